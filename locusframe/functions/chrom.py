"""Chromosome names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that are taken off in order; the flag says that a digit must follow.
PREFIXES = (
    (r"chromosome[_-]?", False),
    (r"chr", False),
    (r"[a-z]+[0-9.]*ch", True),
    (r"(?:os|gm|at|zm|pv|ps|ah)", True),
    (r"ca[p]?[a-z_]*(?:chr)?", True),
)


def _stripped(name: Column) -> Column:
    c = F.trim(name.cast("string"))
    for prefix, digit in PREFIXES:
        c = F.regexp_replace(c, f"(?i)^{prefix}" + ("(?=[0-9])" if digit else ""), "")
    c = F.regexp_replace(c, r"^([0-9]+)[Hh]$", "$1")
    return F.regexp_replace(c, r"^0+([0-9])", "$1")


def clean_chr(name: Column) -> Column:
    """A number as text, or ``ALT`` for all that is none."""
    c = _stripped(name)
    return F.when(c.rlike("^[0-9]+$"), c).otherwise("ALT")


def canon_chr(name: Column) -> Column:
    """As :func:`clean_chr`, but names without a number stay, and an empty one is ``0``."""
    c = F.coalesce(_stripped(name), F.lit(""))
    return F.when(c == "", "0").otherwise(c)


def chr_number(label: Column) -> Column:
    """The number of a clean label; 0 for ``ALT``."""
    return F.coalesce(label.try_cast("int"), F.lit(0))


def stripped_sql(c: str) -> str:
    """The same in DuckDB, whose regular expressions know no lookahead."""
    c = f"trim({c})"
    for prefix, digit in PREFIXES:
        c = f"regexp_replace({c}, '^{prefix}([0-9])', '\\1', 'i')" if digit else f"regexp_replace({c}, '^{prefix}', '', 'i')"
    return f"regexp_replace(regexp_replace({c}, '^([0-9]+)[Hh]$', '\\1'), '^0+([0-9])', '\\1')"


#: Names to test with, as they occur in public assemblies.
EXAMPLES = (
    "1", "01", "chr1", "Chr02", "CHR10", "chromosome_3", "Chromosome-04", "chromosome5", "SL4.0ch06", "SL2.50ch11", "Os01", "Gm07", "At3", "Zm10", "Pv08",
    "Ps4", "Ah12", "Ca1", "CaChr05", "1H", "7h", "chr3H", "scaffold_12", "Un", "chrUn", "MT", "", "00", "chr00", "Pt", "X", "10",
)
