"""URL filters: pattern rules indexed by their rarest literal token.

A rule without a whole token is found by its longest literal, by one automaton.

Rule syntax: ``||host`` anchors at a host or its subdomains, ``|`` at either end
of the URL, ``*`` is any run, ``^`` a separator or the end, a leading ``@@``
makes an exception. Matching ignores ASCII case. A URL is blocked if a blocking
rule matches and no exception does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

TOKEN = re.compile(r"[a-z0-9%]+")

#: The rules of the production query.
DEFAULT_RULES = (
    "||spam-farm.*^", "||free-bets.*^", "||casino.*^", "||*.casino^", "||cheap-pills.*^", "||adserver.*^", "||ads.*^", "||doubleclick.net^",
    "||tracker.*^", "||click-bait.*^", "||win-prize.*^", "||payday-loans.*^", "||adult-dating.*^", "||warez.*^", "||torrent-hub.*^",
    "/banner/*/ad", "/popunder.", "&adclick=", "?affid=", "/wp-login.php", "/xxx/", "-free-download.", "/cgi-bin/redirect", "|http://go.*/out?",
    "/poker^", "/casino^", "/viagra^", "phishing", "malware-", "|ftp://", ".exe|", ".scr|", "/spam^", "porn", "/link-farm/",
    "@@||docs.*^", "@@/robots.txt|", "@@/privacy^",
)


def compile_rule(rule: str) -> tuple[bool, str]:
    """``(is an exception, regular expression)`` in the syntax shared by Python and RE2, for lower-cased URLs."""
    exception = rule.startswith("@@")
    body = (rule[2:] if exception else rule).lower()
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    out = []
    for c in body:
        out.append(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else c if c.isalnum() or c in "_/&=-%:" else "\\" + c)
    return exception, head + "".join(out) + tail


def literal_tokens(rule: str) -> list[str]:
    """Tokens that every matching URL has as whole tokens.

    A literal run counts only if a non-token character or an anchor bounds it on
    both sides; next to ``*`` or an open end the URL's token may be longer.
    """
    body = (rule[2:] if rule.startswith("@@") else rule).lower()
    anchored_left, anchored_right = body.startswith("|"), body.endswith("|")
    body = body.removeprefix("||").removeprefix("|")
    body = body[:-1] if anchored_right else body
    found = []
    for m in TOKEN.finditer(body):
        a, z = m.span()
        left = body[a - 1] not in "*" if a else anchored_left
        right = body[z] not in "*" if z < len(body) else anchored_right
        if left and right:
            found.append(m[0])
    return found


def open_literal(rule: str) -> str:
    """The longest run of plain characters of a rule, which every matching URL has somewhere; empty if it has none."""
    body = rule[2:] if rule.startswith("@@") else rule
    return max(re.split(r"[*^|]+", body.lower()), key=len)


def build_index(rules: Sequence[str], frequency: dict[str, int]) -> tuple[dict[str, list[int]], dict[str, list[int]], list[int]]:
    """Token to the rules that it is the rarest of; literal to the rules without a usable token; rules without either.

    Ties go to the longer, then the smaller token.
    """
    index: dict[str, list[int]] = {}
    literals: dict[str, list[int]] = {}
    always = []
    for k, rule in enumerate(rules):
        tokens = literal_tokens(rule)
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (frequency.get(t, 0), -len(t), t)), []).append(k)
        elif open_literal(rule):
            literals.setdefault(open_literal(rule), []).append(k)
        else:
            always.append(k)
    return index, literals, always


def token_frequency(pages: DataFrame, rules: Sequence[str], url_col: str = "url") -> dict[str, int]:
    """How many URLs of the whole table have each literal token of the rules."""
    wanted = sorted({t for r in rules for t in literal_tokens(r)})
    if not wanted:
        return {}
    has = F.array_distinct(F.split(F.lower(F.col(url_col)), "[^a-z0-9%]+"))
    found = pages.select(F.explode(F.array_intersect(has, F.array(*map(F.lit, wanted)))).alias("t")).groupBy("t").count().collect()
    return {r[0]: r[1] for r in found}


def filter_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[str] = DEFAULT_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, blocked, rule, n_matched)`` of every row.

    ``rule`` is the number of the first exception that matches, else of the
    first blocking rule, else null; ``n_matched`` counts all that match. Null
    and empty URLs match nothing; a URL of any length is matched whole; null ids
    and repeated rows are kept; an empty table gives no rows; other columns are
    not read, whatever their names. The rules are part of the plan; their number
    does not depend on the data.
    """
    index, literals, always = build_index(rules, token_frequency(pages, rules, url_col))
    compiled = [compile_rule(r) for r in rules]
    schema = pa.schema([("page_id", pa.int64()), ("blocked", pa.bool_()), ("rule", pa.int32()), ("n_matched", pa.int32())])
    state: dict = {}

    def kernel(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not state:
            state["rx"] = [re.compile(x, re.DOTALL).search for _, x in compiled]
            state["a"] = ahocorasick.Automaton()
            for s, ks in literals.items():
                state["a"].add_word(s, ks)
            state["a"].make_automaton()
        rx, blocked, first, number = state["rx"], [], [], []
        for url in b.column(1).to_pylist():
            hit = []
            if url:
                u = url.translate(ASCII_LOWER)
                run = list(always)
                for t in set(TOKEN.findall(u)):
                    run += index.get(t, ())
                if literals:
                    run += {k for _, ks in state["a"].iter(u) for k in ks}
                hit = sorted(k for k in run if rx[k](u))
            allow = [k for k in hit if compiled[k][0]]
            blocked.append(bool(hit) and not allow)
            first.append(allow[0] if allow else hit[0] if hit else None)
            number.append(len(hit))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blocked), pa.array(first, pa.int32()), pa.array(number, pa.int32())], schema=schema)

    return map_arrow(pages.select(F.col(id_col).cast("bigint"), F.col(url_col)), kernel, "page_id bigint, blocked boolean, rule int, n_matched int")


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def oracle_sql(rules: Sequence[str] = DEFAULT_RULES) -> str:
    """DuckDB SQL that runs every rule on every URL."""
    rows = ", ".join(f"({k}, {str(e).lower()}, '{x.replace(chr(39), chr(39) * 2)}')" for k, (e, x) in enumerate(map(compile_rule, rules)))
    return f"""
WITH r(k, ex, rx) AS (VALUES {rows}),
u AS (SELECT row_number() OVER () AS i, page_id, lower(coalesce(url, '')) AS url FROM pages),
m AS (SELECT i, min(CASE WHEN ex THEN k END) AS a, min(CASE WHEN NOT ex THEN k END) AS b, count(*) AS n FROM u JOIN r ON u.url <> '' AND regexp_matches(u.url, r.rx, 's') GROUP BY i)
SELECT page_id, coalesce(b IS NOT NULL AND a IS NULL, false) AS blocked, CAST(coalesce(a, b) AS INTEGER) AS rule, CAST(coalesce(n, 0) AS INTEGER) AS n_matched
FROM u LEFT JOIN m USING (i)"""
