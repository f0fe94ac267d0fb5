"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage; ``corpus_pipeline.py`` at
the repository top composes five of its operators.
"""
