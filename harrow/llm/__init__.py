"""Training-data operators: dedup, language-model scoring, quality, mixing, tokenizing, HTML, PII.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames and can be
used without the thin ``opN_*`` queries in ``harrow.llm.queries``.
"""
