"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    chat_repair,
    decontamination,
    html_extract,
    quality_llr,
    secret_links,
    simhash_dedup,
    source_mix,
    substring_dedup,
    toxicity_grammar,
    warc_derive,
)

MODULES = (simhash_dedup, quality_llr, toxicity_grammar, substring_dedup, html_extract, decontamination, warc_derive, chat_repair, source_mix, secret_links)


def queries() -> dict:
    import corpus_pipeline

    found = {name: query for module in MODULES for name, query in module.QUERIES.items()}
    found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
