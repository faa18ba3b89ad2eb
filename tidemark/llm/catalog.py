"""The operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, htmltext, langid, lines, quality, repair, search, secrets, sharding, simhash, tokencount, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        simhash.op1_simhash_near_dedup,
        bpe.op2_bpe_encoding,
        lines.op3_line_dedup,
        secrets.op4_secret_scan,
        quality.op5_quality_rules,
        toxicity.op6_toxicity,
        tokencount.op7_token_counts,
        decontaminate.op8_benchmark_decontamination,
        htmltext.op9_html_extraction,
        langid.op10_language_id,
        repair.op11_conversation_repair,
        sharding.op12_sharding,
        search.op13_lexical_search,
    )
}

ORACLES: dict[str, str] = {
    "op4_secret_scan": secrets.OP4_SQL,
    "op13_lexical_search": search.OP13_SQL,
}
