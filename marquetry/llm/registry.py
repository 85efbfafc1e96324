"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquetry.llm.bpe import op3_bpe
from marquetry.llm.chat import op7_chat_format
from marquetry.llm.embed import op8_embedding_dups
from marquetry.llm.license import op9_license_scan
from marquetry.llm.mixing import OP10_SQL, op10_mix_sources
from marquetry.llm.quality_bayes import op1_quality
from marquetry.llm.rules import OP5_SQL, op5_quality_rules
from marquetry.llm.simhash import op4_simhash
from marquetry.llm.token_files import op6_token_files
from marquetry.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_toxicity, op3_bpe, op4_simhash, op5_quality_rules, op6_token_files, op7_chat_format,
        op8_embedding_dups, op9_license_scan, op10_mix_sources,
    )
}

ORACLES: dict[str, str] = {"op5_quality_rules": OP5_SQL, "op10_mix_sources": OP10_SQL}
