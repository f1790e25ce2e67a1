"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.bpe_stream import op7_bpe_roundtrip
from quern.llm.chat import OP10_SQL, op10_chat_format
from quern.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from quern.llm.language import op9_language_id
from quern.llm.licences import op6_licences
from quern.llm.line_rules import op2_line_rules
from quern.llm.near_dedup import op8_near_dedup
from quern.llm.packing import op5_packing
from quern.llm.quality import op3_quality
from quern.llm.tokens import op1_token_counts


QUERIES = (
    op1_token_counts, op2_line_rules, op3_quality, op4_exact_dedup, op5_packing,
    op6_licences, op7_bpe_roundtrip, op8_near_dedup, op9_language_id, op10_chat_format,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op10_chat_format": OP10_SQL}
