"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm.decontaminate import op10_decontamination
from larkspan.llm.fingerprints import op4_fingerprints
from larkspan.llm.line_dedup import op7_line_dedup
from larkspan.llm.packing import op8_packing
from larkspan.llm.secrets import op3_secrets
from larkspan.llm.simhash_gray import op1_simhash_gray
from larkspan.llm.substring_dedup import op2_substring_dedup
from larkspan.llm.suffix_dedup import op5_suffix_dedup
from larkspan.llm.token_counts import op6_token_counts
from larkspan.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_simhash_gray, op2_substring_dedup, op3_secrets, op4_fingerprints, op5_suffix_dedup,
        op6_token_counts, op7_line_dedup, op8_packing, op9_toxicity, op10_decontamination,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {}
