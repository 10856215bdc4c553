"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP1_SQL, op1_exact_dedup
from .jaccard_join import op8_jaccard_join
from .mixing import op4_mix
from .packing import op5_pack
from .pii import op10_pii
from .quality import OP3_SQL, op3_quality
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op9_token_counts
from .toxicity import op7_toxicity
from .warc import OP2_SQL, op2_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_warc, op3_quality, op4_mix, op5_pack,
        op6_suffix_dedup, op7_toxicity, op8_jaccard_join, op9_token_counts, op10_pii,
    )
}

SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op3_quality": OP3_SQL}
