"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_byte_bpe

from .fingerprints import op7_simhash
from .html import op3_html_main_text
from .licenses import op8_license_diagonals
from .neardup import op9_order_minhash
from .packing import op4_harmonic_packing
from .quality import op6_quality_rules
from .shards import op1_hilbert_sharding
from .topk import OP10_SQL, op10_exact_topk
from .toxicity import op5_toxic_spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hilbert_sharding,
        op2_byte_bpe,
        op3_html_main_text,
        op4_harmonic_packing,
        op5_toxic_spans,
        op6_quality_rules,
        op7_simhash,
        op8_license_diagonals,
        op9_order_minhash,
        op10_exact_topk,
    )
}

ORACLE_SQL: dict[str, str] = {"op10_exact_topk": OP10_SQL}
