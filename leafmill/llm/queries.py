"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP2_SQL, op2_decontaminate
from .language import op7_language
from .licenses import op5_licenses
from .mixing import OP4_SQL, op4_mixing
from .quality import op8_quality
from .simhash import op3_simhash
from .tokens import op9_tokens
from .topk import OP6_SQL, op6_topk
from .toxicity import op10_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_licenses": op5_licenses,
    "op6_topk": op6_topk,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_tokens": op9_tokens,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op2_decontaminate": OP2_SQL, "op4_mixing": OP4_SQL, "op6_topk": OP6_SQL}
