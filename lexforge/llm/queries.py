"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op6_decontam
from .html import op3_html
from .linededup import OP10_SQL, op10_linededup
from .packing import op9_packing
from .quality import op5_quality
from .sharding import op2_sharding
from .simhash import op4_simhash
from .substring import OP7_SQL, op7_substring
from .toxicity import op8_toxicity
from .urlfilter import OP1_SQL, op1_urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urlfilter": op1_urlfilter,
    "op2_sharding": op2_sharding,
    "op3_html": op3_html,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_decontam": op6_decontam,
    "op7_substring": op7_substring,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_linededup": op10_linededup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_urlfilter": OP1_SQL,
    "op7_substring": OP7_SQL,
    "op10_linededup": OP10_SQL,
}
