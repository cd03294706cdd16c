"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP10_SQL, op10_decontamination
from .lines import OP8_SQL, op8_lines
from .minhash import OP5_SQL, op5_minhash
from .packing import op1_packing
from .personal import op6_personal
from .pivots import OP7_SQL, op7_pivots
from .sharding import OP9_SQL, op9_sharding
from .substrings import OP3_SQL, op3_substrings
from .toxicity import op4_toxicity
from .warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_warc": op2_warc, "op3_substrings": op3_substrings, "op4_toxicity": op4_toxicity, "op5_minhash": op5_minhash, "op6_personal": op6_personal, "op7_pivots": op7_pivots, "op8_lines": op8_lines, "op9_sharding": op9_sharding, "op10_decontamination": op10_decontamination}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_substrings": OP3_SQL, "op5_minhash": OP5_SQL, "op7_pivots": OP7_SQL, "op8_lines": OP8_SQL, "op9_sharding": OP9_SQL, "op10_decontamination": OP10_SQL}
