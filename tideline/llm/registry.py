"""Queries and SQL of the subpackage's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op2_minhash as op2
from . import op8_quality as op8
from . import op11_negatives as op11
from .op1_suffix import op1_suffix
from .op3_sentencepiece import op3_sentencepiece
from .op4_ogg import op4_ogg
from .op5_html import op5_html
from .op6_pii import op6_pii
from .op7_lm import op7_lm
from .op9_packing import op9_packing
from .op10_language import op10_language
from .op12_quality_qda import op12_quality_qda
from .op13_periodic import op13_periodic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix, op2.op2_minhash, op3_sentencepiece, op4_ogg, op5_html, op6_pii, op7_lm, op8.op8_quality, op9_packing, op10_language, op11.op11_negatives, op12_quality_qda, op13_periodic)}
SQL: dict[str, str] = {"op2_minhash": op2.SQL, "op8_quality": op8.SQL, "op11_negatives": op11.SQL}
