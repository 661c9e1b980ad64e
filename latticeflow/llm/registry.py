"""Queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules
from .decontam import op1_benchmark_decontamination
from .html_extract import op8_html_extraction
from .line_dedup import op9_line_dedup
from .packing import op4_best_fit_packing
from .quality import op5_quality_classifier
from .quality_rules import op2_quality_rules
from .simhash import op6_simhash_near_dedup
from .token_output import op3_token_output
from .toxicity import op7_toxicity
from .warc import op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_quality_rules, op3_token_output, op4_best_fit_packing, op5_quality_classifier,
        op6_simhash_near_dedup, op7_toxicity, op8_html_extraction, op9_line_dedup, op10_warc,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_rules.ORACLE}
