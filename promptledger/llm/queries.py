"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP5_SQL, op5_chat_format
from .common import table
from .decontaminate import OP6_SQL, op6_decontamination
from .fast_sketch import op12_fast_sketch
from .feistel import op8_pii
from .line_dedup import OP7_SQL, op7_line_dedup
from .ngram_join import op9_ngram_join
from .quality_model import op3_quality_classifier
from .quality_rules import OP10_SQL, op10_quality_rules
from .ranked_search import OP11_SQL, op11_ranked_search
from .sentence_pieces import op1_sentencepiece
from .suffix_dedup import op2_suffix_dedup
from .token_alignment import op13_token_alignment
from .toxicity_model import op4_toxicity


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, "documents"))

    run.__name__, run.__doc__ = operator.__name__, operator.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": _documents(op1_sentencepiece),
    "op2_suffix_dedup": _documents(op2_suffix_dedup),
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_chat_format": op5_chat_format,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": _documents(op7_line_dedup),
    "op8_pii": _documents(op8_pii),
    "op9_ngram_join": _documents(op9_ngram_join),
    "op10_quality_rules": _documents(op10_quality_rules),
    "op11_ranked_search": op11_ranked_search,
    "op12_fast_sketch": _documents(op12_fast_sketch),
    "op13_token_alignment": _documents(op13_token_alignment),
}

ORACLES: dict[str, str] = {
    "op5_chat_format": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op10_quality_rules": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
}
