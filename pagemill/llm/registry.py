"""Queries of the training-data operators, by the names the entry point registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_katz import op1_katz
from .op2_warc import op2_warc
from .op2_warc import oracle as op2_oracle
from .op3_bradley_terry import op3_bradley_terry
from .op4_nn_descent import op4_nn_descent
from .op5_scaled_sketch import op5_scaled_sketch
from .op6_simhash import op6_simhash
from .op7_chunked_bpe import op7_chunked_bpe
from .op8_mixing import op8_mixing
from .op8_mixing import oracle as op8_oracle
from .op9_licence import op9_licence
from .op10_digest_cache import op10_digest_cache
from .op11_line_runs import op11_line_runs
from .op11_line_runs import oracle as op11_oracle
from .op12_conversations import op12_conversations
from .op12_conversations import oracle as op12_oracle
from .op13_importance import op13_importance
from .op13_importance import oracle as op13_oracle


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_katz": op1_katz,
        "op2_warc": op2_warc,
        "op3_bradley_terry": op3_bradley_terry,
        "op4_nn_descent": op4_nn_descent,
        "op5_scaled_sketch": op5_scaled_sketch,
        "op6_simhash": op6_simhash,
        "op7_chunked_bpe": op7_chunked_bpe,
        "op8_mixing": op8_mixing,
        "op9_licence": op9_licence,
        "op10_digest_cache": op10_digest_cache,
        "op11_line_runs": op11_line_runs,
        "op12_conversations": op12_conversations,
        "op13_importance": op13_importance,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": op2_oracle(), "op8_mixing": op8_oracle(), "op11_line_runs": op11_oracle(), "op12_conversations": op12_oracle(), "op13_importance": op13_oracle()}
