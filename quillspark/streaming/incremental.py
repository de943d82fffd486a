"""Scores of files that keep arriving (an extension): a stream of (scan_index, path, content) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import token_count
from quillspark.operators.scoring import basic_score


def scored(stream: DataFrame, question: str) -> DataFrame:
    """The stream with score and token_count; no state is kept."""
    return stream.withColumns({"score": basic_score(F.col("path"), F.col("content"), question), "token_count": token_count(F.col("content"))})


def write_scores(stream: DataFrame, question: str, output: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append scores to Parquet, each arriving file once."""
    return scored(stream, question).drop("content").writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
