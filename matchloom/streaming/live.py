"""Matching of profiles as they arrive: each micro-batch is scored against a static catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import embed, match


def match_stream(profiles: DataFrame, careers: DataFrame, encoder: embed.Encoder, output: str, checkpoint: str, k: int = 5) -> DataStreamWriter:
    """A writer that appends the k best careers of each new profile (user_id, profile_text) to a Parquet table.

    A batch's rows go to a folder of its number, which a repeated batch overwrites, so each profile is matched once.
    """

    def score(batch: DataFrame, number: int) -> None:
        best = match.topk(embed.encode(batch, encoder), careers, k)
        best.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return profiles.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).outputMode("append")
