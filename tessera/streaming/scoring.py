"""Network scoring on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.surrogate import Network, mlp_score


def score_stream(df: DataFrame, net: Network, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The batch scoring operator on a streaming table; stateless, appended to a parquet folder."""
    return (mlp_score(df, net).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
