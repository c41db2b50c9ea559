"""Feature extraction over a stream of functions; matching itself needs both programs whole."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.features import extract_features
from ..sources.programs import with_defaults


def stream_features(functions: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends the features of each new function to a Parquet table; stateless, exactly once."""
    features = extract_features(with_defaults(functions))
    return features.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
