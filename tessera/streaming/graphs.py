"""Graphs over streams. Operators of columns are projections, so a graph of them is a streaming query as it is; operators
that change rows or must be fitted are fitted on a table first, and refused where a stream cannot run them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.graph import Graph


def transform_stream(graph: Any, stream: DataFrame) -> DataFrame:
    graph = graph if isinstance(graph, Graph) else Graph(graph)
    if not stream.isStreaming:
        raise ValueError("this is not a stream")
    changing = [n.label for n in graph.nodes if n.op is not None and n.op.changes_rows]
    if changing:
        raise ValueError(f"{', '.join(changing)} cannot run on a stream")
    return graph.transform(stream)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """To Parquet files, exactly once per row; with once, all that is there now and then an end."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
