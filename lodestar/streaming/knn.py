"""Search of a static point table by a stream of query vectors.

Each micro-batch is one :func:`lodestar.operators.knn.knn_join`; nothing is
kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestar.model import KnnSpec
from lodestar.operators.knn import knn_join


def knn_stream(points: DataFrame, queries: DataFrame, spec: KnnSpec, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the neighbours of every batch of ``queries`` (``query_id, q``) as Parquet, in a folder of the batch's number.

    A batch that is run again after a failure writes the same folder, so
    results are complete and never doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        knn_join(points, batch, spec).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
