"""Incremental indexing: each micro-batch of a stream becomes a segment of the index at a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators.index import Schema, newest_version, write_segment, write_version
from loomtext.sources.storage import with_workers


def start_indexing(stream: DataFrame, schema: Schema, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of documents (doc_id and fields) to the index at a folder; Index.open() sees each batch once it is whole.

    A batch's segment bears the batch's number and is written before the version that names it. A batch that is run again writes
    its own segment anew and a version that names it once, so a restart neither loses nor doubles any row.
    """
    with_workers(stream.sparkSession)

    def append(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"segment-batch-{number}"
        newest = newest_version(spark, path)
        names = newest[1] if newest else []
        if name not in names:
            write_segment(batch, schema, f"{path}/{name}")
            write_version(spark, path, [*names, name])

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
