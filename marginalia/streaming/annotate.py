"""Documents that keep arriving: each one is annotated once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.corpus import remaining


def annotate_stream(arriving: DataFrame, annotate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, id: str = "doc_id") -> StreamingQuery:
    """Annotate documents of a stream into the Parquet folder ``out``, those that haven't come before.

    Beside it, ``<out>.ids`` is a ledger of the ids that batches took, with or without
    tokens; a batch reads the ledger, never the output. Both are partitioned by stream
    and batch. A batch that runs again after a failure replaces what it wrote, so
    nothing is there twice. Within a batch the first row of an id counts.
    """
    ledger = f"{out}.ids"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        new = remaining(rows.dropDuplicates([id]), _taken(spark, ledger, id, rows, stream, number), id)
        annotate(new).write.mode("overwrite").parquet(f"{out}/stream={stream}/batch={number}")
        new.select(id).write.mode("overwrite").parquet(f"{ledger}/stream={stream}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _taken(spark: SparkSession, ledger: str, id: str, like: DataFrame, stream: str, number: int) -> DataFrame:
    """Ids of all batches but this one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return like.select(id).limit(0)
    return spark.read.parquet(ledger).where((F.col("stream") != stream) | (F.col("batch") != number)).select(id)
