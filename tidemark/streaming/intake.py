"""Continuous intake. Every micro-batch is one publication (see `sources.tables`): its rows and the number of the batch
become visible together, so a replayed batch finds itself done, and a lost executor or a restarted query never doubles
rows. A run is a streaming state folder; one with a new state folder counts batches of its own.

Keys are checked against what is stored, so nothing is dropped for being late, but only where they can lie: topics keep
an index of their ids in buckets of the id's hash, bars lie in parts of a month and a bucket of stocks. A batch reads
as many folders as its keys fall into parts and few of each, however much is stored. The number of buckets is set when a
table begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import has_real_content
from ..operators.ingest import first_by_key, merged_bars, upsert_bars
from ..session import materialize
from ..sources.tables import PART, TableStore, bucket_part, month_part, touched_parts

KEY_BUCKETS = 16
STOCK_BUCKETS = 1


def read_stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder as a stream of new files."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def _start(stream: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None],
           available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(body)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 minutes")
    return writer.start()


def topic_store(spark: SparkSession, sink: str) -> TableStore:
    """Topics lie in the sink itself, the index of their ids beside them, out of sight of other readers."""
    return TableStore(spark, sink, {"topics": "", "keys": "_keys"})


def stream_topics(stream: DataFrame, sink: str, checkpoint: str, order: str = "seq",
                  available_now: bool = True, buckets: int = KEY_BUCKETS) -> StreamingQuery:
    """Append topics with readable content whose id the table does not have yet."""
    schema = stream.schema

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store, run = topic_store(spark, sink), _run_of(spark, checkpoint)
        now = store.manifest()
        if now.done.get(run, -1) >= batch_id:
            return
        fixed = {"buckets": buckets} | now.settings
        bucket = bucket_part(F.col("topic_id"), fixed["buckets"])
        usable = batch.filter(has_real_content(F.col("title"), F.col("content")))
        keys = StructType([schema["topic_id"]])
        known = store.read("keys", keys, touched_parts(usable, bucket), now)
        fresh = materialize(first_by_key(usable.join(known, "topic_id", "left_anti"), ["topic_id"], order).select(*schema.names))
        store.publish(now, append={"topics": fresh.withColumn(PART, bucket), "keys": fresh.select("topic_id").withColumn(PART, bucket)},
                      done={run: batch_id}, settings=fixed)

    return _start(stream, checkpoint, body, available_now)


def publish_bars(store: TableStore, incoming: DataFrame, as_of: str, schema: StructType, done: dict[str, int] | None = None,
                 buckets: int = STOCK_BUCKETS) -> DataFrame:
    """Upsert into the stored bars (see `upsert_bars`) and publish; the counts per stock. Only parts that the incoming dates
    and stocks fall into are read, and only those that change are written."""
    now = store.manifest()
    fixed = {"buckets": buckets} | now.settings
    part = F.concat_ws("-", month_part(F.col("trade_date")), bucket_part(F.col("stock_id"), fixed["buckets"]))
    dated = incoming.withColumn("trade_date", F.try_to_date("date")).where("trade_date IS NOT NULL")
    existing = store.read("bars", schema, touched_parts(dated, part), now)
    changes, counts = upsert_bars(existing, incoming, as_of)
    changes, counts = materialize(changes), materialize(counts)
    merged = merged_bars(store.read("bars", schema, touched_parts(changes, part), now), changes).select(*schema.names)
    store.publish(now, replace={"bars": merged.withColumn(PART, part)}, done=done, settings=fixed)
    return counts


def stream_bars(stream: DataFrame, sink: str, checkpoint: str, as_of: Callable[[int], str],
                schema: StructType, available_now: bool = True, buckets: int = STOCK_BUCKETS) -> StreamingQuery:
    """Upsert bars batch by batch: past days once, the running day replaced after its close.

    `as_of` gives the UTC time of a batch; `schema` is the table's.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        store, run = TableStore(batch.sparkSession, sink), _run_of(batch.sparkSession, checkpoint)
        if store.manifest().done.get(run, -1) < batch_id:
            publish_bars(store, batch, as_of(batch_id), schema, {run: batch_id}, buckets)

    return _start(stream, checkpoint, body, available_now)


def current_bars(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """The bar table."""
    return TableStore(spark, sink).read("bars", schema)


def current_topics(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """The topic table."""
    return topic_store(spark, sink).read("topics", schema)
