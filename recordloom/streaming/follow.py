"""Collections and usage as streams: commits followed in order, state kept, usage summed by day, idle sessions closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from ..operators.lineage import fresh_folder
from ..operators.versions import KEY, newest
from ..sources.store import create_once, read_object


def follow(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Entries of a collection as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def upsert_state(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """State after a batch: the entry of the highest commit wins, however batches are ordered."""
    cols = batch.columns
    return newest(batch if state is None else state.select(cols).unionByName(batch)).select(cols)


def keep_state(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """State tables under root, one for each batch; a batch that runs again writes the same one."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{root}/{n - 1}") if n else None
        upsert_state(batch, before).repartition(*KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(f"{root}/{n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_usage(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Sums by day, account, collection and metric; events delivered again within the watermark count once."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["r", "i"])
    day = F.window("ts", "1 day")
    return once.groupBy(day.alias("day"), "account", "collection", "metric").agg(F.sum("amount").alias("amount")).withColumn("day", F.date_format("day.start", "yyyy-MM-dd"))


def idle_sessions(stream: DataFrame, idle: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Push sessions: each upload extends one until it has idled."""
    w = F.session_window("ts", idle)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "session").agg(F.count("*").alias("uploads")).select("session", F.col("w.start").alias("opened"), F.col("w.end").alias("expires"), "uploads")


def run_now(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that is there now, to a sink for batches."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def gathered(stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """All that a stream gives of what is there now, as a table in the shared folder; in update mode the newest row of each key."""
    spark = stream.sparkSession
    root = fresh_folder(spark, "stream")

    def sink(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/rows/batch={n}")  # a batch that runs again writes the same place

    run_now(stream, f"{root}/checkpoint", sink, mode)
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{root}/rows/*")
    if key:
        rest = [c for c in out.columns if c not in key]
        out = out.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))
    return out.select(*stream.columns)


def notices(versions: DataFrame, hooks: DataFrame, sent: DataFrame) -> DataFrame:
    """Deliveries that published versions (collection, version, bump) ask for: hooks (hook, collection, enabled, bumps) of their collection that want such a bump, but those already sent (hook, version)."""
    rows = versions.join(hooks.where("enabled"), "collection").where(F.array_contains("bumps", F.col("bump")))
    return rows.select("hook", "collection", "version", "bump").join(sent.select("hook", "version"), ["hook", "version"], "left_anti")


# Fixed values of the deliveries.
FIRST_WAIT, LONGEST_WAIT, MOST_TRIES = 60, 6 * 3600, 5


def retries(tries: DataFrame, first: int = FIRST_WAIT, longest: int = LONGEST_WAIT, most: int = MOST_TRIES) -> DataFrame:
    """tries (delivery, attempt, at, ok, terminal), of each its last: delivered, given up, or when to try again; waits double from the first to the longest."""
    last = tries.groupBy("delivery").agg(F.max_by(F.struct("attempt", "at", "ok", "terminal"), "attempt").alias("t")).select("delivery", "t.*")
    over = F.col("terminal") | (F.col("attempt") >= most)
    wait = F.least(F.lit(first) * F.pow(F.lit(2), F.col("attempt") - 1), F.lit(longest)).cast("long")
    return last.select("delivery", "attempt", F.when(F.col("ok"), "delivered").when(over, "given up").otherwise("again").alias("status"), F.when(~F.col("ok") & ~over, F.col("at") + wait).alias("next_at"))


def run_chain(spark: SparkSession, ledger: str, jobs: list[tuple[str, Callable[[], None]]], budget: int | None = None) -> list[str]:
    """Jobs in order, each once: a job is marked in the ledger when it is done, so a chain that is started again goes on behind it. A job that was cut short runs again and must bear that. With a budget at most so many run; returns those that did."""
    ran = []
    for name, job in jobs:
        if budget is not None and len(ran) >= budget:
            break
        if read_object(spark, f"{ledger}/{name}.done") is None:
            job()
            create_once(spark, f"{ledger}/{name}.done", b"done")
            ran.append(name)
    return ran
