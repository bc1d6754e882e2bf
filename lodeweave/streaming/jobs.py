"""Jobs on streams: indexing queue, transcripts, progress, metrics, alerts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import monitoring as M
from ..operators.lineage import cut
from .windows import tumbling

BATCH_FILES = 40


#: Messages that a queue keeps, the newest ones, and seconds that a job's status is kept.
MOST_MESSAGES, STATUS_SECONDS = 1000, 24 * 3600


def numbered(files: DataFrame) -> DataFrame:
    """files (path) with n, their place by path from 0. They are sorted across tasks and written; a row's place is its number in its file and the rows of the files before."""
    rows = cut(files.select("path").orderBy("path"))
    meta = rows.metadataColumn("_metadata")
    placed = rows.select("path", meta["file_name"].alias("file"), meta["row_index"].alias("i"))
    sizes = placed.groupBy("file").agg(F.count("*").alias("k"), F.min("path").alias("first"))
    before = sizes.select("file", (F.sum("k").over(Window.orderBy("first", "file")) - F.col("k")).alias("before"))  # a row a file, not a path
    return placed.join(F.broadcast(before), "file").select("path", (F.col("before") + F.col("i")).alias("n"))


def messages(files: DataFrame, job: str, size: int = BATCH_FILES) -> DataFrame:
    """(job, k, paths): a job's files (path) in messages of ``size`` files."""
    k = F.floor(F.col("n") / size)
    return numbered(files).groupBy(k.alias("k")).agg(F.sort_array(F.collect_list("path")).alias("paths")).select(F.lit(job).alias("job"), "k", "paths")


def trimmed(queue: DataFrame, most: int = MOST_MESSAGES) -> DataFrame:
    """The newest messages (k) of each job's queue."""
    last = queue.groupBy("job").agg(F.max("k").alias("__last"))
    return queue.join(last, "job").where(F.col("k") > F.col("__last") - most).drop("__last")


def drop_batches(files: DataFrame, folder: str, job: str, size: int = BATCH_FILES, now: str | None = None) -> DataFrame:
    """Producer: a job's messages, one Parquet row each, in a drop folder. Gives the job's status row: (job, batches, files, created_at, expires_at)."""
    made = cut(messages(files, job, size))
    made.write.mode("append").parquet(folder)
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    status = made.agg(F.count("*").alias("batches"), F.coalesce(F.sum(F.size("paths")), F.lit(0)).alias("files"))
    return status.select(F.lit(job).alias("job"), "batches", "files", at.alias("created_at"), (at + F.make_dt_interval(secs=F.lit(float(STATUS_SECONDS)))).alias("expires_at"))


def consume(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], schema: str = "job string, k long, paths array<string>", per_trigger: int = 1) -> StreamingQuery:
    """Consumer: messages of the folder in micro-batches until there are none; the checkpoint takes the place of acknowledgements, so a batch that failed comes again and handlers must be idempotent."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(done: DataFrame) -> DataFrame:
    """(job, files, failed): running counters of a stream of results (job, files, failed)."""
    return done.groupBy("job").agg(F.sum("files").alias("files"), F.sum("failed").alias("failed"))


def complete(status: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs of status (job, files) for all of whose files there are results (job, files, failed): their graph can be built."""
    return status.join(progress(done).withColumnRenamed("files", "done"), "job").where(F.col("done") >= F.col("files")).select("job", "files", "failed")


def on_complete(status: DataFrame, done: DataFrame, build: Callable[[str], None]) -> list[str]:
    """Calls build once for each job that is complete; jobs are few, their files may be many. Gives their names."""
    jobs = sorted(r["job"] for r in complete(status, done).select("job").toLocalIterator())
    for job in jobs:
        build(job)
    return jobs


def pending(messages: DataFrame, now, idle: float = 60.0, most_attempts: int = 3) -> DataFrame:
    """What becomes of messages (id, acked, delivered_at, attempts, error) that are not acknowledged: wait, claim (idle for ``idle`` seconds; then after retry_in seconds), dead (too many attempts) or stop (a critical error)."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("delivered_at").cast("timestamp").cast("double")
    what = F.when(F.col("error") == "critical", "stop").when(F.col("attempts") >= most_attempts, "dead").when(age >= idle, "claim").otherwise("wait")
    retry = F.when(what == "claim", F.least(F.lit(60.0), 5.0 * F.pow(F.lit(2.0), F.greatest(F.col("attempts"), F.lit(1)) - 1)))
    return messages.where("not acked").select("id", what.alias("action"), retry.alias("retry_in"))


def workers(spark: SparkSession, folders: dict[str, str], handlers: dict[str, Callable[[DataFrame, int], None]], dead_letters: str, checkpoint: str) -> list[StreamingQuery]:
    """One query for each stream (autosaves, entities, relationships, ...): lines of JSON in its folder go to its handler as (value, message); broken ones go, with the stream's name, to the dead-letter table and count as handled."""

    def worker(name: str) -> StreamingQuery:
        def handle(batch: DataFrame, epoch: int) -> None:
            good, bad = parsed(batch)
            # a folder of its own for each stream and batch: streams write at the same time, and a batch that comes again replaces its letters
            bad.select("value").write.mode("overwrite").parquet(f"{dead_letters}/stream={name}/epoch={epoch}")
            handlers[name](good, epoch)

        stream = spark.readStream.schema("value string").text(folders[name])
        return stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()

    return [worker(name) for name in folders]


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of JSON lines (value): parsed ones, and poison messages for a dead-letter table."""
    v = F.try_parse_json("value")
    return lines.where(v.isNotNull()).withColumn("message", v), lines.where(v.isNull())


def request_metrics(requests: DataFrame) -> DataFrame:
    """One latency row per request (ts, path, latency), its endpoint normalised."""
    return requests.select("ts", F.lit("api").alias("metric_type"), F.lit("latency_ms").alias("metric_name"), F.col("latency").alias("value"), X.normalize_endpoint(F.col("path")).alias("endpoint"))


def window_metrics(rows: DataFrame) -> DataFrame:
    """(start, type, value) of windows (start, event_type, n, total): share of errors in percent, number of slow queries (events of a mean above 50), and requests."""
    bad = F.sum(F.when(F.col("event_type") == "error", F.col("n")).otherwise(0))
    g = rows.groupBy("start").agg((F.lit(100.0) * bad / F.sum("n")).alias("error_rate_high"), F.sum(F.when(F.col("total") / F.col("n") > 50, F.col("n")).otherwise(0)).cast("double").alias("slow_queries"), F.sum("n").cast("double").alias("requests"))
    return g.unpivot("start", ["error_rate_high", "slow_queries", "requests"], "type", "value")


def watch(events: DataFrame, checkpoint: str, rules: DataFrame, sink: Callable[[DataFrame, int], None], size: str = "5 minutes", recent: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Monitoring loop: metrics by window, checked against rules in every micro-batch. recent gives the alerts (type) that are open and suppress their like; by default there are none."""

    def check(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        found = window_metrics(batch).select("type", "value")
        sink(M.alerts(found, rules, recent() if recent else spark.createDataFrame([], "type string")), epoch)

    return tumbling(events, size).writeStream.outputMode("update").foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_rows(df: DataFrame, n: int = 1000, order: str = "ts", tie: str = "event_id") -> DataFrame:
    """A ring buffer: the n newest rows; of equally new ones those of the greatest tie."""
    return df.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(n)
