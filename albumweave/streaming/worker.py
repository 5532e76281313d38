"""The worker as a stream: message files in, state tables per event and results out.

Order inside a batch: state first, as one version of all its tables, then results, then the ledger of jobs that are
answered, then the offsets (by Spark, when the batch function returns). A batch that is run again finds its photos stored
and its corrections made, writes the same state and replaces its own results, so every message takes effect once. A job
that was answered in an earlier batch is done again, which changes nothing, but not answered again.

Messages of one event are taken in order of files and lines: a batch is worked off in turns of at most one message for
each event, all events side by side. A batch that fails is tried again when the stream is started again (`keep_running`
does so); at its last attempt events are taken one by one, so that those that can't be done are answered `failed`, and
their messages are kept with the dead letters, while all others are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from albumweave.operators import jobs, messages, second
from albumweave.operators.graph import settled, working
from albumweave.sources import events, versions

ATTEMPTS = 3
NONHUMAN = "event_id string, face_id string"
TEXTS = "event_id string, body string"
#: Buckets of the ledger: a batch reads and writes those of its jobs alone.
BUCKETS, LEDGER = 1024, "event_id string, job_id string, batch_id long"
#: Results above this are marked, as queues take no larger message.
LARGEST_RESULT = 256 * 1024


def inbox(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """Lines of new files, `per_batch` files a time."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def progress(ticks: DataFrame) -> DataFrame:
    """The furthest tick of each job: later or repeated deliveries of earlier ones change nothing."""
    return ticks.groupBy("job_id").agg(F.max("processed").alias("processed"), F.max("total").alias("total"))


def stored(spark: SparkSession, state: str, touched: DataFrame | None = None) -> jobs.State:
    """The state of all events, or of the touched ones (event_id)."""
    of = lambda name, schema: versions.read(spark, state, name, schema if not isinstance(schema, str) else spark.createDataFrame([], schema).schema, touched)
    faces = events.completed(of("faces", events.FACES))
    return jobs.State(faces, of("links", events.CONSTRAINTS), of("nonhuman", NONHUMAN), events.decoded_scores(of("scores", TEXTS)), events.decoded_verdicts(of("verdicts", TEXTS)))


def keep(spark: SparkSession, path: str, now: jobs.State, touched: DataFrame) -> int:
    """Put the touched events' state in place of the one before. An event without faces leaves nothing behind, neither
    links nor what was said of its faces."""
    tables = {"faces": now.faces, "links": now.links, "nonhuman": now.nonhuman, "scores": events.encoded_scores(now.scores), "verdicts": events.encoded_verdicts(now.verdicts)}
    alive = now.faces.select("event_id").distinct()
    held = {k: x if k == "faces" else x.join(alive, "event_id", "left_semi").select(*x.columns) for k, x in tables.items()}
    return versions.commit(spark, path, held, touched, alive)


def numbered(batch: DataFrame) -> DataFrame:
    """Parsed messages with their `turn` in their event: in order of file and line."""
    at = [c for c in ("file", "at") if c in batch.columns]
    rows = settled(messages.parsed(batch.withColumn("line", F.monotonically_increasing_id())))
    order = Window.partitionBy(F.col("message.event_id"), F.col("message").isNull()).orderBy(*at, "line")
    return rows.withColumn("turn", F.row_number().over(order))


def _of(state: jobs.State, wanted: DataFrame, how: str = "left_semi") -> jobs.State:
    return jobs.State(*(x.join(wanted, "event_id", how).select(*x.columns) for x in vars(state).values()))


def applied(spark: SparkSession, rows: DataFrame, state: str, extract: Callable[[DataFrame], DataFrame], judges: second.Judges | None = None) -> DataFrame:
    """Bring the events of numbered messages up to date and return a result row for each message. An event is carried
    from turn to turn as long as it has messages; what is finished is not touched again."""
    good = settled(rows.where("message IS NOT NULL").select("turn", "message.*"))
    touched = settled(good.select("event_id").distinct())
    now, finished, out = stored(spark, state, touched), None, None
    last = good.groupBy("event_id").agg(F.max("turn").alias("last"))
    for turn in range(1, (good.agg(F.max("turn")).first()[0] or 0) + 1):
        now, result = jobs.done(now, good.where(F.col("turn") == turn).drop("turn"), extract, judges=judges)
        out = result if out is None else out.unionByName(result)
        more = last.where(F.col("last") > turn).select("event_id")
        done = _of(now, more, "left_anti")
        finished = done if finished is None else jobs.State(*(a.unionByName(b) for a, b in zip(vars(finished).values(), vars(done).values(), strict=True)))
        now = _of(now, more)
    if finished is not None:
        keep(spark, state, finished, touched)
    poison = rows.where("message IS NULL AND job_id IS NOT NULL").select("job_id", F.lit("failed").alias("status"))
    return poison if out is None else out.unionByName(poison, allowMissingColumns=True)


def one_by_one(spark: SparkSession, rows: DataFrame, state: str, extract: Callable[[DataFrame], DataFrame], judges: second.Judges | None = None) -> tuple[DataFrame, list[str]]:
    """As `applied`, event by event; an event that fails is answered so and left as it is. (results, failed events)"""
    out = applied(spark, rows.where("message IS NULL"), state, extract, judges)
    failed = []
    for r in rows.where("message IS NOT NULL").select("message.event_id").distinct().collect():  # a batch's events
        own = rows.where(F.col("message.event_id") == r.event_id)
        try:
            out = out.unionByName(applied(spark, own, state, extract, judges), allowMissingColumns=True)
        except Exception:  # noqa: BLE001  whatever it is, it has failed ATTEMPTS times
            failed.append(r.event_id)
            out = out.unionByName(own.select("message.job_id", "message.event_id", F.lit("failed").alias("status")), allowMissingColumns=True)
    return out, failed


def _attempt(spark: SparkSession, folder: str) -> int:
    """Which attempt this is, by the marks that earlier ones left."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    n = len(fs.listStatus(path)) + 1
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, str(n)), True).close()
    return n


def unanswered(spark: SparkSession, results: DataFrame, ledger: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """(results of jobs that no other batch has answered, the ledger's rows of their buckets with these)."""
    out = results.dropDuplicates(["job_id"]).withColumn("event_bucket", F.pmod(F.crc32(F.col("job_id").cast("binary")), F.lit(BUCKETS)).cast("string"))
    out = settled(out)
    buckets = out.select(F.col("event_bucket").alias("event_id")).distinct()
    held = settled(versions.read(spark, ledger, "jobs", spark.createDataFrame([], LEDGER).schema, buckets))
    fresh = out.join(held.where(F.col("batch_id") != batch_id).select("job_id"), "job_id", "left_anti")
    own = fresh.select(F.col("event_bucket").alias("event_id"), "job_id", F.lit(batch_id).cast("long").alias("batch_id"))
    return fresh.drop("event_bucket"), held.where(F.col("batch_id") != batch_id).unionByName(own)


def start(source: DataFrame, state: str, results: str, quarantine: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], once: bool = True, attempts: int = ATTEMPTS, judges: second.Judges | None = None) -> StreamingQuery:
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        n = _attempt(spark, f"{checkpoint}-attempts/{batch_id}")
        with working(spark):
            rows = settled(numbered(batch))
            if n < attempts:
                out, failed = applied(spark, rows, state, extract, judges), []
            else:
                out, failed = one_by_one(spark, rows, state, extract, judges)
            out, jobs_done = unanswered(spark, out, f"{checkpoint}-ledger", batch_id)
            # Folders by batch: a repeated batch replaces its own.
            too_large = F.octet_length(F.to_json(F.struct(*out.columns))) > LARGEST_RESULT
            out.withColumn("too_large", too_large).write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")
            versions.commit(spark, f"{checkpoint}-ledger", {"jobs": jobs_done}, jobs_done.select("event_id"))
            dead = F.col("message").isNull() | F.coalesce(F.col("message.event_id").isin(failed), F.lit(False))
            rows.where(dead).write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def keep_running(begin: Callable[[], StreamingQuery], attempts: int = ATTEMPTS) -> None:
    """Start a stream and wait for it; start it again when it fails, so often that every batch gets its last attempt."""
    for left in range(attempts - 1, -1, -1):
        try:
            begin().awaitTermination()
            return
        except StreamingQueryException:
            if not left:
                raise
