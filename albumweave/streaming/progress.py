"""How far jobs have come, beside the stream of results and never in its way.

While images are read, tasks leave a mark for each one in a folder; a mark that can't be written is passed over. A stream
over that folder remembers which images of a job it has seen and how far it has told, and gives each tick once: 0 when
a job is first seen, every third image, and the last. What the sink makes of ticks can fail without a trace elsewhere."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from albumweave.sources.files import put

MARK = "job_id string, image_id string, total long"
TICK = "job_id string, processed long, total long"
EVERY = 3
#: How long a finished job is remembered, in milliseconds.
REMEMBERED = 3_600_000
log = logging.getLogger(__name__)


def mark(folder: str, **what) -> None:
    """Leave a mark from a task; a failure is none of the task's business."""
    try:
        put(folder, f"{uuid.uuid4().hex}.json", json.dumps(what).encode())
    except Exception:  # noqa: BLE001
        log.warning("no mark for %s", what, exc_info=True)


def extractor(read: Callable[[dict], list[dict]], kinds: dict[str, str], marks: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """What `jobs.done` takes as `extract`, from a function of one image (a dict with event_id, image_id, s3_key) that
    gives its faces as dicts of `kinds` (names and types). An image that can't be read is a row with an error."""
    schema = ", ".join(["event_id string", "photo_id string", "error string", *(f"{k} {t}" for k, t in kinds.items())])

    def extract(asked: DataFrame) -> DataFrame:
        names = ["event_id", "photo_id", "error", *kinds]
        arrow = to_arrow_schema(asked.sparkSession.createDataFrame([], schema).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for image in batch.to_pylist():
                    base = {"event_id": image["event_id"], "photo_id": image["image_id"]}
                    try:
                        rows = [base | face for face in read(image)] or [base]
                    except Exception as e:  # noqa: BLE001  whatever an image holds, it is one row
                        rows = [base | {"error": f"{type(e).__name__}: {e}"[:200]}]
                    if marks is not None and image.get("job_id") is not None:
                        mark(marks, job_id=image["job_id"], image_id=image["image_id"], total=image["total"])
                    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in rows], schema=arrow)

        return asked.mapInArrow(run, schema)

    return extract


def ticks(marks: DataFrame, every: int = EVERY) -> DataFrame:
    """Ticks (job_id, processed, total) of a stream of marks, each once, whatever comes twice or late."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, told, total = state.get if state.exists else ("[]", -1, 0)
        ids = set(json.loads(seen))
        for part in parts:
            ids.update(part["image_id"].dropna())
            total = max(total, int(part["total"].max()))
        done = total if told == total else min(len(ids), total)
        new = [0] if told < 0 else []
        new += [n for n in range(max(told, 0) + 1, done + 1) if n % every == 0 or n == total]
        state.update(("[]" if done == total else json.dumps(sorted(ids)), max([told, *new]), total))
        state.setTimeoutDuration(REMEMBERED)
        if new:
            yield pd.DataFrame({"job_id": key[0], "processed": new, "total": total})

    return marks.groupBy("job_id").applyInPandasWithState(step, TICK, "seen string, told long, total long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def start(spark: SparkSession, folder: str, sink: Callable[[DataFrame], None], checkpoint: str, once: bool = True, every: int = EVERY) -> StreamingQuery:
    """Feed the ticks of new marks to a sink; what it raises is logged, and those ticks are lost."""

    def told(batch: DataFrame, batch_id: int) -> None:
        try:
            sink(batch)
        except Exception:  # noqa: BLE001
            log.warning("ticks of batch %s were not told", batch_id, exc_info=True)

    stream = spark.readStream.schema(MARK).json(folder)
    writer = ticks(stream.where(F.col("job_id").isNotNull()), every).writeStream.foreachBatch(told).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
