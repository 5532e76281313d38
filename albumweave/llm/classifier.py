"""A quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader
updates and applied as sparse dot products.

Tokens are runs of letters and digits with A-Z lowered, and single other marks; features are tokens and pairs of
neighbours, hashed into `BUCKETS` weights (a token beside itself is one feature for all tokens). Training takes at most
about `TRAIN_MOST` labelled texts, by a hash of their doc_id, cut into `TRAIN_SHARDS` parts; each part makes its own
pass of updates in a task and the weights are averaged, `PASSES` times over.

Null and empty texts score as the bias alone. A null doc_id counts as an empty id text and never has a label. Rows that
repeat score alike; of several labels for one doc_id the largest is taken, null labels are left out. Without labels of
both kinds every score is 0.5. Other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumweave.llm.common import materialise, table
from albumweave.llm.words import _BASE, Slice, mix, slices

BITS = 18
BUCKETS = 1 << BITS
TRAIN_MOST, TRAIN_SHARDS, PASSES = 24_000, 6, 3
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.02, 1.0
THRESHOLD = 0.3
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_SAME = np.uint64(0x5A5A_1234_5A5A_4321)


def features(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, tokens of each row) of a slice."""
    kind = _KIND[s.data]
    rows = len(s.doc_off) - 1
    if not len(kind):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(rows, np.int64)
    run = kind == 1
    head, tail = kind > 0, kind > 0
    head, tail = head.copy(), tail.copy()
    head[1:] &= ~(run[1:] & run[:-1])
    tail[:-1] &= ~(run[1:] & run[:-1])
    full = s.doc_off[:-1] < s.doc_off[1:]
    a, b = s.doc_off[:-1][full], s.doc_off[1:][full] - 1
    head[a], tail[b] = kind[a] > 0, kind[b] > 0
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    off = np.searchsorted(starts, s.doc_off)
    h = Slice(s.first, s.last, s.data, s.doc_off, starts, ends, off).hashes()
    n = np.diff(off)
    row = np.repeat(np.arange(rows), n)
    near = row[1:] == row[:-1]
    two = np.where(h[1:] == h[:-1], _SAME, mix(h[:-1] * _BASE + h[1:]))[near]
    bucket = np.concatenate([h, two]) >> np.uint64(64 - BITS)
    return bucket.astype(np.int64), np.concatenate([row, row[1:][near]]), n


def _examples(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text."""
    for s in slices(texts):
        bucket, row, n = features(s)
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(len(n) + 1))
        for k in range(len(n)):
            b, count = np.unique(bucket[order[cuts[k] : cuts[k + 1]]], return_counts=True)
            yield b, count / np.sqrt(max(int(n[k]), 1))


def updated(texts: pa.Array, labels: np.ndarray, z: np.ndarray, n: np.ndarray, alpha: float = ALPHA) -> None:
    """One pass of follow-the-regularised-leader updates; the last weight is the bias."""
    for (b, x), y in zip(_examples(texts), labels.tolist(), strict=True):
        b, x = np.append(b, BUCKETS), np.append(x, 1.0)
        zb, nb = z[b], n[b]
        w = weights(zb, nb, alpha)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
        z[b] += g - sigma * w
        n[b] += g * g


def weights(z: np.ndarray, n: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / alpha + L2))


def train(examples: DataFrame, shards: int = TRAIN_SHARDS, passes: int = PASSES) -> np.ndarray:
    """Weights from a table (doc_id, text, label) of bounded size."""
    dealt = materialise(examples.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")), "examples")
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    sc = examples.sparkSession.sparkContext
    for _ in range(passes):
        state = sc.broadcast((z.astype(np.float32), n.astype(np.float32)))

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("order", "ascending")])
            z, n = (x.astype(np.float64) for x in state.value)  # noqa: B023
            updated(rows.column("text"), rows.column("label").to_numpy(), z, n)
            return pa.table({"z": [z.astype("<f4").tobytes()], "n": [n.astype("<f4").tobytes()]})

        order = F.xxhash64("doc_id", F.lit(11)).alias("order")
        found = dealt.select("shard", "text", "label", order).groupBy("shard").applyInArrow(run, "z binary, n binary").collect()  # a few rows of fixed size
        if found:
            z, n = (np.mean([np.frombuffer(r[k], "<f4") for r in found], 0).astype(np.float64) for k in "zn")
        state.unpersist()
    return weights(z, n)


def fold(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_MOST) -> DataFrame:
    """(doc_id, text, label): labelled texts outside the held-out fold, about `most` of them at most."""
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold(5) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = materialise(known, "labels")
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `most` pairs of numbers


def scores(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """doc_id, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            out = []
            for s in slices(batch.column(1)):
                bucket, row, n = features(s)
                dot = np.bincount(row, w[bucket], minlength=len(n)) / np.sqrt(np.maximum(n, 1))
                out.append(1 / (1 + np.exp(-np.clip(dot + w[-1], -35, 35))))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    out = scores(docs, train(sample(docs, labels)))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
