"""Sequence packing by the sum-of-squares rule: a piece goes where the sum over residual gaps of the squared number
of open sequences with that gap becomes smallest.

Null and empty texts are one piece that holds the end id alone. Repeated rows are packed as often as they occur, a
null doc_id is kept, and other columns are ignored. An empty table gives an empty result. Very long texts are cut into
pieces; one with a long run of white space or without any is given to the full tokenizer, as the quick one can't take it."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumweave.llm.common import materialise, table

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs; each group leaves a few partly filled sequences.
GROUP = 16_384
SPECIAL = "<|endoftext|>"
#: Runs of white space and words from which on texts go to the full tokenizer.
LONG_SPACE, LONG_WORD = re.compile(r"\s{200}"), 2000
_ENCODERS: dict = {}


def encoder(json_path: str, ranks_path: str):
    """A function from text to ids. Both files hold one vocabulary; the ranks are the quicker to apply, and the full
    tokenizer is taken for texts with its special token's string or with long runs."""
    if json_path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        full = Tokenizer.from_file(json_path)

        def encode(text: str) -> np.ndarray:
            if SPECIAL in text or LONG_SPACE.search(text) or max(map(len, text.split()), default=0) >= LONG_WORD:
                return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(quick.encode_ordinary(text), np.uint32)

        _ENCODERS[json_path] = encode
    return _ENCODERS[json_path]


def pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only texts over `capacity` ids are cut; then the
    first piece takes the remainder and all others are full."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for c, v in zip(cols, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, taken from the longest down. A new sequence is one more choice, of the gap
    `capacity`, which counts none; among gaps with equal results the smallest is taken."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    new = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        # What the sum grows by, halved: one less of the gap, one more of what remains of it; a filled one counts none.
        have = np.append(np.flatnonzero(count[n:capacity]) + n, capacity)
        grows = count[have - n] - count[have] + 1
        grows[have == n] = -count[n]
        grows[-1] = 0 if n == capacity else count[capacity - n]
        grows[:-1] *= 2
        grows[-1] = 2 * grows[-1] + (n < capacity)
        grows[:-1][have[:-1] == n] += 1
        gap = int(have[np.argmin(grows)])
        if gap == capacity:
            seq, new = new, new + 1
        else:
            seq = open_at[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = seq, capacity - gap
        if gap > n:
            count[gap - n] += 1
            open_at[gap - n].append(seq)
    return sequence, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset. Pieces are dealt evenly over groups of about `group`, one task each;
    a sequence never spans two groups."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    groups = max(1, -(-rows.count() // group))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row", kind="stable")
        sequence, part["offset"] = sum_of_squares(part["length"].to_numpy(), capacity)
        part["sequence_id"] = sequence + (int(key[0]) << 32)
        return part[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).groupBy("_group").applyInPandas(run, out)


def packed(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    import public_tokenizers as public

    made = pieces(docs, json_path or public.path("byte_bpe_50k.json"), ranks_path or public.path("byte_bpe_50k.tiktoken"), capacity)
    return pack(materialise(made, "pieces"), capacity)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
