"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark, stored as sorted hash arrays, and mapped
by the workers that score texts.

Words are runs other than space and tab to carriage return with A-Z lowered; each text ends with one end token.
1. Each task reduces its tokens and token pairs to distinct ones with counts, cut by hash into shards.
2. Each shard of pairs is merged; it writes its array of pairs and passes on, for each word, how many pairs it begins
   (by count 1, 2, 3 or more) and ends. Pairs are dealt by their own hash, so a frequent word meets in no one task.
3. Each shard of words merges counts and these figures and writes the arrays of words.
4. Tasks map both tables and score whole texts.

Words are told apart by 64-bit hashes; in pairs each word's hash is cut to 40 bits.

Null and empty texts are the end token alone. A null doc_id counts as an empty id text. Repeated rows count as often as
they occur. With no training text the base score has no value (NaN) and the model's is that of one unknown token.
Other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumweave.llm.common import new_folder, table
from albumweave.llm.hash_arrays import HashArrays, discounts, narrow, shard_of, widen, write_shard
from albumweave.llm.words import Slice, mix, slices

START, END = np.uint64(0x0B05_0B05_0B05_0B05), np.uint64(0x0E0D_0E0D_0E0D_0E0D)
_PAIR = np.uint64(0xD1342543DE82EF95)
#: Tokens that a task holds before it reduces them.
HELD = 3_000_000
BLOCK = "kind string, shard int, a binary, b binary, n binary"
BLOCKS = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, the one before it, token bounds of rows) with the end token after each row's words."""
    words, rows = s.hashes(), len(s.off) - 1
    off = s.off + np.arange(rows + 1)
    tok = np.empty(len(words) + rows, np.uint64)
    ends = off[1:] - 1
    tok[ends] = END
    inner = np.ones(len(tok), bool)
    inner[ends] = False
    tok[inner] = words
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[off[:-1]] = START
    return tok, prev, off


#: Bytes of a word's hash within a pair.
CUT = 5


def cut(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - 8 * CUT)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _PAIR + b)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, their sums, a position of each)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], (np.add.reduceat(n[order], first) if len(k) else n[:0]), order[first]


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, slice(int(cuts[k]), int(cuts[k + 1]))


def _counted(shards: int):
    def reduce(tok: np.ndarray, prev: np.ndarray, docs: int) -> pa.RecordBatch:
        rows = []
        w, n, _ = summed(np.append(tok, START), np.append(np.ones(len(tok), np.int64), docs))
        for k, at in by_shard(w, shards):
            rows.append({"kind": "word", "shard": k, "a": w[at].tobytes(), "b": None, "n": n[at].astype("<u4").tobytes()})
        a, b = cut(prev), cut(tok)
        key, n, first = summed(pair_key(a, b), np.ones(len(tok), np.int64))
        a, b = a[first], b[first]
        for k, at in by_shard(key, shards):
            own = np.argsort(a[at], kind="stable")
            rows.append({"kind": "pair", "shard": k, "a": narrow(a[at][own], CUT), "b": narrow(b[at][own], CUT), "n": n[at][own].astype("<u4").tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = docs = 0
        for batch in batches:
            for s in slices(batch.column(0)):
                tok, prev, off = tokens(s)
                held.append((tok, prev))
                size, docs = size + len(tok), docs + len(off) - 1
                if size >= HELD:
                    yield reduce(*(np.concatenate(x) for x in zip(*held, strict=True)), docs)
                    held, size, docs = [], 0, 0
        if held:
            yield reduce(*(np.concatenate(x) for x in zip(*held, strict=True)), docs)

    return run


def _merged_pairs(folder: str, shards: int):
    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        if kind == "word":
            return rows.select(["kind", "shard", "a", "b", "n"])
        shard = rows.column("shard")[0].as_py()
        a = np.concatenate([widen(x.as_py(), CUT) for x in rows.column("a")])
        b = np.concatenate([widen(x.as_py(), CUT) for x in rows.column("b")])
        n = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in rows.column("n")]).astype(np.int64)
        key, n, first = summed(pair_key(a, b), n)
        a, b = a[first], b[first]
        large = np.flatnonzero(n >= 255)
        write_shard(folder, "pair", shard, key, count=np.minimum(n, 255).astype(np.uint8))
        write_shard(folder, "large", shard, key[large], count=n[large].astype("<u4"))
        kinds = np.minimum(n, 3) - 1
        out = [{"kind": "sizes", "shard": 0, "a": None, "b": None, "n": np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype("<i8").tobytes()}]
        out.append({"kind": "filled", "shard": 0, "a": None, "b": None, "n": np.array([shard, len(large)], "<i8").tobytes()})
        # For each word: in the low 16 bits of a value's slot the pairs it begins by count class; and those it ends.
        w = np.concatenate([a, b])
        slot = np.concatenate([kinds, np.full(len(b), 3)])
        u, inv = np.unique(w, return_inverse=True)
        table4 = np.bincount(inv * 4 + slot, minlength=4 * len(u)).reshape(-1, 4)
        for k, at in by_shard(u << np.uint64(64 - 8 * CUT), shards):
            out.append({"kind": "word", "shard": k, "a": None, "b": narrow(u[at], CUT), "n": np.ascontiguousarray(table4[at]).astype("<u4").tobytes()})
        return pa.Table.from_pylist(out, schema=BLOCKS)

    return run


def _merged_words(folder: str):
    def run(rows: pa.Table) -> pa.Table:
        kind, shard = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
        if kind != "word":
            return rows.select(["kind", "shard", "a", "b", "n"])
        counted = [(np.frombuffer(a.as_py(), "<u8"), np.frombuffer(n.as_py(), "<u4")) for a, n in zip(rows.column("a"), rows.column("n"), strict=True) if a.is_valid]
        found = [(widen(b.as_py(), CUT), np.frombuffer(n.as_py(), "<u4").reshape(-1, 4)) for b, n in zip(rows.column("b"), rows.column("n"), strict=True) if b.is_valid]
        key, count, _ = summed(np.concatenate([k for k, _ in counted]), np.concatenate([n for _, n in counted]).astype(np.int64))
        figures = np.zeros((len(key), 4), np.int64)
        if found:
            u, inv = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            per = np.stack([np.bincount(inv, c, len(u)) for c in np.concatenate([n for _, n in found]).astype(np.float64).T], 1).astype(np.int64)
            at = np.searchsorted(u, cut(key))
            at[at == len(u)] = 0
            hit = u[at] == cut(key)
            figures[hit] = per[at[hit]]
        write_shard(folder, "word", shard, key, count=count.astype("<i8"), figures=np.ascontiguousarray(figures).astype("<i8").view("V32").reshape(-1))
        ends = figures[:, 3][key != START]
        own = count[key != START]
        totals = [shard, int(own.sum()), len(own), int(ends.sum()), *np.bincount(np.minimum(ends, 5), minlength=6)[1:5].tolist()]
        return pa.Table.from_pylist([{"kind": "totals", "shard": shard, "a": None, "b": None, "n": np.array(totals, "<i8").tobytes()}], schema=BLOCKS)

    return run


class Model:
    """The totals of a model and readers of its arrays; small enough to travel in a task's closure."""

    def __init__(self, folder: str, shards: int, rows: list) -> None:
        unpack = lambda kind: np.array([np.frombuffer(r["n"], "<i8") for r in rows if r["kind"] == kind]).reshape(-1, {"sizes": 4, "filled": 2, "totals": 8}[kind])
        totals, filled, sizes = unpack("totals"), unpack("filled"), unpack("sizes")
        self.train_tokens, self.vocabulary, self.ends = (int(totals[:, k].sum()) for k in (1, 2, 3))
        self.pair_discount = discounts(sizes.sum(0).tolist())
        self.word_discount = discounts(totals[:, 4:].sum(0).tolist())
        once = totals[:, 4:6].sum(0)
        more = self.vocabulary - int(once.sum())
        self.spread = float(self.word_discount[1] * once[0] + self.word_discount[2] * once[1] + self.word_discount[3] * more)
        self.words = HashArrays(folder, "word", shards, totals[:, 0].tolist(), count="<i8", figures="V32")
        self.pairs = HashArrays(folder, "pair", shards, filled[:, 0].tolist(), count="u1")
        self.large = HashArrays(folder, "large", shards, filled[filled[:, 1] > 0, 0].tolist(), count="<u4")

    def score(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, model score) of each row of a slice."""
        tok, prev, off = tokens(s)
        u, inv = np.unique(np.append(tok, START), return_inverse=True)
        _, got = self.words.lookup(u)
        count, figures = got["count"], got["figures"].view("<i8").reshape(-1, 4)
        start = inv[-1]
        t, p = inv[:-1], np.empty(len(tok), np.int64)
        p[1:] = t[:-1]
        p[off[:-1]] = start
        with np.errstate(divide="ignore", invalid="ignore"):
            base = np.log10((count + 0.1) / (self.train_tokens + 0.1 * (self.vocabulary + 1))) if self.train_tokens else np.full(len(u), np.nan)
            ends = figures[:, 3]
            low = (np.maximum(ends - self.word_discount[np.minimum(ends, 3)], 0) + self.spread / (self.vocabulary + 1)) / self.ends if self.ends else np.full(len(u), 1.0)
            rest = figures[:, :3] @ self.pair_discount[1:]
            key = pair_key(cut(prev), cut(tok))
            uk, back = np.unique(key, return_inverse=True)
            _, got = self.pairs.lookup(uk)
            n = got["count"].astype(np.int64)
            big = np.flatnonzero(n == 255)
            if len(big):
                n[big] = self.large.lookup(uk[big])[1]["count"]
            n = n[back]
            seen = count[p]
            high = (np.maximum(n - self.pair_discount[np.minimum(n, 3)], 0) + rest[p] * low[t]) / np.maximum(seen, 1)
            model = np.log10(np.where(seen > 0, high, low[t]))
        add = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  every row has an end token
        return np.diff(off), add((count[t] > 0).astype(np.int64)), add(base[t]), add(model)


def train(texts: DataFrame, shards: int | None = None) -> Model:
    """Count the table's only column."""
    spark = texts.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "ngrams")
    blocks = texts.mapInArrow(_counted(shards), BLOCK)
    pairs = blocks.groupBy("kind", "shard").applyInArrow(_merged_pairs(folder, shards), BLOCK)
    words = pairs.groupBy("kind", "shard").applyInArrow(_merged_words(folder), BLOCK)
    return Model(folder, shards, words.select("kind", "n").collect())  # a few rows for each shard


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and the scores of a table (doc_id, held_out, text)."""
    kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(s) for s in slices(batch.column(2), most=4 << 20)]
            if not parts:
                continue
            n, known, base, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            cols = [batch.column(0), batch.column(1), n, known, np.full(len(n), model.train_tokens), base, own]
            yield pa.record_batch([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, (_, t) in zip(cols, kinds, strict=True)], schema=schema)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold() % 10 == 0).alias("held_out"))
    model = train(docs.where(~F.col("held_out")).select("text"))
    return score(docs, model)
