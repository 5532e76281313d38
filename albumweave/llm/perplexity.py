"""Quality rules: base counts of a text, and the perplexity of its bytes under a modified Kneser-Ney model of its
language, with a lower and an upper band for each language.

The model is counted in Spark over all texts: byte 5-grams by language, then the continuation counts of each lower
order, discounts, and interpolated probabilities by joins. Its last form, sorted hash arrays with one log probability
for each gram and one back-off weight for each context, lies in the shared folder and is mapped by the tasks that score.
Perplexity is taken per word that holds a letter or digit, so marks beside and glued to words count against a text.
Bands stand `UPPER` robust deviations above and `LOWER` below the median, for each language and each power of two of the
number of words.

Grams are counted and quartiles taken over one text of each group of near copies in a language (`first_of_groups`), so
that a group of any size weighs as much as one text; every text is judged.

Null and empty texts have no words and fail the base rule. A null language is a language of its own; languages, of any
number, are told apart by 22 bits of a hash. Repeated rows are
judged alike; texts of any length are read whole, in slices of whole texts, with arrays of some 40 times a text's bytes;
other columns are ignored; an empty table gives an empty result. A cell's median and
spread are drawn towards those of its neighbours in size, these towards the whole table's, with the weight of `PRIOR`
texts, whatever the number of its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumweave.llm.common import materialise, new_folder, table
from albumweave.llm.hash_arrays import HashArrays, discounts, shard_of, write_shard
from albumweave.llm.words import _BASE, _BYTE, _STEP, Slice, mix, powers, shingles, slices

ORDER = 5
#: Robust deviations from the median that bound the bands: below, endless combinations of a few words; above, junk.
UPPER, LOWER = 6.0, 6.0
#: Texts that a prior counts for, and the spread of a single word that the whole table's begins with.
PRIOR, WORD_SPREAD = 5.0, 1.0
#: Distinct grams that a task holds before it hands them on.
HELD = 2_000_000
LANG_BITS = 40
#: Texts with shares s of equal shingles meet in a round with probability s ** LEAST: 0.996 at s = 0.8 over all rounds.
ROUNDS, LEAST = 8, 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEXICAL = np.zeros(256, bool)
_LEXICAL[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lang_code(lang: str | None) -> int:
    """22 bits of the language's name, above the bytes of a gram."""
    return (zlib.crc32(b"-" if lang is None else b"+" + lang.encode()) & 0x3FFFFF) << LANG_BITS


def grams(s: Slice, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) for each byte of a slice: the byte with the four before it, line feeds before the first."""
    rows, pad = len(s.doc_off) - 1, ORDER - 1
    size = np.diff(s.doc_off)
    row = np.repeat(np.arange(rows), size)
    at = np.arange(len(s.data)) + pad * (row + 1)
    text = np.full(len(s.data) + pad * rows, 0x0A, np.uint8)
    text[at] = s.data
    out = lang[row].copy()
    for k in range(ORDER):
        out |= text[at - k].astype(np.int64) << (8 * k)
    return out, row


def base_counts(s: Slice) -> dict[str, np.ndarray]:
    rows = len(s.off) - 1
    running = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    chars, symbols = running((s.data & 0xC0) != 0x80), running(_SYMBOL[s.data])
    h = s.hashes()
    # Words inside windows of five that occur twice or more in their text.
    g, row = shingles(h, s.off)
    lens = np.diff(s.off)
    five = lens[row] >= 5
    g, row = g[five], row[five]
    repeated = np.zeros(len(h), bool)
    if len(g):
        key = mix(g + row.astype(np.uint64) * _BASE)
        _, inv, n = np.unique(key, return_inverse=True, return_counts=True)
        first = np.flatnonzero(row != np.concatenate([[-1], row[:-1]]))
        at = s.off[row] + np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        hit = at[n[inv] > 1]
        for k in range(5):
            repeated[hit + k] = True
    # Lines with a word that equal an earlier one.
    size = np.diff(s.doc_off)
    begin = np.unique(np.concatenate([s.doc_off[:-1][size > 0], np.flatnonzero(s.data == 0x0A) + 1]))
    begin = begin[begin < len(s.data)]
    doc = np.searchsorted(s.doc_off, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(s.data)), s.doc_off[doc + 1])
    stop = np.where((stop > begin) & (s.data[stop - 1] == 0x0A), stop - 1, stop)
    full = np.searchsorted(s.starts, stop) > np.searchsorted(s.starts, begin)
    begin, stop, doc = begin[full], stop[full], doc[full]
    dup = np.zeros(rows, np.int64)
    if len(begin):
        size = stop - begin
        at = np.concatenate([[0], np.cumsum(size[:-1])])
        pos = np.arange(int(size.sum())) - np.repeat(at, size)
        line = np.add.reduceat(_BYTE[s.data[np.repeat(begin - at, size) + np.arange(len(pos))]] * powers(_BASE, int(size.max()))[pos], at)
        key = mix(mix(line + size.astype(np.uint64)) + doc.astype(np.uint64) * _BASE)
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[first] = False
        dup = np.bincount(doc[again], minlength=rows)
    held = running(_LEXICAL[s.data])
    lexical = held[s.ends] > held[s.starts]
    return {
        "n_words": lens,
        "word_chars": np.diff(running(chars[s.ends] - chars[s.starts])[s.off]),
        "n_symbols": np.diff(symbols[s.doc_off]),
        "n_dup_lines": dup,
        "n_repeat_words": np.diff(np.concatenate([[0], np.cumsum(repeated)])[s.off]),
        "n_lexical": np.diff(np.concatenate([[0], np.cumsum(lexical)])[s.off]),
    }


def first_of_groups(docs: DataFrame) -> HashArrays:
    """The ids `_doc` of one text of each group of near copies in a language. In each round the texts left that have
    the same least shingles under `LEAST` orders give way to one of them."""
    spark = docs.sparkSession
    names = [f"k{r}" for r in range(ROUNDS)]
    schema = pa.schema([(c, pa.int64()) for c in ["_doc", *names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = mix(np.arange(1, ROUNDS * LEAST + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
        for batch in batches:
            codes = np.array([lang_code(x) for x in batch.column(1).to_pylist()], np.int64).view(np.uint64)
            ids = batch.column(0).to_numpy()
            for s in slices(batch.column(2), lower=False):
                g, row = shingles(s.hashes(), s.off)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                keys = []
                for r in range(ROUNDS):
                    key = mix(codes[s.first : s.last] + np.uint64(r))
                    for a in odd[r * LEAST : (r + 1) * LEAST]:
                        if len(g):
                            key[row[first]] = mix(key[row[first]] + np.minimum.reduceat(g * a, first))
                    keys.append(pa.array(key.view(np.int64)))
                yield pa.record_batch([pa.array(ids[s.first : s.last]), *keys], schema=schema)

    left = docs.select("_doc", "lang", "text").mapInArrow(run, ", ".join(f"{c} long" for c in schema.names))
    for r, name in enumerate(names):
        left = left.groupBy(name).agg(F.min(F.struct("_doc", *names[r + 1 :])).alias("x")).select("x.*")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _store(left.select("_doc", F.lit(1.0).alias("one")), new_folder(spark, "firsts"), "first", shards, "one")


def is_first(firsts: HashArrays | None, batch: pa.RecordBatch) -> np.ndarray:
    """Whether a row of the batch is its group's text in `firsts`."""
    if firsts is None:
        return np.ones(batch.num_rows, bool)
    key, at = np.unique(mix(batch.column("_doc").to_numpy().view(np.uint64)), return_inverse=True)
    return firsts.lookup(key)[0][at]


def count_grams(docs: DataFrame, firsts: HashArrays | None = None) -> DataFrame:
    """(gram, n) over all texts of a table (lang, text), or over those in `firsts`."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            k, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, inv = np.unique(k, return_inverse=True)
            return u, np.bincount(inv, n, len(u)).astype(np.int64)

        for batch in batches:
            counted = is_first(firsts, batch)
            codes = np.array([lang_code(x) for x in batch.column(0).to_pylist()], np.int64)
            for s in slices(batch.column(1), lower=False):
                g, row = grams(s, codes[s.first : s.last])
                u, n = np.unique(g[counted[s.first : s.last][row]], return_counts=True)
                held.append((u, n))
                size += len(u)
                if size >= HELD:
                    held = [reduced()]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield pa.record_batch([pa.array(x) for x in held[0]], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(x) for x in reduced()], schema=schema)

    return docs.select("lang", "text", *(["_doc"] if firsts else [])).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _store(df: DataFrame, folder: str, name: str, shards: int, column: str) -> HashArrays:
    """Write (key, value) as sorted arrays of hashed keys."""
    keyed = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("value", pa.float32())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = mix(batch.column(0).to_numpy().view(np.uint64))
            yield pa.record_batch([pa.array(shard_of(key, shards).astype(np.int32)), pa.array(key.view(np.int64)), batch.column(1).cast(pa.float32())], schema=keyed)

    def written(rows: pa.Table) -> pa.Table:
        key = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        shard = rows.column("shard")[0].as_py()
        write_shard(folder, name, shard, key[order], **{column: rows.column("value").to_numpy()[order].astype("<f4")})
        return pa.table({"shard": pa.array([shard], pa.int32())})

    done = df.mapInArrow(hashed, "shard int, key long, value float").groupBy("shard").applyInArrow(written, "shard int").collect()
    return HashArrays(folder, name, shards, [r.shard for r in done], **{column: "<f4"})


class Model:
    """Readers of a model's arrays, by order."""

    def __init__(self, logp: dict[int, HashArrays], backoff: dict[int, HashArrays], unseen: HashArrays) -> None:
        self.logp, self.backoff, self.unseen = logp, backoff, unseen

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """Log probabilities of distinct grams of the highest order."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        lang, low = gram >> LANG_BITS << LANG_BITS, gram & ((1 << LANG_BITS) - 1)
        for k in range(ORDER, 0, -1):
            key = mix((lang[left] | (low[left] & ((1 << 8 * k) - 1))).view(np.uint64))
            u, inv = np.unique(key, return_inverse=True)
            found, got = self.logp[k].lookup(u)
            hit = found[inv]
            out[left[hit]] += got["logp"][inv][hit]
            left = left[~hit]
            if not len(left):
                return out
            if k > 1:
                key = mix((lang[left] | ((low[left] & ((1 << 8 * k) - 1)) >> 8)).view(np.uint64))
                u, inv = np.unique(key, return_inverse=True)
                out[left] += self.backoff[k].lookup(u)[1]["backoff"][inv]  # an unseen context has weight 1
        u, inv = np.unique(mix(lang[left].view(np.uint64)), return_inverse=True)
        found, got = self.unseen.lookup(u)
        out[left] += np.where(found, got["logp"], -np.log10(256.0))[inv]
        return out


def _discounted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The discounts of each order and language, and what they leave of single bytes, spread over the 256 values."""
    for x in batches:
        d = np.array([discounts(n) for n in x[["n1", "n2", "n3", "n4"]].to_numpy()]).reshape(-1, 4)
        left = (d[:, 1] * x.n1 + d[:, 2] * x.n2 + d[:, 3] * (x.grams - x.n1 - x.n2)) / x.total
        yield pd.DataFrame({"k": x.k, "lang": x.lang, "d1": d[:, 1], "d2": d[:, 2], "d3": d[:, 3], "low": left / 256, "total": x.total})


def train(docs: DataFrame, firsts: HashArrays | None = None) -> Model:
    spark = docs.sparkSession
    folder, shards = new_folder(spark, "bytes"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = {ORDER: materialise(count_grams(docs, firsts), "grams")}
    lang = (F.shiftright("gram", LANG_BITS)).alias("lang")
    tail = lambda k: F.col("gram").bitwiseAND(F.lit(-1 << LANG_BITS)).bitwiseOR(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)))
    head = F.col("gram").bitwiseAND(F.lit(-1 << LANG_BITS)).bitwiseOR(F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << LANG_BITS) - 1)), 8))
    for k in range(ORDER - 1, 0, -1):
        level[k] = materialise(level[k + 1].groupBy(tail(k).alias("gram")).agg(F.count("*").alias("n")), f"grams{k}")
    # A row for each order and language, written first: its size decides how it is joined.
    counted = reduce(DataFrame.union, [level[k].select(F.lit(k).alias("k"), lang, "n") for k in level])
    counted = counted.groupBy("k", "lang").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)), F.count("*").alias("grams"), F.sum("n").alias("total"))
    stats = materialise(counted.mapInPandas(_discounted, "k int, lang long, d1 double, d2 double, d3 double, low double, total long"), "stats")
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    one = stats.where("k = 1").drop("k")
    unseen = _store(one.select(F.shiftleft("lang", LANG_BITS).alias("gram"), F.log10("low")), folder, "unseen", shards, "logp")
    p = level[1].withColumn("lang", lang).join(one, "lang").select("gram", (F.greatest(F.col("n") - less, F.lit(0.0)) / F.col("total") + F.col("low")).alias("p"))
    logp, backoff = {1: _store(p.select("gram", F.log10("p")), folder, "p1", shards, "logp")}, {}
    for k in range(2, ORDER + 1):
        d = stats.where(F.col("k") == k).select("lang", "d1", "d2", "d3")
        g = level[k].withColumn("lang", lang).join(d, "lang").withColumn("head", head).withColumn("tail", tail(k - 1))
        ctx = g.groupBy("head").agg(F.sum("n").alias("total"), (F.sum(less) / F.sum("n")).alias("weight"))
        ctx = materialise(ctx, f"contexts{k}")
        low = p.select(F.col("gram").alias("tail"), F.col("p").alias("low"))
        p = g.join(ctx, "head").join(low, "tail").select("gram", (F.greatest(F.col("n") - less, F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("low")).alias("p"))
        p = materialise(p, f"p{k}")
        logp[k] = _store(p.select("gram", F.log10("p")), folder, f"p{k}", shards, "logp")
        backoff[k] = _store(ctx.select("head", F.log10("weight")), folder, f"b{k}", shards, "backoff")
    return Model(logp, backoff, unseen)


def measured(docs: DataFrame, model: Model, keep: list[str], firsts: HashArrays) -> DataFrame:
    """The columns `keep` of `docs`, with the base counts, log10 of the probability (log10_p) and whether the row is in
    `firsts` (_first)."""
    out = docs.select(*keep).schema
    for c in COUNTS[:-1]:
        out = out.add(c, "long")
    out = out.add("log10_p", "double").add("_first", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([lang_code(x) for x in batch.column("lang").to_pylist()], np.int64)
            parts = []
            for s in slices(batch.column("text"), lower=False):
                got = base_counts(s)
                g, row = grams(s, codes[s.first : s.last])
                inv, u = pd.factorize(g)
                got["log10_p"] = np.bincount(row, model.log10(u)[inv], minlength=len(s.off) - 1)
                parts.append(got)
            if parts:
                cols = [pa.array(np.concatenate([x[c] for x in parts]).astype(np.float64 if c == "log10_p" else np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols, pa.array(is_first(firsts, batch))], names=[*keep, *COUNTS, "_first"])

    # Rows are handed through whole, so that later filters need no join back.
    return docs.select(*dict.fromkeys([*keep, "lang", "text", "_doc"])).mapInArrow(run, out)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lexical", "log10_p"]


def _pooled(pairs: DataFrame, by: list[str]) -> DataFrame:
    """center, noise (of texts in a cell), between (of cells) and the weights of both for pairs of a size class and a
    cell (at, n, dof, nm, nmm, ds): the weight halves with each class between them. A spread shrinks with
    the root of the number of words: longer texts' is widened for shorter ones, but none is narrowed for longer ones."""
    w = F.pow(F.lit(0.5), F.abs(F.col("at") - F.col("size_class")))
    wider = F.pow(F.lit(2.0), F.greatest(F.col("at") - F.col("size_class"), F.lit(0)))
    sums = pairs.groupBy(*by).agg(*(F.sum(w * F.col(c)).alias(c) for c in ("n", "nm", "nmm", "dof")), F.sum(w * wider * F.col("ds")).alias("ds"))
    center = F.try_divide("nm", "n")
    return sums.select(*by, "n", "dof", center.alias("center"), F.try_divide("ds", "dof").alias("noise"), F.greatest(F.try_divide("nmm", "n") - center * center, F.lit(0.0)).alias("between"))


def bands(rows: DataFrame, lower: float = LOWER, upper: float = UPPER, prior: float = PRIOR) -> DataFrame:
    """of_lang, of_size, lower, upper of log10 of the perplexity per word, over texts that pass the base rule,
    one of each group of near copies."""
    x = F.when(F.col("_first"), F.col("level"))
    q = F.percentile_approx(x, [0.25, 0.5, 0.75], 2000)
    cells = rows.where(~F.col("base_failed")).groupBy("lang", "size_class").agg(F.count(x).cast("double").alias("n"), q.alias("q"))
    m, s = F.coalesce(F.col("q")[1], F.lit(0.0)), F.coalesce((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(0.0))
    dof = F.greatest(F.col("n") - 1, F.lit(0.0))
    # A lone text, which may be junk, hardly counts for other cells.
    n = F.when(F.col("n") > 0, dof + 0.1).otherwise(0.0)
    cells = cells.select("lang", "size_class", F.col("n").alias("own"), m.alias("m"), n.alias("n"), dof.alias("dof"), (n * m).alias("nm"), (n * m * m).alias("nmm"), (dof * s * s).alias("ds"))
    cells = materialise(cells, "cells")  # a row for each language and power of two of the number of words
    added = [F.sum(c).alias(c) for c in ("n", "dof", "nm", "nmm", "ds")]
    every = cells.groupBy(F.col("size_class").alias("at")).agg(*added)  # a row for each power of two
    drawn = lambda own, n, to: (F.coalesce(own * n, F.lit(0.0)) + prior * to) / (F.coalesce(n, F.lit(0.0)) + prior)
    of = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    pairs = cells.select("size_class").distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(63)))).join(every, "at")
    whole = of(_pooled(pairs, ["size_class"]), "t")
    near = cells.select(F.col("lang").alias("of_lang"), F.col("size_class").alias("at"), "n", "dof", "nm", "nmm", "ds").where("n > 0")
    near = cells.select("lang", "size_class").join(near, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("size_class") != F.col("at")))
    near = of(_pooled(near, ["lang", "size_class"]), "l")
    out = cells.join(whole, F.col("size_class") == F.col("t_size_class"))
    out = out.join(near, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("size_class") == F.col("l_size_class")), "left")
    first = WORD_SPREAD**2 / F.pow(F.lit(2.0), F.col("size_class"))
    noise = drawn(F.col("t_noise"), F.col("t_dof"), first) + F.col("t_between")
    noise = drawn(F.col("l_noise"), F.col("l_dof"), noise)
    noise = drawn(F.try_divide("ds", "dof"), F.col("dof"), noise)
    center = drawn(F.col("l_center"), F.col("l_n"), F.col("t_center"))
    center = drawn(F.col("m"), F.col("own"), center)
    spread = F.greatest(F.sqrt(noise), F.lit(0.05))
    return out.select(F.col("lang").alias("of_lang"), F.col("size_class").alias("of_size"), (center - lower * spread).alias("lower"), (center + upper * spread).alias("upper"))


def judge(docs: DataFrame, keep: list[str] | None = None, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """The columns `keep` of `docs` (all) and lang with the base counts, base_failed, level (log10 of perplexity per word), lower, upper and
    kept. Columns of these names in `docs` are replaced."""
    given = [c for c in dict.fromkeys([*(docs.columns if keep is None else keep), "lang"]) if c not in {*COUNTS, "base_failed", "level", "lower", "upper", "kept", "size_class", "of_lang", "of_size", "_doc", "_first"}]
    # Written with their ids, so that every pass sees the same.
    docs = materialise(docs.select(*dict.fromkeys([*given, "text"])).withColumn("_doc", F.monotonically_increasing_id()), "texts")
    firsts = first_of_groups(docs)
    model = train(docs, firsts)
    rows = measured(docs, model, given, firsts)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = rows.withColumn("level", F.when(F.col("n_words") > 0, -F.col("log10_p") / F.greatest("n_lexical", F.lit(1))))
    rows = rows.withColumn("size_class", F.when(F.col("n_words") > 0, F.floor(F.log2("n_words"))).cast("int"))
    rows = materialise(rows, "measured")
    # A row for each language and power of two of the number of words; written first, so that its size is known.
    band = materialise(bands(rows, lower, upper), "bands")
    on = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("size_class").eqNullSafe(F.col("of_size"))
    rows = rows.join(band, on, "left").drop("of_lang", "of_size", "size_class")
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("level").between(F.col("lower"), F.col("upper")), F.lit(True))).drop("log10_p", "_first")


def passed(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that the rules reject."""
    return judge(docs).where("kept").select(*docs.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).drop("lang")
