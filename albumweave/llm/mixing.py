"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Within a source every document is expected rate = target / source size times. Documents stand in order of size; the
running sum of expected copies plus one random offset of the source is cut at the integers, and a document is emitted
once for each integer its interval crosses. In order of size the words taken stay within about one document of the
target. Running ranks are built in three bounded steps (sizes of a source, salts of a size, rows of a salt), so that
neither a hot source nor a hot size meets in one task. Salts are hashes of ids, or of texts where there is no id.

Null and empty texts have size 0 and take nothing. Null sources form one source, ordered last. Rows that repeat are
separate documents; which of several rows with one doc_id, source and size is taken makes no difference to the result.
Columns other than doc_id, text and source are ignored; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumweave.llm.common import WORD, materialise, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SALTS = 256
SEED = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with one row per source. A target is
    min(most * size, weight * level): the level at which targets add up to `share` of all sizes, found from the
    running sums of sources in order of size per weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    w = w.withColumn("level", level)
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(first, F.col("level")) * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, salts: int = SALTS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and _row where there is one."""
    own = [c for c in ("_row",) if c in docs.columns]
    drawn = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    salt = F.pmod(F.conv(F.substring(drawn, 1, 4), 16, 10).cast("int"), F.lit(salts)).alias("salt")
    rows = materialise(docs.select("doc_id", *own, "source", n_words(F.col("text")).alias("size"), salt), "sizes")
    salted = rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    by_size = salted.groupBy("source", "size").agg(F.sum("n").alias("m"))
    goal = targets(by_size.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).cast("long").alias("source_size")), weights, share, most)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("before", F.coalesce(F.sum("m").over(earlier(Window.partitionBy("source").orderBy("size"))), F.lit(0)))
    # A source that is null joins as a flag beside an empty name.
    key = lambda df: df.withColumn("k0", F.col("source").isNull()).withColumn("k1", F.coalesce("source", F.lit(""))).drop("source")
    by_size = key(by_size).join(key(goal), ["k0", "k1"]).drop("m")
    in_size = Window.partitionBy("k0", "k1", "size").orderBy("salt")
    salted = key(salted).withColumn("in_size", F.coalesce(F.sum("n").over(earlier(in_size)), F.lit(0))).drop("n")
    start = salted.join(by_size, ["k0", "k1", "size"]).withColumn("start", F.col("before") + F.col("in_size")).drop("before", "in_size")
    in_salt = Window.partitionBy("k0", "k1", "size", "salt").orderBy("doc_id", *own)
    ranked = rows.withColumn("k0", F.col("source").isNull()).withColumn("k1", F.coalesce("source", F.lit(""))).withColumn("rank", F.row_number().over(in_salt))
    out = ranked.join(start, ["k0", "k1", "size", "salt"]).withColumn("rank", F.col("start") + F.col("rank"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("k0").cast("string"), F.col("k1")).cast("binary"))
    offset = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    crossed = F.floor(F.col("rank") * rate + offset) - F.floor((F.col("rank") - 1) * rate + offset)
    copies = F.least(crossed, F.ceil(rate)).cast("long")
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
    return out.select("doc_id", *own, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """`docs` with each row as often as the mix takes it."""
    names = [c for c in docs.columns if c != "_row"]
    rows = materialise(docs.select(*names).withColumn("_row", F.monotonically_increasing_id()), "rows")
    copies = mix(rows, **how).where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    return rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*names)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
