"""Queries that look scores up read as many of them as they ask for, never the table of all pairs."""

import pytest

import __spark_entry__ as entry
from albumweave.plans import fixtures as fx

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def read(monkeypatch):
    """Every table of scores that a query is given."""
    tables, original = [], fx.scored_pairs

    def scored(*args):
        tables.append(original(*args))
        return tables[-1]

    monkeypatch.setattr(fx, "scored_pairs", scored)
    return tables


def test_wanted_scores_are_those_of_the_whole_table(spark):
    every = fx.scored_pairs(spark, DIR)
    key = ["event_id", "source_face_id", "rep_face_id"]
    wanted = every.where("similarity % 7 = 3").select(*key)
    backwards = wanted.selectExpr("event_id", "rep_face_id AS source_face_id", "source_face_id AS rep_face_id")
    want = every.join(wanted, key, "left_semi").select(*every.columns)
    got = fx.scored_pairs(spark, DIR, wanted.union(wanted).union(backwards))
    assert want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    want = every.join(wanted, key[:2], "left_semi").select(*every.columns)
    got = fx.scored_pairs(spark, DIR, wanted.select(*key[:2]))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_album_pairs_look_up_four_scores_each(spark, read):
    out = entry.queries()["pair_unanimity"](spark, DIR)
    assert 0 < read[0].count() <= 4 * out.count()


def test_linkage_looks_up_no_more_than_album_pairs(spark, read):
    entry.queries()["pair_complete_linkage"](spark, DIR).count()
    assert read[0].count() <= 4 * entry.queries()["pair_unanimity"](spark, DIR).count()


@pytest.mark.parametrize("name", ["argmax_assignment", "photo_album_argmax_guard", "fragment_hints"])
def test_faces_look_up_a_score_for_each_candidate(spark, read, name):
    entry.queries()[name](spark, DIR)
    assert 0 < read[0].count() <= 3 * fx.faces(spark, DIR).count()


def test_budget_asks_no_more_sources_than_it_needs(spark, read):
    """Sources of one event go by their names: the first eight, then as many again as are needed."""
    from pyspark.sql import functions as F

    from albumweave.operators import screens

    rows = spark.range(400).select(F.lit("e").alias("event_id"), F.format_string("s%03d", F.col("id")).alias("source_face_id"), F.lit("r").alias("rep_face_id"), "id")
    rows = rows.union(rows.select(F.lit("tiny"), "source_face_id", "rep_face_id", "id").where("id < 2"))
    asked = []

    def wanted(some):
        asked.append(some.count())
        return rows.join(some, ["event_id", "source_face_id"], "left_semi")

    cached = lambda some: rows.where("id % 2 = 0").join(some, ["event_id", "source_face_id"], "left_semi")
    order = ["source_face_id", "rep_face_id"]
    got = screens.first_within_budget(rows.select("event_id", "source_face_id"), wanted, cached, 5, order)
    want = screens.within_budget(rows, rows.where("id % 2 = 0"), 5, order)
    assert got.select("event_id", "source_face_id", "call").exceptAll(want.select("event_id", "source_face_id", "call")).isEmpty() and got.count() == want.count() == 6
    assert asked == [10, 64]
    entry.queries()["call_budget"](spark, DIR)
    assert all(t.select("event_id", "source_face_id").distinct().count() <= 40 for t in read)


def test_cache_merge_hashes_the_faces_of_sources(spark):
    """Sorting the pairs instead spilled them where they are many."""
    from albumweave.operators import rejudge

    kind = "event_id string, source_face_id string, rep_face_id string, similarity double"
    old = spark.createDataFrame([("e", "a", "b", 1.0), ("e", "a", "c", 2.0), ("e", "c", "b", 3.0), ("e", "gone", "a", 4.0), ("e", "a", "gone", 5.0)], kind)
    new = spark.createDataFrame([("e", "a", "b", 0.5), ("e", "b", "c", 6.0)], kind)
    alive = spark.createDataFrame([("e", x) for x in "aabc"], "event_id string, face_id string")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rejudge.merged_scores(old, new, alive)
        assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.source_face_id, r.rep_face_id): r.similarity for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert got == {("a", "b"): 0.5, ("a", "c"): 2.0, ("c", "b"): 3.0, ("b", "c"): 6.0}


def test_cached_pairs_are_merged_where_they_are_made(spark):
    """Pairs are many more than faces: none is shuffled or sorted."""

    def moved(node):
        names = node.output().toString()
        own = [node.nodeName()] if node.nodeName() in ("Exchange", "Sort") and "source_face_id" in names and "rep_face_id" in names else []
        return own + [x for i in range(node.children().size()) for x in moved(node.children().apply(i))]

    out = entry.queries()["score_cache_merge"](spark, DIR)
    assert moved(out._jdf.queryExecution().executedPlan().initialPlan()) == []


def test_cells_are_dealt_to_all_shards(spark):
    """Few faces make many pairs: their shards are not put together for being small."""
    out = entry.queries()["score_cache_merge"](spark, DIR)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_merge_in_cells_is_the_merge_of_whole_tables(spark):
    from pyspark.sql import functions as F

    from albumweave.operators import rejudge

    alive = fx.faces(spark, DIR).where("row_ix % 9 <> 0")
    cells, whole = fx.scored_cells(alive, 4), fx.scored_pairs(spark, DIR)
    assert cells.select(*fx.CELL).distinct().count() > alive.select("event_id", "label").distinct().count()
    sides = lambda df: (df.where("similarity % 3 <> 0 AND similarity >= 60"), df.where("similarity >= 95").withColumn("similarity", F.col("similarity") + 0.5))
    want = rejudge.merged_scores(*sides(whole), alive).select("event_id", "source_face_id", "rep_face_id", "similarity")
    got = rejudge.merged_cells(*sides(cells), fx.CELL)
    assert want.count() == got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
