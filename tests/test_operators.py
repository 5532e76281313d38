import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from albumweave.functions import vectors as V
from albumweave.operators import clusters, density, feedback, folds, messages, pairs, rejudge, routing
from albumweave.operators.config import Thresholds
from albumweave.operators.graph import canonical_pairs, components, greedy_matching, similar_components


def unit(*angles):
    return [[math.cos(math.radians(a)), math.sin(math.radians(a))] for a in angles]


def faces(spark, vecs, photos=None, widths=None, label=None, event="e"):
    rows = [(event, i, f"f{i}", (photos or [f"p{i}" for i in range(len(vecs))])[i], v, float((widths or [100] * len(vecs))[i]), 3000.0, (label or [0] * len(vecs))[i]) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "event_id string, row_ix long, face_id string, photo_id string, v array<double>, face_width double, image_long_side double, label int")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [float("nan"), 1.0])], "a array<double>, z array<double>, n array<double>")
    r = df.select(V.norm("a").alias("size"), V.normalised("a").alias("u"), V.normalised("z").alias("z"), V.normalised("n").alias("bad"), V.cosine("a", "z").alias("c")).first()
    assert r.size == 5 and r.u == [0.6, 0.8] and r.z is None and r.bad is None and r.c is None


def test_iou_and_clamp(spark):
    df = spark.sql("SELECT named_struct('x', 0D, 'y', 0D, 'w', 2D, 'h', 2D) a, named_struct('x', 1D, 'y', 1D, 'w', 2D, 'h', 2D) b, named_struct('x', 0D, 'y', 0D, 'w', 0D, 'h', 0D) z")
    r = df.select(V.iou("a", "b").alias("i"), V.iou("z", "z").alias("z"), V.clamped("b", F.lit(2), F.lit(5)).alias("c")).first()
    assert abs(r.i - 1 / 7) < 1e-12 and r.z == 0 and r.c.asDict() == {"x": 1, "y": 1, "w": 1, "h": 2}


def test_pairs_are_complete_and_single(spark):
    df = faces(spark, unit(*range(0, 360, 9)))
    got = {(r.a_ix, r.b_ix) for r in pairs.event_pairs(df, -2.0).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40)}
    near = pairs.event_pairs(df, math.cos(math.radians(10))).count()
    assert near == 40


def test_pairs_of_empty_table(spark):
    assert pairs.event_pairs(faces(spark, unit(1)).limit(0), 0.0).count() == 0


def test_components_of_a_chain(spark):
    nodes = spark.range(300).select(F.lit("e").alias("event_id"), F.col("id").alias("row_ix"))
    edges = spark.range(298).select(F.lit("e").alias("event_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.row_ix: r.root for r in components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(299)} | {299: 299}


def test_greedy_matching_equals_a_walk(spark):
    import random

    random.seed(3)
    rows = [("e", f"n{i}", f"o{j}", random.randint(0, 5)) for i in range(12) for j in range(9) if random.random() < 0.5]
    df = spark.createDataFrame(rows, "event_id string, left string, right string, w int")
    got = {(r.left, r.right) for r in greedy_matching(df, [F.desc("w"), "right", "left"]).collect()}
    used, want = set(), set()
    for _, a, b, _ in sorted(rows, key=lambda r: (-r[3], r[2], r[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert got == want


def test_canonical_pairs(spark):
    df = spark.createDataFrame([("e", 5, "must", "b", "a"), ("e", 2, "must", "a", "b"), ("e", 1, "must", "a", "a")], "event_id string, seq long, kind string, a string, b string")
    assert [tuple(r) for r in canonical_pairs(df).select("a", "b", "seq").collect()] == [("a", "b", 2)]


def test_leave_one_out_and_eviction(spark):
    df = faces(spark, unit(0, 10, 20, 100), label=[1, 1, 1, 1]).withColumn("cluster", F.col("label").cast("string"))
    loo = {r.face_id: r.loo for r in clusters.leave_one_out(df, dims=2).collect()}
    rest = [sum(x) for x in zip(*unit(0, 10, 20), strict=True)]
    assert abs(loo["f3"] - (rest[0] * unit(100)[0][0] + rest[1] * unit(100)[0][1]) / math.hypot(*rest)) < 1e-12
    one = faces(spark, unit(5)).withColumn("cluster", F.lit("x"))
    assert clusters.leave_one_out(one, dims=2).first().loo == 1


def test_core_distance_counts_itself(spark):
    core = {r.face_id: r.core for r in clusters.core_distances(faces(spark, unit(0, 30, 90)), 2).collect()}
    assert abs(core["f2"] - (1 - math.cos(math.radians(60)))) < 1e-12


def test_main_faces_unknown_width(spark):
    df = faces(spark, unit(0, 1, 2), photos=["p", "p", "p"], widths=[100, 49, 0])
    assert {r.face_id for r in routing.main_faces(df).collect()} == {"f0", "f2"}


def test_causes(spark):
    df = spark.createDataFrame([(50.0, 1000.0, "unmatched"), (50.0, 0.0, "unmatched"), (150.0, 1000.0, "unmatched"), (150.0, 1000.0, "ambiguous"), (0.0, 1000.0, "unmatched")], "w double, s double, r string")
    got = [x.c for x in df.select(routing.causes(F.col("w"), F.col("s"), F.col("r")).alias("c")).collect()]
    assert got == [["low_resolution", "small_faces"], ["small_faces"], ["single_appearance"], [], []]


def test_majority_is_strict(spark):
    reps = spark.createDataFrame([("e", "c", f"f{i}") for i in range(4)], "event_id string, cluster string, face_id string")
    verdicts = spark.createDataFrame([("e", "f0", True), ("e", "f1", False)], "event_id string, face_id string, nonhuman boolean")
    r = rejudge.nonhuman_clusters(reps, verdicts).first()
    assert (r.judged, r.nonhuman, r.demoted) == (2, 1, False)


def test_violations_of_a_sound_event(spark):
    df = faces(spark, unit(0, 1))
    links = spark.createDataFrame([("e", "f0", "f1")], "event_id string, a string, b string")
    assert feedback.violations(df, links).count() == 0
    bad = spark.createDataFrame([("e", "f0", "f9"), ("e", "f1", "f1")], "event_id string, a string, b string")
    assert {r.rule for r in feedback.violations(df, bad).collect()} == {"unknown_face", "self_pair"}


@pytest.mark.parametrize("change", [{"duplicate": 1.5}, {"rescue": -0.1}, {"suggest": 95.0}, {"grey_ceiling": 0.1}])
def test_thresholds_are_checked(change):
    with pytest.raises(ValueError):
        Thresholds(**change)


def test_messages(spark):
    bodies = {
        '{"type":"classify_request","job_id":"j","event_id":"e","images":[{"image_id":"a","s3_key":"k"}]}': None,
        '{"type":"classify_request","job_id":"j","event_id":"e","images":[{"image_id":"a"},{"image_id":"a"}]}': "repeated_image",
        '{"type":"cluster_feedback","job_id":"j","event_id":"e","action":"merge","merge":{"target_cluster_id":"a","source_cluster_ids":["a"]}}': "merge_into_itself",
        '{"type":"cluster_feedback","job_id":"j","event_id":"e","action":"split","split":{"cluster_id":"c","groups":[["a","a"],["b"]]}}': None,
        '{"type":"cluster_feedback","job_id":"j","event_id":"e","action":"split","split":{"cluster_id":"c","groups":[["a"],["a"]]}}': "overlapping_groups",
        '{"type":"cluster_feedback","job_id":"j","event_id":"e","action":"reassign","reassign":{"image_id":"i","from_cluster_id":"a","to_cluster_id":"a"}}': "no_move",
        '{"type":"delete_request","job_id":"","event_id":"e","image_ids":["a"]}': "no_job_id",
        "not json": "not_json",
        '{"type":"other","job_id":"j7","event_id":"e"}': "unknown_type",
    }
    got = {r.raw: (r.problem, r.job_id) for r in messages.parsed(spark.createDataFrame([(b,) for b in bodies], "raw string")).collect()}
    assert {k: v[0] for k, v in got.items()} == bodies
    assert got['{"type":"other","job_id":"j7","event_id":"e"}'][1] == "j7" and got["not json"][1] is None


def test_spanning_tree_is_least(spark):
    import random

    random.seed(8)
    df = spark.createDataFrame([("e", i, f"f{i}", [random.gauss(0, 1) for _ in range(3)]) for i in range(40)], "event_id string, row_ix long, face_id string, v array<double>")
    df = df.withColumn("v", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))))
    d = {(r.a, r.b): r.d for r in density.reachability_edges(df).collect()}
    assert len(d) == 40 * 39 // 2
    root, want = list(range(40)), set()
    for (i, j), _ in sorted(d.items(), key=lambda x: (x[1], x[0])):
        a, b = root[i], root[j]
        if a != b:
            want.add((i, j))
            root = [a if r == b else r for r in root]
    for block in (1024, 7):
        assert {(r.a, r.b) for r in density.spanning_tree(df, block=block).collect()} == want


@pytest.mark.parametrize("digits", [1, 9])
def test_forest_across_blocks_is_that_of_the_whole_matrix(digits):
    """Many equal distances, and few; pairs that are no edges, and a side of one row."""
    rng = np.random.default_rng(digits)
    for left, right in ((30, 50), (1, 9), (70, 3)):
        place = rng.permutation(left + right)
        left, right = np.sort(place[:left]), np.sort(place[left:])
        r = np.round(rng.random((len(left), len(right))), digits)
        r[rng.random(r.shape) < 0.2] = np.inf
        full = np.full((len(place), len(place)), np.inf)
        full[np.ix_(left, right)], full[np.ix_(right, left)] = r, r.T
        assert sorted(zip(*density.across(r, left, right), strict=True)) == sorted(zip(*density.dense_tree(full), strict=True))


def test_forests_join_in_bounded_memory():
    """Edges are arrays, but for a few at a time: 16 forests of 20,000 faces take less than 80 bytes an edge."""
    import tracemalloc

    rng = np.random.default_rng(3)
    a = np.tile(np.arange(1, 20_000), 16)
    b, d = (rng.random(len(a)) * a).astype(np.int64), rng.random(len(a))
    want = density.least_forest(b, a, d)
    edges, root = sorted(zip(d, b, a, range(len(a)), strict=True)), list(range(20_000))
    kept = []
    for _, x, y, k in edges:
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[y] = x
            kept.append(k)
    assert want.tolist() == kept and len(kept) == 19_999
    tracemalloc.start()
    density.least_forest(b, a, d)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 * len(a)


def test_density_clusters(spark):
    rows = [("e", k * 10 + i, v) for k, angle in enumerate((0, 60, 140)) for i, v in enumerate(unit(*(angle + 3 * i + 0.1 * i * i for i in range(5))))]
    rows += [("e", 99, [math.cos(4.2), math.sin(4.2)]), ("one", 0, [1.0, 0.0])]
    df = spark.createDataFrame([(e, i, f"f{i}", v) for e, i, v in rows], "event_id string, row_ix long, face_id string, v array<double>")
    got = {(r.event_id, r.row_ix): r.cluster for r in density.density_clusters(df).collect()}
    assert all(got["e", k * 10 + i] == k * 10 for k in range(3) for i in range(5)) and got["e", 99] is None and got["one", 0] is None


def of_points(points, edges, size, epsilon, method="stability"):
    """{point: first point of its cluster} and {point: probability} of the operator's own steps."""
    edges = sorted(edges)
    at = {p: k for k, p in enumerate(sorted(points))}
    a, b = (np.array([at[e[k]] for e in edges], np.int64) for k in (1, 2))
    tree = density.condensed(len(points), a, b, np.array([e[0] for e in edges]), size)
    own, sure = density.members(tree, density.chosen(tree, epsilon, method))
    return {p: min(q for q in points if own[at[q]] == own[at[p]]) for p in points if own[at[p]] >= 0}, {p: sure[at[p]] for p in points}


def plain_clusters(points, edges, size, epsilon, method):
    """The same by walks over sets of points: parts of the tree, without any edge longer than a distance."""
    node = {}
    groups = {p: (frozenset([p]), None) for p in points}
    for d, a, b in sorted(edges):
        x, y = groups[a], groups[b]
        z = (x[0] | y[0], (d, x, y))
        for p in z[0]:
            groups[p] = z
    top = groups[points[0]]
    rows = []  # parent, child (a cluster's number or a point), density, size
    clusters = {0: None}

    def fall(part, c, lam):
        rows.extend((c, ("p", p), lam, 1) for p in part[0])

    todo = [(top, 0)]
    while todo:
        part, c = todo.pop(0)
        if part[1] is None:
            continue
        d, x, y = part[1]
        lam = 1 / max(d, 1e-12)
        large = [len(z[0]) >= size for z in (x, y)]
        for z, ok in zip((x, y), large, strict=True):
            if all(large):
                k = len(clusters)
                clusters[k] = c
                node[k] = d
                rows.append((c, ("c", k), lam, len(z[0])))
                todo.append((z, k))
            elif ok:
                todo.append((z, c))
            else:
                fall(z, c, lam)
    born = {0: 0.0} | {k: 1 / max(d, 1e-12) for k, d in node.items()}
    stable = {c: sum((lam - born[c]) * n for p, _, lam, n in rows if p == c) for c in clusters}
    kids = {c: [k for k, p in clusters.items() if p == c] for c in clusters}
    under = lambda c: [c] + [y for k in kids[c] for y in under(k)]
    if method == "leaf":
        picked = {c for c in clusters if c and not kids[c]}
    else:
        picked, best = set(), {}
        for c in sorted(clusters, reverse=True):
            inner = sum(best[k] for k in kids[c])
            best[c] = max(inner, stable[c])
            if c and inner <= stable[c]:
                picked = (picked - set(under(c))) | {c}
    final = set()
    for c in picked:
        while node[c] < epsilon and clusters[c] != 0:
            c = clusters[c]
        final.add(c)
    final = {c for c in final if not any(c != o and c in under(o) for o in final)}
    label, sure = {}, {}
    for c, child, lam, _ in rows:
        if child[0] == "p":
            sure[child[1]] = 0.0
            o = c
            while o and o not in final:
                o = clusters[o]
            if o:
                label[child[1]] = o
                death = max(x[2] for x in rows if x[0] == o)
                sure[child[1]] = min(lam, death) / death
    return {p: min(q for q in label if label[q] == c) for p, c in label.items()}, sure


def test_stable_clusters_merge_below_epsilon():
    edges = [(0.01, 0, 1), (0.012, 2, 3), (0.05, 1, 2), (0.02, 10, 11), (0.9, 3, 10)]
    points = [0, 1, 2, 3, 10, 11]
    assert of_points(points, edges, 2, 0.15)[0] == {0: 0, 1: 0, 2: 0, 3: 0, 10: 10, 11: 10}
    assert set(of_points(points, edges, 2, 0.0)[0].values()) == {0, 2, 10}


@pytest.mark.parametrize("method", ["stability", "leaf"])
def test_clusters_and_probabilities_equal_walks(method):
    rng = np.random.default_rng(12)
    for trial in range(60):
        n = int(rng.integers(2, 40))
        edges = [(float(rng.choice([0.0, 0.05, 0.1, 0.2, 0.3]) if trial % 3 == 0 else rng.random()), int(rng.integers(0, i)), i) for i in range(1, n)]
        for size in (2, 3):
            got, want = (f(list(range(n)), edges, size, 0.15, method) for f in (of_points, plain_clusters))
            assert got[0] == want[0] and all(abs(got[1][p] - want[1][p]) < 1e-9 for p in range(n))


@pytest.mark.parametrize("method", ["stability", "leaf"])
def test_five_thousand_nested_clusters(method):
    """Pairs joined one after the other, ever further away: each joint is a cluster in the next."""
    pairs_ = 5000
    a = np.concatenate([np.arange(0, 2 * pairs_, 2), np.arange(0, 2 * pairs_ - 2, 2)])
    b = np.concatenate([np.arange(1, 2 * pairs_, 2), np.arange(2, 2 * pairs_, 2)])
    d = np.concatenate([np.full(pairs_, 0.001), 0.2 + np.arange(pairs_ - 1) * 1e-4])
    tree = density.condensed(2 * pairs_, a, b, d, 2)
    own, sure = density.members(tree, density.chosen(tree, 0.15, method))
    assert len(tree.parent) == 2 * pairs_ - 1 and len(set(own.tolist())) == pairs_ and sure.min() == 1.0


def test_a_hundred_thousand_faces_of_one_event(spark):
    """The step after the spanning tree, as Spark runs it."""
    n = 100_000
    tree = spark.range(1, n).select(F.lit("e").alias("event_id"), F.col("id").alias("b"), (F.col("id") - F.when(F.col("id") % 10 == 0, 10).otherwise(1)).alias("a"), F.when(F.col("id") % 10 == 0, 0.9).otherwise(0.05).alias("d"))
    original = density.spanning_tree
    density.spanning_tree = lambda faces, k, block: tree
    try:
        faces_ = spark.range(n).select(F.lit("e").alias("event_id"), F.col("id").alias("row_ix"))
        out = density.density_clusters(faces_)
        assert out.where("cluster <> row_ix - row_ix % 10 OR cluster IS NULL OR probability < 1").isEmpty() and out.count() == n
        shape = density.cluster_tree(faces_).agg(F.count("*").alias("n"), F.count_if("chosen").alias("chosen"), F.count("parent").alias("p")).first()
        assert shape.chosen == n // 10 and shape.p == shape.n - 1
    finally:
        density.spanning_tree = original


def test_later_wins(spark):
    rows = [("e", 1, False, "must", "a", "b"), ("e", 2, False, "must", "b", "c"), ("e", 3, False, "cannot", "d", "x"), ("e", 9, True, "cannot", "c", "a"), ("e", 10, True, "must", "x", "d")]
    df = spark.createDataFrame(rows, "event_id string, seq long, is_new boolean, kind string, a string, b string")
    got = {(r.kind, r.a, r.b) for r in folds.later_wins(df).collect()}
    assert got == {("must", "b", "c"), ("cannot", "a", "c"), ("must", "d", "x")}


def test_complete_linkage_stops_chains(spark):
    rows = [("e", "a", "b", 99.0, True), ("e", "b", "c", 98.0, True), ("e", "a", "c", 40.0, False), ("e", "p", "q", 91.0, True)]
    df = spark.createDataFrame(rows, "event_id string, a string, b string, similarity double, passed boolean")
    assert {(r.album, r.root) for r in folds.complete_linkage(df).collect()} == {("a", "a"), ("b", "a"), ("p", "p"), ("q", "p")}


def test_best_boxes_equal_a_walk(spark):
    import random

    random.seed(6)
    boxes = [("e", f"f{i}", random.randint(1, 5) / 5, i) for i in range(30)]
    rivals = {(i, j) for i in range(30) for j in range(i + 1, 30) if random.random() < 0.15}
    df = spark.createDataFrame(boxes, "event_id string, face_id string, score double, row_ix long")
    pairs_ = spark.createDataFrame([("e", f"f{i}", f"f{j}") for i, j in rivals], "event_id string, a string, b string")
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[2], b[3])):
        if not any((min(b[3], k), max(b[3], k)) in rivals for k in kept):
            kept.append(b[3])
    assert {r.row_ix for r in folds.best_boxes(df, pairs_).collect()} == set(kept)


def test_faces_of_one_row_number_are_no_pair(spark):
    """Ids from 100,000 on give re-uploads the row numbers of other faces."""
    df = faces(spark, unit(0, 1, 2, 40, 41)).withColumn("row_ix", F.when(F.col("row_ix") == 3, 2).otherwise(F.col("row_ix")).cast("long"))
    for block in (1024, 2):
        got = {(r.a, r.b) for r in pairs.event_pairs(df, -2.0, block=block).collect()}
        assert len(got) == 9 and ("f2", "f3") not in got and ("f3", "f2") not in got
    assert {(r.row_ix, r.root) for r in similar_components(df, 0.99).collect()} == {(0, 0), (1, 0), (2, 0), (4, 0)}
    assert similar_components(df, 0.99).count() == 4
    core = {r.face_id: r.core for r in clusters.core_distances(faces(spark, unit(0, 1, 40)).withColumn("row_ix", (F.col("row_ix") / 2).cast("long")), 2).collect()}
    assert abs(core["f1"] - (1 - math.cos(math.radians(39)))) < 1e-12


def test_faces_of_one_row_number_tie_their_neighbours(spark):
    df = faces(spark, unit(0, 40, 80, 41, 1)).withColumn("row_ix", F.expr("CASE row_ix WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE row_ix END"))
    assert {(r.row_ix, r.root) for r in similar_components(df, 0.99).collect()} == {(0, 0), (1, 1), (2, 1), (3, 0)}
    rows = faces(spark, unit(0, 50, 90, 51, 1, 91)).withColumn("row_ix", F.expr("CASE row_ix WHEN 5 THEN 4 ELSE row_ix END"))
    assert {(r.row_ix, r.root) for r in similar_components(rows, 0.99).collect()} == {(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)}


def test_equal_row_numbers_are_put_in_order_by_faces(spark):
    """Whatever order the rows come in, one answer."""
    rows = faces(spark, unit(0, 1, 2, 3), photos=["p"] * 4).withColumn("row_ix", F.lit(7).cast("long")).withColumn("cluster", F.lit("c")).withColumn("grp", F.lit(0))
    into = spark.createDataFrame([("e", "c", 0)], "event_id string, cluster string, target int")
    chain = [("f0", "f1"), ("f1", "f2"), ("f2", "f3")]
    for df in (rows.coalesce(1).sortWithinPartitions(F.desc("face_id")), rows.coalesce(1).sortWithinPartitions("face_id")):
        assert sorted((r.a, r.b) for r in feedback.merge_chain(df, into).collect()) == chain
        assert sorted((r.a, r.b) for r in feedback.split_links(df).collect()) == chain
        added = feedback.appended(df.limit(0), df)
        assert {r.face_id: r.row_ix for r in added.collect()} == {f"f{i}": i for i in range(4)}
        assert [r.face_id for r in routing.headcount_eligible(df, df.limit(0), df.limit(0)).collect()] == ["f0"]


def test_a_face_of_the_same_row_number_is_no_friend(spark):
    df = faces(spark, unit(0, 1, 90)).withColumn("row_ix", F.when(F.col("row_ix") < 2, 1).otherwise(2).cast("long"))
    assert {r.face_id for r in routing.headcount_eligible(df, df, df.limit(0)).collect()} == set()


def test_rows_are_stored_by_their_number(spark, tmp_path):
    """Vectors from number 200,000 on are no stored rows, as in the SQL; no two numbers collide here."""
    import duckdb

    import __spark_entry__ as entry

    ids = [5 * i for i in range(30)] + [200_001 + 5 * i for i in range(30)]
    spark.createDataFrame([(i, [0.1] * 64, i % 10) for i in ids], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["idempotent_append"](spark, str(tmp_path)).collect()
    want = duckdb.sql(entry.oracle_sql()["idempotent_append"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_reassigned_faces_meet_one_face_of_their_cluster(spark):
    rows = [("e", i, f"f{i}", f"p{i // 3}", "a" if i < 9 else "b") for i in range(12)] + [("lone", 0, "x", "p", "a")]
    df = spark.createDataFrame(rows, "event_id string, row_ix long, face_id string, photo_id string, cluster string")
    moves = spark.createDataFrame([("e", "p0", "a", "b"), ("e", "p2", "a", "b"), ("e", "p2", "a", "b"), ("lone", "p", "a", "b")], "event_id string, photo_id string, cluster string, target string")
    out = feedback.reassign_links(df, moves)
    assert sorted((r.a, r.b) for r in out.where("kind = 'cannot'").collect()) == [(f"f{i}", "f3") for i in range(3)] + [(f"f{i}", "f0") for i in range(6, 9)]
    assert {(r.a, r.b) for r in out.where("kind = 'must'").collect()} == {(f"f{i}", "f9") for i in (0, 1, 2, 6, 7, 8)}
    # No face is put beside all of its cluster, to be ranked.
    assert not any("Window" in line and "moved" in line for line in out._jdf.queryExecution().toString().splitlines())


def test_caches_are_merged_in_two_shuffles(spark):
    rows = [("e", f"f{i}", f"f{j}", float(i)) for i in range(6) for j in range(i + 1, 6)]
    old = spark.createDataFrame(rows, "event_id string, source_face_id string, rep_face_id string, similarity double")
    new = old.where("source_face_id = 'f1'").withColumn("similarity", F.lit(0.5)).union(spark.createDataFrame([("e", "f5", "f0", 9.0)], old.schema))
    alive = spark.createDataFrame([("e", f"f{i}") for i in (0, 1, 2, 5)], "event_id string, face_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = rejudge.merged_scores(old, new, alive)
        got = {(r.source_face_id, r.rep_face_id): r.similarity for r in out.collect()}
        plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {("f0", "f1"): 0.0, ("f0", "f2"): 0.0, ("f0", "f5"): 0.0, ("f1", "f2"): 0.5, ("f1", "f5"): 0.5, ("f2", "f5"): 2.0, ("f5", "f0"): 9.0}
    assert "FullOuter" not in plan


def test_a_vector_is_stored_once_however_many_cells_it_is_in(spark, tmp_path, monkeypatch):
    """Forty faces in blocks of four: files hold each face once, and no row is repeated for the cells; nor does it matter
    whether cells are dealt one by one or in tiles."""
    df = faces(spark, unit(*range(0, 360, 9)))
    df = df.union(faces(spark, unit(*range(3)), event="d"))  # an event of one block
    want = {(i, j, "e") for i in range(40) for j in range(i + 1, 40)} | {(0, 1, "d"), (0, 2, "d"), (1, 2, "d")}
    for tiles in (pairs.TILES, 0):
        shared = tmp_path / str(tiles)
        monkeypatch.setattr("albumweave.operators.graph.shared_dir", lambda spark, shared=shared: f"file://{shared}")
        monkeypatch.setattr(pairs, "TILES", tiles)
        made = pairs.event_pairs(df, -2.0, block=4)
        got = [(r.a_ix, r.b_ix, r.event_id) for r in made.collect()]
        assert len(got) == len(want) and set(got) == want
        files = [pa.ipc.open_stream(f.read_bytes()).read_all() for f in shared.glob("blocks-*/*") if not f.name.startswith(".")]
        assert len(files) > 1 and sorted(x for f in files for x in f.column("row_ix").to_pylist()) == list(range(40))
        assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_heads_of_crowded_photos_equal_brute_force(spark):
    """Twins by matrices and by rows, friends in the own block and beyond it, in events of many blocks and of one."""
    rng = np.random.default_rng(3)
    angles = np.concatenate([rng.choice([0, 40, 80, 120], 50) + rng.random(50), rng.random(10) * 360]).round(3).tolist()
    df = faces(spark, unit(*angles), photos=[f"p{i % 3}" for i in range(60)]).union(faces(spark, unit(0, 1, 90), photos=["p", "p", None], event="d"))
    rows = df.collect()
    s = lambda a, b: a.v[0] * b.v[0] + a.v[1] * b.v[1]
    mates = [(a, b) for a in rows for b in rows if a.event_id == b.event_id and a.row_ix != b.row_ix]
    lonely = {(a.event_id, a.face_id) for a in rows} - {(a.event_id, a.face_id) for a, b in mates if s(a, b) >= 0.9999}
    assert 5 < len(lonely) < 60
    for block in (4, 1024):
        assert {tuple(r) for r in routing.friendless(df, df, 0.9999, block).collect()} == lonely
        some = df.where("row_ix % 2 = 0")
        assert {tuple(r) for r in routing.friendless(df, some, 0.9999, block).collect()} == {x for x in lonely if int(x[1][1:]) % 2 == 0}
    links = spark.createDataFrame([(a.event_id, a.row_ix, b.row_ix) for a, b in mates if a.photo_id == b.photo_id and a.photo_id and s(a, b) >= 0.9999], "event_id string, a long, b long")
    of = lambda found: {tuple(r) for r in components(df.select("event_id", "row_ix"), found).collect()}
    want = of(links)
    for many, block in ((0, 4), (0, 1024), (10, 4), (1024, 4)):
        assert of(routing.twins(df, 0.9999, many, block)) == want


def test_faces_with_a_friend_in_their_block_meet_no_other(spark, monkeypatch):
    met = []
    across = routing.across_cells
    monkeypatch.setattr(routing, "across_cells", lambda some, *a: met.append(sorted(r.row_ix for r in some.collect())) or across(some, *a))
    df = faces(spark, unit(*([0.0] * 40), 90))
    assert [r.face_id for r in routing.friendless(df, df, 0.5, 20).collect()] == ["f40"]
    assert met == [[40]]


def test_forests_of_a_tile_are_joined_before_they_are_written(spark, monkeypatch):
    """Forty faces in ten blocks: the cells of three by three tiles hand on one forest for each tile."""
    rng = np.random.default_rng(8)
    df = faces(spark, unit(*(rng.random(40) * 360).tolist())).union(faces(spark, unit(0, 3, 90), event="d"))
    tree = lambda block: {(r.event_id, r.a, r.b, round(r.d, 9)) for r in density.spanning_tree(df, block=block).collect()}
    whole, written, settle = tree(1024), [], density.settled
    monkeypatch.setattr(pairs, "TILES", 0, raising=False)
    monkeypatch.setattr(density, "settled", lambda x: written.append(settle(x)) or written[-1])
    assert tree(4) == whole and len(whole) == 41
    assert written[0].count() <= 6 * 31 + 2 < 10 * 3 + 45 * 7


@pytest.mark.parametrize("k", [2, 3])
def test_core_distances_of_many_blocks(spark, monkeypatch, k):
    angles = (np.random.default_rng(k).random(30) * 360).tolist()
    df, v = faces(spark, unit(*angles)), np.array(unit(*angles))
    monkeypatch.setattr(clusters, "in_cells", lambda faces, run, schema: pairs.in_cells(faces, run, schema, block=4))
    core = {r.face_id: r.core for r in clusters.core_distances(df, k).collect()}
    want = np.sort(np.clip(1 - v @ v.T, 0, 2) + np.diag([-9.0] * 30), 1)[:, k - 1]
    assert all(abs(core[f"f{i}"] - want[i]) < 1e-12 for i in range(30)) and len(core) == 30
