"""An exact self-join of texts on the Jaccard similarity of their word shingles, by count vectors in R-trees.

Shingles are hashed into groups, 64 to 1,024 by the size of the set; a text is the point of its group counts. Points of
more groups are folded for a comparison with one of fewer. For two texts the sum of the smaller
coordinates bounds their overlap from above, and so do the boxes of an R-tree for all texts below them: a tree is joined
with itself from the root down, and pairs of boxes and of points that can't reach the threshold are left out. What is
left is verified on the sets.

Trees are built where linked texts are sure to meet. Every text takes part in the tree of each of its leading shingles:
in an order that all texts share, rare groups first, the first n - ceil(t * n) + 1 of its n shingles; two texts over the
threshold t have one of these in common. Texts with equal sets are one point, and equal trees are built once.

Only links that can join two components are verified, in three rounds: each tree's points against one of them; those
not yet in the tree's largest component against a few of each large one; and last every pair of points of different
components that the trees leave, on finer points of about one group for each shingle, and named by one of the trees that
hold both. Each round is followed by connected components, so that a group of thousands of near
copies costs about one verification for each copy, while no link between components can be missed.

Null and empty texts have no shingles and link with nothing: their component is their own doc_id. Texts of fewer words
than a shingle are one shingle, their whole sequence. Repeated rows are copies. A null doc_id takes part and is never
the name of a component that has another. Other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from albumweave.llm.common import materialise, new_folder, table
from albumweave.llm.components import components
from albumweave.llm.hash_arrays import HashArrays, narrow, shard_of, widen, write_shard
from albumweave.llm.words import distinct, mix, shingles, slices

#: Link when LINK[0] * overlap >= LINK[1] * union.
LINK = (100, 80)
SHINGLE = 5
#: Coordinates of the shortest count vectors; points of a leaf, boxes of an inner node.
GROUPS, LEAF, FANOUT = 64, 32, 8
#: Doublings of a vector's coordinates: at most, and the bits of a set's size below which there are none.
COARSE, FINE = (4, 10), (6, 6)
#: Bytes kept of a shingle's 64-bit hash to find texts with a common one; sets are compared by whole hashes.
WIDTH = 6
#: Trees that a point knows itself to be in, so that a pair is named by the first one of them that it shares.
KNOWN = 16
#: Bytes of rows that one task compares at once, and those of a row besides its count vector.
TASK_BYTES, ROW_BYTES = 8 << 20, 512
#: Texts whose sets are handed on at once.
HANDED = 1024
#: Parts of a shard's leading shingles that are sorted one after the other.
PARTS = 8
#: Members of a tree that one task compares; larger trees are cut into blocks that meet in pairs.
BLOCK = 2048
#: Points that others are compared with in the second round: of the largest component of a tree, and of how many more.
HEADS, NEXT = 4, 7
#: Cells of the table of shingle frequencies that orders shingles from rare to frequent: fixed, 8 MB at most.
CELL_BITS, CHUNK_BITS = 20, 14
#: A cell is frequent above so many times the mean.
FREQUENT, FREQUENT_LEAST = 4, 64


def _texts(column, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text that has one."""
    for s in slices(column):
        h, row = distinct(*shingles(s.hashes(), s.off, size))
        cuts = np.searchsorted(row, np.arange(s.last - s.first + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield s.first + k, h[cuts[k] : cuts[k + 1]]


def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of them is small; a worker then gives back what Arrow held for it."""
    for batch in batches:
        for i in range(0, batch.num_rows, HANDED):
            yield batch.slice(i, HANDED)
    pa.default_memory_pool().release_unused()


def frequent_cells(docs: DataFrame, size: int) -> dict[int, int]:
    """{cell: level} of the cells that more shingles fall into than `FREQUENT` times the mean; all texts are counted."""
    counted = pa.schema([("chunk", pa.int32()), ("total", pa.int64()), ("n", pa.binary())])
    cells, width = 1 << CELL_BITS, 1 << CHUNK_BITS

    def emit(n: np.ndarray) -> pa.RecordBatch:
        parts = n.reshape(-1, width)
        at = np.flatnonzero(parts.any(1))
        return pa.record_batch([pa.array(at.astype(np.int32)), pa.array(parts[at].sum(1)), pa.array([parts[k].astype("<u4").tobytes() for k in at], pa.binary())], schema=counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for batch in batches:
            for s in slices(batch.column(0)):
                h, _ = shingles(s.hashes(), s.off, size)
                n += np.bincount((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=cells)
            if n.max(initial=0) > 1 << 31:
                yield emit(n)
                n[:] = 0
        yield emit(n)

    def add(rows: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in rows.column("n"))
        return pa.table({"chunk": rows.column("chunk")[:1], "total": pa.array([int(n.sum())]), "n": pa.array([n.astype("<i8").tobytes()], pa.binary())})

    summed = materialise(docs.select("text").mapInArrow(count, "chunk int, total long, n binary").groupBy("chunk").applyInArrow(add, "chunk int, total long, n binary"), "cells")
    least = max(FREQUENT_LEAST, FREQUENT * (summed.agg(F.sum("total")).first()[0] or 0) / cells)

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                n = np.frombuffer(data.as_py(), "<i8")
                at = np.flatnonzero(n > least)
                yield pa.record_batch([pa.array(at + chunk * width), pa.array(1 + np.log2(n[at] / least).astype(np.int64))], names=["cell", "level"])

    return {r.cell: r.level for r in summed.mapInArrow(hot, "cell long, level long").collect()}  # a quarter of the cells at most


def points(docs: DataFrame, size: int, link: tuple[int, int]) -> DataFrame:
    """rid, doc_id, n, set (a digest of the shingles), vector, leading: one row per row of `docs`."""
    level = np.zeros(1 << CELL_BITS, np.uint8)
    for cell, lv in frequent_cells(docs, size).items():
        level[cell] = lv
    ratio = link
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("vector", pa.binary()), ("leading", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handed(batches):
            rows = batch.num_rows
            n, sets, vectors, leading = [0] * rows, [None] * rows, [None] * rows, [None] * rows
            for k, h in _texts(batch.column(1), size):
                n[k] = len(h)
                sets[k] = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                vectors[k] = vector(h).tobytes()
                lv = level[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                own = h[np.argsort(lv, kind="stable")] if lv.any() else h
                leading[k] = narrow(own[: len(h) + 1 - -(-len(h) * ratio[1] // ratio[0])] >> np.uint64(64 - 8 * WIDTH), WIDTH)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (sets, vectors, leading))], schema=schema)

    made = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set binary, vector binary, leading binary")
    return materialise(made.withColumn("rid", F.monotonically_increasing_id()), "points")


def doublings(n: int, scale: tuple[int, int]) -> int:
    return min(scale[0], max(0, int(n).bit_length() - scale[1]))


def vector(h: np.ndarray, scale: tuple[int, int] = COARSE) -> np.ndarray:
    """Group counts of a set, in bytes if they fit."""
    groups = GROUPS << doublings(len(h), scale)
    n = np.bincount(((h >> np.uint64(20)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return n.astype(np.uint8 if n.max() < 256 else "<u4")


class Points:
    """Count vectors at each number of groups; a vector is there at its own number and all smaller ones."""

    def __init__(self, n: np.ndarray, column: pa.ChunkedArray, scale: tuple[int, int] = COARSE) -> None:
        self.n = n
        self.level = np.array([doublings(x, scale) for x in n], np.int64)
        self.at: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        for lv in range(int(self.level.max(initial=0)), -1, -1):
            rows = np.flatnonzero(self.level >= lv)
            groups = GROUPS << lv
            at = np.full(len(n), -1, np.int64)
            at[rows] = np.arange(len(rows))
            own = {r: column[r].as_buffer() for r in np.flatnonzero(self.level == lv).tolist()}
            more = np.flatnonzero(self.level > lv)
            finer = self.counts[-1][self.at[-1][more]] if len(more) else np.empty((0, 2 * groups), np.uint8)
            folded = np.add(finer[:, :groups], finer[:, groups:], dtype=np.uint16 if finer.dtype == np.uint8 else np.int32)
            # Bytes where all counts fit: a quarter of the memory.
            fit = folded.max(initial=0) < 256 and all(x.size == groups for x in own.values())
            counts = np.empty((len(rows), groups), np.uint8 if fit else np.int32)
            for r, x in own.items():
                counts[at[r]] = np.frombuffer(x, np.uint8 if x.size == groups else "<u4")
            counts[at[more]] = folded
            self.at.append(at)
            self.counts.append(counts)
        self.at.reverse()
        self.counts.reverse()

    def part(self, rows: np.ndarray) -> Points:
        out = object.__new__(Points)
        out.n, out.level, out.counts = self.n[rows], self.level[rows], self.counts
        out.at = [x[rows] for x in self.at]
        return out

    def close(self, a: np.ndarray, b: np.ndarray, link: tuple[int, int]) -> np.ndarray:
        """Whether the sums of the smaller coordinates of points a and b reach the threshold."""
        out = np.zeros(len(a), bool)
        level = np.minimum(self.level[a], self.level[b])
        for lv in np.unique(level).tolist():
            rows = np.flatnonzero(level == lv)
            at, counts = self.at[lv], self.counts[lv]
            for i in range(0, len(rows), step := (1 << 22) // (GROUPS << lv)):
                r = rows[i : i + step]
                x, y = a[r], b[r]
                out[r] = (link[0] + link[1]) * np.minimum(counts[at[x]], counts[at[y]]).sum(1, dtype=np.int64) >= link[1] * (self.n[x] + self.n[y])
        return out


def trees(rows: DataFrame, copies: HashArrays, shards: int) -> DataFrame:
    """(tree, rid): the sets of two or more texts with a leading shingle in common, each set once. Rows in `copies` are
    left out. A tree's name is a sum of hashes of its texts; should two names be equal, their texts are joined in one
    tree, which loses no pair."""
    blocks = pa.schema([("shard", pa.int32()), ("shingle", pa.binary()), ("rid", pa.binary())])
    high = np.uint64(64 - 8 * WIDTH)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, inv = np.unique(mix(batch.column(0).to_numpy().view(np.uint64)), return_inverse=True)
            first = np.flatnonzero(~copies.lookup(key)[0][inv])
            parts = [widen(batch.column(1)[k].as_py(), WIDTH) for k in first.tolist()]
            if not parts:
                continue
            h = np.concatenate(parts)
            rid = np.repeat(batch.column(0).to_numpy()[first], [len(x) for x in parts])
            shard = shard_of(h << high, shards)
            order = np.argsort(shard, kind="stable")  # texts stay together, so that their ids compress
            cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            at = np.flatnonzero(np.diff(cuts))
            data = [(narrow(h[o := order[cuts[k] : cuts[k + 1]]], WIDTH), rid[o].tobytes()) for k in at]
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array([x for x, _ in data], pa.binary()), pa.array([y for _, y in data], pa.binary())], schema=blocks)

    def meet(rows: pa.Table) -> pa.Table:
        h = np.concatenate([widen(x.as_py(), WIDTH) for x in rows.column("shingle")])
        rid = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in rows.column("rid")])
        part = (h % np.uint64(PARTS)).astype(np.uint8)
        return pa.concat_tables([met(h[at], rid[at]) for k in range(PARTS) if len(at := np.flatnonzero(part == k))])

    def met(h: np.ndarray, rid: np.ndarray) -> pa.Table:
        order = np.argsort(h, kind="stable")
        h, rid = h[order], rid[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        name = np.add.reduceat(mix(rid.view(np.uint64)), first)
        many = np.flatnonzero(size > 1)
        _, once = np.unique(name[many], return_index=True)
        many = many[once]
        at = np.repeat(first[many] - np.concatenate([[0], np.cumsum(size[many])[:-1]]), size[many]) + np.arange(int(size[many].sum()))
        return pa.table({"tree": pa.array(np.repeat(name[many], size[many]).view(np.int64)), "rid": pa.array(rid[at])})

    dealt = rows.where("n > 0").select("rid", "leading").mapInArrow(deal, "shard int, shingle binary, rid binary")
    return dealt.groupBy("shard").applyInArrow(meet, "tree long, rid long").distinct()


class RTree:
    """Boxes over the coarsest coordinates of points, in order of size: leaves of `LEAF` points, inner nodes of `FANOUT`
    boxes up to one root. A box is its largest coordinates, sizes, components, and whether a point is asked for."""

    def __init__(self, points: Points, comp: np.ndarray, asked: np.ndarray) -> None:
        v = points.counts[0][points.at[0]]
        self.order = np.lexsort((v[:, 1], v[:, 0], points.n))
        own, n = comp[self.order], points.n[self.order]
        boxes = (v[self.order], n, n, own, own, asked[self.order])
        least, most, either = np.minimum.reduceat, np.maximum.reduceat, np.logical_or.reduceat
        self.levels: list[tuple] = []
        width = LEAF
        while not self.levels or len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(boxes[0]), width)
            boxes = tuple(f(x, at, 0) for f, x in zip((most, least, most, least, most, either), boxes, strict=True))
            self.levels.append(boxes)
            width = FANOUT

    def meet(self, level: int, i: np.ndarray, j: np.ndarray, link: tuple[int, int]) -> np.ndarray:
        """Whether boxes i and j can hold a pair of points of different components over the threshold."""
        high, low_n, high_n, low_c, high_c, asked = self.levels[level]
        ok = (link[1] * low_n[j] <= link[0] * high_n[i]) & (link[1] * low_n[i] <= link[0] * high_n[j]) & (asked[i] | asked[j])
        ok &= (np.minimum(low_c[i], low_c[j]) != np.maximum(high_c[i], high_c[j]))
        at = np.flatnonzero(ok)
        ok[at] = (link[0] + link[1]) * np.minimum(high[i[at]], high[j[at]]).sum(1, dtype=np.int64) >= link[1] * (low_n[i[at]] + low_n[j[at]])
        return ok

    def leaves(self, link: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of leaves that are left, from the root down."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                i, j = below(i, j, FANOUT, len(self.levels[level][0]), 0)
            ok = self.meet(level, i, j, link)
            i, j = i[ok], j[ok]
        return i, j


def below(i: np.ndarray, j: np.ndarray, width: int, size: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of pairs of nodes, each once, the second at least `apart` after the first."""
    p, q = (x.ravel() for x in np.indices((width, width)))
    a, b = (i[:, None] * width + p).ravel(), (j[:, None] * width + q).ravel()
    ok = (b < size) & (a + apart <= b)
    return a[ok], b[ok]


def tree_pairs(points: Points, comp: np.ndarray, link: tuple[int, int], asked: np.ndarray | None = None, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points of different components that an R-tree of group counts can't rule out: only those with a point
    that `asked` marks, and of two sides, where these are given."""
    tree = RTree(points, comp, np.ones(len(comp), bool) if asked is None else asked)
    left, right = tree.leaves(link)
    for k in range(0, len(left), 256):
        a, b = (tree.order[x] for x in below(left[k : k + 256], right[k : k + 256], LEAF, len(comp), 1))
        ok = (comp[a] != comp[b]) & (link[1] * points.n[b] <= link[0] * points.n[a])
        if asked is not None:
            ok &= asked[a] | asked[b]
        if side is not None:
            ok &= side[a] != side[b]
        a, b = a[ok], b[ok]
        ok = points.close(a, b, link)
        if ok.any():
            yield a[ok], b[ok]


def not_ruled_out(members: DataFrame, shards: int, link: tuple[int, int]) -> DataFrame:
    """The rows of a table (tree, rid, n, vector) whose point has one in its tree that its counts don't rule out. Trees
    of over a block, which may be split among tasks later, keep all rows."""
    schema = "tree long, rid long, n long, vector binary"

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tree", "ascending"), ("n", "ascending"), ("rid", "ascending")])
        tree, n = rows.column("tree").to_numpy(), rows.column("n").to_numpy()
        points = Points(n, rows.column("vector"))
        first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
        size = np.diff(np.append(first, len(tree)))
        keep = np.zeros(len(tree), bool)
        for m in range(2, LEAF // 2 + 1):  # small trees are one leaf: all of one size at once
            at = first[size == m]
            for i in range(0, len(at), 4096):
                p, q = np.triu_indices(m, 1)
                a, b = ((at[i : i + 4096, None] + x).ravel() for x in (p, q))
                a, b = a[(ok := link[1] * n[b] <= link[0] * n[a])], b[ok]
                ok = points.close(a, b, link)
                keep[a[ok]] = keep[b[ok]] = True
        for i, m in zip(first[size > LEAF // 2].tolist(), size[size > LEAF // 2].tolist(), strict=True):
            j = np.arange(i, i + m - 1)
            ok = points.close(j, j + 1, link)
            keep[j[ok]] = keep[j[ok] + 1] = True
            for a, b in tree_pairs(points.part(np.arange(i, i + m)), np.arange(m), link, ~keep[i : i + m]):
                keep[a + i] = keep[b + i] = True
        return rows.filter(pa.array(keep)).select(["tree", "rid", "n", "vector"])

    large = members.groupBy("tree").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("tree")
    small = members.join(large, "tree", "left_anti").withColumn("shard", F.pmod(F.col("tree"), F.lit(shards)))
    return small.groupBy("shard").applyInArrow(run, schema).unionByName(members.join(large, "tree", "left_semi").select("tree", "rid", "n", "vector"))


def with_heads(members: DataFrame, heads: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Pairs of a tree's points (tree, rid, comp, n, vector) and its heads, of other components, that the counts leave.
    Nothing is gathered by tree: a large one can be split among tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b, v_a, v_b = batch.columns
            m = batch.num_rows
            points = Points(np.concatenate([n_a.to_numpy(), n_b.to_numpy()]), pa.chunked_array([v_a, v_b]))
            ok = points.close(np.arange(m), np.arange(m, 2 * m), link)
            a, b = a.to_numpy()[ok], b.to_numpy()[ok]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    head = heads.select("tree", *(F.col(c).alias(f"h_{c}") for c in ("rid", "comp", "n", "vector")))
    size = F.lit(link[1]) * F.greatest("n", "h_n") <= F.lit(link[0]) * F.least("n", "h_n")
    both = members.join(head, "tree").where((F.col("comp") != F.col("h_comp")) & size)
    return both.select(F.col("h_rid").alias("a"), F.col("rid").alias("b"), F.col("h_n").alias("na"), F.col("n").alias("nb"), F.col("h_vector").alias("va"), F.col("vector").alias("vb")).mapInArrow(run, "a long, b long").distinct()


def largest_heads(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, largest): of each tree a few points of its largest component and one of each of the next ones, and
    (tree, comp) of the largest. Ranks keep a few rows of each tree before the shuffle."""
    ids = members.select("tree", "rid", "comp")
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("size"), "comp"))
    top = ids.groupBy("tree", "comp").agg(F.count("*").alias("size")).withColumn("place", place).where(F.col("place") <= NEXT + 1)
    turn = F.row_number().over(Window.partitionBy("tree", "comp").orderBy(F.xxhash64("rid"), "rid"))
    chosen = ids.withColumn("turn", turn).where(F.col("turn") <= HEADS).join(top, ["tree", "comp"]).where("place = 1 OR turn = 1")
    heads = members.join(chosen.select("tree", "rid"), ["tree", "rid"])
    return heads, top.where("place = 1").select("tree", "comp")


def in_cells(members: DataFrame) -> DataFrame:
    """Members with the cells (i, j) they take part in and their block; trees of one block have one cell."""
    large = members.groupBy("tree").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("tree", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(large, "tree", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def shared_before(known: np.ndarray, a: np.ndarray, b: np.ndarray, tree: int) -> np.ndarray:
    """Whether the points of each pair both know of a tree before this one, where the pair is found too."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), step := 1 << 14):
        x, y = known[a[i : i + step]], known[b[i : i + step]]
        out[i : i + step] = ((x[:, :, None] == y[:, None, :]) & (x < tree)[:, :, None]).any((1, 2))
    return out


def task_count(members: DataFrame, least: int) -> int:
    """Tasks that `all_pairs` deals the cells of a table (tree, rid, n) to, each of about `TASK_BYTES`: every row counts as
    often as it is in a cell, with its ids and a vector of at most two coordinates for each shingle."""
    size = F.lit(ROW_BYTES) + F.greatest(F.lit(GROUPS), F.least(2 * F.col("n"), F.lit(4 * GROUPS << FINE[0])))
    held = in_cells(members.select("tree", "rid", "n")).agg(F.sum(size)).first()[0] or 0
    return max(least, -(-held // TASK_BYTES))


def all_pairs(members: DataFrame, fine: DataFrame, shards: int, link: tuple[int, int]) -> DataFrame:
    """Every pair (a, b) of points of different components that the trees leave, of a table (tree, rid, comp, n), by
    the vectors (rid, fine)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tree", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rid", "ascending")])
        tree, rid, comp, n, i_, j_, block = (rows.column(c).to_numpy() for c in ("tree", "rid", "comp", "n", "i", "j", "block"))
        points = Points(n, rows.column("fine"), FINE)
        known = np.full((len(tree), KNOWN), np.iinfo(np.int64).max)
        lists = rows.column("known").combine_chunks()
        lens = lists.value_lengths().to_numpy()
        known[np.arange(KNOWN) < lens[:, None]] = lists.flatten().to_numpy()
        new = np.ones(len(tree), bool)
        new[1:] = (tree[1:] != tree[:-1]) | (i_[1:] != i_[:-1]) | (j_[1:] != j_[:-1])
        first = np.flatnonzero(new)
        out_a, out_b = [], []
        for i, j in zip(first.tolist(), np.append(first[1:], len(tree)).tolist(), strict=True):
            for a, b in tree_pairs(points.part(np.arange(i, j)), comp[i:j], link, None, block[i:j] if i_[i] != j_[i] else None):
                ok = ~shared_before(known, a + i, b + i, tree[i])
                out_a.append(a[ok] + i)
                out_b.append(b[ok] + i)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b))
        a, b = np.minimum(rid[a], rid[b]), np.maximum(rid[a], rid[b])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.table({"a": pa.array(a[once]), "b": pa.array(b[once])})

    known = members.groupBy("rid").agg(F.slice(F.array_sort(F.collect_set("tree")), 1, KNOWN).alias("known"))
    rows = in_cells(members.select("tree", "rid", "comp", "n").join(known.join(fine, "rid"), "rid"))
    # A tree of one block keeps to its shard with others; cells of larger ones are dealt out.
    shard = F.pmod(F.xxhash64("tree", "i", "j"), F.lit(shards)).alias("shard")
    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def _keys(ids: pa.Array) -> np.ndarray:
    return mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def id_set(ids: DataFrame, shards: int) -> HashArrays:
    """The numbers of a one-column table as sorted arrays of their hashes."""
    folder = new_folder(ids.sparkSession, "ids")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = _keys(batch.column(0))
            yield pa.record_batch([pa.array(shard_of(k, shards).astype(np.int32)), pa.array(k.view(np.int64))], names=["shard", "key"])

    def write(rows: pa.Table) -> pa.Table:
        write_shard(folder, "ids", rows.column("shard")[0].as_py(), np.unique(rows.column("key").to_numpy().view(np.uint64)))
        return pa.table({"shard": rows.column("shard")[:1]})

    filled = [r.shard for r in ids.mapInArrow(deal, "shard int, key long").groupBy("shard").applyInArrow(write, "shard int").collect()]  # a number for each shard
    return HashArrays(folder, "ids", shards, filled)


def sets(docs: DataFrame, reps: DataFrame, size: int, shards: int) -> DataFrame:
    """(rid, shingles, fine) of the texts in `reps` (rid, doc_id, set), found again in `docs` by doc_id and digest."""
    wanted = id_set(reps.select("doc_id"), shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, inv = np.unique(_keys(batch.column(0)), return_inverse=True)
            text = batch.column(1).filter(pa.array(wanted.lookup(k)[0][inv]))
            for i in range(0, len(text), HANDED):
                found = [h for _, h in _texts(text[i : i + HANDED], size)]
                made = ([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in found], [h.tobytes() for h in found], [vector(h, FINE).tobytes() for h in found])
                yield pa.record_batch([pa.array(x, pa.binary()) for x in made], names=["set", "shingles", "fine"])
        pa.default_memory_pool().release_unused()

    again = docs.select("doc_id", "text").mapInArrow(run, "set binary, shingles binary, fine binary")
    return materialise(again.join(reps.select("rid", "set"), "set").select("rid", "shingles", "fine").dropDuplicates(["rid"]), "sets")


def verified(pairs: DataFrame, shingle_sets: DataFrame, link: tuple[int, int]) -> DataFrame:
    """The pairs with `linked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handed(batches):
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(link[0] * both >= link[1] * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    left, right = (shingle_sets.select(F.col("rid").alias(k), F.col("shingles").alias(f"s_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, linked boolean")


def classes(docs: DataFrame, size: int = SHINGLE, link: tuple[int, int] = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = points(docs, size, link)
    # Texts with one set are one point, named by its first row.
    same = materialise(rows.where("n > 0").groupBy("set").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_doc")), "classes")
    heads = rows.select("rid", "set", "doc_id", "n", "vector").join(same.select("rid"), "rid", "left_semi")
    copies = id_set(rows.where("n > 0").select("rid").join(same.select("rid"), "rid", "left_anti"), shards)
    member = materialise(trees(rows, copies, shards).join(heads.select("rid", "n", "vector"), "rid"), "members")
    member = materialise(not_ruled_out(member, shards, link), "trees")
    known = member.select("rid").distinct().join(heads.select("rid", "doc_id", "set"), "rid")
    shingle_sets = sets(docs, known, size, shards)
    root, done = None, None
    for turn in (1, 2, 3):
        if root is None:
            at = member.withColumn("comp", F.col("rid"))
        else:
            at = member.join(root.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root")
            # A tree whose points are all in one component has no more to give.
            open_trees = at.groupBy("tree").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("tree")
            at = at.join(open_trees, "tree", "left_semi")
        if turn == 1:
            first = at.groupBy("tree").agg(F.min("rid").alias("rid"))
            pairs = with_heads(at, at.join(first, ["tree", "rid"], "left_semi"), link)
        elif turn == 2:
            heads_of, largest = largest_heads(at)
            pairs = with_heads(at.join(largest, ["tree", "comp"], "left_anti"), heads_of, link)
        else:
            fine = shingle_sets.select("rid", "fine")
            at = materialise(at.select("tree", "rid", "comp", "n"), "open")
            pairs = all_pairs(at, fine, task_count(at, shards), link)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs, f"pairs{turn}")
        judged = materialise(verified(pairs, shingle_sets, link), f"verified{turn}")
        new = judged.where("linked").select("a", "b")
        done = judged.select("a", "b") if done is None else done.union(judged.select("a", "b"))
        if root is not None:
            if new.isEmpty():
                continue
            new = new.union(root.select(F.col("node").alias("a"), F.col("root").alias("b")))
        root = components(new)
    in_class = same.join(root.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    names = in_class.groupBy("root").agg(F.min("first_doc").alias("name"))
    in_class = in_class.join(names, "root").select("set", "name")
    out = rows.select("doc_id", "n", "set").join(in_class, "set", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, size: int = SHINGLE, link: tuple[int, int] = LINK) -> DataFrame:
    """`docs` with one row of each component: the one of the smallest doc_id, nulls last. Rows without words stay."""
    names = [c for c in docs.columns if c != "_row"]
    rows = materialise(docs.select(*names).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = classes(rows.select(F.col("_row").alias("doc_id"), "text"), size, link).where("n_shingles > 0")
    found = materialise(found.join(rows.select(F.col("_row").alias("doc_id"), F.col("doc_id").alias("own_id")), "doc_id"), "components")
    order = F.struct(F.col("own_id").isNull().alias("none"), F.col("own_id").alias("id"), F.col("doc_id").alias("row"))
    stays = found.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("doc_id"))
    goes = materialise(found.join(stays, "doc_id", "left_anti").select(F.col("doc_id").alias("_row")), "copies")
    return rows.join(goes, "_row", "left_anti").select(*names)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
