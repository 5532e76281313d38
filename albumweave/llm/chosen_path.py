"""Near duplicates by a set similarity join along chosen paths, over the shingles of whole texts.

Each set of shingles has `POSITIONS` minwise tokens: the shingle that comes first in one of as many random orders. Two
sets of similarity s have a given one in common with probability s. A tree branches: a node picks 1 / threshold of the
positions on average, and its sets go to a child for each of them, by their token there; two sets at the threshold thus
share one child on average at each level, unlike ones soon share none. Nodes of up to `SMALL` sets are compared
exhaustively, larger ones branch again. The trees are independent, and as many as reach `RECALL` for a pair at the
threshold that lies `DEPTH` levels down, reckoned from the branching; a pair that shares more is found more surely.

Only links that can join two components matter, so a group of thousands of near copies does not become all of its pairs:
first each node's sets meet one of them, then in large nodes a few of the largest component and one of each of the next
ones, and a node whose sets are all in one component is done. Where one component holds half of a large node, branching
would not part it: the rest is compared with the whole node, in blocks. So is a node that is still large `DEPTH` levels
down, so that no node is given up. What a comparison of the tokens (a byte each) doesn't rule out is confirmed on the
full sets of shingle hashes: those of a block meet in one task, which hands on no more links than join its components. A pair over the threshold is ruled out wrongly, by fewer than `AGREE` common tokens of 64,
about twice in a million times.

Null and empty texts have no shingles and link with nothing: their component is their own doc_id. Texts of fewer words
than a shingle are one shingle, their whole sequence. Texts of one set, such as repeated rows, are one set, whatever
their number. A null doc_id takes part and names no component that has another; it is kept only if its component has
none. Texts of any length are read whole. Further columns are ignored. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumweave.llm.common import materialise, table
from albumweave.llm.components import components
from albumweave.llm.jaccard import _keys, id_set, verified
from albumweave.llm.words import distinct, mix, shingles, slices

#: Link when LINK[0] * overlap >= LINK[1] * union.
LINK = (100, 85)
SHINGLE = 5
#: Minwise tokens of a set; how many of them two sets over the threshold have in common at least (5 deviations).
POSITIONS, AGREE = 64, 40
#: Probability that a pair at the threshold is found, in nodes so many levels down.
RECALL, DEPTH = 0.9999, 4
#: Sets of a node that are compared exhaustively; sets of a block of a larger one.
SMALL, BLOCK, BLOCK_SHINGLES = 256, 2048, 1 << 20
#: Columns of the tables whose products count common hashes.
COLUMNS = 4096
#: Sets that all others of a large node meet: of its largest component, and of how many more.
HEADS, NEXT = 4, 7
#: Bytes of sets that one task compares.
TASK_BYTES = 16 << 20
#: Which side of a cell a row is on.
ALL, LEFT, RIGHT = 0, 1, 2
CELL = ["node", "l", "r", "rid", "comp", "n", "tokens", "side", "shard"]
#: The random orders.
_RANDOM = np.random.Generator(np.random.PCG64(85)).integers(1, 2**63, (2, POSITIONS), dtype=np.uint64)
_CHILD = np.uint64(0x9FB21C651E98DF25)
_CHILD_OF = np.arange(1, 9, dtype=np.uint64) * _CHILD


def survival(threshold: float, depth: int) -> float:
    """Probability that two sets at the threshold share a node of one tree so many levels down: a node picks
    1 / threshold positions on average, that number rounded down or up."""
    whole, part = divmod(1 / threshold, 1)
    stay = 1.0
    for _ in range(depth):
        apart = 1 - threshold * stay
        stay = 1 - (1 - part) * apart**whole - part * apart ** (whole + 1)
    return stay


def trees_for(threshold: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    stay = survival(threshold, depth)
    return 1 if stay >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - stay)))


def root_positions(link: tuple[int, int], recall: float = RECALL) -> int:
    """Positions that the roots of all trees pick together, each another; deeper nodes pick among the rest."""
    threshold = link[1] / link[0]
    return min(POSITIONS // 2, math.ceil(trees_for(threshold, recall) / threshold))


def tokens(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minwise tokens of sets that begin at `first`, a row for each set."""
    out = np.empty((len(first), POSITIONS), np.uint32)
    for k in range(POSITIONS):
        order = (h ^ _RANDOM[0, k]) * (_RANDOM[1, k] | np.uint64(1))
        out[:, k] = np.minimum.reduceat((order >> np.uint64(32)).astype(np.uint32), first)
    return out


def points(docs: DataFrame, size: int, roots: int) -> DataFrame:
    """doc_id, n, set (a digest), tokens (a byte each) and nodes (of the first level, one for each position that a root
    picks) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("tokens", pa.binary()), ("nodes", pa.binary())])
    place = np.arange(roots, dtype=np.uint64) << np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n, sets, own, nodes = [0] * rows, [None] * rows, [None] * rows, [None] * rows
            for s in slices(batch.column(1)):
                h, row = distinct(*shingles(s.hashes(), s.off, size))
                if not len(h):
                    continue
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                least = tokens(h, first)
                low = (mix(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                root = mix(least[:, :roots].astype(np.uint64) | place)
                for k, (i, j) in enumerate(zip(first.tolist(), np.append(first[1:], len(h)).tolist(), strict=True)):
                    at = s.first + int(row[i])
                    n[at], sets[at] = j - i, hashlib.blake2b(h[i:j].tobytes(), digest_size=16).digest()
                    own[at], nodes[at] = low[k].tobytes(), root[k].tobytes()
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (sets, own, nodes))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set binary, tokens binary, nodes binary")


def first_nodes(sets: DataFrame) -> DataFrame:
    """(node, rid) of the first level of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
                yield pa.record_batch([pa.array(nodes), pa.array(np.repeat(batch.column(0).to_numpy(), len(nodes) // batch.num_rows))], names=["node", "rid"])

    return sets.select("rid", "nodes").mapInArrow(run, "node long, rid long")


def branched(members: DataFrame, roots: int, link: tuple[int, int]) -> DataFrame:
    """Members (node, rid, comp, n, tokens) in the children that their nodes pick."""
    whole, part = divmod(link[0] / link[1], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy().view(np.uint64)
            t = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, POSITIONS)
            picks = int(whole) + (mix(node ^ _CHILD) < np.uint64(part * 2**64)).astype(np.int64)
            for k in range(int(whole) + 1):
                at = np.flatnonzero(picks > k)
                place = roots + (mix(node[at] + _CHILD_OF[k]) % np.uint64(POSITIONS - roots)).astype(np.int64)
                child = mix(node[at] * _CHILD ^ (place.astype(np.uint64) << np.uint64(8)) ^ t[at, place].astype(np.uint64))
                rows = batch.take(pa.array(at))
                yield pa.record_batch([pa.array(child.view(np.int64)), *rows.columns[1:]], names=["node", "rid", "comp", "n", "tokens"])

    return members.select("node", "rid", "comp", "n", "tokens").mapInArrow(run, "node long, rid long, comp long, n long, tokens binary")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of tokens have enough of them in common."""
    return (a == b).sum(-1) >= AGREE


def within(n: np.ndarray, a: np.ndarray, b: np.ndarray, link: tuple[int, int]) -> np.ndarray:
    """Whether sets of these sizes can be linked at all."""
    return link[1] * np.maximum(n[a], n[b]) <= link[0] * np.minimum(n[a], n[b])


def not_ruled_out(pairs: DataFrame, sets: DataFrame, link: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sizes and tokens leave a link open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, POSITIONS) for k in (2, 3))
                keep = pa.array(near(x, y))
                yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left, right = (sets.select(F.col("rid").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}")) for k in "ab")
    size = F.lit(link[1]) * F.greatest("na", "nb") <= F.lit(link[0]) * F.least("na", "nb")
    return pairs.join(left, "a").join(right, "b").where(size).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def in_components(members: DataFrame, root: DataFrame) -> DataFrame:
    """Members with `comp`, their own component so far."""
    at = members.join(root.withColumnRenamed("node", "rid"), "rid", "left")
    return at.withColumn("comp", F.coalesce("root", "rid")).drop("root")


def parts_of(at: DataFrame) -> DataFrame:
    """(node, comp, m, heads): how many sets of a component a node holds, and a few of them."""
    slot = F.pmod(F.xxhash64("rid"), F.lit(HEADS))
    heads = [F.min(F.when(slot == k, F.col("rid"))).alias(f"h{k}") for k in range(HEADS)]
    parts = at.groupBy("node", "comp").agg(F.count("*").alias("m"), *heads)
    return parts.select("node", "comp", "m", F.array_compact(F.array(*(f"h{k}" for k in range(HEADS)))).alias("heads"))


def opened(at: DataFrame) -> DataFrame:
    """Members of nodes that hold more than one component, with the node's size, its largest component, that one's share,
    and into how many blocks its sets, and those outside of the largest component, are to be cut."""
    parts = at.groupBy("node", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("k"))
    most = F.max(F.struct("m", "comp", "k")).alias("most")
    nodes = parts.groupBy("node").agg(F.sum("m").alias("size"), F.sum("k").alias("k"), most, F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda m, k: F.greatest(F.ceil(m / BLOCK), F.ceil(k / BLOCK_SHINGLES), F.lit(1)).cast("int")
    outside = blocks(F.col("size") - F.col("most.m"), F.col("k") - F.col("most.k"))
    nodes = nodes.select("node", "size", F.col("most.comp").alias("largest"), F.col("most.m").alias("share"), outside.alias("ls"), blocks(F.col("size"), F.col("k")).alias("rs"))
    return at.join(nodes, "node")


def met_heads(at: DataFrame, own: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of a large node's sets outside of its largest component and its heads, of other components, whose sizes
    and tokens leave a link open. A row of a set carries the heads of its node, at most `HEADS` + `NEXT`, into its task,
    which compares them there: `own` are (rid, n, tokens)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, row = batch.column(4).flatten(), np.repeat(np.arange(batch.num_rows), batch.column(4).value_lengths().to_numpy())
            rid, comp, n = (batch.column(k).to_numpy() for k in range(3))
            heads = heads.flatten()
            h, of, m = (heads[k].to_numpy() for k in range(3))
            t, u = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, POSITIONS) for x in (batch.column(3), heads[3]))
            at = np.flatnonzero((comp[row] != of) & (link[1] * np.maximum(n[row], m) <= link[0] * np.minimum(n[row], m)))
            at = at[near(t[row[at]], u[at])]
            yield pa.record_batch([pa.array(np.minimum(rid[row[at]], h[at])), pa.array(np.maximum(rid[row[at]], h[at]))], schema=schema)

    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("m"), "comp"))
    parts = parts_of(at).withColumns({"size": F.sum("m").over(Window.partitionBy("node")), "place": place})
    parts = parts.where((F.col("size") > SMALL) & (F.col("place") <= NEXT + 1))
    heads = F.transform(F.when(F.col("place") == 1, F.col("heads")).otherwise(F.slice("heads", 1, 1)), lambda h: F.struct(h.alias("rid"), F.col("comp").alias("comp")))
    nodes = parts.groupBy("node").agg(F.flatten(F.collect_list(heads)).alias("heads"), F.min_by("comp", "place").alias("largest"), F.count("*").alias("comps")).where("comps > 1")
    # A few heads of each large node, with their tokens.
    whole = nodes.select("node", "largest", F.explode("heads").alias("head")).select("node", "largest", F.col("head.rid").alias("rid"), F.col("head.comp").alias("comp")).join(own, "rid")
    whole = whole.groupBy("node").agg(F.collect_list(F.struct("rid", "comp", "n", "tokens")).alias("heads"))
    met = at.join(nodes.select("node", "largest"), "node").where("comp <> largest").join(own, "rid").join(whole, "node")
    return met.select("rid", "comp", "n", "tokens", "heads").mapInArrow(run, "a long, b long").distinct()


def in_cells(cells: DataFrame, work: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: str) -> DataFrame:
    """What `work` makes of each shard's rows, in order, and of the first rows of its cells."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("node", "ascending"), ("l", "ascending"), ("r", "ascending"), ("rid", "ascending")])
        node, lb, rb = (rows.column(c).to_numpy() for c in ("node", "l", "r"))
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (lb[1:] != lb[:-1]) | (rb[1:] != rb[:-1])]))
        return work(rows, first)

    return cells.groupBy("shard").applyInArrow(run, schema)


def _tokens(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _sides(own: np.ndarray, side: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a cell that are compared, and those with which: of a small node all outside of its largest component
    with all."""
    if side[own[0]] == ALL:
        part = np.unique(comp[own], return_inverse=True)[1]
        return own[part != np.argmax(np.bincount(part))], own
    return own[side[own] == LEFT], own[side[own] == RIGHT]


def suspects(cells: DataFrame, link: tuple[int, int]) -> DataFrame:
    """The rows of cells that have one of another component in their cell whose size and tokens leave a link open."""

    def work(rows: pa.Table, first: np.ndarray) -> pa.Table:
        comp, n, side = (rows.column(c).to_numpy() for c in ("comp", "n", "side"))
        t = _tokens(rows)
        size = np.diff(np.append(first, len(comp)))
        keep = np.zeros(len(comp), bool)

        def look(i: np.ndarray, j: np.ndarray) -> None:
            ok = (comp[i] != comp[j]) & within(n, i, j, link)
            i, j = i[ok], j[ok]
            ok = near(t[i], t[j])
            keep[i[ok]] = keep[j[ok]] = True

        tiny = (size <= 16) & (side[first] == ALL)
        for m in range(2, 17):  # tiny nodes of one size at once
            at = first[tiny & (size == m)]
            p, q = np.triu_indices(m, 1)
            for i in range(0, len(at), step := 1 + (1 << 18) // len(p)):
                look((at[i : i + step, None] + p).ravel(), (at[i : i + step, None] + q).ravel())
        for i, m in zip(first[~tiny].tolist(), size[~tiny].tolist(), strict=True):
            asked, others = _sides(np.arange(i, i + m), side, comp)
            for x in asked.tolist():
                look(np.full(len(others), x), others)
        return rows.filter(pa.array(keep)).select(CELL)

    return in_cells(cells, work, "node long, l int, r int, rid long, comp long, n long, tokens binary, side int, shard int")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of sets (sorted hashes) on two sides: products of their rows of a table of hashes,
    some columns at a time; a hash on one side only is left out."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    row = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right)]
    at = [np.minimum(np.searchsorted(both, x), max(len(both) - 1, 0)) for x in (a, b)]
    for i in range(0, len(both), COLUMNS):
        tables = []
        for x, r, p, m in zip((a, b), row, at, (len(left), len(right)), strict=True):
            here = (p >= i) & (p < i + COLUMNS)
            here[here] = both[p[here]] == x[here]
            table_ = np.zeros((m, min(COLUMNS, len(both) - i)), np.float32)
            table_[r[here], p[here] - i] = 1
            tables.append(table_)
        out += tables[0] @ tables[1].T
    return out


def linked_in(cells: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join all components of a cell which links join: a tree of each."""

    def work(rows: pa.Table, first: np.ndarray) -> pa.Table:
        rid, comp, n, side = (rows.column(c).to_numpy() for c in ("rid", "comp", "n", "side"))
        t, sets = _tokens(rows), [np.frombuffer(x.as_py(), "<u8") for x in rows.column("shingles")]
        out: list[tuple[int, int]] = []
        for i, j in zip(first.tolist(), np.append(first[1:], len(rid)).tolist(), strict=True):
            x, y = _sides(np.arange(i, j), side, comp)
            if not len(x) or not len(y):
                continue
            both = overlaps([sets[k] for k in x], [sets[k] for k in y])
            ok = (link[0] + link[1]) * both.astype(np.int64) >= link[1] * (n[x][:, None] + n[y])
            ok &= comp[x][:, None] != comp[y]
            p, q = np.nonzero(ok)
            out.extend(zip(x[p].tolist(), y[q].tolist(), strict=True)) if len(p) < 64 else out.extend(forest(x[p], y[q]))
        a, b = (rid[np.array(c, np.int64)] for c in (zip(*out, strict=True) if out else ((), ())))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return in_cells(cells, work, "a long, b long").distinct()


def forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of edges a-b those of a spanning forest."""
    up: dict[int, int] = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = x, y
        while up.get(p, p) != p:
            up[p] = p = up.get(up[p], up[p])
        while up.get(q, q) != q:
            up[q] = q = up.get(up[q], up[q])
        if p != q:
            up[q] = p
            yield x, y


def cells_of(at: DataFrame, dense: Column, shards: int) -> DataFrame:
    """Members in the cells (node, l, r) where they are compared. A small node is one; in a large and dense one, blocks of
    the sets outside of its largest component meet blocks of all its sets. Other nodes are left out."""
    rows = at.withColumn("by", F.xxhash64("rid"))
    small, large = rows.where(F.col("size") <= SMALL), rows.where((F.col("size") > SMALL) & dense)
    parts = [
        small.withColumns({"l": F.lit(0), "r": F.lit(0), "side": F.lit(ALL)}),
        large.where("comp <> largest").withColumns({"l": F.pmod("by", "ls"), "r": F.explode(F.sequence(F.lit(0), F.col("rs") - 1)), "side": F.lit(LEFT)}),
        large.withColumns({"l": F.explode(F.sequence(F.lit(0), F.col("ls") - 1)), "r": F.pmod("by", "rs"), "side": F.lit(RIGHT)}),
    ]
    cols = ["node", F.col("l").cast("int").alias("l"), F.col("r").cast("int").alias("r"), "rid", "comp", "n", "tokens", "side"]
    every = parts[0].select(*cols).union(parts[1].select(*cols)).union(parts[2].select(*cols))
    return every.withColumn("shard", F.pmod(F.xxhash64("node", "l", "r"), F.lit(shards)).cast("int"))


def open_cells(at: DataFrame, roots: int, link: tuple[int, int], shards: int) -> list[DataFrame]:
    """Cells that may hold links between components, from members (node, rid, comp, n, tokens) of all trees: small nodes
    and dense ones are looked at, other large ones branch."""
    out = []
    for level in range(1, DEPTH + 1):
        at = materialise(opened(at), "open")
        dense = F.lit(True) if level == DEPTH else 2 * F.col("share") >= F.col("size")
        sparse = (F.col("size") > SMALL) & ~dense
        held = at.agg(F.count("*").alias("m"), F.count_if(sparse).alias("sparse")).first()
        if not held.m:
            break
        tasks = max(shards, -(-held.m * (POSITIONS + 40) // TASK_BYTES))
        out.append(materialise(suspects(cells_of(at, dense, tasks), link), "suspects"))
        if not held.sparse:
            break
        # Written, as the nodes are counted first and then joined with their members.
        at = materialise(branched(at.where(sparse), roots, link), "children")
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int, shards: int) -> DataFrame:
    """(rid, shingles) of the sets `wanted` (rid, doc_id, set), found again in `docs` by doc_id and digest."""
    ids = id_set(wanted.select("doc_id"), shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, inv = np.unique(_keys(batch.column(0)), return_inverse=True)
            text = batch.column(1).filter(pa.array(ids.lookup(k)[0][inv])) if len(k) else batch.column(1)
            for s in slices(text):
                h, row = distinct(*shingles(s.hashes(), s.off, size))
                cuts = np.append(np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), len(h)).tolist() if len(h) else []
                data = [h[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.record_batch([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in data], pa.binary()), pa.array(data, pa.binary())], names=["set", "shingles"])

    again = docs.select("doc_id", "text").mapInArrow(run, "set binary, shingles binary")
    return materialise(again.join(wanted.select("rid", "set"), "set").select("rid", "shingles").dropDuplicates(["rid"]), "sets")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, link: tuple[int, int] = LINK, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    roots = root_positions(link, recall)
    rows = materialise(points(docs, size, roots), "points")
    same = rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("nodes").alias("nodes"))
    sets = materialise(same.withColumn("rid", F.monotonically_increasing_id()), "classes")
    members = materialise(first_nodes(sets), "nodes")
    held = members.groupBy("node").agg(F.count("*").alias("size"), F.min("rid").alias("head")).where("size > 1").select("node", "head")
    members = materialise(members.join(held, "node"), "members")
    own = sets.select("rid", "n", "tokens")
    root = spark.createDataFrame([], "node long, root long")
    whole, done = [], None

    def asked(ids: DataFrame) -> DataFrame:
        """The full sets that were asked for so far, with those of `ids`."""
        for known in whole:
            ids = ids.join(known.select("rid"), "rid", "left_anti")
        wanted = materialise(ids.join(sets.select("rid", "doc_id", "set"), "rid"), "asked")
        whole.append(whole_sets(docs, wanted, size, shards))
        return reduce(DataFrame.union, whole)

    def grown(new: DataFrame) -> DataFrame:
        return root if new.isEmpty() else components(new.union(root.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    for turn in (1, 2):
        if turn == 1:
            pairs = not_ruled_out(members.where("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct(), own, link)
        else:
            pairs = met_heads(in_components(members.select("node", "rid"), root), own, link).join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs, f"pairs{turn}")
        known = asked(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct())
        judged = materialise(verified(pairs, known, link), f"verified{turn}")
        done = judged.select("a", "b")
        root = grown(judged.where("linked").select("a", "b"))
    cells = open_cells(in_components(members.select("node", "rid"), root).join(own, "rid"), roots, link, shards)
    if cells:
        cells = reduce(DataFrame.union, cells)
        tasks = max(shards, -(-8 * (cells.agg(F.sum("n")).first()[0] or 0) // TASK_BYTES))
        dealt = cells.withColumn("shard", F.pmod(F.xxhash64("node", "l", "r"), F.lit(tasks)).cast("int"))
        root = grown(materialise(linked_in(dealt.join(asked(cells.select("rid").distinct()), "rid"), link), "linked"))
    in_class = sets.select("set", "rid", "doc_id").join(root.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    names = in_class.groupBy("root").agg(F.min("doc_id").alias("name"))
    out = rows.select("doc_id", "n", "set").join(in_class.join(names, "root").select("set", "name"), "set", "left")
    component = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_chosen_path_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
