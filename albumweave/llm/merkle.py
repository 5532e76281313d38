"""A Merkle manifest of a table: a leaf for each row, a tree for each source, and one tree over the sources' roots.

H is sha256 in lowercase hex; what it takes is joined without separators, digests as their hex text. A leaf is H of
doc_id, source, lang, n_chars and text, each as `-` if null, else as its length in UTF-8 bytes, `:` and its value. In a
tree, leaves stand in order of doc_id; as long as there are several nodes, each run of three consecutive ones becomes its
H, the last run as it is, even of one node: nothing is padded.

Rows are dealt by ranges of (source, doc_id), and each range numbers its leaves from a count of the ranges before it. The
leaves of a range are cut into chunks of bounded size. A chunk walks its leaves with a mountain range: a stack of peaks
from which a run is taken, as one carries in a base of three, as soon as its last member lies on top of all its others.
What is taken is a node record; what is left at the end, where the chunk's ends fall within runs, are its peaks, a few
for each level. Peaks of `FAN` neighbouring chunks are walked in the same way, and so on until a tree is one node. From
there the way back hands each peak the siblings that it meets outside of its chunk, down to the leaves' chunks, which
put the siblings of each leaf together from records of their own and from those. Neither a source nor a tree has to fit
into a task.

Rows of one doc_id stand in order of their leaves, a null doc_id after all others; equal rows are equal leaves, and
which of them comes first makes no difference. Null values are not empty ones. A row whose doc_id is null is not
tampered with. Texts of any length are hashed whole, by Spark. Further columns are ignored. An empty table gives an
empty result."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumweave.llm.common import materialise, table

#: Members of a run.
BASE = 3
#: Leaves of a chunk at most; neighbouring chunks, or groups of them, whose peaks meet in one task.
CHUNK, FAN = 1 << 15, 16
#: Columns of a leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(of: dict[str, Column] | None = None) -> Column:
    """H of the fields of a row, some of them replaced."""
    parts = []
    for name in FIELDS:
        value = (of or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def last_at(level: int, size: int) -> int:
    """The place of a level's last node in a tree of `size` leaves."""
    return -(-size // BASE**level) - 1


def depth(size: int) -> int:
    level = 0
    while last_at(level, size):
        level += 1
    return level


def mountains(nodes: list[tuple[int, int, str]], size: int) -> tuple[list[tuple[int, int, str]], dict[tuple[int, int], str]]:
    """(peaks, records) of consecutive nodes (level, place, hash) of a tree of `size` leaves: what no run could take, from
    left to right, and all nodes made of runs."""
    top = depth(size)
    peaks: list[tuple[int, int, str]] = []
    records: dict[tuple[int, int], str] = {}
    for node in nodes:
        peaks.append(node)
        while True:
            level, at, _ = peaks[-1]
            width = at % BASE + 1
            if level == top or width < BASE and at != last_at(level, size):
                break  # the root, or a run that goes on
            run = peaks[-width:]
            if len(run) < width or run[0][:2] != (level, at - width + 1):
                break  # it began before these nodes
            digest = h(*(x[2] for x in run))
            del peaks[-width:]
            peaks.append((level + 1, at // BASE, digest))
            records[level + 1, at // BASE] = digest
    return peaks, records


def numbered(rows: DataFrame, order: list[Column], chunk: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (tree, hash, ...) in order, with the chunk they lie in and their place in it, and the chunks (tree, chunk,
    part, start, size): the number of a chunk within its tree, its first leaf's, and how many leaves the tree has."""
    keys = ["tree", *(f"_k{i}" for i in range(len(order))), "_row"]
    rows = rows.withColumns({f"_k{i}": c for i, c in enumerate(order)} | {"_row": F.monotonically_increasing_id()})  # equal rows are many keys
    dealt = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).drop(*keys[1:])
    leaves = materialise(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("chunk", F.expr(f"row div {chunk}")), "leaves")
    counts = leaves.groupBy("tree", "chunk").agg(F.count("*").alias("n"), F.shiftright(F.min("row"), 33).alias("range"))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("tree", "range").agg(F.sum("n").alias("leaves"), F.count("*").alias("chunks")).select(
        "tree",
        "range",
        F.coalesce(F.sum("leaves").over(before), F.lit(0)).alias("leaves_before"),
        F.coalesce(F.sum("chunks").over(before), F.lit(0)).alias("chunks_before"),
        F.sum("leaves").over(Window.partitionBy("tree")).alias("size"),
    )
    own = Window.partitionBy("tree", "range").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = counts.join(ranges, ["tree", "range"]).select(
        "tree",
        "chunk",
        (F.col("chunks_before") + F.count("n").over(own)).alias("part"),
        (F.col("leaves_before") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("start"),
        "size",
    )
    return leaves, materialise(chunks, "chunks")


RAISED = "tree string, part long, size long, level int, at long, hash string, peak boolean"


def _raised(tree: str, part: int, size: int, nodes: list[tuple[int, int, str]]) -> pa.Table:
    """The records and the peaks of a group of nodes."""
    peaks, records = mountains(nodes, size)
    left = {x[:2] for x in peaks}
    out = [(lv, at, x, (lv, at) in left) for (lv, at), x in records.items()] + [(*x, True) for x in peaks if x[:2] not in records]
    columns = [[tree] * len(out), [part] * len(out), [size] * len(out), *map(list, zip(*out, strict=True))]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["tree", "part", "size", "level", "at", "hash", "peak"])


def _leaf_hashes(leaves: pa.Table) -> tuple[pa.Table, list[str]]:
    leaves = leaves.sort_by("row")
    return leaves, leaves.column("hash").to_pylist()


def _chunk_nodes(leaves: pa.Table, chunk: pa.Table) -> pa.Table:
    tree, part, start, size = (chunk.column(c)[0].as_py() for c in ("tree", "part", "start", "size"))
    return _raised(tree, part, size, [(0, start + k, x) for k, x in enumerate(_leaf_hashes(leaves)[1])])


def _merged(rows: pa.Table) -> pa.Table:
    """Peaks of neighbouring groups from left to right: by the first leaf under each."""
    tree, part, size = (rows.column(c)[0].as_py() for c in ("tree", "above", "size"))
    found = zip(*(rows.column(c).to_pylist() for c in ("level", "at", "hash")), strict=True)
    return _raised(tree, part, size, sorted(found, key=lambda x: x[1] * BASE ** x[0]))


def raised(leaves: DataFrame, chunks: DataFrame, fan: int) -> list[DataFrame]:
    """The node records and peaks (tree, part, size, level, at, hash, peak) of each round, the last one's peaks the roots."""
    base = leaves.select("tree", "chunk", "row", "hash").groupBy("tree", "chunk").cogroup(chunks.groupBy("tree", "chunk")).applyInArrow(_chunk_nodes, RAISED)
    rounds = [materialise(base, "nodes")]
    most = chunks.agg(F.max("part")).first()[0] or 0
    while most:
        most //= fan
        up = rounds[-1].where("peak").withColumn("above", F.expr(f"part div {fan}"))
        rounds.append(materialise(up.groupBy("tree", "above").applyInArrow(_merged, RAISED), "nodes"))
    return rounds


PATH = "array<struct<left:string,right:string>>"


def _paths(ends: list[list[tuple[str, str]]]) -> pa.Array:
    offsets, left, right = [0], [], []
    for steps in ends:
        for a, b in steps:
            left.append(a)
            right.append(b)
        offsets.append(len(left))
    steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)


class Climb:
    """Siblings from nodes of a group up to its tree's root: by the group's records, then by what its peaks were handed."""

    def __init__(self, rows: pa.Table, size: int) -> None:
        self.size = size
        self.known: dict[tuple[int, int], str] = {}
        self.records: set[tuple[int, int]] = set()
        self.steps: dict[tuple[int, int], list[tuple[str, str]]] = {}
        for kind, lv, at, digest, steps in zip(*(rows.column(c).to_pylist() for c in ("kind", "level", "at", "hash", "path")), strict=True):
            if kind == "end":
                self.steps[lv, at] = [(x["left"], x["right"]) for x in steps]
            else:
                self.known[lv, at] = digest
                if kind == "record":
                    self.records.add((lv, at))

    def siblings(self, level: int, at: int) -> tuple[str, str]:
        first = at - at % BASE
        last = min(first + BASE - 1, last_at(level, self.size))
        return "".join([self.known[level, x] for x in range(first, at)]), "".join([self.known[level, x] for x in range(at + 1, last + 1)])

    def path(self, level: int, at: int) -> list[tuple[str, str]]:
        found = self.steps.get((level, at))
        if found is None:
            found = [self.siblings(level, at), *self.path(level + 1, at // BASE)]
            if level:
                self.steps[level, at] = found
        return found


HANDED = f"tree string, part long, level int, at long, path {PATH}"


def _handed(rows: pa.Table) -> pa.Table:
    """What a group's records and its peaks' siblings give to each node that entered it."""
    climb = Climb(rows, rows.column("size").to_pylist()[0])
    own = [x for x in zip(*(rows.column(c).to_pylist() for c in ("kind", "tree", "part", "level", "at")), strict=True) if x[0] == "entered"]
    columns = [list(c) for c in zip(*own, strict=True)][1:]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)] + [_paths([climb.path(x[3], x[4]) for x in own])], names=["tree", "part", "level", "at", "path"])


def _leaf_paths(leaves: pa.Table, rows: pa.Table) -> pa.Table:
    chunk = next(x for x in rows.select(["kind", "start", "size"]).to_pylist() if x["kind"] == "chunk")
    climb = Climb(rows.filter(pa.array([x != "chunk" for x in rows.column("kind").to_pylist()])), chunk["size"])
    leaves, hashes = _leaf_hashes(leaves)
    places = range(chunk["start"], chunk["start"] + len(hashes))
    climb.known.update(((0, at), x) for at, x in zip(places, hashes, strict=True))
    return leaves.drop(["row", "chunk"]).append_column("path", _paths([climb.path(0, at) for at in places]))


def _part(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Rows of one kind, with all columns that a group of the way back has."""
    names = {"above": "long", "tree": "string", "part": "long", "size": "long", "start": "long", "level": "int", "at": "long", "hash": "string", "path": PATH}
    have = {c: F.col(c) for c in rows.columns} | columns
    return rows.select(F.lit(kind).alias("kind"), *(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in names.items()))


def proofs(leaves: DataFrame, chunks: DataFrame, rounds: list[DataFrame], ends: DataFrame, fan: int) -> DataFrame:
    """Leaves with `path`: the siblings to the left and right, level by level, to the root and on by the steps that
    `ends` (tree, path) has for each tree."""
    handed = rounds[-1].where("peak").select("tree", "part", "level", "at").join(ends.select("tree", "path"), "tree")
    for lower, upper in zip(rounds[-2::-1], rounds[:0:-1], strict=True):
        entered = _part(lower.where("peak"), "entered", above=F.expr(f"part div {fan}"))
        group = entered.union(_part(upper, "record", above=F.col("part"))).union(_part(handed, "end", above=F.col("part")))
        handed = materialise(group.groupBy("tree", "above").applyInArrow(_handed, HANDED), "handed")
    records = _part(rounds[0].where("level > 0"), "record")
    group = records.union(_part(handed, "end")).join(chunks.select("tree", "part", "chunk"), ["tree", "part"])
    group = group.unionByName(_part(chunks, "chunk").join(chunks.select("tree", "part", "chunk"), ["tree", "part"]))
    kept = [c for c in leaves.columns if c not in ("row", "chunk")]
    schema = ", ".join(f"`{c}` {t}" for c, t in leaves.select(*kept).dtypes) + f", path {PATH}"
    return leaves.groupBy("tree", "chunk").cogroup(group.groupBy("tree", "chunk")).applyInArrow(_leaf_paths, schema)


def manifest(docs: DataFrame, tampered: Column | None = None, chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """((doc_id, leaf, other, subroot, root, path) of each row, node records (source, level, at, hash)). `other` is a leaf
    to hold against the manifest, `tampered` where that is given and not null. `chunk` is a power of two."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = leaf()
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # null stands before all others
    rows = docs.select("doc_id", name.alias("tree"), own.alias("hash"), (F.lit(None).cast("string") if tampered is None else F.nullif(tampered, own)).alias("other"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash")]
    leaves, chunks = numbered(rows, order, chunk, shards)
    rounds = raised(leaves, chunks, fan)
    subroots = rounds[-1].where("peak").select("tree", "hash")
    tops, top_chunks = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), [F.col("name")], chunk, shards)
    top_rounds = raised(tops, top_chunks, fan)
    root = top_rounds[-1].where("peak").select("hash").first()
    nothing = docs.sparkSession.createDataFrame([("", [])], f"tree string, path {PATH}")
    above = materialise(proofs(tops, top_chunks, top_rounds, nothing, fan).select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), "path"), "subroots")
    found = proofs(leaves, chunks, rounds, above, fan).join(above.select("tree", "subroot"), "tree")
    out = found.select("doc_id", F.col("hash").alias("leaf"), F.coalesce("other", "hash").alias("other"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path")
    nodes = rounds[0].where("level > 0")
    for lower, upper in zip(rounds, rounds[1:], strict=False):
        nodes = nodes.union(upper.join(lower.where("peak").select("tree", "level", "at"), ["tree", "level", "at"], "left_anti").select(*upper.columns))
    source = F.when(F.col("tree") != "n", F.expr("substring(tree, 2)"))
    return out, nodes.select(source.alias("source"), "level", "at", "hash")


def refolded(start: Column) -> Column:
    """The root that a leaf gives with the siblings in `path`."""
    return F.aggregate("path", start, lambda x, step: F.sha2(F.concat(step["left"], x, step["right"]), 256))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even & F.contains("text", F.lit("\n")), leaf({"text": F.replace("text", F.lit("\n"), F.lit(""))}))
    out, _ = manifest(docs, tampered)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), refolded(F.col("other")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
