import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from albumweave.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """(root, siblings of each leaf to the left and right, level by level)."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            a = i - i % 3
            steps[k].append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        level, at = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], steps


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf(r)))
        done[s] = own, *tree([leaf(r) for r in own])
    root, top = tree([done[s][1] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        own, subroot, steps = done[s]
        for r, path in zip(own, steps, strict=True):
            path = path + top[k]
            bad = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            fold = leaf(r, r["text"].replace("\n", "")) if bad else leaf(r)
            for a, b in path:
                fold = h(a, fold, b)
            out[r["doc_id"], leaf(r), subroot, root, h(*(a + b for a, b in path)), fold, fold == root] += 1
    return out


def found(spark, df, tmp_path, monkeypatch, chunk, fan):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, chunk, fan))
    return Counter(tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("chunk, fan", [(1, 2), (4, 2), (1 << 15, 16)])
def test_odd_rows_equal_plain_recursion(spark, documents, tmp_path, monkeypatch, chunk, fan):
    df, _ = documents
    rows = [r.asDict() for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert found(spark, df, tmp_path, monkeypatch, chunk, fan) == brute(rows)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [100], [27, 28, 1, 9, 3, 2, 4]])
def test_sizes_of_trees_in_unaligned_chunks(spark, tmp_path, monkeypatch, sizes):
    rows, n = [], 0
    for s, m in enumerate(sizes):
        rows += [(n + i, f"t{i}\nx" if i % 3 else None, "en", f"s{s}", i) for i in range(m)]
        n += m
    df = spark.createDataFrame(rows, DOCS)
    out = found(spark, df, tmp_path, monkeypatch, 2, 2)
    assert out == brute([dict(zip(df.columns, r, strict=True)) for r in rows])


def test_one_id_on_all_rows(spark, tmp_path, monkeypatch):
    rows = [(7, "same\n", "en", "s", 5)] * 50 + [(7, "other", "en", "s", 5)]
    df = spark.createDataFrame(rows, DOCS)
    assert found(spark, df, tmp_path, monkeypatch, 4, 2) == brute([dict(zip(df.columns, r, strict=True)) for r in rows])


def test_empty_table(spark, documents, tmp_path, monkeypatch):
    assert not found(spark, documents[1], tmp_path, monkeypatch, 4, 2)


def test_node_records_are_all_nodes(spark):
    rows = [(i, f"t{i}", "en", "s" if i < 40 else None, i) for i in range(50)]
    df = spark.createDataFrame(rows, DOCS)
    out, nodes = merkle.manifest(df, chunk=4, fan=2)
    got = {(r.source, r.level, r.at): r.hash for r in nodes.collect()}
    assert len(got) == nodes.count()
    for source, part in (("s", rows[:40]), (None, rows[40:])):
        level, k = [leaf(dict(zip(df.columns, r, strict=True))) for r in part], 0
        while len(level) > 1:
            level, k = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], k + 1
            assert [got.pop((source, k, i)) for i in range(len(level))] == level
    assert not got
    assert out.where(merkle.refolded(F.col("leaf")) != F.col("root")).isEmpty()
