import itertools
import random

import numpy as np
import pytest

from albumweave.llm import chosen_path
from tests.llm.conftest import sentence
from tests.llm.test_documents import plain, rows_of, shingle_set

NAMES = ("doc_id", "n_shingles", "component_id", "kept")


def component_of(docs):
    """The same by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        name[r] = d if name.get(r) is None else name[r] if d is None else min(d, name[r])
    out = [(d, len(s), name[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
    return sorted([(*x, x[0] == x[2]) for x in out], key=repr)


def found(df):
    return rows_of(chosen_path.near_duplicates(df), *NAMES)


def varied(rng, sizes, copies, edits):
    """Copies of a few texts with words replaced, and half copies."""
    docs = []
    for n in sizes:
        base = sentence(rng, n).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // edits))):
                w[rng.randrange(n)] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(w)))
        docs.append((len(docs), " ".join(base[: n // 2] + sentence(rng, n // 2).split())))
    return docs


def test_odd_rows(documents):
    df, empty = documents
    assert found(df) == component_of(plain(df))
    assert chosen_path.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_near_the_threshold(spark, seed):
    docs = varied(random.Random(seed), [6, 30, 120, 900], 14, 40)
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == component_of(docs)


def test_branches_and_blocks(spark, monkeypatch):
    """Nodes of a few sets are large here: they branch, dense ones are compared in blocks."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(chosen_path, "COLUMNS", 7)
    monkeypatch.setattr(chosen_path, "HEADS", 1)
    monkeypatch.setattr(chosen_path, "NEXT", 0)
    rng = random.Random(5)
    docs = varied(rng, [60, 80], 40, 25)
    passage = sentence(rng, 40)
    docs += [(1000 + i, f"{passage} {sentence(rng, 30)}") for i in range(60)]  # a passage in common, but no link
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == component_of(docs)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = sentence(rng, 100).split()
    docs = [(i, " ".join(base[: i % 100] + [f"own{i}"] + base[i % 100 + 1 :])) for i in range(400)]
    assert {r[2] for r in found(spark.createDataFrame(docs, "doc_id long, text string"))} == {0}


def test_recall_of_pairs_at_the_threshold(spark):
    """1,000 pairs of 100 shingles that have 92 in common: 92 / 108 is just over the threshold; as many just under."""
    docs = []
    for k in range(1000):
        for link, own in ((0, 8), (1, 9)):
            a = [f"w{k}_{link}_{i}" for i in range(104)]
            b = a[: 104 - own] + [f"v{k}_{link}_{i}" for i in range(own)]
            docs += [(4 * k + 2 * link, " ".join(a)), (4 * k + 2 * link + 1, " ".join(b))]
    out = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    linked = {r[0] for r in out if not r[3]}
    assert len([d for d in linked if d % 4 == 1]) >= 999 and not [d for d in linked if d % 4 != 1]


def test_reckoned_recall():
    rng = np.random.default_rng(7)
    trees = chosen_path.trees_for(0.85)
    stay = chosen_path.survival(0.85, 4)
    assert (1 - stay) ** trees <= 1 - chosen_path.RECALL < (1 - stay) ** (trees - 1)
    n = np.ones(200_000, np.int64)  # nodes that a pair shares, level by level
    for _ in range(4):
        picks = n + rng.binomial(n, 1 / 0.85 - 1)
        n = rng.binomial(picks, 0.85)
    assert abs((n > 0).mean() - stay) < 0.005


def test_heads_are_met_in_tasks(spark):
    """Only pairs that tokens and sizes leave open come out of a large node's task."""
    rng = random.Random(4)
    base = [bytes(rng.randrange(256) for _ in range(chosen_path.POSITIONS)) for _ in range(3)]
    own = [(i, 100 if i % 7 else 300, base[i % 3]) for i in range(400)]
    at = [(1, i, i if i >= 100 else 0) for i in range(400)] + [(2, i, i) for i in range(9)]
    of = {rid: comp for node, rid, comp in at if node == 1}
    own_, at_ = spark.createDataFrame(own, "rid long, n long, tokens binary"), spark.createDataFrame(at, "node long, rid long, comp long")
    out = chosen_path.met_heads(at_, own_, (100, 85))
    got = {(r.a, r.b) for r in out.collect()}
    heads = {x.rid: x.comp for x in at_.where("node = 1").collect() if x.comp in range(100, 100 + chosen_path.NEXT)}
    slots = chosen_path.parts_of(at_.where("node = 1 AND comp = 0")).first().heads
    heads |= dict.fromkeys(slots, 0)
    want = {(min(a, h), max(a, h)) for a in range(100, 400) for h, c in heads.items() if of[a] != c and own[a][1] == own[h][1] and a % 3 == h % 3}
    assert got == want and want


def test_nodes_branch_once(spark, monkeypatch):
    """A member of a large node is put into its children once, not again for each use of them."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    made, frames, original = spark.sparkContext.accumulator(0), [], chosen_path.branched

    def branched(*args):
        frames.append(original(*args))

        def counted(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return frames[-1].mapInArrow(counted, frames[-1].schema)

    monkeypatch.setattr(chosen_path, "branched", branched)
    rng = random.Random(6)
    passage = sentence(rng, 60)
    docs = [(i, f"{passage} {sentence(rng, 30)}") for i in range(80)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == component_of(docs)
    assert made.value == sum(f.count() for f in frames) > 0
