"""Every document operator on odd rows, against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import statistics
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from albumweave.llm import classifier, jaccard, mixing, packing, perplexity, pii, scoring
from albumweave.llm.components import components
from albumweave.llm.hash_arrays import discounts, narrow, widen
from tests.llm.conftest import DOCS, sentence

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def component_of(docs):
    """Row index to smallest doc_id reached, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        name[r] = d if name.get(r) is None else name[r] if d is None else min(d, name[r])
    return [(d, len(s), name[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_jaccard_on_odd_rows(documents):
    df, empty = documents
    assert rows_of(jaccard.classes(df), "doc_id", "n_shingles", "component_id") == sorted(component_of(plain(df)), key=repr)
    assert jaccard.classes(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_near_the_threshold(spark, seed):
    rng = random.Random(seed)
    docs = []
    for b in range(4):
        n = rng.choice([6, 30, 120, 1100])
        base = sentence(rng, n).split()
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(w)))
        docs.append((len(docs), " ".join(base[: n // 2] + sentence(rng, n // 2).split())))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(jaccard.classes(df), "doc_id", "n_shingles", "component_id") == sorted(component_of(docs), key=repr)


def test_jaccard_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = sentence(rng, 100).split()
    docs = []
    for i in range(400):
        w = list(base)
        w[i % 100] = f"own{i}"
        docs.append((i, " ".join(w)))
    out = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.component_id for r in out.collect()} == {0}


def test_jaccard_of_trees_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(11)
    docs = []
    for n in (40, 60):
        base = sentence(rng, n).split()
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(n)] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(w)))
    out = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == sorted(component_of(docs), key=repr)


def test_counts_of_points_stay_bytes_where_they_fit():
    """Four times as much memory as the vectors' own made a task of the last round too large."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (5, 63, 64, 200, 3000, 20_000)]
    for scale in (jaccard.COARSE, jaccard.FINE):
        made = [jaccard.vector(h, scale) for h in sets]
        got = jaccard.Points(np.array([len(h) for h in sets]), pa.chunked_array([[v.tobytes() for v in made]]), scale)
        for lv, (at, counts) in enumerate(zip(got.at, got.counts, strict=True)):
            groups = jaccard.GROUPS << lv
            for r, v in enumerate(made):
                if len(v) >= groups:
                    assert (counts[at[r]] == v.astype(np.int64).reshape(-1, groups).sum(0)).all()
            assert counts.itemsize == (1 if counts.max() < 256 else 4)
        assert got.counts[-1].itemsize == 1


def test_sets_are_handed_on_in_small_batches(spark, monkeypatch):
    """Batches of ten thousand texts' whole sets took a hundred megabytes on both sides of a worker."""
    batch = pa.record_batch([pa.array(range(10))], names=["a"])
    monkeypatch.setattr(jaccard, "HANDED", 4)
    assert [b.column(0).to_pylist() for b in jaccard.handed(iter([batch, batch.slice(0, 0), batch.slice(8)]))] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [8, 9]]
    docs = [(i, f"a{i % 3} b c d e f g h") for i in range(11)] + [(11, None), (12, "")]
    out = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == sorted(component_of(docs), key=repr)


def test_tasks_of_the_last_round_count_rows_of_split_trees_in_every_cell(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("1L AS tree", "id AS rid", "100L AS n")
    monkeypatch.setattr(jaccard, "BLOCK", 500)
    size = jaccard.ROW_BYTES + 200
    monkeypatch.setattr(jaccard, "TASK_BYTES", 4000 * size)
    assert jaccard.task_count(rows, 1) == 8 and jaccard.task_count(rows, 50) == 50 and jaccard.task_count(rows.limit(0), 3) == 3


def test_deduplication_keeps_one_row_of_each_group(documents):
    df, empty = documents
    out = jaccard.deduplicated(df)
    assert out.columns == [c for c in df.columns if c != "_row"]
    named = component_of(plain(df))
    groups = collections.Counter(c for _, n, c in named if n)
    got = collections.Counter(r.doc_id for r in out.collect())
    want = collections.Counter({c: 1 for c in groups}) + collections.Counter(d for d, n, _ in named if not n)
    assert got == want
    assert jaccard.deduplicated(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 180)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def levels(sizes):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, itertools.cycle([5.0, 2.0, 1.0])))
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {(None if k == 3 else f"s{k}"): rng.choice([0, 5, 50, 1000, 20000]) for k in range(rng.randint(1, 9))}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(levels(sizes))


def test_mixing(documents, spark):
    df, empty = documents
    out = mixing.mix(df.drop("_row")).collect()
    assert len(out) == df.count()
    sizes = collections.Counter()
    for r in df.select("source", "text").collect():
        sizes[r.source] += len(words(r.text))
    want = levels(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
    again = mixing.mix(df.drop("_row").repartition(3))
    assert rows_of(again, "doc_id", "size", "taken") == sorted(((r.doc_id, r["size"], r.taken) for r in out), key=repr)
    assert mixing.mix(empty).count() == 0
    # Many documents: words taken are near the targets, also of a hot source.
    rng = random.Random(4)
    many = spark.createDataFrame([(i, "w " * rng.randint(1, 200), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(6000)], "doc_id long, text string, source string")
    taken, goal = collections.Counter(), {}
    for r in mixing.mix(many).collect():
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 400 for s in goal)
    assert mixing.repeated(many).count() == sum(r.copies for r in mixing.mix(many).collect())


def test_packing(documents, tmp_path):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    df, empty = documents
    full = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    out = packing.packed(df).collect()
    want = collections.Counter()
    for d, t in plain(df):
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    filled = collections.defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(places)) and sum(places[-1]) <= 1024
    assert packing.packed(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_places_have_the_smallest_sum_of_squares(seed):
    """Every place against the sums that all choices would give, spelled out."""
    rng = random.Random(seed)
    cap = rng.choice([10, 23])
    n = np.array([rng.randint(1, cap) for _ in range(120)])
    seq, off = packing.sum_of_squares(n, cap)
    gaps = {}
    for i in sorted(range(len(n)), key=lambda i: (-n[i], i)):
        size = int(n[i])

        def after(gap):
            left = list(gaps.values())
            if gap < cap:
                left.remove(gap)
            count = collections.Counter([*left, gap - size])
            return sum(c * c for g, c in count.items() if g)

        gap = gaps.get(int(seq[i]), cap)
        choices = {g for g in gaps.values() if g >= size} | {cap}
        assert (after(gap), gap) == min((after(g), g) for g in choices) and off[i] == cap - gap
        gaps[int(seq[i])] = gap - size


@pytest.mark.parametrize("text", ["x" + " " * 2_000_000, "a" * 2_000_000, "\n" * 1_000_000, " \t" * 500_000 + "end"])
def test_long_runs_are_packed(spark, text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    out = packing.packed(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    ids = Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert sum(r.length for r in out) == len(ids) + 1 and sum(r.length < 1024 for r in out) <= 1


def test_quick_and_full_tokenizer_agree():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    encode, full = packing.encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    marks = ["'s", " ", "  ", "\n", "\t ", "é", "😀", "1234", "don't", "x", "ABC", "\u00a0", "\u2028", "<|", "|>", "<|endoftext|>", " " * 150, "word" * 300]
    for _ in range(300):
        t = "".join(rng.choice(marks) for _ in range(rng.randint(0, 40)))
        assert encode(t).tolist() == full.encode(t, add_special_tokens=False).ids


def test_packing_is_near_the_least():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 1025, 4000)
    seq, off = packing.sum_of_squares(n)
    assert len(set(seq.tolist())) <= 1.06 * math.ceil(n.sum() / 1024)


def base_of(text):
    w, t = words(text, lower=False), text or ""
    count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(documents):
    df, empty = documents
    out = perplexity.judge(df, ["doc_id"])
    want = []
    for d, t in plain(df):
        b = base_of(t)
        want.append((d, *b, b[0] < 10 or 100 * b[4] > 20 * b[0]))
    assert rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert out.where("base_failed AND kept").count() == 0
    assert perplexity.passed(df).columns == df.columns
    assert perplexity.judge(empty, ["doc_id"]).count() == 0


def test_byte_model_is_a_distribution(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([("en", sentence(rng, 50)) for _ in range(20)] + [(None, "other")] + [(f"x{i}", f"word {i}") for i in range(400)], "lang string, text string")
    model = perplexity.train(df)
    # "never" occurs in no text.
    for name, context in itertools.product(("en", None, "x7", "never"), (b"a b ", b"\n\n\n\n", b"zzzz", b"b\n\n\n")):
        lang = perplexity.lang_code(name)
        g = np.array([lang | int.from_bytes(context + bytes([c]), "big") for c in range(256)], np.int64)
        assert (10.0 ** model.log10(g)).sum() == pytest.approx(1, abs=1e-4)


def test_junk_is_rejected_and_clean_text_kept(spark):
    rng = random.Random(3)
    clean = [(i, sentence(rng, 120), "en") for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}%%{rng.choice('#*$&')}" for w in sentence(rng, 120).split()), "en") for i in range(6)]
    out = {r.doc_id: r.kept for r in perplexity.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert sum(out[i] for i in range(300)) >= 298 and not any(out[1000 + i] for i in range(6))


def test_both_bands_reject(spark):
    """Prose stays; nothing but the language's most frequent words is too easy to foretell, strewn marks too hard."""
    rng = random.Random(12)
    vocabulary = [sentence(rng, 1) + sentence(rng, 1) for _ in range(300)]
    prose = lambda: " ".join(rng.choices(vocabulary, [8] * 12 + [1] * 288, k=90))
    rows = [(i, prose(), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choices(vocabulary[:12], k=90)), "en") for i in range(3)]
    rows += [(2000 + i, " ".join("".join(rng.choice("#*$q1;Zx") for _ in range(7)) for _ in range(90)), "en") for i in range(3)]
    out = {r.doc_id: r for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert sum(out[i].kept for i in range(300)) >= 298
    assert all(out[1000 + i].level < out[1000 + i].lower and not out[1000 + i].kept for i in range(3))
    assert all(out[2000 + i].level > out[2000 + i].upper and not out[2000 + i].kept for i in range(3))


def kneser_ney(texts, order=5):
    """Interpolated modified Kneser-Ney over bytes, by its definition, in dictionaries: a function (context, byte) -> p."""
    grams = collections.Counter()
    for t in texts:
        b = b"\n" * (order - 1) + t.encode()
        grams.update(b[i : i + order] for i in range(len(b) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cut = {k: discounts([sum(n == i for n in c.values()) for i in range(1, 5)]) for k, c in counts.items()}

    def p(context, byte, k=order):
        if k == 0:
            return 1 / 256
        context = context[len(context) - k + 1 :] if k > 1 else b""
        own = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not own:
            return p(context, byte, k - 1)
        total = sum(own.values())
        n = own.get(context + bytes([byte]), 0)
        left = sum(cut[k][min(x, 3)] for x in own.values())
        return (max(n - cut[k][min(n, 3)], 0) + left * p(context, byte, k - 1)) / total

    return p


def test_byte_model_equals_its_definition(spark):
    rng = random.Random(6)
    texts = [sentence(rng, 12) for _ in range(12)]
    model = perplexity.train(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    p, lang = kneser_ney(texts), perplexity.lang_code("en")
    for probe in (texts[0].encode()[:30], b"abcab zq", "é ab".encode(), b"\xff\xfe a"):
        padded = b"\n\n\n\n" + probe
        for i in range(len(probe)):
            g = np.array([lang | int.from_bytes(padded[i : i + 5], "big")], np.int64)
            assert model.log10(g)[0] == pytest.approx(math.log10(p(padded[i : i + 4], padded[i + 4])), abs=2e-4), padded[i : i + 5]


def test_group_of_near_copies_weighs_as_one_text(spark):
    rng = random.Random(5)
    vocabulary = [sentence(rng, 1) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).split()
    base = prose(90)
    near = []
    for _ in range(300):
        w = list(base)
        w[rng.randrange(90)] = rng.choice(vocabulary)
        near.append(" ".join(w))
    texts = [" ".join(prose(rng.randint(70, 120))) for _ in range(100)] + near
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    out = {r.doc_id: r.kept for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert sum(out[i] for i in range(100)) >= 98  # clean neighbours
    assert all(out[100 + i] for i in range(300))


def test_bands_of_small_cells_are_wide_and_change_smoothly(spark):
    normal = statistics.NormalDist()
    levels = lambda n, center, spread: [center + spread * normal.inv_cdf((i + 0.5) / n) for i in range(n)]
    long, uppers = [("en", 9, x) for x in levels(2000, 1.0, 0.02)], {}
    for n in (1, 5, 12, 39, 41, 300):
        short = levels(n, 1.2, 0.25)
        rows = spark.createDataFrame(long + [("en", 3, x) for x in short] + [("en", 4, 9.0)], "lang string, size_class int, level double")
        out = {r.of_size: r for r in perplexity.bands(rows.selectExpr("*", "false AS base_failed", "true AS _first")).collect()}
        assert out[3].lower < min(short) and max(short) < out[3].upper < 4
        assert out[9].upper < 1.5 and out[4].upper < 9  # a lone text far off is no cell's measure
        uppers[n] = out[3].upper
    assert abs(uppers[39] - uppers[41]) < 0.1


def test_scores(documents):
    df, empty = documents
    docs = df.select("doc_id", "text", (scoring.fold() % 10 == 0).alias("held_out"))
    out = scoring.score(docs, scoring.train(docs.where("NOT held_out").select("text"))).collect()
    rows = [(r.doc_id, words(r.text), r.held_out) for r in docs.collect()]
    assert all(h == (zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0) for d, _, h in rows)
    count, pair = collections.Counter(), collections.Counter()
    for _, w, h in rows:
        if not h:
            count.update([*w, None])
            pair.update(zip([0, *w], [*w, None], strict=True))
    n, v = sum(count.values()), len(count)
    context, kinds, ends = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (a, b), c in pair.items():
        context[a] += c
        kinds[a][min(c, 3)] += 1
        ends[b] += 1
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    dp, dw = discounts(of(pair)), discounts(of(ends))
    spread = sum(dw[min(c, 3)] for c in ends.values())

    def low(b):
        return (max(ends[b] - dw[min(ends[b], 3)], 0) + spread / (v + 1)) / sum(ends.values())

    def model(a, b):
        if not context[a]:
            return low(b)
        c = pair[a, b]
        return (max(c - dp[min(c, 3)], 0) + sum(kinds[a][k] * dp[k] for k in (1, 2, 3)) * low(b)) / context[a]

    want = []
    for d, w, h in rows:
        t = [*w, None]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        want.append((d, h, len(t), sum(count[x] > 0 for x in t), n, round(base, 6), round(sum(math.log10(model(a, b)) for a, b in zip([0, *w], t, strict=True)), 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert math.isclose(sum(model("w", b) for b in [*count, "never seen"]), 1)
    none = empty.select("doc_id", "text", F.lit(False).alias("held_out"))
    assert scoring.score(none, scoring.train(none.select("text"))).count() == 0


def test_classifier(documents, spark):
    df, empty = documents
    rng = random.Random(5)
    docs = [(i, sentence(rng, 40) if i % 3 else " ".join(w + "!!" for w in sentence(rng, 40).split())) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i % 3 > 0)) for i in range(600)] + [(1, None), (None, 1.0), (2, 1.0)], "doc_id long, label double")
    w = classifier.train(classifier.sample(table, labels))
    got = {r.doc_id: r.score for r in classifier.scores(table, w).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in held)
    odd = classifier.scores(df, w).collect()
    assert len(odd) == df.count() and all(0 <= r.score <= 1 for r in odd)
    assert classifier.scores(empty, w).count() == 0
    unlearned = classifier.train(classifier.sample(table, labels.limit(0)))
    assert {r.score for r in classifier.scores(table.limit(3), unlearned).collect()} == {0.5}
    assert classifier.sample(table, labels, 100).count() < 200


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PERSONAL = [
    "a.b+c@d-e.fg.hi, x%y@z.q%r@s.t and @no.body no@dot a@b..c a@b.c@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 9.9.9.99999999999999999999 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111111111111111 4111111111111111",
    "+1 (555) 555-1234 +1234567 +123456789012345 +1234567890123456 ++4 4) 12.34.56 78 +1()-() é+49 30 1234567é",
    "1" * 3000 + " " + "a." * 2000 + "@x.y " + "1 " * 3000,
    "name (at) site [dot] org, tel 555 123 4567, card 4111.1111.1111.1111",
]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]():  # noqa: B023
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(documents, spark):
    df, empty = documents
    more = spark.createDataFrame([(100 + i, "é😀 " + t, "en", "s", 1) for i, t in enumerate(PERSONAL)], DOCS)
    out = {r.doc_id: r for r in pii.find(df.unionByName(more, allowMissingColumns=True)).collect()}
    for d, t in plain(df) + plain(more):
        b = base_spans(t)
        assert out[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest(), (d, b, out[d].spans)
        assert [out[d][f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in b) for k in PATTERNS]
        assert {f"{k}:{s}:{e}" for k, s, e in b} <= set(out[d].spans.split(",")) | {""}
    assert pii.find(empty).count() == 0


def test_spelled_out_mails_and_cued_numbers_are_added(spark):
    forms = {
        "strict": ("mail anna{0}@site.org or +1 555 {0} 4567 now", None),
        "mail": ("ask ben{0} (at) site [dot] org soon", ("email", "ben{0} (at) site [dot] org")),
        "cued": ("tel 555 {0} 4567 today", ("phone", "555 {0} 4567")),
        "plain": ("order 555 {0} 4567 shipped", None),
        "run": ("number 99{0}12345 of the list", None),
    }
    rows, want = [], {}
    for i in range(200):
        for form, (t, span) in forms.items():
            rows.append((len(rows), t.format(100 + i)))
            x = span and span[1].format(100 + i)
            want[len(rows) - 1] = form, x and f"{span[0]}:{rows[-1][1].index(x)}:{rows[-1][1].index(x) + len(x)}"
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        form, span = want[r.doc_id]
        if form != "strict":
            assert r.spans == (span or ""), (rows[r.doc_id], r.spans)


CARDS = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424"]


def test_loose_forms_without_cue_words_are_added_and_plain_numbers_are_not(spark):
    """The trees learn from strict spans alone, which stand in other words here; one form of each kind is never seen."""
    dotted = lambda d, m: m.join(d[k : k + 4] for k in range(0, 16, 4))
    strict = ["write anna{0}@site.org please", "reached at 10.2.{0}.7 again", "paid {1} then", "number +49 30 {0} 4567 here"]
    loose = {
        "email": ("saw ben{0} at site dot org there", "ben{0} at site dot org"),
        "email2": ("saw ben{0} (at) site [dot] org there", "ben{0} (at) site [dot] org"),
        "ip": ("saw 10,2,{0},7 there", "10,2,{0},7"),
        "ip2": ("saw 10 . 2 . {0} . 7 there", "10 . 2 . {0} . 7"),
        "card": ("saw {2} there", "{2}"),
        "card2": ("saw {3} there", "{3}"),
        "phone": ("saw 0049 30 {0} 4567 there", "0049 30 {0} 4567"),
    }
    plain_ = ["contact list entry 2023 1105 0{0} ref", "saw 999,2,{0},7 there", "saw {4} there", "order 555 {0} 4567 shipped", "meet at noon then"]
    rows, want = [], {}
    for i in range(100):
        c = CARDS[i % 4]
        fill = (100 + i, c, dotted(c, "."), dotted(c, "_"), dotted(c[:-1] + str((int(c[-1]) + 1) % 10), "."))
        for t in strict:
            rows.append((len(rows), t.format(*fill)))
        for kind, (t, x) in loose.items():
            text, x = t.format(*fill), x.format(*fill)
            want[len(rows)] = f"{kind.strip('2')}:{text.index(x)}:{text.index(x) + len(x)}"
            rows.append((len(rows), text))
        for t in plain_:
            want[len(rows)] = ""
            rows.append((len(rows), t.format(*fill)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [(rows[d][1], out[d], x) for d, x in want.items() if out[d] != x] == []
    # The same, however the rows lie.
    assert {r.doc_id: r.spans for r in pii.find(df.orderBy(F.desc("doc_id")).repartition(7)).collect()} == out


def test_many_spans_in_one_text(spark):
    """Twenty thousand spans of two kinds: found, and replaced, in a pass over the text."""
    df = spark.createDataFrame([(1, "é a@b.cd, 10.2.3.4 " * 10_000)], "doc_id long, text string")
    r = pii.find(df).first()
    want = ",".join([*(f"email:{19 * i + 2}:{19 * i + 8}" for i in range(10_000)), *(f"ip:{19 * i + 10}:{19 * i + 18}" for i in range(10_000))])
    assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert pii.redact(df).first().text == "é [EMAIL], [IP] " * 10_000


def test_overlapping_spans_become_one(spark):
    spans = spark.createDataFrame([(1, "phone", 5, 9), (1, "card", 2, 7), (1, "ip", 9, 12), (1, "email", 3, 4), (2, "ip", 0, 1)], "rid long, kind string, s int, e int")
    assert {(r.rid, tuple((m.s, m.e, m.kind) for m in r.marks)) for r in pii.joined(spans).collect()} == {(1, ((2, 9, "card"), (9, 12, "ip"))), (2, ((0, 1, "ip"),))}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a@b.cd or 1.2.3.4!", 25), (2, None, 0), (3, "nothing", 7)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: ("é mail [EMAIL] or [IP]!", 23), 2: (None, None), 3: ("nothing", 7)}


def test_narrow_numbers():
    x = np.array([0, 1, 2**40 - 1, 2**33], np.uint64)
    assert widen(narrow(x, 5), 5).tolist() == x.tolist()
