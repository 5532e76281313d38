"""The pipeline as a whole and its stages, on odd rows, against what each must keep."""

import collections
import itertools
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from albumweave.llm import mixing
from tests.llm.conftest import DOCS, sentence
from tests.llm.test_documents import base_of, base_spans, component_of, plain, words


def test_stages_on_odd_rows(spark, documents):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    odd, empty = documents
    rng = random.Random(8)
    prose = [sentence(rng, 60) for _ in range(60)]
    more = [(500 + i, t + (f" write to x{i}@mail.org or 10.1.2.{i}" if i % 4 == 0 else ""), "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    more += [(700 + i, prose[i], "en", "s1", 1) for i in range(5)]
    docs = odd.unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True)
    stage = dict(corpus_pipeline.STAGES)
    for name in list(stage)[:-1]:
        before = plain(docs)
        out = stage[name](spark, docs, "")
        assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(out.toPandas().astype(object).where(lambda x: x.notna(), None), out.schema)
        after = plain(docs)
        had, has = (collections.Counter(repr(x) for x in rows) for rows in (before, after))
        if name == "quality_rules":
            assert not has - had
            failed = [t for _, t in before if (b := base_of(t))[0] < 10 or 100 * b[4] > 20 * b[0]]
            assert not {t for _, t in after} & set(failed) and len(after) >= 55
        elif name == "near_duplicates":
            named = component_of(before)
            groups = collections.Counter(c for _, n, c in named if n)
            assert collections.Counter(d for d, _ in after) == collections.Counter(groups.keys())
        elif name == "personal_data":
            text = dict(before)
            for d, t in after:
                spans = base_spans(text[d])
                assert (t == text[d]) == (not spans) or "[" in t
                assert not base_spans(t) and all(text[d][s:e] not in t for _, s, e in spans)
                kept = re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", t)
                assert all(x in text[d] for x in kept)
        else:
            sizes = {d: len(words(t)) for d, t in before}
            n = collections.Counter(d for d, _ in after)
            assert all(k <= 2 and d in sizes for d, k in n.items()) and not set(has) - set(had)
            assert abs(sum(sizes[d] * k for d, k in n.items()) - 1.5 * sum(sizes.values())) <= 3 * max(sizes.values())
    full = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, t in plain(docs):
        ids = np.array([*full.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    out = stage["packed_sequences"](spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want


def test_empty_table_and_other_queries_are_left_alone(spark, documents):
    _, empty = documents
    other = mixing.mix(spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string"))
    assert corpus_pipeline.applied(spark, empty).count() == 0
    assert other.collect()[0].doc_id == 1
