import random

import pytest

ODD = ["n", "size", "rid", "_row", "copies", "set", "vector", "shard", "base", "added", "kind", "features", "level", "kept", "score", "label", "payload", "row", "digest", "root", "asks"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("ab cdeé".replace(" ", "")) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Odd texts: null, empty, blank, short, long, repeated, near copies, marks, unusual code points."""
    rng = random.Random(1)
    base = [sentence(rng, 60) for _ in range(8)]
    near = [" ".join(w if k % 31 else "zz" for k, w in enumerate(b.split())) for b in base[:4]]
    odd = [None, "", "   \n\t ", "One", "one", "a b c d", "a b c d e", "x" * 3000, sentence(rng, 3000), "the cat\x1fsat   on the mat 😀 <|endoftext|> ok", "A\nA\nB\nA\n\n", "w " * 200]
    return odd + base + base[:3] + near


@pytest.fixture()
def documents(spark, texts):
    """(table, empty table): the odd texts with null ids and sources, whole rows repeated, and clashing column names."""
    rows = [(i, t, None if i % 7 == 3 else "en" if i % 2 else "fr", None if i % 5 == 4 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "a null id here a null id", "en", "s1", 23), rows[8], rows[12], rows[12]]
    df = spark.createDataFrame(rows, DOCS)
    for name in ODD:
        df = df.selectExpr("*", f"'{name}' AS `{name}`")
    return df, df.limit(0)
