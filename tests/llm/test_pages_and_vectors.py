import base64
import collections
import hashlib
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from albumweave.llm import html, knn, warc
from albumweave.llm.common import get, new_folder

PAGES = [
    (1, "http://a", "<p>one</p>" * 40),
    (2, None, "<p>one</p>" * 40),
    (3, "http://b\r\nX: y%0D", "é" * 5000),
    (4, "u", None),
    (5, "u", ""),
    (3, "u", "<p>one</p>" * 40),
    (2, "u", "<p>one</p>" * 40),
    (None, "u", "other"),
    (None, "u", "other"),
]
SCHEMA = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "'x' AS payload", "1 AS row", "'y' AS digest")
    out = warc.round_trip(spark, df).collect()
    data = lambda h: (h or "").encode()
    first = {}
    for i, _, h in PAGES:
        first[data(h)] = min(first.get(data(h), float("inf")), i if i is not None else float("inf"))
    seen = collections.Counter()
    for r in out:
        h = next(data(h) for i, _, h in PAGES if base64.b32encode(hashlib.sha1(data(h)).digest()).decode() == r.payload_digest)
        assert r.payload_bytes == len(h)
        seen[h, r.record_type] += 1
        if r.record_type == "response":
            assert r.payload == h and r.refers_to is None and r.page_id == (None if first[h] == float("inf") else first[h])
        else:
            assert r.refers_to == (None if first[h] == float("inf") else first[h])
    assert collections.Counter((r.page_id, r.url) for r in out) == collections.Counter((i, u) for i, u, _ in PAGES)
    assert all(seen[h, "response"] == 1 for h in first)
    assert warc.round_trip(spark, df.limit(0)).count() == 0
    assert warc.round_trip(spark, df, least=10**6).where("record_type = 'revisit'").count() == 0


def test_archive_files(spark):
    many = spark.range(300).selectExpr("id AS page_id", "concat('http://s/', id) AS url", "concat('<html>', repeat(cast(id % 250 AS string), 40), '</html>') AS html").coalesce(1)
    folder = new_folder(spark, "t")
    files = warc.write(many, folder).collect()
    assert sum(f.records for f in files) == 300
    raw = get(max(files, key=lambda f: f.records).archive)
    magic, size = struct.unpack_from("<II", raw)
    assert 0x184D2A50 <= magic <= 0x184D2A5F and size > 0
    dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(raw[8 + size :])
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: ") and one.endswith(b"\r\n\r\n")
    assert [warc.parse(x)["page_id"] is not None for x in warc.frames(raw)].count(True) == max(f.records for f in files)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(raw[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(b"xxxx" + raw))
    good = next(warc.frames(raw))
    for bad in (good.replace(b"WARC/1.1", b"WARC/0.9"), good[:-1], good.replace(b"<html>", b"<htmx>"), good.replace(b"WARC-Date", b"X-Date", 1), good.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)


ARTICLE = "<article><h1>Title here</h1><p><b>First &amp; bold<br><p>Second  line\n of text, with <a href=x>a link</a> in it.<p>Third &lt;line&gt; &eacute;&#233; of text.</article>"
WANT = "Title here\nFirst & bold\nSecond line of text, with a link in it.\nThird <line> éé of text."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=a>Home</a><li><a href=b>More</a></ul></nav>{ARTICLE}<footer>&copy; me and more words here</footer></body></html>",
        f"<body><div class='ad'>Buy a lot of things now, a long text without any tags in it at all, for you.</div><script>var x='</p>';</script>{ARTICLE}<!-- <p>no</p> --><aside>side text</aside>",
        f"<div id=top-menu>menu</div><form><p>Your name</p></form>{ARTICLE}<div class='user-comments'><p>I like this text so much that I say it at length.</p></div><p hidden>secret",
        f"<div class=cookie-notice>We use cookies, many of them, and we say so at length.</div><main>{ARTICLE}</main><div role=contentinfo>about</div><p clas",
    ],
)
def test_main_text(page):
    assert html.main_text(page) == WANT


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "plain text"), (4, "u", "<script>x"), (None, "u", "<p>a<p>b &am"), (5, "u", "a < b <3 <p>c" * 2000), (5, "u", "<div>" * 3000 + "deep")], SCHEMA).selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {(r.page_id, r.n_chars): r.text for r in html.extract(df).collect()}
    assert got[1, 0] == got[2, 0] == got[4, 0] == "" and got[3, 10] == "plain text" and got[None, 7] == "a\nb &am" and got[5, 4] == "deep"
    assert all(len(t) == n for (_, n), t in got.items())
    assert html.extract(df.limit(0)).count() == 0


def brute(rows, k=5):
    m = {}
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in ok:
        if i % 50 == 0:
            best = sorted(((-int(q @ x), j) for j, x in ok if j != i))[:k]
            m[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return m


@pytest.mark.parametrize("size", [0, 3, 700])
def test_top_k(spark, size):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=16) * 0.05]) for i in range(size)]
    if size > 100:
        rows[101] = (101, rows[100][1])
        rows[103] = (103, rows[101][1])
        rows[5], rows[6], rows[7] = (5, None), (6, [float("nan")] + [0.0] * 15), (7, [None] + [1.0] * 15)
        rows += [(200, rows[200][1]), (300, [5000.0] * 16), (None, [1.0] * 16)]
        rows[300] = rows[-2]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS cell", "3 AS score")
    got = collections.defaultdict(list)
    for r in knn.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in brute(rows).items() if v}


def test_top_k_of_a_query_repeated_in_a_tight_group(spark):
    rows = [(0, [10.0, 0.0])] * 20 + [(i, [1.0, i / 10]) for i in range(1, 31)] + [(i, [2.0, i / 10]) for i in range(31, 36)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, k + 1, 31 + k) for k in range(5)]


def test_search_visits_only_groups_that_can_matter(spark):
    """Tight, well separated groups: queries go to few of them beyond their own, and the result is exact."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 20
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + rng.normal(size=8) * 0.2]) for i in range(2000)]
    out, visits = knn.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == brute(rows)
    homes = len({i % 40 for i in range(0, 2000, 50)})
    assert visits.count() < 0.6 * homes * 44


def test_bounds_hold():
    """Every true score lies under its group's bound, and the k-th true score over the promised one."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 6)) * 50 + rng.normal(size=(8, 6))[np.arange(400) % 8] * 300).astype(np.int64)
    p = x[:12].astype(np.float64)
    d = np.sqrt(((x[:, None] - p) ** 2).sum(2))
    cell = d.argmin(1)
    far = d[np.arange(400), cell]
    Row = collections.namedtuple("Row", "cell near far norm n own")
    g = knn.Groups(p, [Row(c, far[cell == c].min(), far[cell == c].max(), np.sqrt((x[cell == c] ** 2).sum(1)).max(), int((cell == c).sum()), 0) for c in set(cell.tolist())])
    for home in range(12):
        q = x[cell == home]
        high, least = g.bounds(q, home, 5)
        s = q @ x.T
        assert all((s[:, cell == c] <= high[:, [c]]).all() for c in set(cell.tolist()))
        assert (np.sort(s, 1)[:, -5] >= least).all()


def density_by_hand(page):
    """Composite text density of every element, from its definition, on trees written as (tag, children)."""
    out = []

    def count(node):
        if isinstance(node, str):
            return len("".join(node.split())), 0, 0, 0
        c = t = lc = lt = 0
        for x in node[1]:
            a, b, d, e = count(x)
            inside = not isinstance(x, str)
            c, t, lc, lt = c + a, t + b + inside, lc + d, lt + e
        return (c, t, c, t + 1) if node[0] == "a" else (c, t, lc, lt)

    total = count(page)

    def walk(node):
        c, t, lc, lt = count(node)
        t, lc1, lt1 = max(t, 1), max(lc, 1), max(lt, 1)
        base = np.log(c / max(c - lc, 1) * lc + total[2] / max(total[0], 1) * c + np.e) if c else 1.0
        own = c / t * np.log(max(c / lc1 * t / lt1, 1.0)) / np.log(max(base, 1.0) + 1.0) if c else 0.0
        kids = [walk(x) for x in node[1] if not isinstance(x, str)]
        out.append((node[0], own, sum(d for tag, d in kids if tag not in html.INLINE)))
        return node[0], own

    walk(page)
    return out


def markup(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(markup, node[1]))}</{node[0]}>"


def test_densities_equal_their_definition():
    words = "some words of plain text in a row that goes on "
    links = ("ul", [("li", [("a", ["one link"])]), ("li", [("a", ["another link"])])])
    page = ("body", [links, ("div", ["An advert without any link."]), ("div", [("h2", ["Head"]), ("p", [words * 3, ("b", ["bold"])]), ("p", [words * 2, ("a", ["a link"])]), ("section", [("p", [words * 4])])]), ("div", [words])])
    nodes = html.in_order(html.parse(markup(page)[6:-7]))
    html.measure(nodes)
    got = sorted((x.tag, round(x.density, 9), round(x.sum, 9)) for x in nodes)
    assert got == sorted((t, round(float(d), 9), round(float(s), 9)) for t, d, s in density_by_hand(page))
    chosen, top, least = html.content(nodes)
    assert top.tag == "div" and top.sum == max(x.sum for x in nodes) and least == min(x.density for x in (top, nodes[0]))


def test_density_decides_where_tags_do_not():
    """No article tag, no telling class: the advert, the menu and the footer go by density alone, and a section with a
    misleading class stays."""
    p = "<p>A sentence of the article that is long enough to matter, and then some more.</p>"
    page = f"<div><a href=a>Home</a> <a href=b>More</a></div><div>Buy this now, friend.</div><div><h1>Title</h1>{p}<div class='notice'><h2>Note</h2>{p}{p}{p}</div>{p}{p}<div><a href=x>See</a> <a href=y>also</a></div></div><div>All rights kept.</div>"
    text = "A sentence of the article that is long enough to matter, and then some more."
    assert html.main_text(page) == "\n".join(["Title", text, "Note", text, text, text, text, text])


LONG = " ".join(["words of a long enough sentence that go on"] * 4)
STORY = "".join(f"<p>{k} {LONG}.</p>" for k in range(5))
LINKS = "<ul>" + "".join(f"<li><a href=x>go to {k}</a></li>" for k in range(12)) + "</ul>"
TITLED = "\n".join(["Title", *(f"{k} {LONG}." for k in range(5))])


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class=top>{LINKS}</div><article><p>Buy <a href=x>this</a> now</p></article><div id=wrap><div class=story><h1>Title</h1>{STORY}</div></div></body>",
        f"<body><div class=top>{LINKS}</div><div id=wrap><div class=story><h1>Title</h1>{STORY}</div><div class=more>{LINKS}</div></div></body>",
        f"<body><nav>{LINKS}</nav><article><h1>Title</h1><div>{STORY}</div><div class=related>{LINKS}</div></article></body>",
        "<body><div class=story><h1>Title</h1>" + STORY + "</div><div class=said>" + "".join(f"<article><p>note {k} by <a href=x>someone</a></p></article>" for k in range(4)) + "</div></body>",
        f"<body><div class=sponsored-story id=comments><h1>Title</h1>{STORY}</div><div>{LINKS}</div></body>",
    ],
)
def test_density_decides_where_tags_and_names_mislead(page):
    """An article around an advert, none at all, links inside it, comments in articles, a telling name on the text."""
    assert html.main_text(page) == TITLED


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<div>", "</x>", "<b><p>", "<li>", "<header>", "<a href='>", "<!--", "<script>", "<td><tr>", "<"])
def test_broken_pages_take_linear_time(piece):
    import time

    start = time.process_time()
    html.main_text(piece * 60_000 + "<p>end")
    assert time.process_time() - start < 20
