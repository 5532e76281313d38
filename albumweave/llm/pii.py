"""Personal data by rules and boosted candidates, in DataFrame functions and Spark ML alone.

Base spans come from four strict patterns with checks (octets, card check digit, numbers of digits). Loose patterns with
high recall propose further spans of the same kinds, with other separators and spelled-out marks. Gradient-boosted trees,
those of its kind, score each proposal from its format and context. Nobody has labelled loose forms, but strict spans are known to be
right, so they are the labels: each one of all texts is rewritten in the loose forms of its kind, where it stands
(right), and broken in ways that a careless pattern would take (wrong): a digit that fails the check, an octet too large,
a number without a prefix or a cue before it. Proposals whose numbers can't be of their kind are wrong, too. The trees are
fitted to these examples, summed up by their feature values, but for one right and one wrong form of each kind and a
fifth of the refuted proposals, which set the thresholds: half-way below the lowest score of each kind from which on at
least `PRECISION` of what was kept out is right. A kind without strict spans, or without such a score, adds nothing. Proposals
from there on that overlap no base span of their kind are added.

Offsets count code points, ends are exclusive. Null and empty texts have no spans. A null doc_id is kept. Rows that
repeat give equal results; other columns are kept by `redact` and ignored by `find`; an empty table gives an empty
result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumweave.llm.common import materialise, table

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns. Repetition is possessive and a match starts where a run of its characters starts or the last match
#: ended: the matches are the same, without trying every place of a long run.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:\s?(?:@|\(at\)|\[at\])\s?[a-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\])\s?[a-z0-9-]++)++|\sat\s[a-z0-9-]++(?:\sdot\s[a-z0-9-]++)++)",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|,|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{0,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
#: Texts without these hold no match.
NEEDS = {"email": r"@|\([aA][tT]\)|\[[aA][tT]\]|\s[dD][oO][tT]\s", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: Words that announce a kind, at most 25 characters before it.
CUE = {
    "email": r"(?i)(?:mail|contact|kontakt|contacto|write|reach|schreib|correo|courriel|[ée]cri)",
    "ip": r"(?i)(?:host|server|servidor|serveur|addr|adress|direcci|\bip\b)",
    "card": r"(?i)(?:card|visa|credit|kredit|karte|carte|tarjeta)",
    "phone": r"(?i)(?:\btel|phone|t[ée]l[ée]f|\bcall|\bfax|mobil|m[óo]vil|handy|rufnummer|anruf|llam|appel|contact|kontakt)",
}
PRECISION = 0.95
TREES, DEPTH = 10, 3
SPAN = "array<struct<s:int,e:int,t:string,w:string,a:string>>"
FEATURES = ["digits", "letters", "marks", "check", "octets", "at", "bracket", "plus", "zeros", "tld", "before", "after", "cue", "near"]
#: A word that announces a kind and stands right before it, and contexts of rewritten numbers.
BESIDE = r"[\p{L}]*[.:]?\s?$"
CUED, FAR = "tel ", "contact list entry "


#: Signs set around matches, and what stands for them in a text that holds them: no pattern matches any of them.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
#: Matches whose places are summed up together: running sums cost the matches times this, not their square.
CHUNK = 64


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it, also in functions of its own."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """The matches as (s, e, t, w, a): places, text, up to 25 characters before, as far as the last match reaches, and the
    one after. One pass of the pattern sets signs around its matches; the pieces between the signs give all of it, so
    that nothing counts through the text for each match."""
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, OTHER + OTHER), F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))
    none = F.expr("cast(array() as array<int>)")

    def before(sizes: Column, first: Column) -> Column:
        """Running sums, each without its own."""
        step = lambda acc, n: F.struct((acc["p"] + n).alias("p"), F.concat(acc["o"], F.array(acc["p"])).alias("o"))
        return F.aggregate(sizes, F.struct(first.alias("p"), none.alias("o")), step, lambda acc: acc["o"])

    def described(x: Column, last: Column) -> Column:
        t = F.substring_index(x, CLOSE, 1)
        return F.struct((F.length(x) - 1).alias("n"), t.alias("t"), F.right(F.translate(last, CLOSE, ""), F.lit(25)).alias("w"), F.left(F.substring_index(x, CLOSE, -1), F.lit(1)).alias("a"))

    def in_chunks(pieces: Column) -> Column:
        more = F.size(pieces) - 1
        found = F.zip_with(F.slice(pieces, F.lit(2), more), F.slice(pieces, F.lit(1), more), described)
        count = F.ceil(more / CHUNK).cast("int")
        at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(none)
        return let(found, lambda f: F.transform(at, lambda k: F.slice(f, k * CHUNK + 1, F.lit(CHUNK))))

    def placed(pieces: Column, chunks: Column) -> Column:
        size = lambda c: F.aggregate(c, F.lit(0), lambda m, x: m + x["n"])
        starts = before(F.transform(chunks, size), F.length(F.get(pieces, F.lit(0))))
        span = lambda x, s: F.struct(s.alias("s"), (s + F.length(x["t"])).alias("e"), x["t"].alias("t"), x["w"].alias("w"), x["a"].alias("a"))
        return F.flatten(F.zip_with(chunks, starts, lambda c, s: F.zip_with(c, before(F.transform(c, lambda x: x["n"]), s), span)))

    return let(F.split(marked, OPEN), lambda pieces: let(in_chunks(pieces), lambda chunks: placed(pieces, chunks)))


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def octets(t: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(t, r"[^0-9]+"), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        return octets(t)
    if kind == "card":
        return F.length(digits(t)).between(16, 19) & F.call_function("luhn_check", digits(t))
    if kind == "phone":
        return F.length(digits(t)).between(8, 15)
    return F.lit(True)


def grouped(d: Column, mark: str) -> Column:
    return F.regexp_replace(d, r"([0-9]{4})(?=[0-9])", f"$1{mark}")


def rewritten(kind: str, x: Column) -> Column:
    """Examples (t, w, a, right, held) from a strict span: in loose forms, the last of them held out of fitting, and
    broken, likewise."""
    t, w, d = x["t"], x["w"], digits(x["t"])
    as_is = lambda form: (form, w)
    if kind == "email":
        local, domain = F.substring_index(t, "@", 1), F.substring_index(t, "@", -1)
        form = lambda at, dot, y=domain: F.concat(local, F.lit(at), F.regexp_replace(y, r"\.", dot))
        cut = F.regexp_replace(domain, r"[A-Za-z0-9-]+$", "12")
        right = [as_is(form(" at ", " dot ")), as_is(form("(at)", "(dot)")), as_is(form(" [at] ", " [dot] ")), as_is(form(" (at) ", " [dot] "))]
        wrong = [as_is(form(" at ", " dot ", cut)), as_is(form("@", " . ", cut))]
    elif kind == "ip":
        form = lambda mark, y=t: F.regexp_replace(y, r"\.", mark)
        high = F.regexp_replace(t, "^[0-9]+", "731")
        right = [as_is(form(",")), as_is(form("[.]")), as_is(form("(.)")), as_is(form(" . "))]
        wrong = [as_is(form(",", high)), as_is(form(" . ", high))]
    elif kind == "card":
        # Another last digit fails the check.
        bad = F.concat(F.left(d, F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        right = [as_is(grouped(d, ".")), as_is(grouped(d, "/")), as_is(grouped(d, "  ")), as_is(grouped(d, "_"))]
        wrong = [as_is(grouped(bad, ".")), as_is(grouped(bad, "_"))]
    else:
        far = F.when(w.rlike(CUE[kind]), F.lit("x ")).otherwise(w)
        parts = F.regexp_replace(d, r"([0-9]{3})(?=[0-9]{2})", "$1 ")
        right = [as_is(F.concat(F.lit("00"), parts)), (parts, F.lit(CUED)), (grouped(d, " "), F.lit(CUED)), (d, F.lit(CUED)), (F.concat(F.lit("+"), F.regexp_replace(parts, " ", "/")), w), as_is(F.concat(F.lit("00"), F.regexp_replace(parts, " ", "-")))]
        wrong = [(parts, far), (d, far), (grouped(d, " "), far), (grouped(d, " "), F.lit(FAR)), (parts, F.lit(FAR))]
    if kind != "phone":  # in a context without any cue, too
        right, wrong = ([both for c, v in forms for both in ((c, v), (c, F.lit("x ")))] for forms in (right, wrong))
        last = 2
    else:
        last = 1
    made = [(*c, r, n >= len(forms) - last) for forms, r in ((right, True), (wrong, False)) for n, c in enumerate(forms)]
    return F.array(*(F.struct(c.alias("t"), v.alias("w"), x["a"].alias("a"), F.lit(r).alias("right"), F.lit(h).alias("held")) for c, v, r, h in made))


def refuted() -> Column:
    """Whether a proposal's numbers can't be of its kind."""
    card, ip, phone = (F.col("check") == 0) | (F.col("zeros") == 1) | (F.col("plus") == 1), F.col("octets") == 0, ~F.col("digits").between(8, 15)
    return F.when(F.col("kind") == "card", card).when(F.col("kind") == "ip", ip).when(F.col("kind") == "phone", phone).otherwise(False)


def base_spans(text: Column, kind: str) -> Column:
    none = F.expr(f"cast(array() as {SPAN})")
    needs = "@" if kind == "email" else "[+][0-9]" if kind == "phone" else NEEDS[kind]
    return F.when(text.rlike(needs), F.filter(spans(text, STRICT[kind]), lambda x: valid(kind, x["t"]))).otherwise(none)


def features(kind: str, x: Column) -> list[Column]:
    """The features of a span by its text and surroundings."""
    kind_of = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 3).otherwise(4)
    d = digits(x["t"])
    return [
        F.least(F.length(d), F.lit(20)).alias("digits"),
        F.least(F.length(F.regexp_replace(x["t"], r"[^\p{L}]", "")), F.lit(8)).alias("letters"),
        F.least(F.length(F.regexp_replace(x["t"], r"[\p{L}0-9]", "")), F.lit(8)).alias("marks"),
        (F.length(d).between(13, 19) & F.call_function("luhn_check", d)).cast("int").alias("check"),
        octets(x["t"]).cast("int").alias("octets"),
        x["t"].contains("@").cast("int").alias("at"),
        x["t"].rlike(r"[(\[]").cast("int").alias("bracket"),
        x["t"].startswith("+").cast("int").alias("plus"),
        x["t"].rlike(r"^\(?00").cast("int").alias("zeros"),
        x["t"].rlike(r"[^A-Za-z][A-Za-z]{2,8}$").cast("int").alias("tld"),
        kind_of(F.right(x["w"], F.lit(1))).alias("before"),
        kind_of(x["a"]).alias("after"),
        x["w"].rlike(CUE[kind]).cast("int").alias("cue"),
        x["w"].rlike(CUE[kind] + BESIDE).cast("int").alias("near"),
    ]


def proposals(text: Column, kind: str) -> Column:
    """Loose matches with their features."""
    none = F.expr(f"cast(array() as {SPAN})")
    described = lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), *features(kind, x))
    return F.transform(F.when(text.rlike(NEEDS[kind]), spans(text, LOOSE[kind])).otherwise(none), described)


def examples(strict: Column, kind: str) -> Column:
    """What strict spans of a kind teach: examples with their features."""
    described = lambda x: F.struct(F.lit(kind).alias("kind"), x["right"].alias("right"), x["held"].alias("kept_out"), *features(kind, x))
    return F.flatten(F.transform(strict, lambda x: F.transform(rewritten(kind, x), described)))


def _scored(rows: DataFrame, model) -> DataFrame:
    made = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return model.transform(made).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fitted(taught: DataFrame) -> dict[str, tuple]:
    """(model, threshold) by kind from examples (kind, right, kept_out, features), for kinds that have right and wrong ones
    and a threshold. The table is summed up by feature values before fitting; its size is bounded by their number of
    combinations, not by the texts."""
    summed = materialise(taught.groupBy("kind", "right", "kept_out", *FEATURES).agg(F.count("*").cast("double").alias("w")), "features")
    classes = summed.where(~F.col("kept_out")).groupBy("kind").agg(F.countDistinct("right").alias("n")).where("n = 2")
    out: dict[str, tuple] = {}
    for kind in sorted(r.kind for r in classes.collect()):  # four at most
        own = summed.where(F.col("kind") == kind)
        # In one order, whatever the layout of the texts.
        train = own.where(~F.col("kept_out")).withColumn("label", F.col("right").cast("double")).coalesce(1).sortWithinPartitions(*FEATURES, "label")
        train = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train).select("features", "label", "w")
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, weightCol="w", seed=1, maxBins=32).fit(train)
        levels = _scored(own.where("kept_out"), model).groupBy(F.round("p", 3).alias("p")).agg(F.sum("w").alias("n"), F.sum(F.when(F.col("right"), F.col("w")).otherwise(0.0)).alias("r"))
        rows = levels.orderBy(F.desc("p")).collect()  # 1,001 levels at most
        n, r, low = 0.0, 0.0, None
        for at, row in enumerate(rows):
            n, r = n + row.n, r + row.r
            if r > 0 and r >= PRECISION * n:
                low = at
        if low is not None:  # half-way to what is too low
            below = rows[low + 1].p if low + 1 < len(rows) else 1 - rows[low].p
            out[kind] = model, min(rows[low].p, (rows[low].p + below) / 2)
    return out


def overlapping(found: DataFrame, bases: DataFrame) -> DataFrame:
    """Proposals with `over`: whether a base span (rid, kind, s, e) of their kind and text overlaps them."""
    both = found.withColumn("is_base", F.lit(False)).unionByName(bases.withColumn("is_base", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("rid", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last, next_ = F.max(F.when(F.col("is_base"), F.col("e"))).over(w.orderBy("s")), F.min(F.when(F.col("is_base"), F.col("s"))).over(w.orderBy(F.desc("s")))
    over = F.coalesce(last > F.col("s"), F.lit(False)) | F.coalesce(next_ < F.col("e"), F.lit(False))
    return both.withColumn("over", over).where("NOT is_base").drop("is_base")


def _detected(docs: DataFrame) -> DataFrame:
    """What `detect` returns, with a number `rid` for each row."""
    names = [c for c in docs.columns if c not in ("base", "added", "found", "rid", "proposed", "strict", "taught")]
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    both = lambda k: let(base_spans(text, k), lambda x: F.struct(bare(x).alias("base"), examples(x, k).alias("taught")))
    rows = docs.select(*names).withColumn("strict", F.struct(*(both(k).alias(k) for k in KINDS)))
    rows = rows.withColumn("base", F.struct(*(F.col("strict")[k]["base"].alias(k) for k in KINDS))).withColumn("taught", F.concat(*(F.col("strict")[k]["taught"] for k in KINDS)))
    rows = rows.withColumn("proposed", F.concat(*(proposals(text, k) for k in KINDS))).withColumn("rid", F.monotonically_increasing_id()).drop("strict")
    rows = materialise(rows, "spans")
    found = rows.where(F.size("proposed") > 0).select("rid", F.explode("proposed").alias("x")).select("rid", "x.*")
    bases = rows.select("rid", F.explode(F.concat(*map(named, KINDS))).alias("x")).select("rid", "x.*")
    found = materialise(overlapping(found, bases).where(~F.col("over")).drop("over"), "proposed")
    wrong = found.where(refuted()).withColumns({"right": F.lit(False), "kept_out": F.pmod(F.xxhash64("s", "e", *FEATURES), F.lit(5)) == 0})
    names_of = ["kind", "right", "kept_out", *FEATURES]
    fit = fitted(rows.select(F.explode("taught").alias("x")).select("x.*").select(*names_of).union(wrong.select(*names_of)))
    none = "cast(array() as array<struct<kind:string,s:int,e:int>>)"
    if not fit:
        rows = rows.withColumn("added", F.expr(none))
    else:
        new = reduce(DataFrame.union, (_scored(found.where(F.col("kind") == k), model).where(F.col("p") >= least).select("rid", "kind", "s", "e") for k, (model, least) in fit.items()))
        new = new.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias("added"))
        rows = rows.join(new, "rid", "left").withColumn("added", F.coalesce("added", F.expr(none)))
    every = []
    for k in KINDS:
        every.append(F.array_sort(F.concat(named(k), F.filter("added", _of_kind(k)))))
    return rows.withColumn("found", F.concat(*every)).select(*names, "rid", "base", "added", "found")


def detect(docs: DataFrame) -> DataFrame:
    """The columns of `docs` with base (kind to spans), added (kind, s, e) and all spans as `found` (kind, s, e)."""
    return _detected(docs).drop("rid")


def named(kind: str) -> Column:
    """The base spans of a kind as (kind, s, e)."""
    return F.transform(F.col("base")[kind], lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """The base spans' numbers and digest and all spans of each text."""
    # The text itself is not written along.
    rows = detect(docs.select("doc_id", "text"))
    base = F.concat(*map(named, KINDS))
    return rows.select("doc_id", *(F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def joined(spans_: DataFrame) -> DataFrame:
    """(rid, marks): a text's spans (rid, kind, s, e) in order, those that begin inside earlier ones made one with them
    under the kind of the first."""
    w = Window.partitionBy("rid").orderBy("s", "e", "kind")
    reach = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = spans_.withColumn("first", F.col("s") >= reach).withColumn("turn", F.sum(F.col("first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = rows.groupBy("rid", "turn").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("first"), F.col("kind"))).alias("kind"))
    return one.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias("marks"))


def marked(text: Column, marks: Column) -> Column:
    """`text` with every mark's place taken by its kind, `CHUNK` marks of a stretch at a time."""
    def stretch(part: Column, first: Column) -> Column:
        own = F.substring(text, first + 1, F.element_at(part, -1)["e"] - first)
        step = lambda acc, x: F.struct(
            x["e"].alias("p"), F.concat(acc["o"], F.substring(acc["t"], acc["p"] - first + 1, x["s"] - acc["p"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("o"), acc["t"].alias("t")
        )
        return F.aggregate(part, F.struct(first.alias("p"), F.lit("").alias("o"), own.alias("t")), step, lambda acc: acc["o"])

    at = F.sequence(F.lit(0), F.ceil(F.size(marks) / CHUNK).cast("int") - 1)
    first = lambda k: F.coalesce(F.get(marks, k * CHUNK - 1)["e"], F.lit(0))
    parts = F.transform(at, lambda k: stretch(F.slice(marks, k * CHUNK + 1, F.lit(CHUNK)), first(k)))
    return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(marks, -1)["e"] + 1, F.length(text)))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets; overlapping spans become one. n_chars, where
    there is one, is counted anew."""
    rows = _detected(docs)  # its rows and their numbers are written
    marks = joined(rows.select("rid", F.explode("found").alias("x")).select("rid", "x.kind", "x.s", "x.e"))
    marks = marks.select("rid", F.col("marks").alias("found"))
    rows = rows.drop("base", "added", "found").join(marks, "rid", "left").drop("rid")
    rows = rows.withColumn("text", F.when(F.col("found").isNotNull(), marked(F.col("text"), F.col("found"))).otherwise(F.col("text"))).drop("found")
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in rows.columns else rows


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
