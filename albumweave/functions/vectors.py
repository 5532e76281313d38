"""Column expressions over vectors (arrays of numbers) and boxes (structs x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda m, x: m + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column | str, by: Column) -> Column:
    return F.transform(col(a), lambda x: x * by)


def normalised(a: Column | str) -> Column:
    """The unit vector; null for a zero, null or non-finite one."""
    n = norm(a)
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(col(a), lambda x: x.cast("double") / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distance(a: Column | str, b: Column | str) -> Column:
    """Cosine distance of unit vectors, kept within 0 to 2."""
    return F.least(F.greatest(1.0 - dot(a, b), F.lit(0.0)), F.lit(2.0))


def mean_vector(v: Column | str, size: int) -> Column:
    """An aggregate: the mean of vectors of a known size, one average per position (combined before the shuffle)."""
    return F.array(*(F.avg(col(v)[k].cast("double")) for k in range(size)))


def sum_vector(v: Column | str, size: int) -> Column:
    return F.array(*(F.sum(col(v)[k].cast("double")) for k in range(size)))


def clamped(box: Column | str, width: Column, height: Column) -> Column:
    """The part of a box inside an image, in whole pixels."""
    b = col(box)
    x0, y0 = F.greatest(b["x"], F.lit(0)).cast("int"), F.greatest(b["y"], F.lit(0)).cast("int")
    x1, y1 = F.least(b["x"] + b["w"], width).cast("int"), F.least(b["y"] + b["h"], height).cast("int")
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(x1 - x0, F.lit(0)).alias("w"), F.greatest(y1 - y0, F.lit(0)).alias("h"))


def iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    a, b = col(a), col(b)
    w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, w * h / F.nullif(union, F.lit(0.0))).otherwise(F.lit(0.0))


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def pixels(a: Column | str, centre: float, span: float) -> Column:
    """(value - centre) / span for every element."""
    return F.transform(col(a), lambda x: (x.cast("double") - centre) / span)
