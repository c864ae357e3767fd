"""Arithmetic on detector outputs, key points and vectors, as column expressions; encoders."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.people import kept_boxes


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def similarity_transform(xs: Column, ys: Column, us: Column, vs: Column) -> Column:
    """The least-squares turn, scale and shift that takes points (xs, ys) to (us, vs), as a struct a,
    b, e, f: x goes to a x - b y + e and y to b x + a y + f. Null where all points are one.

    In the plane such maps are products with the complex number a + ib, which least squares gives
    in closed form, reflections excluded.
    """
    mx, my, mu, mv = (_mean(c) for c in (xs, ys, us, vs))
    rows = F.arrays_zip(F.transform(xs, lambda x: x - mx).alias("x"), F.transform(ys, lambda y: y - my).alias("y"), F.transform(us, lambda u: u - mu).alias("u"), F.transform(vs, lambda v: v - mv).alias("v"))
    total = lambda term: F.aggregate(rows, F.lit(0.0), lambda s, r: s + term(r))
    size = total(lambda r: r["x"] * r["x"] + r["y"] * r["y"])
    a = total(lambda r: r["x"] * r["u"] + r["y"] * r["v"]) / size
    b = total(lambda r: r["x"] * r["v"] - r["y"] * r["u"]) / size
    return F.when(size > 0, F.struct(a.alias("a"), b.alias("b"), (mu - a * mx + b * my).alias("e"), (mv - b * mx - a * my).alias("f")))


def decoded(outputs: DataFrame, threshold: float = 0.5, anchors: int = 2) -> DataFrame:
    """Boxes and key points of detector outputs, one row for each anchor (image, stride, place, score,
    distances, points, width, scale): image, box, score, x1, y1, x2, y2, points in source pixels.

    ``place`` numbers a stride's anchors row by row; the distances go from the anchor's centre to
    the left, top, right and bottom, in strides, and ``width`` is the network's input width.
    """
    cell, columns, stride = F.floor(F.col("place") / anchors), F.floor(F.col("width") / F.col("stride")), F.col("stride")
    x, y = cell % columns * stride, F.floor(cell / columns) * stride
    side = lambda centre, sign, k: (centre + sign * F.col("distances")[k] * stride) / F.col("scale")
    points = F.transform("points", lambda p, k: (F.when(k % 2 == 0, x).otherwise(y) + p * stride) / F.col("scale"))
    box = F.concat_ws("/", "stride", "scale", "place").alias("box")
    return outputs.filter(F.col("score") >= threshold).select("image", box, "score", side(x, -1, 0).alias("x1"), side(y, -1, 1).alias("y1"), side(x, 1, 2).alias("x2"), side(y, 1, 3).alias("y2"), points.alias("points"))


def merged_scales(outputs: DataFrame, threshold: float = 0.5, most: float = 0.4) -> DataFrame:
    """The boxes of all strides and input scales of an image, the best of those that overlap."""
    return kept_boxes(decoded(outputs, threshold), "image", most)


def quantised(vector: Column, bits: int = 4, group: int = 64) -> Column:
    """Struct of codes, scales and lows: each group's values as steps from its least one."""
    steps = float((1 << bits) - 1)
    starts = F.sequence(F.lit(1), F.size(vector), F.lit(group))
    parts = F.transform(starts, lambda s: F.slice(vector, s, group))
    low = F.transform(parts, lambda p: F.array_min(p).cast("double"))
    scale = F.transform(parts, lambda p: (F.array_max(p).cast("double") - F.array_min(p).cast("double")) / steps)
    one = lambda p: F.transform(p, lambda x: F.when(F.array_max(p) > F.array_min(p), F.round((x - F.array_min(p)) / ((F.array_max(p).cast("double") - F.array_min(p).cast("double")) / steps))).otherwise(0.0).cast("int"))
    return F.struct(F.flatten(F.transform(parts, one)).alias("codes"), scale.alias("scales"), low.alias("lows"))


def restored(codes: Column, scales: Column, lows: Column, group: int = 64) -> Column:
    """The vector of the codes, within half a step of each value."""
    of = lambda values, k: F.element_at(values, (F.floor(k / group) + 1).cast("int"))
    return F.transform(codes, lambda c, k: of(lows, k) + c * of(scales, k))


class Encoder(Protocol):
    """A model outside the engine: texts or images in, vectors of one width out."""

    width: int

    def encode(self, items: list) -> list[list[float]]: ...


def encoded(rows: DataFrame, column: str, make: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """``rows`` with a vector of ``column``; each worker makes its encoder once and feeds it batches."""
    schema = rows.limit(0).withColumn("vector", F.array().cast("array<float>")).schema

    def run(batches):
        import pyarrow as pa

        encoder = make()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                piece = part.slice(at, batch)
                yield piece.append_column("vector", pa.array(encoder.encode(piece.column(column).to_pylist()), pa.list_(pa.float32())))

    return rows.mapInArrow(run, schema)


def remembered(encoder: Encoder, most: int = 128) -> Callable[[str], tuple[float, ...]]:
    """The vector of a query, the last ``most`` of them from memory."""
    return lru_cache(most)(lambda text: tuple(encoder.encode([text])[0]))
