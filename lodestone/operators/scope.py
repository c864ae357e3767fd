"""One scope predicate for browsing, transcripts and vectors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """None means no filter. ``assets`` is a table of ids; an empty one matches nothing."""

    camera: str | None = None
    shape: str | None = None
    kind: str | None = None
    start: str | None = None  # first captured string, inclusive
    through: str | None = None  # last captured string, inclusive
    arrival_through: int | None = None
    assets: DataFrame | None = None

    def predicate(self) -> Column:
        """All conditions on the row itself; an unknown date never meets a date bound."""
        terms = [F.col(c) == v for c, v in (("camera", self.camera), ("shape", self.shape), ("kind", self.kind)) if v is not None]
        if self.start is not None:
            terms.append((F.col("captured") != "") & (F.col("captured") >= self.start))
        if self.through is not None:
            terms.append((F.col("captured") != "") & (F.col("captured") <= self.through))
        if self.arrival_through is not None:
            terms.append(F.col("arrival") <= self.arrival_through)
        return reduce(lambda a, b: a & b, terms, F.lit(True))

    def apply(self, files: DataFrame) -> DataFrame:
        found = files.filter(self.predicate())
        if self.assets is not None:
            ids = self.assets.select(F.col("asset").alias("__scoped"))
            found = found.join(ids, found["asset"] == F.col("__scoped"), "left_semi")
        return found

    def covers_whole_days(self) -> bool:
        """Whether day facets can answer: bounds, if any, begin and end a day."""
        return (self.start is None or len(self.start) == 8 or self.start.endswith("000000")) and (self.through is None or self.through.endswith("235959"))

    def intersect(self, start: str | None, through: str | None) -> Scope:
        """Narrowed to whole days from ``start`` to ``through`` (yyyyMMdd)."""
        begins = [x for x in (self.start, start) if x is not None]
        ends = [x for x in (self.through, through + "235959" if through else None) if x is not None]
        return Scope(self.camera, self.shape, self.kind, max(begins, default=None), min(ends, default=None), self.arrival_through, self.assets)
