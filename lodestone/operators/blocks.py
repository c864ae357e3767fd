"""Two tables held against each other block by block, without the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one block.
ROWS = 8192


def block_pairs(left: DataFrame, right: DataFrame, function: Callable, schema: str, *, left_rows: int = ROWS, right_rows: int = ROWS, least: int = 1) -> DataFrame:
    """``function`` (two Arrow tables to one) over every pair of a left and a right block.

    The first column of each table, its id, decides the block of a row by its hash; blocks hold
    about ``left_rows`` and ``right_rows`` rows, and there are ``least`` left ones at least where
    rows allow. A row is sent once for each block of the other side, so that a task holds two
    blocks, however large the tables are. What ``function`` returns should be small: the best
    few of each row.
    """
    n, m = left.count(), right.count()
    g = max(1, math.ceil(n / left_rows), min(least, math.ceil(n / 1024)))
    h = max(1, math.ceil(m / right_rows))
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda frame, k: F.pmod(F.xxhash64(frame.columns[0]), F.lit(k)).cast("int")
    a = left.withColumn("__g", block(left, g)).withColumn("__h", upto(h))
    b = right.withColumn("__h", block(right, h)).withColumn("__g", upto(g))
    return a.groupBy("__g", "__h").cogroup(b.groupBy("__g", "__h")).applyInArrow(function, schema)
