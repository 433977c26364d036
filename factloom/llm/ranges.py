"""Which range of ascending splitters a value falls into, in Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_of(value: Column, splitters: list[int]) -> Column:
    """How many of the ascending splitters are at most value, by binary search."""
    if not splitters:
        return F.lit(0)
    cuts = F.lit(splitters).cast("array<bigint>")

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = F.element_at(cuts, middle + 1) <= value
        return F.when(a["lo"] >= a["hi"], a).when(right, F.struct((middle + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splitters).bit_length())), start, step)["lo"]
