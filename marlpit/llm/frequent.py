"""The most frequent values of a table of counts, without a sort of all of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins for each doubling of a count.
STEPS = 16


def most_frequent(counts: DataFrame, count_col: str, size: int) -> DataFrame:
    """Rows of the greatest counts, at most ``size``: all from the least count at which that many or fewer remain.

    ``counts`` should be a written table, as it is read twice. The driver sees a histogram of some hundred bins.
    """
    level = F.floor(F.log2(F.col(count_col).cast("double")) * STEPS).cast("int")
    left, cut = size, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        if r.n > left:
            break
        left, cut = left - r.n, r.level
    return counts.filter(level >= cut) if cut is not None else counts.limit(0)
