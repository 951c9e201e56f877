"""The most frequent keys of a table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bands of counts in which neighbours differ by the factor 2^(1/BANDS).
BANDS = 64


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows whose count is above a cut that at most ``most`` rows pass.

    The cut comes from a histogram by bands of counts (at most 64 * BANDS rows at the driver), so no task and no driver
    sorts or gathers more rows than are wanted. A band that is too large is left out as a whole.
    """
    band = F.floor(F.log2(F.col(n).cast("double")) * BANDS)
    cut, total = None, 0
    for row in sorted(counts.where(F.col(n) > 0).groupBy(band.alias("band")).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        cut = row["band"]
    return counts.where(F.lit(False)) if cut is None else counts.where((F.col(n) > 0) & (band >= cut))
