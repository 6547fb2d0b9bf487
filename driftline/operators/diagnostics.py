"""What filters and smoothers had to hold in check: a flag for each row, counted over all of them.

Caps, floors and stand-ins keep a recursion going where numbers leave their range. Each step says so
in its output `diag`, a sum of the flags below, so that a fit or a filter can be asked how often and
where that happened instead of hiding it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: not_finite: a moment is no number. not_positive: a variance is not above 0. capped: a smoothed covariance was held
#: down. saturated: a log rate was held. unexplained: no state explained the row, so the prediction stood.
FLAGS = {"not_finite": 1, "not_positive": 2, "capped": 4, "saturated": 8, "unexplained": 16}


def marks(**found: np.ndarray) -> np.ndarray:
    """The sum of the flags that hold, for each row."""
    return sum(FLAGS[name] * np.asarray(x, float) for name, x in found.items())


def of_moments(m: np.ndarray, V: np.ndarray) -> dict[str, np.ndarray]:
    """Flags of means and covariances with any axes behind the rows'."""
    rows = len(m)
    flat = lambda x: np.asarray(x).reshape(rows, -1)
    finite = np.isfinite(flat(m)).all(1) & np.isfinite(flat(V)).all(1)
    with np.errstate(invalid="ignore"):
        positive = (flat(np.diagonal(V, axis1=-2, axis2=-1)) > 0).all(1)
    return {"not_finite": ~finite, "not_positive": finite & ~positive}


def report(rows: DataFrame, key: str = "series_id", order: str = "t") -> DataFrame:
    """(flag, n, share, n_keys, first, last): of each flag, rows that have it, how many of all, their series, and the first and last order; zeros and nulls for a flag that none has."""
    each = [F.struct(F.lit(name).alias("flag"), (F.col("diag").cast("long").bitwiseAND(bit) != 0).alias("has")) for name, bit in FLAGS.items()]
    found = rows.select(F.struct(key).alias("k"), F.col(order).alias("at"), F.explode(F.array(*each)).alias("x")).select("k", "at", "x.*")
    has = lambda c: F.when(F.col("has"), F.col(c))
    return found.groupBy("flag").agg(
        F.sum(F.col("has").cast("long")).alias("n"), F.avg(F.col("has").cast("double")).alias("share"), F.count_distinct(has("k")).alias("n_keys"), F.min(has("at")).alias("first"), F.max(has("at")).alias("last")
    )
