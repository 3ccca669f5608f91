"""Set similarity on array columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a, b) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a, b) -> Column:
    """Shared elements over the smaller set."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def words(c) -> Column:
    """Distinct lower-case tokens of a text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 0))
