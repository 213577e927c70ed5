"""pass@k as a column."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: str | Column, c: str | Column, k: int | Column) -> Column:
    """Chance that one of ``k`` answers drawn without replacement from ``n``, ``c`` of them right, is right.

    1 where fewer than k answers are wrong; null where k exceeds n or an argument is null."""
    n, c = (F.col(x) if isinstance(x, str) else x for x in (n, c))
    k = F.lit(k) if isinstance(k, int) else k
    wrong = F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    return F.when(n - c < k, F.when(k <= n, F.lit(1.0))).when(k <= n, 1.0 - wrong)
