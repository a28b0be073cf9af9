"""Sign-collapsing tables: a row with sign -1 cancels one with sign 1, so aggregates weigh by the sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.strings import Str, col


class Collapsing:
    """Aggregates over a table whose ``sign`` column is 1 or -1. min, max and distinct counts are unchanged."""

    def __init__(self, sign: Str = "sign"):
        self.sign = col(sign)

    def sum(self, x: Str, where: Column | None = None) -> Column:
        return F.sum(self._if(col(x) * self.sign, where))

    def count(self, x: Str | None = None, where: Column | None = None) -> Column:
        counted = self.sign if x is None else F.when(col(x).isNotNull(), self.sign)
        return F.coalesce(F.sum(self._if(counted, where)), F.lit(0))

    def avg(self, x: Str, where: Column | None = None) -> Column:
        return F.try_divide(self.sum(x, where), F.sum(self._if(F.when(col(x).isNotNull(), self.sign), where)))

    min, max = staticmethod(F.min), staticmethod(F.max)

    @staticmethod
    def _if(x: Column, where: Column | None) -> Column:
        return x if where is None else F.when(where, x)
