"""Running values over long histories without a task per history. Rows are cut into chunks of their
order, each chunk is scanned in a task of its own, and what the chunks before it add up to is carried in
from a table of one row a chunk. Results are those of one window over the whole history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of a chunk of arrival numbers, and of nanoseconds (an hour).
ARRIVALS, HOUR = 1 << 20, 3_600_000_000_000

_JOIN = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}


def running(rows: DataFrame, by: list[str], order: list[str], values: Mapping[str, tuple[str, Column]], width: int, current: bool = True, peers: bool = False) -> DataFrame:
    """``rows`` and, for each of ``values``, its sum, max or last (not null) over the rows up to the current
    one by ``order``, whose first column is a whole number; ``current=False`` leaves the row itself out, and
    ``peers`` takes in all rows that are equal in ``order[0]``, the only column of the order then."""
    r = rows.withColumn("__chunk", F.floor(F.col(order[0]) / F.lit(width)))
    for n, (_, c) in values.items():
        r = r.withColumn(f"__{n}", c)
    here = Window.partitionBy(*by, "__chunk").orderBy(*order)
    whole = here.rangeBetween(Window.unboundedPreceding, 0) if peers else here.rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    kinds = {n: k for n, (k, _) in values.items()}
    total = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))}
    local = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.last(c, ignorenulls=True)}
    chunks = r.groupBy(*by, "__chunk").agg(*[total[k](F.col(f"__{n}")).alias(f"__{n}") for n, k in kinds.items()])
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*by, "__chunk", *[local[k](F.col(f"__{n}")).over(before).alias(f"__{n}_in") for n, k in kinds.items()])
    out = r.join(carried, [*by, "__chunk"])
    done = [_JOIN[k](F.col(f"__{n}_in"), local[k](F.col(f"__{n}")).over(whole)).alias(n) for n, k in kinds.items()]
    return out.select(*[c for c in rows.columns if c not in kinds], *done)


def numbered(rows: DataFrame, order: list[str], width: int, by: list[str] | None = None, name: str = "n") -> DataFrame:
    """``rows`` with their place, from 1 on, by ``order``, among all or those equal in ``by``."""
    return running(rows, by or [], order, {name: ("sum", F.lit(1).cast("long"))}, width)
