"""Running sums over a whole table in a given order: sorted ranges, a scan of each, and what earlier ranges carry in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str], folder: str, name: str, group: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """rows (its columns keep; by default all) with, for each (new column: column) of sums, the sum of the column over
    all rows up to and with this one in the given order.

    Columns to sum are non-null longs whose sums fit in a long. With group (a column of non-null longs, which comes
    first in the order) sums start anew at each of its values. Rows are dealt over ranges of the order, so that neither
    a group nor the whole passes through one task; each range is scanned once, in batches. What earlier ranges carry
    into a range is a row for each range, or for each range's first group: that is what is broadcast, and its size
    is the number of ranges. Rows that are equal in all of the order may come in any order among each other.
    """
    kept = keep or rows.columns
    needed = list(dict.fromkeys([*kept, *([group] if group else []), *sums.values()]))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in needed), *(f"`{n}` long" for n in sums), "__range int"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        last, carried = None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not len(batch):
                continue
            if group:
                g = batch[group].to_numpy()
                new = np.concatenate([[True], g[1:] != g[:-1]])
                start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
                goes_on = last is not None and g[0] == last
                last = g[-1]
            else:
                start, goes_on = np.zeros(len(batch), dtype=np.int64), True
            for n, c in sums.items():
                total = np.cumsum(batch[c].to_numpy(dtype=np.int64))
                before = np.where(start > 0, total[start - 1], -carried[n] if goes_on else 0)
                batch[n] = total - before
                carried[n] = int(batch[n].to_numpy()[-1])
            batch["__range"] = np.int32(number)
            yield batch

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*needed)
    done = materialize(ranged.mapInPandas(scan, schema), folder, name)
    by = ["__range", group] if group else ["__range"]
    lengths = done.groupBy(*by).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(group or F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = lengths.select(*by, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in sums))
    carry = carry.filter(" or ".join(f"`__{n}` <> 0" for n in sums))  # at most one row for each range
    found = done.join(F.broadcast(carry), by, "left")
    return found.select(*kept, *(F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in sums)).toDF(*kept, *sums)
