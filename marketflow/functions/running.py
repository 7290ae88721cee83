"""Running sums and maxima of whole tables in two levels: totals of cells first, then the rows inside each cell.

No task sees more than one cell's rows, or one row for each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.sources.shared import written


def running(rows: DataFrame, by: list[str], cell: str, order: list[str], values: dict[str, tuple[Column, str]]) -> DataFrame:
    """rows with each value's inclusive running sum or max, per key `by`, in the order of (cell, order).

    cell: a column that grows with the order, such as the day. values: name -> (column, "sum" or "max"). Null counts as 0
    in a sum and is left out of a max.
    """
    x = rows.withColumns({f"__v_{name}": F.coalesce(value, F.lit(0)) if how == "sum" else value for name, (value, how) in values.items()})
    how_of = {name: getattr(F, how) for name, (_, how) in values.items()}
    cells = x.groupBy(*by, cell).agg(*[f(f"__v_{name}").alias(f"__c_{name}") for name, f in how_of.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, cell, *[f(f"__c_{name}").over(before).alias(f"__b_{name}") for name, f in how_of.items()])
    inside = Window.partitionBy(*by, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = {name: F.coalesce(f"__b_{name}", F.lit(0)) + F.sum(f"__v_{name}").over(inside) if how == "sum" else F.greatest(f"__b_{name}", F.max(f"__v_{name}").over(inside)) for name, (_, how) in values.items()}
    out = x.join(cells, [*by, cell]).withColumns(both)
    return out.drop(*[f"__{k}_{name}" for name in values for k in "vb"])


def places(rows: DataFrame, by: list[str], time: str, order: list[str], flags: dict[str, Column], width: int = 21_600_000) -> DataFrame:
    """rows with, for each flag, name: how many rows of its key it holds for up to and with this one, in `order`, and name_n: in all.

    order starts with time. Counts of cells of `width` of time are added up first and stacked on their cells' rows, so that a window holds
    one cell's rows, or a row for each cell of a key, and nothing is joined. The counts are written to the shared folder at once.
    """
    x = rows.withColumns({"__cell": F.expr(f"{time} div {width}"), **{f"__v_{name}": F.coalesce(flag, F.lit(False)).cast("long") for name, flag in flags.items()}})
    cells = written(x.groupBy(*by, "__cell").agg(*[F.sum(f"__v_{name}").alias(f"__c_{name}") for name in flags]))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"__v_{name}": F.coalesce(F.sum(f"__c_{name}").over(before), F.lit(0)) for name in flags} | {f"{name}_n": F.sum(f"__c_{name}").over(whole) for name in flags}
    heads = cells.select(*by, "__cell", F.lit(0).alias("__row"), *[v.alias(name) for name, v in sums.items()])
    inside = Window.partitionBy(*by, "__cell").orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = heads.unionByName(x.withColumn("__row", F.lit(1)), allowMissingColumns=True)
    found = {name: F.sum(f"__v_{name}").over(inside) for name in flags} | {f"{name}_n": F.first(f"{name}_n").over(inside) for name in flags}
    return both.withColumns(found).where("__row = 1").select(*rows.columns, *found)
