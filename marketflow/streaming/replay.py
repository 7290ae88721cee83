"""Tables replayed as streams: rows arrive in slices of time, some of them late; each slice is a run that starts from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State stores that keyed state with timers asks for.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def arrivals(rows: DataFrame, time: str, behind: Column, span: tuple[int, int], slices: int = 3) -> DataFrame:
    """rows with __slice, the slice they arrive in: of `slices` equal parts of the span (first and last time), and `behind` slices later."""
    own = F.expr(f"({time} - {span[0]}) * {slices} div {span[1] - span[0] + 1}")
    return rows.withColumn("__slice", F.least(F.lit(slices - 1), own + behind).cast("int"))


def accepted(rows: DataFrame, clock: DataFrame, time: str, late_ms: int, slices: int = 3) -> DataFrame:
    """The rows of arrivals() that no watermark had passed when they came. clock: arrivals whose newest time sets the watermark."""
    newest = dict(clock.groupBy("__slice").agg(F.max(time)).collect())  # a row a slice
    keep, mark = F.lit(True), None
    for k in range(slices):
        if mark is not None:
            keep = F.when(F.col("__slice") == k, F.col(time) > mark - late_ms).otherwise(keep)
        mark = max((v for v in (mark, newest.get(k)) if v is not None), default=None)
    return rows.where(keep)


def replay(tables: dict[str, DataFrame], path: str, job: Callable[[dict[str, DataFrame]], DataFrame], slices: int = 3, mode: str = "append") -> DataFrame:
    """The output of a job on streams, after all slices of its tables (see arrivals()).

    Tables are worked out once, into a folder a slice. Slice by slice the rows join the input folders and the job runs over what is new, from its
    checkpoint: state, watermark and output outlive every run. Append mode writes Parquet; in complete mode each run replaces the table.
    """
    spark = next(iter(tables.values())).sparkSession
    shapes = {name: t.drop("__slice") for name, t in tables.items()}
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        for name, t in tables.items():
            t.write.partitionBy("__slice").parquet(f"{path}/all/{name}")
        for k in range(slices):
            for name, shape in shapes.items():
                come = spark.read.schema(tables[name].schema).parquet(f"{path}/all/{name}")
                come.where(F.col("__slice") == k).select(*shape.columns).write.mode("append").parquet(f"{path}/in/{name}")
            out = job({name: spark.readStream.schema(s.schema).parquet(f"{path}/in/{name}") for name, s in shapes.items()})
            writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True)
            if mode == "complete":
                writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
            else:
                writer = writer.format("parquet").option("path", f"{path}/out")
            writer.start().awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def with_open(final: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """final, flagged, and what `whole` has besides: groups that no watermark has closed, as they stand."""
    rest = whole.join(final.select(*keys), keys, "left_anti")
    return final.withColumn("is_final", F.lit(True)).unionByName(rest.withColumn("is_final", F.lit(False)))
