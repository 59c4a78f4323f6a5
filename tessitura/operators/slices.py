"""Runs and confirmed stops of one long key over many tasks: slices, a summary of each, and what is carried from slice to slice.

``intervals.runs`` and ``intervals.confirmed_stop`` walk a key in one task. Here
a key is cut into slices by its order; the rows of a slice are one window
partition, so a song, or a user with a third of all rows, is spread over as many
tasks as it has slices. Each slice is summed up in one row; windows over those
few rows tell what a slice takes over, and that is joined back to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sliced(rows: DataFrame, key: list[str], at: str, width: float) -> DataFrame:
    return rows.withColumn("_slice", F.floor(F.col(at).cast("double") / width))


def _local_runs(rows: DataFrame, key: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """``rows`` with, within their slice: {name}_flag, {name}_no (runs begun before, from 0) and {name}_len (rows of the run so far)."""
    w = W.partitionBy(*key, "_slice").orderBy(*order)
    change = F.coalesce(~flag.eqNullSafe(F.lag(flag).over(w)), F.lit(True)) & (F.row_number().over(w) > 1)
    marked = rows.withColumn(f"{name}_flag", flag).withColumn(f"{name}_no", F.sum(change.cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.withColumn(f"{name}_len", F.row_number().over(W.partitionBy(*key, "_slice", f"{name}_no").orderBy(*order)))


def _carried(sums: DataFrame, key: list[str], name: str) -> DataFrame:
    """``sums`` (one row a slice: {name}_first, {name}_last, {name}_last_no, {name}_tail, n) with what the slice takes over.

    {name}_base: the number of its first run, from 1; {name}_carry: rows of that run in slices before. A slice that is one
    run and goes on with the run before adds to it, so a run may span any number of slices."""
    w = W.partitionBy(*key).orderBy("_slice")
    goes_on = F.coalesce(F.col(f"{name}_first").eqNullSafe(F.lag(f"{name}_last").over(w)), F.lit(False)) & (F.row_number().over(w) > 1)
    s = sums.withColumn("_on", goes_on).withColumn("_whole", F.col("_on") & (F.col(f"{name}_last_no") == 0))
    s = s.withColumn("_chain", F.sum((~F.col("_whole")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    s = s.withColumn("_reach", F.sum(f"{name}_tail").over(W.partitionBy(*key, "_chain").orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)))
    begun = F.sum(F.col(f"{name}_last_no") + (~F.col("_on")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    s = s.withColumn(f"{name}_base", begun - F.col(f"{name}_last_no"))
    return s.withColumn(f"{name}_carry", F.when(F.col("_on"), F.lag("_reach").over(w)).otherwise(F.lit(0))).drop("_on", "_whole", "_chain", "_reach")


def _summary(local: DataFrame, key: list[str], order: list[str], names: list[str]) -> DataFrame:
    place = F.struct(*order)
    parts = [F.count("*").alias("n")]
    for name in names:
        parts += [
            F.min_by(f"{name}_flag", place).alias(f"{name}_first"), F.max_by(f"{name}_flag", place).alias(f"{name}_last"),
            F.max(f"{name}_no").alias(f"{name}_last_no"), F.max_by(f"{name}_len", place).alias(f"{name}_tail"),
        ]
    return local.groupBy(*key, "_slice").agg(*parts)


def sliced_runs(rows: DataFrame, key: list[str], at: str, order: list[str], flag: Column, width: float, name: str = "run") -> DataFrame:
    """``intervals.runs`` with a key in many tasks: ``rows`` with the number (from 1) of the run of equal flags they are in.

    ``order`` begins with the number ``at``; a slice is ``width`` of it. Rows that are equal in ``order`` are in an order of their own,
    as in a window."""
    local = _local_runs(_sliced(rows, key, at, width), key, order, flag, "_r")
    carried = _carried(_summary(local, key, order, ["_r"]), key, "_r").select(*key, "_slice", "_r_base")
    whole = local.join(carried, [*key, "_slice"])
    return whole.withColumn(name, F.col("_r_base") + F.col("_r_no")).select(*rows.columns, name)


def sliced_stop(frames: DataFrame, key: list[str], t: str, silent: str, fits: str, step: float, width: float, silence: float = 0.120, failure: float = 0.250, least_cover: float = 0.60, least_gain: float = 0.080, end: float = 0.0) -> DataFrame:
    """``intervals.confirmed_stop`` with a key in many tasks: (key, stop_at, last_good, coverage, accepted).

    Where runs of silence and of frames that do not fit reach over slices, their length is carried; the stop is a minimum,
    and what lies before it is counted, both by partial aggregation."""
    local = _local_runs(_sliced(frames, key, t, width), key, [t], F.col(silent), "_s")
    local = _local_runs(local, key, [t], F.col(fits), "_f")
    sums = _summary(local, key, [t], ["_s", "_f"])
    carried = _carried(_carried(sums, key, "_s"), key, "_f").select(*key, "_slice", "_s_carry", "_f_carry")
    whole = local.join(carried, [*key, "_slice"])
    so_far = lambda n: (F.col(f"{n}_len") + F.when(F.col(f"{n}_no") == 0, F.col(f"{n}_carry")).otherwise(F.lit(0))) * F.lit(step)
    stop = (F.col(silent) & (so_far("_s") >= silence - 1e-9)) | (~F.col(fits) & (so_far("_f") >= failure - 1e-9))
    stops = whole.groupBy(*key).agg(F.min(F.when(stop, F.col(t))).alias("stop_at"))
    before = frames.select(*key, t, fits).join(stops, key).where(F.col("stop_at").isNull() | (F.col(t) < F.col("stop_at")))
    good = before.groupBy(*key).agg(F.max(F.when(F.col(fits), F.col(t))).alias("last_good"))
    walked = before.join(good, key).groupBy(*key).agg(F.count_if(F.col(fits)).alias("_fit"), F.count_if(F.col(t) <= F.col("last_good")).alias("_all"), F.min("stop_at").alias("stop_at"), F.min("last_good").alias("last_good"))
    cover = F.when(F.col("_all") > 0, F.col("_fit") / F.col("_all"))
    accepted = F.coalesce((cover >= least_cover) & (F.col("last_good") + step - end >= least_gain), F.lit(False))
    return walked.select(*key, "stop_at", "last_good", cover.alias("coverage"), accepted.alias("accepted"))
