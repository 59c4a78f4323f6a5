"""Writers: subtitle text, report rows, separated values, note tables and exclusive publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessitura.functions.text import timestamp_text

TICKS_PER_BEAT, BEATS_PER_SECOND = 1920, 2.0


def subtitle_text(rows: DataFrame, key: list[str], order: list[str], start_ms: str = "start_ms", end_ms: str = "end_ms", text: str = "text") -> DataFrame:
    """(key, content): numbered subtitle blocks of each key as one text."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat(timestamp_text(F.col(start_ms)), F.lit(" --> "), timestamp_text(F.col(end_ms))), F.col(text), F.lit(""))
    numbered = rows.withColumn("n", n).withColumn("block", block)
    return numbered.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("content"))


def finite_json(row: Column) -> Column:
    """A struct as JSON; not-a-number and infinity are not allowed in it."""
    text = F.to_json(row)
    return F.when(text.rlike(r'":\s*"?(NaN|-?Infinity)"?[,}\]]'), F.raise_error(F.lit("a number is not finite")).cast("string")).otherwise(text)


def separated(notes: DataFrame, decimals: dict[str, int], yes: str = "SIM", no: str = "NÃO") -> DataFrame:
    """Columns as text: fixed decimals, yes or no, lists joined by `` | ``."""
    out = []
    for name, kind in notes.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.format_string(f"%.{decimals.get(name, 6)}f", c)
        elif kind == "boolean":
            c = F.when(c, yes).otherwise(no)
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), " | ")
        out.append(c.cast("string").alias(name))
    return notes.select(out)


def write_separated(notes: DataFrame, path: str, decimals: dict[str, int]) -> None:
    separated(notes, decimals).write.mode("errorifexists").csv(path, sep=";", header=True)


def note_ticks(notes: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Note times on the tick grid of a file at 120 beats a minute; ``problem`` where a note would have no length."""
    tick = lambda c: F.floor(F.col(c) * BEATS_PER_SECOND * TICKS_PER_BEAT + 0.5).cast("long")
    ticked = notes.withColumns({"tick_on": tick(start), "tick_off": tick(end)})
    return ticked.withColumn("problem", F.when(F.col("tick_off") <= F.col("tick_on"), F.lit("no_length")))


def publish(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes once: an earlier publication is never overwritten."""
    df.write.mode("errorifexists").format(kind).save(path)
