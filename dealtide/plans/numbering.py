"""Running numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows equal in everything are numbered in chunks of so many, each dealt out by itself.
CHUNK = 1 << 20


def _before(keys: Sequence[str], order: Sequence[Column]) -> Column:
    """The rows counted in `n` before the present one among those of the keys."""
    earlier = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(
        F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )


def numbered(df: DataFrame, group: str, at: str, ties: Sequence[str], name: str) -> DataFrame:
    """group, at, ties and the number of each row within its group, from 1, in order of time, then ties, nulls last.

    No window holds a group. Rows equal in all these columns are counted first, combined on the map side; then a day's number is the sum
    over the earlier days of its group, a second's the sum over the earlier seconds of its day, and only the distinct events
    of one second are ordered among themselves. So a group with a third of all rows, be it within one
    day or equal in everything, is spread over many tasks. Nothing runs before the result is read, and nothing is written.

    Columns other than these are dropped: rows that are equal in them can't be told apart.
    """
    moment = F.col(at)
    day = F.coalesce(F.to_date(moment), F.lit("9999-12-31").cast("date"))
    second = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    events = (
        df.groupBy(
            group,
            day.alias("_day"),
            F.coalesce(second, F.lit(-1)).alias("_second"),
            at,
            *ties,
        ).agg(F.count("*").alias("n"))
    )
    seconds = events.groupBy(group, "_day", "_second").agg(F.sum("n").alias("n"))
    days = seconds.groupBy(group, "_day").agg(F.sum("n").alias("n"))
    of_day = days.select(group, "_day", _before([group], [F.col("_day")]).alias("_to_day"))
    to_second = _before([group, "_day"], [F.col("_second")]).alias("_to_second")
    of_second = (
        seconds.select(group, "_day", "_second", to_second)
        .join(of_day, [group, "_day"])
        .select(group, "_day", "_second", (F.col("_to_day") + F.col("_to_second")).alias("_to_second"))
    )
    keys = [group, "_day", "_second"]
    among = _before(keys, [F.asc_nulls_last(c) for c in (at, *ties)])
    chunks = F.expr(f"explode(sequence(0L, (n - 1) div {CHUNK}))")
    places = F.expr(f"explode(sequence(0L, least(n - _chunk * {CHUNK}, {CHUNK}L) - 1))")
    return (
        events.withColumn("_among", among)
        .join(of_second, keys)
        .withColumn("_chunk", chunks)
        .repartition(*keys, "_among", "_chunk")
        .withColumn("_place", places)
        .select(
            group,
            at,
            *ties,
            (F.col("_to_second") + F.col("_among") + F.col("_chunk") * CHUNK + F.col("_place") + 1).alias(name),
        )
    )
