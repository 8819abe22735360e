"""Hours of the newest work-breakdown batch of each deal.

A batch is every row written at the same moment; the newest one is the plan in force.
Rows are first summed per (deal, batch), combined on the map side, so neither a deal nor a
batch with a huge number of rows ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealtide.functions.exact import number


def hour_limbs(wbs: DataFrame) -> list[str]:
    """Names of the columns that hold the limbs of hours (see `number`) in the roll-ups below."""
    return [f"hours_{i}" for i in range(len(number(wbs, "hours").limbs))]


def _per_batch(wbs: DataFrame, counted: Column | None, keys: Sequence[str]) -> DataFrame:
    """Totals of the limbs of hours, and the number of entries, of the counted rows with hours."""
    limbs = [F.expr(limb) for limb in number(wbs, "hours").limbs]
    if counted is not None:
        limbs = [F.when(counted, limb) for limb in limbs]
    return (
        wbs.filter(F.col("hours") != 0)
        .groupBy(*keys)
        .agg(
            *[F.sum(x).alias(n) for n, x in zip(hour_limbs(wbs), limbs, strict=True)],
            F.count(limbs[0]).alias("entries"),
        )
    )


def newest_batch_per_deal(wbs: DataFrame, counted: Column | None = None) -> DataFrame:
    """opportunity_id, limbs of hours, entries: totals of the counted rows of the newest batch.

    The batch is chosen among all rows with hours; ``counted`` only limits what is summed.
    Deals without a counted row in their newest batch are left out.
    """
    batches = _per_batch(wbs, counted, ["opportunity_id", "created_date"])
    # A moment occurs once per deal here, so all picks come from the same batch.
    return (
        batches.groupBy("opportunity_id")
        .agg(*[F.max_by(c, "created_date").alias(c) for c in (*hour_limbs(wbs), "entries")])
        .filter(F.col("entries") > 0)
    )


def newest_batch_per_deal_and_role(wbs: DataFrame, counted: Column) -> DataFrame:
    """opportunity_id, role, limbs of hours, entries: as above, one row per counted role.

    The plan is folded once, to (deal, batch, role). A deal's newest batch is found on that fold and joined back
    on (deal, moment), which spreads a large deal over its batches.
    """
    per_role = _per_batch(wbs, counted, ["opportunity_id", "created_date", "role"])
    newest = per_role.groupBy("opportunity_id").agg(F.max("created_date").alias("created_date"))
    return (
        per_role.filter(F.col("entries") > 0)
        .join(newest, ["opportunity_id", "created_date"], "left_semi")
        .drop("created_date")
    )
