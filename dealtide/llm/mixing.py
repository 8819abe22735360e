"""Mixing sources to target weights.

Sizes are read once from the texts and written beside a hash-random key of the document. That narrow
table is range-sorted by (source, key); sums of whole ranges carry on over the ranges of a source, so a
source with a third of all documents is spread over its ranges and no task holds a source. Each source is
cut where its running total reaches its budget; a budget above the source's size takes whole epochs first.

Only DataFrame functions are used. Defined results:

* a null or empty text has size 0 and is taken 0 times; a source without words has target 0;
* a null source is a source of its own, the last one;
* repeated rows, and rows without doc_id, are documents of their own; ties of the key are ordered by
  (doc_id, size), and rows equal in all of them are interchangeable;
* an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealtide.llm.cluster import phased, stored

_SPACE = r"\x20\x09-\x0D"
WORD = f"[^{_SPACE}]+"
#: A source's documents are repeated at most so often.
EPOCHS = 3
#: Weights of the sources in code-point order, over and over.
WEIGHTS = (1, 2, 3)

_WIDE = "decimal(38,0)"


def running(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Mapping[str, Column | str]
) -> DataFrame:
    """`df` with the totals of each of `sums` over the rows before, within the group in the given order.

    Rows are dealt to ranges of (group, order), so equal rows and large groups are spread; a range sums
    its own rows, and goes on from the total of the earlier ranges of its group. The ranges are written,
    as they must not change between the two uses.
    """
    keys = [*group, *order]
    dealt = stored(
        df.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*keys, "_row")
        .withColumn("_range", F.spark_partition_id())
    )
    here = [*group, "_range"]
    in_range = Window.partitionBy(*here).orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(_WIDE)

    def amount(value: Column | str) -> Column:
        return (F.col(value) if isinstance(value, str) else value).cast(_WIDE)

    ranges = (
        dealt.groupBy(*here)
        .agg(*[F.sum(amount(v)).alias(f"_{name}") for name, v in sums.items()])
        .select(
            *here,
            *[F.coalesce(F.sum(f"_{n}").over(earlier), zero).alias(f"_{n}") for n in sums],
        )
    )
    within = {n: F.coalesce(F.sum(amount(v)).over(in_range), zero) for n, v in sums.items()}
    return (
        dealt.withColumns(within)
        .join(ranges, here)
        .withColumns({n: (F.col(n) + F.col(f"_{n}")).cast(_WIDE) for n in sums})
        .drop("_range", "_row", *[f"_{n}" for n in sums])
    )


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source (null: ''), unknown (whether it is null), size, key: 60 random bits by doc_id."""
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id")), 1, 15), 16, 10)
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNull().alias("unknown"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        key.cast("bigint").alias("key"),
    )


def repeating(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Sources (source, unknown, ...) with `weight`: the given ones in code-point order, null last, repeating."""
    places = running(
        sources.withColumn("_all", F.lit(0)), ["_all"], ["unknown", "source"], {"place": F.lit(1)}
    )
    listed = F.array(*[F.lit(w) for w in weights])
    at = (F.col("place") % len(weights)).cast("int")
    return places.withColumn("weight", F.get(listed, at).cast("bigint")).drop("_all", "place")


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Sources (source, unknown, source_size, weight) with `target`, their share of all sizes by weight.

    No target is above `epochs` times its source's size; what is above goes to the others by weight, until
    none is above. In order of (limit / weight) the limited sources come first, so whether one is
    limited follows from the totals before it: what earlier limits leave, shared among it and the rest.
    Sources without a weight get nothing.
    """
    limit = (F.col("source_size") * epochs).cast(_WIDE)
    weighed = sources.withColumns(
        {"_all": F.lit(0), "limit": limit, "ratio": limit.cast("double") / F.col("weight")}
    )
    whole = weighed.agg(
        F.sum("source_size").cast(_WIDE).alias("total"), F.sum("weight").cast(_WIDE).alias("weights")
    )
    some = F.col("weight") > 0
    order = ["ratio", "unknown", "source"]
    ranked = running(
        weighed.filter(some), ["_all"], order, {"spent": "limit", "passed": "weight"}
    ).crossJoin(F.broadcast(whole))  # one row
    rest, shares = F.col("total") - F.col("spent"), F.col("weights") - F.col("passed")
    full = rest * F.col("weight") > F.col("limit") * shares
    judged = stored(ranked.withColumn("full", full))
    # The first source that isn't limited, which has the most left, shares it with all after it.
    level = judged.agg(
        F.max(F.when(~F.col("full"), rest)).alias("left"),
        F.max(F.when(~F.col("full"), shares)).alias("among"),
    )
    share = (F.col("left") * F.col("weight")).cast("double") / F.col("among").cast("double")
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share)
    given = judged.crossJoin(F.broadcast(level)).select(  # one row
        "source", "unknown", "source_size", target.alias("target")
    )
    none = weighed.filter(~F.coalesce(some, F.lit(False))).select(
        "source", "unknown", "source_size", F.lit(0.0).alias("target")
    )
    return given.unionByName(none)


@phased
def mixture(
    docs: DataFrame,
    weights: Sequence[int] | DataFrame = WEIGHTS,
    *,
    epochs: int = EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes.

    docs: doc_id, source, text. weights: in order of the sources, repeating, or a frame (source, weight);
    a source that is not in it gets none. Taken words count repeats: whole epochs of the source, then, in
    random order, documents up to the exact budget (the target, rounded down), the last of which is cut.
    """
    sizes = stored(sized(docs, seed))
    name = ["unknown", "source"]
    sources = stored(sizes.groupBy(*name).agg(F.sum("size").alias("source_size")))
    if isinstance(weights, DataFrame):
        listed = weights.groupBy(
            F.col("source").isNull().alias("unknown"),
            F.coalesce("source", F.lit("")).alias("source"),
        ).agg(F.max("weight").cast("bigint").alias("weight"))
        weighed = sources.join(listed, name, "left")
    else:
        weighed = repeating(sources, weights)
    planned = targets(stored(weighed), epochs)
    rows = running(sizes, name, ["key", "doc_id", "size"], {"before": "size"})
    budget = F.floor("target").cast("bigint")
    whole = F.expr("cast(floor(target) AS bigint) div greatest(source_size, 1L)")
    rest = budget - whole * F.col("source_size")
    more = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return rows.join(planned, name).select(
        "doc_id",
        F.when(~F.col("unknown"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + more).cast("bigint").alias("taken"),
    )


def mixed(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows of the mix: doc_id, source, epoch (from 0), text, of documents with unique ids.

    A document comes once for each epoch that takes it; the last copy ends after the words taken, which
    only the document at its source's cut doesn't have in full. Texts move once, to meet their plan by doc_id.
    """
    plan = taken.filter(F.col("taken") > 0).select("doc_id", "size", "taken")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    epoch = F.explode(F.sequence(F.lit(0), copies - 1)).alias("epoch")
    rows = docs.select("doc_id", "source", "text").join(plan, "doc_id")
    rows = rows.select("doc_id", "source", "text", "size", "taken", epoch)
    words = F.col("taken") - F.col("epoch") * F.col("size")
    # Possessive, so a long text needs no stack.
    first = F.concat(F.lit(f"^(?:[{_SPACE}]*+[^{_SPACE}]++){{"), words.cast("string"), F.lit("}+"))
    cut = F.regexp_substr("text", first)
    return rows.select(
        "doc_id", "source", "epoch", F.when(words < F.col("size"), cut).otherwise(F.col("text")).alias("text")
    )
