"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealtide.llm.cluster import phased, stored, tasks

#: Links of a task.
LINKS = 1 << 16


def _least(edges: DataFrame) -> DataFrame:
    """Of each node that an edge starts from, the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each greater end has one edge and is nobody's smaller end."""
    ends = edges.selectExpr(
        "inline(array(struct(u as node, 1 as up, 0 as down), struct(v as node, 0 as up, 1 as down)))"
    )
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.count_if(F.expr("up > 1 or up > 0 and down > 0"))).first()[0] == 0


@phased
def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of the links (a bigint, b bigint).

    Alternates large-star and small-star steps until the edges form stars: a logarithmic number of
    rounds, each a few aggregations and joins. A step keeps no more edges than it got. Nodes with
    many neighbours are folded to one minimum before they are joined, so no group is gathered. The
    number of tasks follows that of the links. Links with a null or to oneself are ignored.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    )
    many = tasks(edges.count(), LINKS)
    while not _are_stars(edges):
        # Each edge but those to the least neighbour is in one of the joins; those are the minima.
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = _least(edges.union(back))
        large = (
            back.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.where("m < u"))
            .coalesce(many)
            .distinct()
            .coalesce(many)
        )
        least = _least(large)
        edges = stored(
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least)
            .coalesce(many)
            .distinct()
            .coalesce(many)
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct().coalesce(many)
    )
