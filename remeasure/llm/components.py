"""Problem 6: one identifier for all records linked directly or through others.

Method: minimum labels are propagated over the edges, pointer jumping takes every record to
the root of its chain, and the edges are then carried over to the roots. Each step is written
to shared storage, and the rounds go on until no edge joins two labels any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remeasure.functions.columns import clean_label, clean_night, is_finite
from remeasure.session import stored


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``: its smallest neighbour, followed to the end."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    chain = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        onward = chain.select(F.col("node").alias("root"), F.col("root").alias("further"))
        twice = chain.join(onward, "root").select("node", "root", "further")
        onward = onward.select(F.col("root").alias("further"), F.col("further").alias("furthest"))
        jumped = stored(twice.join(onward, "further").select("node", F.col("furthest").alias("root"), (F.col("furthest") != F.col("root")).alias("moved")))
        chain = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return chain


def connected_components(edges: DataFrame) -> DataFrame:
    """One row (node, component) for every node that occurs in ``edges`` (columns a and b).

    component is the smallest node tied to it. Edges are undirected; repeated edges and loops
    change nothing, a node with only a loop is its own component, edges with a null end are
    left out (the other end, if any, is still a node), no edges give no rows.

    Each round keeps only local minima, at most half of the nodes that still have an edge, so
    rounds grow with the logarithm of the longest chain. A hub's edges are reduced before each
    shuffle (min is combined on the map side, repeated edges are dropped after each round), and
    the joins leave a hot label to the adaptive skew join.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("whole"))
    distinct = stored(pairs.distinct())
    nodes = distinct.select(F.col("a").alias("node")).unionByName(distinct.select(F.col("b").alias("node"))).where("node is not null").distinct()
    live = distinct.where("whole and a <> b").select("a", "b")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        roots = _roots(live)
        rounds.append(roots)
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(left, "a").join(right, "b").where("ra <> rb")
        live = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    final = None
    for roots in reversed(rounds):
        if final is None:
            final = roots.select("node", F.col("root").alias("component"))
        else:
            later = final.select(F.col("node").alias("root"), F.col("component").alias("later"))
            final = stored(roots.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("component")))
    if final is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(final, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def label_links(pairs: DataFrame) -> DataFrame:
    """The distinct links (a, b) of PROGRAM:night labels in the usable rows of ``pairs``.

    A row links its labels if group_id is not null, delta_vrad is finite, pair_error is above 0
    (NaN is not) and both programs and nights are neither null nor blank. A night that holds no
    yyyymmdd in any known spelling counts as blank. Spellings are made distinct before they are
    cleaned: there are far fewer of them than rows.
    """

    def label(side: str):
        program, night = clean_label(F.col(f"program_{side}")), clean_night(F.col(f"night_{side}"))
        return F.when((program != "") & night.isNotNull(), F.concat_ws(":", program, night))

    error = F.col("pair_error")
    usable = F.col("group_id").isNotNull() & is_finite(F.col("delta_vrad")) & (error > 0) & ~F.isnan(error)
    links = stored(pairs.where(usable).select("program_1", "night_1", "program_2", "night_2").distinct())
    ends = [links.select(F.col(f"program_{k}").alias("program_1"), F.col(f"night_{k}").alias("night_1")) for k in (1, 2)]
    spelled = stored(ends[0].unionByName(ends[1]).distinct().withColumn("label", label("1")).where("label is not null"))
    for k, end in ((1, "a"), (2, "b")):
        named = spelled.select(F.col("program_1").alias(f"program_{k}"), F.col("night_1").alias(f"night_{k}"), F.col("label").alias(end))
        links = links.join(named, [f"program_{k}", f"night_{k}"])
    return links.select("a", "b").distinct()


def label_groups(pairs: DataFrame) -> DataFrame:
    """(label, group_label) for every label in a linking row of ``pairs``."""
    return connected_components(label_links(pairs)).select(F.col("node").alias("label"), F.col("component").alias("group_label"))
