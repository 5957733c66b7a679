"""Connected components over an edge table, as iterated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexhoard.session import discard, saved


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of the edge table; component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014), which need O(log^2 n) rounds and keep at most
    as many edges as they start with: no node ever gathers its neighbours in one list. Null ends and self loops carry no link;
    a node that occurs only in a self loop is its own component. The edge plan runs once; tables of earlier rounds are deleted.
    The driver plans every round anew, so a step reads a table as few times as it can, and edges that are stars already end the
    rounds after the first.
    """
    ends = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), (F.col(src).isNotNull() & F.col(dst).isNotNull()).alias("whole"))
    first = saved(ends.where("whole").select("u", "v").distinct())
    # A fixpoint of both steps is a set of stars; equal count and checksum over two rounds show it.
    seen = lambda df: df.where("u > v").agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, mark, was = first, seen(first), None
    while mark[0] and mark != was:
        last, now = now, saved(_star(_star(now, large=True), large=False))
        if last is not first:
            discard(last)
        mark, was = seen(now), mark
    nodes, stars = first.select(F.explode(F.array("u", "v")).alias("node")).distinct(), now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = saved(nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    discard(first, *([now] if now is not first else []))
    return out


def joined_components(components: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The (node, component) table that further edges make of one that `connected_components` has given.

    Only the edges between different components are looked at, as edges between the components' names, so that later rounds of
    a search for links cost what they have found and not what was known. Ends that are in no component yet come in as nodes.
    """
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).join(of("u"), "u", "left").join(of("v"), "v", "left")
    between = ends.select(F.coalesce("u_in", "u").alias("src"), F.coalesce("v_in", "v").alias("dst"), F.col("u_in").isNull().alias("new"))
    named = connected_components(between.where("src != dst or new").select("src", "dst"))
    now = components.join(named.select(F.col("node").alias("component"), F.col("component").alias("name")), "component", "left")
    new = named.join(components.select("node"), "node", "left_anti").select("node", "component")
    out = saved(now.select("node", F.coalesce("name", "component").alias("component")).union(new))
    discard(named)
    return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Every edge (u, v) has u >= v. Large: all larger neighbours of u point to u's smallest neighbour (or u).
    Small: u and its smaller neighbours point to the smallest of them."""
    edges = edges.where("u > v")
    if large:
        around = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        low = around.groupBy(F.col("e.u").alias("v")).agg(F.min("e.v").alias("m"))
        out = edges.join(low, "v").select("u", F.least("m", "v").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    return out.distinct()
