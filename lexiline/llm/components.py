"""Connected components by contraction, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiline.llm.common import drop, materialise


def components(edges: DataFrame, place: str, name: str, led: bool = False) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is one of the ids of those connected.

    In each round every vertex points to the neighbour (or itself) with the least hash, edges are moved to what their ends
    point to, and loops and repeats go; a constant share of the vertices is expected to go each round. With led, edges
    lead from a to b without cycles and the first pointers go back along them, which settles stars at once. No
    vertex's neighbours are gathered, and the driver only asks whether edges are left.
    """
    spark = edges.sparkSession
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    current = materialise((edges.select("a", "b") if led else edges.select("a", "b").unionByName(turned)).filter("a <> b").distinct(), place, f"{name}-edges0")
    pointers: list[DataFrame] = []
    while not current.isEmpty():
        k = len(pointers)
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c), c)  # noqa: B023, E731
        if led and not k:
            to = current.select("b", "a").unionByName(current.select(F.col("a").alias("b"), F.lit(None).cast("long").alias("a"))).groupBy("b").agg(F.min("a").alias("to"))
            to = to.select(F.col("b").alias("a"), F.coalesce("to", "b").alias("to"))
        else:
            best = current.groupBy("a").agg(F.min_by("b", rank(F.col("b"))).alias("b"))
            to = best.select("a", F.when(rank(F.col("a")) < rank(F.col("b")), F.col("a")).otherwise(F.col("b")).alias("to"))
        to = materialise(to, place, f"{name}-to{k}")
        pointers.append(to)
        one = current.join(to, "a").select(F.col("to").alias("x"), "b")
        two = one.join(to.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("to").alias("b")).filter("a <> b")
        if led and not k:
            two = two.unionByName(two.select(F.col("b").alias("a"), F.col("a").alias("b")))
        current = materialise(two.distinct(), place, f"{name}-edges{k + 1}")
        drop(place, spark, f"{name}-edges{k}")
    if not pointers:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component"))
    out = pointers[0].select(F.col("a").alias("id"), F.col("to").alias("component"))
    for to in pointers[1:]:  # as many as rounds: about the logarithm of the longest chain
        out = out.join(to, out["component"] == to["a"], "left").select("id", F.coalesce("to", "component").alias("component"))
    return materialise(out, place, f"{name}-components")


def merged(found: DataFrame, edges: DataFrame, place: str, name: str) -> DataFrame:
    """(id, component) after more edges: only components that they touch are looked at."""
    if edges.isEmpty():
        return found
    own = lambda c: edges.join(found.withColumnRenamed("id", c), c, "left")
    one = own("a").select(F.coalesce("component", "a").alias("x"), "b")
    two = one.join(found.withColumnRenamed("id", "b"), "b", "left").select(F.col("x").alias("a"), F.coalesce("component", "b").alias("b"))
    top = components(two, place, f"{name}-top").select(F.col("component").alias("new"), F.col("id").alias("component"))
    moved = found.join(top, "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    fresh = top.select(F.col("component").alias("id"), F.col("new").alias("component")).join(found, "id", "left_anti")
    return materialise(moved.unionByName(fresh), place, name)
