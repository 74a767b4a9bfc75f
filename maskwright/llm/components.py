"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import drop, keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Alternates two star steps until nothing changes: every node's larger
    neighbours move to its smallest one (large star), then its smaller ones do
    (small star). Links stay as many as nodes, rounds grow with the logarithm
    of the longest path. Smallest neighbours are map-side minima and the join
    back is an equi-join on the node, which Spark splits where a node is hot;
    each round is written to the shared folder. Links with a null end and
    loops are left out.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges = keep(edges, "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, edges = edges, keep(small, "links")
        drop(last)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return out if before else spark.createDataFrame([], out.schema)


def widened(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (code, comp) after more links (a, b), in place of ``comps``: only the components that these join are worked on."""
    end = lambda s: comps.select(F.col("code").alias(s), F.col("comp").alias(f"of_{s}"))
    joined = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct()
    roots = keep(components(joined), "roots")
    nodes = links.select(F.col("a").alias("code")).union(links.select("b")).distinct().join(comps, "code", "left_anti").select("code", F.col("code").alias("comp"))
    moved = comps.unionByName(nodes).join(roots.select(F.col("node").alias("comp"), "component"), "comp", "left")
    out = keep(moved.select("code", F.coalesce("component", "comp").alias("comp")), "components")
    drop(roots, comps)
    return out
