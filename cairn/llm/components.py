"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import runtime


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a < b: joins each node's larger (or smaller) neighbours to its least one."""
    around = _both(links)
    if not large:
        around = around.filter("v < u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = around.join(least, "u")
    if large:
        out = out.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = out.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
    return out.filter("a != b").distinct()


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by its least node.

    Each round writes its links, so a lost executor costs one round at most. Nothing
    but a count and a checksum reaches the driver. No links give no rows.
    """
    now = runtime.written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        after = runtime.written(_star(_star(now, large=True), large=False), "links")
        runtime.drop(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    # Every link of a fixed point goes from a component's least node to another of its nodes.
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).union(stars.select("a", "a").distinct())
