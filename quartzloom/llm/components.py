"""Connected components of a link table, by alternating large and small stars.

Both steps replace links by links to the least neighbour, so that every component ends as a star
around its least node. Rows stay on the executors; each step is cut with checkpoint(), so a lost
executor costs at most one step. The least neighbours are checkpointed before they are joined
back, which lets AQE split the partition of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzloom.llm.common import cut, uncut


def star(links: DataFrame, made: list[DataFrame]) -> DataFrame:
    """links (u, v): each v goes to the least of u and its neighbours."""
    least = cut(links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    made.append(least)
    return links.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b), the component being its least node.

    Links of a node with itself and repeated links change nothing; links with a null end are dropped. The tables of a
    step are removed after it, whatever Spark's cleaner is set to.
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u > v").distinct())
    mark = None
    while True:
        made = [now]
        both = cut(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = cut(star(both, made).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = star(large, made)
        now = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
        for table in (*made, both, large):
            uncut(table)
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
