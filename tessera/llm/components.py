"""Connected components of a link table by alternating large-star and small-star steps.

Links never leave the executors. Each step is a minimum per node (combined on the map
side) and one join that AQE can split; a node with very many links is a key of that
join only. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)`` for every node with a link to another one; ``comp`` is the smallest node of the component."""
    links = links.selectExpr(f"greatest({a}, {b}) as u", f"least({a}, {b}) as v").where("u <> v").distinct()
    links = settle(links, "links")
    before = None
    while True:
        both = links.unionByName(links.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        least = settle(least, "least")
        large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        large = settle(large, "large")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").selectExpr("v as u", "m as v").unionByName(least.selectExpr("u", "m as v"))
        links = settle(small.selectExpr("greatest(u, v) as u", "least(u, v) as v").where("u <> v").distinct(), "small")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return links.selectExpr("u as node", "v as comp").unionByName(links.selectExpr("v as node", "v as comp").distinct())
        before = now
