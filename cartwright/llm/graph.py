"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the component's smallest node) of every node in ``links(a, b)``.

    Each round hooks every component to its smallest neighbour, halves the paths and contracts
    the links, so only links between different components are left for the next. Tables of each
    round are written to the shared folder; nothing is collected but whether links are left.
    """
    rest = materialize(links.select("a", "b").where("a != b").distinct(), "links")
    nodes = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
    found = nodes.withColumn("component", F.col("node"))
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        hooks = materialize(
            both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")),
            "hooks",
        )
        for _ in range(2):
            onward = hooks.select(F.col("a").alias("to"), F.col("to").alias("end"))
            hooks = materialize(
                hooks.join(onward, "to").select("a", F.col("end").alias("to")), "hooks"
            )
        found = materialize(
            found.join(hooks.withColumnRenamed("a", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            "components",
        )
        one = hooks.select("a", F.col("to").alias("x"))
        two = hooks.select(F.col("a").alias("b"), F.col("to").alias("y"))
        rest = materialize(
            rest.join(one, "a")
            .join(two, "b")
            .where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
        )
    return found
