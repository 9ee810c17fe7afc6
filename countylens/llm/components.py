"""Connected components of a link table, by label propagation with pointer jumping.

Each round gives a node the smallest label among itself and its neighbours (summed up before the
shuffle), then the label of its label. Every round is written out, so the plan never grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countylens.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b); comp is the smallest node reached."""
    both = staged(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(
        F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a")
                .agg(F.min("comp").alias("near")))
        lower = staged(labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was")), "labels")
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = staged(lower.join(jump, "comp", "left").select(
            "node", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "was"), "labels")
        labels = new.select("node", "comp")
        if new.filter(F.col("comp") != F.col("was")).isEmpty():
            return labels
