"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.scratch import Scratch, written


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every end of the edges ``(a, b)``; ``comp`` is the least node of its component.

    Each round every node takes the least label of its neighbours and then the label of that
    label, so the rounds grow with the logarithm of a component's width. Labels are written to
    the shared folder between rounds, and those of earlier rounds dropped; nothing but whether
    something changed reaches the driver. Rows with a null end are ignored.
    """
    tables = Scratch(edges.sparkSession)
    ends = edges.where("a is not null and b is not null").select("a", "b")
    both = tables.write(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp"))
    labels = tables.write(labels.withColumn("next", F.col("comp")), "labels")
    while True:
        now = labels.select("node", F.col("next").alias("comp"))
        seen = both.join(now.withColumnRenamed("node", "b"), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        new = now.join(least, "node").select("node", "comp", F.least("comp", "least").alias("next"))
        of = now.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        labels = tables.write(new.join(of, "next").select("node", "comp", F.least("next", "jump").alias("next")), "labels")
        if not labels.where("next <> comp").limit(1).count():
            found = written(labels.select("node", F.col("next").alias("comp")), "components")
            tables.drop("edges", "labels")
            return found
