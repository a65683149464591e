"""Connected components of a graph that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), long ids; the component is its smallest node.

    Each round a node takes the smallest label among its own, its neighbours' and its label's label. Rounds are
    written to the shared folder. Minima are aggregated before they are shuffled, and nodes with many edges meet
    in joins only, which adaptive execution can split.
    """
    both = edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(new.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            out = labels.select("node", F.col("label").alias("component"))
            out._millrace_path = labels._millrace_path
            return out


def smallest_keys(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """(cls, component_id): the smallest key of each class's component, from ``classes`` (cls, key) and ``comp`` (cls, comp).

    Components' minima are stored before they are joined back, so that adaptive execution can split a component
    that many classes share.
    """
    named = stored(classes.select("cls", "key").join(comp.select("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "named")
    least = stored(named.groupBy("comp").agg(F.min("key").alias("component_id")), "least")
    out = stored(named.select("cls", "comp").join(least, "comp").select("cls", "component_id"), "component-ids")
    discard(named, least)
    return out
