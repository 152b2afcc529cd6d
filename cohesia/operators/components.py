"""Connected components within each key by contraction.

Every node hooks onto its smallest neighbour, chains of hooks are jumped to their ends, and the graph between the ends
takes the place of the one before. A round leaves at most half of the nodes that have edges, whatever the length of
paths, so there is no limit on rounds. Once no key has over ``IN_TASK`` edges, the same is done in memory, a key in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.operators.frames import KEYS
from cohesia.session import Scratch, ship

C = F.col
#: Edges of a key that one task takes.
IN_TASK = 500_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while len(a):
        up = np.arange(len(nodes))
        np.minimum.at(up, a, b)
        np.minimum.at(up, b, a)
        while (up[up] != up).any():
            up = up[up]
        top, a, b = up[top], up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[top]


def _whole(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, up = smallest_reachable(pdf["a"].to_numpy(), pdf["b"].to_numpy())
    return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], "labelset": pdf["labelset"].iloc[0], "node": nodes, "up": up})


def _hooks(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(keys, node, up): where the chain of smallest neighbours from each node ends; each join makes chains half as long."""
    both = links.select(*KEYS, "a", "b").unionByName(links.select(*KEYS, C("b").alias("a"), C("a").alias("b")))
    hooks = scratch.keep(both.groupBy(*KEYS, C("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")))
    while True:
        on = hooks.select(*KEYS, C("node").alias("up"), C("up").alias("end"))
        jumped = scratch.keep(hooks.join(on, [*KEYS, "up"]).select(*KEYS, "node", "up", "end"))
        changed = jumped.where("up <> end").limit(1).count()
        scratch.drop(hooks)
        if not changed:
            return jumped.select(*KEYS, "node", "up")
        hooks = jumped.select(*KEYS, "node", C("end").alias("up"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(keys, node, component) for every node of edges (keys, a, b): the smallest node reachable."""
    ship(edges.sparkSession)
    pairs = scratch.keep(edges.select(*KEYS, "a", "b"))
    label = pairs.select(*KEYS, C("a").alias("node")).unionByName(pairs.select(*KEYS, C("b").alias("node"))).distinct().withColumn("component", C("node"))
    between = lambda df: df.select(*KEYS, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    follow = lambda label, up: label.join(up.withColumnRenamed("node", "component"), [*KEYS, "component"], "left").select(*KEYS, "node", F.coalesce("up", "component").alias("component"))
    links = scratch.keep(between(pairs))
    while (links.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0) > IN_TASK:
        up = _hooks(links, scratch)
        label = scratch.keep(follow(label, up))
        ends = links.join(up.select(*KEYS, C("node").alias("a"), C("up").alias("ua")), [*KEYS, "a"]).join(up.select(*KEYS, C("node").alias("b"), C("up").alias("ub")), [*KEYS, "b"])
        links = scratch.keep(between(ends.select(*KEYS, C("ua").alias("a"), C("ub").alias("b"))))
    return follow(label, links.groupBy(*KEYS).applyInPandas(_whole, "dataset string, labelset string, node long, up long"))
