"""Connected components of a link table, by contraction."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch

#: Links that one task solves at once; more are contracted by joins until so few are left.
LOCAL_LINKS = 1 << 18


def _roots(parents: DataFrame) -> DataFrame:
    """Pointer jumping: every node's parent becomes its tree's root."""
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        # written, not checkpointed: the size that the planner sees is then the file's
        jumped = materialize(parents.join(up, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")), "roots")
        parents = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return parents


def least_reachable(a, b):
    """(nodes in order, place of the least node reachable from each) of a graph's links."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.arange(len(nodes))
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while (low[low] != low).any():
            low = low[low]
        root = low[root]
    return nodes, root


def _solved(edges: DataFrame) -> DataFrame:
    def solve(batches):
        links = pd.concat(list(batches) or [pd.DataFrame({"a": [], "b": []})])
        if len(links):
            nodes, root = least_reachable(links["a"].to_numpy(), links["b"].to_numpy())
            yield pd.DataFrame({"node": nodes, "root": nodes[root]})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(solve, f"node {kind}, root {kind}")


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node reachable.

    Every node points at its least neighbour, trees collapse to their roots, and
    the links between different roots form the next, smaller graph; one of at most
    ``local_links`` links is solved by one task. The rows are the same either way. A
    hub with any number of links is pre-aggregated; nothing is gathered per component.
    The tables of the rounds are removed at the end.
    """
    with scratch(links.sparkSession) as keep:
        return keep(_contracted(materialize(links.select("a", "b").filter("a <> b").distinct(), "links"), local_links), "components")


def _contracted(edges: DataFrame, local_links: int) -> DataFrame:
    known = None
    while left := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _solved(edges) if left <= local_links else _roots(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
        if known is None:
            known = parents
        else:
            step = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            known = materialize(known.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "roots")
        if left <= local_links:
            return known
        pa = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        pb = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = materialize(edges.join(pa, "a").join(pb, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    return known if known is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
