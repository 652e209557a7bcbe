"""Groups of records that are linked directly or through others.

Method: deterministic Boruvka hooking. Every component selects its smallest outgoing edge; the trees
that arise collapse by pointer doubling; edges are relabelled and deduplicated until none remain. The number
of components with an edge at least halves in a round, so there are at most log2(nodes) rounds, whatever the
shape of the graph; chains cost doublings, not rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.operators.skew import salted_lookup
from reportloom.session import Stash

MAX_ROUNDS = 64
#: Edges that are few enough for one task: the rounds on them run there in numpy, by the same steps, as each would cost several jobs.
ONE_TASK = 10_000


def _rounds_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(c, p) of each component of at most ONE_TASK edges and its root: hooking, pointer doubling and relabelling until no edge remains."""
    edges = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=object), *batches])
    ends, names = pd.factorize(edges[["a", "b"]].to_numpy(dtype=object).ravel(), sort=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(names))
    while len(a):
        parent = np.full(len(names), len(names))
        np.minimum.at(parent, np.concatenate([a, b]), np.concatenate([b, a]))
        alone = parent == len(names)
        parent[alone] = np.flatnonzero(alone)
        own = np.arange(len(names))
        parent = np.where(parent[parent] == own, np.minimum(parent, own), parent)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        root, a, b = parent[root], parent[a], parent[b]
        keep = a != b
        a, b = np.unique(np.sort(np.stack([a[keep], b[keep]], axis=1), axis=1), axis=0).T
    yield pd.DataFrame({"c": names, "p": names[root]})


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("n")), F.struct(F.col("b").alias("c"), F.col("a").alias("n")))).alias("x")).select("x.c", "x.n")


def _collapse(hook: DataFrame, n: int, stash: Stash) -> DataFrame:
    """(c, root) of the trees that n hooks make, by pointer doubling.

    Two components that chose each other are the only cycles; the smaller one is the root. A row is settled once its target is
    known to be a root, so no doubling is spent on finding that nothing changes.
    """
    up = hook.select(F.col("c").alias("p"), F.col("p").alias("_up"))
    # the first doubling also breaks the cycles: whoever chose c's choice tells if c is in one
    both = salted_lookup(hook, up, "p", "inner", rows=n)
    cycle = F.col("_up") == F.col("c")
    tree = both.select("c", F.when(cycle, F.least("c", "p")).otherwise(F.col("_up")).alias("p"), cycle.alias("settled"))
    tree, seen = stash.put_counted(tree, open=F.count_if(~F.col("settled")))
    while seen["open"]:
        up = tree.select(F.col("c").alias("p"), F.col("p").alias("_up"), F.col("settled").alias("_known"))
        # a root may have a third of all components hooked to it
        nxt = salted_lookup(tree, up, "p", "inner", rows=n).select("c", F.col("_up").alias("p"), (F.col("settled") | F.col("_known")).alias("settled"))
        nxt, seen = stash.put_counted(nxt, open=F.count_if(~F.col("settled")))
        stash.drop(tree)
        tree = nxt
    return tree


def connected_groups(links: DataFrame, left: str, right: str) -> DataFrame:
    """(entity_id, group_id) of each id that is linked to another one; group_id is the group's smallest id (byte order).

    A link with a null id, or of an id with itself, links nothing; repeated links and both directions of one
    count once. An empty table gives no rows. Ids are compared as strings. The operator runs its loop when called:
    a round leaves one table of its components and their roots in the shared folder, and only counts come to the driver. When no edges
    are left the rounds' tables are composed, the last and smallest first; the result is a table in the shared folder that
    belongs to the caller (see Stash), all others are dropped.

    A hub that holds a third of the links: its links are deduplicated and reduced to the smallest neighbour
    with partial aggregates; where links fetch the label of their ends, hot ends are split by salts.
    """
    stash = Stash(links.sparkSession, "components")
    l, r = F.col(left).cast("string"), F.col(right).cast("string")
    edges = links.where(l.isNotNull() & r.isNotNull() & (l != r)).select(F.least(l, r).alias("a"), F.greatest(l, r).alias("b")).distinct()
    edges, seen = stash.put_counted(edges, n=F.count(F.lit(1)))
    rounds: list[tuple[DataFrame, int]] = []
    while seen["n"]:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("the components did not settle")
        if seen["n"] <= ONE_TASK:
            rounds.append((stash.put(edges.coalesce(1).mapInPandas(_rounds_in_task, "c string, p string")), 2 * seen["n"]))
            break
        # the smallest edge of component c, in the order of (smaller end, larger end), leads to its smallest neighbour
        hook, own = stash.put_counted(_both_ways(edges).groupBy("c").agg(F.min("n").alias("p")), n=F.count(F.lit(1)))
        root = _collapse(hook, own["n"], stash)
        stash.drop(hook)
        to = lambda c, out: root.select(F.col("c").alias(c), F.col("p").alias(out))  # noqa: E731, B023
        e = salted_lookup(edges, to("a", "_a"), "a", "inner", rows=seen["n"])
        e = salted_lookup(e.select("b", "_a"), to("b", "_b"), "b", "inner", rows=seen["n"]).where(F.col("_a") != F.col("_b"))
        nxt, seen = stash.put_counted(e.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), n=F.count(F.lit(1)))
        stash.drop(edges)
        edges = nxt
        rounds.append((root, own["n"]))
    if not rounds:
        return stash.finish(edges.select(F.col("a").alias("entity_id"), F.col("b").alias("group_id")))
    final, n = rounds.pop()
    while rounds:
        # components of the round before: those that were roots have gone on, the others stay where their root went
        before, n = rounds.pop()
        onward = final.select(F.col("c").alias("p"), F.col("p").alias("_on"))
        final = stash.put(salted_lookup(before, onward, "p", "left", rows=n).select("c", F.coalesce("_on", "p").alias("p")))
    least = final.groupBy("p").agg(F.min("c").alias("_least"))
    return stash.finish(salted_lookup(final, least, "p", "inner", rows=n).select(F.col("c").alias("entity_id"), F.col("_least").alias("group_id")))
