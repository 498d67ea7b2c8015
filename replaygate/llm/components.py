"""Connected components of a link table, for the operators that group linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import releasing, stored


@releasing
def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node in `links` (a long, b long): label is the
    smallest node reachable.

    Rounds of hooking (a node goes to the smallest of its neighbours and itself) and
    jumping (then to where that one goes, until none goes further: to a node smaller
    than all its neighbours). After each round the links are those between the nodes
    gone to, each once, so that each round at least halves the nodes; the last round is that
    which leaves no link. Then the rounds' tables are put together from the last to the
    first. Each is written to the shared folder. A node's neighbours are
    pre-aggregated, so a node with very many links never meets them all in one row,
    and the tables that links are joined with are read from files, so that Spark can
    split such a node's links.
    """
    links = stored(_distinct(links), f"{name}-links")
    rounds: list[DataFrame] = []
    while not rounds or not links.isEmpty():
        turn = len(rounds)
        both = links.select(F.col("a").alias("node"), "b").union(links.select(F.col("b").alias("node"), F.col("a").alias("b")))
        hooked = stored(both.groupBy("node").agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("to")), f"{name}-h{turn}")
        jumps = 0
        while True:
            up = hooked.select(F.col("node").alias("to"), F.col("to").alias("above"))
            jumps += 1
            jumped = stored(hooked.join(up, "to").select("node", "to", "above"), f"{name}-{turn}-{jumps}")
            if jumped.filter("to <> above").isEmpty():
                break
            hooked = jumped.select("node", F.col("above").alias("to"))
        rounds.append(jumped.select("node", "to"))
        a, b = (rounds[-1].select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        links = stored(_distinct(links.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))), f"{name}-l{turn}")
    labels = rounds.pop().withColumnRenamed("to", "label")
    while rounds:
        on = labels.select(F.col("node").alias("to"), "label")
        labels = stored(rounds.pop().join(on, "to", "left").select("node", F.coalesce("label", "to").alias("label")), f"{name}-labels{len(rounds)}")
    return labels


def _distinct(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
