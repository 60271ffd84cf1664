"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import stored


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` (long) to one row ``(node, root)`` for every linked node.

    Each round renames every node to the neighbour, itself included, that comes first in an
    order drawn anew for the round; links between the new names stay. Random orders shrink long
    chains by a constant factor, stars and cliques at once. Renames are then followed backwards.
    Links with a null end or equal ends are ignored; an empty table gives an empty result."""
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    renames, turn = [], 0
    while not links.isEmpty():
        turn += 1
        both = links.union(links.select("b", "a")).toDF("node", "to")
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), F.col(c).alias("id"))
        best = both.groupBy("node").agg(F.min(rank("to")).alias("m"))
        names = stored(best.select("node", F.least("m", rank("node"))["id"].alias("name")), "names")
        renames.append(names)
        left, right = (names.select(F.col("node").alias(c), F.col("name").alias(f"{c}2")) for c in ("a", "b"))
        moved = links.join(left, "a").join(right, "b").filter("a2 <> b2")
        links = stored(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    if not renames:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = renames[-1].select("node", F.col("name").alias("root"))
    for names in reversed(renames[:-1]):
        later = roots.select(F.col("node").alias("name"), "root")
        roots = names.join(later, "name", "left").select("node", F.coalesce("root", "name").alias("root"))
    return roots
