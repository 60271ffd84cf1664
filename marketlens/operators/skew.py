"""Equi-join that spreads hot keys of either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import broadcast_if_small, stored

# A key whose two sides make more pairs than this is split over several partitions.
HOT_PAIRS = 100_000_000


def salted_join(large: DataFrame, other: DataFrame, keys: list[str], salt_by: list[str],
                hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Inner join of ``large`` and ``other`` on ``keys``.

    A key is hot by the product of its rows on both sides, which is the work it makes. Its rows
    are laid out as a grid: those of ``large`` are cut into ``a`` pieces by a hash of ``salt_by``,
    those of ``other`` into ``b`` by a hash of their other columns, each repeated along the other
    axis, so that a cell makes at most about ``hot_pairs`` pairs and rows are copied least. There
    are at most ``rows / sqrt(hot_pairs)`` hot keys on one side or the other; their list is
    measured before it is broadcast.
    """
    sizes = [side.groupBy(*keys).agg(F.count("*").alias(n)) for side, n in ((large, "_m"), (other, "_n"))]
    cells = F.ceil(F.col("_m") * F.col("_n") / hot_pairs)
    a = F.least(F.greatest(F.ceil(F.sqrt(cells * F.col("_m") / F.col("_n"))), F.lit(1)), cells)
    hot = stored(
        sizes[0].join(sizes[1], keys)
        .filter(F.col("_m").cast("double") * F.col("_n") > hot_pairs)
        .select(*keys, a.cast("int").alias("_a"), F.ceil(cells / a).cast("int").alias("_b")),
        "hot",
    )
    if hot.isEmpty():
        return large.join(other, keys)
    hot = broadcast_if_small(hot)
    rest = [c for c in other.columns if c not in keys]

    def grid(side: DataFrame, cut: str, along: str, by: list[str]) -> DataFrame:
        pieces, copies = (F.coalesce(c, F.lit(1)) for c in (f"_{cut}", f"_{along}"))
        placed = side.join(hot, keys, "left").withColumn(f"_s{cut}", F.pmod(F.xxhash64(*by), pieces).cast("int"))
        return placed.withColumn(f"_s{along}", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_a", "_b")

    left, right = grid(large, "a", "b", salt_by), grid(other, "b", "a", rest or keys)
    return left.join(right, [*keys, "_sa", "_sb"]).drop("_sa", "_sb")
