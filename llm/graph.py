"""Connected components of a link table, without gathering any component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from llm.tables import settled


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``links(a, b)``: the smallest id that can be reached.

    Alternates two contractions until nothing moves: every node hands its
    larger neighbours to its smallest neighbour, then its smaller neighbours to
    the smallest of them. Rounds grow with the logarithm of the longest path.
    Each minimum is a pre-aggregated group, and the joins read written tables on
    both sides, so a node with very many links is split by AQE. Links of an id
    with itself and nulls are left out; an empty table gives an empty result.
    """
    links = settled(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        mark = _fingerprint(links)
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = settled(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large",
        )
        least = settled(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        links = settled(
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
            .select("l.*")
            .where("a <> b")
            .distinct(),
            "links",
        )
    # At rest every link points at the root of its star.
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
