"""Connected components by alternating large-star and small-star steps.

Every step is a join and an aggregate over the link table; nothing is
collected to the driver but one row of convergence figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.shared import discard, materialise_at

MAX_ROUNDS = 60
#: Links that a task of a round writes at least, so that a small graph isn't dealt out over as many files as a large one.
LINKS_PER_FILE = 250_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """`links` holds a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    pulled = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return pulled.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of one orderable type → (node, component): the least node reachable.

    Nodes without a link to another node are not returned. Nulls are no nodes; repeated and
    self links change nothing; no links give no rows.
    """
    spark = links.sparkSession
    clean = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    current, path = materialise_at(clean, "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        # a round leaves at most twice as many links as it got
        files = 1 + 2 * mark[0] // LINKS_PER_FILE
        following, written = materialise_at(_small_star(_large_star(current)).coalesce(files), "links")
        discard(spark, path)
        current, path = following, written
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
