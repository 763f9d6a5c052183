"""A Merkle manifest of a dataset: one leaf per row, a tree per group, a tree over the groups' roots, and each row's proof.

A level is one window: partitioned by group and parent index, ordered by position, its full frame collects the digests of the up to `ARITY` children. The
list is the parent's preimage, and without its own entry the siblings of each child. One child of each parent (its first) stands for it in
the next level. Below the leaves only digests move. From the top down each node then gets the siblings on its way to the root from its parent, so
that leaves join one table of parents, an eighth of their number, and no other level.

Positions come without ordering a group in one task: rows are dealt out by ranges of (group, order) and numbered where they lie, and each range
adds the rows of its group in the ranges before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.llm.shared import materialise

ARITY = 8
#: Rows (of some 50 bytes) of a table of ranges or of subroots up to which it is broadcast.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<l:string,r:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def _value(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> Column:
    return digest(*[_value(F.col(f"`{c}`")) for c in (doc_id, source, lang, n_chars)], _value(text))


def tampered(doc_id: str = "doc_id") -> Column:
    """3 divides the CRC-32 of the id in decimals; a null id is never tampered with."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def indexed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` plus `idx`, the position from 0 in its group by `order`, and `cnt`, the group's size. `group` has no nulls."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    # a task's number and the row within it; written, so that no later stage numbers anew
    numbered = materialise(dealt.select("*", F.monotonically_increasing_id().alias("at")).selectExpr("*", "shiftright(at, 33) as part"), "merkle-order")
    parts = numbered.groupBy(group, "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    ranges = Window.partitionBy(group).orderBy("part")
    before = F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "part", (before - F.col("start")).alias("shift"), F.sum("n").over(Window.partitionBy(group)).alias("cnt"))
    return numbered.join(_few(parts), [group, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _level(nodes: DataFrame) -> DataFrame:
    """nodes (group, idx, cnt, node) plus parent, up (the parent's digest) and step (the siblings to the left and to the right).

    The only node of its group has itself for parent and no siblings: its tree is at its top.
    """
    family = Window.partitionBy("group", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = nodes.withColumn("parent", F.expr(f"idx div {ARITY}")).withColumn("family", F.collect_list("node").over(family))
    here = (F.col("idx") % ARITY).cast("int")
    left = F.concat_ws("", F.slice("family", F.lit(1), here))
    right = F.concat_ws("", F.slice("family", here + 2, F.lit(ARITY)))
    return out.select(
        *nodes.columns,
        "parent",
        F.when(F.col("cnt") == 1, F.col("node")).otherwise(F.sha2(F.concat_ws("", "family"), 256)).alias("up"),
        F.struct(left.alias("l"), right.alias("r")).alias("step"),
    )


def _tree(leaves: DataFrame, tag: str, top: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """leaves (group, idx, cnt, node, ...) plus `root` of the group and `path`, the steps from the leaf to the root of all, `top` of the group's path included.

    `top` takes (group, node), a row per group, and returns (group, root, path): what lies above the groups.
    """
    depth, most = 0, leaves.agg(F.max("cnt")).first()[0] or 0
    while most > 1:
        depth, most = depth + 1, -(-most // ARITY)
    if not depth:  # each group is one leaf
        return leaves.join(_few(top(leaves.select("group", "node"))), "group")
    levels: list[DataFrame] = []
    nodes = leaves
    for _ in range(depth):
        level = materialise(_level(nodes), f"merkle-{tag}")
        levels.append(level)
        nodes = level.where(F.col("idx") % ARITY == 0).select("group", F.col("parent").alias("idx"), F.expr(f"(cnt + {ARITY - 1}) div {ARITY}").alias("cnt"), F.col("up").alias("node"))
    above = materialise(top(nodes.select("group", "node")).withColumn("parent", F.lit(0).cast("long")), f"merkle-{tag}-top")
    for level in reversed(levels):
        joined = level.join(above, ["group", "parent"])
        # a tree that is at its top has no step here
        steps = F.when(F.col("cnt") == 1, F.col("path")).otherwise(F.concat(F.array("step"), F.col("path")))
        whole = joined.select(*[c for c in level.columns if c not in ("parent", "up", "step")], "root", steps.alias("path"))
        above = whole.select("group", F.col("idx").alias("parent"), "root", "path")
    return whole


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of `docs` (doc_id, source, lang, n_chars, text).

    Groups are the values of lang, null a group of its own, before all others. Rows of a group stand by doc_id (nulls first), those that share one
    by their leaves, so repeated rows have a leaf each, next to each other. A null enters a leaf as `-`, an empty text as `0:`. A group of one
    row has its leaf for subroot, a table of one group its subroot for root. Empty tables give no rows, extra columns are ignored.
    Tampering (see `tampered`) lower-cases A-Z in the text, so rows without such letters still verify.
    """
    text = F.col("`text`").cast("string")
    group = F.when(F.col("`lang`").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("`lang`").cast("string")))
    forged = F.when(tampered() & text.isNotNull(), leaf(F.translate(text, _UPPER, _LOWER)))
    leaves = docs.select(F.col("`doc_id`").alias("doc_id"), group.alias("group"), leaf(text).alias("node"), forged.alias("forged"))
    placed = indexed(leaves, "group", ["doc_id", "node"])

    def over_groups(subroots: DataFrame) -> DataFrame:
        """The tree over the groups: itself a tree of one group, with nothing above it."""
        named = subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "node")
        nothing = F.array().cast(f"array<{_STEP}>")
        tree = _tree(indexed(named, "group", ["name"]), "groups", lambda one: one.select("group", F.col("node").alias("root"), nothing.alias("path")))
        return tree.select(F.col("name").alias("group"), F.struct(F.col("node").alias("sub"), F.col("root").alias("all")).alias("root"), "path")

    def fold(start: Column) -> Column:
        return F.aggregate("path", start, lambda node, step: digest(step["l"], node, step["r"]))

    siblings = F.concat_ws("", F.flatten(F.transform("path", lambda s: F.array(s["l"], s["r"]))))
    folded = fold(F.coalesce("forged", "node"))
    return _tree(placed, "rows", over_groups).select(
        "doc_id",
        F.col("node").alias("leaf"),
        F.col("root.sub").alias("subroot"),
        F.col("root.all").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.col("root.all")).alias("verified"),
    )
