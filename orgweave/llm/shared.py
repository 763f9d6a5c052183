"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.plans.settle import discard, materialise, materialise_at, shared_dir, small_batches

__all__ = ["MembershipFilter", "discard", "keep_columns", "let", "materialise", "materialise_at", "null_to_empty", "shared_dir", "small_batches", "spare"]

#: Largest fixed-size membership filter sent to executors, in bits (128 MiB).
MAX_FILTER_BITS = 1 << 30
_BUCKET_BITS = 32768


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in that order, so that extra or clashing columns never meet a join."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def spare(name: str, *frames: DataFrame) -> str:
    """`name`, lengthened until no column of the frames has it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def null_to_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row.

    A column that a lambda refers to may be inlined there by the optimiser and then be computed for every element. (An aggregate over no elements hands
    its start value to its last lambda as it is, where a transform of a one-element array would copy what comes out.)
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


class MembershipFilter:
    """A fixed-size bit table: never misses a member, may let others pass.

    Used only to keep rows out of a shuffle that an exact join follows, so
    a full table costs time, not correctness. Its size follows the number of
    members up to `MAX_FILTER_BITS`.
    """

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @staticmethod
    def build(keys: DataFrame, column: str) -> "MembershipFilter":
        n = keys.count()
        bits = 1 << 20
        while bits < 16 * n and bits < MAX_FILTER_BITS:
            bits *= 2
        slot = F.pmod(F.col(column).cast("long"), F.lit(bits))
        rows = (
            keys.select(slot.alias("s"))
            .groupBy(F.floor(F.col("s") / _BUCKET_BITS).cast("long").alias("b"))
            .agg(F.bitmap_construct_agg(F.pmod(F.col("s"), F.lit(_BUCKET_BITS))).alias("m"))
            .toLocalIterator()
        )
        table = np.zeros(bits // 8, dtype=np.uint8)
        width = _BUCKET_BITS // 8
        for row in rows:  # at most bits / 32768 rows, whatever the input
            table[row["b"] * width : (row["b"] + 1) * width] = np.frombuffer(bytes(row["m"]), dtype=np.uint8)
        return MembershipFilter(bits, table)

    def test(self, keys: np.ndarray) -> np.ndarray:
        """keys: int64. True where the key may be a member."""
        slot = np.mod(keys.astype(np.int64), np.int64(self.bits))
        return (self.table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
