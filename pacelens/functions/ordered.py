"""Ordered computations per key that survive a key holding most of the rows.

``Window.partitionBy(player)`` puts one player's whole history into one task.
Here the rows are first cut into blocks that respect the order; each task works
inside a (key, block) group, and a tiny per-block summary carries counts, sums,
maxima and last values from the earlier blocks of the same key.

Blocks come from one of two sources:

* ``range_blocks`` - Spark's own range partitioning over (keys, order).  It
  balances any skew because the order ends in a unique column, and the numbered
  result is stored so that both uses of it see the same cut.
* ``hash_blocks`` - when the order *is* a 32-bit hash, its leading bits are
  already a balanced, order-preserving block number; nothing has to be stored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelens.functions.storage import materialise

BLOCK = "_block"


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut ``df`` into balanced blocks that are contiguous in (keys, order)."""
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return materialise(ranged.withColumn(BLOCK, F.spark_partition_id()))


def hash_blocks(df: DataFrame, hash_column: str, bits: int = 10) -> DataFrame:
    """Block by the leading bits of an unsigned 32-bit hash column."""
    return df.withColumn(BLOCK, F.shiftright(F.col(hash_column), 32 - bits).cast("int"))


def sized_slices(df: DataFrame, keys: Sequence[str], spread_by: Sequence[str], rows_per_slice: int) -> DataFrame:
    """Lay rows out by (keys, slice), a key having as many slices as its size asks for.

    A small key is one slice; a key with most of the rows is spread over tasks of
    ``rows_per_slice`` rows, whatever its share."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_key_rows"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = df.join(counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_key_rows"), same).drop(*[f"_k_{k}" for k in keys])
    parts = F.ceil(F.col("_key_rows") / F.lit(rows_per_slice))
    cut = joined.withColumn("_slice", F.pmod(F.xxhash64(*spread_by), parts)).drop("_key_rows")
    return cut.repartition(*keys, "_slice").drop("_slice")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    size: str | None = None,
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running columns per key to a blocked frame, in ascending ``order``.

    ``number`` - 1-based position; ``size`` - rows per key; ``sums`` - inclusive
    running sums; ``totals`` - sums over the whole key; ``maxima`` - inclusive
    running maxima; ``previous`` - value of a column one row earlier.
    """
    sums, totals = dict(sums or {}), dict(totals or {})
    maxima, previous = dict(maxima or {}), dict(previous or {})
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local = {"_n_local": F.row_number().over(inside)}
    local |= {f"_sum_{c}": F.sum(e).over(so_far) for c, e in sums.items()}
    local |= {f"_max_{c}": F.max(e).over(so_far) for c, e in maxima.items()}
    local |= {f"_prev_{c}": F.lag(source).over(inside) for c, source in previous.items()}

    summary = df.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(e).alias(f"_s_{c}") for c, e in sums.items()],
        *[F.sum(e).alias(f"_t_{c}") for c, e in totals.items()],
        *[F.max(e).alias(f"_m_{c}") for c, e in maxima.items()],
        *[F.max_by(F.struct(F.col(s).alias("v")), F.struct(*order)).alias(f"_l_{c}") for c, s in previous.items()],
    )
    per_key = Window.partitionBy(*keys).orderBy(BLOCK)
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(BLOCK).alias("_carry_block"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_n_before"),
        F.sum("_rows").over(whole).alias("_n_key"),
        *[F.sum(f"_s_{c}").over(before).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"_total_{c}") for c in totals],
        *[F.max(f"_m_{c}").over(before).alias(f"_top_{c}") for c in maxima],
        *[F.lag(f"_l_{c}").over(per_key).alias(f"_last_{c}") for c in previous],
    )
    same = F.col(BLOCK) == F.col("_carry_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = df.withColumns(local).join(carried, same)

    out = [F.col(c) for c in df.columns if c != BLOCK]
    if number:
        out.append((F.col("_n_before") + F.col("_n_local")).cast("bigint").alias(number))
    if size:
        out.append(F.col("_n_key").alias(size))
    for c in sums:
        out.append(
            F.when(
                F.col(f"_sum_{c}").isNotNull() | F.col(f"_before_{c}").isNotNull(),
                F.coalesce(F.col(f"_sum_{c}"), F.lit(0)) + F.coalesce(F.col(f"_before_{c}"), F.lit(0)),
            ).alias(c)
        )
    out += [F.col(f"_total_{c}").alias(c) for c in totals]
    out += [F.greatest(f"_max_{c}", f"_top_{c}").alias(c) for c in maxima]
    for c in previous:
        out.append(
            F.when(F.col("_n_local") > 1, F.col(f"_prev_{c}")).otherwise(F.col(f"_last_{c}")["v"]).alias(c)
        )
    return joined.select(*out)


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], **columns) -> DataFrame:
    """``running`` over freshly cut range blocks."""
    return running(range_blocks(df, keys, order), keys, order, **columns)
