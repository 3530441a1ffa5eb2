"""Exact statistics that stay distributed and tolerate hot keys.

Spark's ``percentile`` keeps every distinct value of a group in one task.  The
frame-level helpers here count each distinct value first (combined map-side).
Ranks then take running counts over range blocks, quantiles narrow the few wanted
positions down, so a group of any size is spread.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelens.functions.nulls import ratio
from pacelens.functions.ordered import hash_blocks, ordered, running
from pacelens.functions.shipping import ship
from pacelens.functions.storage import materialise

KEY_VALUES = 1_000_000  #: values of a key that one task may order
MARKS = 63  #: cuts of a segment in a round of rank selection
SLICES = 16  #: tasks a key's rows are dealt over in a spread join


def mean_where(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def share(condition: Column) -> Column:
    """Share of rows meeting a condition; rows where it is NULL do not count."""
    return F.avg(condition.cast("double"))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the complete pairs, NULL when either side is constant.

    Built from central moments: the plain ``corr`` raises on a constant group
    under ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (key, distinct value), NULL and NaN left out."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_weight"))


def spread_join(df: DataFrame, per_key: DataFrame, keys: Sequence[str], slices: int = SLICES) -> DataFrame:
    """Inner join of rows with small per-key rows, a key's rows being dealt over ``slices`` tasks.

    The per-key rows are repeated for every slice, so an aggregate on the key behind the
    join starts from partial results of all slices, however many rows the key holds.
    Null keys meet null keys."""
    names = {k: f"_k_{i}" for i, k in enumerate(keys)}
    copies = per_key.select(
        *[F.col(k).alias(n) for k, n in names.items()],
        *[c for c in per_key.columns if c not in names],
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_copy"),
    )
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)).cast("int"))
    same = F.col("_slice") == F.col("_copy")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return dealt.join(copies, same).drop("_slice", "_copy", *names.values())


def _at_positions(counted: DataFrame, segment: Sequence[str]) -> DataFrame:
    """``counted`` with the weight before each value of its segment; a segment fits one task."""
    before = Window.partitionBy(*segment).orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_before", F.coalesce(F.sum("_weight").over(before), F.lit(0)))


def select_ranks(counted: DataFrame, keys: Sequence[str], wanted: DataFrame, most: int) -> DataFrame:
    """(keys, _pos, _value): the value at each wanted 0-based position of its key.

    ``counted`` holds distinct values with weights, ``wanted`` (keys, _pos).  A segment is
    an open interval of values of a key.  A segment of more than ``most`` values is cut
    at marks that a mergeable sketch proposes; exact weights of the marks and of the
    intervals between them say where each position lies.  A position on a mark is
    found, the others go on in their interval, which holds about 1 / ``MARKS`` of the
    values.  So the marks only decide how fast the segments shrink, never the result."""
    keys = list(keys)
    segment = [*keys, "_low", "_high"]
    bound = F.lit(None).cast("double")
    inside = (F.col("_low").isNull() | (F.col("_value") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_value") < F.col("_high")))
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values"))
    active = wanted.select(*keys, "_pos", bound.alias("_low"), bound.alias("_high"), F.lit(0).cast("bigint").alias("_below"))
    active = materialise(spread_join(active, sizes, keys, 1))
    found = []
    while True:
        found.append(active.where("_high <= _low").select(*keys, "_pos", F.col("_low").alias("_value")))
        active = active.where("_low is null or _high is null or _low < _high")
        large = active.where(F.col("_values") > most)
        if large.isEmpty():
            break
        rows = spread_join(counted, large.select(*segment).distinct(), keys).where(inside)
        points = F.array(*[F.lit((i + 1) / (MARKS + 1)) for i in range(MARKS)])
        marks = F.array_sort(F.array_distinct(F.percentile_approx("_value", points, F.lit(20 * MARKS))))
        cuts = materialise(rows.groupBy(*segment).agg(marks.alias("_marks")))
        less = F.aggregate("_marks", F.lit(0), lambda n, m: n + F.when(m < F.col("_value"), 1).otherwise(0))
        placed = spread_join(counted, cuts, keys).where(inside).withColumn("_cell", less)
        on_mark = F.coalesce(F.get("_marks", F.col("_cell")) == F.col("_value"), F.lit(False))
        cells = placed.groupBy(*segment, "_cell", on_mark.alias("_mark")).agg(
            F.sum("_weight").alias("_weight"), F.count(F.lit(1)).alias("_n"),
            F.max(F.when(on_mark, F.col("_value")).otherwise(F.coalesce(F.get("_marks", F.col("_cell") - 1), F.col("_low")))).alias("_left"),
            F.max(F.when(on_mark, F.col("_value")).otherwise(F.coalesce(F.get("_marks", F.col("_cell")), F.col("_high")))).alias("_right"),
        )
        order = Window.partitionBy(*segment).orderBy("_cell", "_mark").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_before", F.coalesce(F.sum("_weight").over(order), F.lit(0)))
        both = spread_join(large.drop("_values"), cells, segment, 1)
        start = F.col("_below") + F.col("_before")
        narrowed = both.where((F.col("_pos") >= start) & (F.col("_pos") < start + F.col("_weight"))).select(
            *keys, "_pos", F.col("_left").alias("_low"), F.col("_right").alias("_high"), start.alias("_below"), F.col("_n").alias("_values")
        )
        active = materialise(active.where(F.col("_values") <= most).unionByName(narrowed))
    rows = spread_join(counted, active.select(*segment).distinct(), keys).where(inside)
    ends = spread_join(active, _at_positions(rows, segment), segment, 1)
    start = F.col("_below") + F.col("_before")
    result = ends.where((F.col("_pos") >= start) & (F.col("_pos") < start + F.col("_weight"))).select(*keys, "_pos", "_value")
    for part in found:
        result = result.unionByName(part)
    return result


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "quantiles") -> DataFrame:
    """Exact linearly interpolated quantiles per key, as one array column.

    The frame is read once: its distinct values per key are stored with their weights,
    unsorted.  Where no key has more than ``KEY_VALUES`` of them one window a key orders
    them; beyond that ``select_ranks`` narrows the wanted ranks alone."""
    keys = list(keys)
    counted = materialise(value_counts(df, keys, value))
    largest = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    position = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    if (largest or 0) <= KEY_VALUES:
        totals = counted.groupBy(*keys).agg(F.sum("_weight").alias("_total"))
        upto = Window.partitionBy(*keys).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = spread_join(counted.withColumn("_upto", F.sum("_weight").over(upto)), totals, keys, 1)
        here = lambda x: (F.col("_upto") - F.col("_weight") <= x) & (x < F.col("_upto"))
        at = lambda x: F.max(F.when(here(x), F.col("_value")))
    else:
        totals = materialise(counted.groupBy(*keys).agg(F.sum("_weight").alias("_total")))
        ranks = F.array_distinct(F.array(*[f(position(p)).cast("bigint") for p in probs for f in (F.floor, F.ceil)]))
        chosen = select_ranks(counted, keys, totals.select(*keys, F.explode(ranks).alias("_pos")), KEY_VALUES)
        counted = spread_join(chosen, totals, keys, 1)
        at = lambda x: F.max(F.when(F.col("_pos") == x, F.col("_value")))

    picks, answers = [], []
    for i, p in enumerate(probs):
        spot = position(p)
        picks += [at(F.floor(spot)).alias(f"_lo{i}"), at(F.ceil(spot)).alias(f"_hi{i}"), F.max(spot - F.floor(spot)).alias(f"_t{i}")]
        answers.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_t{i}"))
    return counted.groupBy(*keys).agg(*picks).select(*keys, F.array(*answers).alias(name))


def quantile_edges(df: DataFrame, keys: Sequence[str], value: str, bins: int, name: str = "edges") -> DataFrame:
    """Bin edges at equal probabilities, duplicates dropped."""
    probs = [i / bins for i in range(bins + 1)]
    found = quantiles(df, keys, value, probs, "_edges")
    return found.select(*keys, F.array_distinct("_edges").alias(name))


def bin_of(value: Column, edges: Column) -> Column:
    """0-based bin for right-closed intervals; NULL when no interval exists."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    code = F.aggregate(inner, F.lit(0), lambda n, edge: n + F.when(value > edge, 1).otherwise(0))
    return F.when((F.size(edges) >= 2) & value.isNotNull(), code)


def join_per_key(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Attach one row per key; a global table (no keys) attaches through a scalar subquery."""
    if keys:
        return df.join(per_key, list(keys), how)
    fields = per_key.columns
    one = per_key.select(F.struct(*fields).alias("_one")).scalar()
    return df.withColumn("_one", one).select(
        *df.columns, *[F.col("_one")[c].alias(c) for c in fields]
    )


def qcut(df: DataFrame, keys: Sequence[str], value: str, bins: int, name: str) -> DataFrame:
    """Add the quantile bin of ``value`` within its key."""
    edges = quantile_edges(df, keys, value, bins, "_edges")
    return join_per_key(df, edges, keys).withColumn(
        name, bin_of(F.col(value).cast("double"), F.col("_edges"))
    ).drop("_edges")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank of each distinct value within its key: columns keys, _value, rank."""
    counted = ordered(
        value_counts(df, keys, value), keys, ["_value"], sums={"_upto": F.col("_weight")}
    )
    middle = F.col("_upto") - F.col("_weight") + (F.col("_weight") + 1) / 2
    return counted.select(*keys, "_value", middle.alias(name))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """Rank correlation per key over complete pairs, NULL for a constant side.

    Works on counts of distinct (x, y) pairs, so repeated values cost nothing.
    """
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    )
    rx = average_ranks(pairs, keys, "_x", "_rx").withColumnRenamed("_value", "_x")
    ry = average_ranks(pairs, keys, "_y", "_ry").withColumnRenamed("_value", "_y")
    ranked = (
        pairs.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
        .join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"])
    )
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("_n"), F.sum(w * a).alias("_a"), F.sum(w * b).alias("_b"),
        F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"),
    )
    n = F.col("_n")
    spread_a = n * F.col("_aa") - F.col("_a") * F.col("_a")
    spread_b = n * F.col("_bb") - F.col("_b") * F.col("_b")
    value = ratio(n * F.col("_ab") - F.col("_a") * F.col("_b"), F.sqrt(spread_a) * F.sqrt(spread_b))
    return sums.select(*keys, value.alias(name))


def _edges(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of equal keys, and where one of equal keys and scores begins, in rows ordered by them."""
    edge = np.zeros(len(table), dtype=bool)
    edge[0] = True
    for i in range(keys):
        c = table.column(i).combine_chunks()
        equal, empty = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False), pc.is_null(c).to_numpy(zero_copy_only=False)
        edge[1:] |= ~(equal | (empty[1:] & empty[:-1]))
    score = table.column(keys).to_numpy()
    return edge, edge | np.append(True, (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1])))


def _run_sums(table: pa.Table, keys: int, classes: int, edge: np.ndarray, new: np.ndarray) -> list[np.ndarray]:
    """(first row, negatives, positives and wins by class) of each run of equal keys."""
    which, n = table.column(keys + 1).to_numpy(), table.column(keys + 2).to_numpy()
    first, start = np.flatnonzero(edge), np.flatnonzero(new)
    run, tie = np.cumsum(edge) - 1, np.cumsum(new) - 1
    negative = np.where(which < 0, n, 0)
    equal = np.add.reduceat(negative, start)
    before = np.cumsum(equal) - equal
    before -= before[tie[first]][run[start]]
    code, own, wins = run * classes + which, which >= 0, n * (before + equal / 2)[tie]
    sums = lambda w: np.bincount(code[own], weights=w[own], minlength=len(first) * classes).reshape(len(first), classes)
    return [first, np.add.reduceat(negative, first), sums(n).astype(np.int64), sums(wins).astype(float)]


def rank_sums(df: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """keys, ``_negatives``, and by class ``_positives`` and ``_wins`` over the negatives (ties count half).

    ``df`` has the keys, ``_score`` and ``_class``: -1 for a negative, else the class of a positive, all of them
    ranked among the same negatives.  Equal scores are counted first; the counts are dealt in order of their scores,
    a task adds up its own range, and what it lacks is the negatives of the ranges before it."""
    ship(df.sparkSession)
    keys = list(keys)
    counted = df.where("_score IS NOT NULL AND _class IS NOT NULL").groupBy(*keys, "_score", "_class").agg(F.count(F.lit(1)).alias("_n"))
    names = [f"_key{i}" for i in range(len(keys))]
    dealt = counted.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_score", F.col("_class").cast("int").alias("_class"), "_n")
    laid = dealt.repartitionByRange(*names, "_score").sortWithinPartitions(*names, "_score").withColumn("_block", F.spark_partition_id())
    wide = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(table: pa.Table, edge: np.ndarray, new: np.ndarray, number: int) -> pa.RecordBatch:
            first, negatives, positives, wins = _run_sums(table, wide, classes, edge, new)
            at = pa.array(first)
            heads = [table.column(i).combine_chunks().take(at) for i in [*range(wide), wide + 3]]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, classes), pa.int32()), pa.array(x.ravel())) for x in (positives, wins)]
            return pa.RecordBatch.from_arrays([*heads, pa.array(np.full(len(first), number)), pa.array(negatives), *lists], names=[*names, "_block", "_at", "_neg", "_pos", "_won"])

        held, number = None, 0
        for number, batch in enumerate(batches):
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if not len(table):
                continue
            # the last score waits for the next batch, which may have more of its classes
            edge, new = _edges(table, wide)
            last = int(np.flatnonzero(new)[-1])
            held = table.slice(last)
            if last:
                yield added(table.slice(0, last), edge[:last], new[:last], number)
        if held is not None:
            yield added(held, *_edges(held, wide), number + 1)

    head = ", ".join(f"{n} {dealt.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{head + ', ' if head else ''}_block int, _at long, _neg long, _pos array<long>, _won array<double>"
    parts = laid.mapInArrow(run, schema)
    earlier = Window.partitionBy(*names).orderBy("_block", "_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_neg").over(earlier), F.lit(0)))
    sums = [F.sum(F.col("_pos")[i]).alias(f"_p{i}") for i in range(classes)] + [F.sum(F.col("_won")[i] + F.col("_pos")[i] * F.col("_before")).alias(f"_w{i}") for i in range(classes)]
    whole = parts.groupBy(*names).agg(F.sum("_neg").alias("_negatives"), *sums)
    every = lambda c, name: F.array(*[F.col(f"{c}{i}") for i in range(classes)]).alias(name)
    return whole.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "_negatives", every("_p", "_positives"), every("_w", "_wins"))


def auc(df: DataFrame, keys: Sequence[str], label: str, score: str, name: str = "auc") -> DataFrame:
    """Area under the ROC curve per key (rank-sum form, ties count half).

    ``label`` is boolean.  NULL when a key has only one class.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    rows = known.select(*keys, F.col(score).cast("double").alias("_score"), (F.col(label).cast("int") - 1).alias("_class"))
    return rank_sums(rows, keys, 1).select(*keys, ratio(F.col("_wins")[0], F.col("_positives")[0] * F.col("_negatives")).alias(name))


def hash_rank(df: DataFrame, keys: Sequence[str], hashed: Column, tie: Sequence[str], name: str) -> DataFrame:
    """1-based position of each row within its key in hash order; balanced for hot keys."""
    blocked = hash_blocks(df.withColumn("_hash", hashed.cast("bigint")), "_hash")
    return running(blocked, keys, ["_hash", *tie], number=name).drop("_hash")
