"""Tree ensembles and cross-fitted regressions for many models, against direct computations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pacelens.operators import ident, logistic, trees


def blobs(classes: int, n: int, width: int = 6, seed: int = 0):
    rng = np.random.default_rng(seed)
    centres, y = rng.normal(size=(classes, width)) * 2, rng.integers(0, classes, n)
    x = centres[y] + rng.normal(size=(n, width))
    x[rng.random(x.shape) < 0.02] = np.nan
    return pd.DataFrame(x, columns=[f"x{i}" for i in range(width)]).assign(player=y, game_id=np.arange(n)), (((np.nan_to_num(x)[:, None] - centres[None]) ** 2).sum(axis=-1).argmin(axis=1) == y).mean()


def prepared(spark, data, folds: int, group=0):
    columns = [c for c in data.columns if c.startswith("x")]
    rows = spark.createDataFrame(data).select("player", "game_id", F.lit(group).alias("_group"), (F.col("game_id") % folds).cast("int").alias("_fold"), F.col("player").cast("int").alias("_label"), F.lit(1.0).alias("_weight"), F.struct("player", "game_id").alias("_row"), *columns)
    return trees.binned(rows, columns, trees.edges(rows, columns)), columns


@pytest.mark.parametrize("shape", [{"rounds": 12, "depth": 4}, {"copies": 24, "depth": 7, "share": 0.5}])
def test_trees_tell_many_classes_apart(spark, shape):
    """Thirty classes, more than the sketch has dimensions, near what the true centres give."""
    data, best = blobs(30, 3000)
    rows, columns = prepared(spark, data, 3)
    model = trees.grow(rows, 1, 30, 3, len(columns), **shape)
    held = trees.held_out(rows, model, len(columns)).toPandas()
    p = np.stack(held.p)
    assert len(held) == 3000 and p.sum(axis=1) == pytest.approx(1.0)
    assert (p.argmax(axis=1) == held._label).mean() > 0.75 * best


def test_first_split_and_leaves_are_the_best_ones(spark):
    """One round of one level against all splits tried one by one."""
    data, _ = blobs(3, 400, width=3, seed=2)
    rows, columns = prepared(spark, data, 2)
    model = trees.grow(rows, 1, 3, 2, 3, rounds=1, depth=1, rate=1.0)
    stored = rows.toPandas()
    x = np.array([np.frombuffer(b, np.uint8) for b in stored._x])
    for out in range(2):
        own = (stored._fold != out).to_numpy()
        xs, hot = x[own], np.eye(3)[stored._label[own]]
        g = hot - 1 / 3
        value = lambda s: (s[:2] ** 2).sum() / (s[2] + trees.RIDGE)  # noqa: E731, B023
        total = np.r_[g[:, :2].sum(axis=0), len(g)]
        gains = {}
        for f in range(3):
            for b in range(1, trees.BINS):
                left = xs[:, f] <= b
                if 2 <= left.sum() <= len(left) - 2:
                    s = np.r_[g[left, :2].sum(axis=0), left.sum()]
                    gains[f, b] = value(s) + value(total - s) - value(total)
        f, b = int(model.feature[out, 0, 0]), int(model.split[out, 0, 0])
        assert gains[f, b] == pytest.approx(max(gains.values()))
        left = xs[:, f] <= b
        for leaf, at in enumerate((left, ~left)):
            assert model.leaf[out, 0, leaf] == pytest.approx(g[at].sum(axis=0) / (at.sum() * 2 / 9 + trees.RIDGE), rel=1e-5)


def test_shuffled_and_collected_sums_agree(spark, monkeypatch):
    data, _ = blobs(12, 600, seed=3)
    rows, columns = prepared(spark, data, 3)
    one = trees.grow(rows, 1, 12, 3, len(columns), rounds=2, depth=2)
    monkeypatch.setattr(trees, "COLLECTED_BYTES", 0)
    monkeypatch.setattr(trees, "HELD_BYTES", 1)
    two = trees.grow(rows, 1, 12, 3, len(columns), rounds=2, depth=2)
    assert (one.feature == two.feature).all() and (one.split == two.split).all() and one.leaf == pytest.approx(two.leaf, abs=1e-6)


def test_groups_do_not_see_each_other(spark):
    """Two groups grown together equal each grown alone."""
    parts = [blobs(2, 300, seed=s)[0] for s in (4, 5)]
    together = None
    columns = [f"x{i}" for i in range(6)]
    for g, data in enumerate(parts):
        one = spark.createDataFrame(data).select("player", "game_id", F.lit(g).alias("_group"), (F.col("game_id") % 2).cast("int").alias("_fold"), F.col("player").cast("int").alias("_label"), F.lit(1.0).alias("_weight"), F.struct("player", "game_id").alias("_row"), *columns)
        together = one if together is None else together.unionByName(one)
    cuts = trees.edges(together, columns)
    both = trees.grow(trees.binned(together, columns, cuts), 2, 2, 2, 6, rounds=2, depth=3)
    for g in range(2):
        alone = trees.grow(trees.binned(together.where(F.col("_group") == g).withColumn("_group", F.lit(0)), columns, cuts), 1, 2, 2, 6, rounds=2, depth=3)
        assert (both.feature[2 * g : 2 * g + 2] == alone.feature).all() and both.leaf[2 * g : 2 * g + 2] == pytest.approx(alone.leaf, abs=1e-6)


def test_boosting_joins_the_other_families_beyond_ten_classes(spark):
    data, best = blobs(14, 900, seed=6)
    columns = [f"x{i}" for i in range(6)]
    filled = spark.createDataFrame(data.fillna(0.0)).withColumn("fold", (F.col("game_id") % 2).cast("int"))
    held = ident.out_of_fold(filled, columns, ("logistic", "boosting"), compact=True)
    rated = {r.family: r for r in ident.accuracy(ident.predictions(held, ("family", *ident.GAME)), ("family",)).collect()}
    assert set(rated) == {"logistic", "boosting"}
    assert all(r.n_games_total == 900 and r.n_classes == 14 and r.overall_accuracy > 0.7 * best for r in rated.values())


def test_rows_and_arrays_of_scores_agree(spark):
    rng = np.random.default_rng(7)
    rows = [(f"p{g % 4}", g, f"p{c}", float(round(rng.random(), 1))) for g in range(60) for c in range(4)]
    long = spark.createDataFrame(rows, "player string, game_id int, class string, p double")
    compact = ident.packed(long).drop("classes")
    plain = lambda df: sorted((tuple(r.asDict().items()) for r in df.collect()), key=repr)
    for f in (ident.predictions, ident.rank_of_true, ident.rank_k, ident.stored_scores, lambda s: ident.fuse(s, (1, 3, 20)), ident.unpacked):
        a, b = f(long), f(compact)
        assert plain(a) == plain(b.select(*a.columns))
    assert plain(ident.unpacked(compact).select(*long.columns)) == plain(long)


@pytest.mark.parametrize("per_slice", [1000, 37])
@pytest.mark.parametrize("standardised", [False, True])
def test_cross_fitting_equals_fits_without_the_fold(spark, per_slice, standardised):
    """Keys of one slice and of many, scaled or not, missing values and a null key included."""
    rng = np.random.default_rng(8)
    rows = [(p, g, int(g % 3), float(a), None if g % 17 == 0 else float(b * 30 + 5), bool(a + b + e > 0)) for p in ("a", "b", None) for g in range(150) for a, b, e in [rng.normal(size=3)]]
    frame = spark.createDataFrame(rows, "player string, game_id int, fold int, x0 double, x1 double, y boolean")
    got = {(r.player, r.fold): (r.coef, r.moved) for r in logistic.cross_fitted(frame, ["player"], ["x0", "x1"], "y", 3, rows_per_slice=per_slice, standardised=standardised).collect()}
    assert len(got) == 9
    for (player, fold), (coef, moved) in got.items():
        own = [r for r in rows if r[0] == player and r[2] != fold]
        x, y = np.array([[r[3], np.nan if r[4] is None else r[4]] for r in own], dtype=float), np.array([r[5] for r in own], dtype=float)
        mean, sd = (np.nanmean(x, axis=0), np.nanstd(x, axis=0)) if standardised else (np.zeros(2), np.ones(2))
        z = np.column_stack([np.ones(len(x)), np.nan_to_num((x - mean) / sd)])
        w = np.r_[0.0, np.array(coef[1:]) * sd]
        w[0] = coef[0] + (np.array(coef[1:]) * mean).sum()
        p = 1 / (1 + np.exp(-z @ w))
        assert z.T @ (y - p) - np.r_[0.0, w[1:]] == pytest.approx(np.zeros(3), abs=1e-4) and moved < logistic.SETTLED


def test_rows_are_placed_by_columns_and_worked_on_in_large_batches():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 33, size=(500, 6)).astype(np.uint8)
    for depth in (1, 3, 9):
        model = trees.Ensemble.empty(1, 3, 1, depth, 0.3, 1)
        model.feature = rng.integers(-1, 6, size=(1, 2, 2**depth - 1)).astype(np.int16)
        model.split = rng.integers(0, 33, size=model.feature.shape).astype(np.uint8)
        model.leaf = rng.normal(size=(1, 2, 2**depth, 3)).astype(np.float32)
        for tree in range(2):
            plain = []
            for row in x:
                node = 0
                for _ in range(depth):
                    f = model.feature[0, tree, node]
                    node = 2 * node + 1 + int(f >= 0 and row[f] > model.split[0, tree, node])
                plain.append(node - (2**depth - 1))
            assert model.laid(0, tree, np.ascontiguousarray(x.T)).tolist() == plain
            assert model.place(0, tree, x).tolist() == plain
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array([r.tobytes() for r in x], kind)
        batches = [pa.RecordBatch.from_arrays([column.slice(at, 7)], names=["_x"]) for at in range(0, len(x), 7)]
        assert (trees.binned_rows(column.slice(3, 11), 6) == x[3:14]).all()
        joined = list(trees.gathered(iter(batches), 6))
        assert len(joined) == 1 and (trees.binned_rows(joined[0].column(0), 6) == x).all()
    assert [b.num_rows for b in trees.gathered(iter(batches), trees.WORKED_BYTES // 100)] == [105, 105, 105, 105, 80]
