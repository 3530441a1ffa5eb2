"""Scans, sinks and the streaming queue on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pacelens.operators import parse
from pacelens.sources import archive, rosters
from pacelens.streaming import queue


def game(white, moves="1. e4 {[%clk 0:01:00]} e5 1-0"):
    return f'[Event "x"]\n[White "{white}"]\n[Black "b"]\n\n{moves}'


def test_game_scan_splits_and_marks_broken_records(spark, tmp_path):
    body = "\n\n".join([game("Ann"), game("Bo"), '[Event "x"]\n[White "Cy"]\n\n1. d4 *', '[Event "x"]\n[White "D"]\n[Black "e"]']) + "\n"
    (tmp_path / "a.pgn").write_bytes(body.replace("Bo", "B\xff").encode("latin-1"))
    out = archive.read_games(spark, str(tmp_path)).collect()
    assert len(out) == 4
    assert sorted(str(r.malformed) for r in out) == ["None", "None", "no moves", "no players"]
    assert parse.plies(archive.read_games(spark, str(tmp_path)).where("malformed IS NULL")).count() == 4


def test_game_scan_reads_both_line_ends(spark, tmp_path):
    body = "\n\n".join(game(n) for n in ("Ann", "Bo", "Cy")) + "\n"
    for name, text in (("lf", body), ("crlf", body.replace("\n", "\r\n"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.pgn").write_bytes(text.encode())
    one, two = (sorted(r.pgn for r in archive.read_games(spark, str(tmp_path / n)).collect()) for n in ("lf", "crlf"))
    assert len(one) == 3 and one == two


def test_game_limit_holds_per_player(spark):
    rows = [(p, k, "bullet", True, "chess", game(p)) for p in ("a", "b") for k in range(4)]
    games = spark.createDataFrame(rows, "player string, position int, time_class string, rated boolean, rules string, pgn string")
    kept = archive.eligible_games(games, max_games=2, order=("position",)).collect()
    assert sorted((r.player, r.position) for r in kept) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_archives_and_eligibility(spark, tmp_path):
    games = [
        {"time_class": "bullet", "rated": True, "rules": "chess", "pgn": game("Ann")},
        {"time_class": "bullet", "rated": True, "rules": "chess", "pgn": game("Ann", "1. e4 *")},
        {"time_class": "bullet", "rated": False, "rules": "chess", "pgn": game("Ann")},
        {"time_class": "daily", "rated": True, "rules": "chess", "pgn": game("Ann")},
        {"time_class": "bullet", "rated": True, "rules": "chess960", "pgn": game("Ann")},
        {"time_class": "bullet", "rated": True, "rules": "chess"},
    ]
    for month in ("2024-01", "2024-02"):
        (tmp_path / f"month={month}").mkdir()
        (tmp_path / f"month={month}" / "x.json").write_text(json.dumps({"games": games}))
    rows = archive.read_archives(spark, str(tmp_path))
    assert rows.count() == 12
    assert archive.eligible_games(rows).count() == 2
    assert archive.eligible_games(rows, rated_only=False).count() == 4
    first = archive.eligible_games(rows, max_games=1, order=("month", "position")).collect()
    assert [str(r.month) for r in first] == ["2024-01"]
    counts = archive.clockless_count(rows).first()
    assert (counts.n_kept, counts.n_without_clock) == (2, 2)


def test_player_overwrite_leaves_other_players(spark, tmp_path):
    path = str(tmp_path / "features")
    archive.write_by_player(spark.createDataFrame([("a", 1), ("b", 2)], "player string, v int"), path)
    archive.write_by_player(spark.createDataFrame([("a", 5)], "player string, v int"), path)
    assert sorted((r.player, r.v) for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 2)]


def test_documents_and_scripts(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    archive.write_documents(df, str(tmp_path / "d"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "d")).collect()] == [{"a": 1, "b": None}]
    archive.write_script(df, str(tmp_path / "s"), "DATA")
    assert spark.read.text(str(tmp_path / "s")).first().value == 'const DATA = {"a":1,"b":null};'


def test_band_sample_prefers_busy_players(spark):
    stats = spark.createDataFrame([(f"u{i}", 700 + i, 300 + i) for i in range(10)] + [("lazy", 750, 10), ("known", 705, 999)], "username string, rating int, n_games int")
    out = rosters.band_sample(stats, spark.createDataFrame([("known",)], "username string"), per_band=2)
    assert sorted(r.username for r in out.collect()) == ["u8", "u9"]


def test_stream_queue_is_incremental_and_merge_takes_the_last(spark, tmp_path):
    source, out, done = (str(tmp_path / n) for n in ("plies", "queue", "done"))
    schema = "fen_before string"

    def add(*fens):
        spark.createDataFrame([(f,) for f in fens], schema).write.mode("append").parquet(source)

    def run():
        finished = lambda: spark.createDataFrame([("b",)], schema)
        queue.queue_positions(queue.read_stream(spark, source, schema), finished, out, str(tmp_path / "c1")).awaitTermination()

    add("a", "b", "a")
    run()
    add("a", "c", "b")
    run()
    assert sorted((r.fen_before, r.batch) for r in spark.read.parquet(out).collect()) == [("a", 0), ("c", 1)]

    results = "fen_before string, eval_before double"
    for value in (1.0, 2.0):
        spark.createDataFrame([("a", value)], results).write.mode("append").parquet(str(tmp_path / "res"))
        queue.collect_annotations(queue.read_stream(spark, str(tmp_path / "res"), results), done, str(tmp_path / "c2")).awaitTermination()
    merged = queue.merged_annotations(spark, done).collect()
    assert [(r.fen_before, r.eval_before) for r in merged] == [("a", 2.0)]


def test_player_names_compare_caselessly(spark):
    plies = parse.plies(spark.createDataFrame([(game("ANN"),)], "pgn string"))
    view = parse.player_view(plies.withColumn("base_s", F.lit(60.0)), spark.createDataFrame([("ann",)], "player string"))
    assert [(r.player, r.color, r.player_moves_total) for r in view.collect()] == [("ann", "white", 1)]


def test_registry_publishes_whole_versions(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from pacelens.sources import registry

    folder = f"file://{tmp_path}/models"
    first = spark.createDataFrame([("a", 1.0)], "player string, intercept double")
    with pytest.raises(LookupError):
        registry.load(spark, folder)
    assert registry.publish(first, folder) == 1
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["intercept"], outputCol="x")]).fit(first)
    assert registry.publish(first.withColumn("intercept", first.intercept + 1), folder, {"trees": fitted}) == 2
    first.write.parquet(f"{folder}/00000003-unnamed/coefficients")  # a writer that died before naming its version
    fresh = spark.newSession()
    assert [registry.load(fresh, folder, v).first().intercept for v in (None, 1, 2)] == [2.0, 1.0, 2.0]
    assert registry.load_pipeline(fresh, folder, "trees").transform(first).first().x[0] == 1.0
    with pytest.raises(LookupError):
        registry.load(spark, folder, 3)
