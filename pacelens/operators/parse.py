"""From game archives to the two-sided ply table and the tracked player's view.

Text is taken apart with JVM regular expressions and higher-order functions; no
board is replayed.  All moves of a game stand in one record, so ``plies`` fills clocks,
opponent times, recaptures and castling forward over the moves of a batch of records,
laid back to back: no shuffle, a cost per ply that does not grow with the length of a
game, and a record that occurs twice cannot mix with its copy.
The frame functions (``think_times``, ...) do the same as windows, for tables whose
plies arrive one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelens.functions.nulls import truthy
from pacelens.functions.shipping import ship

# What counts as a premove and as a lag spike.
PREMOVE_SECONDS = 0.12
LAG_MULTIPLE = 0.6

# Text formats of clock tags, header lines and move tokens.
CLOCK_TAG = r"\[%clk\s+(\d+):(\d+):(\d+(?:\.\d+)?)\]"
HEADER_LINE = r'\[(\w+)\s+"([^"]*)"\]'
SAN = r"(?:[NBRQK]?[a-h]?[1-8]?x?[a-h][1-8](?:=?[NBRQ])?|O-O-O|O-O|0-0-0|0-0)[+#]?"
MOVE_TOKEN = rf"(?<![\w=])({SAN})(?![\w-])[!?]*\s*(?:\$\d+\s*)*((?:\{{[^}}]*\}}\s*)*)"


def clock_seconds(comment: Column) -> Column:
    """Remaining seconds of a clock tag; NULL without one."""
    part = lambda i: F.nullif(F.regexp_extract(comment, CLOCK_TAG, i), F.lit("")).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def time_control_base(text: Column) -> Column:
    """Base seconds; NULL for correspondence or unreadable controls."""
    pieces = F.split(text, r"\+")
    base = F.when(F.size(pieces) <= 2, F.element_at(pieces, 1).try_cast("double"))
    whole = (F.size(pieces) == 1) | F.try_element_at(pieces, F.lit(2)).try_cast("double").isNotNull()
    return F.when(~text.contains("/") & whole, base)


def time_control_increment(text: Column) -> Column:
    """Increment seconds; 0 when omitted or unreadable."""
    increment = F.try_element_at(F.split(text, r"\+"), F.lit(2)).try_cast("double")
    return F.coalesce(F.when(time_control_base(text).isNotNull(), increment), F.lit(0.0))


def game_identifier(link: Column, site: Column, date: Column, time: Column, white: Column) -> Column:
    """Tail of the game's address, else date, time and white player."""
    tail = lambda address: F.substring_index(F.regexp_replace(address, "/+$", ""), "/", -1)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return (
        F.when(blank(link) != "", tail(link))
        .when(blank(site).startswith("http"), tail(site))
        .otherwise(F.concat_ws("_", blank(date), blank(time), blank(white)))
    )


def header_map(pgn: Column) -> Column:
    """Header lines as a map; the last of repeated keys counts."""
    head = F.substring_index(pgn, "\n\n", 1)
    names = F.regexp_extract_all(head, F.lit(HEADER_LINE), 1)
    values = F.regexp_extract_all(head, F.lit(HEADER_LINE), 2)
    entries = F.arrays_zip(names.alias("k"), values.alias("v"))
    later = lambda e, i: F.array_contains(F.slice(names, i + 2, F.size(names)), e["k"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def source_tag(link: Column) -> Column:
    """Which site wrote the game: only one of them sets the link header."""
    return F.when(F.coalesce(link, F.lit("")) != "", "chesscom").otherwise("lichess")


def headers(games: DataFrame, pgn: str = "pgn") -> DataFrame:
    """One row per game with its header columns."""
    h = lambda name: F.try_element_at(F.col("_headers"), F.lit(name))
    return (
        games.withColumn("_headers", header_map(F.col(pgn)))
        .withColumns(
            {
                "game_id": game_identifier(h("Link"), h("Site"), h("UTCDate"), h("UTCTime"), h("White")),
                "source": source_tag(h("Link")),
                "date": h("UTCDate"),
                "utc_time": h("UTCTime"),
                "white": F.coalesce(h("White"), F.lit("")),
                "black": F.coalesce(h("Black"), F.lit("")),
                "white_rating": h("WhiteElo").try_cast("double"),
                "black_rating": h("BlackElo").try_cast("double"),
                "result": h("Result"),
                "eco": h("ECO"),
                "opening": h("Opening"),
                "time_control": h("TimeControl"),
                "base_s": time_control_base(h("TimeControl")),
                "increment_s": time_control_increment(h("TimeControl")),
            }
        )
        .drop("_headers")
    )


#: Pieces of move text that side lines are cut out of: comments, brackets and what lies between them.
PIECES = r"\{[^}]*\}|[()]|[^(){}]+|[{}]"


def outside_brackets(pieces: pa.Array) -> pa.Array:
    """The pieces of each list that stand in no bracket, in one scan over all lists; a bracket closed too often is ignored."""
    flat, sizes = pieces.flatten(), np.diff(pieces.offsets.to_numpy())
    opened, closed = (pc.fill_null(pc.equal(flat, c), False).to_numpy(zero_copy_only=False) for c in "()")
    segment = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    steps = opened.astype(np.int64) - closed
    level = np.cumsum(steps)
    level -= (level - steps)[np.minimum(starts, max(len(steps) - 1, 0))][segment] if len(steps) else 0
    far = 2 * len(steps) + 1  # keeps a running minimum inside its own list
    lowest = np.minimum.accumulate(level - segment * far) + segment * far
    depth = level - np.minimum(lowest, 0)
    kept = (depth == 0) & ~closed
    counts = np.bincount(segment[kept], minlength=len(sizes))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), flat.filter(pa.array(kept)))


def tokens_of(games: DataFrame, pgn: str, others: dict[str, Column]) -> DataFrame:
    """The columns ``others`` of each game and ``tokens``, its main line's moves (san, comment) in order."""
    text = F.regexp_replace(F.regexp_replace(F.col(pgn), r"^(?:\s*\[[^\n]*\]\s*\n)+", ""), r"\{(?![^}]*%clk)[^}]*\}", " ")
    pieces = F.when(text.contains("("), F.regexp_extract_all(text, F.lit(PIECES), 0)).otherwise(F.array(text))
    held = games.select(F.struct(*[c.alias(n) for n, c in others.items()]).alias("_k"), F.coalesce(pieces, F.array().cast("array<string>")).alias("_pieces"))
    schema = T.StructType([held.schema["_k"], held.schema["_pieces"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), outside_brackets(batch.column(1))], names=["_k", "_pieces"])

    ship(games.sparkSession)
    found = F.regexp_extract_all(F.array_join("_pieces", " "), F.lit(MOVE_TOKEN), 0)
    after = lambda x: F.when(F.instr(x, "{") > 0, x.substr(F.instr(x, "{"), F.length(x))).otherwise("")
    tokens = F.transform(found, lambda x: F.struct(F.regexp_extract(x, rf"^({SAN})(?![\w-])", 1).alias("san"), after(x).alias("comment")))
    return held.mapInArrow(cut, schema).select("_k.*", tokens.alias("tokens"))


def move_tokens(games: DataFrame, pgn: str = "pgn") -> DataFrame:
    """One row per ply: its number, move text and clock comment."""
    kept = [c for c in games.columns if c != pgn]
    found = tokens_of(games, pgn, {c: F.col(c) for c in kept})
    return found.select(*kept, F.posexplode("tokens").alias("ply", "_m")).select(
        *kept, "ply", F.col("_m.san").alias("move_san"), F.col("_m.comment").alias("comment")
    )


def facts_of(s: Column) -> dict[str, Column]:
    """What a move's text itself says: capture, check, target, castling, promotion."""
    plain = F.regexp_replace(s, "[+#]", "")
    return {
        "is_capture": s.contains("x"),
        "gives_check": s.rlike("[+#]"),
        "to_square": F.nullif(F.regexp_extract(plain, r"([a-h][1-8])(?:=?[NBRQ])?$", 1), F.lit("")),
        "castle_side": F.when(plain.isin("O-O-O", "0-0-0"), "queenside").when(plain.isin("O-O", "0-0"), "kingside"),
        "promotion": F.nullif(F.regexp_extract(plain, r"[a-h][1-8]=?([NBRQ])$", 1), F.lit("")),
    }


def san_facts(moves: DataFrame, san: str = "move_san") -> DataFrame:
    return moves.withColumns(facts_of(F.col(san)))


def _game_window(keys) -> Window:
    return Window.partitionBy(*keys).orderBy("ply")


def think_times(plies: DataFrame, keys=("game_id",)) -> DataFrame:
    """Own clock before the move, think time, the opponent's clock and last think time.

    Expects ``side``, ``clock_after``, ``base_s``, ``increment_s``.  A ply without a
    clock leaves the clocks as they were and has no think time.
    """
    earlier = _game_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    white = F.col("side") == "white"
    clock = {
        side: F.coalesce(
            F.last(F.when(F.col("side") == side, F.col("clock_after")), ignorenulls=True).over(earlier),
            F.col("base_s"),
        )
        for side in ("white", "black")
    }
    clocks = plies.withColumns({"_white_clock": clock["white"], "_black_clock": clock["black"]}).withColumns(
        {
            "clock_before": F.when(white, F.col("_white_clock")).otherwise(F.col("_black_clock")),
            "opp_clock": F.when(white, F.col("_black_clock")).otherwise(F.col("_white_clock")),
        }
    )
    timed = clocks.withColumn("think_time", F.col("clock_before") - F.col("clock_after") + F.col("increment_s"))
    spent = {
        side: F.last(F.when(F.col("side") == side, F.col("think_time")), ignorenulls=True).over(earlier)
        for side in ("white", "black")
    }
    return timed.withColumn(
        "opp_think_time_prev", F.when(white, spent["black"]).otherwise(spent["white"])
    ).drop("_white_clock", "_black_clock")


def recaptures(plies: DataFrame, keys=("game_id",)) -> DataFrame:
    """A capture on the square captured on the ply before."""
    taken = F.lag(F.when(F.col("is_capture"), F.col("to_square"))).over(_game_window(keys))
    return plies.withColumn("is_recapture", truthy(F.col("is_capture") & (F.col("to_square") == taken)))


def castling_state(plies: DataFrame, keys=("game_id",)) -> DataFrame:
    """Where each side has castled before this ply, and whether on opposite wings."""
    earlier = _game_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    done = {
        side: F.last(F.when(F.col("side") == side, F.col("castle_side")), ignorenulls=True).over(earlier)
        for side in ("white", "black")
    }
    white = F.col("side") == "white"
    return plies.withColumns(
        {
            "own_castled_side": F.when(white, done["white"]).otherwise(done["black"]),
            "opp_castled_side": F.when(white, done["black"]).otherwise(done["white"]),
        }
    ).withColumn("opposite_side_castling", truthy(F.col("own_castled_side") != F.col("opp_castled_side")))


PLY = (
    "ply int, move_san string, is_capture boolean, gives_check boolean, to_square string, castle_side string, promotion string, "
    "side string, move_number int, clock_after double, clock_before double, opp_clock double, think_time double, opp_think_time_prev double, "
    "is_recapture boolean, own_castled_side string, opp_castled_side string, opposite_side_castling boolean, timed_index int, timed_total int"
)


def last_before(marked: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Place of the nearest earlier marked ply of the same game, -1 without one; ``starts`` has each ply's first place."""
    last = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
    last = np.r_[-1, last[:-1]] if len(last) else last
    return np.where(last >= starts, last, -1)


def at(values: np.ndarray, place: np.ndarray, otherwise=np.nan) -> np.ndarray:
    return np.where(place >= 0, values[np.maximum(place, 0)], otherwise) if len(values) else values


def filled_plies(counts: np.ndarray, base: np.ndarray, increment: np.ndarray, alone: np.ndarray, facts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What each ply's game had before it, for the plies of many games back to back: two scans a quantity, whatever the length of a game.

    ``alone``: one player holds both sides, so both sides' timed plies are numbered together."""
    n = int(counts.sum())
    game = np.repeat(np.arange(len(counts)), counts)
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    ply = np.arange(n) - starts
    white = ply % 2 == 0
    after, castle = facts["clock_after"], facts["castle_side"]
    timed = ~np.isnan(after)

    def both(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last marked ply of the own side and of the other."""
        w, b = last_before(marked & white, starts), last_before(marked & ~white, starts)
        return np.where(white, w, b), np.where(white, b, w)

    own, other = both(timed)
    clock = at(after, own, base[game])
    think = clock - after + increment[game]
    spent = both(~np.isnan(think))[1]
    own_castle, opp_castle = (at(castle, place, None) for place in both(np.array([c is not None for c in castle], dtype=bool)))
    previous = np.where(ply > 0, np.arange(n) - 1, -1)
    taken = at(np.where(facts["is_capture"], facts["to_square"], None), previous, None)
    together = alone[game]

    def numbered(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Timed plies of ``mine`` before each ply, and in its whole game."""
        upto = np.cumsum(timed & mine) - (timed & mine)
        before = upto - (upto[starts] if n else 0)
        return before, np.bincount(game[timed & mine], minlength=len(counts))[game]

    all_sides, of_white, of_black = numbered(np.ones(n, dtype=bool)), numbered(white), numbered(~white)
    index, total = (np.where(together, a, np.where(white, w, b)) for a, w, b in zip(all_sides, of_white, of_black))
    return {
        "ply": ply, "side": np.where(white, "white", "black"), "move_number": ply // 2 + 1, "clock_before": clock, "opp_clock": at(after, other, base[game]),
        "think_time": think, "opp_think_time_prev": at(think, spent),
        "is_recapture": np.array([bool(c) and s is not None and s == t for c, s, t in zip(facts["is_capture"], facts["to_square"], taken)], dtype=bool),
        "own_castled_side": own_castle, "opp_castled_side": opp_castle,
        "opposite_side_castling": np.array([a is not None and b is not None and a != b for a, b in zip(own_castle, opp_castle)], dtype=bool),
        "timed_index": np.where(timed, index, -1), "timed_total": total,
    }


def unique_games(games: DataFrame, pgn: str = "pgn") -> DataFrame:
    """One record per game, where archives of several players hold the same game.

    Records are one game if identifier, players and start agree; the game's longest
    text stays.  This is the only step that moves records, and it moves each once."""
    named = headers(games, pgn)
    best = F.max(F.struct(F.length(pgn), F.struct(*[games[c] for c in games.columns]).alias("_row"))).alias("_best")
    return named.groupBy("game_id", "white", "black", "date", "utc_time").agg(best).select("_best._row.*")


def plies(games: DataFrame, pgn: str = "pgn", unique: bool = False) -> DataFrame:
    """Both sides' plies of every game, from raw game text.

    ``unique`` first drops the copies of games read from several players' archives.
    ``timed_index`` and ``timed_total`` number each player's plies that carry a clock."""
    named = headers(unique_games(games, pgn) if unique else games, pgn)
    kept = [c for c in named.columns if c != pgn]
    others = {"kept": F.struct(*kept), "base": F.col("base_s").cast("double"), "increment": F.col("increment_s").cast("double"), "alone": F.coalesce(F.lower("white") == F.lower("black"), F.lit(False))}
    facts = lambda m: F.struct(m["san"].alias("move_san"), *[c.alias(n) for n, c in facts_of(m["san"]).items()], clock_seconds(m["comment"]).alias("clock_after"))
    told = tokens_of(named, pgn, others).select("kept", "base", "increment", "alone", F.transform("tokens", facts).alias("plies"))
    own = [f for f in T.StructType.fromDDL(PLY).fields]
    schema = T.StructType([told.schema["kept"], *own])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            counts, moves = np.diff(lists.offsets.to_numpy()), lists.flatten()
            told_of = {f.name: moves.field(i) for i, f in enumerate(moves.type)}
            plain = {
                "clock_after": told_of["clock_after"].to_numpy(zero_copy_only=False).astype(float), "is_capture": told_of["is_capture"].to_numpy(zero_copy_only=False).astype(bool),
                **{c: np.array(told_of[c].to_pylist(), dtype=object) for c in ("castle_side", "to_square")},
            }
            numbers = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)]
            found = filled_plies(counts, *[v.astype(float) for v in numbers], batch.column(3).to_numpy(zero_copy_only=False).astype(bool), plain)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))]
            for f in own:
                if f.name in told_of:
                    columns.append(told_of[f.name])
                    continue
                v, kind = found[f.name], {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()]
                missing = np.isnan(v) if kind == pa.float64() else v < 0 if f.name == "timed_index" else None
                columns.append(pa.array(v, kind, mask=missing, from_pandas=False))
            yield pa.RecordBatch.from_arrays(columns, names=["kept", *[f.name for f in own]])

    return told.mapInArrow(fill, schema).select("kept.*", *[f.name for f in own])


def player_view(plies_all: DataFrame, players: DataFrame) -> DataFrame:
    """Own plies of the tracked players (``players.player``), names compared caselessly.

    Plies without a clock are no decisions and are dropped, as are other games.
    """
    white = F.col("side") == "white"
    sided = plies_all.withColumn("_name", F.lower(F.when(white, F.col("white")).otherwise(F.col("black"))))
    tracked = players.select("player", F.lower("player").alias("_name")).dropDuplicates(["_name"])
    own = (
        sided.where(F.col("clock_after").isNotNull())
        .join(tracked, "_name")
        .withColumns(
            {
                "color": F.col("side"),
                "player_rating": F.when(white, F.col("white_rating")).otherwise(F.col("black_rating")),
                "opp_rating": F.when(white, F.col("black_rating")).otherwise(F.col("white_rating")),
            }
        )
        .drop("_name", "side", "white", "black", "white_rating", "black_rating")
    )
    if "timed_index" not in own.columns:
        return move_index(own)
    return own.withColumnsRenamed({"timed_index": "player_move_index", "timed_total": "player_moves_total"})


def resolve_players(games: DataFrame, players: DataFrame) -> DataFrame:
    """Colour and ratings of each tracked player in each of their games."""
    side = lambda color, own, other: F.struct(
        F.lit(color).alias("color"), F.lower(own).alias("_name"),
        F.col(f"{color}_rating").alias("player_rating"), F.col(f"{other}_rating").alias("opp_rating"),
    )
    both = F.array(side("white", "white", "black"), side("black", "black", "white"))
    tracked = players.select("player", F.lower("player").alias("_name")).dropDuplicates(["_name"])
    seated = games.select("game_id", F.explode(both).alias("_s")).select("game_id", "_s.*")
    return seated.join(tracked, "_name").drop("_name")


def move_index(plies_view: DataFrame, keys=("player", "game_id")) -> DataFrame:
    """Index of each own move and the number of own moves in the game."""
    return plies_view.withColumns(
        {
            "player_move_index": F.row_number().over(_game_window(keys)) - 1,
            "player_moves_total": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )


def drop_untimed(plies_view: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Rows with a usable time control; ``untimed_count`` reports the rest, and so does ``observation`` once the rows have been used."""
    timed = F.col("base_s").isNotNull()
    if observation is not None:
        plies_view = plies_view.observe(observation, F.count_if(~timed).alias("n_dropped"), F.count_if(timed).alias("n_kept"))
    return plies_view.where(timed)


def untimed_count(plies_view: DataFrame, keys=("player",)) -> DataFrame:
    return plies_view.groupBy(*keys).agg(
        F.count_if(F.col("base_s").isNull()).alias("n_dropped"), F.count_if(F.col("base_s").isNotNull()).alias("n_kept")
    )


def flag_noise(df: DataFrame, premove_s: float = PREMOVE_SECONDS, lag_mult: float = LAG_MULTIPLE) -> DataFrame:
    """Premove, negative and lag flags, and their union with missing times."""
    t = F.col("think_time")
    return df.withColumns(
        {
            "is_premove": truthy(t <= premove_s),
            "is_negative": truthy(t < 0),
            "lag_suspect": truthy(t > lag_mult * F.col("base_s")),
        }
    ).withColumn(
        "is_suspect", F.col("is_premove") | F.col("is_negative") | F.col("lag_suspect") | t.isNull()
    )


def noise_report(df: DataFrame, keys=("player",)) -> DataFrame:
    """Rates of each noise flag."""
    rate = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_plies"),
        rate(F.col("is_premove")).alias("premove_rate"),
        rate(F.col("lag_suspect")).alias("lag_rate"),
        rate(F.col("is_negative") | F.col("think_time").isNull()).alias("negative_or_missing_rate"),
        rate(F.col("is_suspect")).alias("suspect_rate"),
    )


def think_time_summary(df: DataFrame, keys=("player",)) -> DataFrame:
    """Count, mean, spread, extremes and quartiles of the clean think times."""
    from pacelens.functions.stats import join_per_key, quantiles

    clean = df.where(~F.col("is_suspect"))
    moments = clean.groupBy(*keys).agg(
        F.count("think_time").alias("n_clean"),
        F.avg("think_time").alias("mean"),
        F.stddev_samp("think_time").alias("std"),
        F.min("think_time").alias("min"),
        F.max("think_time").alias("max"),
    )
    quarters = quantiles(clean, keys, "think_time", (0.25, 0.5, 0.75), "_q")
    return join_per_key(moments, quarters, keys).select(
        *moments.columns,
        F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"),
    )
