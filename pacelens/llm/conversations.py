"""Conversation structure repair by a square-root checkpointed dynamic programme.

A conversation is repaired by the cheapest edits (delete, insert, keep, rerole) after
which its role initials read ``(s?(ua)+)?``; of equally cheap ones the ASCII-least
string of edit initials counts.  The programme runs backward over a vector of four
costs, one for each state of that pattern, and forward along tight edits.

Rows are put in order once (range partitions, sorted, numbered) and cut into blocks of
about the square root of the longest conversation's rows.  Backward, a block at the
edge of a conversation becomes the matrix of its costs from state to state; along each
conversation these few matrices give the cost vector behind every block, and only
those checkpoints are stored.  Forward, each block recomputes its own vectors from its
checkpoint, finds where each entry state leaves it, and, once the entry states are
known, emits its edits.  So no conversation has to fit into a task: blocks are solved
apart, and what is scanned in order is one row a block.  Conversations that lie inside
a block need no checkpoint.

The digest of a repaired conversation is a hash over its lines in order; that is
sequential by nature, so one task streams a conversation's sorted lines and holds one
batch of them and its string of edits.

Defined cases: null roles and texts are one space; a null turn sorts first and is
left out of the gaps; a null conv_id is a conversation of its own; rows that tie in turn go
by role and hash of the text, repeated rows side by side; texts are compared by their
128-bit hash; a conversation left without rows has zeros, an empty audit and the hash
of the empty text; an empty table gives no rows; a text of any length is one value;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelens.functions.storage import materialise
from pacelens.llm.common import map_batches, ship, table

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
LEAST_BLOCK = 1024
NEVER = 1 << 40
OWN = 1000

#: States: nothing yet, after the system row, after a user row, after an assistant row.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may come next by insertion or reroling, and the state it leads to.
NEXT = {BEGIN: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEPT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Costs to the end of a conversation without further rows.
END = (0, 2 * INSERT, INSERT, 0)
FOLLOWS = ("su", "ua", "au")
INITIALS = "sua"
#: Faults as the programme sees them.
SOUND, TRUNCATED, MUST_GO = range(3)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) damaged by the hash of their place: dropped, emptied, cut, repeated or put in the user's mouth."""
    named = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    read = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.crc32(named) % 20).alias("code"))
    emptied = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    spoken = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return read.where("code != 0").select("conv", "turn", spoken.alias("role"), emptied.alias("text"), times).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) stored in order with ``at``, a number that rises along each conversation, and their own faults."""
    order = ["conv", "turn", "role", "key"]
    read = rows.select("conv", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    said = F.rtrim("text", F.lit(SPACE))
    keyed = read.select("*", F.unhex(F.md5("text")).alias("key"), (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("open"))
    # equal rows may stand in any order; numbering them lets a range of one key be cut
    numbered = keyed.withColumn("tie", F.monotonically_increasing_id())
    laid = numbered.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    return materialise(laid.withColumn("at", F.monotonically_increasing_id()))


def rated(stored: DataFrame) -> DataFrame:
    """(conv, turn, at, initial, fault): each row's first fault, a repetition told by the least ``at`` of its role and text."""
    firsts = stored.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    repeated = materialise(firsts.where("n > 1").drop("n"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    light = stored.select("conv", "turn", "at", "role", "key", "blank", "open")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("least"), "duplicate").when(F.col("open"), "truncated").otherwise("none")
    return materialise(light.join(repeated, same, "left").select("conv", "turn", "at", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")))


@lru_cache(maxsize=1 << 16)
def step(initial: str, fault: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those behind it, both less their minimum, and what the minimum rose by."""
    added = CUT if fault == TRUNCATED else 0
    base = []
    for state in range(4):
        best = DELETE + after[state]
        if fault != MUST_GO:
            best = min(best, REROLE + added + after[NEXT[state][1]])
            if (state, initial) in KEPT:
                best = min(best, KEEP + added + after[KEPT[state, initial]])
        base.append(best)
    user, assistant = min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER])
    costs = [min(base[BEGIN], INSERT + user), min(base[SYSTEM], INSERT + user), user, assistant]
    least = min(costs)
    return tuple(min(c - least, NEVER) if c < NEVER else NEVER for c in costs), least


@lru_cache(maxsize=1 << 16)
def choice(initial: str, fault: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least tight edits at a row, up to the one that takes it, and the state they lead to."""
    before, risen = step(initial, fault, after)
    added, letters = CUT if fault == TRUNCATED else 0, ""
    while True:
        now, (_, onward) = before[state] + risen, NEXT[state]
        if DELETE + after[state] == now:
            return letters + "D", state
        if INSERT + before[onward] + risen == now:
            letters, state = letters + "I", onward
        elif fault != MUST_GO and (state, initial) in KEPT and KEEP + added + after[KEPT[state, initial]] == now:
            return letters + "K", KEPT[state, initial]
        else:
            return letters + "R", onward


def lowered(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least if c < NEVER else NEVER for c in costs), least


def backward(rows: list[tuple[str, int]], behind: tuple[int, ...]) -> tuple[list[tuple[int, ...]], tuple[int, ...]]:
    """(costs behind each row less their minimum, full costs before the first row)."""
    now, total = lowered(behind)
    vectors = []
    for initial, fault in reversed(rows):
        vectors.append(now)
        now, risen = step(initial, fault, now)
        total += risen
    return vectors[::-1], tuple(c + total if c < NEVER else NEVER for c in now)


def matrix(rows: list[tuple[str, int]]) -> list[int]:
    """Least costs from each entry state to each exit state, row after row."""
    columns = [backward(rows, tuple(0 if q == out else NEVER for q in range(4)))[1] for out in range(4)]
    return [columns[out][q] for q in range(4) for out in range(4)]


def walk(rows: list[tuple[str, int]], vectors: list[tuple[int, ...]], state: int) -> Iterator[tuple[str, int]]:
    """(edits, state behind them) at each row from an entry state."""
    for (initial, fault), after in zip(rows, vectors):
        letters, state = choice(initial, fault, after, state)
        yield letters, state


FAULTS = {"none": SOUND, "truncated": TRUNCATED, "blank": MUST_GO, "duplicate": MUST_GO}


def segments(block: pa.Table) -> list[tuple[object, list[int], list[tuple[str, int]]]]:
    """The conversations of a block in order: (conv, numbers of their rows, what the programme reads of each row)."""
    block = block.sort_by("at")
    found: list[tuple] = []
    previous: object = found
    for conv, at, initial, fault in zip(*(block[c].to_pylist() for c in ("conv", "at", "initial", "fault"))):
        if not found or conv != previous:
            found.append((conv, [], []))
        previous = conv
        found[-1][1].append(at)
        found[-1][2].append((initial if initial in INITIALS else "", FAULTS[fault]))
    return found


def edges(found: list) -> list:
    """The segments that may go on in a neighbouring block."""
    return found[:1] + found[1:][-1:]


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def decided(faults: DataFrame) -> DataFrame:
    """(conv, at, place, edit, role): the edits of every conversation, in order of (at, place).

    A row's own edit has place ``OWN``; an inserted row has the ``at`` of the row it stands before and a place from 0 up,
    or at the end that of the last row and a place above ``OWN``."""
    spark = faults.sparkSession
    ship(spark)
    kind = faults.schema["conv"].dataType
    longest = faults.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    size = LEAST_BLOCK
    while size * size < longest:
        size *= 2
    light = faults.select("conv", "at", "initial", "fault", F.col("at").bitwiseAND(F.lit(-size)).alias("block"))

    def schemas(**fields: tuple[T.DataType, pa.DataType]) -> tuple[T.StructType, dict]:
        return T.StructType([T.StructField("conv", kind), *[T.StructField(n, t) for n, (t, _) in fields.items()]]), {n: a for n, (_, a) in fields.items()}

    def arrow(conv: pa.DataType, fields: dict) -> pa.Schema:
        return pa.schema([("conv", conv), *fields.items()])

    whole, many, word = (T.LongType(), pa.int64()), (T.ArrayType(T.LongType()), pa.list_(pa.int64())), (T.StringType(), pa.string())
    out1, in1 = schemas(block=whole, matrix=many)
    out2, in2 = schemas(block=whole, behind=many)
    out3, in3 = schemas(block=whole, behind=many, exits=many)
    out4, in4 = schemas(block=whole, behind=many, entry=whole, last=whole)
    out5, in5 = schemas(at=whole, place=whole, edit=word, role=word)

    def matrices(block: pa.Table) -> pa.Table:
        number = block["block"][0].as_py()
        rows = [(conv, number, matrix(read)) for conv, _, read in edges(segments(block))]
        return table_of(rows, arrow(block.schema.field("conv").type, in1))

    def checkpoints(chain: pa.Table) -> pa.Table:
        behind, rows = END, []
        for conv, number, m in reversed(list(zip(*(chain.sort_by("block")[c].to_pylist() for c in ("conv", "block", "matrix"))))):
            rows.append((conv, number, list(behind)))
            behind = tuple(min(min(m[4 * q + out] + behind[out] for out in range(4)), NEVER) for q in range(4))
        return table_of(rows, arrow(chain.schema.field("conv").type, in2))

    def exits(block: pa.Table, known: pa.Table) -> pa.Table:
        behind = dict(zip(known["conv"].to_pylist(), known["behind"].to_pylist()))
        rows = []
        for conv, ats, read in edges(segments(block)):
            vectors, _ = backward(read, tuple(behind[conv]))
            leave = []
            for state in range(4):
                for _, state in walk(read, vectors, state):
                    pass
                leave.append(state)
            rows.append((conv, block["block"][0].as_py(), behind[conv], leave))
        return table_of(rows, arrow(block.schema.field("conv").type, in3))

    def entries(chain: pa.Table) -> pa.Table:
        chain, state, rows = chain.sort_by("block"), BEGIN, []
        for conv, number, behind, leave in zip(*(chain[c].to_pylist() for c in ("conv", "block", "behind", "exits"))):
            rows.append((conv, number, behind, state, int(len(rows) == len(chain) - 1)))
            state = leave[state]
        return table_of(rows, arrow(chain.schema.field("conv").type, in4))

    def emit(block: pa.Table, known: pa.Table) -> pa.Table:
        given = {r["conv"]: r for r in known.to_pylist()}
        rows: list[tuple] = []
        for conv, ats, read in segments(block):
            edge = given.get(conv, {"behind": END, "entry": BEGIN, "last": 1})
            vectors, _ = backward(read, tuple(edge["behind"]))
            before = edge["entry"]
            for at, (letters, state) in zip(ats, walk(read, vectors, before)):
                for place, letter in enumerate(letters):
                    if letter == "I":
                        role, before = NEXT[before]
                        rows.append((conv, at, place, "I", role))
                    else:
                        rows.append((conv, at, OWN, letter, NEXT[before][0] if letter == "R" else None))
                before = state
            place = OWN + 1
            while edge["last"] and END[before]:
                role, before = NEXT[before]
                rows.append((conv, ats[-1], place, "I", role))
                place += 1
        return table_of(rows, arrow(block.schema.field("conv").type, in5))

    def by_block(df: DataFrame):
        return df.groupBy("block")

    ends = materialise(by_block(light).applyInArrow(matrices, out1)).groupBy("conv").applyInArrow(checkpoints, out2)
    leaves = by_block(light).cogroup(by_block(ends)).applyInArrow(exits, out3)
    known = materialise(leaves.groupBy("conv").applyInArrow(entries, out4))
    return materialise(by_block(light).cogroup(by_block(known)).applyInArrow(emit, out5))


def edits(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv, at, place, edit, initial, line): each edit with the row's role initial and the repaired ``role:text`` line, null where none is left."""
    own = decisions.where("edit != 'I'").select(F.col("at").alias("a"), "place", "edit", F.col("role").alias("new_role"))
    line = F.when(F.col("edit") != "D", F.concat(F.coalesce("new_role", "role"), F.lit(":"), F.col("text")))
    taken = stored.select("conv", "at", "role", "text").join(own, F.col("at") == F.col("a")).select("conv", "at", "place", "edit", F.substring("role", 1, 1).alias("initial"), line.alias("line"))
    added = decisions.where("edit = 'I'").select("conv", "at", "place", "edit", F.lit(None).cast("string").alias("initial"), F.concat("role", F.lit(":")).alias("line"))
    return taken.union(added)


def digests(found: DataFrame) -> DataFrame:
    """(conv, illegal, audit, repaired_sha256), streamed over each conversation's edits in order."""
    kind = found.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("illegal", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, arrow, open_ = None, None, False
        illegal, audit, sha, lines, previous = 0, [], hashlib.sha256(), 0, None
        for batch in batches:
            done, arrow = [], batch.schema.field(0).type
            for name, edit, initial, line in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not open_ or name != conv:
                    if open_:
                        done.append((conv, illegal, "".join(audit), sha.hexdigest()))
                    conv, open_ = name, True
                    illegal, audit, sha, lines, previous = 0, [], hashlib.sha256(), 0, None
                audit.append(edit)
                if edit != "I":
                    illegal += previous is not None and previous + initial not in FOLLOWS
                    previous = initial
                if line is not None:
                    sha.update(b"\n" + line.encode() if lines else line.encode())
                    lines += 1
            yield as_batch(done, arrow)
        if open_:
            yield as_batch([(conv, illegal, "".join(audit), sha.hexdigest())], arrow)

    def as_batch(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
        types = (conv, pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["conv", "illegal", "audit", "repaired_sha256"])

    laid = found.repartition("conv").sortWithinPartitions("conv", "at", "place").select("conv", "edit", "initial", "line")
    return map_batches(laid, run_batches, schema)


def tallies(faults: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, cost) of every conversation that has rows."""

    def count(fault: str) -> Column:
        return F.count(F.when(F.col("fault") == fault, 1)).alias(fault)

    # turns apart first, so that a distinct count never gathers a conversation
    turns = faults.groupBy("conv", "turn").agg(count("blank"), count("duplicate"), count("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    own = turns.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.lit(0).cast("long").alias("cost"))
    paid = F.sum(F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).when(F.col("edit") == "R", REROLE).otherwise(KEEP))
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")]
    edited = decisions.groupBy("conv").agg(paid.alias("cost")).select("conv", *zero, "cost")
    kept = decisions.where("edit IN ('K', 'R')").select(F.col("at").alias("a"))
    cut = faults.where("fault = 'truncated'").join(kept, F.col("at") == F.col("a")).groupBy("conv").agg((F.count(F.lit(1)) * CUT).alias("cost")).select("conv", *zero, "cost")
    return own.union(edited).union(cut).groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "cost")])


def repair(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation in rows (conv, turn, role, text)."""
    stored = in_order(rows)
    faults = rated(stored)
    decisions = decided(faults)
    summary, digest = tallies(faults, decisions), digests(edits(stored, decisions)).withColumnRenamed("conv", "c")
    joined = summary.join(digest, F.col("conv").eqNullSafe(F.col("c")))
    return joined.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair(damage(rows))
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
