"""Cheapest repairs of conversations, by block tables in the manner of the Four Russians.

A repaired conversation has role initials ``(s?(ua)+)?``. Reading turns from the end, four costs say what the rest costs from
each state of that pattern. Only their differences matter, and these take few values: the normalised vectors have numbers, and for
every block of ``BLOCK`` turn symbols a table says which vector lies before it for each vector behind it. Conversations are
read by lookup, a block at a time. For the edits themselves a block is expanded backward from the vector behind it to the vectors
inside, and then walked forward, each time with the least letter that is still cheapest, so ties are settled exactly.

Rows of all conversations get one running position, and cells of ``CELL`` positions are the unit of work. A conversation of one cell
is done at once. For longer ones a cell is a map from the vector behind it to the vector before it, and then from the state
it is entered in to the state it is left in; such maps are composed in a tree, so one very long conversation is as many tasks as it has cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import dense_index
from .common import BLANKS, landed, read, table

BLOCK = 4
CELL = 4096
FAN_IN = 256
# Prices of the edits; an undeleted truncated turn adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# States of the pattern: nothing yet, after s, after u, after a. Inserting or changing a role leads from one to the next.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
# Where a kept turn with initial s, u, a or another leads to.
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
# Stands for K inside the traces where the turn kept is the one that may open a conversation.
OPENING = "S"
# A turn is a byte: 4 * initial + fault, with these faults.
SOUND, CUT, BLANK, AGAIN = range(4)
# Its symbol: 0 if it has to go, else 1 + 2 * initial + truncated.
SYMBOLS = 9
_SYMBOL = np.array([0 if fault >= BLANK else 1 + 2 * initial + fault for initial in range(4) for fault in range(4)])
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
PIECE = "conv_id bigint, cell bigint, first bigint, lasts boolean, audits array<string>, costs array<bigint>, exits array<int>, illegal bigint, faults array<bigint>"


def _before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """What the rest costs in each state before a turn, from what it costs after it."""
    found = [DELETE + cost for cost in costs]
    if symbol:
        initial, extra = divmod(symbol - 1, 2)
        for state in range(4):
            found[state] = min(found[state], REROLE + extra * TRUNCATED + costs[AFTER[state]])
            if state in KEPT[initial]:
                found[state] = min(found[state], KEEP + extra * TRUNCATED + costs[KEPT[initial][state]])
    return _inserting(found)


def _inserting(costs: list[int]) -> tuple[int, ...]:
    once = [min(cost, INSERT + costs[AFTER[state]]) for state, cost in enumerate(costs)]
    return tuple(min(cost, INSERT + once[AFTER[state]]) for state, cost in enumerate(once))


def _normal(costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(cost - min(costs) for cost in costs)


END = _normal(_inserting([0 if state in ENDS else 99 for state in range(4)]))


@cache
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """(vectors, vector before one symbol [vector, symbol], vector before a block [vector, block]); END is number 0."""
    vectors, numbers, one = [END], {END: 0}, []
    for vector in vectors:  # grows until the vectors are closed under every symbol
        row = []
        for symbol in range(SYMBOLS):
            before = _normal(_before(vector, symbol))
            if before not in numbers:
                numbers[before] = len(vectors)
                vectors.append(before)
            row.append(numbers[before])
        one.append(row)
    single = np.array(one)
    block = np.arange(len(vectors))[:, None]
    for _ in range(BLOCK):  # a symbol is put before the blocks so far, as their highest digit
        block = single[block].transpose(0, 2, 1).reshape(len(vectors), -1)
    return vectors, single, block


def _blocks(codes: np.ndarray) -> tuple[list[int], list[int]]:
    """Numbers of the whole blocks, and the symbols left over at the end."""
    symbols = _SYMBOL[codes]
    whole = len(symbols) // BLOCK * BLOCK
    return (symbols[:whole].reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK)[::-1])).tolist(), symbols[whole:].tolist()


def _digits(block: int) -> tuple[int, ...]:
    return tuple(block // SYMBOLS**at % SYMBOLS for at in reversed(range(BLOCK)))


@lru_cache(maxsize=1 << 18)
def _walked(behind: int, symbols: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """(edits, cost, state behind) of the turns of a block entered in ``state``, with the vector ``behind`` it."""
    costs = [tables()[0][behind]]
    for symbol in reversed(symbols):
        costs.append(_before(costs[-1], symbol))
    costs.reverse()
    edits, spent, at = "", 0, 0
    while at < len(symbols):
        initial, extra = divmod(symbols[at] - 1, 2) if symbols[at] else (3, 0)
        moves = [("D", DELETE, state, 1), ("I", INSERT, AFTER[state], 0)]
        if symbols[at]:
            if state in KEPT[initial]:
                moves.append((OPENING if initial == 0 else "K", KEEP + extra * TRUNCATED, KEPT[initial][state], 1))
            moves.append(("R", REROLE + extra * TRUNCATED, AFTER[state], 1))
        for letter, price, to, step in moves:
            if price + costs[at + step][to] == costs[at][state]:
                edits, spent, at, state = edits + letter, spent + price, at + step, to
                break
    return edits, spent, state


def traced(codes: np.ndarray, behind: int, state: int, last: bool) -> tuple[str, int, int]:
    """(edits, cost, state behind) of a cell; the last cell of a conversation is completed to the end of the pattern."""
    vectors, single, block = tables()
    numbers, rest = _blocks(codes)
    at = behind
    for symbol in reversed(rest):
        at = int(single[at, symbol])
    ahead = []
    for number in reversed(numbers):
        ahead.append(at)
        at = int(block[at, number])
    edits, spent = [], 0
    for number, vector in zip(numbers, reversed(ahead)):
        some, price, state = _walked(vector, _digits(number), state)
        edits.append(some)
        spent += price
    some, price, state = _walked(behind, tuple(rest), state)
    edits.append(some)
    spent += price
    while last and state not in ENDS:
        edits.append("I")
        spent += INSERT
        state = AFTER[state]
    return "".join(edits), spent, state


def _maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector before each cell for every vector behind it."""
    vectors, single, block = tables()
    for batch in batches:
        maps = []
        for codes in batch.column("codes"):
            numbers, rest = _blocks(np.asarray(codes.values))
            at = np.arange(len(vectors))
            for symbol in reversed(rest):
                at = single[at, symbol]
            for number in reversed(numbers):
                at = block[at, number]
            maps.append(at)
        yield table({"conv_id": (batch.column("conv_id"), None), "cell": (batch.column("cell"), None), "map": (maps, pa.list_(pa.int32()))})


def _traces(batches: Iterable[pa.RecordBatch], states: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, costs, exits, illegal, faults = [], [], [], [], []
        for codes, behind, last, before in zip(batch.column("codes"), *[batch.column(name).to_pylist() for name in ("behind", "lasts", "before")]):
            codes = np.asarray(codes.values)
            found = [traced(codes, behind, state, last) for state in states]
            for to, part in zip((audits, costs, exits), zip(*found)):
                to.append(list(part))
            initials = (codes if before is None else np.concatenate([[before], codes])) >> 2
            illegal.append(len(initials) - 1 - int(_LEGAL[initials[:-1], initials[1:]].sum()))
            faults.append(np.bincount(codes & 3, minlength=4))
        yield table({
            **{name: (batch.column(name), None) for name in ("conv_id", "cell", "first", "lasts")}, "audits": (audits, pa.list_(pa.string())), "costs": (costs, pa.list_(pa.int64())),
            "exits": (exits, pa.list_(pa.int32())), "illegal": (illegal, pa.int64()), "faults": (faults, pa.list_(pa.int64())),
        })


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per edit but deletions: the turn's position, place among the edits there, letter and new role (null: its own)."""
    roles = {USER: "user", ASSISTANT: "assistant"}
    for batch in batches:
        ids, ats, nths, letters, news = [], [], [], [], []
        for conv, first, state, audit in zip(*[batch.column(name).to_pylist() for name in ("conv_id", "first", "state", "audit")]):
            at, nth = first, 0
            for letter in audit:
                if letter in "IR":
                    state = AFTER[state]
                    new = roles[state]
                elif letter != "D":
                    new = None
                    state = SYSTEM if letter == OPENING else AFTER[state]
                if letter != "D":
                    ids.append(conv)
                    ats.append(at)
                    nths.append(nth)
                    letters.append("K" if letter == OPENING else letter)
                    news.append(new)
                nth += 1
                if letter != "I":
                    at, nth = at + 1, 0
        yield table({"conv_id": (ids, pa.int64()), "at": (ats, pa.int64()), "nth": (nths, pa.int32()), "edit": (letters, pa.string()), "new": (news, pa.string())})


def scanned(maps: DataFrame, start: int, backwards: bool) -> DataFrame:
    """(conv_id, cell, entry): ``start`` led through the maps of all cells of the conversation before each, or behind it.

    Maps are composed ``FAN_IN`` at a time, level by level, and the entries come down the same tree.
    """
    sign = -1 if backwards else 1
    same = lambda a, b, *names: [a[f"_{name}"].eqNullSafe(b[name]) for name in names]
    row = F.struct((F.col("cell") * sign).alias("order"), "cell", "map")
    levels = [maps.select("conv_id", "cell", "map")]
    grouped = []
    while True:
        lists = landed(levels[-1].groupBy("conv_id", F.floor(F.col("cell") / FAN_IN).cast("bigint").alias("above")).agg(F.array_sort(F.collect_list(row)).alias("rows")), "map-lists")
        grouped.append(lists)
        if lists.groupBy("conv_id").count().filter("count > 1").isEmpty():
            break
        composed = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.get("rows", F.lit(0))["map"], lambda done, one: F.transform(done, lambda x: F.get(one["map"], x)))
        levels.append(lists.select("conv_id", F.col("above").alias("cell"), composed.alias("map")))
    entries = grouped[-1].select("conv_id", F.col("above").alias("cell"), F.lit(start).alias("entry"))
    for lists in reversed(grouped):
        up = entries.select(F.col("conv_id").alias("_conv_id"), F.col("cell").alias("_above"), "entry")
        begun = F.struct(F.col("entry").alias("now"), F.array().cast("array<int>").alias("seen"))
        passed = F.aggregate("rows", begun, lambda done, one: F.struct(F.get(one["map"], done["now"]).alias("now"), F.concat(done["seen"], F.array(done["now"])).alias("seen")))["seen"]
        down = lists.join(up, (F.col("_conv_id").eqNullSafe(F.col("conv_id"))) & (F.col("_above") == F.col("above")))
        entries = landed(
            down.select("conv_id", F.explode(F.arrays_zip(F.transform("rows", lambda one: one["cell"]).alias("cell"), passed.alias("entry"))).alias("one")).select(
                "conv_id", "one.cell", "one.entry"), "entries")
    return entries


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): rows in order, conversations one after the other; null roles and texts are one blank."""
    blank = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    return dense_index(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], out="at")


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, code) of placed rows: role initial and first fault (blank, seen before, truncated)."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    first = rows.filter(bare != "").groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("at").alias("_at")).select("_at", F.lit(True).alias("fresh"))
    initial = F.coalesce(F.array_position(F.array(*[F.lit(one) for one in "sua"]), F.substring("role", 1, 1)) - 1, F.lit(3))
    initial = F.when(initial < 0, 3).otherwise(initial).cast("int")
    fault = F.when(bare == "", BLANK).when(F.col("fresh").isNull(), AGAIN).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    return rows.join(first, F.col("at") == F.col("_at"), "left").select("conv_id", "turn", "at", (initial * 4 + fault).cast("tinyint").alias("code"))


def _pieces(codes: DataFrame, cell: int) -> DataFrame:
    """Every cell with its edits: conv_id, cell, first, state, audit, cost, illegal, faults."""
    cells = codes.groupBy("conv_id", F.floor(F.col("at") / cell).cast("bigint").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("rows")).select(
        "conv_id", "cell", F.get("rows", F.lit(0))["at"].alias("first"), F.transform("rows", lambda row: row["code"]).alias("codes"))
    spans = codes.groupBy("conv_id").agg(F.floor(F.min("at") / cell).cast("bigint").alias("low"), F.floor(F.max("at") / cell).cast("bigint").alias("high")).withColumnRenamed("conv_id", "_conv_id")
    cells = landed(cells.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).drop("_conv_id"), "cells")
    columns = ("conv_id", "cell", "first", "codes", "lasts", "behind", "before")
    alone = cells.filter("low = high").select(*columns[:4], F.lit(True).alias("lasts"), F.lit(0).alias("behind"), F.lit(None).cast("tinyint").alias("before"))
    chosen = lambda traces, state, at: traces.select(
        "conv_id", "cell", "first", state.alias("state"), F.get("audits", at).alias("audit"), F.get("costs", at).alias("cost"), "illegal", "faults")
    done = chosen(alone.mapInArrow(partial(_traces, states=(START,)), PIECE), F.lit(START), F.lit(0))
    many = cells.filter("low < high")
    if many.isEmpty():
        return landed(done, "pieces")
    keys = lambda other: F.col("conv_id").eqNullSafe(other["_conv_id"]) & (F.col("cell") == other["_cell"])
    behind = scanned(many.select("conv_id", "cell", "codes").mapInArrow(_maps, "conv_id bigint, cell bigint, map array<int>"), 0, True).select(
        F.col("conv_id").alias("_conv_id"), F.col("cell").alias("_cell"), F.col("entry").alias("behind"))
    before = many.select(F.col("conv_id").alias("_conv_id"), (F.col("cell") + 1).alias("_cell"), F.element_at("codes", -1).alias("before"))
    ready = many.withColumn("lasts", F.col("cell") == F.col("high")).join(behind, keys(behind)).drop("_conv_id", "_cell").join(before, keys(before), "left")
    traces = landed(ready.select(*columns).mapInArrow(partial(_traces, states=(START, SYSTEM, USER, ASSISTANT)), PIECE), "traces")
    entries = scanned(traces.select("conv_id", "cell", F.col("exits").alias("map")), START, False).select(
        F.col("conv_id").alias("_conv_id"), F.col("cell").alias("_cell"), F.col("entry").alias("state"))
    return landed(done.unionByName(chosen(traces.join(entries, keys(entries)), F.col("state"), F.col("state"))), "pieces")


def repaired(turns: DataFrame, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The report on every conversation of ``turns``, and the turns of the repaired ones.

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (K keep, R change the role, D delete, I insert). Turns:
    conv_id, at, nth (their order), edit, role, text. Rows are ordered by turn (null first), then role and text; null roles and texts
    are one blank, so such a text is blank. Rows without a conv_id are one conversation. Equal rows are duplicates of the first one. Conversations of any
    length are whole; an empty table gives two empty ones. Other columns are not read.
    """
    rows = placed(turns)
    codes = landed(coded(rows), "codes")
    pieces = _pieces(codes, cell)
    numbers = codes.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "_conv_id")
    fault = lambda kind: F.sum(F.get("faults", F.lit(kind)))
    totals = pieces.groupBy("conv_id").agg(
        fault(BLANK).alias("blank"), fault(AGAIN).alias("duplicate"), fault(CUT).alias("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "audit"))), lambda one: F.translate(one["audit"], OPENING, "K")), "").alias("audit"))
    report = totals.join(numbers, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = pieces.select("conv_id", "first", "state", "audit").mapInArrow(_edits, "conv_id bigint, at bigint, nth int, edit string, new string")
    texts = rows.select(F.col("at").alias("_at"), "role", "text")
    mended = edits.join(texts, F.col("at") == F.col("_at"), "left").select(
        "conv_id", "at", "nth", "edit", F.coalesce("new", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
    return report, mended


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, turn by turn over sorted rows; nothing of a conversation is held but the state of its hash."""
    now, state, started = None, None, False
    for batch in batches:
        ids, digests = [], []
        for conv, role, text in zip(*[batch.column(name).to_pylist() for name in ("conv_id", "role", "text")]):
            if not started or conv != now:
                if started:
                    ids.append(now)
                    digests.append(state.hexdigest())
                now, state, started = conv, hashlib.sha256(), True
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield table({"conv_id": (ids, pa.int64()), "repaired_sha256": (digests, pa.string())})
    if started:
        yield table({"conv_id": ([now], pa.int64()), "repaired_sha256": ([state.hexdigest()], pa.string())})


def digested(mended: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines ``role:text`` of every repaired conversation that has any."""
    return mended.repartition("conv_id").sortWithinPartitions("conv_id", "at", "nth").select("conv_id", "role", "text").mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults that a checksum of conversation and turn chooses: dropped, emptied, cut, repeated or given to the user."""
    blank = F.lit(" ")
    filled = lambda name: F.coalesce(F.col(name).cast("string"), blank)
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    report, mended = repaired(damaged(turns))
    digests = digested(mended).withColumnRenamed("conv_id", "_conv_id")
    every = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    zero: Column = F.lit(0).cast("bigint")
    right = report.withColumnRenamed("conv_id", "_report_id")
    met = every.join(right, F.col("conv_id").eqNullSafe(F.col("_report_id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    return met.select(
        "conv_id", *[F.coalesce(name, zero).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP11_SQL = """
WITH RECURSIVE x AS (
  SELECT list(list_reduce([n]::BIGINT[] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS x FROM range(256) r(n)
), c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda a: ascii(a)::BIGINT),
             lambda c, b: xor(c >> 8, x[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, x
), m AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE kind <> 0
), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM m),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
            WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE 'o' END AS fault,
         role[1] AS i, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY place) AS j FROM p
), v AS (  -- cheapest (cost, audit) in each state of the pattern; z: nothing yet, s, u, a
  SELECT DISTINCT conv_id, 0::BIGINT AS place, {'c': 0, 'e': ''} AS z, {'c': 99999999, 'e': ''} AS s, {'c': 99999999, 'e': ''} AS u, {'c': 99999999, 'e': ''} AS a FROM f
  UNION ALL
  SELECT conv_id, place, dz, CASE WHEN NOT gone AND i = 's' THEN least(ds, {'c': z.c + t, 'e': z.e || 'K'}) ELSE ds END,
         CASE WHEN gone THEN du ELSE least(du, {'c': z.c + t + k_u, 'e': z.e || e_u}, {'c': s.c + t + k_u, 'e': s.e || e_u}, {'c': a.c + t + k_u, 'e': a.e || e_u}) END,
         CASE WHEN gone THEN da ELSE least(da, {'c': u.c + t + k_a, 'e': u.e || e_a}) END
  FROM (
    SELECT *, {'c': z.c + 3, 'e': z.e || 'D'} AS dz, {'c': s.c + 3, 'e': s.e || 'D'} AS ds, {'c': u.c + 3, 'e': u.e || 'D'} AS du, {'c': a.c + 3, 'e': a.e || 'D'} AS da,
           CASE WHEN i = 'u' THEN 0 ELSE 2 END AS k_u, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS e_u, CASE WHEN i = 'a' THEN 0 ELSE 2 END AS k_a, CASE WHEN i = 'a' THEN 'K' ELSE 'R' END AS e_a
    FROM (
      SELECT f.conv_id, f.place, f.i, f.fault IN ('b', 'd') AS gone, CASE WHEN f.fault = 't' THEN 1 ELSE 0 END AS t, z, s,
             least(u, {'c': z.c + 2, 'e': z.e || 'I'}, {'c': s.c + 2, 'e': s.e || 'I'}, {'c': a.c + 2, 'e': a.e || 'I'}) AS u,
             least(a, {'c': u.c + 2, 'e': u.e || 'I'}, {'c': z.c + 4, 'e': z.e || 'II'}, {'c': s.c + 4, 'e': s.e || 'II'}) AS a
      FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.place = v.place + 1
    )
  )
), l AS (
  SELECT conv_id, least(z, a, {'c': u.c + 2, 'e': u.e || 'I'}, {'c': s.c + 4, 'e': s.e || 'II'}) AS best FROM v
  WHERE place = (SELECT max(place) FROM f WHERE f.conv_id IS NOT DISTINCT FROM v.conv_id)
), w AS (
  SELECT conv_id, unnest(string_split(best.e, '')) AS e, generate_subscripts(string_split(best.e, ''), 1) AS nth FROM l WHERE best.e <> ''
), y AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER b AS place, count(*) FILTER (e <> 'D') OVER b AS out FROM w WINDOW b AS (PARTITION BY conv_id ORDER BY nth)
), o AS (
  SELECT y.*, f.role, f.text, max(CASE WHEN out = 1 AND e = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY y.conv_id) AS opened
  FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.place = y.place
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (out - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END,
         chr(10) ORDER BY nth)) AS h FROM o WHERE e <> 'D' GROUP BY conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (j IS NOT NULL AND i || j NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM e.conv_id
"""
