"""Repair of conversations by the cheapest edits, with a Viterbi search that runs on pieces at once.

Rows are read by conversation and turn. Keeping, re-roling or deleting a row and inserting a row
have costs; the roles left must read ``(s?(ua)+)?``. The search goes backward: for every place it
knows, per state, what the rest costs at least. A piece of a long conversation does not know what
stands behind it, so it starts from a speculative cost vector. Two vectors that differ by a constant
lead to the same decisions, so a rerun from another vector stops where it becomes parallel to the
first run. Up to a constant only a few vectors can ever occur (``VECTORS``); a piece is fixed up for
each of them, and the pieces' results are stitched from the end. What was found backward then leads
the way forward, always by the least letter among the cheapest edits.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.llm.common import written

#: Rows of a piece, and pieces whose results are stitched in one step.
PIECE, STITCHED = 1024, 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 40
#: What has been read: nothing, a system row, a user row, an assistant row (nothing and the last may end).
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}
FINE, CUT_SHORT, BLANK, DUPLICATE = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
BLANKS = " \t\n\x0b\x0c\r"


def row_code(role: str, fault: int) -> int:
    return 4 * INITIALS.get(role[:1], 3) + fault


def _next_insert(state: int) -> tuple[int, str]:
    return (ASSISTANT, "assistant") if state == USER else (USER, "user")


def _kept(code: int, state: int) -> int | None:
    """The state after a row that keeps its role, if it may stand there."""
    initial = code // 4
    if initial == 0 and state == START:
        return SYSTEM
    if initial == 1 and state != USER:
        return USER
    return ASSISTANT if initial == 2 and state == USER else None


def _closed(costs: list[int]) -> list[int]:
    """Costs when rows may be inserted first; two inserts reach every state worth reaching."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_next_insert(q)[0]]) for q, c in enumerate(costs)]
    return costs


def _before(code: int, after: Sequence[int]) -> list[int]:
    """Costs of the rest before a row of this code, from the costs after it."""
    extra = TRUNCATED if code % 4 == CUT_SHORT else 0
    costs = []
    for q in range(4):
        best = DELETE + after[q]
        if code % 4 < BLANK:
            best = min(best, REROLE + extra + after[_next_insert(q)[0]])
            if (to := _kept(code, q)) is not None:
                best = min(best, KEEP + extra + after[to])
        costs.append(best)
    return _closed(costs)


def _step(code: int, after: Sequence[int], q: int) -> tuple[str, tuple[str, ...], str | None, int]:
    """Letters, inserted roles, role of the row (None if deleted, empty if kept) and state behind it."""
    costs, extra = _before(code, after), TRUNCATED if code % 4 == CUT_SHORT else 0
    letters, inserted = "", []
    while True:
        if DELETE + after[q] == costs[q]:
            return letters + "D", tuple(inserted), None, q
        to, role = _next_insert(q)
        if INSERT + costs[to] == costs[q]:
            letters, q = letters + "I", to
            inserted.append(role)
            continue
        kept = _kept(code, q)
        if kept is not None and KEEP + extra + after[kept] == costs[q]:
            return letters + "K", tuple(inserted), "", kept
        return letters + "R", tuple(inserted), role, to


def _tables():
    """All cost vectors up to a constant, and what each row code does to them and from them."""
    first = tuple(_closed([0, NEVER, NEVER, 0]))
    vectors, at, back, steps = [first], 0, [], []
    while at < len(vectors):
        back.append([])
        for code in range(16):
            costs = _before(code, vectors[at])
            least = min(costs)
            even = tuple(c - least for c in costs)
            if even not in vectors:
                vectors.append(even)
            back[at].append((vectors.index(even), least))
        steps.append([[_step(code, vectors[at], q) for q in range(4)] for code in range(16)])
        at += 1
    return vectors, back, steps


VECTORS, BACK, STEPS = _tables()


def ending(state: int) -> list[str]:
    """Roles inserted behind the last row."""
    roles = []
    while state in (SYSTEM, USER):
        state, role = _next_insert(state)
        roles.append(role)
    return roles


def backward(codes: bytes, vector: int = 0) -> tuple[list[int], list[int]]:
    """Vector before every row and behind the last, and what lies in constants behind each place."""
    vectors, constants = [vector] * (len(codes) + 1), [0] * (len(codes) + 1)
    for i in range(len(codes) - 1, -1, -1):
        vectors[i], more = BACK[vectors[i + 1]][codes[i]]
        constants[i] = constants[i + 1] + more
    return vectors, constants


def fixed_up(codes: bytes) -> tuple[list[int], list[int]]:
    """For every vector behind the piece: the one before it, and the constant between them.

    The first run is speculative; each other one stops where it is parallel to it.
    """
    vectors, constants = backward(codes)
    before, between = [vectors[0]], [constants[0]]
    for vector in range(1, len(VECTORS)):
        now, constant, i = vector, 0, len(codes)
        while i and now != vectors[i]:
            i -= 1
            now, more = BACK[now][codes[i]]
            constant += more
        same = now == vectors[i]
        before.append(vectors[0] if same else now)
        between.append(constant + (constants[0] - constants[i] if same else 0))
    return before, between


@dataclass
class Traced:
    letters: list[str]
    #: Per row: inserted roles before it, and its role (None if deleted, empty if kept).
    edits: list[tuple[tuple[str, ...], str | None]]
    state: int


def trace(codes: bytes, vectors: list[int], state: int = START) -> Traced:
    letters, edits = [], []
    for i, code in enumerate(codes):
        said, inserted, role, state = STEPS[vectors[i + 1]][code][state]
        letters.append(said)
        edits.append((inserted, role))
    return Traced(letters, edits, state)


def faults_of(role: str, text: str) -> int:
    """Blank, cut short or fine; duplicates are known only beside other rows."""
    body = text.rstrip(BLANKS)
    return BLANK if not body else FINE if body[-1] in ".!?" else CUT_SHORT


def repaired_rows(traced: Traced, roles: Sequence[str], texts: Sequence[str], last: bool) -> list[dict]:
    out = []
    for (inserted, role), own, text in zip(traced.edits, roles, texts, strict=True):
        out += [{"role": r, "text": ""} for r in inserted]
        if role is not None:
            out.append({"role": role or own, "text": text})
    return out + [{"role": r, "text": ""} for r in ending(traced.state)] if last else out


def _counts(codes: bytes) -> dict[str, int]:
    faults = [c % 4 for c in codes]
    broken = sum((a // 4, b // 4) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_SHORT), "illegal": broken}


def damaged(rows: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text, dropped: the rows after damage; a dropped row stays as a mark without text.

    The remainder by 20 of the crc32 of ``conv_id:turn`` decides: 0 drops the row, 1 empties its text,
    2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's. Null
    ids and turns count as one space there, null roles and texts everywhere.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    found = rows.select(
        conv.alias("conv"), "conv_id", F.when(kind != 0, F.col("turn")).cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"),
        F.when(kind == 3, 2).otherwise(1).alias("_times"), F.monotonically_increasing_id().alias("_tie"),
    )
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_copy")


_FACTS = "audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_REPAIRED = "repaired array<struct<role:string,text:string>>"
_PIECES = (
    f"piece bigint, whole boolean, {_FACTS}, {_REPAIRED}, n int, low bigint, high bigint, turns bigint, codes binary, "
    "roles array<string>, texts array<string>, keys array<string>"
)
_ROW = pa.struct([("role", pa.string()), ("text", pa.string())])
_FACT_TYPES = [("audit", pa.string()), *[(c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")], ("repaired", pa.list_(_ROW))]
_PIECE_TYPES = [
    ("conv", pa.string()), ("conv_id", None), ("piece", pa.int64()), ("whole", pa.bool_()), *_FACT_TYPES, ("n", pa.int32()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("keys", pa.list_(pa.string())),
]


def _batch(rows: list[dict], types: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    arrays = [pa.array([r.get(name) for r in rows], kind or id_type) for name, kind in types]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in types])


def repair_codes(codes: bytes, vector: int, state: int, last: bool, roles: Sequence[str], texts: Sequence[str]) -> dict:
    """The edits of a piece whose vector behind it and whose state before it are known."""
    vectors, _ = backward(codes, vector)
    traced = trace(codes, vectors, state)
    letters = "".join(traced.letters) + ("I" * len(ending(traced.state)) if last else "")
    undeleted_cut = sum(c % 4 == CUT_SHORT and role is not None for c, (_, role) in zip(codes, traced.edits, strict=True))
    cost = REROLE * letters.count("R") + DELETE * letters.count("D") + INSERT * letters.count("I") + TRUNCATED * undeleted_cut
    return {"audit": letters, "cost": cost, **_counts(codes), "repaired": repaired_rows(traced, roles, texts, last)}


def _turns(turns: list[int | None]) -> dict:
    known = [t for t in turns if t is not None]
    return {"low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)), "n": len(turns)}


def _gathered(id_type: pa.DataType, piece: int):
    """Rows in order to whole conversations, repaired, and pieces of those that may go on elsewhere."""

    def whole(conv: str, conv_id, rows: list[tuple]) -> dict:
        seen, codes = set(), bytearray()
        for _, role, text, _ in rows:
            fault = faults_of(role, text)
            if fault != BLANK:
                fault = DUPLICATE if (role, text) in seen else fault
                seen.add((role, text))
            codes.append(row_code(role, fault))
        found = repair_codes(bytes(codes), 0, START, True, [r[1] for r in rows], [r[2] for r in rows])
        return {"conv": conv, "conv_id": conv_id, "piece": 0, "whole": True, **found, **_turns([r[0] for r in rows])}

    def part(conv: str, conv_id, rows: list[tuple], number: int) -> dict:
        codes = bytes(row_code(role, faults_of(role, text)) for _, role, text, _ in rows)
        keys = [None if c % 4 == BLANK else f"{len(r[1])}:{r[1]}{r[3]}" for c, r in zip(codes, rows, strict=True)]
        return {
            "conv": conv, "conv_id": conv_id, "piece": number, "whole": False, **_turns([r[0] for r in rows]),
            "codes": codes, "roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "keys": keys,
        }

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, conv_id, rows, out, number, begun = None, None, [], [], 0, True  # begun: may have begun elsewhere
        for batch in batches:
            for own, own_id, turn, role, text, digest, dropped, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != conv:
                    if conv is not None:
                        if begun:
                            out.append(part(conv, conv_id, rows, number))
                            number += 1
                        else:
                            out.append(whole(conv, conv_id, rows))
                        begun = False
                    else:
                        number = place << 32
                    conv, conv_id, rows = own, own_id, []
                if not dropped:
                    rows.append((turn, role, text, digest))
                if len(rows) == piece:
                    out.append(part(conv, conv_id, rows, number))
                    number, rows, begun = number + 1, [], True
                if len(out) >= 256:
                    yield _batch(out, _PIECE_TYPES, id_type)
                    out = []
        if conv is not None:
            out.append(part(conv, conv_id, rows, number))
        if out:
            yield _batch(out, _PIECE_TYPES, id_type)

    return gather


def pieces_of(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Whole conversations, repaired, and the pieces of long ones and of those at the edge of a partition.

    Rows are dealt by ranges of conversation and turn, so a conversation of any length is spread over
    as many tasks as it needs. Rows of one turn stand by role, then the first 64 characters of the
    text, then its digest.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("_digest"), F.col("_tie")]
    dealt = damaged(rows).withColumn("_digest", F.md5("text"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = dealt.select("conv", "conv_id", "turn", "role", "text", "_digest", "dropped", F.spark_partition_id().cast("bigint").alias("_place"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    id_type = _arrow_type(rows)
    return written(columns.mapInArrow(_gathered(id_type, piece), f"conv string, conv_id {kind}, {_PIECES}"), "chat-pieces")


def _arrow_type(rows: DataFrame) -> pa.DataType:
    return to_arrow_type(rows.schema["conv_id"].dataType)


def duplicates_in(pieces: DataFrame) -> DataFrame:
    """conv, piece, again: places of the rows whose role and text stand earlier in the conversation."""
    rows = pieces.select("conv", "piece", F.posexplode("keys").alias("_i", "_key")).where("_key is not null")
    at = F.struct("piece", "_i")
    first = rows.groupBy("conv", "_key").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = rows.join(first.drop("_n"), ["conv", "_key"]).where(at != F.col("_first"))
    return again.groupBy("conv", "piece").agg(F.collect_list("_i").alias("again"))


def followed(functions: DataFrame, stitched: int = STITCHED) -> DataFrame:
    """conv, at, value: what reaches each function when 0 enters the first of its conversation.

    ``functions`` has conv, at (0, 1, ...) and to, the result for every input. Runs of ``stitched``
    functions are composed into one, these again, until one is left; then values go down again.
    """

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chain in batch.column(2).to_pylist():
                now = list(range(len(chain[0]["to"])))
                for link in sorted(chain, key=lambda x: x["at"]):
                    now = [link["to"][x] for x in now]
                out.append(now)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["conv", "at", "to"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, ats, values = [], [], []
            for conv, chain, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for link in sorted(chain, key=lambda x: x["at"]):
                    convs.append(conv)
                    ats.append(link["at"])
                    values.append(value)
                    value = link["to"][value]
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(ats, pa.int64()), pa.array(values, pa.int32())], names=["conv", "at", "value"])

    functions = written(functions, "functions")
    group = F.floor(F.col("at") / stitched).cast("bigint")
    chains = functions.groupBy("conv", group.alias("at")).agg(F.collect_list(F.struct("at", "to")).alias("chain"))
    if functions.where(F.col("at") >= stitched).isEmpty():
        entered = chains.withColumn("value", F.lit(0))
    else:
        above = followed(chains.mapInArrow(compose, "conv string, at bigint, to array<int>"), stitched)
        entered = chains.join(above, ["conv", "at"])
    return entered.select("conv", "at", "chain", "value").mapInArrow(walk, "conv string, at bigint, value int")


def repair(rows: DataFrame, piece: int = PIECE, stitched: int = STITCHED) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations: those handled as a whole, and the pieces of the others.

    Both have conv, conv_id, piece, audit, cost, blank, duplicate, truncated, illegal, repaired (rows of
    role and text), n, low, high, turns. A piece's ``illegal`` includes the pair it forms with the piece
    before, and its ``turns`` does not count a turn that the piece before has too.
    """
    found = pieces_of(rows, piece)
    facts = ["conv", "conv_id", "piece", *[name for name, _ in _FACT_TYPES], "n", "low", "high", "turns"]
    wholes, parts = found.where("whole").select(facts), found.where("not whole")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, numbers, codes, again = (c.to_pylist() for c in batch.columns)
            after = []
            for own, places in zip(codes, again, strict=True):
                own = bytearray(own)
                for i in places or ():
                    own[i] = own[i] // 4 * 4 + DUPLICATE
                after.append(bytes(own))
            to, between = zip(*map(fixed_up, after), strict=True) if after else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(convs, pa.string()), pa.array(numbers, pa.int64()), pa.array(after, pa.binary()), pa.array(to, pa.list_(pa.int32())),
                 pa.array(between, pa.list_(pa.int64()))],
                names=["conv", "piece", "codes", "to", "between"],
            )

    light = parts.select("conv", "piece", "codes", "n", "low", "high").join(duplicates_in(parts), ["conv", "piece"], "left")
    marked = written(
        light.select("conv", "piece", "codes", "again").mapInArrow(mark, "conv string, piece bigint, codes binary, to array<int>, between array<bigint>"), "marked"
    )
    # one row per piece: numbers within the conversation, and what a piece must know of those before it
    along = W.partitionBy("conv").orderBy("piece")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    code_at = lambda i: F.conv(F.hex(F.substring("codes", i, 1)), 16, 10).cast("int")
    count = F.count(F.lit(1)).over(W.partitionBy("conv"))
    placed = parts.select("conv", "piece", "n", "low", "high", "codes").select(
        "conv", "piece", (F.row_number().over(along) - 1).cast("bigint").alias("at"), count.alias("_count"),
        F.when(F.col("n") > 0, code_at(1)).alias("_first"), F.last(F.when(F.col("n") > 0, code_at(-1)), True).over(earlier).alias("_previous"),
        (F.col("low") == F.last("high", True).over(earlier)).alias("_same"),
    )
    placed = written(placed.withColumn("back", F.col("_count") - 1 - F.col("at")), "placed")
    # the vector behind each piece, stitched from the end
    functions = marked.select("conv", "piece", "to").join(placed.select("conv", "piece", "back"), ["conv", "piece"])
    behind = followed(functions.select("conv", F.col("back").alias("at"), "to"), stitched).withColumnsRenamed({"at": "back", "value": "vector"})
    placed = written(placed.join(behind, ["conv", "back"]), "behind")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            for codes, vector in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                vectors, _ = backward(codes, vector)
                to.append([trace(codes, vectors, q).state for q in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, pa.list_(pa.int32()))], names=["conv", "at", "to"])

    coded = marked.select("conv", "piece", "codes").join(placed, ["conv", "piece"])
    states = followed(coded.select("conv", "at", "codes", "vector").mapInArrow(exits, "conv string, at bigint, to array<int>"), stitched)
    known = coded.join(states.withColumnRenamed("value", "state"), ["conv", "at"]).select(
        "conv", "piece", F.col("codes").alias("_codes"), "vector", "state", (F.col("back") == 0).alias("last"),
        F.coalesce(~_legal(F.col("_previous"), F.col("_first")), F.lit(False)).cast("bigint").alias("_broken"),
        F.coalesce("_same", F.lit(False)).cast("bigint").alias("_shared"),
    )
    id_type = _arrow_type(rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("conv", pa.string()), ("conv_id", None), ("piece", pa.int64()), *_FACT_TYPES]
        types += [("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = repair_codes(r["_codes"], r["vector"], r["state"], r["last"], r["roles"], r["texts"])
                own["illegal"] += r["_broken"]
                out.append({**{c: r[c] for c in ("conv", "conv_id", "piece", "n", "low", "high")}, "turns": r["turns"] - r["_shared"], **own})
            yield _batch(out, types, id_type)

    wide = parts.select("conv", "conv_id", "piece", "n", "low", "high", "turns", "roles", "texts").join(known, ["conv", "piece"])
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv string, conv_id {kind}, piece bigint, {_FACTS}, {_REPAIRED}, n int, low bigint, high bigint, turns bigint"
    return wholes, written(wide.mapInArrow(finish, schema), "chat-repaired")


def _legal(before: Column, now: Column) -> Column:
    initial = lambda c: F.floor(c / 4)
    return F.concat_ws(",", initial(before), initial(now)).isin(*[f"{a},{b}" for a, b in sorted(LEGAL)]) | before.isNull() | now.isNull()


def lines(repaired: str = "repaired") -> Column:
    return F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


def long_digests(parts: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of conversations in pieces.

    A digest is sequential by definition: the pieces of a conversation pass through one task, in
    order and one at a time, and only the state of the digest is held.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, said = None, None, False

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

        for batch in batches:
            for own, rows, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != conv:
                    if conv is not None:
                        yield made()
                    conv, state, said = own, hashlib.sha256(), False
                if rows:
                    state.update((("\n" if said else "") + text).encode())
                    said = True
        if conv is not None:
            yield made()

    texts = parts.select("conv", "piece", F.size("repaired").alias("_rows"), lines().alias("_text"))
    dealt = texts.repartition("conv").sortWithinPartitions("conv", "piece")
    return dealt.mapInArrow(digest, "conv string, repaired_sha256 string")


def report(rows: DataFrame, piece: int = PIECE, stitched: int = STITCHED) -> DataFrame:
    """One row per conv_id: gaps, faults, cost, audit and the digest of the repaired conversation.

    Null conv_ids are one conversation; null turns come first and do not count for gaps; repeated rows
    are duplicates of each other; conversations that lose all rows have zeros, an empty audit and the
    digest of the empty text; ``gaps`` beyond a long is null. An empty table gives an empty result.
    Further columns are not read.
    """
    wholes, parts = repair(rows.select("conv_id", "turn", "role", "text"), piece, stitched)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]

    def with_gaps(df: DataFrame) -> DataFrame:
        wide = lambda c: F.col(c).cast("decimal(38,0)")
        gaps = F.coalesce(wide("high") - wide("low") + 1 - F.col("turns"), F.lit(0))
        fits = gaps.between(-(1 << 63), (1 << 63) - 1)
        return df.select("conv_id", F.when(fits, gaps).cast("bigint").alias("gaps"), *counts, "audit", "repaired_sha256")

    whole = wholes.withColumn("repaired_sha256", F.sha2(lines(), 256))
    audits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    joined = parts.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"),
        *[F.sum(c).alias(c) for c in counts], audits.alias("audit"),
    ).join(long_digests(parts), "conv")
    return with_gaps(whole).unionByName(with_gaps(joined))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
