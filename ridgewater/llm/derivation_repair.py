"""Conversation structure repair by Knuth's lightest derivation.

A conversation's rows are read left to right by items ("at", i, state): the first i rows are dealt with and the roles so far
end in ``state``. Further items ("row", i, reading) say what row i may stand for: its own role (Keep), a user's or an
assistant's (Rerole) or nothing (Delete). Deductions join a prefix with a reading of the next row, or add an inserted turn.
Each carries a weight (cost, letter); a conclusion's value is the premises' summed costs and joined letters. Joining adds
to both and keeps the order of two derivations of one item: at equal cost neither of their audits starts the other, since
the rest could only be insertions, which cost. So values are superior functions, and the agenda pops items in order of
(cost, audit) until the goal item is final.

Long conversations are cut into segments of at most ``SEGMENT`` rows. A segment's value is the lightest derivation from each
state to each state; ``FAN`` neighbouring segments at a time are joined by the same agenda, with segments as readings, until
one is left. So no task holds more than a segment's rows, whatever the conversation's length. Only the final hash needs
one pass over a conversation's text in order; it streams and holds one row at a time. The audit itself has a letter an edit.

Nulls are read as one space (a null conversation id as a conversation of its own, a null turn as the first). Rows of one
turn come in the order of role and text; equal rows repeat each other, so the later ones are duplicates. Empty roles have
an empty initial, which no neighbour may follow. A conversation without rows has zeros, an empty audit and the hash of the
empty string. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Hashable, Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewater.operators.scale import global_positions, spread_join
from ridgewater.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT_BITS, FAN = 9, 16
SEGMENT = 1 << SEGMENT_BITS
SPACES = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
ROLES = {"u": "user", "a": "assistant"}
# Which roles may follow a state, named by the last role's initial; the empty state is the start. Where reading may end.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
ENDS = ("", "a")
LEGAL = ("su", "ua", "au")

Item = Hashable
Edge = tuple[tuple[Item, ...], int, str, Item]


def lightest(edges: Iterable[Edge], goals: set[Item]) -> dict[Item, tuple[int, str]]:
    """The lightest value (cost, audit) of each goal that can be derived.

    An edge is (premises, cost, letters, conclusion): the conclusion follows from all premises, at their costs and this one,
    with their audits joined in order and the letters after them. An edge without premises states an axiom.
    """
    final: dict[Item, tuple[int, str]] = {}
    agenda: list[tuple[int, str, int, Item]] = []
    waiting: dict[Item, list[list]] = {}
    for premises, cost, letters, conclusion in edges:
        if premises:
            edge = [len(set(premises)), premises, cost, letters, conclusion]
            for p in set(premises):
                waiting.setdefault(p, []).append(edge)
        else:
            heappush(agenda, (cost, letters, len(agenda), conclusion))
    pushed, left = len(agenda), set(goals)
    while agenda and left:
        cost, audit, _, item = heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        left.discard(item)
        for edge in waiting.get(item, ()):
            edge[0] -= 1
            if edge[0] == 0 and edge[4] not in final:
                _, premises, own, letters, conclusion = edge
                total = own + sum(final[p][0] for p in premises)
                heappush(agenda, (total, "".join(final[p][1] for p in premises) + letters, pushed, conclusion))
                pushed += 1
    return {g: final[g] for g in goals if g in final}


def _row_edges(rows: list[tuple[str, int]], entry: str) -> Iterator[Edge]:
    """Deductions of a segment: rows are (role initial, fault)."""
    yield (), 0, "", ("at", 0, entry)
    for i, (initial, fault) in enumerate(rows):
        more = TRUNCATED if fault == CUT else 0
        yield (), DELETE, "D", ("row", i, "")
        if fault not in (BLANK, DUPLICATE):
            if initial in ("s", "u", "a"):
                yield (), KEEP + more, "K", ("row", i, initial)
            for role in ROLES:
                yield (), REROLE + more, "R", ("row", i, role)
    for i in range(len(rows) + 1):
        for state, following in NEXT.items():
            here = ("at", i, state)
            for role in following:
                if role in ROLES:
                    yield (here,), INSERT, "I", ("at", i, role)
                if i < len(rows):
                    yield (here, ("row", i, role)), 0, "", ("at", i + 1, role)
            if i < len(rows):
                yield (here, ("row", i, "")), 0, "", ("at", i + 1, state)


def _joined_edges(segments: list[dict[tuple[str, str], tuple[int, str]]], entry: str) -> Iterator[Edge]:
    yield (), 0, "", ("at", 0, entry)
    for i, paths in enumerate(segments):
        for (first, last), (cost, audit) in paths.items():
            yield (), cost, audit, ("segment", i, first, last)
            yield (("at", i, first), ("segment", i, first, last)), 0, "", ("at", i + 1, last)


def _paths(edges, n: int, whole: bool, start: bool) -> dict[tuple[str, str], tuple[int, str]]:
    """(entry, exit) -> lightest value; a whole conversation needs the goal alone, reached from the two ends."""
    if whole:
        found = lightest([*edges(""), *(((("at", n, s),), 0, "", "goal") for s in ENDS)], {"goal"})
        return {("", ""): found["goal"]}
    out = {}
    for entry in [""] if start else NEXT:
        for (_, _, last), value in lightest(edges(entry), {("at", n, s) for s in NEXT}).items():
            out[entry, last] = value
    return out


_PATHS = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_SUMMARY = "key string, seq long, head string, tail string, illegal long, paths array<struct<entry: string, exit: string, cost: long, audit: string>>"


def _summaries(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), _PATHS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "seq", "head", "tail", "illegal", "paths"])


def _as_rows(paths: dict[tuple[str, str], tuple[int, str]]) -> list[dict]:
    return [{"entry": a, "exit": b, "cost": c, "audit": t} for (a, b), (c, t) in paths.items()]


def segment_values(segments: DataFrame) -> DataFrame:
    """Summaries of segments: key, seq, start and whole (first or all of the conversation), rows (place, initial, fault)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, seq, start, whole, members in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(m["initial"], m["fault"]) for m in members]
                illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(rows, rows[1:]))
                paths = _paths(lambda entry: _row_edges(rows, entry), len(rows), whole, start)  # noqa: B023
                out.append((key, seq, rows[0][0], rows[-1][0], illegal, _as_rows(paths)))
            yield _summaries(out)

    return segments.select("key", "seq", "start", "whole", "rows").mapInArrow(make, _SUMMARY)


def joined(summaries: DataFrame) -> DataFrame:
    """Every FAN neighbouring segments of a conversation joined to one; seq counts segments from 0."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, seq, whole, members in zip(*(c.to_pylist() for c in batch.columns)):
                segments = [{(p["entry"], p["exit"]): (p["cost"], p["audit"]) for p in m["paths"]} for m in members]
                paths = _paths(lambda entry: _joined_edges(segments, entry), len(segments), whole, seq == 0)  # noqa: B023
                illegal = sum(m["illegal"] for m in members) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(members, members[1:]))
                out.append((key, seq, members[0]["head"], members[-1]["tail"], illegal, _as_rows(paths)))
            yield _summaries(out)

    member = F.struct("seq", "head", "tail", "illegal", "paths")
    group = F.floor(F.col("seq") / FAN)
    grouped = summaries.groupBy("key", group.alias("seq"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return grouped.select("key", "seq", F.col("n") <= FAN, "members").mapInArrow(make, _SUMMARY)


def edits(found: DataFrame) -> DataFrame:
    """key, place, edit, role (of a rerole), before and after (initials of turns inserted there) of every row.

    found: key, audit, spans (first place and number of rows of each segment, in order) and system (where in the audit a
    system's turn is kept). The roles of all other turns follow from the letters, as they must alternate.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "place", "edit", "role", "before", "after"])

        for batch in batches:
            out: list[list] = []
            for key, audit, spans, system in zip(*(c.to_pylist() for c in batch.columns)):
                places = (p for s in spans for p in range(s["place"], s["place"] + s["n"]))
                state, before, last = "", "", None
                for at, letter in enumerate(audit):
                    if letter == "I":
                        state = "a" if state == "u" else "u"
                        before += state
                        continue
                    row = [key, next(places), letter, None, before, ""]
                    if letter == "K":
                        state = "s" if at == system else "a" if state == "u" else "u"
                    elif letter == "R":
                        state = "a" if state == "u" else "u"
                        row[3] = ROLES[state]
                    if last is not None:
                        out.append(last)
                    before, last = "", row
                    if len(out) >= 10_000:
                        yield batch_of(out)
                        out = []
                if last is not None:
                    last[5] = before
                    out.append(last)
            if out:
                yield batch_of(out)

    return found.select("key", "audit", "spans", "system").mapInArrow(make, "key string, place long, edit string, role string, before string, after string")


def hashes(rows: DataFrame, made: DataFrame) -> DataFrame:
    """key, repaired_sha256: the repaired lines of each conversation, hashed as they stream by in order."""
    text = rows.select("key", "place", F.lit(1).alias("kind"), F.col("role").alias("a"), F.col("text").alias("b"), F.lit("").alias("c"), F.lit("").alias("d"))
    edit = made.select("key", "place", F.lit(0).alias("kind"), F.col("edit").alias("a"), F.col("role").alias("b"), F.col("before").alias("c"), F.col("after").alias("d"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, lines = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])

        def add(line: str) -> None:
            nonlocal lines
            digest.update(("\n" + line if lines else line).encode())
            lines += 1

        change = None
        for batch in batches:
            for key, _, kind, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns)):
                if key != current:
                    if current is not None:
                        yield done()
                    current, digest, lines = key, hashlib.sha256(), 0
                if kind == 0:
                    change = (a, b, c, d)
                    continue
                letter, role, before, after = change
                for x in before:
                    add(f"{ROLES[x]}:")
                if letter != "D":
                    add(f"{role or a}:{b}")
                for x in after:
                    add(f"{ROLES[x]}:")
        if current is not None:
            yield done()

    both = text.unionByName(edit).repartition("key").sortWithinPartitions("key", "place", "kind")
    return both.mapInArrow(make, "key string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage: key, conv_id, turn, role, text as they then are, and order (what sorts rows of a turn).

    crc32 of "conv_id:turn" modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes its ends of sentences, 3 repeats
    it, 4 makes it a user's.
    """
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    kind = F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")), F.lit(20))
    was = F.struct(F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    out = rows.select("key", "conv_id", "turn", was.alias("order"), kind.alias("kind")).filter("kind != 0")
    out = out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("order.role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("order.text", ".!?", "")).otherwise(F.col("order.text"))
    return out.select("key", "conv_id", "turn", role.alias("role"), text.alias("text"), "order", "copy")


def _keyed(rows: DataFrame) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    return rows.select(F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv)).alias("key"), "conv_id", "turn", "role", "text")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``initial`` and ``fault`` (the first that holds) and drops the text. rows: key, place, role, text."""
    ends = F.rtrim(F.col("text"), F.lit(SPACES))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    own = F.when(ends == "", BLANK).when(~F.substring(ends, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE)
    marked = stage(rows.select("key", "turn", "place", F.substring("role", 1, 1).alias("initial"), own.alias("own"), F.when(ends != "", digest).alias("digest")), "marked")
    first = marked.filter("digest is not null").groupBy("key", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = spread_join(marked, stage(first.drop("n"), "first"), ["key", "digest"], "place", "left")
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("place") > F.col("first"), DUPLICATE).otherwise(F.col("own"))
    return known.select("key", "turn", "place", "initial", fault.alias("fault"))


def in_order(rows: DataFrame) -> DataFrame:
    """Adds ``place``: rows sorted by conversation, turn (nulls first), role and text, in ranges over all tasks."""
    ordered = rows.orderBy("key", F.asc_nulls_first("turn"), "order", "copy").drop("order", "copy")
    return stage(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")


def repaired(conversations: DataFrame) -> DataFrame:
    """Damages and repairs conversations (conv_id, turn, role, text); one row for every conv_id."""
    every = stage(_keyed(conversations), "turns")
    return repair(in_order(damaged(every)), every.select("key", "conv_id").distinct())


def repair(rows: DataFrame, every: DataFrame) -> DataFrame:
    """The repair of rows in order (key, turn, role, text, place) for every conversation in ``every`` (key, conv_id)."""
    marked = stage(with_faults(rows), "faults")
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1))
    wide = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1
    gaps = F.coalesce(wide - F.countDistinct("turn"), F.lit(0)).cast("long")
    stats = stage(
        marked.groupBy("key").agg(gaps.alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(CUT).alias("truncated"),
                                  F.count(F.lit(1)).alias("total"), F.min("place").alias("least")),
        "stats",
    )
    part = F.shiftright("place", SEGMENT_BITS)
    segments = marked.groupBy("key", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("place", "initial", "fault"))).alias("rows"))
    segments = segments.join(stats.select("key", "total", "least"), "key")
    first, n = F.col("rows")[0]["place"], F.size("rows")
    segments = stage(segments.select("key", "part", first.alias("place"), n.alias("n"), "rows", (first == F.col("least")).alias("start"), (n == F.col("total")).alias("whole")), "segments")
    several = segments.filter("not whole").select("key", "place")
    placed = global_positions(several, [F.col("place"), F.col("key")], "position")
    numbered = stage(placed.join(placed.groupBy("key").agg(F.min("position").alias("base"), F.count(F.lit(1)).alias("n")), "key")
                     .select("key", "place", (F.col("position") - F.col("base")).alias("seq"), "n"), "numbered")
    whole = segment_values(segments.filter("whole").withColumn("seq", F.lit(0).cast("long")))
    parts = segment_values(segments.filter("not whole").join(numbered.drop("n"), ["key", "place"]))
    longest = numbered.agg(F.max("n")).first()[0] or 0
    totals = numbered.groupBy("key").agg(F.first("n").alias("n"))
    while longest > 1:
        parts = stage(joined(parts.join(totals, "key")), "joined")
        longest = -(-longest // FAN)
        totals = totals.withColumn("n", F.ceil(F.col("n") / FAN))
    summary = stage(whole.unionByName(parts), "summaries")
    value = F.col("paths")[0]
    found = summary.select("key", "illegal", value["cost"].alias("cost"), value["audit"].alias("audit"), "head")
    spans = segments.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("spans"))
    # The first row that is kept may be a system's, which only the rows can tell; any later kept row goes by the letters.
    made = edits(with_system(found.join(spans, "key"), marked))
    lines = hashes(rows.select("key", "place", "role", "text"), made)
    out = every.join(stats, "key", "left").join(found, "key", "left").join(lines, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def with_system(found: DataFrame, marked: DataFrame) -> DataFrame:
    """Adds ``system``: where in the audit the first letter that is no Delete keeps a system's turn, else null.

    That letter is the row's after as many deleted rows as stand before it.
    """
    gone = F.length("audit") - F.length(F.ltrim(F.col("audit"), F.lit("D")))
    kept = F.substr(F.col("audit"), gone + 1, F.lit(1)) == "K"
    spans = found.withColumn("at", F.when(kept, gone))
    # The place of row number ``at``: spans are in order, so it lies in the span that reaches beyond it.
    reach = F.aggregate(
        "spans",
        F.struct(F.col("at").cast("long").alias("left"), F.lit(None).cast("long").alias("place")),
        lambda x, s: F.when(x["place"].isNull() & (x["left"] < s["n"]), F.struct(x["left"].alias("left"), (s["place"] + x["left"]).alias("place")))
        .otherwise(F.struct((x["left"] - s["n"]).alias("left"), x["place"].alias("place"))),
        lambda x: x["place"],
    )
    asked = spans.withColumn("place", reach)
    system = marked.filter("initial = 's'").select("place", F.lit(True).alias("is_system"))
    return asked.join(system, "place", "left").withColumn("system", F.when(F.col("is_system"), F.col("at")).cast("long"))
