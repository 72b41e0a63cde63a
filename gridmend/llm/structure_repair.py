"""Repair of conversation structures by least cost, over rows of any number.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``. Rows are kept, given another role or
deleted, and empty turns are inserted. Repairs are paths through a graph whose nodes are (rows consumed, state), with
the states of the pattern: nothing yet, after s, after u, after a. Least costs forward from the source and backward
from the end tell which arcs are tight, on some cheapest path; from the source, the frontier of nodes then moves along
the tight arcs of the least letter, D < I < K < R.

No conversation is brought into one task for this. Rows are sorted into ranges and cut into pieces of PIECE rows. A
conversation that lies in one piece is solved there. Of one that goes on over a cut, each piece gives a 4 x 4 matrix of
least costs; these, one row each, are chained forward and backward. With the costs at its ends a piece knows its tight
arcs, and walks them from each state that the frontier can be in at its start, which is one of four; a second chain
picks which of these walks holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, portions, small_batches, table, written

#: Costs of the edits, and of keeping a row that breaks off.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Rows that one task has in memory for the search.
PIECE = 20_000
#: Characters of a text by which rows of one turn and role are sorted; then by a digest of the whole.
PREFIX = 100
FAR = 1 << 40
#: The states: nothing yet, after s, after u, after a. Where each role leads to from there, and who may be inserted.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
TURN = {0: 2, 1: 2, 3: 2, 2: 3}
ROLE = {2: "user", 3: "assistant"}
SOURCE = [0, FAR, FAR, FAR]
#: Least costs from each state to the end, by insertions alone; what a row's class says is decoded by these.
END = [0, 2 * INSERT, INSERT, 0]
INITIALS = "?sua"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32(conv_id:turn) % 20; nulls are one space but for turn and conv_id
    themselves. 0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it
    the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    return rows.drop("again")


def placed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with ``place``, which is in the order of conversations and of their rows, and the marks of
    each row, written once. Rows are sorted by turn, nulls first; those of one turn by role, the first characters of the text and
    a digest. Equal rows are dealt by a salt, so any number of them can be spread."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    marked = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumns({"last": last, "digest": digest})
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, PREFIX), F.col("digest"), F.col("salt")]
    marked = marked.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    made = marked.select("conv_id", "turn", "role", "text", "digest", (F.col("last") == "").alias("blank"), (~F.col("last").isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("place"))
    return written(made, "placed")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of placed() without texts, with their first fault: blank, duplicate, truncated or null. Whether a row has
    been seen earlier is told by the least place of its role and text, so equal rows never meet in one task."""
    narrow = rows.select("conv_id", "turn", "place", "blank", "open", "digest", F.substring("role", 1, 1).alias("initial"))
    firsts = narrow.groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    row = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return narrow.join(firsts, "place", "left").select("conv_id", "turn", "place", "initial", fault.alias("fault"), (F.col("place") - row % PIECE).alias("piece"))


# the graph of one row: costs are lists of four, one for each state


def _row_class(initial: str, fault: str | None) -> tuple[str, bool, int]:
    return initial if initial and initial in "sua" else "?", fault in ("blank", "duplicate"), CUT_OFF * (fault == "truncated")


def arcs(state: int, row: tuple[str, bool, int] | None) -> list[tuple[str, int, int, bool]]:
    """(letter, cost, next state, whether the row is consumed) of the edits at a node."""
    out = [("I", INSERT, TURN[state], False)]
    if row:
        initial, must_go, more = row
        out.append(("D", DELETE, state, True))
        if not must_go:
            out.append(("R", REROLE + more, TURN[state], True))
            if initial in NEXT and state in NEXT[initial]:
                out.append(("K", more, NEXT[initial][state], True))
    return out


_CLASSES = [(i, g, m) for i in INITIALS for g in (False, True) for m in (0, CUT_OFF)]
_ARCS = {c: [arcs(s, c) for s in range(4)] for c in _CLASSES}
_CONSUMING = {c: [(s, cost, to) for s in range(4) for _, cost, to, used in _ARCS[c][s] if used] for c in _CLASSES}


def inserted_before(cost: list[int]) -> list[int]:
    """Least costs of the nodes of a layer, insertions within it included."""
    a, b, c, d = cost
    u = min(c, a + INSERT, b + INSERT, d + INSERT)
    return [a, b, u, min(d, u + INSERT)]


def inserted_after(cost: list[int]) -> list[int]:
    a, b, c, d = cost
    u = min(c, d + INSERT)
    return [min(a, u + INSERT), min(b, u + INSERT), u, min(d, u + INSERT)]


def forward(cost: list[int], rows: list) -> list[list[int]]:
    """Least costs at each layer from those at the first."""
    layers = [inserted_before(cost)]
    for row in rows:
        after, now = [FAR] * 4, layers[-1]
        for s, c, to in _CONSUMING[row]:
            after[to] = min(after[to], now[s] + c)
        layers.append(inserted_before(after))
    return layers


def backward(cost: list[int], rows: list) -> list[list[int]]:
    """Least costs from each layer to the end, from those at the last."""
    layers = [inserted_after(cost)]
    for row in reversed(rows):
        before, now = [FAR] * 4, layers[-1]
        for s, c, to in _CONSUMING[row]:
            before[s] = min(before[s], now[to] + c)
        layers.append(inserted_after(before))
    return layers[::-1]


def traverse(start: int, rows: list, ahead: list[list[int]], behind: list[list[int]], total: int, closes: bool) -> tuple[list[tuple[int, str, str]], int]:
    """((row, letter, new role) of each edit, state at the end) along tight arcs from ``start``, least letter first.

    Without ``closes`` the walk ends when all rows are consumed: insertions there are those of the next piece.
    """
    edits, layer, frontier = [], 0, {start}
    while layer < len(rows) or (closes and all(behind[layer][s] for s in frontier)):
        row = rows[layer] if layer < len(rows) else None
        tight = [(letter, to, used) for s in frontier for letter, cost, to, used in (_ARCS[row][s] if row else arcs(s, None)) if ahead[layer][s] + cost + behind[layer + used][to] == total]
        letter = min(tight)[0]
        took = {(to, used) for which, to, used in tight if which == letter}
        frontier = {to for to, _ in took}
        new = ROLE[min(frontier)] if letter in "IR" else ""
        edits.append((layer, letter, new))
        layer += any(used for _, used in took)
    return edits, min(frontier)


def _runs(group: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """(start, stop) of each conversation in a sorted piece."""
    ids = group["conv_id"].to_numpy()
    same = (ids[1:] == ids[:-1]) | (pd.isna(ids[1:]) & pd.isna(ids[:-1]))
    cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(ids)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _edge_segments(narrow: DataFrame) -> DataFrame:
    """For the first and the last conversation of each piece, which may go on over its ends: the least costs from each
    state to each, and the initials at the ends."""

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        runs = list(_runs(group))
        out = []
        for start, stop in dict.fromkeys((runs[0], runs[-1])):
            some = group.iloc[start:stop]
            rows = [_row_class(i, f) for i, f in zip(some["initial"], some["fault"], strict=True)]
            costs = []
            for s in range(4):
                costs += forward([0 if k == s else FAR for k in range(4)], rows)[-1]
            out.append((some["conv_id"].iloc[0], some["piece"].iloc[0], costs, some["initial"].iloc[-1]))
        return pd.DataFrame(out, columns=["conv_id", "piece", "costs", "last"])

    as_text = narrow.withColumn("conv_id", F.col("conv_id").cast("string"))
    return as_text.groupBy("piece").applyInPandas(summed, "conv_id string, piece long, costs array<long>, last string")


def _chained(segments: DataFrame) -> DataFrame:
    """The segments of conversations in more than one piece, with the least costs at their ends."""

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece").reset_index(drop=True)
        steps = [np.array(c, np.int64).reshape(4, 4) for c in group["costs"]]
        before, after = [np.array(SOURCE)], [np.array(END)]
        for m in steps[:-1]:
            before.append(np.minimum((before[-1][:, None] + m).min(axis=0), FAR))
        for m in reversed(steps[1:]):
            after.append(np.minimum((m + after[-1][None, :]).min(axis=1), FAR))
        after.reverse()
        known = {"ahead": [b.tolist() for b in before], "behind": [a.tolist() for a in after], "closes": [False] * (len(steps) - 1) + [True], "previous": [None, *group["last"][:-1]]}
        return group[["conv_id", "piece"]].assign(**known).iloc[: len(steps) if len(steps) > 1 else 0].astype({"previous": object})

    return segments.groupBy("conv_id").applyInPandas(chain, "conv_id string, piece long, ahead array<long>, behind array<long>, closes boolean, previous string")


_WALKED = "place long, entry int, leaves int, split boolean, illegal boolean, edits array<struct<letter:string,role:string>>, conv_id string, piece long"


def _walks(narrow: DataFrame, chained: DataFrame) -> DataFrame:
    """The edits at each row; for conversations in more than one piece, by each state that may be entered. Those after the last
    row of a conversation are with that row. ``leaves``: the state at a piece's end, with the last row of the piece."""

    def walk(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        ends = {None if pd.isna(k.conv_id) else k.conv_id: k for k in known.itertuples()}
        out = []
        for start, stop in _runs(group) if len(group) else ():
            some = group.iloc[start:stop]
            name = None if pd.isna(some["conv_id"].iloc[0]) else some["conv_id"].iloc[0]
            rows = [_row_class(i, f) for i, f in zip(some["initial"], some["fault"], strict=True)]
            k = ends.get(name)
            ahead = forward(SOURCE if k is None else list(map(int, k.ahead)), rows)
            behind = backward(END if k is None else list(map(int, k.behind)), rows)
            total = min(a + b for a, b in zip(ahead[0], behind[0], strict=True))
            initials = some["initial"].tolist()
            before = [None if k is None or pd.isna(k.previous) else k.previous, *initials[:-1]]
            illegal = [b is not None and b + i not in ("su", "ua", "au") for b, i in zip(before, initials, strict=True)]
            given = SOURCE if k is None else k.ahead
            for entry in [s for s in range(4) if given[s] < FAR and given[s] + behind[0][s] == total]:
                edits, leaves = traverse(entry, rows, ahead, behind, total, k is None or bool(k.closes))
                at = [[] for _ in rows]
                for layer, letter, role in edits:
                    at[min(layer, len(rows) - 1)].append({"letter": letter, "role": role or None})
                out += [(p, entry, leaves if n == len(rows) - 1 else None, k is not None, x, e, name, piece) for n, (p, x, e, piece) in enumerate(zip(some["place"], illegal, at, some["piece"], strict=True))]
        return pd.DataFrame(out, columns=["place", "entry", "leaves", "split", "illegal", "edits", "conv_id", "piece"]).astype({"leaves": "Int32"})

    as_text = narrow.withColumn("conv_id", F.col("conv_id").cast("string"))
    return as_text.groupBy("piece").cogroup(chained.groupBy("piece")).applyInPandas(walk, _WALKED)


def _entered(walks: DataFrame) -> DataFrame:
    """(conv_id, piece, entry): the state in which the walk of a conversation in more than one piece enters each of them."""

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        state, out = 0, []
        for piece, some in group.sort_values("piece").groupby("piece", sort=True):
            out.append((some["conv_id"].iloc[0], piece, state))
            state = dict(zip(some["entry"], some["leaves"], strict=True))[state]
        return pd.DataFrame(out, columns=["conv_id", "piece", "entry"])

    ends = walks.where("split and leaves is not null").select("conv_id", "piece", "entry", "leaves")
    return ends.groupBy("conv_id").applyInPandas(chain, "conv_id string, piece long, entry int")


def repaired(rows: DataFrame) -> DataFrame:
    """The repair of conversations ``rows`` (conv_id, turn, role, text): one row for each row, in the order of ``place``
    (conv_id, turn, place, fault, illegal, role, text, edits).

    ``fault`` is blank, duplicate, truncated or null. ``illegal``: this row's and the previous row's initials aren't su, ua or
    au. ``edits``: (letter, role) of each edit at this row, in their order: I inserts an empty turn of ``role``, K keeps the row,
    R gives it ``role``, D deletes it; insertions at the end of a conversation follow on its last row. Null roles and texts are
    one space, a null conv_id is a conversation, null turns come first and count in no gap. A role without characters
    can't be kept. Equal rows count one by one: all but the first are duplicates. An empty table gives no rows.
    """
    full = placed(rows)
    narrow = written(faults(full), "faults")
    chained = written(_chained(_edge_segments(narrow)), "chained")
    walks = written(_walks(narrow, chained), "walks")
    entered = _entered(walks).withColumnRenamed("conv_id", "of")
    whole = walks.where("not split").select("place", "illegal", "edits")
    met = (F.col("conv_id").eqNullSafe(F.col("of"))) & (walks["piece"] == entered["piece"]) & (walks["entry"] == entered["entry"])
    cut = walks.where("split").join(entered, met).select("place", "illegal", "edits")
    texts = full.select("conv_id", "turn", "place", "role", "text")
    return texts.join(narrow.select("place", "fault"), "place").join(whole.union(cut), "place")


def _edit_cost(edits: Column, fault: Column) -> Column:
    costs = F.create_map(*[F.lit(x) for kv in (("I", INSERT), ("K", 0), ("R", REROLE), ("D", DELETE)) for x in kv])
    each = F.aggregate(edits, F.lit(0), lambda n, e: n + costs[e["letter"]])
    stays = (fault == "truncated") & ~F.exists(edits, lambda e: e["letter"] == "D")
    return each + F.when(stays, CUT_OFF).otherwise(0)


def digests(fixed: DataFrame) -> DataFrame:
    """Counts, audit and digest of each conversation of ``fixed``, what repaired() gives.

    A SHA-256 takes its bytes one after the other, so a conversation's rows stream through one task, sorted there with
    spilling; it holds the hash, the letters and one batch.
    """
    cost = _edit_cost(F.col("edits"), F.coalesce("fault", F.lit("")))
    rows = fixed.select(F.col("conv_id").cast("string").alias("conv_id"), "place", F.col("turn").cast("long").alias("turn"), "fault", "illegal", "role", "text", "edits", cost.cast("long").alias("cost"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        now, state, out = None, None, []

        def closed(s: dict) -> tuple:
            gaps = s["hi"] - s["lo"] + 1 - s["turns"] if s["turns"] else 0
            return s["conv_id"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["hash"].hexdigest()

        for b in portions(batches):
            for r in b.to_pylist():
                if state is None or r["conv_id"] != now:
                    if state is not None:
                        out.append(closed(state))
                    now = r["conv_id"]
                    state = {"conv_id": now, "turns": 0, "lo": None, "hi": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "any": False}
                if r["turn"] is not None and r["turn"] != state["hi"]:
                    state["lo"] = r["turn"] if state["lo"] is None else state["lo"]
                    state["hi"], state["turns"] = r["turn"], state["turns"] + 1
                if r["fault"]:
                    state[r["fault"]] += 1
                state["illegal"] += bool(r["illegal"])
                state["cost"] += r["cost"]
                for e in r["edits"]:
                    state["audit"].append(e["letter"])
                    if e["letter"] == "D":
                        continue
                    said = ("", "") if e["letter"] == "I" else (r["role"], r["text"])
                    if state["any"]:
                        state["hash"].update(b"\n")
                    state["hash"].update(f"{e['role'] or said[0]}:{said[1]}".encode())
                    state["any"] = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(closed(state), types, strict=True)], names=names)

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return sorted_rows.mapInArrow(fold, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    """Damages all conversations and repairs them: faults, cheapest edits and digest of each.

    See damaged() and repaired() for nulls, empty and very long texts, ties and repeated rows. A conversation with no row left
    has zeros, an empty audit and the hash of nothing. An empty table gives no rows; other columns are never read.
    """
    small_batches(spark)
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = digests(repaired(damaged(rows))).withColumn("of", F.col("conv_id").cast(rows.schema["conv_id"].dataType)).drop("conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    met = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    none = hashlib.sha256(b"").hexdigest()
    return met.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
