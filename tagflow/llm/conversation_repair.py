"""Repair of conversation structure by cheapest edits, with square-root checkpoints.

A conversation's rows, in order of turn, are kept (0), given the role user or assistant (3), deleted (4, the only choice for blank and duplicate
rows), and empty user or assistant rows are inserted (3), so that the role initials read ``(s?(ua)+)?``; a truncated row that stays costs 3
more.  The automaton has four states: start, after s, after u, after a.  In any state at most one of u and a may follow, so edit letters fix
the path, and the least letter that is tight (its cost and the rest's cost add up to the least cost) gives the ASCII-least of the cheapest edits.

Backward vectors (least cost of the rest for each state) are stored only at checkpoints: a conversation of n rows is cut into blocks of
max(LEAST, square root of n) rows.  Each block gives its 4 x 4 matrix of least costs; the matrices of a conversation lead its end costs back to
every block's end.  Inside a block, vectors are stored at every square root of its length and the stretch between two is worked out again
while walking forward.  A block is walked from each of the four states, and the states are linked through the blocks afterwards, so a
conversation with any number of turns is spread over tasks, none of which holds more than a block or one entry for each block.

Defined cases: null roles and texts are one space; null turns come first; equal turns go by role, then text; a null conversation id is an id
of its own; a role that doesn't begin with s, u or a can't be kept; repeated rows are duplicates but for the first; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.llm.common import BLANKS, cumulated, prepared, written

LEAST = 4096
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: Extra cost of a truncated row that stays, and a cost beyond all others.
CUT_OFF, NEVER = 3, 1 << 40
FAULTS = ["", "truncated", "blank", "duplicate"]
INITIALS = "sua"

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after the one of u and a that may follow each state, and its role.
FOLLOWS = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
_MAY = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
#: A row's code is 4 * fault + initial (3: another one).  Where keeping it leads from each state (-1: nowhere), and the cost of letting it stay.
KEEP_TO = np.array([[_MAY.get((q, INITIALS[c % 4]), -1) if c < 8 and c % 4 < 3 else -1 for q in range(4)] for c in range(16)])
STAY = np.array([NEVER if c >= 8 else CUT_OFF * (c >= 4) for c in range(16)])


def _least_costs() -> np.ndarray:
    """(code, from, to): least cost of passing a row, insertions before it included."""
    before = np.full((4, 4), NEVER)
    for q in range(4):
        one = FOLLOWS[q]
        for n, p in enumerate((q, one, FOLLOWS[one])):
            before[q, p] = min(before[q, p], n * INSERT)
    row = np.full((16, 4, 4), NEVER)
    for c in range(16):
        for q in range(4):
            row[c, q, q] = DELETE
            for to, cost in ((FOLLOWS[q], REROLE + STAY[c]), (KEEP_TO[c, q], KEEP + STAY[c])):
                if to >= 0:
                    row[c, q, to] = min(row[c, q, to], cost)
    return np.minimum((before[None, :, :, None] + row[:, None, :, :]).min(axis=2), NEVER)


PASS = _least_costs()
#: Least cost of ending in each state: what is missing is inserted.
FINISH = np.array([0, 2 * INSERT, INSERT, 0])
TAIL = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}


def _grid(codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes as numbers (row, string), lengths)."""
    size = np.fromiter(map(len, codes), np.int64, len(codes))
    grid = np.zeros((int(size.max(initial=0)), len(codes)), np.int64)
    for i, c in enumerate(codes):
        grid[:len(c), i] = np.frombuffer(c.encode(), np.uint8) - 65
    return grid, size


def passages(codes: list[str]) -> np.ndarray:
    """(string, from, to): least costs of passing all rows of each string."""
    grid, size = _grid(codes)
    out = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(codes), 4, 4)).copy()
    for t in range(len(grid)):
        live = t < size
        out[live] = np.minimum((out[live][:, :, :, None] + PASS[grid[t, live]][:, None, :, :]).min(axis=2), NEVER)
    return out


def behind(passed: np.ndarray) -> np.ndarray:
    """(block, state): least cost of all that follows each block, from the matrices of a conversation's blocks in order."""
    out = np.empty((len(passed), 4), np.int64)
    out[-1] = FINISH
    for k in range(len(passed) - 1, 0, -1):
        out[k - 1] = (passed[k] + out[k]).min(axis=1)
    return out


def walk(codes: list[str], rest: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """(string, state): the state behind each block from each entry state, and the edits, ASCII-least among the cheapest.

    ``rest`` are the costs behind the blocks, ``last`` tells the conversations' last ones.
    """
    grid, size = _grid(codes)
    width, n = len(grid), len(codes)
    stretch = max(1, int(np.ceil(np.sqrt(width))))

    def back(v: np.ndarray, t: int) -> np.ndarray:
        return np.where((t < size)[:, None], (PASS[grid[t]] + v[:, None, :]).min(axis=2), v)

    stored, v = {}, rest
    for t in range(width - 1, -1, -1):
        if (t + 1) % stretch == 0 or t == width - 1:
            stored[t // stretch] = v  # the vector behind a stretch
        v = back(v, t)
    state = np.broadcast_to(np.arange(4), (n, 4)).copy()
    letters = np.zeros((n, 4, 3 * width), np.uint8)
    each = np.arange(n)[:, None]
    for k in range(len(stored)):
        first, stop = k * stretch, min((k + 1) * stretch, width)
        vectors = [stored.pop(k)]
        for t in range(stop - 1, first - 1, -1):
            vectors.append(back(vectors[-1], t))
        for t in range(first, stop):
            now, then = vectors[stop - t], vectors[stop - t - 1]
            code, open_ = grid[t][:, None], np.broadcast_to((t < size)[:, None], (n, 4)).copy()
            for slot in range(3):
                left = now[each, state]
                delete = open_ & (DELETE + then[each, state] == left)
                insert = open_ & ~delete & (INSERT + now[each, FOLLOWS[state]] == left)
                to = KEEP_TO[code, state]
                keep = open_ & ~delete & ~insert & (to >= 0) & (KEEP + STAY[code] + then[each, to] == left)
                rerole = open_ & ~delete & ~insert & ~keep
                at = letters[:, :, 3 * t + slot]
                for chosen, letter in ((delete, "D"), (insert, "I"), (keep, "K"), (rerole, "R")):
                    at[chosen] = ord(letter)
                state = np.where(keep, to, np.where(insert | rerole, FOLLOWS[state], state))
                open_ = insert
    edits = [[bytes(letters[i, q]).replace(b"\0", b"").decode() + (TAIL[int(state[i, q])] if last[i] else "") for q in range(4)] for i in range(n)]
    return state, edits


def _lots(codes: list[str], most: int = 100_000):
    """Index lists of strings of like length with at most ``most`` rows in all, or one string."""
    order, lot = sorted(range(len(codes)), key=lambda i: len(codes[i])), []
    for i in order:
        if lot and (len(lot) + 1) * len(codes[i]) > most:
            yield lot
            lot = []
        lot.append(i)
    if lot:
        yield lot


def faulty(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their rank, codes and first rank of each block)."""
    conv = F.col(id_col)
    own = rows.select(conv.isNull().alias("_none"), F.coalesce(conv, F.lit(0).cast(rows.schema[id_col].dataType)).alias("_conv"), F.col(turn_col).alias("turn"),
                      F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    ranked = cumulated(own, ["_none", "_conv"], ["turn", "role", "text"], None, "repair-rows")
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / F.greatest(F.lit(least), F.ceil(F.sqrt("_count")))))
    bare = F.btrim("text", F.lit(BLANKS))
    initial = F.when(F.substring("role", 1, 1).isin(*INITIALS), F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1).otherwise(3)
    light = ranked.select("_none", "_conv", "_rank", "_block", F.md5(F.concat_ws(":", F.length("role"), "role", "text")).alias("_same"),
                          F.when(bare == "", 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0).alias("_own"), initial.alias("_initial"))
    firsts = light.groupBy("_none", "_conv", "_same").agg(F.min("_rank").alias("_first"))
    fault = F.when((F.col("_own") < 2) & (F.col("_rank") > F.col("_first")), 3).otherwise(F.col("_own"))
    coded = light.join(firsts, ["_none", "_conv", "_same"]).select("_none", "_conv", "_rank", "_block", F.chr((65 + 4 * fault + F.col("_initial")).cast("long")).alias("c"))
    blocks = coded.groupBy("_none", "_conv", "_block").agg(F.min("_rank").alias("_rank"), F.array_sort(F.collect_list(F.struct("_rank", "c"))).alias("x"))
    return ranked, blocks.select("_none", "_conv", "_block", "_rank", F.array_join(F.transform("x", lambda x: x["c"]), "").alias("codes"))


def audits(blocks: DataFrame) -> DataFrame:
    """(_none, _conv, _rank, codes, entry, edits): each block's first rank, its edits and the state it is entered in."""
    key = ["_none", "_conv"]

    @F.pandas_udf("array<long>")
    def passed(codes: pd.Series) -> pd.Series:
        codes, out = codes.tolist(), [None] * len(codes)
        for lot in _lots(codes):
            for i, m in zip(lot, passages([codes[i] for i in lot])):
                out[i] = m.ravel()
        return pd.Series(out)

    @F.pandas_udf("array<array<long>>")
    def ends(matrices: pd.Series) -> pd.Series:
        return pd.Series([list(behind(np.stack([np.asarray(x).reshape(4, 4) for x in m]))) for m in matrices])

    @F.pandas_udf("exits array<int>, edits array<string>")
    def walked(codes: pd.Series, rest: pd.Series, last: pd.Series) -> pd.DataFrame:
        codes, exits, edits = codes.tolist(), [None] * len(codes), [None] * len(codes)
        for lot in _lots(codes):
            state, found = walk([codes[i] for i in lot], np.stack([rest.iloc[i] for i in lot]), last.to_numpy()[lot])
            for i, s, e in zip(lot, state, found):
                exits[i], edits[i] = s.astype(np.int32), e
        return pd.DataFrame({"exits": exits, "edits": edits})

    @F.pandas_udf("array<int>")
    def entered(exits: pd.Series) -> pd.Series:
        out = []
        for blocks_of_one in exits:
            states = [START]
            for e in list(blocks_of_one)[:-1]:
                states.append(int(e[states[-1]]))
            out.append(states)
        return pd.Series(out)

    def listed(df: DataFrame, column: str) -> DataFrame:
        """One entry for each block of a conversation, in order."""
        return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_block", column))).alias("x")).select(*key, F.transform("x", lambda x: x[column]).alias("x"))

    rest = listed(blocks.select(*key, "_block", passed("codes").alias("m")), "m").select(*key, F.size("x").alias("_n"), F.posexplode(ends("x")).alias("_block", "rest"))
    paths = blocks.join(rest.withColumn("_block", F.col("_block").cast("long")), [*key, "_block"]).select(
        *key, "_block", "_rank", "codes", walked("codes", "rest", F.col("_block") == F.col("_n") - 1).alias("w")).select(*key, "_block", "_rank", "codes", "w.*")
    paths = written(paths, "repair-paths")
    entries = listed(paths, "exits").select(*key, F.posexplode(entered("x")).alias("_block", "entry"))
    return paths.join(entries.withColumn("_block", F.col("_block").cast("long")), [*key, "_block"]).select(
        *key, "_rank", "codes", "entry", F.get("edits", F.col("entry")).alias("edits"))


EDITS = "step long, edit string, fault string, initial string, before string, role string, text string"


def edited(batches):
    """Streams sorted rows, a block's edits before its rows, into one row for each edit."""
    key, step, state, codes, edits, at, place = None, 0, START, "", "", 0, 0
    names = ["_none", "_conv", *[c.split()[0] for c in EDITS.split(", ")]]
    for b in batches:
        none, conv, given, entry, role, text, code = (b.column(c).to_pylist() for c in ("_none", "_conv", "edits", "entry", "role", "text", "codes"))
        out = []

        def insert():
            nonlocal step, state, at
            state = int(FOLLOWS[state])
            out.append((*key, step, "I", None, None, None, ROLE[state], ""))
            step, at = step + 1, at + 1

        for i in range(b.num_rows):
            if given[i] is not None:  # a block begins
                if (none[i], conv[i]) != key:
                    key, step = (none[i], conv[i]), 0
                state, codes, edits, at, place = entry[i], code[i], given[i], 0, 0
                continue
            while edits[at] == "I":
                insert()
            c = ord(codes[place]) - 65
            letter, after = edits[at], role[i]
            if letter == "K":
                state = int(KEEP_TO[c, state])
            elif letter == "R":
                state = int(FOLLOWS[state])
                after = ROLE[state]
            out.append((*key, step, letter, FAULTS[c // 4] or None, INITIALS[c % 4] if c % 4 < 3 else "", role[i], after, text[i]))
            step, at, place = step + 1, at + 1, place + 1
            while place == len(codes) and at < len(edits):
                insert()
        if out:
            columns = list(zip(*out))
            kinds = [pa.bool_(), b.schema.field("_conv").type, pa.int64(), *[pa.string()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def edit_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each edit, each conversation's rows together and in order of ``step`` in a partition.

    ``_none`` and ``_conv`` are the key.  ``edit`` is K, R, D or I; ``fault`` (null, truncated, blank, duplicate), ``initial`` and ``before`` (the role) are of the row
    before the edit; ``role`` and ``text`` are after it (of a deleted row: its own).
    """
    prepared(rows.sparkSession)
    ranked, blocks = faulty(rows, id_col, turn_col, role_col, text_col, least)
    blocks = written(blocks, "repair-blocks")
    none = lambda t, *cols: [F.lit(None).cast(t).alias(c) for c in cols]
    heads = audits(blocks).select("_none", "_conv", "_rank", F.lit(0).alias("_kind"), "edits", "entry", *none("string", "role", "text"), "codes")
    body = ranked.select("_none", "_conv", "_rank", F.lit(1).alias("_kind"), *none("string", "edits"), *none("int", "entry"), "role", "text", *none("string", "codes"))
    stream = heads.unionByName(body).repartition("_none", "_conv").sortWithinPartitions("_none", "_conv", "_rank", "_kind")
    kind = rows.schema[id_col].dataType.simpleString()
    return stream.drop("_rank", "_kind").mapInArrow(edited, f"_none boolean, _conv {kind}, {EDITS}")


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """conv_id, step, edit, fault, before, role and text: the repaired conversations are the rows whose edit is not D, by step."""
    conv = F.when(~F.col("_none"), F.col("_conv")).alias("conv_id")
    return edit_rows(rows, id_col, turn_col, role_col, text_col, least).select(conv, "step", "edit", "fault", "before", "role", "text")


DIGEST = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``edit_rows``: its faults, illegal neighbours, cost, edit letters and the hash of the repaired ``role:text`` lines.

    Reads the rows as they come, so a conversation's texts are never together in memory.
    """
    names = ["_none", "_conv", *[c.split()[0] for c in DIGEST.split(", ")]]
    cost = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def summed(batches):
        key, conv_type = None, None

        def row():
            return (*key, n["blank"], n["duplicate"], n["truncated"], illegal, total, "".join(letters), text_hash.hexdigest())

        for b in batches:
            conv_type, out = b.schema.field("_conv").type, []
            for none, conv, edit, fault, initial, role, text in zip(*[b.column(c).to_pylist() for c in ("_none", "_conv", "edit", "fault", "initial", "role", "text")]):
                if (none, conv) != key:
                    if key is not None:
                        out.append(row())
                    key, n, illegal, total, letters = (none, conv), dict.fromkeys(FAULTS, 0), 0, 0, []
                    text_hash, before, lines = hashlib.sha256(), None, 0
                letters.append(edit)
                total += cost[edit] + (CUT_OFF if fault == "truncated" and edit != "D" else 0)
                if edit != "I":
                    n[fault or ""] += 1
                    illegal += before is not None and before + initial not in LEGAL
                    before = initial
                if edit != "D":
                    text_hash.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    lines += 1
            if out:
                yield batch(out, conv_type)
        if key is not None:
            yield batch([row()], conv_type)

    def batch(out, conv_type):
        kinds = [pa.bool_(), conv_type, *[pa.int64()] * 5, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    kind = edits.schema["_conv"].dataType.simpleString()
    return edits.mapInArrow(summed, f"_none boolean, _conv {kind}, {DIGEST}")
