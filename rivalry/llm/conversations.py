"""Repair of conversations whose roles do not alternate.

The role initials of a repaired conversation are ``(s?(ua)+)?``: nothing, or an
optional system turn and then user and assistant in turn. Edits, one letter
each: ``K`` keeps a turn (0), ``R`` gives it the role user or assistant (2),
``D`` deletes it (3; blank and repeated turns must go), ``I`` inserts an empty
turn of user or assistant (2). A truncated turn that stays adds 1.

For every length that the grammar allows there is one string of initials. The
turns are aligned to each of them by Wagner-Fischer tables, whose cells are
limited to the diagonals that can still cost no more than the cheapest
alignment found so far (Ukkonen's band); lengths that cannot reach it are left
out. Each table is traced back to its least audit (the edits' letters in
order), and the audits of the cheapest lengths are compared.

Every conversation crosses the cluster once, its turns in order: first their
marks (initial, faults, a hash), from which the audit is found, then their
texts, to which it is applied as they pass. A task holds the marks of one
conversation and no text but the current one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETYPE, INSERT, DELETE, TRUNCATED = 2, 2, 3, 1
_FAR = np.int64(1) << 40
_GONE = "-"  # the mark of a turn that must be deleted; upper case: truncated


def _target(m: int) -> str:
    return ("s" if m % 2 else "") + "ua" * (m // 2)


def _stay(marks: str) -> dict[str, np.ndarray]:
    """By target initial, what each turn costs that takes that place."""
    out = {}
    for c in "sua":
        cost = [(0 if x.lower() == c else RETYPE if c != "s" else int(_FAR)) + TRUNCATED * x.isupper() if x != _GONE else int(_FAR) for x in marks]
        out[c] = np.array(cost, np.int64)
    return out


def _table(marks: str, stay: dict[str, np.ndarray], m: int, limit: int) -> tuple[np.ndarray, int] | None:
    """Wagner-Fischer costs from every cell (turn i, place j) to the end, in
    the band of the diagonals j - i that a total of ``limit`` can visit:
    (costs by turn and diagonal, the first diagonal). None: no such path."""
    n, shift = len(marks), m - len(marks)
    low, high = min(0, shift), max(0, shift)
    base = INSERT * max(shift, 0) + DELETE * max(-shift, 0)
    if base > limit:
        return None
    slack = (limit - base) // (INSERT + DELETE)  # a step off the way costs one insertion and one deletion
    low, high = low - slack, high + slack
    width = high - low + 1
    cost = np.full((n + 1, width + 1), _FAR)
    at = np.arange(width) + low  # j - i
    ramp = INSERT * np.arange(width, dtype=np.int64)
    alternate = [np.array([stay[c][i] for c in "ua"]) for i in range(n)]
    odd = m % 2
    for i in range(n, -1, -1):
        j = at + i
        inside = (j >= 0) & (j <= m)
        if i == n:
            row = np.where(j == m, 0, _FAR)
        else:
            row = DELETE + np.concatenate([[_FAR], cost[i + 1, : width - 1]])  # turn i goes: diagonal falls by one
            step = alternate[i][(j - odd) % 2]
            if odd:
                step = np.where(j == 0, stay["s"][i], step)
            row = np.minimum(row, np.where(j < m, step + cost[i + 1, :width], _FAR))
            row = np.where(inside, row, _FAR)
        # insertions along the row; none may stand for the system turn
        first = np.flatnonzero((j == 0) & inside) if odd else []
        alone = row[first].copy() if len(first) else None
        row = np.minimum.accumulate((row + ramp)[::-1])[::-1] - ramp
        if alone is not None:
            row[first] = alone
        cost[i, :width] = np.minimum(np.where(inside, row, _FAR), _FAR)
    return cost, low


def _trace(marks: str, stay: dict[str, np.ndarray], m: int, cost: np.ndarray, low: int) -> str:
    """The least audit among the cheapest paths of a table."""
    n, width, target = len(marks), cost.shape[1] - 1, _target(m)

    def left(i, j):
        k = j - i - low
        return int(cost[i, k]) if 0 <= k < width and j <= m else int(_FAR)

    audit, i, j = [], 0, 0
    while i < n or j < m:
        here = left(i, j)
        if i < n and here == DELETE + left(i + 1, j):
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and here == INSERT + left(i, j + 1):
            audit.append("I")
            j += 1
        else:
            audit.append("K" if marks[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return "".join(audit)


def align(marks: str) -> tuple[int, str]:
    """(least cost, least audit) for the marks of a conversation's turns:
    ``s``, ``u``, ``a`` or ``x`` (another role), upper case if truncated,
    ``-`` for a turn that must be deleted."""
    n = len(marks)
    staying = n - marks.count(_GONE)
    stay = _stay(marks)
    best = (DELETE * n, "D" * n)  # the empty conversation

    def least(m):
        return DELETE * max(n - staying, n - m) + INSERT * max(0, m - staying)

    lengths = (m for k in range(n + DELETE * n // INSERT + 2) for m in {staying - k, staying + k} if m >= 2)
    for m in lengths:
        if min(least(m), least(max(2 * staying - m, 2))) > best[0] and m > staying:
            break
        if least(m) > best[0] or (m % 2 and not ("s" in marks or "S" in marks)):
            continue
        found = _table(marks, stay, m, best[0])
        if found and found[0][0, -found[1]] <= best[0]:
            best = min(best, (int(found[0][0, -found[1]]), _trace(marks, stay, m, *found)))
    return best


def align_long(marks: str) -> tuple[int, str]:
    """:func:`align` for very long conversations. The tables of all lengths
    differ only in the place of the end, and a target repeats every two
    places, so their columns fold into four: no turn yet, after the system
    turn, after a user's, after an assistant's. Linear in the turns."""
    n = len(marks)
    stay = _stay(marks)
    # place 0: nothing yet, 1: after s, 2: after u, 3: after a; the initial that a turn takes from a place, and the place after it
    moves = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
    put = {0: 2, 1: 2, 2: 3, 3: 2}
    far = int(_FAR)
    left = np.full((n + 1, 4), _FAR)

    def inserted(row):
        for _ in range(3):
            row = [min(row[q], INSERT + row[put[q]]) for q in range(4)]
        return row

    row = inserted([0, far, far, 0])
    left[n] = row
    cost = {c: v.tolist() for c, v in stay.items()}
    for i in range(n - 1, -1, -1):
        row = inserted([min(DELETE + row[q], *[min(far, cost[c][i] + row[t]) for c, t in moves[q]]) for q in range(4)])
        left[i] = row
    audit, i, q = [], 0, 0
    while i < n or not (q in (0, 3) and left[i, q] == 0):
        here = int(left[i, q])
        if i < n and here == DELETE + left[i + 1, q]:
            audit.append("D")
            i += 1
        elif here == INSERT + left[i, put[q]]:
            audit.append("I")
            q = put[q]
        else:
            options = [("K" if marks[i].lower() == c else "R", t) for c, t in moves[q] if here == cost[c][i] + left[i + 1, t]]
            letter, q = min(options)
            audit.append(letter)
            i += 1
    return int(left[0, 0]), "".join(audit)


LONG = 512  # turns; both ways give the same alignment


def best_edits(marks: str, known: dict) -> tuple[int, str]:
    """The alignment of ``marks``; short ones are kept in ``known``."""
    if len(marks) > LONG:
        return align_long(marks)
    found = known.get(marks) or align(marks)
    if len(marks) <= 64 and len(known) < 50_000:
        known[marks] = found
    return found


class _Conversation:
    """What is known of one conversation while its rows pass."""

    def __init__(self, key, known: dict):
        self.key, self.known = key, known
        self.marks: list[str] = []
        self.seen: set = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.initial = None
        self.audit = None
        self.cost = 0

    def mark(self, turn, role, key, blank, truncated) -> None:
        if turn is not None:
            if self.last is None or turn != self.last:
                self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.marks and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        fault = "blank" if blank else "duplicate" if (role, key) in self.seen else "truncated" if truncated else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.seen.add((role, key))
        letter = initial if initial and initial in "sua" else "x"
        self.marks.append(_GONE if fault in ("blank", "duplicate") else letter.upper() if fault else letter)

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = best_edits("".join(self.marks), self.known)
            self.system = (len(self.audit) - self.audit.count("D")) % 2
            self.seen = set()
            self.step = self.place = 0

    def _alternate(self) -> str:
        return "user" if (self.place - self.system) % 2 == 0 else "assistant"

    def _inserted(self) -> Iterator[tuple]:
        while self.step < len(self.audit) and self.audit[self.step] == "I":
            yield self.step, "I", None, self._alternate(), ""
            self.step += 1
            self.place += 1

    def text(self, turn, role, text) -> Iterator[tuple]:
        """(step, edit, turn, role, text) of the edits up to this turn."""
        yield from self._inserted()
        edit = self.audit[self.step]
        yield self.step, edit, turn, self._alternate() if edit == "R" else role, text
        self.step += 1
        self.place += edit != "D"

    def rest(self) -> Iterator[tuple]:
        self.settle()
        yield from self._inserted()

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EDITS = "step long, edit string, turn long, role string, text string"


def _flow(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, every: DataFrame | None) -> DataFrame:
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).select(
        "conv", "turn", "role", "text", F.substring("text", 1, 32).alias("head"), F.md5("text").alias("key"))
    none = F.lit(None)
    marks = rows.select(
        "conv", F.lit(1).alias("kind"), "turn", "role", "head", "key", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"), none.cast("string").alias("text"))
    texts = rows.select("conv", F.lit(2).alias("kind"), "turn", "role", "head", "key", none.cast("boolean").alias("blank"),
                        none.cast("boolean").alias("truncated"), "text")
    flow = marks.unionByName(texts)
    if every is not None:
        ids = every.select(F.col(conv_col).alias("conv")).distinct().withColumn("kind", F.lit(0))
        flow = flow.unionByName(ids, allowMissingColumns=True)
    order = ["conv", "kind", F.col("turn").asc_nulls_first(), "role", "head", "key"]
    return flow.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "turn", "role", "key", "blank", "truncated", "text")


def _edits(batches) -> Iterator[tuple[_Conversation, Iterator[tuple], bool]]:
    """Every step of every conversation: (conversation, edits, whether it ends)."""
    now, known = None, {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            for conv, kind, turn, role, key, blank, truncated, text in zip(*[c.to_pylist() for c in part.columns]):
                if now is None or conv != now.key:
                    if now is not None:
                        yield now, now.rest(), True
                    now = _Conversation(conv, known)
                if kind == 1:
                    now.mark(turn, role, key, blank, truncated)
                elif kind == 2:
                    now.settle()
                    yield now, now.text(turn, role, text), False
    if now is not None:
        yield now, now.rest(), True


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(df: DataFrame, conv_col: str, rest: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(rest).fields
    spark_schema = T.StructType([T.StructField(conv_col, df.schema[conv_col].dataType), *fields])
    return spark_schema, to_arrow_schema(spark_schema)


def repair(
    df: DataFrame, *, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: its id, ``gaps`` (turn numbers missing
    between the first and the last), ``blank``, ``duplicate`` and ``truncated``
    (turns by their first fault), ``illegal`` (neighbours that are not system
    and user, user and assistant or assistant and user), and of the cheapest
    repair ``cost``, ``audit`` and ``repaired_sha256`` (of its ``role:text``
    lines). With ``every``, each id found there has a row.

    Turns are taken by number, NULL first, ties by role, then by the first 32
    characters of the text, then by its hash. A NULL role or text is one
    space; a role whose initial is not s, u or a (an empty one too) is kept
    nowhere. A turn is blank without a character other than x20 and x09-x0D,
    a duplicate if its role and text came before, truncated if its last such
    character is not one of ``.!?``. Rows with a NULL id are one conversation.
    A conversation without rows has zeros, an empty audit and the hash of an
    empty string. An empty table gives no rows. Other columns are ignored."""
    flow = _flow(df, conv_col, turn_col, role_col, text_col, every)
    schema, arrow = _schema(df, conv_col, _DIGEST)

    def run(batches):
        def rows():
            digest, begun = hashlib.sha256(), False
            for c, edits, ended in _edits(batches):
                for _, edit, _, role, text in edits:
                    if edit != "D":
                        digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                        begun = True
                if ended:
                    yield c.key, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, c.audit, digest.hexdigest()
                    digest, begun = hashlib.sha256(), False

        yield from _batches(rows(), arrow)

    return flow.mapInArrow(run, schema)


def repaired_turns(
    df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per edit of the repair that :func:`repair` describes: the
    conversation's id, ``step`` (from 0), ``edit`` (K, R, D or I), ``turn``
    (NULL if inserted), ``role`` and ``text`` (after the edit). Without the
    deleted ones, in order of ``step``, the rows are the repaired turns."""
    flow = _flow(df, conv_col, turn_col, role_col, text_col, None)
    schema, arrow = _schema(df, conv_col, _EDITS)

    def run(batches):
        yield from _batches(((c.key, *e) for c, edits, _ in _edits(batches) for e in edits), arrow)

    return flow.mapInArrow(run, schema)
