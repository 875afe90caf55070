import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from rivalry.llm import conversations, queries

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def brute(marks):
    """Least (cost, audit) by best-first search over edits."""
    heap, n = [(0, "", 0, "")], len(marks)
    done = set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        tail = made if len(made) < 2 else made[:1] + "." + made[-1]  # what the grammar can still tell
        if (i, tail) in done:
            continue
        done.add((i, tail))
        if i == n and GRAMMAR.fullmatch(made):
            yield cost, audit
            return
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[made[-1:]]
        if i < n:
            x = marks[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, made))
            if x != "-":
                late = x.isupper()
                for c in follow:
                    if x.lower() == c:
                        heapq.heappush(heap, (cost + late, audit + "K", i + 1, made + c))
                    elif c != "s":
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, made + c))
        for c in follow:
            if c != "s" and len(made) < n + 6:
                heapq.heappush(heap, (cost + 2, audit + "I", i, made + c))


def every_edit(marks):
    """Least (cost, audit) by trying all edits, for very short conversations."""
    best = None

    def go(i, made, cost, audit):
        nonlocal best
        if best and (cost > best[0]):
            return
        if i == len(marks) and GRAMMAR.fullmatch(made):
            best = min(best or (cost, audit), (cost, audit))
        if i < len(marks):
            go(i + 1, made, cost + 3, audit + "D")
            x = marks[i]
            if x != "-":
                late = x.isupper()
                if x.lower() in "sua":
                    go(i + 1, made + x.lower(), cost + late, audit + "K")
                for c in "ua":
                    if c != x.lower():
                        go(i + 1, made + c, cost + 2 + late, audit + "R")
        if len(made) < len(marks) + 3:
            for c in "ua":
                go(i, made + c, cost + 2, audit + "I")

    go(0, "", 0, "")
    return best


def test_alignment_against_all_edits():
    import itertools

    for n in range(4):
        for marks in itertools.product("suaxSUA-", repeat=n):
            marks = "".join(marks)
            want = every_edit(marks)
            assert conversations.align(marks) == want, marks
            assert conversations.align_long(marks) == want, marks


def test_both_alignments_agree_on_longer_ones():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        p = rng.dirichlet(np.ones(8) * 0.7)
        marks = "".join(rng.choice(list("suaxSUA-"), n, p=p))
        got = conversations.align(marks)
        assert got == conversations.align_long(marks), marks
        assert got[0] == next(brute(marks))[0], marks


def plain(rows):
    """The contract's columns of one conversation's rows after damage, in order."""
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, marks, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        seen_text = text.strip(SPACE)
        fault = "blank" if not seen_text else "duplicate" if (role, text) in seen else "truncated" if seen_text[-1] not in ".!?" else None
        if fault:
            count[fault] += 1
        seen.add((role, text))
        c = role[:1] if role[:1] in ("s", "u", "a") else "x"
        marks.append("-" if fault in ("blank", "duplicate") else c.upper() if fault else c)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    marks = "".join(marks)
    cost, audit = conversations.align_long(marks)
    out, i = [], 0
    system = (len(audit) - audit.count("D")) % 2
    for e in audit:
        place = "user" if (len(out) - system) % 2 == 0 else "assistant"
        if e == "I":
            out.append(place + ":")
            continue
        if e != "D":
            out.append(f"{rows[i][1] if e == 'K' else place}:{rows[i][2]}")
        i += 1
    assert i == len(rows)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def run(spark, rows, monkeypatch=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return queries.repaired_conversations(df)


def rows_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain(v) for c, v in damaged(rows).items()}
    assert rows_of(queries.QUERIES["op12_conversation_repair"](spark, sf_dir)) == want


def odd_rows():
    rng = np.random.default_rng(9)
    rows = [(1, None, "user", "a."), (1, None, None, None), (2, 5, "tool", "x"), (2, 9, "", "y."), (None, 1, "user", "no id."), (None, None, "user", "no id."),
            (3, 1, "assistant", ""), (4, 1, "user", "é?\n\t"), (4, 1, "user", "tie."), (4, 1, "assistant", "tie."), (4, 1, "user", "tie."), (5, 2, "system", "only")]
    # a conversation of which damage leaves nothing
    gone = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((gone, 1, "user", "lost."))
    for c in range(10, 60):
        for t in range(int(rng.integers(1, 14))):
            rows.append((c, int(t * rng.integers(1, 3)), str(rng.choice(["user", "assistant", "system", "tool"])), str(rng.choice(["Hi.", "", " ", "cut off", "yes!", "why?"]))))
    for t in range(1500):  # longer than the tables go
        rows.append((77, t, ["user", "assistant"][t % 2] if t % 17 else "system", f"turn {t}" + "." * (t % 5 > 0)))
    rows.append((6, 0, "user", "very long " * 200_000))
    return rows, gone


def test_edges(spark):
    rows, gone = odd_rows()
    got = rows_of(run(spark, rows))
    want = {c: plain(v) for c, v in damaged(rows).items()}
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_turns_follow_the_audit(spark):
    rows, _ = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS conv", "1 AS kind", "2 AS key")
    found = {}
    for r in conversations.repaired_turns(df).orderBy("conv_id", "step").collect():
        found.setdefault(r.conv_id, []).append(r)
    for r in conversations.repair(df).collect():
        turns = found[r.conv_id]
        assert "".join(t.edit for t in turns) == r.audit
        kept = [t for t in turns if t.edit != "D"]
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in kept).encode()).hexdigest() == r.repaired_sha256
        assert GRAMMAR.fullmatch("".join(t.role[0] for t in kept))


def test_empty_table_and_ids_of_other_types(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.repair(df).collect() == [] and conversations.repaired_turns(df).collect() == []
    df = spark.createDataFrame([("c", 1, "user", "a."), ("c", 2, "assistant", "b.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.cost, r.audit) for r in conversations.repair(df).collect()] == [("c", 0, "KK")]
