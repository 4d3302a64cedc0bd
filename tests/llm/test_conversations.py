import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from twigspark.llm import conversations as C

DDL = "conv_id long, turn long, role string, text string, gone boolean"


def faults(rows):
    """(blank, duplicate, truncated) of each of a conversation's rows."""
    seen, out = set(), []
    for role, text in rows:
        trimmed = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        duplicate = not blank and (role, text) in seen
        out.append((blank, duplicate, not blank and not duplicate and trimmed[-1] not in ".!?"))
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by Dijkstra's way over (rows taken, roles given), straight from the edits: single inserts, keeps, renames and deletes."""
    marks = faults(rows)
    best = {(0, ""): (0, "", ())}
    done = {}
    while best:
        at = min(best, key=lambda k: best[k][:2])
        cost, audit, text = done[at] = best.pop(at)
        i, last = at

        def offer(i, name, cost, audit, text):
            if name is None:
                new = (i, last)
            else:
                if last + name[:1] not in ("s", "u", "su", "ua", "au") or not name[:1]:
                    return
                new = (i, name[:1])
            if new not in done and (new not in best or (cost, audit) < best[new][:2]):
                best[new] = (cost, audit, text)

        for name in ("user", "assistant"):
            offer(i, name, cost + 3, audit + "I", (*text, f"{name}:"))
        if i < len(rows):
            (role, t), (blank, duplicate, truncated) = rows[i], marks[i]
            offer(i + 1, None, cost + 4, audit + "D", text)
            if not blank and not duplicate:
                offer(i + 1, role, cost + 3 * truncated, audit + "K", (*text, f"{role}:{t}"))
                for name in ("user", "assistant"):
                    offer(i + 1, name, cost + 3 + 3 * truncated, audit + "R", (*text, f"{name}:{t}"))
    return min(v for (i, last), v in done.items() if i == len(rows) and last in ("", "a"))


def plain(key, rows):
    """rows: (turn, role, text, gone) in any order."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x, gone in rows if not gone))
    turns, said = [t for known, t, _, _ in rows if known], [(r, x) for _, _, r, x in rows]
    cost, audit, text = cheapest(said)
    marks = faults(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (key, gaps, *(sum(m[k] for m in marks) for k in range(3)), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


def made(seed, n, top):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for _ in range(r.randint(0, top)):
            rows.append((c, r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]), r.choice(["Hi.", "Yes!", "no", " \t", "", "é?\n", "a:b.", "Hi."]), r.random() < 0.1))
    return rows


def expected(rows):
    by = defaultdict(list)
    for c, *x in rows:
        by[c].append(x)
    return sorted((plain(c, x) for c, x in by.items()), key=str)


@pytest.mark.parametrize("size,segment", [(8192, 64), (3, 2), (7, 1), (1, 5)])
def test_batches_and_segments_equal_the_definition(monkeypatch, size, segment):
    monkeypatch.setattr(C, "ROWS", size)
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = made(size, 40, 14)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2], x[3]))
    names = [x.split()[0] for x in DDL.split(", ")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in order[k : k + 50]]) for k in range(0, len(order), 50)]
    out = [tuple(x.values()) for b in C.repaired(False)(iter(batches)) for x in b.to_pylist()]
    assert sorted(out, key=str) == expected(rows)


def test_long_conversation(spark):
    r = random.Random(5)
    rows = [(7, k, r.choice(["user", "assistant"]), r.choice([f"t{k}.", f"t{k}"]), False) for k in range(20_000)] + [(8, 0, "user", "a.", False)]
    got = C.repair(spark.createDataFrame(rows, DDL), texts=False).collect()
    want = {x[0]: x for x in (cheap_chain(7, rows[:-1]), plain(8, [rows[-1][1:]]))}
    assert {x[0]: tuple(x) for x in got} == want


def cheap_chain(key, rows):
    """The same by a table over rows, for a conversation too long for `cheapest`; rows are ordered and none is blank or repeated."""
    best = {"": (0, "")}
    for *_, role, text, _ in rows:
        new = {}
        for last, (cost, audit) in best.items():
            for k in range(3):
                off = 3 * (text[-1] != ".")
                ways = [(last, cost + 4, "D"), ("a" if last == "u" else "u", cost + 3 + off, "R")]
                ways += [(role[0], cost + off, "K")] if last + role[0] in ("u", "ua", "au") else []
                for s, c, x in ways:
                    new[s] = min(new.get(s, (1 << 40, "")), (c + 3 * k, audit + "I" * k + x))
                last = "a" if last == "u" else "u"
        best = new
    cost, audit = min((c + 3 * (s == "u"), a + "I" * (s == "u")) for s, (c, a) in best.items())
    out, at = [], iter(rows)
    for x in audit:
        need = "assistant" if len(out) % 2 else "user"
        row = None if x == "I" else next(at)
        if x != "D":
            out.append(f"{need}:{row[3] if row else ''}")
    illegal = sum(a[2][0] == b[2][0] for a, b in zip(rows, rows[1:]))
    return (key, 0, 0, 0, sum(not r[3].endswith(".") for r in rows), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_report_damages_and_repairs(spark):
    rows = [(c, t, r, x, "k") for c, t, r, x, _ in made(1, 150, 9)] + [(3, None, None, None, None), (None, 4, "user", "x" * 100_000, None)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(3)
    damaged = []
    for c, t, r, x, _ in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        damaged += [(c, t, "user" if k == 4 else r, x, k == 0)] * (1 + (k == 3))
    assert sorted((tuple(x) for x in C.report(df).collect()), key=str) == expected(damaged)
    assert C.report(df.limit(0)).collect() == []


def test_texts_are_those_of_the_digest(spark):
    rows = made(2, 60, 8)
    for x in C.repair(spark.createDataFrame(rows, DDL)).collect():
        said = "\n".join(f"{y.role}:{y.text}" for y in x.repaired)
        assert hashlib.sha256(said.encode()).hexdigest() == x.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(y.role[0] for y in x.repaired))
