import hashlib
import random
from collections import defaultdict

import pytest

from twigspark.llm import line_dedup as L

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, n_chars long, keep string, pos int"


def key(line):
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in line.strip(SPACES))


def brute(rows, min_docs):
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not key(x) or len(held[key(x)]) < min_docs]
        yield d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()


def made(n=300, seed=3):
    r = random.Random(seed)
    common = ["Menu", "menu ", "É", "é", "Footer\t", "", " ", "Ünï\x0b"]
    rows = []
    for d in range(n):
        lines = [r.choice(common) if r.random() < 0.5 else f"w{r.randint(0, 900)}" for _ in range(r.randint(0, 12))]
        rows.append((d, "\n".join([*lines, *(["HOT line"] * (d % 3 == 0))])))
    rows += [(n, None), (n + 1, ""), (n + 2, "\n".join(["x"] * 20_000 + ["hot LINE"])), (5, rows[5][1]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_matches_brute_force(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = made()
    try:
        got = L.report(spark.createDataFrame([(d, t, 0, "c", 1) for d, t in rows], SCHEMA).repartition(6)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got)) == sorted(brute(rows, 10))


@pytest.mark.parametrize("parts", ["1", "9"])
def test_later_leaves_the_first(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [(d, f"own {d}\nshared") for d in range(40)] + [(99, "shared\nshared")]
    try:
        got = {r.doc_id: (r.text, r.n_chars, r.keep) for r in L.apply(spark.createDataFrame([(d, t, 0, "k", 2) for d, t in rows], SCHEMA), 10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == ("own 0\nshared", 12, "k")
    assert all(got[d][0] == f"own {d}" for d in range(1, 40)) and 99 not in got


def test_empty(spark):
    assert L.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert L.keep_bitmaps(spark.createDataFrame([], SCHEMA)).collect() == []
