import random
import re

import pytest

from twigspark.llm import ngram_join as J

SCHEMA = "doc_id long, text string, n long"


def shingled(t, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words, num, den):
    sets = [(d, shingled(t, words)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def made(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = r.choices(vocabulary, k=60)
    base = [r.choices(vocabulary, k=r.choice([3, 8, 30, 90, 150])) for _ in range(40)]
    rows = []
    for d in range(n):
        w = list(r.choice(base[:5]) if d % 3 == 0 else r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((d, " ".join(w + (passage if d % 4 == 0 else [])).title()))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, rows[0][1]), (n + 6, rows[0][1]), (n + 7, "É é"), (n + 8, "É É")]


@pytest.mark.parametrize(("seed", "words", "num", "hot", "block", "small"), [(1, 4, 85, 48, 1024, 8 << 20), (2, 5, 80, 3, 7, 0), (3, 4, 85, 2, 16, 0)])
def test_matches_brute_force(spark, monkeypatch, seed, words, num, hot, block, small):
    """small = 0: no side of a join is broadcast for its size, and sets with many copies are looked up apart."""
    monkeypatch.setattr(J, "BROADCAST_BYTES", small)
    monkeypatch.setattr(J, "HOT_SETS", 100)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "HOT", hot)
    rows = made(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, J.join(df, words, num, 100).collect()))
    assert got == brute(rows, words, num, 100)
    assert len({c for d, _, c in got}) < len(rows) - 60


def test_empty_and_representatives(spark):
    assert J.join(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(k, "a b c d e f g h", 1) for k in (5, 3, 9)] + [(1, "", 1), (2, None, 1)]
    assert sorted(r.doc_id for r in J.representatives(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 2, 3]


@pytest.mark.parametrize("hot", [2, 48])
def test_runs_over_many_batches(monkeypatch, hot):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(J, "HOT", hot)
    r = np.random.default_rng(0)
    token = np.sort(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9], p=[0.6, *[0.05] * 8], size=500))
    s1 = np.arange(500) * 7 % 501
    seen = set()
    batches = [pa.RecordBatch.from_arrays([pa.array(token[k : k + 17]), pa.array(s1[k : k + 17]), pa.array(s1[k : k + 17] * 0), pa.array(s1[k : k + 17] * 0 + 10)], ["token", "s1", "s2", "n"]) for k in range(0, 500, 17)]
    for b in J._paired(85, 100, iter(batches)):
        for row in b.to_pylist():
            seen.add((row["a1"], row["b1"]))
    for t in range(1, 10):
        own = s1[token == t].tolist()
        if len(own) > hot:
            assert {frozenset(p) for p in seen} >= {frozenset((own[0], x)) for x in own[1:]}
        else:
            assert {frozenset(p) for p in seen} >= {frozenset((x, y)) for x in own for y in own if x != y}


def test_representatives_by_row(spark):
    a, b, c = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    rows = [(1, a, 1), (2, a, 1), (2, b, 1), (3, c, 2), (3, c, 1), (None, a, 1), (None, "n u l l i d s o", 1), (None, "n u l l i d s o", 1), (4, "", 1), (4, "", 1)]
    got = J.representatives(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a, 1), (2, b, 1), (3, c, 1), (None, "n u l l i d s o", 1), (4, "", 1), (4, "", 1)], key=str)


def test_rows_without_or_with_repeated_ids(spark, monkeypatch):
    """Many different texts under the null id and under one id: all links are found, and the join to their texts makes no more rows than there are texts."""
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):
        base = r.choices(vocabulary, k=60)
        rows += [(None, " ".join(base)), (5, " ".join([*base[:-1], "x"])), (1000 + k, " ".join([*base[:-1], "y"]))]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(4)
    seen = spark.sparkContext.accumulator(0)
    plain = J._verified

    def counted(*args):
        def rows_of(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        yield from plain(*args[:-1], rows_of(args[-1]))

    monkeypatch.setattr(J, "_verified", counted)
    got = J.join(df, 5, 80, 100).collect()
    assert len(got) == len(rows) and {x.component_id for x in got} == {5} and 0 < seen.value <= len(rows)
