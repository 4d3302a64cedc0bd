import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twigspark.llm import periodic as P


def plain_runs(w):
    """Straight from the definition: all stretches of all periods, those that can be extended or have a smaller period left out."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                a, length = i, j + q - i
                smaller = any(all(w[k] == w[k + r] for k in range(a, a + length - r)) for r in range(1, q))
                if length >= max(6, 4 * q) and not smaller:
                    out.append((a, length, q))
            i = j + 1
    return sorted(out)


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 5), st.integers(1, 6))
def test_runs_equal_the_definition(w, p, k):
    made = w + (w[:p] * k) + w[: p // 2]
    assert P.runs_of(made) == plain_runs(made)


@pytest.mark.parametrize("w", [["a"] * 5, ["a"] * 6, ["a"] * 999, ["a", "b"] * 4, ["a", "b", "a"] * 20, list("aabaabaabaab") * 3, [str(k) for k in range(300)] * 4 + ["0"], ["x"] * 7 + ["y"] + ["x"] * 7])
def test_known_runs(w):
    assert P.runs_of(w) == plain_runs(w)


def test_long_text():
    r = random.Random(4)
    w = [r.choice(["the", "of"] + [f"w{k}" for k in range(500)]) for _ in range(20_000)]
    w[7000:9000] = w[7000:7500] * 4
    assert (7000, 2000, 500) in [(a, min(n, 2000), p) for a, n, p in P.runs_of(w)]
    assert P.runs_of(["a"] * 20_000) == [(0, 20_000, 1)]


def test_report(spark):
    r = random.Random(3)
    texts = [None, "", " \n", "a " * 9, "é\x0bé\x0cé é é é é", "x\x1cy " * 8, "a\x00b " * 7]
    for _ in range(200):
        part = [r.choice("abcdefgh") for _ in range(r.randint(1, 9))]
        texts.append(r.choice([" ", "\n", "\t "]).join([r.choice("abc") for _ in range(r.randint(0, 30))] + part * r.randint(1, 7)))
    rows = [(k, t, "k", 1) for k, t in enumerate(texts)] + [(3, "a " * 9, "k", 1), (None, "b " * 7, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = [tuple(x) for x in P.report(df.repartition(3)).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted((plain(d, t) for d, t, *_ in rows), key=key)
    assert P.report(df.limit(0)).collect() == []


def test_collapse_keeps_columns_and_clean_texts(spark):
    rows = [(1, "so so so so so so it  is", "r", 2.0), (2, "no\n runs  here", "r", None), (3, None, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed double")
    out = P.collapse(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "so it is", "r", 2.0), (2, "no\n runs  here", "r", None), (3, None, None, 1.0)]
