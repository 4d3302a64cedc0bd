import numpy as np
from pyspark.sql import functions as F

from twigspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(ids, v, k):
    v = v.astype("f8")
    n = np.sqrt((v * v).sum(axis=1))
    for i in np.flatnonzero(ids % 50 == 0):
        s = (v[i] * v).sum(axis=1) / (n[i] * n)
        best = sorted((-x, int(j)) for x, j in zip(s, ids, strict=True) if j != ids[i])[:k]
        yield int(ids[i]), best


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found.get(q, set()) & {j for _, j in b}) / max(1, len(b)) for q, b in want])


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy())
    got, want = ann.search(df, F.col("id") % 50 == 0).collect(), list(brute(ids, v, 5))
    assert recall(got, want) >= 0.9
    assert len(got) == 5 * len(want)
    at = {int(i): v[k].astype("f8") for k, i in enumerate(ids)}
    for r in got:
        a, b = at[r.query_id], at[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_skew_ties_and_odd_rows(spark):
    r = np.random.default_rng(0)
    near = r.normal(size=8)
    rows = [(i, (near + 0.01 * r.normal(size=8)).tolist()) for i in range(300)]
    rows += [(i, near.tolist()) for i in range(300, 420)]
    rows += [(500, None), (550, []), (600, [0.0] * 8), (650, [float("nan")] * 8), (700, [1.0, None] * 4), (750, [float("inf")] + [0.0] * 7), (800, [1.0, 2.0]), (850, [2.0, 4.0]), (900, [1e-30] * 8), (950, [3e30] * 8), (950, [3e30] * 8)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = ann.search(df, F.col("id") % 50 == 0, hot=20).collect()
    of = {}
    for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
        of.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert {500, 550, 600, 650, 700, 750}.isdisjoint({*of, *(i for v in of.values() for i, _ in v)})
    assert [i for i, _ in of[350]] == [300, 301, 302, 303, 304] and [i for i, _ in of[300]] == [301, 302, 303, 304, 305]
    assert [i for i, _ in of[800]] == [850] and [i for i, _ in of[850]] == [800]
    assert of[900][0][0] == 950 and all(i != 950 for i, _ in of[950])
    assert ann.search(df.limit(0), F.col("id") % 50 == 0).collect() == []


def test_perturbations_are_in_order_of_cost():
    place = np.random.default_rng(1).uniform(size=5)
    cost = lambda s: sum(place[j] ** 2 if d < 0 else (1 - place[j]) ** 2 for j, d in s)
    out = ann.perturbations(place.tolist(), 243)
    assert len(out) == 243 == len({tuple(sorted(s)) for s in out})
    costs = [cost(s) for s in out]
    assert all(a <= b + 1e-12 for a, b in zip(costs, costs[1:], strict=False))


def test_few_and_opposite_candidates_are_all_found(spark):
    r = np.random.default_rng(7)
    hot = r.normal(size=64)
    rows = [(i, r.normal(size=64).tolist()) for i in (0, 1, 2)]  # fewer than k candidates, without structure
    far = [(1000, (-hot).tolist()), *((1001 + i, (hot + 0.001 * r.normal(size=64)).tolist()) for i in range(40))]
    for table, ask in ((rows, 0), (far, 1000)):
        got = ann.search(spark.createDataFrame([(i, v, 0, "x") for i, v in table], SCHEMA), F.col("id") == ask).orderBy("rank").collect()
        ids, v = np.array([i for i, _ in table]), np.array([v for _, v in table], "f4").astype("f8")
        s = v @ v[0] / np.sqrt((v * v).sum(axis=1) * (v[0] @ v[0]))
        assert [x.vec_id for x in got] == [i for _, i in sorted(zip(-s[1:], ids[1:].tolist(), strict=True))][:5]
        assert [x.rank for x in got] == list(range(1, len(got) + 1))


def test_repeated_rows_leave_room_for_others(spark):
    r = np.random.default_rng(8)
    near = r.normal(size=8)
    rows = [(1, near.tolist())] * 20 + [(2, (near * 2).tolist())] + [(10, (near + 0.001 * r.normal(size=8)).tolist()) for _ in range(20)] + [(i, (near + 0.1 * r.normal(size=8)).tolist()) for i in (20, 30, 40, 51)]
    got = ann.search(spark.createDataFrame([(i, v, 0, "x") for i, v in [*rows, (100, near.tolist())]], SCHEMA), F.col("id") == 100).orderBy("rank").collect()
    assert len({x.vec_id for x in got}) == 5 and {1, 2, 10} <= {x.vec_id for x in got}
