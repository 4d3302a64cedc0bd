"""Weighted point-branch graphs and label propagation on them.

Graphs are coordinate tables (image_id, kind, i, j, w). Walks are solved a component of the point graph at a time, sparsely; scores and embeddings an image at a time, in space proportional to its edges (and, for
scores, the square of its branches). Every solver gives the residual it ends with. Fixed-point forms run as joins and sums on all images together.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twigspark.functions.durable import cut
from twigspark.operators.components import components
from twigspark.operators.hierarchy import bridges
from twigspark.operators.joins import apart, dealt, in_cells, knn_branches, knn_points, knn_targets
from twigspark.operators.sparse import conjugate, smallest, times


def branch_weights(points: DataFrame, targets: DataFrame, k: int = 3, decay: float = 50.0) -> DataFrame:
    """(image_id, id, branch_id, w): e^(-d / decay) to the k nearest branches."""
    return knn_branches(points, targets, k).select("image_id", "id", "branch_id", F.exp(-F.col("distance") / decay).alias("w"))


def point_weights(points: DataFrame, k: int = 5, sigma: float = 50.0) -> DataFrame:
    """(image_id, i, j, w): symmetric, the larger weight where both directions are among the k nearest."""
    near = knn_points(points, k).select("image_id", F.col("id").alias("i"), F.col("other").alias("j"), F.exp(-F.col("distance") / sigma).alias("w"))
    back = near.select("image_id", F.col("j").alias("i"), F.col("i").alias("j"), "w")
    return near.unionByName(back).groupBy("image_id", "i", "j").agg(F.max("w").alias("w"))


def transitions(to_branch: DataFrame, to_point: DataFrame) -> DataFrame:
    """(image_id, i, branch_id or j, p): rows of the walk from points, divided by their sums."""
    both = to_branch.select("image_id", F.col("id").alias("i"), "branch_id", F.lit(None).cast("long").alias("j"), "w").unionByName(to_point.select("image_id", "i", F.lit(None).cast(to_branch.schema["branch_id"].dataType).alias("branch_id"), "j", "w"))
    total = both.groupBy("image_id", "i").agg(F.sum("w").alias("total"))
    return both.join(total, ["image_id", "i"]).withColumn("p", F.col("w") / F.col("total")).drop("w", "total")


def walk_steps(t: DataFrame, steps: int) -> DataFrame:
    """(image_id, id, branch_id, f): F <- Q F + R so many times from F = 0, by join and sum."""
    r = t.where("branch_id is not null").select("image_id", F.col("i").alias("id"), "branch_id", F.col("p").alias("f"))
    q = t.where("j is not null").select("image_id", "i", "j", "p")
    f = r
    for _ in range(steps - 1):
        moved = q.join(f.select("image_id", F.col("id").alias("j"), "branch_id", "f"), ["image_id", "j"]).select("image_id", F.col("i").alias("id"), "branch_id", (F.col("p") * F.col("f")).alias("f"))
        f = moved.unionByName(r).groupBy("image_id", "id", "branch_id").agg(F.sum("f").alias("f"))
    return f


#: Points of a component of the point graph that one kernel solves; larger ones are solved by joins.
KERNEL_POINTS = 200_000


def _absorb(table: pd.DataFrame) -> pd.DataFrame:
    """The exact limit of walk_steps on one component: (D - W) F = B with the weights W between points, B to branches and D their sums, by conjugate gradients, clipped and normalised; a row per point with its most likely branch.

    Rows are (i, branch_id or j, p); p are weights, and the same in both directions between points."""
    points = np.unique(table["i"].to_numpy())
    branch = table["branch_id"].notna().to_numpy()
    to, w = np.searchsorted(points, table["i"].to_numpy()), table["p"].to_numpy(float)
    branches = np.unique(table["branch_id"].to_numpy()[branch]).astype("i8")
    b = np.zeros((len(points), max(1, len(branches))))
    np.add.at(b, (to[branch], np.searchsorted(branches, table["branch_id"].to_numpy()[branch].astype("i8"))), w[branch])
    i, j, v = to[~branch], np.searchsorted(points, table["j"].to_numpy()[~branch].astype("i8")), w[~branch]
    up = i < j  # both directions are in the table, with one weight
    total = np.bincount(to, w, len(points))
    f, off = conjugate(lambda x: total[:, None] * x - times(i[up], j[up], v[up], x), total, b)
    f = np.clip(f, 0, None)
    f /= np.maximum(f.sum(axis=1, keepdims=True), 1e-12)
    best = f.argmax(axis=1)
    return pd.DataFrame({"image_id": table["image_id"].iloc[0], "id": points, "branch_id": branches[best] if len(branches) else -1, "probability": f[np.arange(len(points)), best], "residual": off})


def absorbed_by_steps(t: DataFrame, tolerance: float = 1e-10, steps: int = 16, rounds: int = 200) -> DataFrame:
    """(image_id, id, branch_id, probability, residual) by the walk itself, for components that no kernel holds: so many steps a round, until no score changes by more than tolerance."""
    r = t.where("branch_id is not null").select("image_id", F.col("i").alias("id"), "branch_id", F.col("p").alias("f"))
    q = t.where("j is not null").select("image_id", "i", "j", "p")
    f, off = cut(r), None
    for _ in range(rounds):
        new = f
        for _ in range(steps):
            moved = q.join(new.select("image_id", F.col("id").alias("j"), "branch_id", "f"), ["image_id", "j"]).select("image_id", F.col("i").alias("id"), "branch_id", (F.col("p") * F.col("f")).alias("f"))
            last, new = new, moved.unionByName(r).groupBy("image_id", "id", "branch_id").agg(F.sum("f").alias("f"))
        new = cut(new)
        off = new.join(f.withColumnRenamed("f", "before"), ["image_id", "id", "branch_id"], "left").agg(F.max(F.abs(F.col("f") - F.coalesce("before", F.lit(0.0))))).first()[0]
        f = new
        if off is None or off <= tolerance:
            break
    w = Window.partitionBy("image_id", "id")
    part = f.withColumns({"probability": F.col("f") / F.sum("f").over(w), "k": F.row_number().over(w.orderBy(F.col("f").desc(), "branch_id"))})
    return part.where("k = 1").select("image_id", "id", "branch_id", "probability", F.lit(off).cast("double").alias("residual"))


def random_walk(points: DataFrame, targets: DataFrame, k: int = 3, k_points: int = 5, sigma: float = 50.0, kernel_points: int = KERNEL_POINTS) -> DataFrame:
    """(image_id, id, branch_id, probability, residual) by an absorbing walk. Branch-branch edges leave it unchanged: only rows of points are solved.

    A component of the point graph is solved apart from the others, as no walk leads from one to another."""
    to_branch = cut(branch_weights(points, targets, k, sigma))
    to_point = cut(point_weights(points, k_points, sigma))
    node = lambda c: F.struct("image_id", F.col(c).alias("id"))
    root = components(to_point.where("i < j").select(node("i").alias("a"), node("j").alias("b"))).select("node.image_id", F.col("node.id").alias("i"), F.col("root.id").alias("root"))
    none = lambda kind: F.lit(None).cast(kind)
    both = to_branch.select("image_id", F.col("id").alias("i"), F.col("branch_id").cast("long").alias("branch_id"), none("long").alias("j"), "w").unionByName(to_point.select("image_id", "i", none("long").alias("branch_id"), "j", "w"))
    rows = cut(both.withColumnRenamed("w", "p").join(root, ["image_id", "i"], "left").withColumn("root", F.coalesce("root", "i")))
    large = cut(rows.groupBy("image_id", "root").agg(F.count_distinct("i").alias("n")).where(F.col("n") > kernel_points).select("image_id", "root"))
    shape = "image_id long, id long, branch_id long, probability double, residual double"
    if large.isEmpty():
        return dealt(rows, "root").groupBy("image_id", "root").applyInPandas(_absorb, shape)
    few = rows.join(large, ["image_id", "root"], "left_anti").groupBy("image_id", "root").applyInPandas(_absorb, shape)
    rest = rows.join(large, ["image_id", "root"], "left_semi").withColumnRenamed("p", "w")
    t = transitions(rest.where("branch_id is not null").select("image_id", F.col("i").alias("id"), "branch_id", "w"), rest.where("j is not null").select("image_id", "i", "j", "w"))
    return few.unionByName(absorbed_by_steps(cut(t)))


def branch_scores(weights: pd.DataFrame, edges: pd.DataFrame, alpha: float, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """(branches, scores u of branches by branches, largest component of the gradient) at the optimum of -mean log softmax(u_i)_i + alpha / 2 tr(u' L u).

    Points only hang on branches, so at the optimum a point is the weighted mean of its branches: what remains is a convex problem in the branches' scores. Newton's steps are solved by conjugate gradients with
    products alone: L of the points is applied through their weights, and is never made."""
    branches = np.unique(np.r_[weights["branch_id"].to_numpy(), edges["a"].to_numpy(), edges["b"].to_numpy()]).astype("i8")
    n = len(branches)
    pair = np.unique(np.sort(np.searchsorted(branches, edges[["a", "b"]].to_numpy().reshape(-1, 2).astype("i8")), axis=1), axis=0)
    a, b = pair[pair[:, 0] < pair[:, 1]].T
    of, point = np.searchsorted(branches, weights["branch_id"].to_numpy()), np.unique(weights["id"].to_numpy(), return_inverse=True)[1]
    w = weights["w"].to_numpy(float)
    total = np.bincount(point, w)
    share = np.divide(w, total[point], out=np.zeros_like(w), where=total[point] > 0)
    diagonal = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + np.bincount(of, w * (1 - share), n)
    one = np.ones(len(a))
    own = np.bincount(of, w, n) + np.bincount(a, minlength=n) + np.bincount(b, minlength=n)

    def laplacian_times(x: np.ndarray) -> np.ndarray:
        mean = np.zeros((len(total), x.shape[1]))
        np.add.at(mean, point, share[:, None] * x[of])
        back = np.zeros_like(x)
        np.add.at(back, of, w[:, None] * mean[point])
        return own[:, None] * x - times(a, b, one, x) - back

    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def value(x: np.ndarray) -> float:
        return float(-np.log(np.maximum(softmax(x).diagonal(), 1e-300)).mean() + alpha / 2 * (x * laplacian_times(x)).sum())

    u = np.zeros((n, n))
    off = np.inf
    for _ in range(rounds):
        s = softmax(u)
        gradient = (s - np.eye(n)) / n + alpha * laplacian_times(u)
        off = float(np.abs(gradient).max(initial=0))
        if off <= tolerance:
            break

        def curvature(flat: np.ndarray, s: np.ndarray = s) -> np.ndarray:
            x = flat.reshape(n, n)
            # A hair of the identity: adding one number to a row, or a constant to a class everywhere, changes nothing.
            return ((s * x - s * (s * x).sum(axis=1, keepdims=True)) / n + alpha * laplacian_times(x) + 1e-12 * x).reshape(-1, 1)

        scale = ((s - s * s) / n + alpha * diagonal[:, None] + 1e-12).reshape(-1)
        step = conjugate(curvature, scale, -gradient.reshape(-1, 1), 1e-6, 20 * n)[0].reshape(n, n)
        slope, here, length = float((gradient * step).sum()), value(u), 1.0
        while length > 1e-8 and value(u + length * step) > here + 1e-4 * length * slope:
            length /= 2
        u = u + length * step
    return branches, u, off


def _scores(alpha: float, key, weights: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    branches, u, off = branch_scores(weights, edges, alpha)
    i, j = np.indices(u.shape).reshape(2, -1)
    return pd.DataFrame({"image_id": key[0], "branch_id": branches[i], "label": branches[j], "score": u[i, j], "gap": off})


def _laplace(alpha: float, key, weights: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    if not len(weights):
        return pd.DataFrame({"image_id": [], "id": [], "branch_id": [], "gap": []})
    branches, u, off = branch_scores(weights, edges, alpha)
    points, point = np.unique(weights["id"].to_numpy(), return_inverse=True)
    score = np.zeros((len(points), len(branches)))
    w = weights["w"].to_numpy(float)
    np.add.at(score, point, w[:, None] * u[np.searchsorted(branches, weights["branch_id"].to_numpy())])
    # Points that are equally drawn to two branches take the first, whatever the last digits say.
    score = np.round(score / np.maximum(np.bincount(point, w), 1e-300)[:, None], 9)
    return pd.DataFrame({"image_id": key[0], "id": points, "branch_id": branches[score.argmax(axis=1)], "gap": off})


def _with_loops(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """edges and one from each branch to itself: branches that no point and no edge touches are nodes and labels as well."""
    own = targets.where("branch_id is not null").select("image_id", "branch_id").distinct()
    return edges.select("image_id", "a", "b").unionByName(own.select("image_id", F.col("branch_id").alias("a"), F.col("branch_id").alias("b")))


def laplacian_scores(points: DataFrame, targets: DataFrame, edges: DataFrame, k: int = 3, decay: float = 50.0, alpha: float = 1.0) -> DataFrame:
    """(image_id, branch_id, label, score, gap): how much each branch belongs to the label of each, and the largest component of the gradient left."""
    w = branch_weights(points, targets, k, decay)
    return apart(w).cogroup(apart(_with_loops(edges, targets))).applyInPandas(partial(_scores, alpha), "image_id long, branch_id long, label long, score double, gap double")


def score_gradients(scores: DataFrame, weights: DataFrame, edges: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(image_id, branch_id, label, gradient): the gradient of the problem at scores, by joins over the edges and the points' weights."""
    key = ["image_id", "label"]
    top = Window.partitionBy("image_id", "branch_id")
    e = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(top)))
    n = scores.select("image_id", "branch_id").distinct().groupBy("image_id").agg(F.count("*").alias("n"))
    loss = e.join(n, "image_id").select("image_id", "branch_id", "label", "score", ((F.col("e") / F.sum("e").over(top) - (F.col("branch_id") == F.col("label")).cast("int")) / F.col("n")).alias("loss"))
    total = weights.groupBy("image_id", "id").agg(F.sum("w").alias("total"))
    hung = cut(weights.join(total, ["image_id", "id"]))
    mean = hung.join(scores, ["image_id", "branch_id"]).groupBy("image_id", "id", "label").agg((F.sum(F.col("w") * F.col("score")) / F.max("total")).alias("mean"))
    of_points = hung.join(scores, ["image_id", "branch_id"]).join(mean, ["image_id", "id", "label"]).select(*key, "branch_id", (F.col("w") * (F.col("score") - F.col("mean"))).alias("g"))
    both = edges.select("image_id", F.col("a").alias("branch_id"), F.col("b").alias("other")).unionByName(edges.select("image_id", F.col("b").alias("branch_id"), F.col("a").alias("other"))).distinct()
    other = scores.select(*key, F.col("branch_id").alias("other"), F.col("score").alias("s2"))
    of_edges = both.join(scores, ["image_id", "branch_id"]).join(other, [*key, "other"]).select(*key, "branch_id", (F.col("score") - F.col("s2")).alias("g"))
    graph = of_points.unionByName(of_edges).groupBy(*key, "branch_id").agg(F.sum("g").alias("g"))
    return loss.join(graph, [*key, "branch_id"], "left").select("image_id", "branch_id", "label", (F.col("loss") + alpha * F.coalesce("g", F.lit(0.0))).alias("gradient"))


def laplacian(points: DataFrame, targets: DataFrame, edges: DataFrame, k: int = 3, decay: float = 50.0, alpha: float = 1.0) -> DataFrame:
    """(image_id, id, branch_id, gap) by semi-supervised scores on the graph of branches (edges) and points."""
    w = branch_weights(points, targets, k, decay)
    return dealt(w).groupBy("image_id").cogroup(dealt(_with_loops(edges, targets)).groupBy("image_id")).applyInPandas(partial(_laplace, alpha), "image_id long, id long, branch_id long, gap double")


def hybrid(split: DataFrame, solved: DataFrame) -> DataFrame:
    """(image_id, id, branch_id, how): the nearest branch where the ratio is clear, the solver's elsewhere."""
    clear = split.where("nearest").select("image_id", "id", "branch_id", F.lit("nearest").alias("how"))
    rest = split.where("not nearest").select("image_id", "id").join(solved, ["image_id", "id"]).select("image_id", "id", "branch_id", F.lit("solver").alias("how"))
    return clear.unionByName(rest)


def _embedded(dims: int, table: pd.DataFrame) -> pd.DataFrame:
    ends = np.concatenate([table[["kind_a", "a"]].to_numpy("i8"), table[["kind_b", "b"]].to_numpy("i8")])
    nodes, at = np.unique(ends, axis=0, return_inverse=True)
    pair = np.unique(np.sort(at.reshape(2, -1), axis=0), axis=1)
    i, j = pair[:, pair[0] < pair[1]]
    values, v, off = smallest(i, j, np.ones(len(i)), len(nodes), dims + 1)
    values, v, off = values[1:], v[:, 1:], off[1:]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    return pd.DataFrame({"image_id": table["image_id"].iloc[0], "kind": nodes[:, 0], "node": nodes[:, 1], "vector": list(v), "eigenvalues": [values] * len(nodes), "residual": off.max(initial=0)})


#: Kinds of nodes of the graph that is embedded.
PIXEL, FLOWER = 0, 1


def embedding(edges: DataFrame, dims: int = 8) -> DataFrame:
    """(image_id, kind, node, vector, eigenvalues, residual): the eigenvectors after the first of the normalised Laplacian of each image's graph (kind_a, a, kind_b, b), with the largest residual."""
    return dealt(edges).groupBy("image_id").applyInPandas(partial(_embedded, dims), "image_id long, kind long, node long, vector array<double>, eigenvalues array<double>, residual double")


def embedding_graph(points: DataFrame, pixels: DataFrame, edges: DataFrame, k: int = 3, step: float = 1.0) -> DataFrame:
    """(image_id, kind_a, a, kind_b, b): pixels no more than a step apart in either direction, whatever their branches; the closest pixels of branches that an edge (image_id, a, b) joins; each point with its k nearest pixels. Of pixels at one place, the first by ord stands for all."""
    first = Window.partitionBy("image_id", "x", "y").orderBy("ord")
    p = pixels.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    t = in_cells(p.select("image_id", F.col("ord").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty")).withColumns({"x": F.col("tx"), "y": F.col("ty")}), step, False).drop("x", "y")
    own = in_cells(p.select("image_id", F.col("ord").alias("a"), "x", "y"), step, True).join(t, ["image_id", "cx", "cy"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("tx")) <= step) & (F.abs(F.col("y") - F.col("ty")) <= step))
    cross = bridges(edges, p).select("image_id", F.col("pixel_a").alias("a"), F.col("pixel_b").alias("b"))
    hang = knn_targets(points, p, k).select("image_id", F.col("id").alias("a"), F.col("ord").alias("b"))
    kinds = lambda df, a: df.select("image_id", F.lit(a).cast("long").alias("kind_a"), F.col("a").cast("long").alias("a"), F.lit(PIXEL).cast("long").alias("kind_b"), F.col("b").cast("long").alias("b"))
    between = own.select("image_id", "a", "b").unionByName(cross.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return kinds(between, PIXEL).unionByName(kinds(hang, FLOWER)).distinct()


def eigen_residuals(graph: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, dim, residual, norm, cross): of each vector of an embedding, by joins on the edge table: how far it is from an eigenvector, its length, and the largest product with another."""
    end = lambda k, n: F.struct(F.col(k).alias("kind"), F.col(n).alias("node"))
    both = graph.select("image_id", end("kind_a", "a").alias("u"), end("kind_b", "b").alias("v")).unionByName(graph.select("image_id", end("kind_b", "b").alias("u"), end("kind_a", "a").alias("v")))
    degree = both.groupBy("image_id", "u").agg(F.count("*").alias("d"))
    x = cut(found.select("image_id", F.struct("kind", "node").alias("u"), F.posexplode("vector").alias("dim", "x"), "eigenvalues").withColumn("value", F.get("eigenvalues", F.col("dim"))).drop("eigenvalues").join(degree, ["image_id", "u"]))
    moved = both.join(x.select("image_id", F.col("u").alias("v"), "dim", (F.col("x") / F.sqrt("d")).alias("xd")), ["image_id", "v"]).groupBy("image_id", "u", "dim").agg(F.sum("xd").alias("s"))
    off = x.join(moved, ["image_id", "u", "dim"]).withColumn("off", F.col("x") - F.col("s") / F.sqrt("d") - F.col("value") * F.col("x"))
    own = off.groupBy("image_id", "dim").agg(F.sqrt(F.sum(F.col("off") ** 2)).alias("residual"), F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    other = x.select("image_id", "u", F.col("dim").alias("dim2"), F.col("x").alias("x2"))
    cross = x.join(other, ["image_id", "u"]).where("dim <> dim2").groupBy("image_id", "dim", "dim2").agg(F.abs(F.sum(F.col("x") * F.col("x2"))).alias("c")).groupBy("image_id", "dim").agg(F.max("c").alias("cross"))
    return own.join(cross, ["image_id", "dim"], "left").fillna({"cross": 0.0})
