"""Queries by name over the test tables, and the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twigspark.functions.durable import cut
from twigspark.functions.geometry import frame_number, natural_key
from twigspark.operators import cluster, counts, evaluate, fit, geodesic, graphs, heat, hierarchy, joins, lsystem, raster, rays, shoots, skeleton, transport
from twigspark.operators.components import components, levels
from twigspark.plans import spaces
from twigspark.sources import files
from twigspark.streaming.arrivals import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The labelled space (l) and the tree space (t) as points (f) and pixels (p).
LABELLED = """lf as (select 1::bigint image_id, vec_id id, embedding[1]::double * 1000 x, embedding[2]::double * 1000 y from embeddings where vec_id % 5 = 0),
lp as (select 1::bigint image_id, vec_id ord, label::bigint branch_id, embedding[1]::double * 1000 x, embedding[2]::double * 1000 y from embeddings where vec_id % 5 <> 0)"""
#: The labelled space as many images.
SEVERAL = LABELLED.replace("1::bigint", "vec_id // 250")
TREE = """t as (select l_suppkey image_id, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey id, l_linenumber::bigint branch_id, l_quantity * 10 x, l_extendedprice / 100 y, l_returnflag from lineitem),
tf as (select * from t where l_returnflag = 'R'), tp as (select image_id, id ord, branch_id, x, y from t where l_returnflag <> 'R')"""
L_PAIRS = "pr as (select f.image_id, f.id, f.x, f.y, p.ord, p.branch_id, p.x tx, p.y ty, (f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y) d2 from lf f join lp p using (image_id))"
T_PAIRS = L_PAIRS.replace("lf f", "tf f").replace("lp p", "tp p")
NEAREST = "nr as (select image_id, id, arg_min(branch_id, struct_pack(d2 := d2, ord := ord)) branch_id, arg_min(ord, struct_pack(d2 := d2, ord := ord)) ord, sqrt(min(d2)) distance from pr group by all)"
MATRIX = "mx as (select image_id, id, branch_id, sqrt(min(d2)) distance from pr group by all)"
RATIO = """two as (select *, row_number() over (partition by image_id, id order by distance, branch_id) k from mx),
sp as (select a.image_id, a.id, a.branch_id, a.distance d1, b.distance d2, coalesce(b.distance / (a.distance + 1e-6), 'inf'::double) ratio from two a left join two b on a.image_id = b.image_id and a.id = b.id and b.k = 2 where a.k = 1)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# Joins


@query(f"with {LABELLED}, {L_PAIRS}, {NEAREST} select id, branch_id, ord, round(distance, 6) distance from nr")
def nearest_branch(spark, sf):
    f, p = spaces.labelled(spark, sf)
    return joins.nearest(f, p).select("id", "branch_id", "ord", r("distance"))


@query(ORACLES["nearest_branch"])
def nearest_branch_by_rings(spark, sf):
    f, p = spaces.labelled(spark, sf)
    return joins.nearest_by_rings(f, p, 20.0).select("id", "branch_id", "ord", r("distance"))


@query(f"with {TREE}, {T_PAIRS}, {NEAREST} select image_id, count(*) flowers, round(avg(distance), 6) mean_distance, round(max(distance), 6) max_distance from nr group by all")
def nearest_branch_stats(spark, sf):
    f, p = spaces.tree(spark, sf)
    return counts.distance_stats(joins.nearest(f.drop("branch_id"), p)).select("image_id", "flowers", r("mean_distance"), r("max_distance"))


@query(f"with {LABELLED}, {L_PAIRS}, {MATRIX} select id, branch_id, round(distance, 6) distance from mx")
def min_distance_matrix(spark, sf):
    return joins.min_distance_matrix(*spaces.labelled(spark, sf)).select("id", "branch_id", r("distance"))


@query(f"with {LABELLED}, {L_PAIRS}, {MATRIX} select id, branch_id, round(exp(-distance / 50), 6) w from mx qualify row_number() over (partition by id order by distance, branch_id) <= 3")
def knn_branch_weights(spark, sf):
    return graphs.branch_weights(*spaces.labelled(spark, sf)).select("id", "branch_id", r("w"))


POINT_EDGES = """nn as (select a.id i, b.id j, exp(-sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 50) w,
row_number() over (partition by a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) k from lf a join lf b on a.id <> b.id and a.image_id = b.image_id),
pe as (select i, j, max(w) w from (select i, j, w from nn where k <= 5 union all select j, i, w from nn where k <= 5) group by all)"""


@query(f"with {LABELLED}, {POINT_EDGES} select i, j, round(w, 6) w from pe")
def knn_point_edges(spark, sf):
    return graphs.point_weights(spaces.labelled(spark, sf)[0]).select("i", "j", r("w"))


@query(f"with {LABELLED} select a.id a, b.id b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) distance from lf a join lf b on a.id < b.id where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900")
def radius_pairs(spark, sf):
    return joins.radius_pairs(spaces.labelled(spark, sf)[0], 30.0).select("a", "b", r("distance"))


@query(f"with {LABELLED}, {L_PAIRS}, {NEAREST} select id, branch_id, ord, round(distance, 6) distance from nr where distance <= 40")
def snapped_points(spark, sf):
    f, p = spaces.labelled(spark, sf)
    return joins.snapped(f, p, 40.0).select("id", "branch_id", "ord", r("distance"))


@query(f"with {LABELLED}, {L_PAIRS}, k as (select id, branch_id, sqrt(d2) d, row_number() over (partition by id order by d2, ord) k from pr) select a.id, a.branch_id, round(a.d, 6) d1, round(b.d, 6) d2, b.d / greatest(a.d, 1e-9) <= 1.5 ambiguous from k a join k b using (id) where a.k = 1 and b.k = 2")
def two_nearest_pixels(spark, sf):
    return joins.two_nearest(*spaces.labelled(spark, sf)).select("id", "branch_id", r("d1"), r("d2"), "ambiguous")


@query(f"with {LABELLED}, c as (select branch_id, avg(x) x, avg(y) y from lp group by all), {L_PAIRS}, {NEAREST}, far as (select f.* from lf f where id not in (select id from nr where distance <= 15)), g as (select far.id, c.branch_id, (far.x - c.x) * (far.x - c.x) + (far.y - c.y) * (far.y - c.y) d2 from far, c) select id, arg_min(branch_id, d2) branch_id, round(sqrt(min(d2)), 6) distance from g group by all")
def rehomed_points(spark, sf):
    f, p = spaces.labelled(spark, sf)
    centres = p.groupBy("image_id", "branch_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("ord", F.col("branch_id"))
    return joins.rehomed(f, joins.radius_nearest(f, p, 15.0), centres).select("id", "branch_id", r("distance"))


@query(f"with {LABELLED}, {L_PAIRS}, {NEAREST} select ord, round(sum(1.0 + id % 3), 6) mass from nr group by all")
def mass_on_nodes(spark, sf):
    f, p = spaces.labelled(spark, sf)
    return joins.mass_to_nodes(f.withColumn("mass", 1.0 + F.col("id") % 3), p).select("ord", r("mass"))


@query("select d.vec_id id, arg_min(e.label, struct_pack(d := list_sum(list_transform(list_zip(d.embedding, e.embedding), lambda p: (p[1]::double - p[2]::double) ** 2)), o := e.vec_id))::bigint branch_id from embeddings d, embeddings e where d.vec_id % 5 = 0 and e.vec_id % 5 <> 0 group by all")
def vector_nearest(spark, sf):
    e = spaces.table(spark, sf, "embeddings")
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    t = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("ord"), F.col("label").cast("long").alias("branch_id"), F.col("embedding").alias("vector"))
    return joins.nearest_vector(q, t).select("id", "branch_id")


STEPS = """s0 as (select id, x, y, unnest(range(31)) k from lf), st as (select id, k, x px, y + k py from s0),
pd as (select st.id, st.k, p.ord, p.branch_id, (px - p.x) * (px - p.x) + (py - p.y) * (py - p.y) d2 from st, lp p),
hit as (select id, true found, arg_min(branch_id, struct_pack(k := k, d := d2, o := ord)) branch_id, arg_min(ord, struct_pack(k := k, d := d2, o := ord)) ord, arg_min(sqrt(d2), struct_pack(k := k, d := d2, o := ord)) distance from pd where k >= 10 and d2 <= 36 group by all),
nohit as (select id, false found, arg_min(branch_id, struct_pack(d := d2, k := k, o := ord)) branch_id, arg_min(ord, struct_pack(d := d2, k := k, o := ord)) ord, sqrt(min(d2)) distance from pd where id not in (select id from hit) group by all)"""


@query(f"with {LABELLED}, {STEPS} select id, found, branch_id, ord, round(distance, 6) distance from (select * from hit union all select * from nohit)")
def march_to_branch(spark, sf):
    f, p = spaces.labelled(spark, sf)
    s = f.withColumns({"dx": F.lit(0.0), "dy": F.lit(1.0)})
    return joins.marched(s, p, 10.0, 20.0, 6.0).select("id", "found", "branch_id", "ord", r("distance"))


# Counts


@query(f"with {TREE}, {T_PAIRS}, {MATRIX}, rk as (select image_id, branch_id, row_number() over (partition by image_id, id order by distance, branch_id) k from mx), b as (select distinct image_id, branch_id from tp) select b.image_id, b.branch_id, count_if(k = 1) flowers, count_if(k <= 3) near from b left join rk using (image_id, branch_id) group by all")
def flowers_per_branch(spark, sf):
    f, p = spaces.tree(spark, sf)
    near = joins.knn_branches(f.drop("branch_id"), p, 3)
    n = near.groupBy("image_id", "branch_id").agg(F.count_if(F.col("rank") == 1).alias("flowers"), F.count("*").alias("near"))
    out = p.select("image_id", "branch_id").distinct().join(n, ["image_id", "branch_id"], "left")
    return out.fillna(0, ["flowers", "near"]).select("image_id", "branch_id", "flowers", "near")


@query(f"with {TREE}, b as (select distinct image_id, branch_id from tp), n as (select image_id, branch_id, count(*) n from tf group by all) select image_id, (branch_id - 1)::int as level, sum(coalesce(n, 0))::bigint flowers, count(*) branches from b left join n using (image_id, branch_id) group by all")
def flowers_per_level(spark, sf):
    f, p = spaces.tree(spark, sf)
    b = p.select("image_id", "branch_id").distinct()
    n = b.agg(F.max("branch_id").alias("n")).select(F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("node"))
    chain = levels(n, n.where("node > 1").select((F.col("node") - 1).alias("a"), F.col("node").alias("b")), n.where("node = 1"))
    lv = b.join(chain.withColumnRenamed("node", "branch_id"), "branch_id")
    return counts.per_level(counts.per_branch(f, b), lv).select("image_id", "level", "flowers", "branches")


@query(f"with {TREE}, b as (select image_id, branch_id, count(*) size_px from tp group by all), n as (select image_id, branch_id, count(*) n from tf group by all), j as (select image_id, branch_id, size_px, coalesce(n, 0) n from b left join n using (image_id, branch_id)) select image_id, branch_id, size_px, n flowers from j union all select image_id, null, sum(size_px)::bigint, sum(n)::bigint from j group by all")
def branch_summary(spark, sf):
    f, p = spaces.tree(spark, sf)
    b = spaces.branches(p).select("image_id", "branch_id", "size_px")
    return counts.branch_summary(counts.per_branch(f, b), b)


@query(f"with {LABELLED}, {L_PAIRS}, {MATRIX}, {RATIO} select id, branch_id, round(d1, 6) d1, round(d2, 6) d2, round(ratio, 6) ratio, ratio > 1.5 as nearest from sp")
def ambiguity_split(spark, sf):
    return counts.ambiguity(joins.two_branches(*spaces.labelled(spark, sf))).select("id", "branch_id", r("d1"), r("d2"), r("ratio"), "nearest")


@query(f"with {LABELLED}, {L_PAIRS}, {MATRIX}, {RATIO} select least(greatest(floor((ratio - 1) / 0.1), 0), 39)::int bin, count(*) n from sp where ratio <> 'inf'::double group by all")
def ambiguity_histogram(spark, sf):
    return counts.ratio_histogram(counts.ambiguity(joins.two_branches(*spaces.labelled(spark, sf))))


@query(f"with {LABELLED}, {L_PAIRS}, {MATRIX}, {RATIO} select t::double threshold, round(count_if(ratio <= t) / count(*), 6) share from sp, (select unnest([1.1, 1.2, 1.5, 2.0, 3.0]::double[]) t) group by all")
def ambiguity_thresholds(spark, sf):
    return counts.ratio_thresholds(counts.ambiguity(joins.two_branches(*spaces.labelled(spark, sf))), [1.1, 1.2, 1.5, 2.0, 3.0]).select("threshold", r("share"))


@query(f"with {TREE} select image_id, count(*) points, sum(x)::bigint flowers, count(distinct branch_id) branches, 0::bigint orphans from tf group by all")
def truth_totals(spark, sf):
    f, _ = spaces.tree(spark, sf)
    return counts.truth_totals(f.withColumn("num_flowers", F.col("x").cast("long")))


@query("select case when value is null then 'missing' when value < 20 then 'low' else 'ok' end status, count(*) n from events group by all")
def run_report(spark, sf):
    e = spaces.table(spark, sf, "events")
    return counts.run_report(e.select(F.when(F.col("value").isNull(), "missing").when(F.col("value") < 20, "low").otherwise("ok").alias("status")))


# Propagation

WALK = f"""{SEVERAL}, {L_PAIRS}, {MATRIX}, {POINT_EDGES}, kb as (select id, branch_id, exp(-distance / 50) w from mx qualify row_number() over (partition by id order by distance, branch_id) <= 3),
tot as (select i, sum(w) tw from (select id i, w from kb union all select i, w from pe) group by all),
rr as (select id i, branch_id, w / tw p from kb join tot on i = id), qq as (select i, j, w / tw p from pe join tot using (i))"""


@query(f"with {WALK} select i id, round(sum(p), 6) total from (select i, p from rr union all select i, p from qq) group by all")
def random_walk_rowsum(spark, sf):
    f, p = spaces.several(spark, sf)
    return graphs.transitions(graphs.branch_weights(f, p), graphs.point_weights(f)).groupBy(F.col("i").alias("id")).agg(F.round(F.sum("p"), 6).alias("total"))


#: The walk over the labelled space as the one image that it is.
WALK_OF_ONE = WALK.replace(SEVERAL, LABELLED).replace(" and a.image_id = b.image_id", "")


def _walk_sql(steps: int) -> str:
    out = f"with {WALK_OF_ONE}, f1 as (select * from rr)"
    for k in range(2, steps + 1):
        out += f", f{k} as (select i, branch_id, sum(p) p from (select q.i, f.branch_id, q.p * f.p p from qq q join f{k - 1} f on f.i = q.j union all select * from rr) group by all)"
    return out + f" select i id, branch_id, round(p, 6) f from f{steps}"


@query(_walk_sql(5))
def random_walk_iter5(spark, sf):
    f, p = spaces.labelled(spark, sf)
    return graphs.walk_steps(graphs.transitions(graphs.branch_weights(f, p), graphs.point_weights(f)), 5).select("id", "branch_id", r("f"))


#: The limit of the walk as the sum of what arrives after each number of steps.
_WALKED = f"""with recursive {WALK}, wk as (select 1 k, i, branch_id, p from rr union all select k + 1, q.i, w.branch_id, sum(q.p * w.p) p from wk w join qq q on q.j = w.i where k < 400 group by k, q.i, w.branch_id),
fs as (select i id, branch_id, sum(p) p from wk group by all),
fw as (select id, branch_id, p / sum(p) over (partition by id) probability from fs qualify row_number() over (partition by id order by p desc, branch_id) = 1)"""


@query(_WALKED + " select id, branch_id, round(probability, 6) probability from fw")
def random_walk_assign(spark, sf):
    return graphs.random_walk(*spaces.several(spark, sf)).select("id", "branch_id", r("probability"))


def _edges(p: DataFrame) -> DataFrame:
    return hierarchy.adjacency(p, 12.0)


@query()
def laplacian_assign(spark, sf):
    f, p = spaces.several(spark, sf)
    return graphs.laplacian(f, p, _edges(p)).select("image_id", "id", "branch_id")


@query()
def hybrid_laplacian(spark, sf):
    f, p = spaces.several(spark, sf)
    return graphs.hybrid(counts.ambiguity(joins.two_branches(f, p)), graphs.laplacian(f, p, _edges(p)))


@query(f"with {SEVERAL}, b as (select image_id, count(distinct branch_id) branches from lp where image_id in (select image_id from lf) group by image_id) select image_id, branches, branches * branches scores, true optimal from b")
def laplacian_optimality(spark, sf):
    """Of each image's scores: that the gradient is gone, checked by joins on the scores and edges, not by the solver."""
    f, p = spaces.several(spark, sf)
    w, edges = graphs.branch_weights(f, p), _edges(p)
    scores = cut(graphs.laplacian_scores(f, p, edges).join(f.select("image_id").distinct(), "image_id", "left_semi"))
    return graphs.score_gradients(scores, w, edges).groupBy("image_id").agg(
        F.count_distinct("branch_id").alias("branches"), F.count("*").alias("scores"), (F.max(F.abs("gradient")) < 1e-7).alias("optimal")
    )


@query(_WALKED + f", {RATIO} select image_id, id, case when ratio > 1.5 then sp.branch_id else fw.branch_id end branch_id, case when ratio > 1.5 then 'nearest' else 'solver' end how from sp join fw using (id)")
def hybrid_random_walk(spark, sf):
    f, p = spaces.several(spark, sf)
    return graphs.hybrid(counts.ambiguity(joins.two_branches(f, p)), graphs.random_walk(f, p))


def embedded_branches(f: DataFrame, p: DataFrame, edges: DataFrame, step: float = 1.0, k: int = 3, dims: int = 8) -> DataFrame:
    """(image_id, id, branch_id): each flower takes the branch of the pixel nearest to it in the embedding of the graph of both."""
    v = cut(graphs.embedding(graphs.embedding_graph(f, p, edges, k, step), dims))
    of = lambda kind: v.where(F.col("kind") == kind).select("image_id", "node", "vector")
    t = of(graphs.PIXEL).join(p.select("image_id", F.col("ord").alias("node"), F.col("branch_id").cast("long").alias("branch_id")), ["image_id", "node"]).withColumnRenamed("node", "ord")
    return joins.nearest_vector_of_image(of(graphs.FLOWER).withColumnRenamed("node", "id"), t, 9).select("image_id", "id", "branch_id")


#: Pixels of the labelled spaces are this far apart, as those of an image are one.
STEP = 60.0


@query()
def embedding_assign(spark, sf):
    f, p = spaces.several(spark, sf)
    return embedded_branches(f, p, _edges(p), STEP)


@query(f"with {SEVERAL} select image_id, unnest(range(8)) dim, true eigenvector, true orthonormal from (select distinct image_id from lf where image_id in (select image_id from lp))")
def embedding_residuals(spark, sf):
    """Each vector of each image's embedding: that it is an eigenvector to 1e-5 and orthonormal to the others, by joins on the edge table."""
    f, p = spaces.several(spark, sf)
    g = cut(graphs.embedding_graph(f, p, _edges(p), 3, STEP))
    r = graphs.eigen_residuals(g, graphs.embedding(g))
    return r.select("image_id", "dim", (F.col("residual") < 1e-5).alias("eigenvector"), ((F.abs(F.col("norm") - 1) < 1e-6) & (F.col("cross") < 1e-6)).alias("orthonormal"))


# Fits

FIT = """st as (select image_id, branch_id, count(*) n, avg(x) cx, avg(y) cy, var_pop(x) sxx, var_pop(y) syy, covar_pop(x, y) sxy from tf group by all),
dr as (select *, case when n = 1 or (sxx = 0 and syy = 0) then 0 when syy >= sxx then sxy / syy else 1 end px, case when n = 1 or (sxx = 0 and syy = 0) then -1 when syy >= sxx then 1 else sxy / sxx end py from st),
ft as (select image_id, branch_id, n, cx, cy, px / sqrt(px * px + py * py) ux, py / sqrt(px * px + py * py) uy, -py / sqrt(px * px + py * py) vx, px / sqrt(px * px + py * py) vy from dr)"""
PROJECT = """pj as (select tf.image_id, tf.branch_id, (x - cx) * ux + (y - cy) * uy t, (x - cx) * vx + (y - cy) * vy r from tf join ft using (image_id, branch_id)),
ex as (select image_id, branch_id, sum(t * t * r) / nullif(sum(t ** 4), 0) q, min(t) t_min, max(t) t_max, sqrt(avg(r * r)) rms from pj group by all),
sh as (select ft.*, t_min, t_max, case when n > 1 then rms else 0 end rms, case when n >= 10 then least(greatest(coalesce(q, 0), -0.0012), 0.0012) else 0 end c from ft join ex using (image_id, branch_id)),
en as (select *, cx + t_min * ux + c * t_min ** 2 * vx lx, cy + t_min * uy + c * t_min ** 2 * vy ly, cx + t_max * ux + c * t_max ** 2 * vx hx, cy + t_max * uy + c * t_max ** 2 * vy hy from sh),
bo as (select *, case when hy >= ly then hx else lx end bottom_x, case when hy >= ly then hy else ly end bottom_y, case when hy >= ly then lx else hx end top_x, case when hy >= ly then ly else hy end top_y from en)"""


@query(f"with {TREE}, h as (select image_id, count(*) n, max(y) - min(y) h from tp group by all) select image_id, round(case when n < 2 or h <= 1 then 1 else h / 350 end, 6) px_per_cm from h")
def px_per_cm(spark, sf):
    return fit.px_per_cm(spaces.tree(spark, sf)[1]).select("image_id", r("px_per_cm"))


@query(f"with {TREE}, {FIT} select image_id, branch_id, n, round(cx * n, 4) sum_x, round(cy * n, 4) sum_y, round(ux, 8) ux, round(uy, 8) uy from ft")
def line_fit(spark, sf):
    return fit.line_fit(spaces.tree(spark, sf)[0], ["image_id", "branch_id"]).select("image_id", "branch_id", "n", F.round(F.col("cx") * F.col("n"), 4).alias("sum_x"), F.round(F.col("cy") * F.col("n"), 4).alias("sum_y"), r("ux", 8), r("uy", 8))


@query(f"with {TREE}, {FIT}, {PROJECT} select image_id, branch_id, round(c, 9) c, round(rms, 4) rms from bo")
def curvature_fit(spark, sf):
    return fit.shoots(spaces.tree(spark, sf)[0], ["image_id", "branch_id"]).select("image_id", "branch_id", r("c", 9), r("rms", 4))


@query(f"with {TREE}, {FIT}, {PROJECT} select image_id, branch_id, round(t_max - t_min, 4) length_px, round(bottom_x, 4) bottom_x, round(bottom_y, 4) bottom_y, round(top_x, 4) top_x, round(top_y, 4) top_y from bo")
def extent_endpoints(spark, sf):
    return fit.shoots(spaces.tree(spark, sf)[0], ["image_id", "branch_id"]).select("image_id", "branch_id", *[r(c, 4) for c in ("length_px", "bottom_x", "bottom_y", "top_x", "top_y")])


@query(f"""with {TREE}, {FIT}, {PROJECT}, k as (select *, (t_max - t_min) / 10 cm, n % 2 = 0 found from bo)
select image_id, branch_id, round(least(greatest((0.4 * exp(-rms / 40) + 0.4 * (case when found then exp(-abs(uy) * 6 / 6) else 0.2 end) + 0.2 * (case when cm < 8 then greatest(0.2, cm / 8) when cm > 80 then greatest(0.2, 80 / greatest(cm, 1)) else 1 end)) * (case when n < 3 or n > 60 then 0.5 else 1 end), 0), 1), 6) confidence from k""")
def confidence_score(spark, sf):
    s = fit.shoots(spaces.tree(spark, sf)[0], ["image_id", "branch_id"])
    c = fit.confidence(F.col("rms"), F.col("n") % 2 == 0, F.abs("uy") * 6, F.col("length_px") / 10, F.col("n"), 40.0, 6.0)
    return s.select("image_id", "branch_id", F.round(c, 6).alias("confidence"))


_GAPS = ", ".join(f"sqrt((a.{p}x - b.{q}x) ** 2 + (a.{p}y - b.{q}y) ** 2)" for p in ("c", "top_", "bottom_") for q in ("c", "top_", "bottom_"))


@query(f"""with {TREE}, {FIT}, {PROJECT} select image_id, a.branch_id a, b.branch_id b, round(least({_GAPS}), 4) gap from bo a join bo b using (image_id)
where a.branch_id < b.branch_id and degrees(acos(least(1, abs(a.ux * b.ux + a.uy * b.uy)))) <= 20 and abs((b.cx - a.cx) * a.vx + (b.cy - a.cy) * a.vy) <= 60 and least({_GAPS}) <= 80""")
def merge_candidates(spark, sf):
    s = fit.shoots(spaces.tree(spark, sf)[0], ["image_id", "branch_id"])
    return fit.merge_candidates(s, "image_id", "branch_id", 20.0, 60.0, 80.0).select("image_id", "a", "b", r("gap", 4))


@query()
def merge_groups(spark, sf):
    s = fit.shoots(spaces.tree(spark, sf)[0], ["image_id", "branch_id"])
    near = fit.merge_candidates(s, "image_id", "branch_id", 20.0, 60.0, 80.0)
    return shoots.merge_groups(s.withColumnRenamed("branch_id", "shoot_id"), near)


# Clusters

_ANISO = f"""with recursive {LABELLED}, md as (select (min(y) + max(y)) / 2 m from lf), hf as (select id, case when y < m then 0 else 1 end half, case when y < m then x * 4 else x end sx, case when y < m then y else y * 4 end sy from lf, md),
ed as (select a.id a, b.id b from hf a join hf b on a.half = b.half and a.id <> b.id and (a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2 <= 3600),
rc as (select id, id root from hf union select rc.id, ed.b from rc join ed on ed.a = rc.root),
lb as (select rc.id, half, min(root) root from rc join hf using (id) group by all),
cl as (select id, dense_rank() over (order by half, root) - 1 as cluster from lb)"""


@query(_ANISO + " select id, cluster::int as cluster from cl")
def cluster_aniso(spark, sf):
    return cluster.aniso_components(spaces.labelled(spark, sf)[0], 60.0).select("id", F.col("cluster").cast("int"))


@query(_ANISO + ", n as (select cluster, count(*) n from cl group by all) select count(*) n_clusters, count_if(n = 1) n_singletons, max(n) max_size, round(avg(n), 6) mean_size from n")
def cluster_sizes(spark, sf):
    return cluster.cluster_sizes(cluster.aniso_components(spaces.labelled(spark, sf)[0], 60.0)).select("n_clusters", "n_singletons", "max_size", r("mean_size"))


@query(f"""with recursive {LABELLED}, ed as (select a.id a, b.id b from lf a join lf b on a.id <> b.id and (4 * (a.x - b.x)) ** 2 + (a.y - b.y) ** 2 <= 3600),
co as (select a id from ed group by all having count(*) + 1 >= 3), ce as (select a, b from ed where a in (select id from co) and b in (select id from co)),
rc as (select id, id root from co union select rc.id, ce.b from rc join ce on ce.a = rc.root), lb as (select id, min(root) root from rc group by all), cl as (select id, dense_rank() over (order by root) - 1 as k from lb),
bd as (select a id, min(k) k from ed join cl on cl.id = b group by all)
select lf.id, coalesce(cl.k, bd.k, -1)::int as cluster from lf left join cl using (id) left join bd using (id)""")
def dbscan_min3(spark, sf):
    return cluster.dbscan(spaces.labelled(spark, sf)[0], 60.0, 3).select("id", "cluster")


# Rays

_NORMALS = f"""{LABELLED}, th as (select * from lp qualify row_number() over (partition by floor(x / 50), floor(y / 50) order by ord) = 1),
nb as (select o.ord, count(*) n, var_pop(p.x) sxx, covar_pop(p.x, p.y) sxy, var_pop(p.y) syy from th o join lp p on (o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y) <= 3600 group by all),
an as (select *, 0.5 * atan2(2 * sxy, sxx - syy) a from nb), no as (select ord, case when n < 2 then 0 when cos(a) > 0 then sin(a) else -sin(a) end nx, case when n < 2 then -1 when cos(a) > 0 then -cos(a) else cos(a) end ny from an)"""


@query(f"with {LABELLED} select ord, branch_id from lp qualify row_number() over (partition by floor(x / 50), floor(y / 50) order by ord) = 1")
def grid_thin(spark, sf):
    return rays.thinned(spaces.labelled(spark, sf)[1], 50.0).select("ord", "branch_id")


def _origins(p: DataFrame) -> DataFrame:
    return rays.local_normals(rays.thinned(p, 50.0), p, 60.0)


@query(f"with {_NORMALS} select ord, round(nx, 6) nx, round(ny, 6) ny from no")
def local_normal(spark, sf):
    return _origins(spaces.labelled(spark, sf)[1]).select("ord", r("nx"), r("ny"))


_FAN = "fn as (select unnest(range({n})) turn, unnest([{a}]::double[]) dev, unnest([{s}]::double[]) side)".format(n=len(rays.fan()), a=", ".join(str(float(a)) for a, _ in rays.fan()), s=", ".join(str(float(s)) for _, s in rays.fan()))
_RAYS = f"""{_NORMALS}, {_FAN}, ry as (select ord, branch_id, x ox, y oy, turn, cos(radians(side * dev)) * nx - sin(radians(side * dev)) * ny dx, sin(radians(side * dev)) * nx + cos(radians(side * dev)) * ny dy from no join th using (ord), fn)"""


@query(f"with {_RAYS} select ord, turn::int turn, round(dx, 6) dx, round(dy, 6) dy from ry where dy <= 1e-6")
def ray_fan(spark, sf):
    return rays.ray_fan(_origins(spaces.labelled(spark, sf)[1])).select("ord", "turn", r("dx"), r("dy"))


def _segments(f: DataFrame) -> DataFrame:
    """Each flower with a segment up and to the right of it."""
    return f.select("image_id", F.col("id").alias("cluster"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 20).alias("bx"), (F.col("y") - 40).alias("by"))


_HITS = f"""{_RAYS}, sg0 as (select id as cluster, x ax0, y ay0, 20 / (sqrt(2000) + 1e-12) sx, -40 / (sqrt(2000) + 1e-12) sy from lf),
sg as (select *, ax0 - 4 * sx ax, ay0 - 4 * sy ay, ax0 + 20 + 4 * sx bx, ay0 - 40 + 4 * sy by_ from sg0),
dt as (select *, dy * (bx - ax) - dx * (by_ - ay) det from ry, sg where dy <= 1e-6),
ht as (select *, ((ay - oy) * (bx - ax) - (ax - ox) * (by_ - ay)) / det t, (dx * (ay - oy) - dy * (ax - ox)) / det s from dt where abs(det) >= 1e-12),
hh as (select *, ox + t * dx hx, oy + t * dy hy from ht where t between 0 and 300 and s between 0 and 1)"""


@query(f"with {_HITS} select cluster, ord, turn::int turn, round(t, 6) t, round(s, 6) s from hh")
def ray_hits(spark, sf):
    f, p = spaces.labelled(spark, sf)
    o = rays.ray_fan(_origins(p)).withColumnsRenamed({"x": "ox", "y": "oy"})
    return joins.ray_hits(o, rays.extended(_segments(f), 4.0), 300.0).select("cluster", "ord", "turn", r("t"), r("s"))


@query(f"""with {_HITS}, f1 as (select *, abs(dx * sx + dy * sy) + 0.5 * exp(-sqrt((hx - ax0) ** 2 + (hy - ay0) ** 2) / 30) score from hh qualify row_number() over (partition by cluster, ord order by turn) = 1)
select cluster, ord, branch_id, turn::int turn, round(score, 6) score from f1 qualify row_number() over (partition by cluster order by score desc, ord) = 1""")
def ray_winner(spark, sf):
    f, p = spaces.labelled(spark, sf)
    return rays.winners(rays.ray_fan(_origins(p)), _segments(f), 300.0).select("cluster", "ord", "branch_id", "turn", r("score"))


@query(f"with {_HITS}, {L_PAIRS}, {NEAREST} select id, branch_id, round(distance, 6) distance from nr where id not in (select cluster from hh where t <= 8)")
def unhit_clusters(spark, sf):
    """Segments that no ray hits, with the branch nearest to their basal end."""
    f, p = spaces.labelled(spark, sf)
    s = _segments(f)
    return rays.unhit(s, rays.winners(rays.ray_fan(_origins(p)), s, 8.0), p).select("id", "branch_id", r("distance"))


@query(f"""with {LABELLED}, c as (select id, 0.0::double ox, 0.0::double oy, x hx, y hy, x + 10 tx, y - 10 ty from lf), k as (select *, unnest(range(30)) k from c), u as (select *, k / 29.0::double u, (ox + tx) / 2 + 0.25 * (hx - (ox + tx) / 2) qx, (oy + ty) / 2 + 0.25 * (hy - (oy + ty) / 2) qy from k)
select id, k::int k, round((1 - u) ** 2 * ox + 2 * (1 - u) * u * qx + u * u * tx, 4) x, round((1 - u) ** 2 * oy + 2 * (1 - u) * u * qy + u * u * ty, 4) y from u""")
def bezier_points(spark, sf):
    f, _ = spaces.labelled(spark, sf)
    c = f.select("id", F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.col("x").alias("hx"), F.col("y").alias("hy"), (F.col("x") + 10).alias("tx"), (F.col("y") - 10).alias("ty"))
    return rays.smoothed(c).select("id", F.posexplode("curve").alias("k", "p")).select("id", "k", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


# Hierarchy

_COLOURS = "px as (select p_partkey % 40 x, floor(p_partkey / 40)::bigint y, (p_size * 5 % 256)::int b, (floor(p_retailprice)::bigint % 256)::int g, (p_partkey % 3 * 80)::int r from part), sz as (select max(x) + 1 w, max(y) + 1 h from px)"
_BG = "bg as (select trunc(quantile_cont(b, 0.5))::int bb, trunc(quantile_cont(g, 0.5))::int bg, trunc(quantile_cont(r, 0.5))::int br from px, sz where (x < 4 or x >= w - 4) and (y < 4 or y >= h - 4))"


@query(f"with {_COLOURS}, {_BG} select bb bg_b, bg bg_g, br bg_r from bg")
def background_median(spark, sf):
    return hierarchy.background(spaces.colours(spark, sf), 4).drop("image_id")


@query(f"""with {_COLOURS}, {_BG}, fg as (select *, y * w + x place from px, sz, bg where greatest(abs(b - bb), abs(g - bg.bg), abs(r - br)) > 25 and not (b > 200 and g > 200 and r > 200)),
gr as (select least(((b + 6) // 12) * 12, 255)::int qb, least(((g + 6) // 12) * 12, 255)::int qg, least(((r + 6) // 12) * 12, 255)::int qr, count(*) size_px, min(place) first, avg(x) avg_x, avg(y) avg_y from fg group by 1, 2, 3 having count(*) >= 2)
select (row_number() over (order by first) - 1)::int branch_id, qb, qg, qr, size_px, round(avg_x, 6) avg_x, round(avg_y, 6) avg_y from gr""")
def colour_groups(spark, sf):
    p = spaces.colours(spark, sf)
    return hierarchy.colour_groups(hierarchy.without_text(p), hierarchy.background(p, 4), 25, 2).select(F.col("branch_id").cast("int"), "qb", "qg", "qr", "size_px", r("avg_x"), r("avg_y"))


@query(f"with {LABELLED} select distinct a.branch_id a, b.branch_id b from lp a join lp b on a.branch_id < b.branch_id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 49")
def adjacency_edges(spark, sf):
    return hierarchy.adjacency(spaces.labelled(spark, sf)[1], 7.0).select("a", "b")


@query("select distinct least(l_partkey, l_suppkey) a, greatest(l_partkey, l_suppkey) b from lineitem where l_partkey <> l_suppkey")
def canonical_edges(spark, sf):
    e = spaces.table(spark, sf, "lineitem").select(F.lit(1).alias("image_id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return hierarchy.canonical_edges(e).select("a", "b")


_TRUNK = f"""with recursive {TREE}, br as (select image_id, branch_id, count(*) size_px, avg(y) avg_y, max(y) max_y from tp group by all),
seed as (select image_id, arg_max(branch_id, struct_pack(a := avg_y, m := max_y, k := -branch_id)) branch_id from br group by all),
lim as (select image_id, size_px * 0.95 lim from (select image_id, size_px, row_number() over (partition by image_id order by size_px, branch_id) - 1 k, count(*) over (partition by image_id) n from br) where k = n // 2),
sh as (select br.image_id, branch_id from br join lim using (image_id) where size_px <= lim),
tr as (select image_id, branch_id from seed union select sh.image_id, sh.branch_id from tr join sh on sh.image_id = tr.image_id and abs(sh.branch_id - tr.branch_id) = 1)"""


@query(_TRUNK + " select image_id, branch_id from tr")
def trunk_branches(spark, sf):
    p = spaces.tree(spark, sf)[1]
    b = spaces.branches(p)
    e = b.select("image_id", F.col("branch_id").alias("a")).join(b.select("image_id", F.col("branch_id").alias("b")), "image_id").where("b = a + 1")
    return hierarchy.trunk(b, e, 0.95)


@query(f"with {TREE}, br as (select image_id, branch_id, avg(y) a, max(y) m from tp group by all) select image_id, arg_max(branch_id, struct_pack(a := a, m := m, k := -branch_id)) branch_id from br group by all")
def trunk_seed(spark, sf):
    b = spaces.branches(spaces.tree(spark, sf)[1])
    return b.groupBy("image_id").agg(F.max_by("branch_id", F.struct("avg_y", "max_y", -F.col("branch_id"))).alias("branch_id"))


_H = "n as (select 'r' || r_regionkey node, 0 as level from region union all select 'n' || n_nationkey, 1 from nation union all select 'c' || c_custkey, 2 from customer)"


@query(f"with {_H} select node, level::int as level from n")
def branch_levels(spark, sf):
    return levels(*spaces.hierarchy(spark, sf))


@query(f"with {_H} select node, case level when 0 then 'Tronco' when 1 then '1º orden' else '2º orden' end level_name from n")
def level_names(spark, sf):
    return levels(*spaces.hierarchy(spark, sf)).select("node", hierarchy.level_name(F.col("level")).alias("level_name"))


@query("select 'n' || n_nationkey node, 'c' || min('c' || c_custkey)[2:] root from nation join customer on c_nationkey = n_nationkey group by all union all select 'c' || c_custkey, min('c' || c_custkey) over (partition by c_nationkey) from customer")
def component_labels(spark, sf):
    c = spaces.table(spark, sf, "customer")
    e = c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("b"))
    return components(e)


_GRID = f"""{LABELLED}, gp as (select distinct floor(x / 25)::bigint x, floor(y / 25)::bigint y from (select x, y from lf union all select x, y from lp)),
rg as (select unnest(range(8)) k, unnest([0, 1, 1, 1, 0, -1, -1, -1]) i, unnest([-1, -1, 0, 1, 1, 1, 0, -1]) j),
nb as (select g.x, g.y, k, h.x is not null hit from gp g cross join rg left join gp h on h.x = g.x + i and h.y = g.y + j),
cr as (select a.x, a.y, count_if(a.hit) n, count_if(b.hit and not a.hit) c from nb a join nb b on a.x = b.x and a.y = b.y and b.k = (a.k + 1) % 8 group by all)"""


@query(f"with {_GRID} select x, y, n::int neighbours, c::int crossings, case when c = 1 and n = 1 then 'endpoint' when c >= 3 or n >= 3 then 'junction' else 'body' end as class from cr")
def pixel_class(spark, sf):
    return hierarchy.pixel_classes(spaces.grid(spark, sf)).drop("image_id")


@query(f"with {_GRID}, o as (select x, y, row_number() over (order by y, x) k from gp) select least(a.k, b.k) a, greatest(a.k, b.k) b from o a join o b on a.k < b.k and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1")
def pixel_graph(spark, sf):
    g = spaces.grid(spark, sf)
    w = Window.partitionBy("image_id").orderBy("y", "x")
    return hierarchy.pixel_graph(g.withColumn("ord", F.row_number().over(w).cast("long"))).select("a", "b")


@query(f"with {LABELLED}, e as (select distinct a.branch_id a, b.branch_id b from lp a join lp b on a.branch_id < b.branch_id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 49), d as (select e.a, e.b, p.ord pa, q.ord pb, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) d2 from e join lp p on p.branch_id = e.a join lp q on q.branch_id = e.b) select a, b, arg_min(pa, struct_pack(d := d2, p := pa, q := pb)) pixel_a, arg_min(pb, struct_pack(d := d2, p := pa, q := pb)) pixel_b, round(sqrt(min(d2)), 6) distance from d group by all")
def branch_bridges(spark, sf):
    p = spaces.labelled(spark, sf)[1]
    return hierarchy.bridges(hierarchy.adjacency(p, 7.0), p).select("a", "b", "pixel_a", "pixel_b", r("distance"))


@query(f"with {TREE} select image_id, case when branch_id in (2, 5) then 2 else branch_id end branch_id, count(*) size_px from tp where branch_id <> 7 group by all")
def edited_branches(spark, sf):
    p = spaces.tree(spark, sf)[1]
    of = p.select("image_id", "branch_id").distinct()
    merged = hierarchy.merged_branches(p, of.where("branch_id in (2, 5)").withColumn("group_id", F.lit(0)))
    kept = hierarchy.deleted_branches(merged, of.where("branch_id = 7"))
    return kept.groupBy("image_id", "branch_id").agg(F.count("*").alias("size_px")).withColumn("branch_id", F.when(F.col("branch_id") == 5, 2).otherwise(F.col("branch_id")).cast("long")).groupBy("image_id", "branch_id").agg(F.sum("size_px").alias("size_px"))


# Heat and scores

_HEAT = f"{LABELLED}, ht as (select p.ord, coalesce(sum((1 + id % 4) * exp(-((p.x - f.x) ** 2 + (p.y - f.y) ** 2) / (2 * 80.0 * 80.0))), 0) heat from lp p left join lf f on true group by all)"


def _heat(spark, sf, kinds: int = 4) -> DataFrame:
    """The field of all flowers, each with a load that depends on its id."""
    f, p = spaces.labelled(spark, sf)
    return heat.heat_field(f.withColumn("n", 1 + F.col("id") % kinds), p, 80.0)


@query(f"with {_HEAT} select ord, round(heat, 6) heat from ht")
def heat_field(spark, sf):
    return _heat(spark, sf).select("ord", r("heat"))


@query(f"with {_HEAT} select round(sum(heat), 4) total, round(max(heat), 6) peak, count(*) pixels from ht")
def heat_summary(spark, sf):
    return heat.heat_summary(_heat(spark, sf)).select(r("total", 4), r("peak"), "pixels")


@query(f"with {_HEAT}, h2 as (select p.ord, coalesce(sum((1 + id % 7) * exp(-((p.x - f.x) ** 2 + (p.y - f.y) ** 2) / (2 * 80.0 * 80.0))), 0) heat from lp p left join lf f on true group by all) select round(sum(a.heat * b.heat) / (sqrt(sum(a.heat ** 2) * sum(b.heat ** 2)) + 1e-12), 6) cosine, round(corr(a.heat, b.heat), 6) pearson from ht a join h2 b using (ord)")
def heat_similarity(spark, sf):
    return heat.similarity(_heat(spark, sf), _heat(spark, sf, 7)).select(r("cosine"), r("pearson"))


@query(f"""with {TREE}, k as (select *, row_number() over (partition by image_id, branch_id order by ord) - 1 k, count(*) over (partition by image_id, branch_id) n from tp),
s as (select image_id, branch_id, x, y, least(k // (n // greatest(1, n // 30)), greatest(1, n // 30) - 1)::int section_id from k),
d as (select f.image_id, f.branch_id, f.id, s.section_id, (f.x - s.x) * (f.x - s.x) + (f.y - s.y) * (f.y - s.y) d2 from tf f join s using (image_id, branch_id)),
m as (select image_id, branch_id, id, arg_min(section_id, struct_pack(d := d2, s := section_id)) section_id from d group by all),
n as (select image_id, branch_id, section_id, count(*) n from m group by all)
select image_id, branch_id, section_id, coalesce(n, 0) flowers from (select distinct image_id, branch_id, section_id from s) left join n using (image_id, branch_id, section_id)""")
def subsection_counts(spark, sf):
    f, p = spaces.tree(spark, sf)
    s = heat.subsections(p, 30)
    return counts.per_section(joins.nearest_within(f, s), s)


@query()
def medial_subsection_counts(spark, sf):
    """Flowers by runs of each branch's medial axis."""
    f, p = spaces.tree(spark, sf)
    s = cut(heat.medial_subsections(p, 30))
    return counts.per_section(joins.nearest_within(f, s), s)


_SCORES = f"{TREE}, {T_PAIRS}, {NEAREST}, sc as (select nr.image_id, avg((nr.branch_id = tf.branch_id)::int) accuracy, count(*) flowers from nr join tf using (image_id, id) group by all)"


def _scores(spark, sf) -> DataFrame:
    f, p = spaces.tree(spark, sf)
    predicted = joins.nearest(f.drop("branch_id"), p).select("image_id", "id", "branch_id", F.lit("nearest").alias("method"))
    return evaluate.accuracy(predicted, f.select("image_id", "id", F.col("branch_id").alias("true_branch")))


@query(f"with {_SCORES} select image_id, 'nearest' as method, round(accuracy, 6) accuracy, flowers from sc")
def accuracy_by_image(spark, sf):
    return _scores(spark, sf).select("image_id", "method", r("accuracy"), "flowers")


@query(f"with {_SCORES} select 'nearest' as method, round(avg(accuracy), 6) accuracy, count(*) images from sc")
def accuracy_macro(spark, sf):
    return evaluate.macro(_scores(spark, sf)).select("method", r("accuracy"), "images")


@query(f"with {LABELLED}, {L_PAIRS}, {NEAREST} select id, branch_id true_branch from nr")
def true_branches(spark, sf):
    return evaluate.true_branches(*spaces.labelled(spark, sf)).select("id", "true_branch")


@query(f"with {LABELLED} select ord from lp qualify row_number() over (partition by floor(x / 40), floor(y / 40) order by ord) = count(*) over (partition by floor(x / 40), floor(y / 40)) // 2 + 1")
def subsample_nodes(spark, sf):
    return heat.subsampled(spaces.labelled(spark, sf)[1], 40.0).select("ord")


_SAMPLED = f"""with recursive {TREE}, g as (select image_id, count(*) n, min(x) x0, min(y) y0, greatest(max(x) - min(x), max(y) - min(y), 1.0) span from tp group by image_id),
bs(image_id, k, low, high, size, settled) as (select image_id, 0, span / (60 * 4.0), span / 2.0, null::double, n <= 60 from g union all
 select image_id, k + 1, case when c > 60 * 1.1 then m else low end, case when c < 60 * 0.9 then m else high end, m, c between 60 * 0.9 and 60 * 1.1 from (
  select b.image_id, b.k, b.low, b.high, 0.5 * (b.low + b.high) m, count(distinct struct_pack(i := floor((x - x0) * (1.0 / (0.5 * (b.low + b.high)))), j := floor((y - y0) * (1.0 / (0.5 * (b.low + b.high)))))) c
  from bs b join g using (image_id) join tp using (image_id) where not b.settled and b.k < 20 group by all)),
z as (select image_id, arg_max(size, k) size from bs group by all),
nd as (select tp.image_id, ord, tp.x, tp.y from tp join g using (image_id) join z using (image_id)
 qualify row_number() over (partition by tp.image_id, floor((tp.x - x0) * (1.0 / size)), floor((tp.y - y0) * (1.0 / size)), case when size is null then ord end order by ord)
  = count(*) over (partition by tp.image_id, floor((tp.x - x0) * (1.0 / size)), floor((tp.y - y0) * (1.0 / size)), case when size is null then ord end) // 2 + 1)"""


@query(f"{_SAMPLED} select image_id, ord from nd")
def sampled_nodes(spark, sf):
    """About 60 nodes an image, by a search for its cell size."""
    return heat.sampled(spaces.tree(spark, sf)[1], 60).select("image_id", "ord")


#: Paths over pixels at most 40 apart between every 50th vector's pixel and the next; the search goes on from what became shorter.
_PATHS = f"""with recursive {SEVERAL}, ed as (select a.image_id, a.ord u, b.ord v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) w from lp a join lp b on a.image_id = b.image_id and a.ord <> b.ord and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600),
sp(s, v, d) using key (s, v) as (select ord, ord, 0::double from lp where ord % 50 = 1 union
 select x.s, x.v, x.d from (select sp.s, ed.v, min(sp.d + ed.w) d from sp join ed on ed.u = sp.v group by sp.s, ed.v) x left join recurring.sp r on r.s = x.s and r.v = x.v where r.d is null or x.d < r.d)
select p.image_id, s a, v b, round(d, 6) distance from sp join lp p on p.ord = s where s < v and v % 50 = 1"""


@query(_PATHS)
def geodesic_distances(spark, sf):
    p = spaces.several(spark, sf)[1]
    return geodesic.geodesics(p, p.where("ord % 50 = 1"), 40.0).select("image_id", "a", "b", r("distance"))


@query(_PATHS)
def geodesic_distances_by_joins(spark, sf):
    """The same where no image is small enough for a kernel before its other pixels are eliminated."""
    p = spaces.several(spark, sf)[1]
    return geodesic.geodesics(p, p.where("ord % 50 = 1"), 40.0, 350).select("image_id", "a", "b", r("distance"))


def _heat_of_images(spark, sf, kinds: int = 4) -> DataFrame:
    f, p = spaces.several(spark, sf)
    return heat.heat_field(f.withColumn("n", 1 + F.col("id") % kinds), p, 80.0)


@query()
def sinkhorn_similarity(spark, sf):
    p = spaces.several(spark, sf)[1]
    return transport.transport_similarity(_heat_of_images(spark, sf), _heat_of_images(spark, sf, 7), p, 120, 40.0)


# L-System and shoots


@query(f"with {LABELLED}, n as (select id, x, y, unnest(range(13)) k from lf), s as (select n.id, n.k, n.x, n.y, i from n left join (select unnest(range(12)) i) on i < k) select id, k::int node, round(any_value(x) + coalesce(sum(5 * cos(-1.2 + i * (id % 7) * 0.02)), 0), 4) x, round(any_value(y) + coalesce(sum(5 * sin(-1.2 + i * (id % 7) * 0.02)), 0), 4) y, k > 4 flower from s group by id, k")
def lsystem_forward(spark, sf):
    f, _ = spaces.labelled(spark, sf)
    s = f.select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(-1.2).alias("theta"), (F.col("id") % 7 * F.lit(0.02)).alias("kappa"), F.lit(5.0).alias("delta"))
    return lsystem.forward(s, 12, 4).select("id", "node", r("x", 4), r("y", 4), "flower")


@query(f"""with {TREE}, w as (select image_id, branch_id, y, y - lag(y) over (partition by image_id, branch_id order by y) d from tf), a as (select image_id, branch_id, count(*) n, median(d) / 3 sp, (max(y) - min(y)) / 3 + 9 len from w group by all),
k as (select *, len between 30 and 80 lo, n between 20 and 40 co, abs(sp - 2.5) / 2.5 off from a)
select image_id, branch_id, case when n < 2 then false else lo and co and off <= 0.4 end ok, round(case when n < 2 then 0 else (1 - least(off, 1)) * (0.5 * lo::int + 0.5 * co::int) end, 6) score from k""")
def lsystem_validate(spark, sf):
    t = spaces.tree(spark, sf)[0].withColumn("t", F.col("y"))
    return lsystem.validated(t, ["image_id", "branch_id"], 3.0).select("image_id", "branch_id", "ok", r("score"))


@query()
def lsystem_assign(spark, sf):
    f, p = spaces.several(spark, sf)
    return lsystem.reconstruct(f, p, 10.0)[1]


@query()
def shoots_by_clusters(spark, sf):
    f, p = spaces.several(spark, sf)
    return shoots.first_form(f, p, 6.0)[0].select("shoot_id", "branch_id", "n", r("length_cm", 4), r("confidence", 4), "found", "merged_from", "flag_too_short", "flag_too_long", "flag_bad_count")


@query()
def shoots_by_rays(spark, sf):
    f, p = spaces.several(spark, sf)
    return shoots.second_form(f, p, 6.0)[0].select("shoot_id", "branch_id", "found", r("score", 4))


# Rasters


#: A mask's side, and its cells for each pixel of the tree space.
SIDE = 96
MASK_CELLS = [f"least(greatest(cast(floor({c} / {size}) as int) + 1 + {d}, 0), {SIDE - 1}) {c}" for c, size, d in (("x", 5.5, "di"), ("y", 12.0, "dj"))]


def masks(spark, sf) -> DataFrame:
    """A mask for each image of the tree space: every pixel of it, drawn as a square of three cells. Middle cells are distinct before they meet in a group, so a group holds at most (SIDE + 2) ** 2 rows."""
    p = spaces.tree(spark, sf)[1]
    middle = [f"least(greatest(cast(floor({c} / {size}) as int) + 1, -1), {SIDE}) {c}" for c, size in (("x", 5.5), ("y", 12.0))]
    return raster.drawn(p.selectExpr("image_id", *middle).distinct(), SIDE, SIDE, spread=1)


PARAMS = {"close_k": 1, "open_k": 1, "thick_dist": 9.0, "dilate_k": 1, "min_branch": 4}


def _skeletons(spark, sf) -> DataFrame:
    return raster.skeletonise(masks(spark, sf).withColumns({k: F.lit(v) for k, v in PARAMS.items()}))


@query()
def thin_prune_repair(spark, sf):
    return raster.to_pixels(_skeletons(spark, sf)).groupBy("image_id").agg(F.count("*").alias("pixels"))


@query()
def trace_branches(spark, sf):
    return skeleton.branch_stats(skeleton.branches(raster.to_pixels(_skeletons(spark, sf))))


@query()
def skeleton_diameter(spark, sf):
    return skeleton.diameter(skeleton.branches(raster.to_pixels(_skeletons(spark, sf))))


@query()
def mask_features(spark, sf):
    return raster.mask_features(masks(spark, sf))


@query(f"""with {TREE}, n(di) as (values (-1), (0), (1)), m(dj) as (values (-1), (0), (1)), c as (select distinct image_id, {", ".join(MASK_CELLS)} from tp, n, m)
select image_id, count(*)::bigint area, (max(x) - min(x))::bigint wide, (max(y) - min(y))::bigint high, round(count(*) / (96.0 * 96.0), 6) share, round(count(*) / greatest(1, (max(x) - min(x)) * (max(y) - min(y))), 6) filled from c group by image_id""")
def mask_extents(spark, sf):
    """What of a mask's measures SQL can tell: area, box and how full it is."""
    share, _, _, _, _, _, _, _, _, _, _, _, high, wide, filled, _ = raster.FEATURES
    m = raster.mask_features(masks(spark, sf))
    whole = lambda c: F.round(c).cast("long")
    return m.select("image_id", whole(F.col(share) * SIDE * SIDE).alias("area"), whole(F.col(wide)).alias("wide"), whole(F.col(high)).alias("high"), F.round(share, 6).alias("share"), F.round(filled, 6).alias("filled"))


@query(f"""with {TREE}, n(di) as (values (-1), (0), (1)), m(dj) as (values (-1), (0), (1)), c as (select distinct image_id, {", ".join(MASK_CELLS)} from tp, n, m),
k(ki, kj) as (select a.di, b.di from n a, n b where a.di = 0 or b.di = 0), r as (select image_id, i::int x, j::int y from (select distinct image_id from c), range(96) p(i), range(96) q(j)),
-- Outside the image nothing erodes: a cell goes if an empty cell of the image is next to it.
e as (select image_id, x, y from r anti join c using (image_id, x, y)), gone as (select distinct image_id, x + ki x, y + kj y from e, k),
core as (select * from c anti join gone using (image_id, x, y)),
opened as (select distinct image_id, x + ki x, y + kj y from core, k where x + ki between 0 and 95 and y + kj between 0 and 95)
select image_id, count(*)::bigint pixels, sum(x * 97 + y * 89)::bigint checksum from opened group by image_id""")
def mask_opened(spark, sf):
    """Each mask, opened by an ellipse of three: cells left and a sum that tells where they are."""
    left = raster.to_pixels(raster.opened_masks(masks(spark, sf), 3))
    return left.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum(F.col("x") * 97 + F.col("y") * 89).alias("checksum"))


@query()
def learned_parameters(spark, sf):
    """The learned calibrator's parameters of each mask."""
    return raster.calibrated(raster.mask_features(masks(spark, sf)))


@query("select p_partkey image_id, case when p_partkey % 3 = 0 then p_size else 1 end::int close_k, case when p_partkey % 3 = 0 then p_size + 1 else 1 end::int open_k, case when p_partkey % 3 = 0 then p_retailprice else 1 end::double thick_dist, case when p_partkey % 3 = 0 then p_size + 2 else 1 end::int dilate_k, case when p_partkey % 3 = 0 then p_size + 3 else 5 end::int min_branch from part")
def tuned_parameters(spark, sf):
    p = spaces.table(spark, sf, "part").withColumn("image_id", F.col("p_partkey"))
    size = lambda k: (F.col("p_size") + k).cast("int")
    stored = p.where("p_partkey % 3 = 0").select("image_id", size(0).alias("close_k"), size(1).alias("open_k"), F.col("p_retailprice").cast("double").alias("thick_dist"), size(2).alias("dilate_k"), size(3).alias("min_branch"))
    return raster.tuned(p, stored)


@query(f"with {TREE}, m as (select image_id, count(*) n, avg(x) ax, max(y) my, min(y) ny from tp group by all) select image_id, round(3.5 + 0.01 * n + 0.002 * ax - 0.001 * (my - ny))::int open_k from m")
def mask_features_linear(spark, sf):
    p = spaces.tree(spark, sf)[1]
    m = p.groupBy("image_id").agg(F.count("*").alias("n"), F.avg("x").alias("ax"), (F.max("y") - F.min("y")).alias("h"))
    return m.select("image_id", raster.linear([0.01, 0.002, -0.001], 3.5, ["n", "ax", "h"]).alias("open_k"))


@query("""with v as (select l_suppkey image_id, l_quantity::int * 5 as value from lineitem), n as (select image_id, value, count(*) n from v group by all), c as (select *, sum(n) over (partition by image_id order by value) w, sum(n * value) over (partition by image_id order by value) m, sum(n) over (partition by image_id) tw, sum(n * value) over (partition by image_id) tm from n),
b as (select image_id, value, coalesce((tm * w / tw - m) ** 2 / nullif(w * (tw - w), 0), -1)::double bt from c) select image_id, arg_max(value, struct_pack(b := bt, v := -value))::int threshold from b group by all""")
def otsu_threshold(spark, sf):
    v = spaces.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_quantity").cast("int") * 5).alias("value"))
    return raster.otsu_thresholds(v).select("image_id", F.col("threshold").cast("int"))


# Sources


@query("select event_id, case when regexp_matches('imgs_frame' || user_id || '_00000_graph.json', 'frame[0-9]+') then user_id::int end frame, 'frame' || user_id || '.json' flower_file from events")
def frame_key(spark, sf):
    e = spaces.table(spark, sf, "events").withColumn("name", F.concat(F.lit("imgs_frame"), F.col("user_id").cast("string"), F.lit("_00000_graph.json")))
    return e.select("event_id", frame_number("name").alias("frame"), F.concat(F.lit("frame"), frame_number("name").cast("string"), F.lit(".json")).alias("flower_file"))


@query("select event_id, json_extract(props, '$.k')::int k from events where json_extract(props, '$.k') is not null")
def event_properties(spark, sf):
    return spaces.table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k is not null")


@query("select user_id frame, (row_number() over (partition by user_id order by event_id) - 1)::int id, value x, -value y from events where event_type = (select min(event_type) from events)")
def labelme_flatten(spark, sf):
    e = spaces.table(spark, sf, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    shape = F.struct("event_id", F.col("event_type").alias("label"), F.array(F.array("value", -F.col("value"))).alias("points"))
    docs = e.groupBy(F.col("user_id").alias("frame")).agg(F.array_sort(F.collect_list(shape)).alias("shapes")).withColumn("name", F.lit(""))
    return files.flowers(docs, kind).drop("name")


@query("with e as (select user_id frame, event_id, event_type, value from events), b as (select frame, dense_rank() over (partition by frame order by event_type) - 1 as k, event_id, value from e) select frame, k::int branch_id, (row_number() over (partition by frame order by k, event_id) - 1)::int ord, value x, event_id::double y from b")
def graph_flatten(spark, sf):
    e = spaces.table(spark, sf, "events")
    p = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    b = p.groupBy(F.col("user_id").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("event_type", F.transform("s", lambda s: F.array(s["event_id"].cast("double"), s["value"])).alias("pixels")))).alias("b"))
    g = b.select("frame", F.lit("").alias("name"), F.transform("b", lambda s, i: F.struct(i.alias("id"), s["pixels"].alias("pixels"))).alias("branches"))
    return files.graph_pixels(g).drop("name")


@query("with o as (select c_custkey k, 'v1' as method, c_acctbal value from customer), n as (select c_custkey k, 'v1' as method, c_acctbal * 2 as value from customer where c_custkey % 3 = 0 union all select c_custkey, 'v2', c_acctbal from customer where c_custkey % 5 = 0) select * from n union all select * from o where not exists (select 1 from n where n.k = o.k and n.method = o.method)")
def metrics_upsert(spark, sf):
    c = spaces.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("v1").alias("method"), F.col("c_acctbal").alias("value"))
    new = c.where("k % 3 = 0").withColumn("value", F.col("value") * 2).unionByName(c.where("k % 5 = 0").withColumn("method", F.lit("v2")))
    return files.upserted(c, new, ["k", "method"])


@query("select p_partkey, coalesce(case when p_partkey % 7 = 0 then p_size end, case when p_partkey % 2 = 0 then p_size + 1 end, 4)::int open_k from part")
def param_priority(spark, sf):
    p = spaces.table(spark, sf, "part").select("p_partkey", "p_size")
    manual = p.where("p_partkey % 7 = 0").select("p_partkey", F.col("p_size").alias("manual"))
    learned = p.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + 1).alias("learned"))
    j = p.select("p_partkey").join(manual, "p_partkey", "left").join(learned, "p_partkey", "left")
    return j.select("p_partkey", counts.prioritised(F.col("manual"), F.col("learned"), F.lit(4)).cast("int").alias("open_k"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def event_windows(spark, sf):
    return windowed_counts(spaces.table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("total", 4))


# Files: what readers, lookups and writers make of documents built from whole tables.

_NAMES = "nm as (select event_id, event_type, case when event_id % 7 = 0 then 'img_' || event_id else 'imgs_frame' || user_id || '_' || event_id || '.png' end as name from events)"


@query(f"with {_NAMES} select event_id, (row_number() over (partition by event_type order by coalesce(try_cast(regexp_extract(name, 'frame(\\d+)', 1) as int), 1073741824), name))::int place from nm")
def natural_order(spark, sf):
    """Places of file names in the readers' order, within each event type."""
    numbered = F.concat(F.lit("imgs_frame"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_id").cast("string"), F.lit(".png"))
    name = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("img_"), F.col("event_id").cast("string"))).otherwise(numbered)
    w = Window.partitionBy("event_type").orderBy(natural_key("name"))
    return spaces.table(spark, sf, "events").withColumn("name", name).select("event_id", F.row_number().over(w).cast("int").alias("place"))


_FILES = """gf as (select c_custkey frame, 'graphs/' || c_name as path from customer),
ff as (select o_custkey frame, 'flowers/' || o_orderkey || '.json' as path, o_orderstatus from orders)"""


def _files(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A graph file per customer; a flower file per order, with its customer as the frame."""
    g = spaces.table(spark, sf, "customer").select(F.col("c_custkey").alias("frame"), F.concat(F.lit("graphs/"), "c_name").alias("path"))
    name = F.concat(F.lit("flowers/"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    return g, spaces.table(spark, sf, "orders").select(F.col("o_custkey").alias("frame"), name.alias("path"), "o_orderstatus")


@query(f"with {_FILES} select frame, g.path, min(f.path) partner from gf g join ff f using (frame) group by all")
def graph_flower_lookup(spark, sf):
    g, f = _files(spark, sf)
    return files.matched(g, f)[0]


@query(f"with {_FILES} select f.frame, f.path, min(g.path) partner from ff f join gf g using (frame) group by all")
def flower_graph_lookup(spark, sf):
    g, f = _files(spark, sf)
    return files.matched(f.drop("o_orderstatus"), g)[0]


@query(f"with {_FILES} select p_partkey frame, p_name as path from part where not exists (select 1 from ff where ff.frame = p_partkey)")
def graphs_without_flowers(spark, sf):
    """Files, one a part, whose frame no flower file has."""
    g = spaces.table(spark, sf, "part").select(F.col("p_partkey").alias("frame"), F.col("p_name").alias("path"))
    return files.matched(g, _files(spark, sf)[1])[1]


@query(f"with {_FILES} select g.frame, coalesce((select min(path) from ff where ff.frame = g.frame and o_orderstatus = 'P'), (select min(path) from ff where ff.frame = g.frame and o_orderstatus = 'F'), g.path) as path from gf g")
def first_source(spark, sf):
    """Each frame's file in the first of three folders that has it."""
    g, f = _files(spark, sf)
    return files.first_source(g.select("frame"), f.where("o_orderstatus = 'P'"), f.where("o_orderstatus = 'F'"), g)


@query("select s.s_suppkey frame, exists (select 1 from nation where n_nationkey = s_suppkey) has_graph from supplier s")
def shoot_work_list(spark, sf):
    there, missing = files.work_list(spaces.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("frame")), spaces.table(spark, sf, "nation").select(F.col("n_nationkey").alias("frame")))
    return there.withColumn("has_graph", F.lit(True)).unionByName(missing.withColumn("has_graph", F.lit(False)))


def _truth(spark, sf) -> DataFrame:
    """Ground-truth documents: an image per customer, a point per order."""
    o = spaces.table(spark, sf, "orders")
    return files.truth_documents(o.select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("x"), (F.col("o_totalprice") / 2).alias("y"), (F.col("o_orderkey") % 5).cast("int").alias("num_flowers"), (F.col("o_orderkey") % 3).cast("int").alias("branch_id")))


@query("select o_custkey image_id, count(*) n_points, sum(o_orderkey % 5)::bigint n_flowers from orders group by all")
def truth_documents(spark, sf):
    return _truth(spark, sf).drop("points")


@query("select o_custkey frame, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int ord, o_totalprice x, o_totalprice / 2 y, (o_orderkey % 5)::int num_flowers, (o_orderkey % 3)::int branch_id from orders")
def truth_points(spark, sf):
    """Points of written ground-truth documents, read again."""
    return files.truth_points(_truth(spark, sf).withColumnRenamed("image_id", "frame").withColumn("name", F.lit(""))).drop("name")


@query("select c_custkey, case when c_custkey % 4 = 0 then c_name || '.json' else 'imgs_frame' || c_custkey || '.json' end graph_name from customer")
def truth_graph_names(spark, sf):
    c = spaces.table(spark, sf, "customer")
    stated = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit(".json")))
    named = c.withColumns({"name": F.concat(F.lit("imgs_frame"), F.col("c_custkey").cast("string"), F.lit("_GT.json")), "graph_json": stated})
    return files.truth_graph(named).select("c_custkey", "graph_name")


@query("select l_orderkey frame, l_linenumber::int shoot_id, l_suppkey::int branch_id, l_quantity::int n, l_extendedprice x, l_discount y, l_tax confidence, len([l_partkey, l_suppkey])::int n_indices from lineitem")
def shoot_records(spark, sf):
    """Records of shoot documents: one document an order, one shoot a line."""
    whole = lambda c: F.col(c).cast("int")
    shoot = F.struct(whole("l_linenumber").alias("varilla_id"), whole("l_suppkey").alias("rama_id"), whole("l_quantity").alias("num_flowers"), F.array("l_extendedprice", "l_discount").alias("base_xy"), F.col("l_tax").alias("confidence"), F.array(whole("l_partkey"), whole("l_suppkey")).alias("flower_indices"))
    docs = spaces.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.collect_list(shoot).alias("varillas")).withColumn("name", F.lit(""))
    return files.shoot_records(docs).withColumn("n_indices", F.size("flower_indices")).drop("name", "flower_indices")


@query("select p_size frame, p_partkey::int branch_id, (p_partkey % 256)::int r, (p_size * 5 % 256)::int g, (p_partkey % 3 * 80)::int b from part")
def branch_colours(spark, sf):
    """Colours of the nodes of graph documents: one document a size, one node a part."""
    null = lambda kind: F.lit(None).cast(kind)
    rgb = F.array((F.col("p_partkey") % 256).cast("int"), (F.col("p_size") * 5 % 256).cast("int"), (F.col("p_partkey") % 3 * 80).cast("int"))
    node = F.struct(F.col("p_partkey").cast("int").alias("id"), null("double").alias("centroid_x"), null("double").alias("centroid_y"), null("int").alias("level"), null("string").alias("level_name"), null("boolean").alias("is_trunk"), null("int").alias("size_px"), rgb.alias("color_rgb"))
    docs = spaces.table(spark, sf, "part").groupBy(F.col("p_size").alias("frame")).agg(F.collect_list(node).alias("nodes")).withColumn("name", F.lit(""))
    c = files.branch_colours(docs)
    return c.select("frame", "branch_id", *[F.col("color_rgb")[k].alias(a) for k, a in enumerate("rgb")])


def _records(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = spaces.tree(spark, sf)[1]
    b = spaces.branches(p)
    return hierarchy.graph_nodes(b, b.select("image_id", "branch_id", (F.col("branch_id") % 4 - 1).cast("int").alias("level"))), p


_RECORDS = f"{TREE}, nd as (select image_id, branch_id, round_even(avg(x), 1) centroid_x, round_even(avg(y), 1) centroid_y, (branch_id % 4 - 1)::int as level, count(*) size_px from tp group by image_id, branch_id)"


@query(f"with {_RECORDS} select *, case level when -1 then 'Desconectada' when 0 then 'Tronco' else level || 'º orden' end level_name, level = 0 is_trunk from nd")
def node_records(spark, sf):
    return _records(spark, sf)[0]


@query(f"with {TREE} select image_id frame, branch_id, (row_number() over (partition by image_id order by branch_id, ord) - 1)::int ord, x, y from tp")
def graph_documents(spark, sf):
    """Branch pixels of written graph documents, read again."""
    n, p = _records(spark, sf)
    edges = n.groupBy("image_id").agg(F.min("branch_id").alias("a"), F.max("branch_id").alias("b"))
    docs = files.graph_documents(n, edges, p).withColumnRenamed("image_id", "frame").withColumn("name", F.lit(""))
    return files.graph_pixels(docs).drop("name")


@query("select c_custkey, round(c_acctbal / 7, 3) a, case when c_nationkey > 0 then round(c_acctbal / c_nationkey / 11, 4) end b from customer")
def metrics_table(spark, sf):
    c = spaces.table(spark, sf, "customer")
    by = F.when(F.col("c_nationkey") > 0, F.col("c_acctbal") / F.col("c_nationkey") / 11).otherwise(F.lit(float("nan")))
    return files.metrics_table(c.select("c_custkey", (F.col("c_acctbal") / 7).alias("a"), by.alias("b")), {"a": 3, "b": 4})


@query("select 'frame' || p_partkey || '.png' as name, p_size close_k, p_size + 1 open_k, p_retailprice thick_dist, p_size + 2 dilate_k, p_size + 3 min_branch from part")
def parameter_store(spark, sf):
    """Rows of parameter stores: a store a brand, an entry a part."""
    size = lambda k, c: (F.col("p_size") + k).alias(c)
    entry = F.struct(F.concat(F.lit("frame"), F.col("p_partkey").cast("string"), F.lit(".png")), F.struct(size(0, "close_k"), size(1, "open_k"), F.col("p_retailprice").alias("thick_dist"), size(2, "dilate_k"), size(3, "min_branch")))
    stores = spaces.table(spark, sf, "part").groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return files.parameter_rows(stores)


_CELLS = "cl as (select l_suppkey image_id, l_linenumber::bigint branch_id, floor(l_quantity / 10)::bigint x, floor(l_extendedprice / 20000)::bigint y from lineitem)"


def _cells(spark, sf) -> DataFrame:
    """Branches that share pixels: a branch per line number, on a coarse grid."""
    return spaces.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("branch_id"), F.floor(F.col("l_quantity") / 10).alias("x"), F.floor(F.col("l_extendedprice") / 20000).alias("y"))


@query(f"with {_CELLS} select image_id, x, y, max(branch_id) branch_id from cl group by all")
def pixel_owner(spark, sf):
    return skeleton.pixel_owner(_cells(spark, sf))


@query(f"""with {_CELLS}, px as (select distinct * from cl), n as (select image_id, branch_id, count(*) n from px group by all),
sh as (select p.image_id, p.branch_id a, q.branch_id b, count(*) both_n from px p join px q using (image_id, x, y) where p.branch_id < q.branch_id group by all)
select sh.image_id, a, b, round(both_n / greatest(na.n, nb.n), 6) share from sh join n na on na.image_id = sh.image_id and na.branch_id = a join n nb on nb.image_id = sh.image_id and nb.branch_id = b where both_n / greatest(na.n, nb.n) > 0.6""")
def shared_pixels(spark, sf):
    return skeleton.deduplicated_candidates(_cells(spark, sf)).select("image_id", "a", "b", r("share"))


def methods(step: float = 1.0, gap: float = 7.0, px_per_cm: float = 6.0) -> dict[str, Callable[[DataFrame, DataFrame], DataFrame]]:
    """Registry of assignment methods: (flowers, pixels) to a branch per flower. Pixels lie a step apart, and branches within gap are neighbours."""
    near = lambda p: hierarchy.adjacency(p, gap)
    split = lambda f, p: counts.ambiguity(joins.two_branches(f, p))
    found = {
        "nearest": joins.nearest,
        "random_walk": graphs.random_walk,
        "laplacian": lambda f, p: graphs.laplacian(f, p, near(p)),
        "embedding": lambda f, p: embedded_branches(f, p, near(p), step),
        "hybrid_laplacian": lambda f, p: graphs.hybrid(split(f, p), graphs.laplacian(f, p, near(p))),
        "hybrid_random_walk": lambda f, p: graphs.hybrid(split(f, p), graphs.random_walk(f, p)),
        "clusters": lambda f, p: shoots.first_form(f, p, px_per_cm)[1],
        "rays": lambda f, p: shoots.second_form(f, p, px_per_cm)[1],
        "lsystem": lambda f, p: lsystem.reconstruct(f, p, px_per_cm)[1],
    }
    return {k: lambda f, p, m=m: m(f, p).select("image_id", "id", "branch_id") for k, m in found.items()}


METHODS = methods(STEP, 12.0)

#: Methods that are another one where the nearest branch isn't clear.
HYBRIDS = {"hybrid_laplacian": "laplacian", "hybrid_random_walk": "random_walk"}


@query()
def method_accuracy(spark, sf):
    """All methods of the registry against the branch of the nearest ground-truth point. What a hybrid takes from another method is that method's result, which is solved once."""
    f, p = map(cut, spaces.several(spark, sf))
    truth = cut(evaluate.true_branches(f, p))
    found = {n: cut(m(f, p)) for n, m in METHODS.items() if n not in HYBRIDS}
    split = cut(counts.ambiguity(joins.two_branches(f, p)))
    found |= {n: graphs.hybrid(split, found[of]) for n, of in HYBRIDS.items()}
    out = None
    for n in METHODS:
        s = found[n].select("image_id", "id", "branch_id").withColumn("method", F.lit(n))
        out = s if out is None else out.unionByName(s)
    return evaluate.macro(evaluate.accuracy(out, truth)).select("method", r("accuracy"), "images")


@query(f"with {TREE}, h as (select image_id, greatest(max(y) - min(y), 1) / 350 s from tp group by all), n as (select image_id, branch_id, count(*) n from tf group by all), b as (select image_id, branch_id, count(*) px from tp group by all) select image_id, branch_id, round(coalesce(n, 0) / (px / s), 6) per_cm from b join h using (image_id) left join n using (image_id, branch_id)")
def flowers_per_cm(spark, sf):
    f, p = spaces.tree(spark, sf)
    b = spaces.branches(p)
    n = counts.per_branch(f, b).join(b.select("image_id", "branch_id", "size_px"), ["image_id", "branch_id"]).join(fit.px_per_cm(p), "image_id")
    return n.select("image_id", "branch_id", F.round(F.col("flowers") / (F.col("size_px") / F.col("px_per_cm")), 6).alias("per_cm"))
