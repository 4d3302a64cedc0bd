"""Raster and skeleton kernels against plain versions, pixel by pixel, on random small masks."""

import heapq
import random
from itertools import combinations

import numpy as np
import pytest

from twigspark.operators import heat, raster, skeleton
from twigspark.plans import catalog

SIDES = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
#: Clockwise from above.
TURN = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def blobs(seed, h=22, w=26):
    """Random strokes: thick lines, dots and holes."""
    r = random.Random(seed)
    x = np.zeros((h, w), bool)
    for _ in range(r.randrange(1, 6)):
        y, c, dy, dx, t = r.randrange(h), r.randrange(w), r.choice((-1, 0, 1)), r.choice((-1, 0, 1)), r.randrange(1, 5)
        for k in range(r.randrange(3, 20)):
            x[max(0, y + k * dy) : max(0, y + k * dy + t), max(0, c + k * dx) : max(0, c + k * dx + t)] = True
    for _ in range(r.randrange(12)):
        x[r.randrange(h), r.randrange(w)] ^= True
    return x


MASKS = [blobs(k) for k in range(40)] + [np.zeros((5, 7), bool), np.ones((4, 6), bool), np.ones((1, 1), bool)]


def cells(x):
    return {tuple(map(int, p)) for p in np.argwhere(x)}


def grown(on, k, h, w):
    """on with every cell that an ellipse of size k around one of its cells reaches."""
    r = k // 2
    reach = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if r == 0 or abs(dx) <= round((r * r - dy * dy) ** 0.5)]
    return {(y + dy, c + dx) for y, c in on for dy, dx in reach if 0 <= y + dy < h and 0 <= c + dx < w}


@pytest.mark.parametrize("k", [1, 3, 5, 7])
def test_opening_and_closing(k):
    for x in MASKS:
        h, w = x.shape
        every, on = {(y, c) for y in range(h) for c in range(w)}, cells(x)
        shrunk = lambda s: every - grown(every - s, k, h, w)  # noqa: E731, B023
        assert cells(raster.dilated(x, k)) == grown(on, k, h, w)
        assert cells(raster.closed(x, k)) == shrunk(grown(on, k, h, w))
        assert cells(raster.opened(x, k)) == grown(shrunk(on), k, h, w)


def test_distance_is_the_shortest_way_to_the_background():
    cost = {(dy, dx): w for dy in range(-2, 3) for dx in range(-2, 3) for w in [{1: 1.0, 2: 1.4, 5: 2.1969}.get(dy * dy + dx * dx)] if w}
    for x in MASKS:
        if x.all():
            continue
        best = {(y, c): 0.0 for y, c in cells(~x)}
        todo = [(0.0, p) for p in best]
        heapq.heapify(todo)
        while todo:
            d, (y, c) = heapq.heappop(todo)
            if d > best[y, c]:
                continue
            for (dy, dx), w in cost.items():
                q = (y + dy, c + dx)
                if 0 <= q[0] < x.shape[0] and 0 <= q[1] < x.shape[1] and d + w < best.get(q, np.inf):
                    best[q] = d + w
                    heapq.heappush(todo, (d + w, q))
        got = raster.distance(x)
        assert all(abs(got[p] - d) < 1e-9 for p, d in best.items())


def test_thick_parts_stay_within_the_mask():
    for x in MASKS:
        for limit in (1.0, 2.0, 3.0):
            d, (h, w) = raster.distance(x), x.shape
            core = {p for p in cells(x) if d[p] > limit}
            assert cells(raster.thin_parts(x, limit, 5)) == {p for p in cells(x) if p not in core} | (grown(core, 5, h, w) & cells(x))


def plain_thinning(on):
    on = set(on)
    while True:
        before = len(on)
        for step in (0, 1):
            gone = set()
            for y, c in on:
                n = [(y + dy, c + dx) in on for dy, dx in TURN]
                up, right, down, left = n[0], n[2], n[4], n[6]
                enters = sum(not n[k] and n[(k + 1) % 8] for k in range(8))
                if 2 <= sum(n) <= 6 and enters == 1 and not ((up and right and down) or (right and down and left) if step == 0 else (up and right and left) or (up and down and left)):
                    gone.add((y, c))
            on -= gone
        if len(on) == before:
            return on


def parts(on):
    left, out = set(on), []
    while left:
        todo = [left.pop()]
        whole = set(todo)
        while todo:
            y, c = todo.pop()
            for dy, dx in SIDES:
                q = (y + dy, c + dx)
                if q in left:
                    left.discard(q)
                    whole.add(q)
                    todo.append(q)
        out.append(whole)
    return out


def test_thinning():
    for x in MASKS:
        got = cells(raster.thinned(x))
        assert got == plain_thinning(cells(x)) and got <= cells(x)


def degree(on, p):
    return sum((p[0] + dy, p[1] + dx) in on for dy, dx in SIDES)


def test_pruning_leaves_no_short_end():
    for x in MASKS:
        thin = raster.thinned(x)
        for least in (2, 4, 8):
            got = cells(raster.pruned(thin, least))
            assert got <= cells(thin)
            for p in got:
                if degree(got, p) != 1:
                    continue
                path = [p]
                while len(path) < least:
                    onward = [q for dy, dx in TURN if (q := (path[-1][0] + dy, path[-1][1] + dx)) in got and q not in path]
                    if not onward:
                        break
                    path.append(onward[0])
                    if degree(got, onward[0]) > 2:
                        break
                assert len(path) >= least or degree(got, path[-1]) == 1


def test_a_ball_is_what_so_many_steps_reach():
    for x in MASKS[:12]:
        on = cells(raster.thinned(x))
        for start in sorted(on)[:5]:
            near = {start}
            for steps in range(6):
                ball = raster.local_ball(raster.thinned(x), start, steps)
                assert set(ball) == near and ball[0] == start and len(ball) == len(near)
                near = near | {(y + dy, c + dx) for y, c in near for dy, dx in SIDES} & on


def test_repair_fills_only_next_to_ends():
    for x in MASKS:
        thin = raster.thinned(x)
        on, new = cells(thin), cells(raster.repaired(thin))
        ends = {p for p in on if degree(on, p) == 1}
        assert on <= new and all(any((y + dy, c + dx) in ends for dy, dx in SIDES) for y, c in new - on)
        assert len(new - on) <= len(ends) and len(parts(new)) <= len(parts(on))


def test_measures():
    for x in MASKS[:40]:
        if not x.any() or x.mean() > 0.45:
            continue
        got, size = raster.features(x * np.uint8(255)), [len(p) for p in parts(cells(x))]
        ys, xs = zip(*cells(x), strict=True)
        high, wide = max(ys) - min(ys), max(xs) - min(xs)
        assert (got["components"], got["small_components"], got["medium_components"]) == (len(size), sum(n < 50 for n in size), sum(50 <= n < 500 for n in size))
        assert got["largest_share"] == pytest.approx(max(size) / sum(size)) and got["area_share"] == pytest.approx(x.mean())
        assert (got["box_height"], got["box_width"]) == (high, wide) and got["box_fill"] == pytest.approx(sum(size) / max(1, high * wide))
        d = sorted(raster.distance(x)[x])
        assert got["dist_mean"] == pytest.approx(sum(d) / len(d)) and got["dist_max"] == d[-1]


SKELETONS = [{(c, y) for y, c in cells(raster.thinned(x))} for x in MASKS]


def test_ends_and_forks():
    for on in SKELETONS:
        ends, forks = skeleton.classified(on)
        for p in on:
            n = [(p[0] + dx, p[1] + dy) in on for dy, dx in TURN]
            turns = sum(not n[k] and n[(k + 1) % 8] for k in range(8))
            assert (p in ends) == (sum(n) == 1) and (p in forks) == (sum(n) >= 3 or turns >= 3)


def test_clusters_of_forks():
    for on in SKELETONS:
        forks = skeleton.classified(on)[1]
        of = skeleton.clustered(forks)
        groups = parts(set(forks))
        assert {*of} == {*forks} and len({*of.values()}) == len(groups)
        for g in groups:
            cx, cy = (int(sum(p[k] for p in g) / len(g)) for k in (0, 1))
            assert {of[p] for p in g} == {min(sorted(g), key=lambda p: (p[0] - cx) ** 2 + (p[1] - cy) ** 2)}


def test_branches_join_nodes_and_lose_no_pixel():
    for on in SKELETONS:
        ends, forks = skeleton.classified(on)
        found, nodes = skeleton.traced(on), {*ends, *forks}
        for b in found:
            path = b["pixels"]
            assert len({*path}) == len(path) and {*path} <= on and path[0] in nodes and not nodes & {*path[1:-1]}
            assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for p, q in zip(path, path[1:], strict=False))
        # All but nodes without a way out, dots and closed rings lie on a branch.
        on_branch = {p for b in found for p in b["pixels"]}
        for whole in parts(on):
            if whole & nodes:
                assert whole - on_branch <= {*forks}


def test_longest_path_of_a_tree(spark):
    r, rows, want = random.Random(2), [], {}
    for image in range(12):
        ways = {0: []}
        for n in range(1, r.randrange(3, 14)):  # a random tree; a branch of so many pixels between (0, parent) and (0, n)
            up, size = r.randrange(n), r.randrange(5, 30)
            ways[n] = []
            ways[up].append((n, n - 1, size))
            ways[n].append((up, n - 1, size))
            rows += [(image, n - 1, k, 0, 0, 0, up, 0, n) for k in range(size)]

        def between(a, b, came=None, ways=ways):
            if a == b:
                return 0, []
            for q, branch, size in ways[a]:
                if q != came and (rest := between(q, b, a)) is not None:
                    return rest[0] + size, [branch, *rest[1]]
            return None

        want[image] = max(between(a, b)[0] for a, b in combinations(ways, 2))
    size = {(i, b): sum(x[:2] == (i, b) for x in rows) for i, b in {x[:2] for x in rows}}
    df = spark.createDataFrame(rows, "image_id long, branch_id long, ord long, x long, y long, src_x long, src_y long, dst_x long, dst_y long")
    got = {}
    for x in skeleton.diameter(df).collect():
        got[x.image_id] = got.get(x.image_id, 0) + size[x.image_id, x.branch_id]
    assert got == want


def test_queries_of_masks_equal_their_kernels(spark, sf):
    """Cells to masks, skeletons and back over whole tables, against the kernels on masks built here."""
    _, pixels = catalog.spaces.tree(spark, sf)
    mask = {}
    for p in pixels.select("image_id", "x", "y").collect():
        m = mask.setdefault(p.image_id, np.zeros((catalog.SIDE, catalog.SIDE), "u1"))
        c, y = int(float(p.x) // 5.5) + 1, int(float(p.y) // 12.0) + 1
        m[max(0, y - 1) : y + 2, max(0, c - 1) : c + 2] = 255
    got = {x.image_id: x.pixels for x in catalog.QUERIES["thin_prune_repair"](spark, sf).collect()}
    assert got == {i: int(raster.processed(m, **catalog.PARAMS).sum()) for i, m in mask.items()}
    table = {x.image_id: x.asDict() for x in catalog.QUERIES["mask_features"](spark, sf).collect()}
    for i, m in mask.items():
        assert all(table[i][k] == pytest.approx(v) for k, v in raster.features(m).items())
    least = {}
    for x in catalog.QUERIES["trace_branches"](spark, sf).collect():
        least.setdefault(x.image_id, []).append(x.length)
    for i, m in mask.items():
        on = {(c, y) for y, c in cells(raster.processed(m, **catalog.PARAMS))}
        want = [len(b["pixels"]) for b in skeleton.distinct_branches(skeleton.traced(on))]
        assert sorted(least.get(i, [])) == sorted(n for n in want if n >= 5)


def test_sets_are_thinned_as_their_boxes_are():
    """Sets of pixels far apart, dense ones and lines, all thinned at once by their neighbours."""
    g, rows, want = np.random.default_rng(11), [], []
    for k in range(40):
        size = (int(g.integers(1, 25)), int(g.integers(1, 25)))
        mask = np.pad(g.random(size) < g.choice([0.1, 0.5, 0.9, 1.0]), 1)
        rows += [(k, int(x) * (1000 if k == 3 else 1) - 7, int(y) + 10**6 * (k % 2)) for y, x in np.argwhere(mask)]
        want += (np.ones(mask.sum(), bool) if k == 3 else raster.thinned(mask)[mask]).tolist()
    of, x, y = (np.array(c) for c in zip(*rows, strict=True))
    got = raster.thinned_sets(of, x, y)
    alone = np.concatenate([raster.thinned_sets(of[of == k], x[of == k], y[of == k]) for k in np.unique(of)])
    assert (got == alone).all() and (got == want)[of != 3].all() and got.sum() < len(got) / 2
    assert not len(raster.thinned_sets(of[:0], x[:0], y[:0]))


def test_medial_subsections_work_by_image(spark):
    """Wide sparse branches: a kernel for an image, no rows for pairs of pixels; runs equal those by the chain of the axis."""
    g = np.random.default_rng(12)
    p = [(i, b if b < 9 else None, 1000 * b + k, float(x), float(y)) for i in (1, 2) for b in (*range(6), 9) for k, (x, y) in enumerate(np.unique(g.integers(0, (40, 3000 if b % 2 else 4), (70, 2)), axis=0) / 2)]
    df = spark.createDataFrame(p, "image_id long, branch_id long, ord long, x double, y double")
    found = heat.medial_subsections(df, 5)
    assert "Join" not in found._jdf.queryExecution().toString()
    axis = {}
    for r in skeleton.axes(df).orderBy("ord").collect():
        axis.setdefault((r.image_id, r.branch_id), []).append((r.x, r.y))
    got = {(r.image_id, r.branch_id, r.ord): r.section_id for r in found.collect()}
    want = {}
    for i, b, o, x, y in p:
        if b is not None:
            a = np.array(axis[i, b])
            parts = max(1, len(a) // 5)
            want[i, b, o] = min(int(((a - (x, y)) ** 2).sum(axis=1).argmin()) // (len(a) // parts), parts - 1)
    assert got == want and max(want.values()) > 2
