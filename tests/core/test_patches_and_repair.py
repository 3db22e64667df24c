"""Patches, greedy choices, repairs, ceilings and association against plain loops."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import digests, linear, polygon
from orrery.operators import association, boxjoin, ceilings, components, greedy, masks, patches, repair

MASK = "scene_id long, p long, v long"


def intervals(seed, k=40, n=200, least=4, most=60):
    rng = random.Random(seed)
    sets = [set(range(a, min(n, a + rng.randrange(least, most)))) for a in (rng.randrange(n) for _ in range(k))]
    # nearly equal masks and nested ones, which repairs are about
    for i in range(0, k - 3, 4):
        sets[i + 1] = set(sorted(sets[i])[: max(2, int(len(sets[i]) * rng.choice([0.45, 0.2, 0.95])))])
        sets[i + 2] = set(sorted(sets[i])[-max(2, int(len(sets[i]) * 0.45)) :])
    return sets, [round(rng.random(), 3) for _ in sets]


def tables(spark, sets, scores=None):
    rows = spark.createDataFrame([(0, p, v) for p, s in enumerate(sets) for v in s], MASK)
    return rows, spark.createDataFrame([(0, p, x) for p, x in enumerate(scores or [])], "scene_id long, p long, score double")


# functions


def test_least_axis_and_centroid_equal_numpy_and_shoelace(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(40):
        points = rng.normal(size=(12, 3)) * [3.0, 1.0, [0.0, 1e-6, 0.3][k % 3]] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + 5
        rows += [(k, float(w), *map(float, p)) for w, p in zip(rng.random(12) + 0.1, points)]
    df = spark.createDataFrame(rows, "k long, w double, x double, y double, z double")
    mean = df.groupBy("k").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m{c}") for c in "xyz"])
    near = df.join(mean, "k").groupBy("k").agg(*[c.alias(n) for n, c in linear.weighted_spread(F.col("w"), *[F.col(c) - F.col(f"m{c}") for c in "xyz"]).items()])
    matrix = linear.Spread(*[F.col(n) for n in ("xx", "xy", "xz", "yy", "yz", "zz")])
    for r in near.withColumn("l", linear.least_eigenvalue(matrix)).withColumn("n", linear.null_axis(matrix, F.col("l"))).collect():
        values, vectors = np.linalg.eigh(np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]]))
        assert r["l"] == pytest.approx(values[0], abs=1e-12)
        assert abs(np.dot([r["n"][k] for k in "xyz"], vectors[:, 0])) == pytest.approx(1, abs=1e-9)
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]
    flat = [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]
    cases = spark.createDataFrame([([{"x": x, "y": y} for x, y in s],) for s in (shape, shape[::-1], flat, [])], "q array<struct<x:double,y:double>>")
    got = [r["c"] and (r["c"]["x"], r["c"]["y"]) for r in cases.select(polygon.centroid(F.col("q")).alias("c")).collect()]
    assert got[0] == pytest.approx((9.0 / 6, 1.0)) and got[1] == pytest.approx(got[0]) and got[2] == (1.0, 1.0) and got[3] is None


def test_digest_is_of_little_endian_longs(spark):
    ids = [0, 1, 255, 2**40 + 7, 12]
    got = spark.range(1).select(digests.ids_sha256(F.array(*[F.lit(i).cast("long") for i in ids])).alias("d")).first()["d"]
    assert got == hashlib.sha256(np.array(ids, "<i8").tobytes()).hexdigest()


# groups


def test_components_of_paths_stars_and_groups(spark):
    rng = random.Random(1)
    edges = [(0, i, i + 1) for i in range(60)] + [(1, 5, i) for i in range(40)] + [(2, 3, 3)] + [(3, rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    df = spark.createDataFrame(edges, "scene_id long, a long, b long")
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, a, b in edges:
        x, y = sorted((top((g, a)), top((g, b))))
        parent[y] = x
    got = {(r["scene_id"], r["node"]): r["root"] for r in components.components(df, ["scene_id"], "a", "b").collect()}
    assert got == {k: top(k)[1] for k in parent}
    assert components.components(df.where("false"), ["scene_id"], "a", "b").count() == 0


def test_greedy_rounds_equal_the_loop(spark):
    rng = random.Random(2)
    pairs = {(g, *sorted(rng.sample(range(50), 2))) for g in range(3) for _ in range(70)} | {(9, i, i + 1) for i in range(30)}
    kept = {}
    for g in {p[0] for p in pairs}:
        kept[g] = set()
        for node in range(60):
            if not any((g, k, node) in pairs for k in kept[g]):
                kept[g].add(node)
    df = spark.createDataFrame(sorted(pairs), "scene_id long, better long, worse long")
    got = {(r["scene_id"], r["node"]) for r in greedy.losers(df, ["scene_id"]).collect()}
    assert got == {(g, n) for g, k in kept.items() for n in range(60) if n not in k}
    assert greedy.losers(df.where("false"), ["scene_id"]).count() == 0


def test_footprints_meet_once(spark):
    rng = random.Random(4)
    box = lambda: (lambda x, y: (x, y, x + rng.uniform(0, 3), y + rng.uniform(0, 3)))(rng.uniform(-4, 4), rng.uniform(-4, 4))
    a, b = ([(i % 2, i, *box()) for i in range(40)] for _ in range(2))
    schema = "scene_id long, n long, x0 double, y0 double, x1 double, y1 double"
    got = [(r["s"], r["t"]) for r in boxjoin.footprints_meeting(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).select(F.col("t.n").alias("s"), F.col("s.n").alias("t")).collect()]
    want = [(p[1], q[1]) for p, q in itertools.product(a, b) if p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]]
    assert sorted(got) == sorted(want)


# patches


def test_patches_rest_and_floor_of_a_small_scene(spark):
    """A table top with a cup on it, a tilted lid that is no patch, a floor, and a box half off the table."""
    quad = lambda base, pts, own: ([(0, base + i, *map(float, p), own) for i, p in enumerate(pts)], [(0, 10 * base, base, base + 1, base + 2), (0, 10 * base + 1, base, base + 2, base + 3)])
    table = quad(0, [(0, 0, 1), (2, 0, 1), (2, 1, 1), (0, 1, 1)], 1)
    legs = ([(0, 50, 0.0, 0.0, 0.0, 1)], [])
    lid = quad(10, [(5, 0, 1), (6, 0, 1.5), (6, 1, 1.5), (5, 1, 1)], 2)
    floor = quad(20, [(-5, -5, 0), (7, -5, 0), (7, 5, 0), (-5, 5, 0)], 3)
    mixed = ([(0, 30, 9.0, 9.0, 0.0, 4), (0, 31, 10.0, 9.0, 0.0, 4), (0, 32, 9.0, 10.0, 0.0, -1)], [(0, 300, 30, 31, 32)])
    parts = (table, legs, lid, floor, mixed)
    vertices = spark.createDataFrame([v for p in parts for v in p[0]], "scene_id long, vid long, x double, y double, z double, instance long")
    faces = spark.createDataFrame([f for p in parts for f in p[1]], "scene_id long, fid long, a long, b long, c long")
    found = patches.entity_patches(faces, vertices).cache()
    told = {r["owner"]: r for r in found.collect()}
    assert set(told) == {1, 3}
    top = told[1]
    assert (top["patch_uid"], top["n_faces"], top["n_vertices"], top["qualifies"]) == ("instance_1_hpatch_000", 2, 4, True)
    assert [top[k] for k in ("height", "projected_area", "footprint_area", "coverage", "area_share")] == pytest.approx([1, 2, 2, 1, 1])
    assert top["faces_sha256"] == hashlib.sha256(np.array([0, 1], "<i8").tobytes()).hexdigest()
    boxes = spark.createDataFrame(
        [(0, 1, "table", 0.0, 0.0, 0.0, 2.0, 1.0, 1.0), (0, 3, "floor", -5.0, -5.0, 0.0, 7.0, 5.0, 0.0), (0, 7, "cup", 0.5, 0.25, 1.01, 0.75, 0.5, 1.26), (0, 8, "half", 1.8, 0.0, 1.0, 2.3, 1.0, 1.5), (0, 9, "away", 3.0, 3.0, 2.0, 4.0, 4.0, 3.0)],
        "scene_id long, owner long, uid string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double",
    )
    floors = patches.floor_patches(boxes, found)
    assert floors.first().asDict()["patch_uid"] == "instance_3_hpatch_000" and floors.first()["status"] == "available"
    rest = {(r["uid"], r["owner"]): r for r in patches.patch_resting(boxes, found, floors).collect()}
    assert set(rest) == {("table", 3), ("floor", 1), ("cup", 1), ("cup", 3), ("half", 1), ("half", 3), ("away", 3)}
    cup = rest["cup", 1]
    assert cup["candidate"] and cup["best"] and cup["contained"] and cup["gap"] == pytest.approx(0.01) and cup["floor_state"] == "clear"
    assert list(rest["half", 1]["reasons"]) == ["footprint_overlap_below_min"] and rest["half", 1]["overlap_target"] == pytest.approx(0.4)
    assert rest["table", 3]["floor_state"] == "contact" and list(rest["table", 3]["reasons"]) == ["target_floor_contact"]
    assert list(rest["away", 3]["reasons"]) == ["vertical_gap_above_contact_band"]
    none = patches.floor_patches(boxes, found.where("owner = 1"))
    assert none.first()["status"] == "unknown"
    unsure = patches.patch_resting(boxes, found.where("owner = 1"), none, patches.RestLimits(unknown_floor_rejects=True)).where("uid = 'cup'").first()
    assert list(unsure["reasons"]) == ["target_floor_contact_unknown"]


# repair


def plain_children(sets, scores, least):
    """Kept children of every parent, by the loop over candidates from the largest."""
    out = {}
    for p, s in enumerate(sets):
        if scores[p] < 0.2:
            continue
        kids = sorted((c for c, t in enumerate(sets) if c != p and len(t) >= least and len(s & t) / len(t) >= 0.8 and len(t) <= 0.5 * len(s)), key=lambda c: (-len(sets[c]), c))
        kept = []
        for c in kids:
            if all(len(sets[c] & sets[o]) / min(len(sets[c]), len(sets[o])) <= 0.2 for o in kept):
                kept.append(c)
        if len(kept) >= 2 and sum(len(sets[p] & sets[c]) for c in kept) >= 0.5 * len(s):
            out[p] = kept
    return out


def plain_resolve(sets, priority, least):
    owner = {}
    for v in set().union(*sets):
        able = [p for p, s in enumerate(sets) if v in s and priority[p] >= 0]
        if able:
            owner[v] = min(able, key=lambda p: (-priority[p], p))
    sizes = {p: sum(o == p for o in owner.values()) for p in set(owner.values())}
    return {v: p for v, p in owner.items() if sizes[p] >= least}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repairs_equal_the_loops(spark, seed):
    sets, scores = intervals(seed)
    rows, scored = tables(spark, sets, scores)
    suspects = plain_children(sets, scores, 1)
    want = [x if x >= 0.2 and p not in suspects else -1.0 for p, x in enumerate(scores)]
    for p, kids in suspects.items():
        for c in kids:
            want[c] = max(want[c], scores[c], scores[p])
    got = {r["p"]: r for r in repair.repair_v1(rows, scored).collect()}
    assert {p: r["priority"] for p, r in got.items()} == dict(enumerate(want))
    assert {p for p, r in got.items() if r["suspect"]} == set(suspects)
    iou = lambda a, b: len(a & b) / len(a | b)
    for function, rule, split in ((repair.repair_v2, repair.CARVE_WIDE, False), (repair.repair_v3, repair.CARVE_NARROW, True)):
        own = [x if x >= 0.2 else -1.0 for x in scores]
        base, least = list(own), 5
        lifts = [(c, p) for p, kids in (plain_children(sets, scores, least) if split else {}).items() for c in kids]
        for c, s in enumerate(sets):
            if len(s) >= least and sum(iou(s, t) >= rule.iou for o, t in enumerate(sets) if o != c) >= rule.others:
                lifts += [(c, p) for p, t in enumerate(sets) if p != c and base[p] >= 0 and len(s & t) / len(s) >= 0.8 and len(s) <= rule.size * len(t)]
        for c, p in lifts:
            own[c] = max(own[c], scores[p] + 1e-6)
        first = plain_resolve(sets, own, least)
        stay = [x if x >= 0 and sum(o == p for o in first.values()) / len(sets[p]) >= rule.retained else -1.0 for p, x in enumerate(own)]
        got = {r["v"]: r["p"] for r in function(rows, scored, rule, least).collect()}
        assert got == plain_resolve(sets, stay, least)


def test_expansion_claims_what_is_not_locked(spark):
    rows = spark.createDataFrame([(0, 1, v) for v in range(0, 10)] + [(0, 2, v) for v in range(8, 20)] + [(0, 3, v) for v in range(15, 25)] + [(0, 4, v) for v in range(5, 18)] + [(0, 5, 30)], MASK)
    hard = spark.createDataFrame([(0, v, 1) for v in range(10)] + [(0, v, 2) for v in range(10, 20)], "scene_id long, v long, p long")
    chosen = spark.createDataFrame([(0, 3, 0.5), (0, 4, 0.9), (0, 5, 0.7)], "scene_id long, p long, score double")
    locked = spark.createDataFrame([(0, 1)], "scene_id long, p long")
    got = {r["v"]: r["p"] for r in repair.expanded(hard, rows, chosen, locked, 3).collect()}
    # 1 is locked, 4 has the better score, 3 takes the rest of 2, what is left of 5 is too small
    assert got == {**dict.fromkeys(range(10), 1), **dict.fromkeys(range(10, 18), 4), **dict.fromkeys(range(18, 25), 3)}


# ceilings


@pytest.mark.parametrize("seed", [5, 6])
def test_ceilings_equal_the_loops(spark, seed):
    sets, _ = intervals(seed)
    rows, _ = tables(spark, sets)
    objects = [set(range(q * 25, q * 25 + 25)) for q in range(8)]
    truth = spark.createDataFrame([(0, q, v) for q, s in enumerate(objects) for v in s], MASK)
    iou = lambda a, b: len(a & b) / len(a | b)
    got = {}
    for r in ceilings.union_curve(rows, truth, candidates=10).orderBy("q", "step").collect():
        got.setdefault(r["q"], []).append((r["p"], pytest.approx(r["iou"])))
    for q, s in enumerate(objects):
        met = sorted((p for p, t in enumerate(sets) if s & t), key=lambda p: (-len(s & sets[p]), p))[:10]
        union, curve = set(), []
        for _ in range(8):
            best = min(((-iou(union | sets[p], s), p) for p in met if p not in {c for c, _ in curve}), default=(0, None))
            if -best[0] <= (iou(union, s) if union else 0.0):
                break
            curve.append((best[1], -best[0]))
            union |= sets[best[1]]
        assert got.get(q, []) == curve
    options = {q: sorted(((iou(s, t), p) for p, t in enumerate(sets) if iou(s, t) >= 0.3), reverse=True) for q, s in enumerate(objects)}
    taken, want = set(), {}
    for q in sorted((q for q in options if options[q]), key=lambda q: (-options[q][0][0], q)):
        for rank, (_, p) in enumerate(options[q]):
            if p not in taken:
                taken.add(p)
                want[q] = (p, rank)
                break
    assert {r["q"]: (r["p"], r["rank"]) for r in ceilings.nominated(rows, truth, 0.3).collect()} == want


# association


def test_association_links_across_views_only_and_votes(spark):
    a, b = set(range(0, 40)), set(range(100, 140))
    lifted = {0: (0, a), 1: (1, a - {0, 1}), 2: (2, a | {40, 41}), 3: (0, a - {5}), 4: (1, b), 5: (1, b - {100}), 6: (3, b), 7: (2, set(range(30, 70)))}
    rows = spark.createDataFrame([(0, m, view, v) for m, (view, s) in lifted.items() for v in s], "scene_id long, mask long, view long, v long")
    found = {r["mask"]: r["cluster"] for r in association.associated(rows, association.Linkage(stride=1)).collect()}
    # 3 shares a view with 0 but is linked through 1; 5 shares a view with 4 and is linked through 6
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 4, 7: 7}
    visible = spark.createDataFrame([(0, view, v) for view in range(4) for v in range(150) if (view, v) != (2, 3)], "scene_id long, view long, v long")
    ways = spark.createDataFrame([(0, k, math.cos(math.radians(6 * k)), math.sin(math.radians(6 * k)), 0.0) for k in range(4)], "scene_id long, view long, dx double, dy double, dz double")
    quality = spark.createDataFrame([(0, m, 0.5 + m / 20) for m in lifted], "scene_id long, mask long, predicted double")
    total = spark.createDataFrame([(0, 150)], "scene_id long, n long")
    clusters = association.associated(rows, association.Linkage(stride=1))
    table, held = association.fused(clusters, rows, visible, ways, quality, total, association.Voting(least=10, most_share=0.4))
    got = {r["cluster"]: r for r in table.collect()}
    assert set(got) == {0, 4}
    assert (got[0]["members"], got[0]["views"]) == (4, 3) and got[0]["degrees"] == pytest.approx(12) and got[0]["confidence"] == pytest.approx(0.575)
    # 40 and 41 are in one of the three views that see them
    assert {r["v"] for r in held.where("cluster = 0").collect()} == a
    assert {r["v"] for r in held.where("cluster = 4").collect()} == b
    bank = spark.createDataFrame([(0, 0, v) for v in b] + [(0, 1, v) for v in range(-100, 60)], MASK)
    kinds = {r["cluster"]: (r["kind"], r["parent"], r["emitted"]) for r in association.classified(table, held, bank, association.Novelty(least=10)).collect()}
    assert kinds == {0: ("split", 1, True), 4: ("duplicate_of_baseline", None, False)}


def test_ids_that_are_no_candidates_fail(spark):
    rows, scored = tables(spark, [set(range(30)), set(range(20, 60))], [0.9, 0.1])
    view = masks.policy_view(rows, scored, 0.2, 0.05, 5)
    hard = masks.resolve(rows, scored, 0.05, 5)
    chosen = spark.createDataFrame([(0, 1)], "scene_id long, p long")
    assert masks.activated(hard, view, chosen).count() == 60
    with pytest.raises(Exception, match="no candidate"):
        masks.activated(hard, view, spark.createDataFrame([(0, 0)], "scene_id long, p long")).collect()
