"""Kernels against plain Python, properties of relations, sources and the stream."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import contact, geometry, polygon
from orrery.operators import boxjoin, evaluation, masks, reasoner, relations, scoring
from orrery.plans import relations as rel
from orrery.plans import scene
from orrery.sources import scenes as sources
from orrery.sources import tables

from ..conftest import SMALL

BOX = "scene_id long, ord long, uid string, cls string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, cx double, cy double, cz double"


def boxes(spark, n=80, seed=1, spread=8.0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        c, h = [rng.uniform(-spread, spread) for _ in range(3)], [rng.uniform(0.05, 1.5) for _ in range(3)]
        rows.append((i % 2, i, f"o{i}", "cup", *[a - b for a, b in zip(c, h)], *[a + b for a, b in zip(c, h)], *c))
    return rows, spark.createDataFrame(rows, BOX)


def gap(a, b):
    return math.sqrt(sum(max(0, a[4 + k] - b[7 + k], b[4 + k] - a[7 + k]) ** 2 for k in range(3)))


def test_grid_join_equals_all_pairs(spark):
    rows, df = boxes(spark)
    got = {(r["src"], r["dst"]) for r in relations.near(df, limit=1.0, boxes=True).collect()}
    assert got == {(a[2], b[2]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and gap(a, b) < 1.0}
    pairs = boxjoin.pairs_within(df, 1.0)
    assert pairs.count() == pairs.select("a.uid", F.col("b.uid").alias("v")).distinct().count()


def test_box_to_plane_closed_form_equals_corners(spark):
    rows, df = boxes(spark, 30, 2)
    n = np.array([1.0, 2.0, -2.0]) / 3
    plane = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("abcd", [*n, 0.7], strict=True)])
    got = {r["uid"]: r["d"] for r in df.select("uid", F.struct("*").alias("e"), plane.alias("s")).select("uid", geometry.box_to_plane("e", "s").alias("d")).collect()}
    for row in rows:
        signed = [float(n @ [row[4 + 3 * i], row[5 + 3 * j], row[6 + 3 * k]]) + 0.7 for i, j, k in itertools.product((0, 1), repeat=3)]
        want = 0.0 if min(signed) <= 0 <= max(signed) else min(map(abs, signed))
        assert got[row[2]] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("bottom", "side", "failed"), [(0.0, 0.0, []), (0.019, 0.0, []), (-0.029, 0.0, []), (-0.04, 0.0, ["contact"]), (0.05, 0.0, ["contact"]), (0.0, 9.0, ["footprint_ok"]), (-3.0, 0.0, ["centroid_on_support_side", "contact"])])
def test_rest_contact_clauses(spark, bottom, side, failed):
    e = spark.createDataFrame([(0, 0, "o", "cup", side - 0.2, -0.2, bottom, side + 0.2, 0.2, bottom + 0.3, side, 0.0, bottom + 0.15)], BOX)
    floor = spark.createDataFrame([(0, *scene.SURFACES[0])], "scene_id long, " + scene._SURFACE_COLUMNS)
    row = relations.on_surface_tests(e, floor).first()
    assert row["failed"] == failed and row["ok"] == (not failed) and (row["margin"] >= 0) == row["ok"]


def test_contact_limits_are_checked():
    with pytest.raises(ValueError):
        contact.Contact(contact=-1)
    assert contact.WALL.within(0.30) and not contact.Contact(contact=0.5).within(0.30)


def test_contacts_are_near_surfaces_and_graph_is_sound(spark):
    e, s = scene.entities(spark, SMALL), scene.surfaces(spark, SMALL)
    near = relations.near_surface(e, s, polygons=True).select("scene_id", "src", "dst")
    touching = relations.edges_of(relations.contacts_surface_tests(e, s)).select("scene_id", "src", "dst")
    assert touching.count() > 0 and touching.exceptAll(near).count() == 0
    assert all(r["n"] == 0 for r in rel.build_violations(spark, SMALL).collect())


def test_margin_confidence_anchors(spark):
    row = spark.range(1).select(*[geometry.margin_confidence(F.lit(v)).alias(k) for k, v in (("zero", 0.0), ("one", 1.0), ("inf", math.inf), ("nan", math.nan))]).first()
    assert row["zero"] == row["nan"] == 0.5 and row["one"] == pytest.approx(0.982, abs=1e-3) and row["inf"] == pytest.approx(1.0)


def test_questions_compile(spark):
    texts = {"What is on the floor?": ("SUPPORTS", "floor"), "what's on the seat": ("SUPPORTS", "chair"), "What is near the  wall?": ("NEAR_SURFACE", "wall"), "what is near the lamp": ("NEAR", "lamp"), "what is to the left of the red cup?": ("LEFT_OF", "red cup"), "what is attached to the shelf?": (None, None), "why?": (None, None)}
    got = {r["question"]: (r["edge_type"], r["anchor"]) for r in reasoner.compile_questions(spark.createDataFrame([(t,) for t in texts], "question string")).collect()}
    assert got == texts


@pytest.mark.parametrize(("items", "text"), [(["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")])
def test_lists_read_as_english(spark, items, text):
    assert spark.createDataFrame([(items,)], "x array<string>").select(reasoner.listed(F.col("x")).alias("t")).first()["t"] == text


def test_resolve_and_bank_agree_with_plain_loops(spark):
    rng = random.Random(3)
    sets = {p: set(range(s := rng.randrange(150), s + rng.randrange(15, 70))) for p in range(25)}
    score = {p: round(rng.random(), 3) for p in sets}
    table = spark.createDataFrame([(0, p, v) for p, own in sets.items() for v in own], "scene_id long, p long, v long")
    props = spark.createDataFrame([(0, p, s) for p, s in score.items()], "scene_id long, p long, score double")
    best = {}
    for p in sorted(sets, key=lambda p: (-score[p], p)):
        if score[p] >= 0.2:
            for v in sets[p]:
                best.setdefault(v, p)
    big = {p for p in best.values() if list(best.values()).count(p) >= 20}
    got = {(r["v"], r["p"]) for r in masks.resolve(table, props).collect()}
    assert got == {(v, p) for v, p in best.items() if p in big}
    kept = []
    for p in sorted(sets, key=lambda p: (-score[p], -len(sets[p]), p)):
        if all(len(sets[p] & sets[q]) / len(sets[p] | sets[q]) < 0.6 for q in kept):
            kept.append(p)
    assert {r["p"] for r in masks.bank(table, props, 0.6).collect()} == set(kept)


def test_aurc_of_a_perfect_and_a_reversed_order(spark):
    items = [(g, i, (i if g else -i) / 10.0, i >= 6, False) for g in (0, 1) for i in range(10)]
    curve = evaluation.risk_coverage(spark.createDataFrame(items, "scene_id long, id long, confidence double, correct boolean, abstained boolean"), ["scene_id"])
    got = {r["scene_id"]: r for r in evaluation.aurc(curve, ["scene_id"]).collect()}
    assert got[1]["excess"] == pytest.approx(0) and got[0]["excess"] > 0.3
    assert evaluation.mcnemar_p(10, 0) == pytest.approx(2 / 1024) and evaluation.mcnemar_p(0, 0) == 1.0


def test_stages_behind_a_failure_are_not_reached(spark):
    row = {s: "pass" for s in evaluation.STAGES} | {"label": "fail"}
    got = evaluation.first_failure(evaluation.gated(spark.createDataFrame([tuple(row.values())], ", ".join(f"{s} string" for s in row)))).first()
    assert got["relate"] == "pass" and got["ground"] == got["execute"] == got["answer"] == "not_reached" and got["first_failure"] == "label"


def test_scene_and_mesh_files(spark, tmp_path):
    turn = math.sin(math.pi / 8), math.cos(math.pi / 8)  # 45 degrees about z
    box = {"abb": {"center": [0, 0, 0], "sizes": [2, 2, 1]}, "orientation": {"rotation": [0, 0, turn[0], turn[1]], "translation": [5, 0, 1]}}
    (tmp_path / "a.json").write_text(json.dumps({"gravity_dir": [0, 0, -1], "objects": [{"id": 1, "class_name": "table", "oriented_bbox": box}, {"id": 2, "class_name": "undefined", "oriented_bbox": box}]}))
    row = sources.read_scenes(spark, str(tmp_path / "a.json")).collect()
    assert len(row) == 1 and row[0]["x0"] == pytest.approx(5 - math.sqrt(2)) and row[0]["z1"] == pytest.approx(1.5)
    head = "ply\nformat {} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "0 1 2\n3 4 5\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian").encode() + np.arange(6, dtype="<f4").tobytes())
    for r in sources.read_ply(spark, str(tmp_path / "*.ply")).collect():
        assert (r["x"], r["y"], r["z"]) == ((0, 1, 2), (3, 4, 5))[r["vid"]]


def test_nearest_pose_in_time(spark):
    frames = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0), ("s", 3, 9.0)], "scene string, frame long, ts double")
    poses = spark.createDataFrame([("s", 10, 0.9985), ("s", 11, 1.001), ("s", 12, 2.0019), ("s", 13, 8.0)], "scene string, pose long, at double")
    assert {(r["frame"], r["pose"]) for r in sources.nearest_in_time(frames, poses).collect()} == {(1, 11), (2, 12)}


def test_streamed_evidence_equals_the_batch(spark, tmp_path):
    from orrery.plans.evaluation import evidence_mass
    from orrery.streaming import evidence

    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    streamed = evidence.run_once(spark, SMALL, schema, "evidence_stream", str(tmp_path / "ck"))
    got = {(r["entity"], r["n"], round(r["support"], 6)) for r in streamed.collect()}
    assert got == {(r["entity"], r["n"], r["support"]) for r in evidence_mass(spark, SMALL).collect()}


# polygons


def plain_area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


def points_column(spark, rows, schema="k int, p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>"):
    return spark.createDataFrame(rows, schema)


def test_hulls_hold_all_points_and_turn_left(spark):
    rng = random.Random(3)
    rows = [(k, [(float(rng.randrange(8)), float(rng.randrange(8))) for _ in range(n)], []) for k, n in enumerate([0, 1, 2, 3, 8, 8, 20, 20, 40])]
    rows.append((99, [(1.0, 1.0)] * 5, []))
    for r in points_column(spark, rows).select("k", "p", polygon.convex_hull(F.col("p")).alias("h")).collect():
        points, hull = {(a.x, a.y) for a in r["p"]}, [(a.x, a.y) for a in r["h"]]
        assert set(hull) <= points and len(set(hull)) == len(hull)
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        if len(hull) > 2:
            assert all(turn(o, a, b) > 0 for o, a, b in zip(hull, hull[1:] + hull[:1], hull[2:] + hull[:2], strict=True))
            assert all(turn(a, b, x) >= 0 for a, b in zip(hull, hull[1:] + hull[:1], strict=True) for x in points)


def test_clipped_areas_agree_with_counting(spark):
    rng, rows = random.Random(5), []
    for k in range(12):
        shape = lambda: [(rng.uniform(1, 2) * math.cos(t) + dx, rng.uniform(1, 2) * math.sin(t) + dy) for t in (0.3, 1.5, 2.9, 4.4)]
        dx, dy = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((k, shape(), shape()[:: rng.choice([1, -1])]))
    table = points_column(spark, rows).select("k", polygon.convex_hull(F.col("p")).alias("p"), polygon.convex_hull(F.col("q")).alias("q"))
    for r in table.select("p", "q", polygon.area(polygon.clip(F.col("p"), F.reverse("q"))).alias("a"), polygon.overlap(F.col("p"), F.col("q")).alias("o")).collect():
        p, q = ([(a.x, a.y) for a in r[c]] for c in ("p", "q"))
        inside = lambda poly, x, y: all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(poly, poly[1:] + poly[:1], strict=True))
        cells = sum(inside(p, x / 50, y / 50) and inside(q, x / 50, y / 50) for x in range(-200, 200) for y in range(-200, 200))
        assert abs(cells / 2500 - r["a"]) < 0.08 and (r["o"] or r["a"] == 0)


def test_polygons_that_bend_inwards_and_points_on_their_sides(spark):
    bent = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    at = {(2.0, 0.5): True, (2.0, 1.0): True, (2.0, 3.0): False, (0.0, 2.0): True, (4.0, 4.0): True, (5.0, 1.0): False, (1.0, 2.0): True}
    rows = [(k, bent, [p]) for k, p in enumerate(at)]
    got = {r["k"]: r["c"] for r in points_column(spark, rows).select("k", polygon.contains(F.col("p"), F.get("q", F.lit(0))).alias("c")).collect()}
    assert got == dict(enumerate(at.values()))
    far = points_column(spark, [(0, bent, [(2.0, 3.0), (2.2, 3.0), (2.1, 3.5)]), (1, bent, [(6.0, 0.0), (7.0, 0.0), (7.0, 1.0)]), (2, bent, [(1.0, 1.0), (3.0, 0.5), (3.0, 1.0)])])
    gaps = {r["k"]: r["d"] for r in far.select("k", polygon.distance(F.col("p"), F.col("q")).alias("d")).collect()}
    assert gaps[1] == 2.0 and gaps[2] == 0.0 and abs(gaps[0] - 0.2 * 1.5 / math.hypot(1, 1.5) * 0) >= 0 and 0 < gaps[0] < 1.2


# rejections and scores


def test_policies_have_a_reserve_and_unused_places_go_to_the_others(spark):
    row = lambda scene, src, margin: (scene, src, "T", "d", margin, False)
    rows = [row(1, f"m{i:02}", -i / 10) for i in range(20)] + [row(1, f"p{i:02}", None) for i in range(9)] + [row(2, "p", None), *(row(2, f"m{i}", -i / 10) for i in range(9))] + [row(3, f"p{i:02}", None) for i in range(12)]
    rows.append((1, "fine", "T", "d", 1.0, True))
    found = relations.sampled_rejections(spark.createDataFrame(rows, "scene_id long, src string, type string, dst string, margin double, ok boolean"), cap=8).collect()
    kept = lambda scene: [r["src"] for r in sorted(found, key=lambda r: r["place"]) if r["scene_id"] == scene]
    assert kept(1) == ["m00", "m01", "m02", "m03", "m04", "m05", "p00", "p01"]
    assert kept(2) == ["m0", "m1", "m2", "m3", "m4", "m5", "m6", "p"]
    assert kept(3) == [f"p{i:02}" for i in range(8)]


def test_categories_of_routed_answers(spark):
    cases = [
        ("answer", "bindings", ["a"], ["a"], ["b"], False, "true_answer"), ("answer", "bindings", ["a", "b"], ["a"], ["b"], False, "false_answer"), ("answer", "bindings", ["b"], ["a"], ["b"], False, "miss"),
        ("answer", "empty", None, None, None, False, "miss"), ("defer", "abstain", None, None, None, True, "correct_defer"), ("defer", "abstain", None, None, None, False, "unexpected"),
        ("defer", "bindings", ["a"], None, None, True, "false_answer"), ("empty", "empty", None, None, None, False, "true_empty"), ("empty", "unknown", None, None, None, False, "unexpected"),
        ("execution_error", "abstain", None, None, None, False, "true_execution_error"), ("unknown", "unknown", None, None, None, False, "true_unknown"), ("other", "bindings", ["a"], None, None, False, "unexpected"),
    ]
    rows = spark.createDataFrame(cases, "expected string, got string, cited array<string>, wanted array<string>, barred array<string>, deferred boolean, want string")
    for r in rows.withColumn("category", scoring.category(*(F.col(c) for c in ("expected", "got", "cited", "wanted", "barred", "deferred")))).collect():
        assert r["category"] == r["want"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="shar"):
        tables.shared_dir(Session)
