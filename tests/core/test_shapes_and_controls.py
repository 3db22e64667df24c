"""Surfaces of any shape in relations, unmeasured rejections, and random controls."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import polygon
from orrery.operators import evaluation, reasoner, relations
from orrery.plans.polygons import SHAPES

BOX = "scene_id long, ord long, uid string, cls string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, cx double, cy double, cz double"
SURFACE = "scene_id long, surface string, surface_type string, a double, b double, c double, d double, polygon array<struct<x:double,y:double,z:double>>"


def box(uid, x, y, z, half=0.25):
    x, y, z = float(x), float(y), float(z)
    return (0, 0, uid, "cup", x - half, y - half, z - half, x + half, y + half, z + half, x, y, z)


def test_boxes_meet_surfaces_of_any_shape(spark):
    e = spark.createDataFrame([box("on", -2, -2, 0.25), box("corner", 1.25, 1.25, 0.25), box("far", 1.25, 1.25, 3.25)], BOX)
    s = spark.createDataFrame([(0, *row) for row in SHAPES], SURFACE)
    rows = relations.with_surfaces(e, s).select("e.uid", "s.surface", polygon.box_to_surface("e", "s").alias("m")).collect()
    got = {(r["uid"], r["surface"]): r["m"] for r in rows}
    assert got["on", "floor"]["distance"] == 0 and got["on", "floor"]["distance_metric"] == "polygon_clipped"
    # the missing corner of the floor begins a metre from either side of the box
    assert got["corner", "floor"]["in_plane_gap"] == pytest.approx(1.0) and got["corner", "floor"]["normal_gap"] == 0
    assert got["far", "floor"]["distance"] == pytest.approx(math.hypot(3.0, 1.0))
    wall = got["corner", "wall_n"]
    assert (wall["distance"], wall["in_plane_gap"], wall["fallback_reason"], wall["clipped"]) == (pytest.approx(2.5), None, "polygon_none", False)
    tests = {(r["src"], r["dst"]): r for r in relations.on_surface_tests(e, s).collect()}
    assert tests["on", "floor"]["ok"] and list(tests["corner", "floor"]["failed"]) == ["footprint_ok"]
    assert "support_capable" not in tests["on", "ramp"]["failed"] and ("on", "wall_n") not in tests
    near = {(r["src"], r["dst"]) for r in relations.near_surface(e, s, polygons=True).collect()}
    assert ("on", "floor") in near and ("far", "floor") not in near
    assert relations.attached_to(e, s).count() == 0


def test_polygons_off_their_plane_or_too_small(spark):
    e = spark.createDataFrame([box("a", 0, 0, 1)], BOX)
    flat = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0)]
    surface = lambda q: spark.createDataFrame([(0, "f", "floor", 0.0, 0.0, 1.0, 0.0, q)], SURFACE)
    gap = lambda q: relations.with_surfaces(e, surface(q)).select(polygon.surface_gap("e", "s").alias("g")).first()["g"]
    assert gap(flat) == 0 and gap(flat[:2]) == math.inf and gap([(x, y, 0.00009) for x, y, _ in flat]) == 0
    with pytest.raises(Exception, match="does not lie"):
        gap([*flat, (0.0, 1.0, 0.0002)])


def test_a_rejection_without_a_margin_limits_nothing(spark):
    asked = spark.createDataFrame([(0, "q", "ON_SURFACE", "surface", "floor")], "scene_id long, question string, edge_type string, anchor_kind string, anchor string")
    entities = spark.createDataFrame([box("a", 0, 0, 1), box("b", 2, 0, 1)], BOX)
    surfaces = spark.createDataFrame([(0, "f", "floor")], "scene_id long, surface string, surface_type string")
    found = lambda rows: reasoner.ceilings(asked, entities, surfaces, spark.createDataFrame(rows, "scene_id long, type string, src string, dst string, margin double")).first()
    only = found([(0, "ON_SURFACE", "a", "f", None)])
    assert (only["ceiling"], only["n_scoped"], only["n_measured"]) == (1.0, 1, 0)
    both = found([(0, "ON_SURFACE", "a", "f", None), (0, "ON_SURFACE", "b", "f", 0.0)])
    assert (both["ceiling"], both["n_scoped"], both["n_measured"]) == (0.5, 2, 1)


def test_controls_order_by_rank_and_then_by_noise(spark):
    items = [(g, i, float(i % 3 == 0), i % 3 == 0 or i % 7 == 0, i % 11 == 0) for g in range(2) for i in range(40)]
    df = spark.createDataFrame(items, "scene_id long, id long, rank double, correct boolean, abstained boolean")
    trials, seed = 60, 5
    shares = {(r["i"], r["t"]): r["u"] for r in spark.range(40).withColumnRenamed("id", "i").crossJoin(spark.range(trials).withColumnRenamed("id", "t")).select("i", "t", evaluation.hashed_share(F.col("i"), F.col("t"), seed).alias("u")).collect()}
    assert all(0 <= u < 1 for u in shares.values()) and len(set(shares.values())) > 0.99 * len(shares)
    assert 0.45 < sum(shares.values()) / len(shares) < 0.55
    values = []
    for t in range(trials):
        ordered = sorted((x for x in items if x[0] == 0), key=lambda x: (x[4], -(x[2] + shares[x[1], t] * 1e-3)))
        wrong, risks = 0, []
        for k, x in enumerate(ordered, 1):
            wrong += not x[3]
            risks.append(wrong / k)
        values.append(sum(risks) / len(risks))
    values.sort()
    got = {r["scene_id"]: r for r in evaluation.random_control(df, ["scene_id"], trials, seed).collect()}
    assert got[0]["mean"] == pytest.approx(sum(values) / trials) and got[0]["p05"] == pytest.approx(values[3]) and got[0]["p95"] == pytest.approx(values[57])
    assert got[1]["mean"] == pytest.approx(got[0]["mean"])
    ranks = {r["family"]: r["rank"] for r in evaluation.observed_ranks(df.withColumn("family", F.col("id") % 3), ["scene_id"], "family").where("scene_id = 0").collect()}
    assert ranks[0] == 1.0


def test_what_is_put_off_does_not_read_as_nothing(spark):
    rows = [("what is on the moon?", "abstain", "x"), ("What is   against the door?", "abstain", "x"), ("what is attached to the lamp", "abstain", "x"), ("sing", "parser_failure", "no"), ("what is near the cup?", "unknown", "x"), ("what is on the desk?", "empty", "Nothing in the scene matches that.")]
    asked = spark.createDataFrame(rows, "question string, outcome string, text string").withColumn("scene_id", F.lit(0))
    compiled = reasoner.compile_questions(asked.select("question"))
    got = {r["question"]: (r["text"], r["answered_by"]) for r in reasoner.spoken(asked, compiled).collect()}
    assert len(got) == len(rows)
    for question, _, why in ((rows[0][0], 0, "support class"), (rows[1][0], 0, "wall contact"), (rows[2][0], 0, "wall surfaces only")):
        text, who = got[question]
        assert why in text and text.endswith("This isn't a claim that nothing is there.") and who == "verbalizer_abstain"
    assert got["sing"] == ("no", "verbalizer_abstain")
    assert got["what is near the cup?"] == (reasoner.UNSURE, "rules_compiler")
    assert got["what is on the desk?"][0] == "Nothing in the scene matches that."


def test_items_are_not_shuffled_once_a_trial(spark):
    from tests.core.test_mask_words import executions

    from orrery.sources.tables import settled

    rows = settled(spark.createDataFrame([(0, k, float(k % 3), k % 4 != 0, k % 11 == 0) for k in range(100)], "scene_id long, id long, rank double, correct boolean, abstained boolean"), "items")
    got = []
    _, records = executions(spark, lambda: got.extend(evaluation.random_control(rows, ["scene_id"], 120, 5).collect()))
    assert len(got) == 1
    # 12,000 rows of items and trials
    assert records < 2000
