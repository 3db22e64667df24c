"""Masks meet as words: nothing exploded is broadcast, no row for each vertex is shuffled, and repeats count as in SQL."""

from __future__ import annotations

import pytest
from tests.conftest import SMALL

from __spark_entry__ import queries
from orrery.operators import masks
from orrery.sources.tables import settled

MASK = "scene_id long, p long, v long"


def executions(spark, run, planned=False):
    """What ``run`` executed: the plans' texts and the records that their shuffles wrote; only ``planned`` joins may broadcast."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    seen = store.executionsCount()
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if planned else "-1")
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    bus.waitUntilEmpty()
    listed = store.executionsList()
    plans, records = [], 0
    for k in range(seen, listed.size()):
        plans.append(listed.apply(k).physicalPlanDescription())
        nodes, values = store.planGraph(listed.apply(k).executionId()).allNodes(), store.executionMetrics(listed.apply(k).executionId())
        for n in range(nodes.size()):
            metrics = nodes.apply(n).metrics()
            for i in range(metrics.size()):
                value = values.get(metrics.apply(i).accumulatorId())
                if metrics.apply(i).name() == "shuffle records written" and value.isDefined():
                    records += int(value.get().replace(",", ""))
    return plans, records


def broadcast_explosions(plan: str) -> int:
    """Broadcasts with an explosion below them."""
    found, lines = 0, plan.split("\n\n")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[at + 1 :]:
                if depth(below) <= depth(line):
                    break
                found += "Generate" in below
    return found


@pytest.mark.parametrize("name", ["mask_iou", "ar_at_k", "bank_dedupe", "components", "edge_confidence", "fused_bank", "iou_match", "failure_classes", "exact_recall", "lifted_masks", "oracle_coverage", "over_segmentation", "overlap_matches", "expanded_answers"])
def test_exploded_rows_are_not_broadcast(spark, name):
    plans, _ = executions(spark, lambda: queries()[name](spark, SMALL).collect(), planned=True)
    assert plans and sum(map(broadcast_explosions, plans)) == 0


def test_overlaps_shuffle_words(spark):
    rows = settled(spark.createDataFrame([(0, p, v) for p in range(20) for v in range(p, p + 1000)], MASK), "masks")
    got = []
    _, records = executions(spark, lambda: got.extend(masks.overlaps(rows).collect()))
    assert {(r["p"], r["q"]): r["shared"] for r in got} == {(p, q): 1000 - (q - p) for p in range(20) for q in range(p + 1, 20)}
    # 20,000 rows of vertices, 330 words or so
    assert records < 5000


def test_agreement_shuffles_words(spark):
    rows = settled(spark.createDataFrame([(0, p, v) for p in range(20) for v in range(p, p + 1000)], MASK), "masks")
    sight = settled(spark.createDataFrame([(0, view, v) for view in range(2) for v in range(600)], "scene_id long, view long, v long"), "visible")
    views = settled(spark.createDataFrame([(0, m % 2, m, v) for m in range(20) for v in range(m, m + 500)], "scene_id long, view long, mask long, v long"), "views")
    got = []
    _, records = executions(spark, lambda: got.extend(masks.agreement(rows, sight, views).collect()))
    best = lambda p, view: max(len(set(range(p, 600)) & set(range(m, m + 500))) / len(set(range(p, 600)) | set(range(m, m + 500))) for m in range(view, 20, 2))
    assert {r["p"]: r["agreement"] for r in got} == {p: pytest.approx((best(p, 0) + best(p, 1)) / 2) for p in range(20)}
    assert records < 15_000


def test_repeated_rows_count_as_often_as_they_are_there(spark):
    rows = spark.createDataFrame([(0, 1, v) for v in (-70, 5, 5, 5, 64)] + [(0, 2, v) for v in (-70, 5, 5, 200)], MASK)
    got = masks.overlaps(rows).first()
    # 5 is there three times and twice
    assert (got["shared"], got["size_p"], got["size_q"]) == (7, 5, 4)
    props = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9)], "scene_id long, p long, score double")
    assert sorted((r["v"], r["p"]) for r in masks.resolve(rows, props, 0.2, 1).collect()) == [(-70, 2), (5, 2), (64, 1), (200, 2)]
