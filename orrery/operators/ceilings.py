"""What the best choice of masks could reach, with the truth known: unions of masks, and one mask for each object."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.masks import overlaps, sizes
from orrery.sources.tables import settled

#: Masks considered for an object, steps of a union, and the least IoU of a nomination.
CANDIDATES, STEPS, VIABLE = 64, 8, 0.5


def union_curve(masks: DataFrame, truths: DataFrame, steps: int = STEPS, candidates: int = CANDIDATES) -> DataFrame:
    """``scene_id, q, step, p, iou, met, capped``: the greedy union of masks for each object (scene_id, p as q, v).

    Every step adds the mask that raises the union's IoU most (then the lower id) and stops where
    none does; an object that no mask meets has no row. Masks beyond the ``candidates`` of largest
    overlap (then lower id) do not take part: met says how many there are and capped whether that bound.
    What is left of a mask outside the union is kept up by anti-joins, so a step reads only what is still new.
    """
    met = overlaps(masks, truths).select("scene_id", "p", "q", "shared", "size_q")
    order = Window.partitionBy("scene_id", "q").orderBy(F.desc("shared"), "p")
    ranked = met.withColumn("n", F.row_number().over(order)).withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("scene_id", "q")))
    chosen = settled(ranked.where(F.col("n") <= candidates).select("scene_id", "q", "p", "size_q", "met"), "candidates")
    inside = truths.select("scene_id", F.col("p").alias("q"), "v", F.lit(1).alias("inside"))
    fresh = chosen.join(masks.select("scene_id", "p", "v"), ["scene_id", "p"]).join(inside, ["scene_id", "q", "v"], "left").select("scene_id", "q", "p", "v", "size_q", "met", F.coalesce("inside", F.lit(0)).alias("inside"))
    fresh = settled(fresh, "union-vertices")
    state = chosen.select("scene_id", "q").distinct().select("scene_id", "q", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("was"))
    out = None
    for step in range(1, steps + 1):
        gain = fresh.groupBy("scene_id", "q", "p").agg(F.sum("inside").alias("more"), F.count(F.lit(1)).alias("all"), F.first("size_q").alias("size_q"), F.first("met").alias("met"))
        tried = gain.join(state, ["scene_id", "q"]).withColumns({"shared": F.col("shared") + F.col("more"), "size": F.col("size") + F.col("all")})
        tried = tried.withColumn("iou", F.col("shared") / (F.col("size") + F.col("size_q") - F.col("shared"))).where(F.col("iou") > F.col("was"))
        best = tried.groupBy("scene_id", "q").agg(F.min(F.struct((-F.col("iou")).alias("i"), "p", "shared", "size", "met")).alias("b"))
        found = settled(best.select("scene_id", "q", F.lit(step).alias("step"), "b.p", (-F.col("b.i")).alias("iou"), "b.shared", "b.size", "b.met"), "union-step")
        if found.isEmpty():
            break
        rows = found.select("scene_id", "q", "step", "p", "iou", "met", (F.col("met") > candidates).alias("capped"))
        out = rows if out is None else out.unionByName(rows)
        state = found.select("scene_id", "q", "shared", "size", F.col("iou").alias("was"))
        held = fresh.join(found.select("scene_id", "q", "p"), ["scene_id", "q", "p"], "left_semi").select("scene_id", "q", "v")
        going = fresh.join(state.select("scene_id", "q"), ["scene_id", "q"], "left_semi")
        fresh = settled(going.join(held, ["scene_id", "q", "v"], "left_anti"), "union-vertices")
    empty = "scene_id long, q long, step int, p long, iou double, met long, capped boolean"
    return masks.sparkSession.createDataFrame([], empty) if out is None else out


def nominated(masks: DataFrame, truths: DataFrame, least: float = VIABLE, rounds: int = 1000) -> DataFrame:
    """``scene_id, q, p, iou, rank``: one viable mask for each object, none twice.

    Objects choose in the order of their best IoU (then lower id); each takes the best mask (then the
    higher id) that none before it took, and rank counts those it had to pass over. All masks
    prefer objects in one order, so choosing in turn equals letting every object ask for its best mask
    and every mask refuse all but the first in order, until nothing is refused: rounds, and no loop over a scene.
    """
    able = overlaps(masks, truths).where(F.col("iou") >= least).select("scene_id", "q", "p", "iou")
    own = Window.partitionBy("scene_id", "q").orderBy(F.desc("iou"), F.desc("p"))
    ranked = able.withColumn("rank", F.row_number().over(own) - 1).withColumn("best", F.max("iou").over(Window.partitionBy("scene_id", "q")))
    options = settled(ranked, "nominations")
    for _ in range(rounds):
        asked = options.groupBy("scene_id", "q").agg(F.min(F.struct("rank", "p", "iou", "best")).alias("o")).select("scene_id", "q", "o.*")
        first = asked.groupBy("scene_id", "p").agg(F.min(F.struct((-F.col("best")).alias("b"), "q")).alias("h")).select("scene_id", "p", F.col("h.q").alias("holder"))
        known = settled(asked.join(first, ["scene_id", "p"]), "asked")
        refused = known.where("q <> holder").select("scene_id", "q", "p")
        if refused.isEmpty():
            return known.select("scene_id", "q", "p", "iou", "rank")
        options = settled(options.join(refused, ["scene_id", "q", "p"], "left_anti"), "nominations")
    raise RuntimeError("nominations did not settle")


def recall(curve: DataFrame, truths: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.75)) -> DataFrame:
    """``scene_id, field, threshold, recall``: share of objects whose best single mask, union of two, three or any reaches a threshold."""
    total = sizes(truths).groupBy("scene_id").agg(F.count(F.lit(1)).alias("total"))
    best = curve.groupBy("scene_id", "q").agg(*[F.max(F.when(F.col("step") <= most, F.col("iou"))).alias(name) for name, most in (("single", 1), ("union2", 2), ("union3", 3), ("union_any", 10**6))])
    fields = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.round(F.col(name), 4).alias("iou")) for name in ("single", "union2", "union3", "union_any")]))
    told = best.select("scene_id", "q", fields.alias("f")).select("scene_id", "f.*").select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hits = told.groupBy("scene_id", "field", "threshold").agg(F.count_if(F.col("iou") >= F.col("threshold")).alias("n"))
    return hits.join(total, "scene_id").select("scene_id", "field", "threshold", F.round(F.col("n") / F.col("total"), 4).alias("recall"))
