"""Masks of several views that show one surface: linked, voted on by vertex, and set beside a bank.

Lifted masks are tables (scene_id, mask, view, v) with a number ``mask`` that is unique in a
scene. Masks of one view are never linked, however much they overlap: they are hypotheses of different scale.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.components import components
from orrery.operators.greedy import losers
from orrery.operators.masks import overlaps, sizes
from orrery.sources.tables import settled


@dataclass(frozen=True)
class Linkage:
    """Anchors are every ``stride``-th vertex; masks link by IoU, or by containment where their sizes are alike."""

    stride: int = 16
    iou: float = 0.30
    contained: float = 0.80
    ratio: float = 0.50


@dataclass(frozen=True)
class Voting:
    """Least views and angle between them, share of votes, IoU of a member, and vertices of a proposal."""

    views: int = 2
    degrees: float = 8.0
    share: float = 0.50
    member_iou: float = 0.20
    least: int = 200
    most_share: float = 0.15


@dataclass(frozen=True)
class Novelty:
    """How a proposal relates to a bank; a piece of a parent has at most ``size`` of it; at most ``most`` proposals a scene."""

    duplicate: float = 0.90
    additional: float = 0.50
    split: float = 0.70
    size: float = 0.70
    least: int = 200
    most: int = 60


def associated(lifted: DataFrame, rule: Linkage = Linkage()) -> DataFrame:
    """``scene_id, mask, view, cluster`` of every mask: single linkage across views; cluster is its least mask."""
    own = lifted.select("scene_id", "mask", "view").distinct()
    anchors = lifted.where(F.col("v") % rule.stride == 0).select("scene_id", F.col("mask").alias("p"), "v")
    view = lambda name: own.select("scene_id", F.col("mask").alias(name), F.col("view").alias(f"view_{name}"))
    pairs = overlaps(anchors).join(view("p"), ["scene_id", "p"]).join(view("q"), ["scene_id", "q"])
    alike = F.least("size_p", "size_q") / F.greatest("size_p", "size_q") >= rule.ratio
    links = pairs.where("view_p <> view_q").where((F.col("iou") >= rule.iou) | ((F.col("contained") >= rule.contained) & alike))
    found = components(links, ["scene_id"], "p", "q").select("scene_id", F.col("node").alias("mask"), F.col("root").alias("cluster"))
    return own.join(found, ["scene_id", "mask"], "left").withColumn("cluster", F.coalesce("cluster", "mask"))


def _spread(members: DataFrame, directions: DataFrame) -> DataFrame:
    """``scene_id, cluster, views, degrees``: how many views a cluster has, and the widest angle between two of them."""
    views = members.select("scene_id", "cluster", "view").distinct().join(directions, ["scene_id", "view"])
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    unit = views.select("scene_id", "cluster", "view", *[(F.col(k) / size).alias(k) for k in ("dx", "dy", "dz")])
    other = unit.select("scene_id", "cluster", *[F.col(k).alias(f"o{k}") for k in ("view", "dx", "dy", "dz")])
    dot = F.col("dx") * F.col("odx") + F.col("dy") * F.col("ody") + F.col("dz") * F.col("odz")
    widest = F.degrees(F.acos(F.greatest(F.least(F.min(dot), F.lit(1.0)), F.lit(-1.0))))
    pairs = unit.join(other, ["scene_id", "cluster"])
    return pairs.groupBy("scene_id", "cluster").agg(F.count_distinct("view").alias("views"), F.when(F.count_distinct("view") > 1, widest).otherwise(0.0).alias("degrees"))


def _vote(members: DataFrame, lifted: DataFrame, visible: DataFrame, share: float) -> DataFrame:
    """``scene_id, cluster, v``: vertices in at least ``share`` of the cluster's views that see them; a vertex hidden from all of them counts one."""
    held = members.select("scene_id", "cluster", "mask").join(lifted, ["scene_id", "mask"]).groupBy("scene_id", "cluster", "v").agg(F.count(F.lit(1)).alias("held"))
    seen = members.select("scene_id", "cluster", "view").distinct().join(visible.select("scene_id", "view", "v").distinct(), ["scene_id", "view"])
    could = seen.join(held.select("scene_id", "cluster", "v"), ["scene_id", "cluster", "v"], "left_semi").groupBy("scene_id", "cluster", "v").agg(F.count(F.lit(1)).alias("could"))
    voted = held.join(could, ["scene_id", "cluster", "v"], "left")
    return voted.where(F.col("held") / F.greatest(F.coalesce("could", F.lit(0)), F.lit(1)) >= share).select("scene_id", "cluster", "v")


def fused(clusters: DataFrame, lifted: DataFrame, visible: DataFrame, directions: DataFrame, quality: DataFrame, vertices: DataFrame, rule: Voting = Voting()) -> tuple[DataFrame, DataFrame]:
    """Proposals (scene_id, cluster, members, views, degrees, confidence, size) of supported clusters, and their vertices.

    Vertices are voted on, members that disagree with the outcome leave, and if any left the rest vote again. quality:
    scene_id, mask, predicted. vertices: scene_id, n. confidence is the mean of what was predicted of the members that stay.
    """
    lifted, visible = settled(lifted.select("scene_id", "mask", "v").distinct(), "lifted"), settled(visible, "visible")
    wide = (F.col("views") >= rule.views) & (F.col("degrees") >= rule.degrees)
    able = _spread(clusters, directions).where(wide).select("scene_id", "cluster")
    members = settled(clusters.join(able, ["scene_id", "cluster"], "left_semi"), "members")
    first = settled(_vote(members, lifted, visible, rule.share), "votes")
    count = lambda held: held.groupBy("scene_id", "cluster").agg(F.count(F.lit(1)).alias("size"))
    large = count(first).where(F.col("size") >= rule.least)
    shared = members.join(lifted, ["scene_id", "mask"]).join(first, ["scene_id", "cluster", "v"]).groupBy("scene_id", "cluster", "mask", "view").agg(F.count(F.lit(1)).alias("shared"))
    own = lifted.groupBy("scene_id", "mask").agg(F.count(F.lit(1)).alias("own"))
    agreeing = shared.join(own, ["scene_id", "mask"]).join(large, ["scene_id", "cluster"]).where(F.col("shared") / (F.col("own") + F.col("size") - F.col("shared")) >= rule.member_iou)
    kept = settled(agreeing.select("scene_id", "cluster", "mask", "view"), "members-kept")
    before = members.groupBy("scene_id", "cluster").agg(F.count(F.lit(1)).alias("before"))
    after = kept.groupBy("scene_id", "cluster").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("view").alias("left")).where(F.col("left") >= rule.views)
    state = settled(after.join(before, ["scene_id", "cluster"]), "clusters-kept")
    torn = state.where("members < before").select("scene_id", "cluster")
    second = _vote(kept.join(torn, ["scene_id", "cluster"], "left_semi"), lifted, visible, rule.share)
    whole = first.join(state.where("members = before").select("scene_id", "cluster"), ["scene_id", "cluster"], "left_semi").unionByName(second)
    spread = _spread(kept, directions).where(wide)
    predicted = kept.join(quality, ["scene_id", "mask"]).groupBy("scene_id", "cluster").agg(F.avg("predicted").alias("confidence"))
    bounded = count(whole).join(vertices, "scene_id").where((F.col("size") >= rule.least) & (F.col("size") <= rule.most_share * F.col("n"))).select("scene_id", "cluster", "size")
    table = settled(bounded.join(state.select("scene_id", "cluster", "members"), ["scene_id", "cluster"]).join(spread, ["scene_id", "cluster"]).join(predicted, ["scene_id", "cluster"]), "fused")
    return table.select("scene_id", "cluster", "members", "views", "degrees", "confidence", "size"), settled(whole.join(table, ["scene_id", "cluster"], "left_semi"), "fused-vertices")


def classified(found: DataFrame, held: DataFrame, baseline: DataFrame, rule: Novelty = Novelty()) -> DataFrame:
    """``scene_id, cluster, kind, parent, containment, iou, size, emitted`` of every fused proposal beside a bank (scene_id, p, v).

    kind is additional, split, duplicate_of_baseline, ambiguous_containment, split_piece_too_small or duplicate_repair. A
    split is clipped to its parent: the baseline mask with most of it (then the lower id). Candidates are emitted by
    confidence, size and first vertex, without those nearly equal to an emitted one, and at most ``rule.most`` a scene.
    """
    baseline = settled(baseline.select("scene_id", "p", "v"), "baseline")
    pairs = settled(overlaps(held.select("scene_id", F.col("cluster").alias("p"), "v"), baseline), "beside-baseline").withColumnRenamed("p", "cluster")
    best = pairs.groupBy("scene_id", "cluster").agg(F.min(F.struct((-F.col("shared")).alias("s"), "q")).alias("b"), F.max("iou").alias("iou"))
    parent = sizes(baseline).select("scene_id", F.col("p").alias("parent"), F.col("size").alias("parent_size"))
    every = found.select("scene_id", "cluster", "confidence", "size").join(best.select("scene_id", "cluster", "iou", F.col("b.q").alias("parent"), (-F.col("b.s")).alias("shared")), ["scene_id", "cluster"], "left").join(parent, ["scene_id", "parent"], "left")
    every = every.withColumns({"iou": F.coalesce("iou", F.lit(0.0)), "containment": F.coalesce(F.col("shared") / F.col("size"), F.lit(0.0))})
    kind = (
        F.when(F.col("iou") >= rule.duplicate, "duplicate_of_baseline")
        .when(F.col("containment") < rule.additional, "additional")
        .when((F.col("containment") < rule.split) | (F.col("size") > rule.size * F.col("parent_size")), "ambiguous_containment")
        .when(F.col("shared") < rule.least, "split_piece_too_small")
        .otherwise("split")
    )
    judged = settled(every.withColumn("kind", kind), "kinds")
    able = judged.where("kind in ('additional', 'split')")
    clipped = baseline.select("scene_id", F.col("p").alias("parent"), "v")
    split = able.where("kind = 'split'").select("scene_id", "cluster", "parent").join(held, ["scene_id", "cluster"]).join(clipped, ["scene_id", "parent", "v"], "left_semi").select("scene_id", "cluster", "v")
    whole = able.where("kind = 'additional'").select("scene_id", "cluster").join(held, ["scene_id", "cluster"])
    pieces = settled(whole.unionByName(split), "pieces")
    first = pieces.groupBy("scene_id", "cluster").agg(F.count(F.lit(1)).alias("piece"), F.min("v").alias("start"))
    order = Window.partitionBy("scene_id").orderBy(F.desc("confidence"), F.desc("piece"), "start", "cluster")
    ranked = settled(able.join(first, ["scene_id", "cluster"]).withColumn("place", F.row_number().over(order)), "ranked")
    place = lambda name: ranked.select("scene_id", F.col("cluster").alias(name), F.col("place").alias(f"at_{name}"))
    near = overlaps(pieces.withColumnRenamed("cluster", "p")).where(F.col("iou") >= rule.duplicate).join(place("p"), ["scene_id", "p"]).join(place("q"), ["scene_id", "q"])
    ahead = F.col("at_p") < F.col("at_q")
    clash = near.select("scene_id", F.when(ahead, F.col("at_p")).otherwise(F.col("at_q")).alias("better"), F.when(ahead, F.col("at_q")).otherwise(F.col("at_p")).alias("worse"))
    gone = losers(clash, ["scene_id"]).select("scene_id", F.col("node").alias("place"), F.lit(True).alias("repeated"))
    left = ranked.join(gone, ["scene_id", "place"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    nth = F.sum(F.when(F.col("repeated"), 0).otherwise(1)).over(Window.partitionBy("scene_id").orderBy("place"))
    last = left.withColumn("nth", nth).select("scene_id", "cluster", "piece", "repeated", (~F.col("repeated") & (F.col("nth") <= rule.most)).alias("emitted"))
    told = judged.join(last, ["scene_id", "cluster"], "left")
    return told.select(
        "scene_id", "cluster", F.when(F.col("repeated"), "duplicate_repair").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "split", F.col("parent")).alias("parent"),
        "containment", "iou", F.coalesce("piece", "size").alias("size"), F.coalesce("emitted", F.lit(False)).alias("emitted"),
    )
