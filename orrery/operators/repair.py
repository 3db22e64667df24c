"""Repairing a selection of overlapping masks from scores, sizes and overlaps alone.

High-scoring masks are often several objects at once, and the masks of these objects
lose to them. Three rules: children replace the mask they make up; small masks
that others corroborate are carved out of the mask they lie in; and masks that keep too little of
themselves are put aside before a second resolution. Masks are tables (scene_id, p, v);
everything is joins on pairs that share vertices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.greedy import losers
from orrery.operators.masks import counted_words, overlaps, resolve, resolved, sizes
from orrery.sources.tables import apart, settled

#: Least score of the base, the priority of what is left out, and what lifts a mask above its parent.
BASE_SCORE, EXCLUDED, LIFT = 0.2, -1.0, 1e-6


@dataclass(frozen=True)
class Decomposition:
    """A child lies in its parent by ``contained`` and has at most ``size`` of it; kept children share at most ``shared`` of the smaller and cover ``cover``."""

    contained: float = 0.8
    size: float = 0.5
    shared: float = 0.2
    cover: float = 0.5


@dataclass(frozen=True)
class Carving:
    """Fixed values of the carve-out: largest share of the parent, least IoU and number of corroborators, least share kept."""

    size: float = 0.6
    iou: float = 0.7
    others: int = 1
    retained: float = 0.5


CARVE_WIDE, CARVE_NARROW = Carving(), Carving(size=0.25, others=2)


def directed(pairs: DataFrame) -> DataFrame:
    """``scene_id, parent, child, shared, parent_size, child_size, iou`` both ways for every pair that shares vertices."""
    way = lambda a, b: F.struct(F.col(a).alias("parent"), F.col(b).alias("child"), F.col(f"size_{a}").alias("parent_size"), F.col(f"size_{b}").alias("child_size"))
    return pairs.select("scene_id", "shared", "iou", F.explode(F.array(way("p", "q"), way("q", "p"))).alias("x")).select("scene_id", "x.*", "shared", "iou")


def _inside(contained: float, size: float) -> Column:
    return (F.col("shared") / F.col("child_size") >= contained) & (F.col("child_size") <= size * F.col("parent_size"))


def decomposed(pairs: DataFrame, proposals: DataFrame, rule: Decomposition = Decomposition(), least_size: int = 1) -> DataFrame:
    """``scene_id, parent, child, score, cover``: the kept children of every base mask that they make up.

    A parent's children are gone through from the largest (then lower id), and one
    is kept that shares little with those kept; two or more that cover enough of the parent replace it.
    """
    base = proposals.where(F.col("score") >= BASE_SCORE).select("scene_id", F.col("p").alias("parent"), "score")
    inside = directed(pairs).where(_inside(rule.contained, rule.size) & (F.col("child_size") >= least_size))
    children = settled(inside.join(apart(base), ["scene_id", "parent"]), "children")
    side = lambda name: children.select("scene_id", "parent", F.col("child").alias(name), F.col("child_size").alias(f"{name}_size"))
    # two children of a parent can only clash if they share vertices, so pairs come from the overlaps
    strong = pairs.where(F.col("shared") / F.least("size_p", "size_q") > rule.shared).select("scene_id", "p", "q")
    met = strong.join(apart(side("p")), ["scene_id", "p"]).join(apart(side("q")), ["scene_id", "q", "parent"])
    first = (F.col("p_size") > F.col("q_size")) | ((F.col("p_size") == F.col("q_size")) & (F.col("p") < F.col("q")))
    clash = met.select("scene_id", "parent", F.when(first, F.col("p")).otherwise(F.col("q")).alias("better"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("worse"))
    kept = children.join(losers(clash, ["scene_id", "parent"]).withColumnRenamed("node", "child"), ["scene_id", "parent", "child"], "left_anti")
    enough = kept.groupBy("scene_id", "parent").agg(F.count(F.lit(1)).alias("n"), F.sum("shared").alias("covered"), F.max("parent_size").alias("of"))
    enough = enough.where((F.col("n") >= 2) & (F.col("covered") >= rule.cover * F.col("of"))).select("scene_id", "parent", (F.col("covered") / F.col("of")).alias("cover"))
    return kept.join(enough, ["scene_id", "parent"]).select("scene_id", "parent", "child", "score", "cover")


def repair_v1(masks: DataFrame, proposals: DataFrame, rule: Decomposition = Decomposition()) -> DataFrame:
    """``scene_id, p, priority, suspect, admitted`` of every proposal (scene_id, p, score): children replace their parents.

    A suspect is excluded unless it is itself the child of another; an admitted child has the greater
    of its and its parent's score; other base masks keep theirs, all else is excluded. A proposal without vertices is excluded.
    """
    found = settled(decomposed(settled(overlaps(masks), "overlaps"), proposals, rule), "decomposed")
    suspect = found.select("scene_id", F.col("parent").alias("p")).distinct().withColumn("suspect", F.lit(True))
    own = proposals.select("scene_id", "p", "score")
    child = found.groupBy("scene_id", F.col("child").alias("p")).agg(F.max("score").alias("lifted"))
    every = own.join(apart(sizes(masks)), ["scene_id", "p"], "left").join(apart(suspect), ["scene_id", "p"], "left").join(apart(child), ["scene_id", "p"], "left")
    base = F.when((F.col("score") >= BASE_SCORE) & F.col("size").isNotNull() & F.col("suspect").isNull(), F.col("score")).otherwise(EXCLUDED)
    priority = F.greatest(base, F.when(F.col("lifted").isNotNull(), F.greatest("score", "lifted")))
    return every.select("scene_id", "p", priority.alias("priority"), F.coalesce("suspect", F.lit(False)).alias("suspect"), F.col("lifted").isNotNull().alias("admitted"))


def corroborated(pairs: DataFrame, least: float) -> DataFrame:
    """``scene_id, p, others``: how many other masks are nearly the same one."""
    same = pairs.where(F.col("iou") >= least).select("scene_id", F.explode(F.array("p", "q")).alias("p"))
    return same.groupBy("scene_id", "p").agg(F.count(F.lit(1)).alias("others"))


def promoted(pairs: DataFrame, proposals: DataFrame, rule: Carving, decompose: Decomposition | None = None, least_size: int = 20, contained: float = 0.8) -> DataFrame:
    """``scene_id, p, priority, mechanism`` of every proposal: base masks by score, lifted ones just above their best parent.

    A mask is carved out of a base mask that it lies in if enough others corroborate it. With ``decompose``,
    children that make up a parent are lifted too. mechanism is null where nothing lifts it.
    """
    base = proposals.where(F.col("score") >= BASE_SCORE).select("scene_id", F.col("p").alias("parent"), "score")
    known = corroborated(pairs, rule.iou).where(F.col("others") >= rule.others).select("scene_id", F.col("p").alias("child"))
    carved = directed(pairs).where(_inside(contained, rule.size) & (F.col("child_size") >= least_size)).join(apart(known), ["scene_id", "child"], "left_semi").join(apart(base), ["scene_id", "parent"])
    lifted = carved.select("scene_id", F.col("child").alias("p"), (F.col("score") + LIFT).alias("lift"), F.lit("carveout").alias("mechanism"))
    if decompose is not None:
        split = decomposed(pairs, proposals, decompose, least_size)
        lifted = lifted.unionByName(split.select("scene_id", F.col("child").alias("p"), (F.col("score") + LIFT).alias("lift"), F.lit("decomposition").alias("mechanism")))
    # of equal lifts decomposition counts, as it is judged first
    best = lifted.groupBy("scene_id", "p").agg(F.max(F.struct("lift", "mechanism")).alias("best")).select("scene_id", "p", "best.*")
    own = F.when(F.col("score") >= BASE_SCORE, F.col("score")).otherwise(EXCLUDED)
    every = proposals.select("scene_id", "p", "score").join(apart(best), ["scene_id", "p"], "left").withColumn("own", own)
    higher = F.coalesce(F.col("lift") > F.col("own"), F.lit(False))
    return every.select("scene_id", "p", F.when(higher, F.col("lift")).otherwise(F.col("own")).alias("priority"), F.when(higher, F.col("mechanism")).alias("mechanism"))


def retained(masks: DataFrame, priorities: DataFrame, least: float, least_size: int = 20) -> DataFrame:
    """``scene_id, v, p``: resolve by priority, put aside masks that keep under ``least`` of their vertices, and resolve again."""
    ranked = settled(priorities.where(F.col("priority") >= 0).select("scene_id", "p", F.col("priority").alias("score")), "priorities")
    first = resolved(masks, ranked, 0.0, least_size).groupBy("scene_id", "p").agg(F.max("size").alias("won"))
    share = ranked.join(apart(sizes(masks)), ["scene_id", "p"]).join(apart(first), ["scene_id", "p"], "left")
    stays = share.where(F.coalesce("won", F.lit(0)) / F.col("size") >= least).select("scene_id", "p", "score")
    return resolve(masks, stays, 0.0, least_size)


def repair_v2(masks: DataFrame, proposals: DataFrame, rule: Carving = CARVE_WIDE, least_size: int = 20) -> DataFrame:
    """``scene_id, v, p``: the assignment after carving out corroborated masks and the test of what is retained."""
    pairs = settled(overlaps(masks), "overlaps")
    return retained(masks, promoted(pairs, proposals, rule, None, least_size), rule.retained, least_size)


def repair_v3(masks: DataFrame, proposals: DataFrame, rule: Carving = CARVE_NARROW, least_size: int = 20) -> DataFrame:
    """``scene_id, v, p``: decomposition, a narrower carve-out, and the test of what is retained."""
    pairs = settled(overlaps(masks), "overlaps")
    return retained(masks, promoted(pairs, proposals, rule, Decomposition(), least_size), rule.retained, least_size)


def raw_boxes(masks: DataFrame, vertices: DataFrame) -> DataFrame:
    """``scene_id, p, n`` and the box and centroid of each mask's own vertices, before any composition."""
    ends = [f(k).alias(f"{k}{n}") for n, f in ((0, F.min), (1, F.max)) for k in "xyz"]
    # masks meet the vertices as words, so that a vertex is shuffled once and not for each mask
    held = counted_words(masks, ["p"]).join(apart(vertices.withColumn("word", F.expr("shiftright(v, 6)"))), ["scene_id", "word"]).where("getbit(bits, cast(v & 63 as int)) = 1")
    boxes = held.groupBy("scene_id", "p").agg(F.sum("times").alias("n"), *ends)
    return boxes.withColumns({f"c{k}": (F.col(f"{k}0") + F.col(f"{k}1")) / 2 for k in "xyz"})


def expanded(assignment: DataFrame, masks: DataFrame, selected: DataFrame, protected: DataFrame, least_size: int = 20) -> DataFrame:
    """``scene_id, v, p``: ``selected`` masks (scene_id, p, score) claim their vertices from a hard assignment.

    Vertices of ``protected`` instances (scene_id, p) are locked; of two selected masks the one of
    greater score (then lower id) has a vertex; instances left with under ``least_size`` vertices go.
    """
    locked = assignment.join(apart(protected.select("scene_id", "p").distinct()), ["scene_id", "p"], "left_semi").select("scene_id", "v")
    free = masks.join(apart(selected.select("scene_id", "p", "score")), ["scene_id", "p"]).join(apart(locked), ["scene_id", "v"], "left_anti")
    claims = free.groupBy("scene_id", "v").agg(F.min(F.struct((-F.col("score")).alias("s"), "p")).alias("best")).select("scene_id", "v", F.col("best.p").alias("p"))
    whole = claims.unionByName(assignment.select("scene_id", "v", "p").join(apart(claims), ["scene_id", "v"], "left_anti"))
    large = sizes(whole).where(F.col("size") >= least_size)
    return whole.join(apart(large), ["scene_id", "p"], "left_semi").select("scene_id", "v", "p")
