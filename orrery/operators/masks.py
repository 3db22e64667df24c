"""Overlapping mask proposals as vertex sets: long tables ``(scene_id, p, v)``.

Resolve, compare, rank, deduplicate and evaluate. Masks meet as words, 64 vertices to a
row, so neither rows for each vertex nor pairs for each shared vertex are shuffled; a greedy
choice runs per scene over the pairs that overlap, not over vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.digests import ids_sha256
from orrery.operators.components import components
from orrery.sources.tables import apart, settled, tasks

_WORD, _BIT = "shiftright(v, 6)", "shiftleft(1L, cast(v & 63 as int))"


def words(table: DataFrame, by: list[str]) -> DataFrame:
    """``scene_id, *by, word, bits, n``: the vertices of each set, 64 to a row, as bits; n counts its rows, repeats included."""
    keys = table.select("scene_id", *by, F.expr(_WORD).alias("word"), F.expr(_BIT).alias("bit"))
    return keys.groupBy("scene_id", *by, "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))


def vertices(held: DataFrame) -> DataFrame:
    """``held`` (with word and bits) as rows, one for each vertex ``v``."""
    own = [c for c in held.columns if c not in ("word", "bits")]
    every = held.select(*own, "word", "bits", F.explode(F.array(*map(F.lit, range(64)))).alias("bit"))
    return every.where("getbit(bits, bit) = 1").select(*own, F.expr("word * 64 + bit").alias("v"))


def counted_words(table: DataFrame, by: list[str]) -> DataFrame:
    """``scene_id, *by, word, bits, times, size``, settled: as ``words``, with the size of the set; a vertex that is there several times is in a row of so many ``times``."""
    size = F.sum("n").over(Window.partitionBy("scene_id", *by)).alias("size")
    found = settled(words(table, by).select("*", size), "words")
    repeats = F.col("n") > F.bit_count("bits")
    plain = found.where(~repeats).select("scene_id", *by, "word", "bits", F.lit(1).cast("long").alias("times"), "size")
    if found.where(repeats).isEmpty():
        return plain
    some = found.where(repeats).select("scene_id", *by, "word", "size")
    rows = table.select("scene_id", *by, F.expr(_WORD).alias("word"), F.expr(_BIT).alias("bit")).join(apart(some), ["scene_id", *by, "word"])
    each = rows.groupBy("scene_id", *by, "word", "size", "bit").agg(F.count(F.lit(1)).alias("times"))
    return plain.unionByName(each.groupBy("scene_id", *by, "word", "times", "size").agg(F.bit_or("bit").alias("bits")))


def resolved(masks: DataFrame, proposals: DataFrame, least_score: float = 0.2, least_size: int = 20) -> DataFrame:
    """``scene_id, p, word, bits, size``: as ``resolve``, in words, with the size of each instance."""
    scored = words(masks, ["p"]).join(apart(proposals.where(F.col("score") >= least_score).select("scene_id", "p", "score")), ["scene_id", "p"])
    better = Window.partitionBy("scene_id", "word").orderBy((-F.col("score")).asc(), "p").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.bit_or("bits").over(better), F.lit(0).cast("long"))
    won = scored.select("scene_id", "p", "word", F.col("bits").bitwiseAND(F.bitwise_not(taken)).alias("bits")).where("bits <> 0")
    size = F.sum(F.bit_count("bits")).over(Window.partitionBy("scene_id", "p")).alias("size")
    return won.select("*", size).where(F.col("size") >= least_size)


def resolve(masks: DataFrame, proposals: DataFrame, least_score: float = 0.2, least_size: int = 20) -> DataFrame:
    """``scene_id, v, p``: each vertex goes to its best proposal (score, then lower p); small winners vanish.

    Vertices of a dropped instance are not given to the next proposal. Proposals go through
    each word from best to worst, and one wins what none before it has.
    """
    return vertices(resolved(masks, proposals, least_score, least_size)).select("scene_id", "v", "p")


def sizes(masks: DataFrame) -> DataFrame:
    return masks.groupBy("scene_id", "p").agg(F.count(F.lit(1)).alias("size"))


def overlaps(masks: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """``scene_id, p, q, shared, size_p, size_q, iou, contained``: pairs that share vertices (p < q within one table)."""
    left = counted_words(masks, ["p"])
    right = (left if other is None else counted_words(other, ["p"])).select("scene_id", F.col("p").alias("q"), "word", F.col("bits").alias("bits_q"), F.col("times").alias("times_q"), F.col("size").alias("size_q"))
    pairs = left.withColumnRenamed("size", "size_p").join(apart(right), ["scene_id", "word"]).where("bits & bits_q <> 0")
    if other is None:
        pairs = pairs.where("p < q")
    shared = F.sum(F.expr("bit_count(bits & bits_q) * times * times_q")).alias("shared")
    known = pairs.groupBy("scene_id", "p", "q").agg(shared, F.max("size_p").alias("size_p"), F.max("size_q").alias("size_q"))
    iou = F.col("shared") / (F.col("size_p") + F.col("size_q") - F.col("shared"))
    return known.withColumn("iou", iou).withColumn("contained", F.col("shared") / F.least("size_p", "size_q"))


def agreement(masks: DataFrame, visible: DataFrame, views: DataFrame, least_seen: float = 0.5, top: int = 3) -> DataFrame:
    """``scene_id, p, agreement, support``: how well views' masks match a proposal where they see it.

    A view observes a proposal if it sees ``least_seen`` of its vertices; its best IoU
    is over the part it sees; agreement is the mean of the ``top`` best observing
    views, support the share of observing views with an IoU of a half.
    """
    own = counted_words(masks, ["p"])
    sight = counted_words(visible, ["view"]).select("scene_id", "view", "word", F.col("bits").alias("bits_s"), F.col("times").alias("times_s"))
    seen = own.join(apart(sight), ["scene_id", "word"]).where("bits & bits_s <> 0")
    part = seen.groupBy("scene_id", "p", "view").agg(F.sum(F.expr("bit_count(bits & bits_s) * times * times_s")).alias("seen"), F.max("size").alias("size"))
    part = part.where(F.col("seen") >= least_seen * F.col("size")).select("scene_id", "p", "view", "seen")
    held = counted_words(views, ["view", "mask"]).withColumnsRenamed({"bits": "bits_m", "times": "times_m", "size": "mask_size"})
    # what a view's mask has of what the view sees, before it meets the proposals
    held = held.join(apart(sight), ["scene_id", "view", "word"]).select("scene_id", "word", "view", "mask", "mask_size", F.expr("bits_m & bits_s").alias("bits_m"), F.expr("times_m * times_s").alias("times_m")).where("bits_m <> 0")
    met = own.select("scene_id", "p", "word", "bits", "times").join(apart(held), ["scene_id", "word"]).where("bits & bits_m <> 0")
    # dealt by proposal and view, so that one shuffle serves for the counts and the best of them
    counts = met.select("scene_id", "p", "view", "mask", "mask_size", F.expr("bit_count(bits & bits_m) * times * times_m").alias("shared")).repartition(tasks(masks.sparkSession), "scene_id", "p", "view")
    counts = counts.groupBy("scene_id", "p", "view", "mask").agg(F.sum("shared").alias("shared"), F.max("mask_size").alias("mask_size"))
    best = counts.join(apart(part), ["scene_id", "p", "view"]).groupBy("scene_id", "p", "view").agg(F.max(F.col("shared") / (F.col("seen") + F.col("mask_size") - F.col("shared"))).alias("iou"))
    every = part.join(apart(best), ["scene_id", "p", "view"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))
    order = Window.partitionBy("scene_id", "p").orderBy(F.desc("iou"), "view")
    ranked = every.withColumn("n", F.row_number().over(order))
    return ranked.groupBy("scene_id", "p").agg(F.avg(F.when(F.col("n") <= top, F.col("iou"))).alias("agreement"), F.avg((F.col("iou") >= 0.5).cast("double")).alias("support"))


def nesting(pairs: DataFrame, signal: DataFrame, containment: float = 0.8) -> DataFrame:
    """``scene_id, p, nested``: how many better proposals contain it or lie in it."""
    shared = pairs.where(F.col("contained") >= containment).select("scene_id", F.explode(F.array(F.struct(F.col("p").alias("p"), F.col("q").alias("o")), F.struct(F.col("q").alias("p"), F.col("p").alias("o")))).alias("x")).select("scene_id", "x.p", "x.o")
    a = shared.join(apart(signal.select("scene_id", "p", F.col("agreement").alias("own"))), ["scene_id", "p"]).join(apart(signal.select("scene_id", F.col("p").alias("o"), F.col("agreement").alias("theirs"))), ["scene_id", "o"])
    better = (F.col("theirs") > F.col("own")) | ((F.col("theirs") == F.col("own")) & (F.col("o") < F.col("p")))
    return a.where(better).groupBy("scene_id", "p").agg(F.count(F.lit(1)).alias("nested"))


def size_prior(extent, low: float = 0.03, full: float = 0.10, most: float = 2.0, gone: float = 2.6):
    """A trapezoid over an extent in metres."""
    return F.when((extent <= low) | (extent >= gone), 0.0).when(extent < full, (extent - low) / (full - low)).when(extent > most, (gone - extent) / (gone - most)).otherwise(1.0)


def gate(x):
    return F.lit(0.3) + 0.7 * x


def edge_confidence(edges: DataFrame, visible: DataFrame, views: DataFrame) -> DataFrame:
    """``scene_id, a, b, confidence``: of the views that see shared ends, the share in which a mask holds shared.

    What sees and holds a vertex is gathered at the vertex, so that an edge is one row where its ends meet. Ids are numbers.
    """
    seen = visible.select("scene_id", "v", F.col("view").cast("string").alias("seen"), F.lit(None).cast("string").alias("held"))
    held = views.where("view is not null and mask is not null").select("scene_id", "v", F.lit(None).cast("string").alias("seen"), F.concat_ws(" ", F.col("view").cast("string"), F.col("mask").cast("string")).alias("held"))
    # sets leave nulls out
    ends = seen.unionByName(held).groupBy("scene_id", "v").agg(F.collect_set("seen").alias("seen"), F.collect_set("held").alias("held"))
    end = lambda k: apart(ends.select("scene_id", F.col("v").alias(k), F.col("seen").alias(f"seen_{k}"), F.col("held").alias(f"held_{k}")))
    both = edges.select("scene_id", "a", "b").distinct().join(end("a"), ["scene_id", "a"]).join(end("b"), ["scene_id", "b"])
    views_held = F.array_distinct(F.transform(F.array_intersect("held_a", "held_b"), lambda x: F.substring_index(x, " ", 1)))
    known = both.select("scene_id", "a", "b", F.size(F.array_intersect("seen_a", "seen_b")).alias("seen"), F.size(views_held).alias("held"))
    return known.where("seen > 0").select("scene_id", "a", "b", (F.col("held") / F.col("seen")).alias("confidence"))


def bank(masks: DataFrame, proposals: DataFrame, most: float = 0.95) -> DataFrame:
    """``scene_id, p``: proposals kept when, best first, one is dropped that overlaps a kept one by ``most``.

    Order: score, size, lower p. Only the pairs above the limit reach the per-scene
    loop, so its input is the conflicts, not the masks.
    """
    clash = settled(overlaps(masks).where(F.col("iou") >= most).select("scene_id", "p", "q"), "clashes")
    ranked = proposals.join(apart(sizes(masks)), ["scene_id", "p"]).select("scene_id", "p", "score", "size")
    torn = clash.select("scene_id", F.explode(F.array("p", "q")).alias("p")).distinct()
    free = ranked.join(apart(torn), ["scene_id", "p"], "left_anti").select("scene_id", "p")
    ends = clash.groupBy("scene_id", F.col("p")).agg(F.collect_set("q").alias("qs"))
    back = clash.groupBy("scene_id", F.col("q").alias("p")).agg(F.collect_set("p").alias("ps"))
    nodes = ranked.join(apart(torn), ["scene_id", "p"], "left_semi").join(apart(ends), ["scene_id", "p"], "left").join(apart(back), ["scene_id", "p"], "left")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: set[int] = set()
        for row in pdf.sort_values(["score", "size", "p"], ascending=[False, False, True]).itertuples():
            rivals = [*(row.qs if row.qs is not None else ()), *(row.ps if row.ps is not None else ())]
            if not kept.intersection(rivals):
                kept.add(row.p)
        return pdf.loc[pdf["p"].isin(kept), ["scene_id", "p"]]

    return free.unionByName(nodes.groupBy("scene_id").applyInPandas(greedy, "scene_id long, p long"))


def greedy_matches(pairs: DataFrame, least: float = 0.3, by: str = "iou") -> DataFrame:
    """``scene_id, p, q, iou, shared``: one-to-one matches, greatest ``by`` first (then lower p, q), per scene.

    Only pairs that overlap reach the per-scene loop, not vertices.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, left, right = [], set(), set()
        for row in pdf.sort_values([by, "p", "q"], ascending=[False, True, True]).itertuples():
            if row.p not in left and row.q not in right:
                left.add(row.p)
                right.add(row.q)
                rows.append((row.scene_id, row.p, row.q, row.iou, row.shared))
        return pd.DataFrame(rows, columns=["scene_id", "p", "q", "iou", "shared"])

    kept = pairs.where(F.col("iou") >= least).select("scene_id", "p", "q", "iou", "shared")
    return kept.groupBy("scene_id").applyInPandas(run, "scene_id long, p long, q long, iou double, shared long")


def vertex_membership(faces: DataFrame) -> DataFrame:
    """``scene_id, v, o``: the object of most faces at a vertex; ties go to the smallest object.

    faces: scene_id, corners (array of vertices), o.
    """
    ends = faces.select("scene_id", F.explode("corners").alias("v"), "o")
    counted = ends.groupBy("scene_id", "v", "o").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("scene_id", "v").agg(F.min(F.struct((-F.col("n")).alias("n"), "o")).alias("best")).select("scene_id", "v", "best.o")


def lifted(views: DataFrame, visible: DataFrame, least: int = 20) -> DataFrame:
    """``scene_id, view, mask, v``: a view's mask on the mesh, that is, the vertices it holds that the view sees, if there are ``least``."""
    return vertices(lifted_words(views, visible, least).drop("size"))


def lifted_words(views: DataFrame, visible: DataFrame, least: int = 20) -> DataFrame:
    """``scene_id, view, mask, word, bits, size``: as ``lifted``, in words, with the size of each mask."""
    sight = words(visible, ["view"]).select("scene_id", "view", "word", F.col("bits").alias("bits_s"))
    held = words(views, ["view", "mask"]).join(apart(sight), ["scene_id", "view", "word"])
    held = held.select("scene_id", "view", "mask", "word", F.expr("bits & bits_s").alias("bits")).where("bits <> 0")
    size = F.sum(F.bit_count("bits")).over(Window.partitionBy("scene_id", "view", "mask")).alias("size")
    return held.select("*", size).where(F.col("size") >= least)


def policy_view(masks: DataFrame, proposals: DataFrame, accepted: float = 0.2, provisional: float = 0.05, least_size: int = 20) -> DataFrame:
    """``scene_id, p, score, state, raw, hard, assigned, inclusive, association, positive, negative, candidate, raw_candidate`` of every proposal.

    hard, assigned and inclusive count the vertices it wins when accepted proposals
    compete, when provisional ones do too, and when all do; association is the share of
    its vertices that it keeps among the second. A candidate for activation is provisional
    and wins something; a raw one is not discarded and wins nothing among the accepted.
    positive and negative are the mass of evidence that one score is.
    """
    won = lambda least, name: apart(resolved(masks, proposals, least, least_size).groupBy("scene_id", "p").agg(F.max("size").alias(name)))
    every = proposals.select("scene_id", "p", "score").join(apart(sizes(masks).withColumnRenamed("size", "raw")), ["scene_id", "p"], "left")
    for least, name in ((accepted, "hard"), (provisional, "assigned"), (float("-inf"), "inclusive")):
        every = every.join(won(least, name), ["scene_id", "p"], "left")
    every = every.fillna(0, ["raw", "hard", "assigned", "inclusive"])
    state = F.when(F.col("score") >= accepted, "accepted").when(F.col("score") >= provisional, "provisional").otherwise("discarded")
    share = F.when(F.col("raw") > 0, F.col("assigned") / F.col("raw")).otherwise(0.0)
    every = every.withColumns({"state": state, "association": share, "positive": F.col("score"), "negative": 1 - F.col("score")})
    return every.withColumns({
        "candidate": (F.col("state") == "provisional") & (F.col("assigned") > 0),
        "raw_candidate": (F.col("state") != "discarded") & (F.col("raw") > 0) & (F.col("hard") == 0),
    })


def activated(assignment: DataFrame, view: DataFrame, chosen: DataFrame) -> DataFrame:
    """``assignment`` (scene_id, v, p among provisional proposals) of the accepted proposals and of ``chosen`` candidates alone.

    A chosen id that is no candidate of its scene fails the job.
    """
    known = chosen.select("scene_id", "p").distinct().join(view.where("candidate").select("scene_id", "p", F.lit(True).alias("able")), ["scene_id", "p"], "left")
    able = known.where(F.when(F.col("able").isNull(), F.raise_error(F.format_string("proposal %d of scene %d is no candidate for activation", "p", "scene_id"))).otherwise(True).cast("boolean"))
    allowed = view.where("state = 'accepted' and assigned > 0").select("scene_id", "p").unionByName(able.select("scene_id", "p"))
    return assignment.join(apart(allowed), ["scene_id", "p"], "left_semi")


def fused_bank(edges: DataFrame, counts: DataFrame, cuts: tuple[float, ...] = (0.25, 0.50, 0.75), least: int = 20, most_share: float = 0.40, same: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The pool of components of edges (with confidence) at three cuts, ``scene_id, p, score, size, digest``, and their vertices.

    A component has ``least`` to ``most_share`` of the scene's vertices (counts: scene_id, n). p is its
    place in the order in which duplicates are judged: higher cut, larger, lesser digest. The score is the cut.
    """
    held = edges.select("scene_id", "a", "b", F.explode(F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.col("confidence") >= cut)).alias("cut"))
    found = components(held, ["scene_id", "cut"], "a", "b").withColumnRenamed("node", "v")
    sized = found.groupBy("scene_id", "cut", "root").agg(F.array_sort(F.collect_list("v")).alias("vs")).join(apart(counts), "scene_id")
    bounded = sized.where((F.size("vs") >= least) & (F.size("vs") <= F.floor(F.col("n") * most_share)))
    digest = ids_sha256(F.col("vs"))
    order = Window.partitionBy("scene_id").orderBy(F.desc("cut"), F.desc(F.size("vs")), digest)
    pool = bounded.withColumn("p", F.row_number().over(order).cast("long"))
    return pool.select("scene_id", "p", F.col("cut").alias("score"), F.size("vs").cast("long").alias("size"), digest.alias("digest")), pool.select("scene_id", "p", F.explode("vs").alias("v"))


def mesh_edges(faces: DataFrame) -> DataFrame:
    """``scene_id, a, b`` (a < b): the distinct edges of triangles (scene_id, corners)."""
    corner = lambda k: F.get("corners", F.lit(k))
    sides = F.array(*(F.struct(F.least(corner(i), corner(j)).alias("a"), F.greatest(corner(i), corner(j)).alias("b")) for i, j in ((0, 1), (1, 2), (2, 0))))
    return faces.select("scene_id", F.explode(sides).alias("e")).select("scene_id", "e.a", "e.b").where("a <> b").distinct()


def coverage(pairs: DataFrame, truths: DataFrame, matches: DataFrame) -> DataFrame:
    """``scene_id, q, size, top, covered, match, match_iou`` of every true object.

    top is the prediction with most of its vertices (then the lower id), covered the
    share it has; match is its one-to-one partner.
    """
    first = pairs.groupBy("scene_id", "q").agg(F.min(F.struct((-F.col("shared")).alias("n"), "p")).alias("t")).select("scene_id", "q", F.col("t.p").alias("top"), (-F.col("t.n")).alias("most"))
    own = matches.select("scene_id", "q", F.col("p").alias("match"), "iou")
    every = sizes(truths).withColumnRenamed("p", "q").join(apart(first), ["scene_id", "q"], "left").join(apart(own), ["scene_id", "q"], "left")
    covered = F.round(F.coalesce(F.col("most") / F.col("size"), F.lit(0.0)), 4)
    return every.select("scene_id", "q", "size", "top", covered.alias("covered"), "match", F.round(F.coalesce("iou", F.lit(0.0)), 4).alias("match_iou"))


def split_and_merged(pairs: DataFrame, least: float = 0.10) -> DataFrame:
    """``scene_id, split, merging``: objects with two or more predictions of ``least`` of them, predictions over two or more such objects."""
    strong = pairs.where(F.col("shared") >= least * F.col("size_q")).select("scene_id", "p", "q")
    split = strong.groupBy("scene_id", "q").count().where("count > 1").groupBy("scene_id").agg(F.count(F.lit(1)).alias("split"))
    merging = strong.groupBy("scene_id", "p").count().where("count > 1").groupBy("scene_id").agg(F.count(F.lit(1)).alias("merging"))
    return pairs.select("scene_id").distinct().join(split, "scene_id", "left").join(merging, "scene_id", "left").fillna(0, ["split", "merging"])


def failures(cover: DataFrame, matches: DataFrame, best_raw: DataFrame) -> DataFrame:
    """``scene_id, q, class``: recovered, merged, lost_by_resolver or no_raw_proposal, in this order.

    An object is merged if one prediction holds half of it and is matched to another
    object; best_raw has the best IoU of any raw mask (scene_id, q, raw_iou).
    """
    owner = matches.select("scene_id", F.col("p").alias("top"), F.col("q").alias("owner"))
    known = cover.join(apart(owner), ["scene_id", "top"], "left").join(apart(best_raw), ["scene_id", "q"], "left")
    swallowed = (F.col("covered") >= 0.5) & F.col("owner").isNotNull() & (F.col("owner") != F.col("q"))
    kind = F.when(F.col("match_iou") >= 0.5, "recovered").when(swallowed, "merged").when(F.coalesce("raw_iou", F.lit(0.0)) >= 0.5, "lost_by_resolver").otherwise("no_raw_proposal")
    return known.select("scene_id", "q", kind.alias("class"))


def mesh_components(edges: DataFrame, confident: float = 0.5) -> DataFrame:
    """``scene_id, v, root``: components of a mesh's confident edges, per scene, root the least vertex."""
    return components(edges.where(F.col("confidence") >= confident), ["scene_id"], "a", "b").select("scene_id", F.col("node").alias("v"), "root")


def recall_at(pairs: DataFrame, proposals: DataFrame, truths: DataFrame, ks: Iterator[int], least: float = 0.5) -> DataFrame:
    """``scene_id, k, recall``: share of true entities that one of the best k proposals overlaps by ``least``."""
    order = Window.partitionBy("scene_id").orderBy(F.desc("score"), "p")
    ranked = proposals.withColumn("rank", F.row_number().over(order)).select("scene_id", "p", "rank")
    first = pairs.where(F.col("iou") >= least).join(apart(ranked), ["scene_id", "p"]).groupBy("scene_id", "q").agg(F.min("rank").alias("rank"))
    total = truths.groupBy("scene_id").agg(F.countDistinct("p").alias("total"))
    grid = total.select("scene_id", "total", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hits = grid.join(apart(first), "scene_id", "left").groupBy("scene_id", "k", "total").agg(F.count_if(F.col("rank") <= F.col("k")).alias("n"))
    return hits.select("scene_id", "k", F.round(F.col("n") / F.col("total"), 6).alias("recall"))
