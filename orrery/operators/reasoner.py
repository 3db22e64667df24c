"""Questions over the graph, answered all at once.

Compile (text to relation and anchor, by column expressions), look up (joins with
the edge table), decide (bindings, empty or unknown), score, gate and put in words.
A single question is the same plan with one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g

#: Patterns of a question and the relation they mean, in the order they are tried.
GENERIC = (
    (r"^what(?:'s| is) (?:to the )?left of (?:the )?(.+?)\??$", "LEFT_OF"),
    (r"^what(?:'s| is) (?:to the )?right of (?:the )?(.+?)\??$", "RIGHT_OF"),
    (r"^what(?:'s| is) (?:directly )?below (?:the )?(.+?)\??$", "BELOW"),
    (r"^what(?:'s| is) under (?:the )?(.+?)\??$", "BELOW"),
    (r"^what(?:'s| is) (?:directly )?above (?:the )?(.+?)\??$", "ABOVE"),
    (r"^what(?:'s| is) in front of (?:the )?(.+?)\??$", "IN_FRONT_OF"),
    (r"^what(?:'s| is) behind (?:the )?(.+?)\??$", "BEHIND"),
    (r"^what(?:'s| is) near (?:the )?(.+?)\??$", "NEAR"),
    (r"^what(?:'s| is) (?:close to|next to) (?:the )?(.+?)\??$", "NEAR"),
)
ON, AGAINST, NEAR, ATTACHED = (rf"^what(?:'s| is) {w} (?:the )?(.+?)\??$" for w in ("on", "against", "near", "attached to"))
#: Nouns of "on the ..." and the class they name.
ON_CLASSES = {"table": "table", "tabletop": "table", "desk": "desk", "chair": "chair", "seat": "chair", "stool": "stool", "bench": "bench", "shelf": "shelf", "sofa": "sofa", "plant stand": "plant-stand", "plant-stand": "plant-stand", "counter": "counter"}
#: The battery's questions.
STRUCTURAL = ("what is on the floor?", "what is against the wall?", "what is near the wall?", "what is attached to the wall?")
BATTERY = STRUCTURAL + tuple(f"what is on the {c}?" for c in ("table", "desk", "shelf", "counter", "stool", "bench", "sofa", "chair", "plant-stand"))
INVERSE = {"RIGHT_OF": "LEFT_OF", "IN_FRONT_OF": "BEHIND", "BELOW": "ABOVE"}


def compile_questions(questions: DataFrame, extra_on: dict[str, str] | None = None) -> DataFrame:
    """``questions`` (with ``question``) and ``edge_type, anchor_kind, anchor, compiled``.

    compiled is ``compiled``, ``out_of_schema`` (a surface question about something
    else) or ``parser_failure``. Surface patterns are tried first; "near" something
    other than the wall falls through to the generic ones.
    """
    patterns = [ON, ATTACHED, AGAINST, *[p for p, _ in GENERIC]]
    kinds = [None, "ATTACHED_TO", "CONTACTS_SURFACE", *[k for _, k in GENERIC]]
    classes = {**ON_CLASSES, **(extra_on or {})}
    literal = lambda values: F.array(*[F.lit(v).cast("string") for v in values])
    rule, noun = F.col("__rule"), F.col("__noun")
    # which pattern holds, then one extraction with it, then what its noun makes of it
    found = questions.withColumn("__q", F.regexp_replace(F.lower(F.trim("question")), r"\s+", " "))
    found = found.withColumn("__rule", F.coalesce(*[F.when(F.col("__q").rlike(p), F.lit(i)) for i, p in enumerate(patterns)]))
    found = found.withColumn("__noun", F.trim(F.regexp_replace(F.call_function("regexp_extract", F.col("__q"), F.get(literal(patterns), rule), F.lit(1)), r"[.?!]+$", "")))
    named = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])[noun]
    wall, near = noun == "wall", patterns.index(NEAR)
    kind = F.when(rule == 0, F.when((noun == "floor") | named.isNotNull(), "SUPPORTS")).when(rule < 3, F.when(wall, F.get(literal(kinds), rule))).when((rule == near) & wall, "NEAR_SURFACE").otherwise(F.get(literal(kinds), rule))
    place = F.when(rule == 0, F.when(noun == "floor", "surface").otherwise("class")).when((rule < 3) | ((rule == near) & wall), "surface").otherwise("entity")
    anchor = F.when((rule == 0) & (noun != "floor"), named).otherwise(noun)
    known = found.withColumn("edge_type", kind).withColumn("compiled", F.when(rule.isNull(), "parser_failure").when(F.col("edge_type").isNull(), "out_of_schema").otherwise("compiled"))
    if_known = lambda c: F.when(F.col("compiled") == "compiled", c)
    return known.select(*questions.columns, "edge_type", if_known(place).alias("anchor_kind"), if_known(anchor).alias("anchor"), "compiled")


def logical_edges(edges: DataFrame) -> DataFrame:
    """Edges as questions see them: ``scene_id, type, anchor, answer, edge_id, confidence``.

    A stored edge "src TYPE dst" answers "what is TYPE of dst"; the inverse type
    answers with dst; a symmetric edge answers both ways.
    """
    base = edges.select("scene_id", "type", F.col("dst").alias("anchor"), F.col("src").alias("answer"), "edge_id", "confidence")
    turned = F.col("type")
    for inverse, kept in INVERSE.items():
        turned = F.when(F.col("type") == kept, inverse).otherwise(turned)
    back = edges.where(F.col("type").isin("NEAR", *INVERSE.values())).select("scene_id", turned.alias("type"), F.col("src").alias("anchor"), F.col("dst").alias("answer"), "edge_id", "confidence")
    carried = edges.where(F.col("type").isin("ON_SURFACE", "ON_ENTITY_SURFACE")).select("scene_id", F.lit("SUPPORTS").alias("type"), F.col("dst").alias("anchor"), F.col("src").alias("answer"), "edge_id", "confidence")
    return base.unionByName(back).unionByName(carried)


def anchors(entities: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``scene_id, anchor_kind, anchor, ref``: what a question's anchor may resolve to."""
    key = lambda kind, name: F.struct(F.lit(kind).alias("anchor_kind"), F.col(name).alias("anchor"))
    keys = F.explode(F.array(key("entity", "cls"), key("class", "cls"), key("entity", "uid")))
    named = entities.select("scene_id", keys.alias("k"), F.col("uid").alias("ref"))
    kinds = surfaces.select("scene_id", F.lit("surface").alias("anchor_kind"), F.col("surface_type").alias("anchor"), F.col("surface").alias("ref"))
    return named.select("scene_id", "k.anchor_kind", "k.anchor", "ref").unionByName(kinds)


def ceilings(asked: DataFrame, entities: DataFrame, surfaces: DataFrame, rejections: DataFrame) -> DataFrame:
    """``scene_id, question, ceiling, n_scoped, n_measured``: 1 less the best confidence of a rejection in a question's scope.

    In scope is a rejection of the relation that is consulted, with an end among the
    question's anchors: an edge that was nearly there. What carries things is read off
    ON_SURFACE for a surface, ON_ENTITY_SURFACE for a class. rejections: scene_id, type,
    src, dst, margin (null where none was measured). Questions without any are left out.
    """
    consulted = F.when(F.col("edge_type") != "SUPPORTS", F.col("edge_type")).when(F.col("anchor_kind") == "surface", "ON_SURFACE").otherwise("ON_ENTITY_SURFACE")
    scope = asked.select("scene_id", "question", "anchor_kind", "anchor", consulted.alias("type")).join(anchors(entities, surfaces), ["scene_id", "anchor_kind", "anchor"]).select("scene_id", "question", "type", "ref").distinct()
    # a rejection without a margin is in scope, but nothing was measured
    held = rejections.withColumn("confidence", F.when(F.col("margin").isNotNull(), g.margin_confidence(F.col("margin"))))
    ends = held.select("scene_id", "type", F.explode(F.array_distinct(F.array("src", "dst"))).alias("ref"), "src", "dst", "confidence")
    met = scope.join(ends, ["scene_id", "type", "ref"]).select("scene_id", "question", "src", "dst", "confidence").distinct()
    # greatest passes over nulls, so nothing measured is asked for first
    worst = F.when(F.max("confidence").isNotNull(), F.greatest(F.lit(0.0), 1 - F.max("confidence")))
    return met.groupBy("scene_id", "question").agg(F.coalesce(worst, F.lit(1.0)).alias("ceiling"), F.count(F.lit(1)).alias("n_scoped"), F.count("confidence").alias("n_measured"))


def answer(
    compiled: DataFrame, entities: DataFrame, surfaces: DataFrame, edges: DataFrame, recall: float = 1.0, threshold: float = 0.95,
    tau: float = 0.0, aggregate: str = "min", rejections: DataFrame | None = None,
) -> DataFrame:
    """Every question of every scene: ``scene_id, question, outcome, n, answers, cited, confidence, text``.

    compiled: compiled questions with ``scene_id``. An answer is bound once however many anchors or
    edges give it (the edge of least id is cited). Without bindings the outcome is
    ``empty`` if the extractors' recall reaches the threshold, else ``unknown``. Scores
    below ``tau`` turn bindings and empties into ``unknown``. aggregate: min, mean or product.
    With ``rejections`` no score is above its question's ceiling (see ``ceilings``); an
    empty answer scores the ceiling itself.
    """
    asked = compiled.where("compiled = 'compiled'")
    seen = edges.withColumn("confidence", g.margin_confidence(F.col("margin")))
    hits = (
        asked.join(anchors(entities, surfaces), ["scene_id", "anchor_kind", "anchor"])
        .join(logical_edges(seen).withColumnRenamed("anchor", "ref"), ["scene_id", "ref"])
        .where(F.col("type") == F.col("edge_type"))
    )
    bound = hits.groupBy("scene_id", "question", "answer").agg(F.min(F.struct("edge_id", "confidence")).alias("edge"))
    labelled = bound.join(entities.select("scene_id", F.col("uid").alias("answer"), "cls", "ord"), ["scene_id", "answer"])
    score = {"min": F.min("edge.confidence"), "mean": F.avg("edge.confidence"), "product": F.product("edge.confidence")}[aggregate]
    row = F.array_sort(F.collect_list(F.struct("ord", "answer", "cls", "edge.edge_id")))
    found = labelled.groupBy("scene_id", "question").agg(row.alias("rows"), score.alias("score"))
    joined = compiled.join(found, ["scene_id", "question"], "left").withColumn("ceiling", F.lit(1.0))
    if rejections is not None:
        limits = ceilings(asked, entities, surfaces, rejections).select("scene_id", "question", F.col("ceiling").alias("limit"))
        joined = joined.join(limits, ["scene_id", "question"], "left").withColumn("ceiling", F.coalesce("limit", F.lit(1.0)))
    n = F.coalesce(F.size("rows"), F.lit(0))
    first = F.when(F.col("compiled") == "parser_failure", "parser_failure").when(F.col("compiled") == "out_of_schema", "abstain").when(n > 0, "bindings").when(F.lit(recall >= threshold), "empty").otherwise("unknown")
    base = F.when(first == "bindings", F.least("score", "ceiling")).when(first == "empty", F.col("ceiling")).otherwise(0.0)
    out = joined.select("scene_id", "question", first.alias("outcome"), base.alias("score"), "rows")
    gated = F.when(F.col("outcome").isin("bindings", "empty") & (F.col("score") < tau), "unknown").otherwise(F.col("outcome"))
    kept = out.withColumn("outcome", gated)
    rows = F.when(F.col("outcome") == "bindings", F.col("rows"))
    return kept.select("scene_id", "question", "outcome", F.coalesce(F.size(rows), F.lit(0)).cast("long").alias("n"), F.array_join(rows["answer"], ",").alias("answers"), F.array_join(rows["edge_id"], ",").alias("cited"), F.round("score", 6).alias("confidence"), wording(F.col("outcome"), rows["cls"]).alias("text"))


def listed(items: Column) -> Column:
    """Items as English lists them."""
    n = F.size(items)
    two = F.concat_ws(" and ", items)
    many = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(items, -1))
    return F.when(n == 1, F.element_at(items, 1)).when(n == 2, two).otherwise(many)


#: What is said of an outcome without bindings.
WORDS = {
    "parser_failure": "I couldn't understand the question well enough to answer it.",
    "abstain": "I can't answer this question.",
    "empty": "Nothing in the scene matches that.",
    "unknown": "I don't have enough evidence to say.",
}


def wording(outcome: Column, labels: Column) -> Column:
    text = F.concat(F.lit("The "), listed(labels), F.lit("."))
    for name, words in WORDS.items():
        text = F.when(outcome == name, words).otherwise(text)
    return text


#: Why a question of the schema's own kinds is put off, by its pattern; and what is said of it, of others outside the schema, and of too little evidence.
DEFERRED = (
    (ON, "this support class is not covered by EntitySurface in P6"),
    (AGAINST, "wall contact only supports 'against the wall' in P5; this surface is not a wall"),
    (ATTACHED, "ATTACHED_TO currently supports wall surfaces only"),
)
PUT_OFF, OUTSIDE = ("I can't answer that yet — ", ". This isn't a claim that nothing is there."), "That question isn't expressible in the current scene graph."
UNSURE = "I don't have enough evidence to say. The underlying extractor's recall is below the threshold needed to treat a no-match result as a true negative."


def spoken(answers: DataFrame, compiled: DataFrame) -> DataFrame:
    """``answers`` with the full ``text`` and ``answered_by``: reasons of deferral, which must not read as if nothing were there.

    compiled: question, compiled. Questions outside the schema without a reason of their own are called inexpressible.
    """
    asked = F.regexp_replace(F.lower(F.trim("question")), r"\s+", " ")
    reason = F.coalesce(*[F.when(asked.rlike(pattern), why) for pattern, why in DEFERRED])
    known = answers.join(compiled.select("question", "compiled").distinct(), "question")
    outside = F.col("compiled") == "out_of_schema"
    put_off = F.concat(F.lit(PUT_OFF[0]), reason, F.lit(PUT_OFF[1]))
    text = F.when(outside, F.coalesce(put_off, F.lit(OUTSIDE))).when(F.col("outcome") == "unknown", UNSURE).otherwise(F.col("text"))
    who = F.when(outside | (F.col("compiled") == "parser_failure"), "verbalizer_abstain").otherwise("rules_compiler")
    return known.withColumns({"text": text, "answered_by": who})


def per_group_rank(df: DataFrame, group: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each group in a total order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top)
