"""Question answering over every scene, and its evaluation against a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import reasoner as q
from orrery.operators import scoring
from orrery.plans import relations as rel
from orrery.plans.scene import CLASSES, entities, surfaces
from orrery.sources.tables import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIRECTIONAL = tuple(f"What is {w} the {c}?" for c in CLASSES for w in ("to the left of", "right of", "below", "above", "in front of", "behind", "near", "next to"))
ODD = ("Where is it?", "what is on the ceiling?", "what is attached to the lamp", "What's   NEAR the wall", "what is against the door?")


def compiled_once(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return settled(q.compile_questions(spark.createDataFrame([(t,) for t in texts], "question string")), "questions")


def asked(spark: SparkSession, sf: str, texts: tuple[str, ...], compiled: DataFrame | None = None) -> DataFrame:
    """Every question, compiled once, in every scene; the texts are literals and broadcast."""
    scenes = surfaces(spark, sf).select("scene_id").distinct()
    return scenes.crossJoin(F.broadcast(compiled_once(spark, texts) if compiled is None else compiled))


def _values(texts: tuple[str, ...]) -> str:
    return ", ".join("('" + t.replace("'", "''") + "')" for t in texts)


_NOUN = "trim(regexp_replace(regexp_extract(q, {p}, 1), '[.?!]+$', ''))"


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _case(part: str) -> str:
    """A compile rule in SQL: part is edge_type, anchor_kind, anchor or compiled."""
    pick = lambda kind, anchor_kind, anchor: {"edge_type": f"'{kind}'", "anchor_kind": f"'{anchor_kind}'", "anchor": anchor, "compiled": "'compiled'"}[part]
    out = "'out_of_schema'" if part == "compiled" else "NULL"
    on, noun = _lit(q.ON), lambda p: _NOUN.format(p=_lit(p))
    classes = "CASE " + noun(q.ON) + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in q.ON_CLASSES.items()) + " END"
    text = f"CASE WHEN regexp_matches(q, {on}) THEN CASE WHEN {noun(q.ON)} = 'floor' THEN {pick('SUPPORTS', 'surface', _lit('floor'))} WHEN {classes} IS NOT NULL THEN {pick('SUPPORTS', 'class', classes)} ELSE {out} END "
    for p, kind in ((q.ATTACHED, "ATTACHED_TO"), (q.AGAINST, "CONTACTS_SURFACE")):
        text += f"WHEN regexp_matches(q, {_lit(p)}) THEN CASE WHEN {noun(p)} = 'wall' THEN {pick(kind, 'surface', _lit('wall'))} ELSE {out} END "
    text += f"WHEN regexp_matches(q, {_lit(q.NEAR)}) AND {noun(q.NEAR)} = 'wall' THEN {pick('NEAR_SURFACE', 'surface', _lit('wall'))} "
    for p, kind in q.GENERIC:
        text += f"WHEN regexp_matches(q, {_lit(p)}) THEN {pick(kind, 'entity', noun(p))} "
    return text + "ELSE " + ("'parser_failure'" if part == "compiled" else "NULL") + " END"


def compiled_sql(texts: tuple[str, ...]) -> str:
    return f"""asked AS (SELECT s.scene_id, v.question, regexp_replace(lower(trim(v.question)), '\\s+', ' ', 'g') AS q FROM (SELECT DISTINCT scene_id FROM ent) s, (VALUES {_values(texts)}) v(question)
), rules AS (SELECT scene_id, question, {", ".join(f"{_case(p)} AS {p}" for p in ("edge_type", "anchor_kind", "anchor", "compiled"))} FROM asked)"""


def _list(items: str) -> str:
    return f"CASE len({items}) WHEN 1 THEN {items}[1] WHEN 2 THEN {items}[1] || ' and ' || {items}[2] ELSE array_to_string({items}[:-2], ', ') || ', and ' || {items}[-1] END"


_NO_CEILING = "limits AS (SELECT NULL::BIGINT AS scene_id, NULL::VARCHAR AS question, 1e0 AS ceiling, 0 AS n_scoped, 0 AS n_measured)"
_CEILING = f"""{rel.REJECTED}, scope AS (SELECT DISTINCT r.scene_id, r.question, a.ref, CASE WHEN r.edge_type <> 'SUPPORTS' THEN r.edge_type WHEN r.anchor_kind = 'surface' THEN 'ON_SURFACE' ELSE 'ON_ENTITY_SURFACE' END AS type
  FROM rules r JOIN anc a USING (scene_id, anchor_kind, anchor) WHERE compiled = 'compiled'
), scoped AS (SELECT DISTINCT c.scene_id, c.question, j.src, j.dst, CASE WHEN j.margin IS NOT NULL THEN 1 / (1 + exp(-least(greatest(4 * j.margin, -50e0), 50e0))) END AS confidence FROM scope c JOIN sampled j ON j.scene_id = c.scene_id AND j.type = c.type AND c.ref IN (j.src, j.dst)
), limits AS (SELECT scene_id, question, CASE WHEN count(confidence) = 0 THEN 1e0 ELSE greatest(0e0, 1 - max(confidence)) END AS ceiling, count(*) AS n_scoped, count(confidence) AS n_measured FROM scoped GROUP BY ALL)"""


def answers_sql(texts: tuple[str, ...], recall: float = 1.0, tau: float = 0.0, score: str = "min(edge.c)", limits: str = _NO_CEILING) -> str:
    words = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in q.WORDS.items())
    return f"""{rel.EDGES}, {compiled_sql(texts)}, scored AS (SELECT *, 1 / (1 + exp(-least(greatest(4 * margin, -50e0), 50e0))) AS confidence FROM edges
), seen AS (
  SELECT scene_id, type, dst AS ref, src AS answer, edge_id, confidence FROM scored
  UNION ALL SELECT scene_id, CASE type WHEN 'LEFT_OF' THEN 'RIGHT_OF' WHEN 'BEHIND' THEN 'IN_FRONT_OF' WHEN 'ABOVE' THEN 'BELOW' ELSE type END, src, dst, edge_id, confidence FROM scored WHERE type IN ('NEAR', 'LEFT_OF', 'BEHIND', 'ABOVE')
  UNION ALL SELECT scene_id, 'SUPPORTS', dst, src, edge_id, confidence FROM scored WHERE type IN ('ON_SURFACE', 'ON_ENTITY_SURFACE')
), anc AS (
  SELECT scene_id, 'entity' AS anchor_kind, cls AS anchor, uid AS ref FROM ent UNION ALL SELECT scene_id, 'class', cls, uid FROM ent UNION ALL SELECT scene_id, 'entity', uid, uid FROM ent
  UNION ALL SELECT scene_id, 'surface', surface_type, surface FROM surf
), {limits}, bound AS (
  SELECT r.scene_id, r.question, s.answer, min({{'e': s.edge_id, 'c': s.confidence}}) AS edge FROM rules r JOIN anc a USING (scene_id, anchor_kind, anchor) JOIN seen s ON s.scene_id = r.scene_id AND s.ref = a.ref AND s.type = r.edge_type
  WHERE r.compiled = 'compiled' GROUP BY ALL
), found AS (
  SELECT b.scene_id, b.question, count(*) AS n, list(e.cls ORDER BY e.ord) AS labels, string_agg(b.answer, ',' ORDER BY e.ord) AS answers, string_agg(b.edge.e, ',' ORDER BY e.ord) AS cited, {score.replace("edge.", "b.edge.")} AS score
  FROM bound b JOIN ent e ON e.scene_id = b.scene_id AND e.uid = b.answer GROUP BY ALL
), decided AS (
  SELECT r.scene_id, r.question, CASE WHEN compiled = 'parser_failure' THEN 'parser_failure' WHEN compiled = 'out_of_schema' THEN 'abstain' WHEN n > 0 THEN 'bindings' ELSE '{"empty" if recall >= 0.95 else "unknown"}' END AS first, f.*  EXCLUDE (scene_id, question), coalesce(l.ceiling, 1e0) AS ceiling
  FROM rules r LEFT JOIN found f ON f.scene_id = r.scene_id AND f.question = r.question LEFT JOIN limits l ON l.scene_id = r.scene_id AND l.question = r.question
), valued AS (SELECT *, CASE first WHEN 'bindings' THEN least(score, ceiling) WHEN 'empty' THEN ceiling ELSE 0e0 END AS value FROM decided
), gated AS (SELECT *, CASE WHEN first IN ('bindings', 'empty') AND value < {tau}e0 THEN 'unknown' ELSE first END AS outcome FROM valued
), answers AS (
  SELECT scene_id, question, outcome, CASE outcome WHEN 'bindings' THEN n ELSE 0 END AS n, CASE outcome WHEN 'bindings' THEN answers END AS answers, CASE outcome WHEN 'bindings' THEN cited END AS cited, round(value, 6) AS confidence,
    CASE outcome {words} ELSE 'The ' || {_list('labels')} || '.' END AS text FROM gated)"""


def _graph(e: DataFrame, s: DataFrame, compiled: DataFrame) -> DataFrame:
    """The edges that the questions consult; the relations they name are few."""
    named = {row["edge_type"] for row in compiled.where("edge_type is not null").select("edge_type").distinct().collect()}
    return settled(rel.edges_between(e, s, named or {"SUPPORTS"}), "edges")


def answers(spark: SparkSession, sf: str, texts: tuple[str, ...], **options) -> DataFrame:
    e, s, compiled = settled(entities(spark, sf), "entities"), surfaces(spark, sf), compiled_once(spark, texts)
    return q.answer(asked(spark, sf, texts, compiled), e, s, _graph(e, s, compiled), **options)


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query(f"WITH {rel.PRELUDE}, {compiled_sql(q.BATTERY + DIRECTIONAL + ODD)} SELECT * FROM rules")
def compile_questions(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf, q.BATTERY + DIRECTIONAL + ODD)


@_query(f"WITH {answers_sql(q.BATTERY)} SELECT * FROM answers")
def qa_battery(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf, q.BATTERY)


@_query(f"WITH {answers_sql(DIRECTIONAL + ODD)} SELECT * FROM answers")
def qa_directional(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf, DIRECTIONAL + ODD)


@_query(f"WITH {answers_sql(q.BATTERY, recall=0.9, tau=0.6, score='avg(edge.c)')} SELECT * FROM answers")
def qa_tau_gate(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf, q.BATTERY, recall=0.9, tau=0.6, aggregate="mean")


_SPOKEN = q.BATTERY[:5] + ODD
_DASH = "\u2014"


@_query(f"""WITH {answers_sql(_SPOKEN, recall=0.9)}, t AS (SELECT a.scene_id, a.question, a.outcome, a.text, r.compiled, lower(trim(a.question)) AS asked FROM answers a JOIN (SELECT DISTINCT question, compiled FROM rules) r USING (question))
SELECT scene_id, question, outcome, CASE WHEN compiled = 'out_of_schema' THEN coalesce('I can''t answer that yet {_DASH} ' || CASE WHEN asked LIKE 'what is on %' THEN 'this support class is not covered by EntitySurface in P6'
    WHEN asked LIKE 'what is against %' THEN 'wall contact only supports ''against the wall'' in P5; this surface is not a wall' WHEN asked LIKE 'what is attached to %' THEN 'ATTACHED_TO currently supports wall surfaces only' END || '. This isn''t a claim that nothing is there.',
    'That question isn''t expressible in the current scene graph.')
  WHEN outcome = 'unknown' THEN 'I don''t have enough evidence to say. The underlying extractor''s recall is below the threshold needed to treat a no-match result as a true negative.' ELSE text END AS text,
  CASE WHEN compiled IN ('out_of_schema', 'parser_failure') THEN 'verbalizer_abstain' ELSE 'rules_compiler' END AS answered_by FROM t""")
def qa_spoken(spark: SparkSession, sf: str) -> DataFrame:
    """What is said to questions, with the reasons for putting some off, and who says it."""
    found = q.spoken(answers(spark, sf, _SPOKEN, recall=0.9), compiled_once(spark, _SPOKEN))
    return found.select("scene_id", "question", "outcome", "text", "answered_by")


def limited(spark: SparkSession, sf: str, texts: tuple[str, ...], **options) -> DataFrame:
    """Answers with the rejections' ceiling."""
    e, s, compiled = settled(entities(spark, sf), "entities"), surfaces(spark, sf), compiled_once(spark, texts)
    near = settled(rel.rejections(e, s), "rejections")
    return q.answer(asked(spark, sf, texts, compiled), e, s, _graph(e, s, compiled), rejections=near, **options)


@_query(f"WITH {answers_sql(q.BATTERY, limits=_CEILING)} SELECT * FROM limits")
def qa_rejection_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """How high each question's confidence may be, by the rejections in its scope."""
    e, s = settled(entities(spark, sf), "entities"), surfaces(spark, sf)
    return q.ceilings(asked(spark, sf, q.BATTERY).where("compiled = 'compiled'"), e, s, rel.rejections(e, s))


_UNMEASURED = _CEILING.replace("JOIN sampled j", "JOIN (SELECT * REPLACE (CASE WHEN right(src, 1) IN ('0', '3', '6', '9') THEN NULL ELSE margin END AS margin) FROM sampled) j")


@_query(f"WITH {answers_sql(q.BATTERY, limits=_UNMEASURED)} SELECT * FROM limits")
def qa_unmeasured_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """Ceilings where some rejections in scope have no margin: they count as scoped and limit nothing."""
    e, s = settled(entities(spark, sf), "entities"), surfaces(spark, sf)
    unmeasured = F.substring("src", -1, 1).isin("0", "3", "6", "9")
    near = rel.rejections(e, s).withColumn("margin", F.when(~unmeasured, F.col("margin")))
    return q.ceilings(asked(spark, sf, q.BATTERY).where("compiled = 'compiled'"), e, s, near)


@_query(f"WITH {answers_sql(q.BATTERY, tau=0.5, limits=_CEILING)} SELECT * FROM answers")
def qa_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The battery's answers under the ceiling: doubtful bindings and empties become unknown."""
    return limited(spark, sf, q.BATTERY, tau=0.5)


#: Expected outcomes of the derived key, in turn.
_EXPECTED = ("answer", "empty", "defer", "unknown", "parser_failure", "execution_error", "answer", "empty")
_ROUTED = q.BATTERY + ODD
_ROUTER = f"""{answers_sql(_ROUTED, recall=0.9)}, k AS (
  SELECT a.scene_id, a.question, ([{", ".join(f"'{x}'" for x in _EXPECTED)}])[(a.scene_id + length(a.question)) % 8 + 1] AS expected, outcome AS got, r.compiled = 'out_of_schema' AS deferred,
    list_filter(string_split(coalesce(answers, ''), ','), lambda x: x <> '') AS cited, [x FOR x IN ['obj_' || (a.scene_id * 50 + 4 * (length(a.question) % 9))] IF a.scene_id % 2 = 0] AS wanted, ['obj_' || (a.scene_id * 50 + length(a.question))] AS barred
  FROM answers a JOIN rules r ON r.scene_id = a.scene_id AND r.question = a.question
), routed AS (SELECT *, CASE WHEN expected = 'answer' THEN CASE WHEN got <> 'bindings' OR NOT list_has_all(cited, wanted) THEN 'miss' WHEN list_has_any(cited, barred) THEN 'false_answer' ELSE 'true_answer' END
  WHEN got = 'bindings' THEN 'false_answer' WHEN expected = 'defer' AND deferred THEN 'correct_defer' WHEN expected = got THEN 'true_' || expected WHEN expected = 'execution_error' AND got = 'abstain' THEN 'true_execution_error' ELSE 'unexpected' END AS category FROM k)"""


def routed(spark: SparkSession, sf: str) -> DataFrame:
    """Routed answers beside a derived key: expected outcomes in turn, ids that must and must not be cited."""
    told = answers(spark, sf, _ROUTED, recall=0.9)
    why = asked(spark, sf, _ROUTED).select("scene_id", "question", (F.col("compiled") == "out_of_schema").alias("deferred"))
    n, obj = F.length("question"), lambda k: F.concat(F.lit("obj_"), k.cast("string"))
    key = told.join(why, ["scene_id", "question"]).select(
        "scene_id", "question", F.element_at(F.array(*map(F.lit, _EXPECTED)), ((F.col("scene_id") + n) % 8 + 1).cast("int")).alias("expected"), F.col("outcome").alias("got"), "deferred",
        F.filter(F.split(F.coalesce("answers", F.lit("")), ","), lambda x: x != "").alias("cited"),
        F.when(F.col("scene_id") % 2 == 0, F.array(obj(F.col("scene_id") * 50 + 4 * (n % 9)))).alias("wanted"), F.array(obj(F.col("scene_id") * 50 + n)).alias("barred"),
    )
    return key.withColumn("category", scoring.category(*(F.col(c) for c in ("expected", "got", "cited", "wanted", "barred", "deferred"))))


@_query(f"WITH {_ROUTER} SELECT scene_id, question, expected, got, deferred, category FROM routed")
def router_categories(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every routed question with an expected outcome."""
    return routed(spark, sf).select("scene_id", "question", "expected", "got", "deferred", "category")


@_query(f"""WITH {_ROUTER} SELECT scene_id, count(*) AS questions, count(*) FILTER (category = 'false_answer') AS false_answers, count(*) FILTER (category = 'miss') AS misses, count(*) FILTER (category = 'unexpected') AS unexpected,
  count(*) FILTER (category LIKE 'true%' OR category = 'correct_defer') AS met, bool_and(category LIKE 'true%' OR category = 'correct_defer') AS all_met FROM routed GROUP BY 1""")
def router_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.scorecard(routed(spark, sf), ["scene_id"])


@_query(f"WITH {_ROUTER} SELECT expected, got, count(*) AS n FROM routed GROUP BY ALL")
def outcome_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Expected outcomes against the outcomes that came."""
    return routed(spark, sf).groupBy("expected", "got").agg(F.count(F.lit(1)).alias("n"))


_TYPES, _POLICIES = ("entity_list", "count", "yes_no", "entity", "location"), ("none", "abstain_ok", "one_of", "any_of_subset", "all_of")
_BENCH_TEXTS = q.BATTERY + DIRECTIONAL[:16] + ODD
_BENCH = f"""{answers_sql(_BENCH_TEXTS, recall=0.9)}, given AS (
  SELECT scene_id, question, outcome, length(question) AS len, list_filter(string_split(coalesce(answers, ''), ','), lambda x: x <> '') AS ids FROM answers
), b AS (SELECT *, ([{", ".join(f"'{x}'" for x in _TYPES)}])[(scene_id + len) % 5 + 1] AS answer_type, ([{", ".join(f"'{x}'" for x in _POLICIES)}])[(scene_id * 3 + len) % 5 + 1] AS policy,
    outcome IN ('unknown', 'abstain') AS abstained, CASE WHEN outcome = 'parser_failure' THEN 'unparseable' END AS error,
    list_transform(ids, lambda x: {{'id': x, 'zone': 'zone_' || (string_split(x, '_')[2]::BIGINT % 3)}}) AS given,
    list_transform(range((scene_id + len) % 3), lambda k: CASE WHEN k = 0 THEN {{'id': 'obj_' || (scene_id * 50 + 4 * (len % 9)), 'kind': 'entity'}} ELSE {{'id': 'zone_' || (len % 3), 'kind': 'zone'}} END) AS targets,
    len(ids) AS n FROM given
), c AS (SELECT *, CASE answer_type WHEN 'count' THEN CASE WHEN len % 7 <> 0 THEN n::VARCHAR END WHEN 'yes_no' THEN CASE WHEN len % 7 <> 0 THEN (n > 0)::VARCHAR END END AS actual, CASE answer_type WHEN 'count' THEN (scene_id % 4)::VARCHAR WHEN 'yes_no' THEN (len % 2 = 0)::VARCHAR END AS expected FROM b
), d AS (SELECT *, answer_type IN ('count', 'yes_no') AS scalar, len(targets) AS total, abstained OR n = 0 AS nothing, NOT abstained AND coalesce(actual = expected, FALSE) AS same,
    list_filter(given, lambda a: len(list_filter(targets, lambda t: CASE WHEN t.kind = 'entity' THEN a.id = t.id ELSE a.zone = t.id END)) > 0) AS hits,
    len(list_filter(targets, lambda t: len(list_filter(given, lambda a: CASE WHEN t.kind = 'entity' THEN a.id = t.id ELSE a.zone = t.id END)) > 0)) AS found FROM c
), e AS (SELECT *, CASE WHEN scalar THEN same WHEN total = 0 THEN nothing WHEN abstained THEN FALSE ELSE n > 0 AND len(hits) > 0 AND hits[1] = given[1] END AS top1, CASE WHEN scalar THEN same WHEN total = 0 THEN nothing WHEN abstained THEN FALSE ELSE found > 0 END AS topk,
    CASE WHEN scalar THEN (NOT abstained AND actual IS NOT NULL AND NOT same)::BIGINT WHEN total = 0 THEN n WHEN abstained THEN 0 ELSE n - len(hits) END AS false_positives FROM d
), marks AS (SELECT scene_id, question, answer_type, policy, top1, topk, CASE WHEN scalar THEN same ELSE CASE policy WHEN 'none' THEN nothing WHEN 'abstain_ok' THEN abstained OR found > 0 WHEN 'one_of' THEN found > 0 WHEN 'any_of_subset' THEN found > 0 AND false_positives = 0 ELSE found = total END END AS policy_ok,
    CASE WHEN scalar AND abstained THEN 'wrong_abstain' WHEN scalar OR (total > 0 AND NOT abstained) THEN CASE WHEN topk THEN 'true_answer' ELSE 'miss' END WHEN total = 0 THEN CASE WHEN nothing THEN 'correct_abstain' ELSE 'false_answer' END ELSE 'wrong_abstain' END AS outcome,
    false_positives, CASE WHEN scalar THEN same::BIGINT ELSE found END AS covered, CASE WHEN scalar THEN 1 ELSE total END AS expected_total,
    CASE WHEN error IS NOT NULL THEN 'parser' WHEN scalar THEN CASE WHEN abstained THEN 'abstention' WHEN actual IS NULL THEN 'scene_graph' WHEN same THEN 'none' ELSE 'scorer' END
      WHEN total = 0 THEN CASE WHEN n > 0 THEN 'scorer' ELSE 'none' END WHEN topk THEN CASE WHEN top1 THEN 'none' ELSE 'scorer' END WHEN abstained THEN 'abstention' WHEN n = 0 THEN 'scene_graph' ELSE 'scorer' END AS attribution FROM e)"""


def benchmarked(spark: SparkSession, sf: str) -> DataFrame:
    """Answers scored as a benchmark's, against derived types, policies and targets."""
    told = answers(spark, sf, _BENCH_TEXTS, recall=0.9)
    scene, n = F.col("scene_id"), F.length("question")
    ids = F.filter(F.split(F.coalesce("answers", F.lit("")), ","), lambda x: x != "")
    of = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % 5 + 1).cast("int"))
    target = lambda name, kind: F.struct(name.alias("id"), F.lit(kind).alias("kind"))
    every = F.array(target(F.concat(F.lit("obj_"), (scene * 50 + 4 * (n % 9)).cast("string")), "entity"), target(F.concat(F.lit("zone_"), (n % 3).cast("string")), "zone"))
    given = F.transform(ids, lambda x: F.struct(x.alias("id"), F.concat(F.lit("zone_"), (F.try_element_at(F.split(x, "_"), F.lit(2)).cast("long") % 3).cast("string")).alias("zone")))
    counted, asked_so = F.size(ids), n % 7 != 0
    rows = told.select(
        "scene_id", "question", of(_TYPES, scene + n).alias("answer_type"), of(_POLICIES, scene * 3 + n).alias("policy"), F.col("outcome").isin("unknown", "abstain").alias("abstained"),
        F.when(F.col("outcome") == "parser_failure", "unparseable").alias("error"), given.alias("answers"), F.slice(every, 1, ((scene + n) % 3).cast("int")).alias("targets"), counted.alias("n"),
    )
    scalar = lambda count, yes: F.when(F.col("answer_type") == "count", count.cast("string")).when(F.col("answer_type") == "yes_no", yes.cast("string"))
    rows = rows.withColumns({"actual": F.when(asked_so, scalar(F.col("n"), F.col("n") > 0)), "expected": scalar(scene % 4, n % 2 == 0)})
    return scoring.scored(rows)


@_query(f"WITH {_BENCH} SELECT * FROM marks")
def benchmark_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on every benchmark answer: correctness, policy, abstention, false positives, attribution."""
    return benchmarked(spark, sf).select("scene_id", "question", "answer_type", "policy", "top1", "topk", "policy_ok", "outcome", "false_positives", "covered", "expected_total", "attribution")


@_query(f"""WITH {_BENCH} SELECT coalesce(answer_type, 'overall') AS category, count(*) AS questions, round(avg(top1::INT), 6) AS top1, round(avg(topk::INT), 6) AS topk, round(avg(policy_ok::INT), 6) AS policy_ok, round(avg(false_positives), 6) AS false_positives,
  count(*) FILTER (outcome = 'true_answer') AS true_answers, count(*) FILTER (outcome = 'correct_abstain') AS correct_abstains, count(*) FILTER (outcome = 'wrong_abstain') AS wrong_abstains, count(*) FILTER (outcome = 'false_answer') AS false_answers, count(*) FILTER (outcome = 'miss') AS misses,
  count(*) FILTER (attribution = 'parser') AS parser, count(*) FILTER (attribution = 'scene_graph') AS scene_graph, count(*) FILTER (attribution = 'scorer') AS scorer, count(*) FILTER (attribution = 'abstention') AS abstention FROM marks GROUP BY ROLLUP (answer_type)""")
def benchmark_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's verdicts overall and by category."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    of = lambda column, value, name: F.count_if(F.col(column) == value).alias(name)
    outcomes = {"true_answer": "true_answers", "correct_abstain": "correct_abstains", "wrong_abstain": "wrong_abstains", "false_answer": "false_answers", "miss": "misses"}
    rolled = benchmarked(spark, sf).rollup("answer_type").agg(
        F.count(F.lit(1)).alias("questions"), mean("top1"), mean("topk"), mean("policy_ok"), F.round(F.avg("false_positives"), 6).alias("false_positives"),
        *(of("outcome", k, v) for k, v in outcomes.items()), *(of("attribution", k, k) for k in ("parser", "scene_graph", "scorer", "abstention")),
    )
    return rolled.withColumn("category", F.coalesce("answer_type", F.lit("overall"))).drop("answer_type")


#: The key: a question's true answers are the entities whose loose test passes; here even-numbered ones of the bindings.
def scorecard_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Answers against a key that calls every answer with an even id right, and three more missing."""
    rows = answers(spark, sf, q.BATTERY + DIRECTIONAL).where("outcome in ('bindings', 'empty')")
    cited = F.filter(F.split(F.coalesce("answers", F.lit("")), ","), lambda x: x != "")
    right = F.size(F.filter(cited, lambda x: F.try_element_at(F.split(x, "_"), F.lit(2)).cast("long") % 2 == 0))
    return rows.select("scene_id", "question", F.size(cited).alias("given"), right.alias("right"), (right + F.pmod(F.col("scene_id") + F.length("question"), F.lit(3))).alias("wanted"))


_CARD = f"""{answers_sql(q.BATTERY + DIRECTIONAL)}, c AS (SELECT *, list_filter(string_split(coalesce(answers, ''), ','), lambda x: x <> '') AS given_list FROM answers WHERE outcome IN ('bindings', 'empty')),
k AS (SELECT scene_id, question, len(given_list) AS given, len(list_filter(given_list, lambda x: string_split(x, '_')[2]::BIGINT % 2 = 0)) AS good FROM c), card AS (SELECT *, good + (scene_id + length(question)) % 3 AS wanted FROM k)"""


@_query(f"""WITH {_CARD}, p AS (SELECT scene_id, sum(good) AS hit, sum(given) AS given, sum(wanted) AS wanted, count(*) AS questions, count(*) FILTER (given = 0 AND wanted = 0) AS true_empty FROM card GROUP BY 1)
SELECT scene_id, questions, true_empty, round(hit / nullif(given, 0), 6) AS precision, round(hit / nullif(wanted, 0), 6) AS recall, round(2 * hit / nullif(given + wanted, 0), 6) AS f1 FROM p""")
def router_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    total = scorecard_rows(spark, sf).groupBy("scene_id").agg(F.sum("right").alias("hit"), F.sum("given").alias("given"), F.sum("wanted").alias("wanted"), F.count(F.lit(1)).alias("questions"), F.count_if((F.col("given") == 0) & (F.col("wanted") == 0)).alias("true_empty"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return total.select("scene_id", "questions", "true_empty", ratio(F.col("hit"), F.col("given")).alias("precision"), ratio(F.col("hit"), F.col("wanted")).alias("recall"), ratio(2 * F.col("hit"), F.col("given") + F.col("wanted")).alias("f1"))
