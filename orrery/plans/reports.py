"""Reports over relations and answers: telemetry, challenges, paraphrases, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import geometry as g
from orrery.operators import reasoner as q
from orrery.operators import relations as r
from orrery.plans import questions as qa
from orrery.plans import relations as rel
from orrery.plans.scene import entities, surfaces
from orrery.sources.tables import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Groups of ways to ask the same; the first is the canonical one.
PARAPHRASES = (
    ("near_lamp", "what is near the lamp?", "what's next to the lamp", "What is close to lamp?"),
    ("below_table", "what is below the table?", "what is under the table", "what is beneath the table?"),
    ("on_chair", "what is on the chair?", "what's on the seat?", "What is on chair"),
)


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@_query(f"""WITH {rel.TESTED}, t AS (SELECT scene_id, surface_type, distance <= {rel._LIMIT} AS plane, sqrt(distance ** 2 + plane_gap ** 2) <= {rel._LIMIT} AS rect, {rel._REST_OK} AS resting FROM tests)
SELECT scene_id, surface_type, count(*) FILTER (plane) AS plane_edges, count(*) FILTER (rect) AS rect_edges, count(*) FILTER (plane AND NOT rect) AS clipped, count(*) FILTER (resting) AS resting FROM t GROUP BY ALL""")
def surface_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Edges to planes and to rectangles, those that clipping removes, and resting contacts, by type of surface."""
    e, s = entities(spark, sf), surfaces(spark, sf)
    key = ["scene_id", "src", "dst"]
    plane = r.near_surface(e, s).select(*key, F.lit(True).alias("plane"))
    rect = r.near_surface(e, s, polygons=True).select(*key, F.lit(True).alias("rect"))
    rest = r.on_surface_tests(e, s).select(*key, "ok")
    every = rest.join(plane, key, "left").join(rect, key, "left").join(s.select("scene_id", F.col("surface").alias("dst"), "surface_type"), ["scene_id", "dst"])
    has, clip = F.col("plane").isNotNull(), F.col("rect").isNotNull()
    return every.groupBy("scene_id", "surface_type").agg(F.count_if(has).alias("plane_edges"), F.count_if(clip).alias("rect_edges"), F.count_if(has & ~clip).alias("clipped"), F.count_if("ok").alias("resting"))


@_query(f"""WITH {rel.PRELUDE}, one AS (SELECT scene_id, cls, min(ord) AS ord FROM ent GROUP BY ALL), p AS (
  SELECT a.scene_id, a.cls AS subject, b.cls AS object, {rel._CDIST} AS d FROM one x JOIN ent a USING (scene_id, ord) JOIN one y ON y.scene_id = x.scene_id AND y.ord <> x.ord JOIN ent b ON b.scene_id = y.scene_id AND b.ord = y.ord)
SELECT scene_id, subject, object, d < 1 AS near, row_number() OVER (PARTITION BY scene_id, subject ORDER BY d, object) = 1 AS nearest FROM p""")
def near_challenge(spark: SparkSession, sf: str) -> DataFrame:
    """Binary and comparative nearness between the first entities of each class in a scene."""
    e = settled(entities(spark, sf), "entities")
    one = e.groupBy("scene_id", "cls").agg(F.min("ord").alias("ord")).select("scene_id", "ord")
    named = e.join(one, ["scene_id", "ord"], "left_semi")
    side = lambda k: named.select("scene_id", F.struct(*named.columns).alias(k))
    pairs = side("a").join(side("b"), "scene_id").where("a.ord <> b.ord").withColumn("d", g.centroid_distance("a", "b"))
    order = Window.partitionBy("scene_id", "a.cls").orderBy("d", "b.cls")
    return pairs.select("scene_id", F.col("a.cls").alias("subject"), F.col("b.cls").alias("object"), (F.col("d") < 1).alias("near"), (F.row_number().over(order) == 1).alias("nearest"))


_TEXTS = tuple(t for _, *texts in PARAPHRASES for t in texts)
_GROUPS = ", ".join(f"('{name}', '{t.replace(chr(39), chr(39) * 2)}', {i})" for name, *texts in PARAPHRASES for i, t in enumerate(texts))


@_query(f"""WITH {qa.answers_sql(_TEXTS)}, g AS (SELECT * FROM (VALUES {_GROUPS}) v(group_id, question, i)), a AS (SELECT group_id, scene_id, i, outcome, coalesce(answers, '') AS answers FROM answers JOIN g USING (question)),
c AS (SELECT a.group_id, a.scene_id, a.outcome <> 'parser_failure' AS compiled, a.answers = k.answers AND a.outcome = k.outcome AS same FROM a JOIN a k ON k.group_id = a.group_id AND k.scene_id = a.scene_id AND k.i = 0 WHERE a.i > 0)
SELECT group_id, scene_id, count(*) AS n, count(*) FILTER (compiled) AS compiled, count(*) FILTER (same) AS consistent FROM c GROUP BY ALL""")
def paraphrase_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Of each group's paraphrases, how many compile and how many are answered as the canonical question is."""
    groups = spark.createDataFrame([(name, t, i) for name, *texts in PARAPHRASES for i, t in enumerate(texts)], "group_id string, question string, i int")
    found = qa.answers(spark, sf, _TEXTS).select("scene_id", "question", "outcome", F.coalesce("answers", F.lit("")).alias("answers"))
    rows = settled(found.join(F.broadcast(groups), "question"), "paraphrases")
    first = rows.where("i = 0").select("scene_id", "group_id", F.col("outcome").alias("outcome0"), F.col("answers").alias("answers0"))
    same = (F.col("answers") == F.col("answers0")) & (F.col("outcome") == F.col("outcome0"))
    return rows.where("i > 0").join(first, ["scene_id", "group_id"]).groupBy("group_id", "scene_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") != "parser_failure").alias("compiled"), F.count_if(same).alias("consistent"))


@_query(f"""WITH {qa.answers_sql(q.BATTERY + qa.ODD)} SELECT CASE WHEN grouping(scene_id) = 1 THEN -1 ELSE scene_id END AS scene_id, outcome, count(*) AS questions, sum(n)::BIGINT AS answers FROM answers GROUP BY GROUPING SETS ((outcome), (scene_id, outcome))""")
def outcome_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes over all scenes (scene -1) and by scene, in one pass."""
    rows = qa.answers(spark, sf, q.BATTERY + qa.ODD).select("scene_id", "outcome", "n")
    total = rows.groupingSets([["outcome"], ["scene_id", "outcome"]], "scene_id", "outcome").agg(F.grouping("scene_id").alias("all"), F.count(F.lit(1)).alias("questions"), F.sum("n").alias("answers"))
    return total.select(F.when(F.col("all") == 1, -1).otherwise(F.col("scene_id")).alias("scene_id"), "outcome", "questions", "answers")
