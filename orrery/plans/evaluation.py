"""Evaluation queries over ``events``, ``labels`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators import evaluation as ev

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Events are answers with a confidence; users in groups of 64 are scenes, so groups grow in number with the data.
ITEMS = """items AS (SELECT user_id // 64 AS scene_id, event_id AS id, least(greatest(floor(value * 10) / 1000, 0e0), 1e0) AS confidence, event_id % 3 <> 0 AS correct, event_type = 'error' AS abstained FROM events)"""
CURVE = ITEMS + """, ranked AS (SELECT *, row_number() OVER w AS k, sum((NOT correct)::INT) OVER w AS errors, count(*) OVER (PARTITION BY scene_id) AS total FROM items
  WINDOW w AS (PARTITION BY scene_id ORDER BY abstained, confidence DESC, correct, id ROWS UNBOUNDED PRECEDING)), curve AS (SELECT scene_id, id, k, k / total AS coverage, errors / k AS risk, errors, total FROM ranked)"""
_STATUS = {s: f"CASE WHEN (event_id * {7 + 2 * i} + {i}) % {11 + i} = 0 THEN 'fail' WHEN (event_id * {5 + i}) % {23 + i} = 0 THEN 'abstain' ELSE 'pass' END" for i, s in enumerate(ev.STAGES)}


def items(spark: SparkSession, sf: str) -> DataFrame:
    confidence = F.least(F.greatest(F.floor(F.col("value") * 10) / 1000, F.lit(0.0)), F.lit(1.0))
    return spark.read.parquet(f"{sf}/events.parquet").select(F.floor(F.col("user_id") / 64).cast("long").alias("scene_id"), F.col("event_id").alias("id"), confidence.alias("confidence"), (F.col("event_id") % 3 != 0).alias("correct"), (F.col("event_type") == "error").alias("abstained"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/events.parquet")
    return ev.gated(raw.select("event_id", "event_type", *[F.expr(sql).alias(s) for s, sql in _STATUS.items()]))


def _gated_sql() -> str:
    step, text = "t0", f"t0 AS (SELECT event_id, event_type, {', '.join(f'{sql} AS {s}' for s, sql in _STATUS.items())} FROM events)"
    for i, (stage, needs) in enumerate(ev.NEEDS.items(), 1):
        blocked = " OR ".join(f"{n} IN ('fail', 'abstain', 'not_reached')" for n in needs)
        text += f", t{i} AS (SELECT * REPLACE (CASE WHEN {blocked} THEN 'not_reached' ELSE {stage} END AS {stage}) FROM {step})"
        step = f"t{i}"
    return text + f", traces AS (SELECT * FROM {step})"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query(f"WITH {CURVE} SELECT scene_id, id, k, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM curve")
def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return ev.risk_coverage(items(spark, sf), ["scene_id"]).select("scene_id", "id", F.col("k").cast("long").alias("k"), F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@_query(f"WITH {CURVE}, n AS (SELECT scene_id, max(total) - max(errors) AS correct_n FROM curve GROUP BY 1) SELECT scene_id, round(avg(risk), 5) AS aurc, round(avg(greatest(0e0, (k - correct_n) / k)), 5) AS optimum, round(avg(risk) - avg(greatest(0e0, (k - correct_n) / k)), 5) AS excess FROM curve JOIN n USING (scene_id) GROUP BY 1")
def aurc_report(spark: SparkSession, sf: str) -> DataFrame:
    found = ev.aurc(ev.risk_coverage(items(spark, sf), ["scene_id"]), ["scene_id"])
    return found.select("scene_id", *[F.round(c, 5).alias(c) for c in ("aurc", "optimum", "excess")])


@_query(f"WITH {CURVE}, l AS (SELECT unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0]) AS \"limit\") SELECT scene_id, \"limit\", round(coalesce(max(coverage) FILTER (risk <= \"limit\" + 1e-12), 0), 6) AS coverage FROM curve, l GROUP BY ALL")
def coverage_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    found = ev.coverage_at_risk(ev.risk_coverage(items(spark, sf), ["scene_id"]), ["scene_id"], [0.1, 0.2, 0.3, 0.4])
    return found.select("scene_id", "limit", F.round("coverage", 6).alias("coverage"))


@_query(f"""WITH {ITEMS}, v AS (SELECT scene_id, confidence, count(*) FILTER (correct) AS pos, count(*) FILTER (NOT correct) AS neg FROM items GROUP BY ALL),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY scene_id ORDER BY confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
SELECT scene_id, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auroc FROM w GROUP BY 1""")
def auroc(spark: SparkSession, sf: str) -> DataFrame:
    return ev.auroc(items(spark, sf), ["scene_id"]).select("scene_id", F.round("auroc", 6).alias("auroc"))


_KAPPA = "WITH s AS (SELECT d.source, avg((quality = toxic)::INT) AS o, avg(quality) AS a, avg(toxic) AS b, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1), c AS (SELECT *, a * b + (1 - a) * (1 - b) AS ch FROM s)"


@_query(_KAPPA + " SELECT source, n, CASE WHEN ch < 1 THEN round((o - ch) / (1 - ch), 6) END AS kappa FROM c")
def annotator_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of the two label columns as if two annotators had given them, by source."""
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    return labels.join(docs, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(ev.kappa(F.col("quality"), F.col("toxic")), 6).alias("kappa"))


@_query("SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS only_first, count(*) FILTER (quality = 0 AND toxic = 1) AS only_second, count(*) FILTER (quality = toxic) AS concordant FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def mcnemar_counts(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return labels.join(docs, "doc_id").groupBy("source").agg(F.count_if(q & ~t).alias("only_first"), F.count_if(t & ~q).alias("only_second"), F.count_if(q == t).alias("concordant"))


@_query(f"WITH {_gated_sql()} SELECT * FROM traces")
def stage_traces(spark: SparkSession, sf: str) -> DataFrame:
    return traces(spark, sf)


@_query(f"WITH {_gated_sql()}, l AS ({' UNION ALL '.join(f'SELECT event_type, {i} AS ord, {chr(39)}{s}{chr(39)} AS stage, {s} AS status FROM traces' for i, s in enumerate(ev.STAGES))}) SELECT event_type, ord, stage, count(*) FILTER (status <> 'not_reached') AS reached, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status IN ('fail', 'abstain')) AS failed FROM l GROUP BY ALL")
def survival_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return ev.survival(traces(spark, sf), ["event_type"])


@_query(f"WITH {_gated_sql()} SELECT event_type, CASE {' '.join(f'WHEN {s} IN ({chr(39)}fail{chr(39)}, {chr(39)}abstain{chr(39)}) THEN {chr(39)}{s}{chr(39)}' for s in ev.STAGES)} END AS first_failure, count(*) AS n FROM traces GROUP BY ALL")
def failure_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return ev.first_failure(traces(spark, sf)).groupBy("event_type", "first_failure").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS votes FROM v GROUP BY 1)
SELECT v.user_id, event_type AS modal, round(n / votes, 6) AS share FROM v JOIN t USING (user_id) QUALIFY row_number() OVER (PARTITION BY v.user_id ORDER BY n DESC, event_type) = 1""")
def self_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """The modal vote of each user and its share, ties by name."""
    votes = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("b"), F.sum("n").alias("votes"))
    return best.select("user_id", F.col("b.event_type").alias("modal"), F.round(-F.col("b.m") / F.col("votes"), 6).alias("share"))


@_query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label AS cls, k, avg(x) AS m FROM e GROUP BY ALL),
d AS (SELECT vec_id, cls, sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)) AS cosine FROM e JOIN c USING (k) GROUP BY ALL)
SELECT vec_id, cls, round(cosine, 5) AS cosine, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, cls) AS rank FROM d QUALIFY rank <= 3""")
def label_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three classes whose mean embedding is nearest by cosine; the class means are few and broadcast."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    means = rows.select("label", F.posexplode("e").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    centre = means.groupBy(F.col("label").alias("cls")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = rows.crossJoin(F.broadcast(centre))
    cosine = dot(F.col("e"), F.col("c")) / F.sqrt(dot(F.col("e"), F.col("e"))) / F.sqrt(dot(F.col("c"), F.col("c")))
    order = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "cls")
    ranked = pairs.select("vec_id", "cls", cosine.alias("cosine")).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where("rank <= 3").select("vec_id", "cls", F.round("cosine", 5).alias("cosine"), "rank")


@_query("WITH o AS (SELECT user_id AS entity, least(greatest(value / 100, 0e0), 1e0) AS score FROM events) SELECT entity, round(sum(score), 6) AS support, round(sum(1 - score), 6) AS against, count(*) AS n, round((sum(score) + 1) / (count(*) + 2), 4) AS belief FROM o GROUP BY 1")
def evidence_mass(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming accumulator's aggregate, over the whole table as a batch."""
    from orrery.streaming.evidence import evidence

    seen = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("entity"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return evidence(seen).select("entity", F.round("support", 6).alias("support"), F.round("against", 6).alias("against"), "n", F.round("belief", 4).alias("belief"))


#: Trials of the controls here, and their seed.
TRIALS, SEED = 200, 11
_CONTROLLED = f"""{CURVE}, own AS (SELECT scene_id, avg(risk) AS aurc FROM curve GROUP BY ALL
), typed AS (SELECT i.*, e.event_type AS family FROM items i JOIN events e ON e.event_id = i.id
), known AS (SELECT scene_id, 'none' AS control, id, 0e0 AS rank, correct, abstained FROM typed UNION ALL SELECT scene_id, 'relation', id, avg(correct::INT) OVER (PARTITION BY scene_id, family), correct, abstained FROM typed
), drawn AS (SELECT k.*, t AS trial, rank + {ev.hashed_share_sql("id", "t", SEED)} * {ev.NOISE} AS confidence FROM known k, range({TRIALS}) r(t)
), ordered AS (SELECT scene_id, control, trial, sum((NOT correct)::INT) OVER w / row_number() OVER w AS risk FROM drawn WINDOW w AS (PARTITION BY scene_id, control, trial ORDER BY abstained, confidence DESC, correct, id ROWS UNBOUNDED PRECEDING)
), trials AS (SELECT scene_id, control, trial, avg(risk) AS aurc FROM ordered GROUP BY ALL
), bands AS (SELECT scene_id, control, avg(aurc) AS mean, stddev_pop(aurc) AS stdev, (list(aurc ORDER BY aurc))[{int(ev.LOW * TRIALS) + 1}] AS p05, (list(aurc ORDER BY aurc))[{int(ev.HIGH * TRIALS) + 1}] AS p95 FROM trials GROUP BY ALL)"""


@_query(f"""WITH {_CONTROLLED} SELECT scene_id, control, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round(p05, 6) AS p05, round(p95, 6) AS p95, round(aurc, 6) AS aurc,
  CASE WHEN aurc < p05 THEN 'better' WHEN aurc > p95 THEN 'worse' ELSE 'within' END AS band FROM bands JOIN own USING (scene_id)""")
def random_controls(spark: SparkSession, sf: str) -> DataFrame:
    """The AURC of confidences beside scores that know nothing, and scores that know each event type's accuracy."""
    every = items(spark, sf)
    types = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("family"))
    typed = every.join(types, "id")
    ranks = ev.observed_ranks(typed, ["scene_id"], "family")
    none = every.select("scene_id", F.lit("none").alias("control"), "id", F.lit(0.0).alias("rank"), "correct", "abstained")
    known = typed.join(ranks, ["scene_id", "family"]).select("scene_id", F.lit("relation").alias("control"), "id", "rank", "correct", "abstained")
    bands = ev.random_control(none.unionByName(known), ["scene_id", "control"], TRIALS, SEED)
    own = ev.aurc(ev.risk_coverage(every, ["scene_id"]), ["scene_id"]).select("scene_id", "aurc")
    told = bands.join(own, "scene_id").withColumn("band", ev.band(F.col("aurc")))
    return told.select("scene_id", "control", "band", *[F.round(k, 6).alias(k) for k in ("mean", "stdev", "p05", "p95", "aurc")])
