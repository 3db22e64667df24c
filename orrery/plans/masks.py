"""Mask queries: proposals are runs of vertices derived from the ``part`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.digests import ids_sha256_sql
from orrery.operators import masks as m
from orrery.sources.tables import apart, settled, tasks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Parts of 200 consecutive keys are the proposals of a scene of 1,500 vertices.
PER_SCENE, SPACE = 200, 1500
PRELUDE = f"""
prop AS (SELECT (p_partkey // {PER_SCENE})::BIGINT AS scene_id, p_partkey AS p, round(p_retailprice / 2100, 4) AS score, (p_partkey * 37) % {SPACE} AS start, 20 + 4 * p_size AS len FROM part
), mask AS (SELECT scene_id, p, unnest(range(start, start + len)) AS v FROM prop
), size AS (SELECT scene_id, p, count(*) AS size FROM mask GROUP BY ALL
), pairs AS (SELECT scene_id, a.p, b.p AS q, count(*) AS shared FROM mask a JOIN mask b USING (scene_id, v) WHERE a.p < b.p GROUP BY ALL
), over AS (SELECT o.scene_id, o.p, o.q, shared, a.size AS size_p, b.size AS size_q, shared / (a.size + b.size - shared) AS iou, shared / least(a.size, b.size) AS contained
  FROM pairs o JOIN size a ON a.scene_id = o.scene_id AND a.p = o.p JOIN size b ON b.scene_id = o.scene_id AND b.p = o.q
), seen AS (SELECT scene_id, v, view FROM (SELECT DISTINCT scene_id, v FROM mask), range(8) r(view) WHERE (v + view * 29) % 10 < 7
), views AS (SELECT scene_id, p % 8 AS view, p AS mask, v FROM mask WHERE (v + (p % 8) * 29) % 10 < 7
), truth AS (SELECT DISTINCT scene_id, v // 60 AS p, v FROM mask)"""


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").select(F.floor(key / PER_SCENE).cast("long").alias("scene_id"), key.alias("p"), F.round(F.col("p_retailprice") / 2100, 4).alias("score"), (key * 37 % SPACE).alias("start"), (20 + 4 * F.col("p_size")).cast("long").alias("len"))


def masks(spark: SparkSession, sf: str) -> DataFrame:
    # a proposal has a hundred vertices, so the few rows of the file are dealt to more tasks first
    return proposals(spark, sf).repartition(tasks(spark), "scene_id").select("scene_id", "p", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("v"))


def visible(spark: SparkSession, sf: str, raw: DataFrame | None = None) -> DataFrame:
    every = (masks(spark, sf) if raw is None else raw).select("scene_id", "v").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("view"))
    return every.where((F.col("v") + F.col("view") * 29) % 10 < 7)


def view_masks(spark: SparkSession, sf: str, raw: DataFrame | None = None) -> DataFrame:
    own = (masks(spark, sf) if raw is None else raw).select("scene_id", (F.col("p") % 8).alias("view"), F.col("p").alias("mask"), "v")
    return own.where((F.col("v") + F.col("view") * 29) % 10 < 7)


def truths(spark: SparkSession, sf: str) -> DataFrame:
    return masks(spark, sf).select("scene_id", F.floor(F.col("v") / 60).cast("long").alias("p"), "v").distinct()


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _resolved(least: str, extra: str = "") -> str:
    return f"""best AS (SELECT scene_id, v, p{extra} FROM mask JOIN prop USING (scene_id, p){' , k' if extra else ''} WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY scene_id, v{extra} ORDER BY score DESC, p) = 1
), inst AS (SELECT scene_id{extra}, p, count(*) AS n FROM best GROUP BY ALL HAVING count(*) >= 20)"""


@_query(f"WITH {PRELUDE}, {_resolved('0.2')} SELECT b.scene_id, b.v, b.p FROM best b SEMI JOIN inst i ON i.scene_id = b.scene_id AND i.p = b.p")
def mask_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return m.resolve(masks(spark, sf), proposals(spark, sf))


@_query(f"WITH {PRELUDE}, k AS (SELECT unnest([0.2e0, 0.5e0, 0.7e0]) AS least), {_resolved('least', ', least')} SELECT scene_id, least, count(*) AS instances, sum(n)::BIGINT AS vertices FROM inst GROUP BY ALL")
def mask_resolve_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Instances and vertices left as the least score rises."""
    out = None
    for least in (0.2, 0.5, 0.7):
        one = m.sizes(m.resolve(masks(spark, sf), proposals(spark, sf), least)).groupBy("scene_id").agg(F.count(F.lit(1)).alias("instances"), F.sum("size").alias("vertices")).select("scene_id", F.lit(least).alias("least"), "instances", "vertices")
        out = one if out is None else out.unionByName(one)
    return out


@_query(f"WITH {PRELUDE} SELECT scene_id, p, q, shared, size_p, size_q, round(iou, 6) AS iou, round(contained, 6) AS contained FROM over")
def mask_iou(spark: SparkSession, sf: str) -> DataFrame:
    return m.overlaps(masks(spark, sf)).select("scene_id", "p", "q", "shared", "size_p", "size_q", F.round("iou", 6).alias("iou"), F.round("contained", 6).alias("contained"))


_AGREE = """part AS (SELECT scene_id, p, view, count(*) AS seen FROM mask JOIN seen USING (scene_id, v) GROUP BY ALL
), obs AS (SELECT * FROM part JOIN size USING (scene_id, p) WHERE seen >= 0.5 * size
), met AS (SELECT scene_id, m.p, view, w.mask, count(*) AS shared FROM mask m JOIN views w USING (scene_id, v) GROUP BY ALL
), ms AS (SELECT scene_id, view, mask, count(*) AS mask_size FROM views GROUP BY ALL
), best AS (SELECT o.scene_id, o.p, o.view, max(shared / (seen + mask_size - shared)) AS iou FROM obs o JOIN met USING (scene_id, p, view) JOIN ms USING (scene_id, view, mask) GROUP BY ALL
), ranked AS (SELECT o.scene_id, o.p, coalesce(iou, 0) AS iou, row_number() OVER (PARTITION BY o.scene_id, o.p ORDER BY coalesce(iou, 0) DESC, o.view) AS n FROM obs o LEFT JOIN best b ON b.scene_id = o.scene_id AND b.p = o.p AND b.view = o.view
), signal AS (SELECT scene_id, p, avg(iou) FILTER (n <= 3) AS agreement, avg((iou >= 0.5)::INT) AS support FROM ranked GROUP BY ALL
), both_ways AS (SELECT scene_id, p, q AS o FROM over WHERE contained >= 0.8 UNION ALL SELECT scene_id, q, p FROM over WHERE contained >= 0.8
), nest AS (SELECT x.scene_id, x.p, count(*) AS nested FROM both_ways x JOIN signal a ON a.scene_id = x.scene_id AND a.p = x.p JOIN signal b ON b.scene_id = x.scene_id AND b.p = x.o
  WHERE round(b.agreement, 9) > round(a.agreement, 9) OR (round(b.agreement, 9) = round(a.agreement, 9) AND x.o < x.p) GROUP BY ALL)"""


def _signal(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The masks, and how far views agree with them; both are settled, as several joins use them."""
    raw = settled(masks(spark, sf), "masks")
    found = m.agreement(raw, visible(spark, sf, raw), view_masks(spark, sf, raw)).withColumn("agreement", F.round("agreement", 9))
    return raw, settled(found, "agreement")


@_query(f"WITH {PRELUDE}, {_AGREE} SELECT scene_id, p, round(agreement, 4) AS agreement, round(support, 4) AS support, coalesce(nested, 0) AS nested FROM signal LEFT JOIN nest USING (scene_id, p)")
def mask_nesting(spark: SparkSession, sf: str) -> DataFrame:
    raw, signal = _signal(spark, sf)
    nested = m.nesting(m.overlaps(raw), signal)
    return signal.join(apart(nested), ["scene_id", "p"], "left").select("scene_id", "p", F.round("agreement", 4).alias("agreement"), F.round("support", 4).alias("support"), F.coalesce("nested", F.lit(0)).cast("long").alias("nested"))


_PRIOR = "CASE WHEN size / 100 <= 0.03 OR size / 100 >= 2.6 THEN 0 WHEN size / 100 < 0.1 THEN (size / 100 - 0.03e0) / 0.07e0 WHEN size / 100 > 2 THEN (2.6e0 - size / 100) / 0.6e0 ELSE 1 END"


@_query(f"WITH {PRELUDE}, {_AGREE} SELECT scene_id, p, round(agreement * (0.3e0 + 0.7e0 * ({_PRIOR})) * (0.3e0 + 0.7e0 * exp(-0.5e0 * coalesce(nested, 0))), 4) AS score FROM signal JOIN size USING (scene_id, p) LEFT JOIN nest USING (scene_id, p)")
def proposal_scores(spark: SparkSession, sf: str) -> DataFrame:
    raw, signal = _signal(spark, sf)
    nested = m.nesting(m.overlaps(raw), signal)
    rows = signal.join(apart(m.sizes(raw)), ["scene_id", "p"]).join(apart(nested), ["scene_id", "p"], "left")
    score = F.col("agreement") * m.gate(m.size_prior(F.col("size") / 100)) * m.gate(F.exp(-0.5 * F.coalesce("nested", F.lit(0))))
    return rows.select("scene_id", "p", F.round(score, 4).alias("score"))


@_query(f"""WITH {PRELUDE}, v AS (SELECT DISTINCT scene_id, v FROM mask), e AS (SELECT a.scene_id, a.v AS a, b.v AS b FROM v a JOIN v b ON a.scene_id = b.scene_id AND b.v = a.v + 1)
, c AS (SELECT e.scene_id, a, b, count(DISTINCT s.view) AS seen FROM e JOIN seen s ON s.scene_id = e.scene_id AND s.v = a JOIN seen t ON t.scene_id = e.scene_id AND t.v = b AND t.view = s.view GROUP BY ALL)
, h AS (SELECT e.scene_id, a, b, count(DISTINCT s.view) AS held FROM e JOIN views s ON s.scene_id = e.scene_id AND s.v = a JOIN views t ON t.scene_id = e.scene_id AND t.v = b AND t.view = s.view AND t.mask = s.mask GROUP BY ALL)
SELECT scene_id, a, b, round(coalesce(held, 0) / seen, 6) AS confidence FROM c LEFT JOIN h USING (scene_id, a, b)""")
def edge_confidence(spark: SparkSession, sf: str) -> DataFrame:
    v = masks(spark, sf).select("scene_id", "v").distinct()
    edges = v.select("scene_id", F.col("v").alias("a"), (F.col("v") + 1).alias("b")).join(apart(v.select("scene_id", F.col("v").alias("b"))), ["scene_id", "b"])
    return m.edge_confidence(edges, visible(spark, sf), view_masks(spark, sf)).select("scene_id", "a", "b", F.round("confidence", 6).alias("confidence"))


_TRUE = "ts AS (SELECT scene_id, p, count(*) AS size FROM truth GROUP BY ALL), tp AS (SELECT scene_id, a.p, b.p AS q, count(*) AS shared FROM mask a JOIN truth b USING (scene_id, v) GROUP BY ALL), ti AS (SELECT t.scene_id, t.p, t.q, shared / (a.size + b.size - shared) AS iou FROM tp t JOIN size a ON a.scene_id = t.scene_id AND a.p = t.p JOIN ts b ON b.scene_id = t.scene_id AND b.p = t.q)"


@_query(f"""WITH {PRELUDE}, {_TRUE}, r AS (SELECT scene_id, p, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, p) AS rank FROM prop), f AS (SELECT scene_id, q, min(rank) AS rank FROM ti JOIN r USING (scene_id, p) WHERE iou >= 0.5 GROUP BY ALL),
g AS (SELECT scene_id, total, k FROM (SELECT scene_id, count(DISTINCT p) AS total FROM truth GROUP BY 1), (SELECT unnest([10, 25, 50, 100, 200]) AS k)) SELECT g.scene_id, k, round(count(*) FILTER (rank <= k) / total, 6) AS recall FROM g LEFT JOIN f ON f.scene_id = g.scene_id GROUP BY g.scene_id, k, total""")
def ar_at_k(spark: SparkSession, sf: str) -> DataFrame:
    pairs = m.overlaps(masks(spark, sf), truths(spark, sf))
    return m.recall_at(pairs, proposals(spark, sf), truths(spark, sf), (10, 25, 50, 100, 200))




def _fold(name: str, ranked: str) -> str:
    """A greedy one-to-one choice in SQL: ``ranked`` has scene_id, p, q, n (1, 2, ... in the order of choice)."""
    return f"""{name}_fold AS (
  SELECT scene_id, 0::BIGINT AS n, NULL::BIGINT AS p, NULL::BIGINT AS q, []::BIGINT[] AS ps, []::BIGINT[] AS qs FROM (SELECT DISTINCT scene_id FROM {ranked})
  UNION ALL SELECT f.scene_id, r.n, CASE WHEN free THEN r.p END, CASE WHEN free THEN r.q END, CASE WHEN free THEN list_append(ps, r.p) ELSE ps END, CASE WHEN free THEN list_append(qs, r.q) ELSE qs END
  FROM {name}_fold f JOIN {ranked} r ON r.scene_id = f.scene_id AND r.n = f.n + 1, LATERAL (SELECT NOT list_contains(ps, r.p) AND NOT list_contains(qs, r.q) AS free)
), {name} AS (SELECT scene_id, p, q FROM {name}_fold WHERE p IS NOT NULL)"""


#: What is left after resolution, its overlaps with the true objects, and their one-to-one matches by overlap.
_FINAL = f"""{PRELUDE}, {_TRUE}, {_resolved('0.2')}, fin AS (SELECT b.* FROM best b SEMI JOIN inst i ON i.scene_id = b.scene_id AND i.p = b.p), fs AS (SELECT scene_id, p, count(*) AS size FROM fin GROUP BY ALL
), fp AS (SELECT scene_id, f.p, t.p AS q, count(*) AS shared FROM fin f JOIN truth t USING (scene_id, v) GROUP BY ALL
), fi AS (SELECT p.*, s.size AS size_p, t.size AS size_q, shared / (s.size + t.size - shared) AS iou FROM fp p JOIN fs s ON s.scene_id = p.scene_id AND s.p = p.p JOIN ts t ON t.scene_id = p.scene_id AND t.p = p.q
), fr AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY shared DESC, p, q) AS n FROM fi
), {_fold('chosen', 'fr')}, match AS (SELECT c.*, i.shared, i.iou FROM chosen c JOIN fi i USING (scene_id, p, q))"""
#: Classes of true objects, by number; walls and floors are no entities.
_CLASSES = ("table", "desk", "chair", "cup", "lamp", "wall", "book", "sofa", "floor", "rug")
_STRUCTURAL = ("wall", "floor")
_OWNERS = ("table", "desk", "chair", "sofa")
_CLASS_SQL = f"([{', '.join(repr(c) for c in _CLASSES)}])[q % {len(_CLASSES)} + 1]"


def _class(q: str = "q"):
    return F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col(q) % len(_CLASSES) + 1).cast("int"))


def _final(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Overlaps of the resolved masks with the true objects, and their matches, settled."""
    pairs = settled(m.overlaps(m.resolve(masks(spark, sf), proposals(spark, sf)), truths(spark, sf)), "overlaps")
    return pairs, settled(m.greedy_matches(pairs, 0.0, "shared"), "matches")


@_query(f"WITH RECURSIVE {_FINAL} SELECT scene_id, p, q, shared, round(iou, 6) AS iou FROM match")
def overlap_matches(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one matches of predictions and true objects, most shared vertices first."""
    return _final(spark, sf)[1].select("scene_id", "p", "q", "shared", F.round("iou", 6).alias("iou"))


@_query(f"""WITH RECURSIVE {_FINAL}, o AS (SELECT scene_id, p AS q, {_CLASS_SQL.replace('q %', 'p %')} AS cls FROM ts), j AS (SELECT o.*, coalesce(iou, 0) AS iou FROM o LEFT JOIN match k ON k.scene_id = o.scene_id AND k.q = o.q WHERE cls NOT IN ('wall', 'floor')),
g AS (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS least)
SELECT scene_id, least, count(*) AS entities, count(*) FILTER (iou >= least) AS matched, round(avg((iou >= least)::INT), 6) AS recall, round(avg((iou >= least)::INT) FILTER (cls IN ('table', 'desk', 'chair', 'sofa')), 6) AS owner_recall FROM j, g GROUP BY ALL""")
def exact_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of true entities, and of furniture that carries things, at three IoUs; null where there are none."""
    _, matches = _final(spark, sf)
    known = m.sizes(truths(spark, sf)).withColumnRenamed("p", "q").withColumn("cls", _class()).where(~F.col("cls").isin(*_STRUCTURAL)).join(apart(matches.select("scene_id", "q", "iou")), ["scene_id", "q"], "left")
    grid = known.select("*", F.explode(F.expr("array(0.25D, 0.5D, 0.75D)")).alias("least"))
    hit = F.coalesce("iou", F.lit(0.0)) >= F.col("least")
    share = lambda only: F.round(F.avg(F.when(only, hit.cast("int"))), 6)
    return grid.groupBy("scene_id", "least").agg(F.count(F.lit(1)).alias("entities"), F.count_if(hit).alias("matched"), share(F.lit(True)).alias("recall"), share(F.col("cls").isin(*_OWNERS)).alias("owner_recall"))


@_query(f"""WITH RECURSIVE {_FINAL}, s AS (SELECT * FROM fi WHERE shared >= 0.1e0 * size_q)
SELECT scene_id, (SELECT count(*) FROM (SELECT q FROM s WHERE s.scene_id = x.scene_id GROUP BY q HAVING count(*) > 1)) AS split, (SELECT count(*) FROM (SELECT p FROM s WHERE s.scene_id = x.scene_id GROUP BY p HAVING count(*) > 1)) AS merging FROM (SELECT DISTINCT scene_id FROM fi) x""")
def over_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    """True objects that are split and predictions that merge, at a tenth of the object."""
    return m.split_and_merged(_final(spark, sf)[0])


_COVER = """top AS (SELECT scene_id, q, p AS top, shared AS most FROM fi QUALIFY row_number() OVER (PARTITION BY scene_id, q ORDER BY shared DESC, p) = 1
), cover AS (SELECT t.scene_id, t.p AS q, t.size, x.top, round(coalesce(most / t.size, 0), 4) AS covered, k.p AS match, round(coalesce(k.iou, 0), 4) AS match_iou FROM ts t LEFT JOIN top x ON x.scene_id = t.scene_id AND x.q = t.p LEFT JOIN match k ON k.scene_id = t.scene_id AND k.q = t.p)"""


@_query(f"WITH RECURSIVE {_FINAL}, {_COVER} SELECT * FROM cover")
def oracle_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """For each true object, the prediction that has most of it, matched or not."""
    pairs, matches = _final(spark, sf)
    return m.coverage(pairs, truths(spark, sf), matches)


@_query(f"""WITH RECURSIVE {_FINAL}, {_COVER}, w AS (SELECT scene_id, q, max(iou) AS raw FROM ti GROUP BY ALL)
SELECT c.scene_id, c.q, CASE WHEN match_iou >= 0.5 THEN 'recovered' WHEN covered >= 0.5 AND o.q IS NOT NULL AND o.q <> c.q THEN 'merged' WHEN coalesce(raw, 0) >= 0.5 THEN 'lost_by_resolver' ELSE 'no_raw_proposal' END AS class
FROM cover c LEFT JOIN match o ON o.scene_id = c.scene_id AND o.p = c.top LEFT JOIN w ON w.scene_id = c.scene_id AND w.q = c.q WHERE {_CLASS_SQL.replace('q %', 'c.q %')} NOT IN ('wall', 'floor')""")
def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Why each true entity is or is not found: matched, swallowed by another's prediction, lost in resolution, or never proposed."""
    pairs, matches = _final(spark, sf)
    best_raw = m.overlaps(masks(spark, sf), truths(spark, sf)).groupBy("scene_id", "q").agg(F.max("iou").alias("raw_iou"))
    return m.failures(m.coverage(pairs, truths(spark, sf), matches), matches, best_raw).where(~_class().isin(*_STRUCTURAL))


def faces(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles of consecutive vertices; a face's object is that of its first vertex, or of the next block for every seventh."""
    v = F.col("v")
    first = masks(spark, sf).select("scene_id", "v").distinct()
    return first.select("scene_id", F.array(v, v + 1, v + 2).alias("corners"), F.floor((v + F.when(v % 7 == 0, 60).otherwise(0)) / 60).cast("long").alias("o"))


_FACES = "face AS (SELECT scene_id, [v, v + 1, v + 2] AS corners, (v + CASE WHEN v % 7 = 0 THEN 60 ELSE 0 END) // 60 AS o FROM (SELECT DISTINCT scene_id, v FROM mask))"


@_query(f"""WITH {PRELUDE}, {_FACES}, e AS (SELECT scene_id, unnest(corners) AS v, o FROM face), c AS (SELECT scene_id, v, o, count(*) AS n FROM e GROUP BY ALL)
SELECT scene_id, v, o FROM c QUALIFY row_number() OVER (PARTITION BY scene_id, v ORDER BY n DESC, o) = 1""")
def vertex_membership(spark: SparkSession, sf: str) -> DataFrame:
    return m.vertex_membership(faces(spark, sf))


@_query(f"""WITH {PRELUDE}, {_FACES}, e AS (SELECT scene_id, unnest([[corners[1], corners[2]], [corners[2], corners[3]], [corners[3], corners[1]]]) AS s FROM face)
SELECT DISTINCT scene_id, least(s[1], s[2]) AS a, greatest(s[1], s[2]) AS b FROM e WHERE s[1] <> s[2]""")
def mesh_edges(spark: SparkSession, sf: str) -> DataFrame:
    return m.mesh_edges(faces(spark, sf))


@_query(f"WITH {PRELUDE} SELECT scene_id, view, p AS mask, count(DISTINCT v) AS vertices FROM (SELECT m.scene_id, p % 8 AS view, p, m.v FROM mask m) x SEMI JOIN seen s ON s.scene_id = x.scene_id AND s.view = x.view AND s.v = x.v GROUP BY ALL HAVING count(DISTINCT v) >= 20")
def lifted_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices of each view's mask once it is lifted to what the view sees."""
    whole = masks(spark, sf).select("scene_id", (F.col("p") % 8).alias("view"), F.col("p").alias("mask"), "v")
    return m.lifted_words(whole, visible(spark, sf)).groupBy("scene_id", "view", "mask").agg(F.max("size").alias("vertices"))


@_query(f"""WITH RECURSIVE {PRELUDE}, clash AS (SELECT scene_id, p, q FROM over WHERE iou >= 0.8 UNION ALL SELECT scene_id, q, p FROM over WHERE iou >= 0.8), rival AS (SELECT scene_id, p, list(q) AS qs FROM clash GROUP BY ALL),
r AS (SELECT x.scene_id, x.p, coalesce(qs, []::BIGINT[]) AS qs, row_number() OVER (PARTITION BY x.scene_id ORDER BY score DESC, size DESC, x.p) AS n FROM prop x JOIN size USING (scene_id, p) LEFT JOIN rival USING (scene_id, p)),
f AS (SELECT scene_id, 0::BIGINT AS n, NULL::BIGINT AS p, []::BIGINT[] AS ps FROM (SELECT DISTINCT scene_id FROM r)
  UNION ALL SELECT f.scene_id, r.n, CASE WHEN NOT list_has_any(ps, qs) THEN r.p END, CASE WHEN NOT list_has_any(ps, qs) THEN list_append(ps, r.p) ELSE ps END FROM f JOIN r ON r.scene_id = f.scene_id AND r.n = f.n + 1)
SELECT scene_id, p FROM f WHERE p IS NOT NULL""")
def bank_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return m.bank(masks(spark, sf), proposals(spark, sf), 0.8)


@_query(f"""WITH RECURSIVE {PRELUDE}, {_TRUE}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY iou DESC, p, q) AS n FROM ti WHERE iou >= 0.3), {_fold('chosen', 'r')}
SELECT scene_id, p, q, round(iou, 6) AS iou FROM chosen JOIN ti USING (scene_id, p, q)""")
def iou_match(spark: SparkSession, sf: str) -> DataFrame:
    return m.greedy_matches(m.overlaps(masks(spark, sf), truths(spark, sf))).select("scene_id", "p", "q", F.round("iou", 6).alias("iou"))


_CHAIN = f"""WITH {PRELUDE}, v AS (SELECT DISTINCT scene_id, v FROM mask), e AS (SELECT a.scene_id, a.v AS a, b.v AS b FROM v a JOIN v b ON a.scene_id = b.scene_id AND b.v = a.v + 1)
, c AS (SELECT e.scene_id, a, b, count(DISTINCT s.view) AS seen FROM e JOIN seen s ON s.scene_id = e.scene_id AND s.v = a JOIN seen t ON t.scene_id = e.scene_id AND t.v = b AND t.view = s.view GROUP BY ALL)
, h AS (SELECT e.scene_id, a, b, count(DISTINCT s.view) AS held FROM e JOIN views s ON s.scene_id = e.scene_id AND s.v = a JOIN views t ON t.scene_id = e.scene_id AND t.v = b AND t.view = s.view AND t.mask = s.mask GROUP BY ALL)
, k AS (SELECT scene_id, a, b FROM c LEFT JOIN h USING (scene_id, a, b) WHERE coalesce(held, 0) / seen >= 0.5)
, i AS (SELECT scene_id, a, b, sum((gap)::INT) OVER (PARTITION BY scene_id ORDER BY a) AS island FROM (SELECT *, coalesce(a <> lag(b) OVER (PARTITION BY scene_id ORDER BY a), TRUE) AS gap FROM k))
, n AS (SELECT scene_id, island, a AS v FROM i UNION SELECT scene_id, island, b FROM i)"""


#: The edges are between consecutive vertices, so SQL reads components off as islands.
@_query(f"{_CHAIN} SELECT scene_id, v, min(v) OVER (PARTITION BY scene_id, island) AS root FROM n")
def components(spark: SparkSession, sf: str) -> DataFrame:
    v = masks(spark, sf).select("scene_id", "v").distinct()
    edges = v.select("scene_id", F.col("v").alias("a"), (F.col("v") + 1).alias("b")).join(apart(v.select("scene_id", F.col("v").alias("b"))), ["scene_id", "b"])
    return m.mesh_components(m.edge_confidence(edges, visible(spark, sf), view_masks(spark, sf)))


_POLICY = f"""{", ".join(f"{n}_best AS (SELECT scene_id, v, p FROM mask JOIN prop USING (scene_id, p) WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY scene_id, v ORDER BY score DESC, p) = 1), {n} AS (SELECT scene_id, p, count(*) AS n FROM {n}_best GROUP BY ALL HAVING count(*) >= 20)" for n, least in (('hard', '0.48e0'), ('unsure', '0.45e0'), ('wide', '0e0')))}, view AS (
  SELECT x.scene_id, x.p, score, CASE WHEN score >= 0.48e0 THEN 'accepted' WHEN score >= 0.45e0 THEN 'provisional' ELSE 'discarded' END AS state, size AS raw, coalesce(h.n, 0) AS hard, coalesce(u.n, 0) AS assigned, coalesce(w.n, 0) AS inclusive
  FROM prop x JOIN size USING (scene_id, p) LEFT JOIN hard h USING (scene_id, p) LEFT JOIN unsure u USING (scene_id, p) LEFT JOIN wide w USING (scene_id, p))"""


@_query(f"""WITH {PRELUDE}, {_POLICY} SELECT scene_id, p, score, state, raw, hard, assigned, inclusive, round(assigned / raw, 6) AS association, round(1 - score, 4) AS negative, state = 'provisional' AND assigned > 0 AS candidate, state <> 'discarded' AND hard = 0 AS raw_candidate FROM view""")
def policy_view(spark: SparkSession, sf: str) -> DataFrame:
    """Each proposal's state, what it wins among the accepted, the provisional and all, and whether it may be activated."""
    view = m.policy_view(masks(spark, sf), proposals(spark, sf), 0.48, 0.45)
    return view.select("scene_id", "p", "score", "state", "raw", "hard", "assigned", "inclusive", F.round("association", 6).alias("association"), F.round("negative", 4).alias("negative"), "candidate", "raw_candidate")


@_query(f"""WITH {PRELUDE}, {_POLICY} SELECT b.scene_id, b.v, b.p FROM unsure_best b JOIN unsure u USING (scene_id, p) JOIN view w USING (scene_id, p) WHERE state = 'accepted' OR (state = 'provisional' AND p % 2 = 0)""")
def policy_activation(spark: SparkSession, sf: str) -> DataFrame:
    """The assignment with the candidates of even number activated."""
    raw, scored = masks(spark, sf), proposals(spark, sf)
    view = settled(m.policy_view(raw, scored, 0.48, 0.45), "policy")
    return m.activated(m.resolve(raw, scored, 0.45), view, view.where("candidate and p % 2 = 0"))


_CUT_CHAIN = _CHAIN.replace(", k AS (SELECT scene_id, a, b FROM c LEFT JOIN h USING (scene_id, a, b) WHERE coalesce(held, 0) / seen >= 0.5)", ", k AS (SELECT scene_id, cut, a, b FROM c LEFT JOIN h USING (scene_id, a, b), (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS cut) WHERE coalesce(held, 0) / seen >= cut)").replace("PARTITION BY scene_id ORDER BY a", "PARTITION BY scene_id, cut ORDER BY a").replace("SELECT scene_id, a, b, sum(", "SELECT scene_id, cut, a, b, sum(").replace("SELECT scene_id, island, a AS v FROM i UNION SELECT scene_id, island, b FROM i", "SELECT scene_id, cut, island, a AS v FROM i UNION SELECT scene_id, cut, island, b FROM i").replace("WITH ", "WITH RECURSIVE ", 1)


@_query(f"""{_CUT_CHAIN}, g AS (SELECT scene_id, cut, island, count(*) AS size, {ids_sha256_sql("list(v ORDER BY v)")} AS digest, list(v) AS vs FROM n GROUP BY ALL
), pool AS (SELECT scene_id, cut, size, vs, row_number() OVER (PARTITION BY scene_id ORDER BY cut DESC, size DESC, digest) AS p FROM g JOIN (SELECT scene_id, count(*) AS all_ FROM v GROUP BY 1) USING (scene_id) WHERE size >= 20 AND size <= floor(all_ * 0.4e0)
), rival AS (SELECT a.scene_id, a.p, list(b.p) AS qs FROM pool a JOIN pool b ON a.scene_id = b.scene_id AND a.p <> b.p AND len(list_intersect(a.vs, b.vs)) / (a.size + b.size - len(list_intersect(a.vs, b.vs))) >= 0.95e0 GROUP BY ALL
), r AS (SELECT x.*, coalesce(qs, []::BIGINT[]) AS qs FROM pool x LEFT JOIN rival USING (scene_id, p)
), f AS (SELECT scene_id, 0::BIGINT AS at, NULL::BIGINT AS p, []::BIGINT[] AS ps FROM (SELECT DISTINCT scene_id FROM r)
  UNION ALL SELECT f.scene_id, r.p, CASE WHEN NOT list_has_any(ps, qs) THEN r.p END, CASE WHEN NOT list_has_any(ps, qs) THEN list_append(ps, r.p) ELSE ps END FROM f JOIN r ON r.scene_id = f.scene_id AND r.p = f.at + 1)
SELECT scene_id, f.p, cut, size FROM f JOIN r USING (scene_id, p) WHERE f.p IS NOT NULL""")
def fused_bank(spark: SparkSession, sf: str) -> DataFrame:
    """The bank of components at three cuts without duplicates."""
    v = masks(spark, sf).select("scene_id", "v").distinct()
    edges = v.select("scene_id", F.col("v").alias("a"), (F.col("v") + 1).alias("b")).join(apart(v.select("scene_id", F.col("v").alias("b"))), ["scene_id", "b"])
    confident = settled(m.edge_confidence(edges, visible(spark, sf), view_masks(spark, sf)), "edge-confidence")
    pool, held = m.fused_bank(confident, v.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")))
    pool, held = settled(pool, "pool"), settled(held, "pool-vertices")
    kept = m.bank(held, pool.select("scene_id", "p", "score"))
    return pool.join(apart(kept), ["scene_id", "p"], "left_semi").select("scene_id", "p", F.col("score").alias("cut"), "size")
