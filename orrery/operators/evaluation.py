"""Evaluation: selective prediction, agreement, paired tests, reachability ladders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.tables import tasks


def risk_coverage(items: DataFrame, group: list[str]) -> DataFrame:
    """``group, k, coverage, risk``: error rate of the k most confident items, abstained ones last.

    items: id, confidence, correct, abstained. Ties are pessimistic: wrong items come
    first. Groups are evaluated independently.
    """
    order = [F.col("abstained").asc(), F.desc("confidence"), F.col("correct").asc(), F.col("id")]
    by = Window.partitionBy(*group).orderBy(*order)
    ranked = items.withColumn("k", F.row_number().over(by)).withColumn("errors", F.sum((~F.col("correct")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    total = items.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(total, group).select(*group, "id", "k", (F.col("k") / F.col("total")).alias("coverage"), (F.col("errors") / F.col("k")).alias("risk"), "errors", "total")


def aurc(curve: DataFrame, group: list[str]) -> DataFrame:
    """``group, aurc, optimum, excess``: mean risk over coverages, the least possible, and the difference.

    With e errors of n, the best order has risk 0 up to n - e and (k - (n - e)) / k after.
    """
    right = F.max("total") - F.max("errors")
    worst = curve.groupBy(*group).agg(F.avg("risk").alias("aurc"), right.alias("right"), F.max("total").alias("total"))
    ladder = curve.join(worst.select(*group, "right"), group).groupBy(*group).agg(F.avg(F.greatest(F.lit(0.0), (F.col("k") - F.col("right")) / F.col("k"))).alias("optimum"))
    return worst.join(ladder, group).select(*group, "aurc", "optimum", (F.col("aurc") - F.col("optimum")).alias("excess"))


def coverage_at_risk(curve: DataFrame, group: list[str], limits: list[float]) -> DataFrame:
    """``group, limit, coverage``: the greatest coverage whose risk stays within each limit; 0 if none does."""
    grid = curve.select(*group, "coverage", "risk", F.explode(F.array(*map(F.lit, limits))).alias("limit"))
    return grid.groupBy(*group, "limit").agg(F.coalesce(F.max(F.when(F.col("risk") <= F.col("limit") + 1e-12, F.col("coverage"))), F.lit(0.0)).alias("coverage"))


def auroc(items: DataFrame, group: list[str]) -> DataFrame:
    """``group, auroc``: chance that a right item is more confident than a wrong one, ties half.

    Items are counted per distinct confidence first, so the running sums are over values.
    """
    values = items.groupBy(*group, "confidence").agg(F.count_if("correct").alias("pos"), F.count_if(~F.col("correct")).alias("neg"))
    below = Window.partitionBy(*group).orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    rows = values.withColumn("won", won)
    return rows.groupBy(*group).agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two 0/1 columns (an aggregate); null if chance agreement is certain."""
    n = F.count(F.lit(1))
    observed, pa, pb = F.avg((a == b).cast("double")), F.avg(a.cast("double")), F.avg(b.cast("double"))
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.when((n > 0) & (chance < 1), (observed - chance) / (1 - chance))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p-value for b and c discordant pairs."""
    n = b + c
    if n == 0:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)


#: Stages of a trace, in order; a stage is reached only if those it needs passed.
STAGES = ("capture", "reconstruct", "segment", "label", "relate", "ground", "execute", "answer")
NEEDS = {"reconstruct": ("capture",), "segment": ("reconstruct",), "label": ("segment",), "relate": ("segment",), "ground": ("label",), "execute": ("relate", "ground"), "answer": ("execute",)}


def gated(traces: DataFrame) -> DataFrame:
    """Traces (one column of status per stage) with stages behind a failure set to ``not_reached``."""
    bad = ("fail", "abstain", "not_reached")
    for stage in STAGES:
        if stage in NEEDS:
            blocked = F.lit(False)
            for need in NEEDS[stage]:
                blocked = blocked | F.col(need).isin(*bad)
            traces = traces.withColumn(stage, F.when(blocked, "not_reached").otherwise(F.col(stage)))
    return traces


def first_failure(traces: DataFrame) -> DataFrame:
    """``first_failure``: the earliest stage that failed or abstained, null if none did."""
    return traces.withColumn("first_failure", F.coalesce(*[F.when(F.col(s).isin("fail", "abstain"), F.lit(s)) for s in STAGES]))


def survival(traces: DataFrame, group: list[str]) -> DataFrame:
    """``group, ord, stage, reached, passed, failed``: the survival ladder of gated traces."""
    long = traces.select(*group, F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("status")) for s in STAGES])).alias("ord", "x"))
    status = F.col("x.status")
    return long.groupBy(*group, "ord", F.col("x.stage").alias("stage")).agg(F.count_if(status != "not_reached").alias("reached"), F.count_if(status == "pass").alias("passed"), F.count_if(status.isin("fail", "abstain")).alias("failed"))


def hashed_share(id_: Column, trial: Column, seed: int) -> Column:
    """A share in [0, 1) that looks random and is the same on every run: three rounds of products modulo the prime 2^31 - 1."""
    prime = 2147483647
    x = (id_ % prime * 48271 + trial * 69621 + seed) % prime
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * 48271) % prime
    x = (x.bitwiseXOR(F.shiftright(x, 13)) * 69621) % prime
    return x / F.lit(float(prime))


def hashed_share_sql(id_: str, trial: str, seed: int) -> str:
    prime = 2147483647
    x = f"(({id_} % {prime} * 48271 + {trial} * 69621 + {seed}) % {prime})"
    x = f"((xor({x}, {x} >> 15) * 48271) % {prime})"
    x = f"((xor({x}, {x} >> 13) * 69621) % {prime})"
    return f"({x} / {prime}e0)"


#: Trials of a control, the width of the noise, and the tails that bound it.
TRIALS, NOISE, LOW, HIGH = 4000, 1e-3, 0.05, 0.95
#: Trials for which an item is shuffled once.
TOGETHER = 50


def observed_ranks(items: DataFrame, group: list[str], family: str) -> DataFrame:
    """``group, family, rank``: each family's own share of right items, the most that a score of families alone could know."""
    return items.groupBy(*group, family).agg(F.avg(F.col("correct").cast("double")).alias("rank"))


def random_control(items: DataFrame, group: list[str], trials: int = TRIALS, seed: int = 0) -> DataFrame:
    """``group, mean, stdev, p05, p95``: the AURC of scores that know nothing beyond ``rank``.

    items: id, rank, correct, abstained. Every trial orders a group by rank and, within a rank, by hashed noise;
    trials are rows, so a trial of a group is one window, and what is gathered of a group is one number a trial.
    Items are dealt once for ``TOGETHER`` trials, and become rows of each trial where these are ordered.
    """
    blocks = -(-trials // TOGETHER)
    own = items.select(*group, "id", "rank", "correct", "abstained", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    # as many more partitions as there are blocks, as their rows grow after they are dealt
    dealt = own.repartition(tasks(items.sparkSession) * blocks, *group, "block")
    last = F.least((F.col("block") + 1) * TOGETHER, F.lit(trials)) - 1
    noisy = dealt.select("*", F.explode(F.sequence(F.col("block") * TOGETHER, last)).alias("trial"))
    noisy = noisy.select(*group, "block", "trial", "id", "correct", "abstained", (F.col("rank") + hashed_share(F.col("id"), F.col("trial"), seed) * NOISE).alias("confidence"))
    by = Window.partitionBy(*group, "block", "trial").orderBy(F.col("abstained").asc(), F.desc("confidence"), F.col("correct").asc(), F.col("id"))
    errors = F.sum((~F.col("correct")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    risks = noisy.select(*group, "block", "trial", (errors / F.row_number().over(by)).alias("risk"))
    each = risks.groupBy(*group, "block", "trial").agg(F.avg("risk").alias("aurc"))
    at = lambda share: F.element_at(F.array_sort(F.collect_list("aurc")), int(share * trials) + 1)
    return each.groupBy(*group).agg(F.avg("aurc").alias("mean"), F.stddev_pop("aurc").alias("stdev"), at(LOW).alias("p05"), at(HIGH).alias("p95"))


def band(value: Column) -> Column:
    """Where an AURC lies beside its control's p05 and p95."""
    return F.when(value < F.col("p05"), "better").when(value > F.col("p95"), "worse").otherwise("within")
