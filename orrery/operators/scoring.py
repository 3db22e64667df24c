"""Scoring answers against keys: router categories, benchmark policies, rollups; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories that meet the expected outcome.
SUCCESS = ("true_answer", "correct_defer", "true_empty", "true_unknown", "true_parser_failure", "true_execution_error")
#: An expected outcome without bindings, the outcome that meets it, and its category.
DECLINED = (("empty", "empty", "true_empty"), ("unknown", "unknown", "true_unknown"), ("parser_failure", "parser_failure", "true_parser_failure"), ("execution_error", "abstain", "true_execution_error"))


def category(expected: Column, got: Column, cited: Column, wanted: Column, barred: Column, deferred: Column) -> Column:
    """What became of a question with an expected outcome.

    cited, wanted and barred are arrays of ids (null: none). Bindings where none are expected
    are a false answer, whatever they say.
    """
    none = F.array().cast("array<string>")
    cited, wanted, barred = (F.coalesce(x, none) for x in (cited, wanted, barred))
    bound = got == "bindings"
    answered = F.when(~bound | (F.size(F.array_except(wanted, cited)) > 0), "miss").when(F.size(F.array_intersect(barred, cited)) > 0, "false_answer").otherwise("true_answer")
    found = F.when(expected == "answer", answered).when(~expected.isin("defer", *[e for e, _, _ in DECLINED]), "unexpected").when(bound, "false_answer")
    found = found.when((expected == "defer") & deferred, "correct_defer")
    for name, meets, kind in DECLINED:
        found = found.when((expected == name) & (got == meets), kind)
    return found.otherwise("unexpected")


def scorecard(rows: DataFrame, group: list[str]) -> DataFrame:
    """Counts of the categories that matter in each group, and whether every expectation is met."""
    of = lambda name: F.count_if(F.col("category") == name)
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("questions"), of("false_answer").alias("false_answers"), of("miss").alias("misses"), of("unexpected").alias("unexpected"),
        F.count_if(F.col("category").isin(*SUCCESS)).alias("met"), F.bool_and(F.col("category").isin(*SUCCESS)).alias("all_met"),
    )


def policy_met(policy: Column, covered: Column, targets: Column, abstained: Column, answers: Column, wrong: Column) -> Column:
    """Whether an answer satisfies its question's ambiguity policy: numbers covered, targets, answers and false positives."""
    some = covered >= 1
    return (
        F.when(policy == "none", abstained | (answers == 0)).when(policy == "abstain_ok", abstained | some).when(policy == "one_of", some)
        .when(policy == "any_of_subset", some & (wrong == 0)).when(policy == "all_of", covered == targets).otherwise(False)
    )


def scored(rows: DataFrame) -> DataFrame:
    """``rows`` of answered benchmark questions with their verdicts.

    Needs answer_type (count, yes_no, or about entities), policy, abstained, error, answers
    (array of id and zone, best first), targets (array of id and kind: entity or zone), actual
    and expected (texts of the scalar, null if there is none). Adds top1, topk, policy_ok, outcome,
    false_positives, covered, expected_total and attribution.
    """
    hit = lambda a, t: F.when(t["kind"] == "entity", a["id"] == t["id"]).otherwise(a["zone"] == t["id"])
    right = lambda a: F.exists("targets", lambda t: hit(a, t))
    ids = F.array_distinct(F.transform("targets", lambda t: t["id"]))
    found = F.size(F.array_distinct(F.transform(F.filter("targets", lambda t: F.exists("answers", lambda a: hit(a, t))), lambda t: t["id"])))
    scalar, abstained = F.col("answer_type").isin("count", "yes_no"), F.col("abstained")
    given, total = F.size("answers"), F.size("targets")
    first = F.coalesce(right(F.get("answers", F.lit(0))), F.lit(False))
    nothing = abstained | (given == 0)
    same = F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)) & ~abstained
    wrong = F.when(total == 0, given).when(abstained, 0).otherwise(given - F.size(F.filter("answers", right)))
    told = F.when(F.col("error") == "unparseable", "parser").when(F.lower("error").startswith("vlm_format"), "vlm_format").when(F.lower("error").startswith("vlm_hallucination"), "vlm_hallucination")
    rows = rows.withColumns({"_found": F.when(scalar, same.cast("int")).otherwise(found), "_wrong": F.when(scalar, (~abstained & F.col("actual").isNotNull() & ~same).cast("int")).otherwise(wrong)})
    top1 = F.when(scalar, same).when(total == 0, nothing).when(abstained, False).otherwise(first)
    topk = F.when(scalar, same).when(total == 0, nothing).when(abstained, False).otherwise(F.col("_found") > 0)
    rows = rows.withColumns({"top1": top1, "topk": topk})
    met = policy_met(F.col("policy"), F.col("_found"), F.size(ids), abstained, given, F.col("_wrong"))
    missed = F.when(F.col("topk"), "true_answer").otherwise("miss")
    outcome = F.when(scalar, F.when(abstained, "wrong_abstain").otherwise(missed)).when(total == 0, F.when(nothing, "correct_abstain").otherwise("false_answer")).when(abstained, "wrong_abstain").otherwise(missed)
    of_scalar = F.when(abstained, "abstention").when(F.col("actual").isNull(), "scene_graph").when(same, "none").otherwise("scorer")
    of_list = F.when(total == 0, F.when(given > 0, "scorer").otherwise("none")).when(F.col("topk"), F.when(F.col("top1"), "none").otherwise("scorer")).when(abstained, "abstention").when(given == 0, "scene_graph").otherwise("scorer")
    return rows.withColumns({
        "policy_ok": F.when(scalar, same).otherwise(met), "outcome": outcome, "false_positives": F.col("_wrong").cast("long"), "covered": F.col("_found").cast("long"),
        "expected_total": F.when(scalar, 1).otherwise(total).cast("long"), "attribution": F.coalesce(told, F.when(scalar, of_scalar).otherwise(of_list)),
    }).drop("_found", "_wrong")
