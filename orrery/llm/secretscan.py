"""Secret scans: fixed patterns, and windows of high entropy, in Spark expressions.

Patterns give the base spans. The method adds ``entropy`` spans: in every long
run of key characters that no allow-list entry explains, a window slides over the
run, the counts of its characters are updated by the one that enters and the one
that leaves, and the Shannon entropy follows from them. The threshold depends on
the run's character class. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import let, running, stretch, strips, table, unused, whole_text

#: Kind, pattern, group that must be long, its least length.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits per character that a window must reach, by character class.
LIMITS = {"hex": 3.0, "mixed": 3.7, "letters": 3.65}
#: Runs that are long and yet no secrets: UUIDs, words in one case or CamelCase joined by marks, dates and counters, one character over and over.
#: Java matches a repeated group by recursion, so none repeats one without bound unless it is possessive.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(?:[-_/=+]++|[A-Z]{2,19}+(?![A-Z])|[A-Z]?+[a-z]{2,19}+(?![a-z])|(?<![A-Za-z])[A-Za-z](?![A-Za-z]))*+$",
    r"^[0-9_/=+-]+$",
    r"^(.)\1*$",
)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """``[{start, end, value}]``: leftmost matches that do not overlap, with the named group.

    The texts between the matches and the matches themselves, in turn, make up the
    whole text, so a running sum of their lengths gives the positions.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")), lambda x: x["hit"].isNotNull())

    def span(x: Column, before: Column) -> Column:
        begin = before + F.length(x["gap"])
        return F.struct(begin.alias("start"), (begin + F.length(x["hit"])).alias("end"), x["value"].alias("value"))

    def placed(found: Column) -> Column:
        return F.zip_with(found, running(F.transform(found, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("bigint"))), span)

    empty = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(empty)


def high_entropy(value: Column, limit: Column, window: int = WINDOW) -> Column:
    """``{lo, hi}`` from the first to the last window of at least ``limit`` bits a character; lo is -1 if there is none.

    The sum of n log n over the counts n in the window changes with the counts of the
    character that enters and of the one that leaves alone. ``value`` and ``limit`` should be
    fields of a lambda's argument, as every step uses the limit.
    """
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))
    term = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    rise = F.array(*(F.lit(b - a) for a, b in zip(term, term[1:], strict=False)))  # from n to n + 1
    begin = F.struct(F.array().cast("array<int>").alias("last"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    count = lambda last, code: F.size(last) - F.size(F.array_remove(last, code))

    def step(state: Column, enters: Column) -> Column:
        last, at = state["last"], state["at"]
        leaves, full = F.get(last, F.lit(0)), F.size(last) == window
        left = count(last, leaves) - 1 + F.when(leaves == enters, 1).otherwise(0)
        total = state["sum"] + F.get(rise, count(last, enters)) - F.when(full, F.get(rise, left)).otherwise(0.0)
        high = lambda total: (at >= window - 1) & (F.lit(math.log2(window)) - total / window >= limit)
        return let(
            total,
            lambda total: F.struct(
                F.concat(F.slice(last, F.when(full, 2).otherwise(1), F.lit(window)), F.array(enters)).alias("last"),
                (at + 1).alias("at"),
                total.alias("sum"),
                F.when(high(total) & (state["lo"] < 0), at - window + 1).otherwise(state["lo"]).alias("lo"),
                F.when(high(total), at + 1).otherwise(state["hi"]).alias("hi"),
            ),
        )

    return F.aggregate(codes, begin, step, lambda state: F.struct(state["lo"].alias("lo"), state["hi"].alias("hi")))


def _entropy_spans(text: Column) -> Column:
    def unexplained(x: Column) -> Column:
        keep = F.lit(True)
        for pattern in ALLOWED:
            keep = keep & ~x["value"].rlike(pattern)
        return keep

    def span(x: Column) -> Column:
        letters = ~x["value"].rlike("[0-9]")
        limit = F.when(x["value"].rlike("^[0-9a-fA-F]+$"), LIMITS["hex"]).when(letters, LIMITS["letters"]).otherwise(LIMITS["mixed"])
        return F.struct(x["start"].alias("start"), x["value"].alias("value"), limit.alias("limit"))

    runs = F.transform(F.filter(_matches(text, CANDIDATE, 0), unexplained), span)
    scanned = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), high_entropy(x["value"], x["limit"]).alias("high")))
    high = F.filter(scanned, lambda x: x["high"]["lo"] >= 0)
    return F.transform(high, lambda x: _span(x["start"] + x["high"]["lo"], x["start"] + x["high"]["hi"], 3))


def _span(start: Column, end: Column, rank: int) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"))


def _base_spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(_matches(text, pattern, group), lambda x: F.length(x["value"]) >= least)
    return F.transform(kept, lambda x: _span(x["start"], x["end"], rank))


def scan(docs: DataFrame, out: str = "secrets") -> DataFrame:
    """``docs`` with ``secrets``: ``[{start, rank, end}]`` by start, then kind (rank in KINDS).

    A null text has none. All rows and columns stay; a column of the name ``out`` is replaced.
    """
    text = whole_text()
    spans = []
    for rank, (_, pattern, group, least) in enumerate(PATTERNS):
        spans.append(_base_spans(text, rank, pattern, group, least))
    return docs.withColumn(out, F.array_sort(F.concat(*spans, _entropy_spans(text))))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``, and ``n_chars`` (if there) as it is then.

    Overlapping secrets become one mark. Texts without secrets, null ones too, stay
    as they are. Columns keep their names and order.
    """
    text, name = F.col("text"), unused(docs, "secrets")
    found = F.col(name)

    def cleaned(cut: Column) -> Column:
        reach = running(F.transform(found, lambda x: x["end"]), F.greatest)
        own = lambda x, before: F.when(x["start"] >= before, F.concat(stretch(cut, before, x["start"]), F.lit(mark))).otherwise(F.lit(""))
        rest = stretch(cut, F.array_max(F.transform(found, lambda x: x["end"])), F.length(text).cast("bigint"))
        return F.concat(F.array_join(F.zip_with(found, reach, own), ""), rest)

    done = scan(docs, name).withColumn("text", F.when(F.size(name) > 0, let(strips(text), cleaned)).otherwise(text))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda rank: F.size(F.filter("secrets", lambda x: x["rank"] == rank)).cast("long")
    base = F.filter("secrets", lambda x: x["rank"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )
