"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the session is local, as in tests, a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows does not recompute ``df``, and a lost
    executor costs only the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/orrery/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def text_hash(column: str = "text") -> Column:
    """With doc_id it tells rows apart that share or lack one: equal rows are judged alike."""
    return F.xxhash64(whole_text(column))


#: Rows of two longs, about 16 MB, that ``without`` sends to every task; with more, both sides are shuffled.
FEW = 1 << 19


def without(docs: DataFrame, gone: DataFrame, tag: str) -> DataFrame:
    """``docs`` less the rows whose doc_id and text are in ``gone`` (doc_id, row_hash); all columns stay.

    ``gone`` is written first and counted: at most FEW rows of it are broadcast, so that texts stay
    where they are, and with more of them both sides are shuffled.
    """
    gone = materialise(gone.select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_hash")).distinct(), tag)
    if isinstance(gone.schema["gone_id"].dataType, IntegralType) and gone.count() <= FEW:
        gone = F.broadcast(gone)
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each element of an array of longs, what comes before it combined (from 0): running sums by default.

    Built in blocks of the square root of the length, as appending to an array copies it.
    """
    empty = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")

    def block(part: Column) -> Column:
        step = lambda state, x: F.struct(combine(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        return F.aggregate(part, F.struct(zero.alias("at"), empty.alias("out")), step)

    def joined(blocks: Column) -> Column:
        before = block(blocks["at"])["out"]
        return F.flatten(F.zip_with(blocks, before, lambda own, base: F.transform(own["out"], lambda x: combine(base, x))))

    def whole(array: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(array).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(array), width), lambda at: block(F.slice(array, at, width)))
        return F.when(F.size(array) > 0, let(blocks, joined)).otherwise(empty)

    return let(values, whole)


#: Characters of a text's strips.
STRIP = 1024


def strips(text: Column) -> Column:
    """A text cut into strips of STRIP characters, for ``stretch``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STRIP}}}"), F.lit(0))


def stretch(cut: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` (exclusive); its cost does not grow with the text around it."""
    first = F.floor(start / STRIP).cast("int")
    few = F.slice(cut, first + 1, F.floor((end - 1) / STRIP).cast("int") - first + 1)
    own = F.substring(F.array_join(few, ""), (start % STRIP + 1).cast("int"), (end - start).cast("int"))
    return F.when(end > start, own).otherwise(F.lit(""))


def numbered(df: DataFrame, group: str, row: str, out: str, buckets: int) -> DataFrame:
    """Gapless numbers from 0 within each ``group``, without a group in one task.

    Rows of a group are dealt to ``buckets`` by a hash of ``row``, which differs for
    every row, and numbered inside each bucket; a table of at most groups x buckets
    counts gives where each bucket starts. The numbers are the same on every run.
    """
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int"))
    counts = df.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__bucket").orderBy(row)
    ranked = df.withColumn("__place", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, [group, "__bucket"])
    return joined.withColumn(out, (F.col("__start") + F.col("__place")).cast("long")).drop("__bucket", "__start", "__place")


def least_hashed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the least hashes of ``key``: a bounded sample.

    The hashes alone are sorted, so no more than the sample's rows travel.
    """
    hashed = F.xxhash64(key)
    cut = df.select(hashed.alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    return df.where(hashed <= F.lit(cut if cut is not None else 0)).limit(rows)
