"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed to thousands of virtual slots, which never change. A map
puts the slots on shards so that the shards' bytes come out near equal. To
rebalance, a new version of the map is made from the old one: only slots move,
and only as many as needed. All of it is DataFrame operations.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import files
from orrery.llm.common import shared_dir, table, whole_text

SLOTS = 4096
SHARDS = 16
#: How far over the mean a shard may be before slots leave it, when documents are sharded.
SLACK = 0.001
#: Repetitions of a row that are dealt out together.
COPIES = 1 << 16
#: Looks at a map that another writer is just beginning, a fifth of a second apart.
TRIES = 300
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long"


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every row.

    size: bytes of the UTF-8 text, none for null, plus 1. The slot hashes doc_id
    and text, so rows that lack a doc_id or share one still spread.
    """
    text = whole_text()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes of each slot that has rows: at most as many rows as there are slots."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def even_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map, made before any bytes are known: slots in turn."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("virtual_slot"), (slot % shards).alias("shard"), F.lit(0).cast("long").alias("bytes"))


def slot_map(bytes_by_slot: DataFrame, shards: int, version: int = 1, old: DataFrame | None = None, slack: float = 0.01) -> DataFrame:
    """``version, virtual_slot, shard, bytes``: the map that puts slots on shards.

    Slots go, largest first, to the shard with the fewest bytes so far. With an
    ``old`` map, a slot stays where it is as long as its shard stays within
    (1 + slack) times the mean; so growing by a shard moves slots into that shard,
    and little else; its slots without bytes stay in the map. The fold runs over one row of at most ``slots`` entries,
    which is a fixed number however many records there are.
    """
    known = bytes_by_slot.select("virtual_slot", "bytes")
    if old is None:
        known = known.withColumn("was", F.lit(-1))
    else:
        was = old.select("virtual_slot", F.col("shard").alias("was"))
        known = known.join(was, "virtual_slot", "full").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    entry = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", F.coalesce("was", F.lit(-1)).alias("was"))
    row = known.agg(F.array_sort(F.collect_list(entry)).alias("slots"), F.sum("bytes").alias("total"))
    limit = F.col("total") / F.lit(shards) * F.lit(1 + slack)

    def place(state, slot):
        loads = state["loads"]
        stay = (slot["was"] >= 0) & (slot["was"] < shards) & (F.coalesce(F.get(loads, slot["was"]), F.lit(0)) + slot["bytes"] <= limit)
        least = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        shard = F.when(stay, slot["was"]).otherwise(least)
        added = F.transform(loads, lambda load, k: F.when(k == shard, load + slot["bytes"]).otherwise(load))
        picks = F.concat(state["picks"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), shard.alias("shard"), slot["bytes"].alias("bytes"))))
        return F.struct(added.alias("loads"), picks.alias("picks"))

    empty = F.from_json(F.lit("[]"), "array<struct<virtual_slot:int,shard:int,bytes:bigint>>")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), empty.alias("picks"))
    picks = row.select(F.explode(F.aggregate("slots", start, place, lambda state: state["picks"])).alias("pick"))
    return picks.select(F.lit(version).alias("version"), "pick.virtual_slot", "pick.shard", "pick.bytes")


def save_map(found: DataFrame, path: str, version: int) -> bool:
    """Write a version of the map in a folder of its own, and say whether it is ours to write.

    Of several writers of one version the one that makes its claim first writes it; the others
    get False and leave the map as it is. Earlier versions stay.
    """
    spark = found.sparkSession
    if not files.claim(spark, f"{path}/claim-{version:08d}"):
        return False
    found.coalesce(1).write.parquet(f"{path}/version-{version:08d}")
    return True


def latest_version(spark: SparkSession, path: str) -> int:
    """The latest complete version of the map at ``path``; 0 if there is none."""
    named = [int(name[8:]) for name in files.names(spark, path) if name.startswith("version-")]
    whole = [v for v in named if files.exists(spark, f"{path}/version-{v:08d}/_SUCCESS")]
    return max(whole, default=0)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map at ``path``; the latest if none is named. A map that lacks slots or has one twice raises."""
    wanted = latest_version(spark, path) if version is None else version
    found = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version-{wanted:08d}")
    rows, slots, last = found.agg(F.count(F.lit(1)), F.count_distinct("virtual_slot"), F.max("virtual_slot")).first()
    if not rows == slots == (last or 0) + 1:
        raise ValueError(f"version {wanted} of the map at {path} has {rows} rows for {slots} slots up to {last}")
    return found


def next_map(rows: DataFrame, path: str, shards: int, slots: int) -> int:
    """Edit the latest version of the map at ``path`` by the bytes of ``rows``, and return the new version.

    A writer that comes second edits again from what the first one wrote; the number of a writer that died
    between its claim and the end of its write is passed over.
    """
    spark, by_slot = rows.sparkSession, slot_bytes(rows)
    if not latest_version(spark, path):
        save_map(even_map(spark, shards, slots), path, 1)
    for _ in range(TRIES):
        old = latest_version(spark, path)
        if old:
            break
        time.sleep(0.2)  # another writer is making version 1
    else:
        raise RuntimeError(f"the map at {path} has no complete version")
    version = old + 1
    while not save_map(slot_map(by_slot, shards, version, load_map(spark, path, old), SLACK), path, version):
        old, version = max(old, latest_version(spark, path)), version + 1
    return version


def place(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with ``shard``, and ``slot``: their place in the shard, gapless from 0.

    Equal rows are counted first and dealt out again at the end, so a row that is
    repeated very often stays one row where the places are counted. A virtual slot
    is numbered by one task; where it starts in its shard is a running sum over
    the slots, which are few.
    """
    keys = ["virtual_slot", "doc_id", "size", "text_crc32"]
    distinct = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    mapped = counts.join(F.broadcast(found.select("virtual_slot", "shard", "version")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = mapped.select("virtual_slot", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    joined = ranked.join(F.broadcast(starts), "virtual_slot")
    # what is repeated very often is spread by strips of COPIES before it is dealt out
    few = joined.where(F.col("copies") <= COPIES).withColumn("strip", F.lit(0).cast("long"))
    many = joined.where(F.col("copies") > COPIES).withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    dealt = few.unionByName(many.repartition("virtual_slot", "doc_id", "strip"))
    copy = F.explode(F.sequence(F.col("strip") * COPIES, F.least(F.col("copies"), (F.col("strip") + 1) * COPIES) - 1))
    return dealt.select("*", copy.alias("copy")).withColumn("slot", (F.col("start") + F.col("ahead") + F.col("copy")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its shard and place, under the law ``bytes``.

    Makes the next version of the map at ``map_path`` (a new one in the shared folder
    by default, which begins as an even map) by moving slots of the version before it,
    and reads that version back. A null text has size 1 and the CRC of the empty
    text; a null doc_id is a value like any other; repeated rows are all placed; an
    empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = sized(docs, slots)
    if map_path is None:
        map_path = f"{shared_dir(spark).rstrip('/')}/orrery/slot-map-{uuid.uuid4().hex}"
    return place(rows, load_map(spark, map_path, next_map(rows, map_path, shards, slots)))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )
