"""Line dedup over levelled, sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z lower-cased;
its hash has 128 bits. Documents arrive in batches. A batch's keys, with the number of
its documents that hold each, are merge-anti-joined with what the runs have decided
already (keys that enough documents hold: these need no more counting), and what is
left becomes a sorted run of level 0. As soon as FANOUT runs share a level, they are
merged into one run of the next level and dropped, so a store of n batches has
O(log n) runs and a key is rewritten O(log n) times. A run's name says which batches it
covers; a run that another complete run covers is passed over, so that a job that
dies between writing and dropping leaves a store that reads the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import files
from orrery.llm.common import table, text_hash, whole_text

#: Documents that must hold a line before it goes, and code points that its key must have.
LEAST, SHORTEST = 10, 1
FANOUT, BATCHES = 4, 8
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = "h long, g long, docs long"


def key_hash(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """The 16-byte hash of a line's key, or None if the key is shorter than ``shortest`` code points."""
    key = line.strip(_SPACE)
    if len(key) < 4 * shortest and sum(b & 0xC0 != 0x80 for b in key) < shortest:
        return None
    return xxhash.xxh3_128_digest(key.translate(_LOWER))


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    flat = memoryview(b"".join(digests)).cast("q") if digests else []
    return pa.array(flat[0::2] if digests else [], pa.int64()), pa.array(flat[1::2] if digests else [], pa.int64())


def keys(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, row_hash, h, g``: the distinct line keys of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            found: list[bytes] = []
            for at, text in enumerate(batch.column(2)):
                own = {key_hash(line, shortest) for line in text.as_py().split(b"\n")} - {None}
                owners.extend([at] * len(own))
                found.extend(own)
            who = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), *_halves(found)], names=["doc_id", "row_hash", "h", "g"])

    rows = docs.select("doc_id", text_hash().alias("row_hash"), whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_hash long, h long, g long")


class Run(NamedTuple):
    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"run-{self.first:08d}-{self.last:08d}-{self.level}"

    def covers(self, other: Run) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last and self.level > other.level


class LineStore:
    """Counts of line keys in a folder that all executors see; it can be opened again by any session."""

    def __init__(self, spark: SparkSession, folder: str, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.folder, self.least, self.fanout = spark, folder.rstrip("/"), least, fanout

    def runs(self) -> list[Run]:
        """The complete runs that no other covers, oldest first."""
        named = (re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", name) for name in files.names(self.spark, self.folder))
        found = [Run(*map(int, m.groups())) for m in named if m]
        whole = [r for r in found if files.exists(self.spark, f"{self.folder}/{r.name}/_SUCCESS")]
        return sorted(r for r in whole if not any(o.covers(r) for o in whole))

    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], _RUN)
        return self.spark.read.schema(_RUN).parquet(*(f"{self.folder}/{r.name}" for r in runs))

    def merged(self) -> DataFrame:
        """``h, g, docs``: every key of the store, once. The count of a decided key stops where it was decided."""
        return self._read(self.runs()).groupBy("h", "g").agg(F.sum("docs").alias("docs"))

    def decided(self) -> DataFrame:
        """``h, g``: keys that at least ``least`` documents hold."""
        return self.merged().where(F.col("docs") >= self.least).select("h", "g")

    def unseen(self, counts: DataFrame) -> DataFrame:
        """The keys of ``counts`` that no run holds: what is new in a batch."""
        return counts.join(self._read(self.runs()), ["h", "g"], "left_anti")

    def add(self, counts: DataFrame) -> Run:
        """Add a batch (h, g, docs; one row a key): what is not decided yet becomes a run; full levels are merged.

        Writers take their numbers by making a file that must not exist, so two of
        them never write one run; the number of one that died stays unused.
        """
        number = 1 + max([-1, *(int(n[6:]) for n in files.names(self.spark, self.folder) if n.startswith("batch-"))])
        while not files.claim(self.spark, f"{self.folder}/batch-{number:08d}"):
            number += 1
        run = Run(number, number, 0)
        undecided = counts.join(self.decided(), ["h", "g"], "left_anti")
        self._write(undecided.select("h", "g", "docs"), run)
        self._compact()
        return run

    def _write(self, rows: DataFrame, run: Run) -> None:
        rows.sortWithinPartitions("h", "g").write.parquet(f"{self.folder}/{run.name}")

    def _compact(self) -> None:
        level = 0
        while True:
            own = [r for r in self.runs() if r.level == level]
            if not own:
                return
            if len(own) >= self.fanout:
                merged = self._read(own).groupBy("h", "g").agg(F.sum("docs").alias("docs"))
                into = Run(own[0].first, own[-1].last, level + 1)
                if not files.claim(self.spark, f"{self.folder}/merge-{into.name}"):
                    return
                self._write(merged, into)
                for r in own:
                    files.drop(self.spark, f"{self.folder}/{r.name}")
            level += 1


def gather(docs: DataFrame, store: LineStore, batches: int = BATCHES, shortest: int = SHORTEST) -> None:
    """Deal the rows of ``docs`` into ``batches`` and add them to the store, one after the other.

    The texts are read once: the keys of all batches are counted in one pass.
    """
    spark, path = docs.sparkSession, files.fresh(docs.sparkSession, "line-keys")
    batch = F.pmod(F.col("row_hash"), F.lit(batches)).cast("int")
    counts = keys(docs, shortest).groupBy(batch.alias("batch"), "h", "g").agg(F.count(F.lit(1)).alias("docs"))
    counts.write.partitionBy("batch").parquet(path)
    arrived = spark.read.schema(f"{_RUN}, batch int").parquet(path)
    for b in range(batches):
        store.add(arrived.where(F.col("batch") == b).select("h", "g", "docs"))
    files.drop(spark, path)


def without_lines(docs: DataFrame, gone: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row, without the lines whose keys are in ``gone`` (h, g).

    What is to go is found on hashes alone and gathered by row; then texts meet it once.
    """
    met = keys(docs, shortest).join(gone, ["h", "g"]).distinct()
    hits = met.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("h", "g")).alias("gone"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("row_hash").alias("hit_hash"), "gone")
    rows = docs.select("doc_id", text_hash().alias("row_hash"), whole_text().cast("binary").alias("text"))
    both = rows.join(hits, rows["doc_id"].eqNullSafe(hits["hit_id"]) & (rows["row_hash"] == hits["hit_hash"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, texts = [], [], []
            for text, listed in zip(batch.column(1), batch.column(2), strict=True):
                parts = text.as_py().split(b"\n")
                lines.append(len(parts))
                kept = parts
                if listed.is_valid:
                    out = {x["h"].to_bytes(8, "little", signed=True) + x["g"].to_bytes(8, "little", signed=True) for x in listed.as_py()}
                    kept = [line for line in parts if key_hash(line, shortest) not in out]
                dropped.append(len(parts) - len(kept))
                texts.append(b"\n".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines), pa.array(dropped), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.select("doc_id", "text", "gone").mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def deduplicate_lines(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, folder: str | None = None, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row of ``docs``: lines that ``least`` documents hold go everywhere.

    Each row counts as a document, rows that repeat too. A null or empty text is one empty line; keys
    of fewer than ``shortest`` code points are neither counted nor dropped; rows
    without doc_id are judged like others; an empty table gives an empty table; other columns are not
    read. With a ``folder``, the counts of earlier calls take part, and this call's stay there.
    """
    spark = docs.sparkSession
    store = LineStore(spark, folder or files.fresh(spark, "line-store"), least)
    gather(docs, store, batches, shortest)
    return without_lines(docs, files.write(store.decided(), files.fresh(spark, "frequent-lines")), shortest)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), parts AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
), keyed AS MATERIALIZED (
  SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM parts
), gone AS (SELECT key FROM keyed WHERE length(key) >= {SHORTEST} GROUP BY key HAVING count(DISTINCT rid) >= {LEAST}
), marked AS (SELECT k.*, g.key IS NOT NULL AS out FROM keyed k LEFT JOIN gone g ON g.key = k.key)
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (m.out) AS n_dropped,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT m.out), '')) AS kept_sha256
FROM marked m JOIN docs d USING (rid) GROUP BY m.rid, d.doc_id
"""
