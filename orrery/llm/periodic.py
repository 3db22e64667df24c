"""Runs of words that repeat with a period, found in tiles and stitched.

A run of period q is a stretch of words in which words q apart are equal; it has at
least POWER times q words, so it has at least (POWER - 1) q = 3 q places i with
word i = word i + q. Periods from s = 2^o to 2 s - 1 are an octave. Among places 0, s,
2 s, ... (boundaries) each such run has one at which a block of 2 s words equals
the block q words on. Blocks of all lengths 2 s get 64-bit hashes by doubling, and one
comparison of arrays finds, for all boundaries of a document at once, the q of its octave
at which blocks are equal. By the theorem of Fine and Wilf two such q at one boundary are both
multiples of a smaller period, so only a boundary with a single q can show a
run of its smallest period.

A document is exploded into overlapping tiles for each octave; tiles without such a
boundary hold no run of the octave and are not dealt out. Each tile is solved on its
own: at a boundary c the Z-values forward (words that tile[c:] and tile[c + q:] have in
common from their start) and backward (the same before c) at the shifts that
are left give the fragment of the run inside the tile. Fragments are
shuffled by document and period and stitched where they touch.

The hash decides only where to look: what it shows is compared word by word. A run could
be passed over only if two different blocks shared a 64-bit hash at one of its boundaries.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialise, table, whole_text

#: A run has at least LEAST words and POWER periods.
LEAST, POWER = 6, 4
#: Words of a tile's own part, or WIDE times its octave's least period if that is more.
CORE, WIDE = 4096, 16
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPAN = "struct<start:bigint,period:bigint,length:bigint>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def _block(octave: int) -> tuple[int, int]:
    """Least period of an octave, which is also the step of its boundaries, and words of its blocks."""
    step = 1 << octave
    return step, 2 * step if octave else LEAST - 2


def candidates(ids: np.ndarray, octaves: range | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each octave: boundaries with a single q of equal blocks, and that q."""
    n, octave, length = len(ids), 0, 1
    h = _mixed(ids.astype(np.uint64) + np.uint64(1))
    while POWER << octave <= n and n >= LEAST:
        step, block = _block(octave)
        while length < block:
            h = _mixed(h[:-length] * _ODD[1] + h[length:])
            length *= 2
        if octaves is None or octave in octaves:
            if not octave:
                c = np.flatnonzero(h[:-1] == h[1:])
                yield octave, c, np.ones(len(c), np.int64)
            else:
                rows = -(-(len(h) - step) // step)
                shifted = np.zeros(rows * step, np.uint64)
                shifted[: len(h) - step] = h[step:]
                equal = shifted.reshape(rows, step) == h[: rows * step : step, None]
                equal.reshape(-1)[len(h) - step :] = False
                alone = np.flatnonzero(equal.sum(1) == 1)
                yield octave, alone * step, step + equal[alone].argmax(1)
        octave += 1


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``octave, start, ids`` of the overlapping tiles that may hold a run of their octave.

    A tile reaches one step before its core and a block, a step and the longest
    period beyond it, so that fragments of a run in neighbouring tiles touch.
    """
    for octave, c, _ in candidates(ids):
        step, block = _block(octave)
        core = max(CORE, WIDE * step)
        for k in np.unique(c // core).tolist():
            start = max(0, k * core - step)
            yield octave, start, ids[start : (k + 1) * core + step + block + 2 * step]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements two arrays share, looked up in stretches that double."""
    n, at, width = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(n, at + width)] != b[at : min(n, at + width)]
        if differ.any():
            return at + int(differ.argmax())
        at, width = at + width, 2 * width
    return n


def _primitive(word: np.ndarray) -> bool:
    """Whether a stretch is no repetition of a shorter one."""
    n, left, p = len(word), len(word), 2
    primes = set()
    while p * p <= left:
        while left % p == 0:
            primes.add(p)
            left //= p
        p += 1
    if left > 1:
        primes.add(left)
    return not any((word[: n - n // p] == word[n // p :]).all() for p in primes)


def solve(ids: np.ndarray, octave: int, start: int, words: int) -> list[tuple[int, int, int]]:
    """``period, low, high``: fragments in a tile, as places i (of the document) with word i = word i + period.

    Fragments that are too short and reach no cut end of the tile are left out.
    """
    found: list[tuple[int, int, int]] = []
    for _, at, shift in candidates(ids, range(octave, octave + 1)):
        covered: dict[int, int] = {}
        for c, q in zip(at.tolist(), shift.tolist(), strict=True):
            if c < covered.get(q, -1):
                continue
            if not _primitive(ids[c : c + q]):
                continue
            forward = _common(ids[c:], ids[c + q :])
            if forward < _block(octave)[1]:
                continue
            backward = _common(ids[:c][::-1], ids[q : c + q][::-1])
            low, high = c - backward, c + forward
            covered[q] = high
            cut = (low == 0 and start > 0) or (high + q == len(ids) and start + len(ids) < words)
            if cut or high - low + q >= max(LEAST, POWER * q):
                found.append((q, start + low, start + high))
    return found


#: Rows, and word numbers in tiles, that are gathered before they leave a task.
_ROWS, _NUMBERS = 1024, 1 << 20


def read_words(docs: DataFrame, rewrite: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """One row a document and one a tile (``octave`` is null in the former).

    ``words`` holds the document's words joined by one space, and only where it has tiles.
    ``rewrite`` may change the words of a document, given its doc_id.
    """
    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, words_sha256 string, words string, octave int, start long, ids array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows_of(row: int, doc: object, text: bytes) -> Iterator[tuple]:
        words = text.split()
        if rewrite is not None:
            words = rewrite(words, doc)
        joined, dealt = b" ".join(words), False
        for octave, start, ids in tiles(word_numbers(words)):
            dealt = True
            yield row, None, len(words), None, None, octave, start, ids.astype(np.int32)
        yield row, doc, len(words), hashlib.sha256(joined).hexdigest(), joined if dealt else None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        numbers = 0
        for batch in batches:
            kinds = [pa.int64(), batch.schema.field(1).type, pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k).cast(pa.string() if pa.types.is_binary(k) else k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)  # noqa: E731, B023
            for row, doc, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                for out in rows_of(row.as_py(), doc.as_py(), text.as_py()):
                    waiting.append(out)
                    numbers += len(out[-1]) if out[-1] is not None else 0
                    if len(waiting) >= _ROWS or numbers >= _NUMBERS:
                        yield packed(waiting)
                        waiting, numbers = [], 0
        if waiting:
            yield packed(waiting)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def fragments(dealt: DataFrame) -> DataFrame:
    """``row, period, low, high``: the fragments of every tile, each tile solved on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for row, words, octave, start, ids in zip(*batch.columns, strict=True):
                own = solve(ids.values.to_numpy().astype(np.int64), octave.as_py(), start.as_py(), words.as_py())
                out.extend((row.as_py(), *f) for f in own)
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "period", "low", "high"])

    wanted = dealt.where("octave is not null").select("row", "n_words", "octave", "start", "ids")
    return wanted.repartition("row", "octave", "start").mapInArrow(run, "row long, period long, low long, high long")


def stitched(parts: DataFrame) -> DataFrame:
    """``row, start, period, length``: fragments that touch are one run; runs that are too short go."""
    order = Window.partitionBy("row", "period").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("low") > reach), 1).otherwise(0)
    numbered = parts.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("row", "period", "run").agg(F.min("low").alias("start"), (F.max("high") + F.col("period") - F.min("low")).alias("length"))
    return whole.where(F.col("length") >= F.greatest(F.lit(LEAST), POWER * F.col("period"))).select("row", "start", "period", "length")


def _kept(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that no run contains after its first period."""
    stays = np.ones(len(words), bool)
    for r in runs:
        stays[r["start"] + r["period"] : r["start"] + r["length"]] = False
    return [words[i] for i in np.flatnonzero(stays).tolist()]


def periodic_runs(docs: DataFrame, rewrite: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, words_sha256, runs, collapsed`` of every row of ``docs``.

    runs are (start, period, length) by start, then period; collapsed is the text
    without the words that repeat, joined by one space, and null where there is no run and the
    words stand as they are (words_sha256 is the SHA-256 of these, joined by one space).
    A null or blank text has no words. Rows that repeat are judged one by one;
    a null doc_id stays null; an empty table gives an empty table; other columns are not read.
    """
    dealt = materialise(read_words(docs, rewrite), "word-tiles")
    found = stitched(fragments(dealt)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    plain = dealt.where("octave is null")
    none = F.array().cast(f"array<{_SPAN}>")
    still = plain.where("words is null").select("doc_id", "n_words", "words_sha256", none.alias("runs"), F.lit(None).cast("string").alias("collapsed"))
    tiled = plain.where("words is not null").join(found, "row", "left").select("doc_id", "n_words", "words_sha256", "runs", F.when(F.col("runs").isNotNull(), F.col("words")).cast("binary").alias("collapsed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(_kept(w.as_py().split(b" "), r.as_py())).decode() if r.is_valid else None for r, w in zip(batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string())], names=batch.schema.names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    shorter = tiled.mapInArrow(run, f"doc_id {kind}, n_words long, words_sha256 string, runs array<{_SPAN}>, collapsed string")
    return still.unionByName(shorter.withColumn("runs", F.coalesce("runs", none)))


def _planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """The contract's rewriting: every tenth document repeats a stretch to its end."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _listed(runs: Column) -> Column:
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), _planted)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    told = found.withColumn("best", best)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.n") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(_listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.coalesce(F.sha2(F.col("collapsed").cast("binary"), 256), "words_sha256").alias("collapsed_sha256"),
    )
