"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Symbols are words. The CGK random walk reads a window's words, writes the word it
stands on and moves on or stays by a random bit of (step, word); walks over strings
a few edits apart soon run in step again, so edit distance becomes Hamming
distance. Repeated samples of the walk's output make the keys of an LSH, on which
windows of the documents meet the items. Candidates are verified by the exact
edit distance of the whole item to the best-fitting stretch of the document.

Windows are as long as the items: item lengths are rounded down to a geometric
ladder, and an item is embedded by its first words of that number. Only windows
that an item within the distance could leave (the q-gram lemma on word pairs:
an edit destroys two pairs at most) are embedded. A window may run past its text's
beginning or end by as many words as the item may lose.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import materialise, table, text_hash, whole_text, without
from orrery.llm.tokens import Known, gathered

SIMILARITY = 0.8
#: Items of fewer words may have no edit at this similarity; their windows are looked up whole.
LEAST_WORDS = 5
LADDER = 1.1
#: Independent walks, samples of each, and words in a sample.
WALKS, SAMPLES, WIDTH = 4, 24, 3
#: Bytes of item texts that go to the executors at once; more are searched in blocks.
BLOCK_BYTES = 16 << 20
_PAIRS = 1 << 24
#: Slots by which most keys are told to be of no item.
_SEEN = 1 << 18
_WORD = re.compile(r"\w+")
_PAD = np.uint64(0)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[int]:
    """Hashes of the lower-cased words of a text; a hash stands for its word."""
    return [zlib.crc32(w.encode()) + 1 for w in _WORD.findall(text.lower())]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def pair_slots(flat: np.ndarray) -> np.ndarray:
    """Slot of each word with the next one, in a table of pairs."""
    return (_mix(flat[:-1] * np.uint64(31) + flat[1:]) & np.uint64(_PAIRS - 1)).astype(np.int64)


def edits(n: int, similarity: float = SIMILARITY) -> int:
    """The most edits that leave an item of n words within the similarity."""
    return int(n * (1 - similarity) + 1e-9)


def embed(flat: np.ndarray, starts: np.ndarray, lack: np.ndarray, room: np.ndarray, size: int, walk: int) -> np.ndarray:
    """The first 2 x size steps of the CGK walk over windows of ``size`` words: one row per step.

    The text has a window's words from ``lack`` to ``room``; the others are padding.
    """
    out = np.empty((2 * size, len(starts)), np.uint64)
    at = np.zeros(len(starts), np.int64)
    for step in range(2 * size):
        symbol = np.where((at >= lack) & (at < room), flat[starts + np.minimum(np.maximum(at, lack), room - 1)], _PAD)
        out[step] = symbol
        salt = np.uint64((step * 2 + 1 + walk * 100_003) * int(_MIX) % (1 << 64))
        coin = _mix(symbol + salt) >> np.uint64(40)
        at += (coin & np.uint64(1)).astype(np.int64)
    return out


def sample_keys(embedded: np.ndarray, size: int, walk: int) -> np.ndarray:
    """LSH keys, one row per sample: the words at WIDTH places of the walk, mixed."""
    places = np.random.default_rng(size * 1009 + walk).integers(0, 2 * size, (SAMPLES, WIDTH))
    keys = np.zeros((SAMPLES, embedded.shape[1]), np.uint64)
    for s in range(SAMPLES):
        for place in np.sort(places[s]):
            keys[s] = _mix(keys[s] * np.uint64(3) + embedded[place])
        keys[s] ^= np.uint64((walk * SAMPLES + s + 1) << 8)
    return keys


def phrases(flat: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the stretches of ``size`` words from each start."""
    found = np.zeros(len(starts), np.uint64)
    for k in range(size):
        found = _mix(found * np.uint64(3) + flat[starts + k])
    return found


def fit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """``(distance, start, end)``: the least edit distance of the item to a stretch of the region."""
    m = len(region)
    row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    ramp = np.arange(m + 1)
    for k, word in enumerate(item, 1):
        change, delete = row[:-1] + (region != word), row[1:] + 1
        best = np.empty(m + 1, np.int64)
        came = np.empty(m + 1, np.int64)
        best[0], came[0] = k, 0
        take = change <= delete
        best[1:], came[1:] = np.where(take, change, delete), np.where(take, origin[:-1], origin[1:])
        # insertions: the least of best[j] + (i - j) over j <= i
        lowered = best - ramp
        running = np.minimum.accumulate(lowered)
        source = np.maximum.accumulate(np.where(lowered == running, ramp, 0))
        row, origin = running + ramp, came[source]
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), end


class ItemIndex:
    """Pairs, walks and keys of a block of items: what a task needs to search documents."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float = SIMILARITY) -> None:
        self.items, self.similarity = items, similarity
        self.pairs = np.zeros(_PAIRS // 8, np.uint8)
        self.own_pairs = [pair_slots(own) for _, own in items]
        ladder: dict[int, list[int]] = defaultdict(list)
        short: dict[int, list[int]] = defaultdict(list)
        for k, (_, own) in enumerate(items):
            if len(own) < LEAST_WORDS and not edits(len(own), similarity):
                short[len(own)].append(k)
                continue
            size = min(LEAST_WORDS, len(own))
            while max(size + 1, int(size * LADDER)) <= len(own):
                size = max(size + 1, int(size * LADDER))
            ladder[size].append(k)
            slots = self.own_pairs[k]
            np.bitwise_or.at(self.pairs, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
        self.short = []
        for size, members in sorted(short.items()):
            keys = np.concatenate([phrases(items[k][1], np.zeros(1, np.int64), size) for k in members])
            order = np.argsort(keys, kind="stable")
            self.short.append((size, keys[order], np.array(members)[order]))
        self.classes = []
        for size, members in sorted(ladder.items()):
            # the longest item of a class may lose most pairs
            slack = max(edits(len(items[k][1]), similarity) for k in members)
            need = max(1, size - 1 - 2 * slack)
            flat = np.concatenate([items[k][1][:size] for k in members])
            keys = np.concatenate([sample_keys(embed(flat, np.arange(len(members)) * size, np.zeros(len(members), np.int64), np.full(len(members), size), size, w), size, w) for w in range(WALKS)])
            owner = np.broadcast_to(np.array(members), keys.shape).ravel()
            order = np.argsort(keys.ravel(), kind="stable")
            seen = np.zeros(_SEEN, bool)
            seen[(keys.ravel() & np.uint64(_SEEN - 1)).astype(np.int64)] = True
            self.classes.append((size, slack, need, keys.ravel()[order], owner[order], seen))

    def candidates(self, flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts of windows, and items whose keys they share."""
        if len(flat) < 2:
            return
        slots = pair_slots(flat)
        hits = np.flatnonzero((self.pairs[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1)
        for size, slack, need, keys, owner, seen in self.classes:
            # a window holds enough pairs if its need-th hit from some hit on is still inside
            span = hits[need - 1 :] - hits[: max(0, len(hits) - need + 1)]
            dense = np.flatnonzero(span <= size - 2)
            row = np.searchsorted(first, hits[dense], "right") - 1
            same = hits[dense + need - 1] < first[row] + count[row]
            dense, row = dense[same], row[same]
            if not len(dense):
                continue
            # a passage that lost words may begin or end with its text, inside the window
            from_ = np.maximum(hits[dense + need - 1] - (size - 2), first[row] - slack)
            n = hits[dense] - from_ + 1
            starts = np.repeat(from_ - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            width = len(flat) + slack
            both = np.unique(np.repeat(row, n) * width + starts + slack)
            row, starts = both // width, both % width - slack
            room = np.minimum(first[row] + count[row] - starts, size)
            kept = room >= size - slack
            row, starts, room = row[kept], starts[kept], room[kept]
            lack = np.maximum(first[row] - starts, 0)
            for at in range(0, len(starts), 65536):
                cut = slice(at, at + 65536)
                inside = starts[cut] + lack[cut]
                for walk in range(WALKS):
                    found = sample_keys(embed(flat, starts[cut], lack[cut], room[cut], size, walk), size, walk).ravel()
                    maybe = np.flatnonzero(seen[(found & np.uint64(_SEEN - 1)).astype(np.int64)])
                    found = found[maybe]
                    lo = np.searchsorted(keys, found, "left")
                    n = np.searchsorted(keys, found, "right") - lo
                    if n.any():
                        yield np.repeat(inside[maybe % len(inside)], n), gathered(owner, lo, n)

    def short_hits(self, flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The first place of each short item in each document."""
        row = np.repeat(np.arange(len(count)), count)
        left = first[row] + count[row] - np.arange(len(flat))
        for size, keys, owner in self.short:
            starts = np.flatnonzero(left >= size)
            found = phrases(flat, starts, size)
            lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            some = np.flatnonzero(hi > lo)
            n = (hi - lo)[some]
            item = owner[np.repeat(lo[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            start = np.repeat(starts[some], n)
            _, at = np.unique(item.astype(np.int64) * max(1, len(count)) + row[start], return_index=True)
            for k, place in zip(item[at].tolist(), start[at].tolist(), strict=True):
                if (flat[place : place + size] == self.items[k][1]).all():
                    begin = place - int(first[row[place]])
                    yield int(row[place]), k, begin, begin + size, 0

    def search(self, flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """``(row, item, start, end, distance)``: the best stretch of each document for each item within the similarity."""
        yield from self.short_hits(flat, first, count)
        met = [np.unique(item.astype(np.int64) * len(flat) + start) for start, item in self.candidates(flat, first, count)]
        if not met:
            return
        both = np.unique(np.concatenate(met))
        item, start = both // len(flat), both % len(flat)
        row = np.searchsorted(first, start, "right") - 1
        new = np.ones(len(both), bool)
        size = np.array([len(own) for _, own in self.items])
        new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (start[1:] - start[:-1] > size[item[1:]])
        begins = np.flatnonzero(new)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for a, b in zip(begins, np.append(begins[1:], len(both)), strict=True):
            k, r = int(item[a]), int(row[a])
            own = self.items[k][1]
            slack = edits(len(own), self.similarity)
            lo, hi = max(int(first[r]), int(start[a]) - slack), min(int(first[r] + count[r]), int(start[b - 1]) + len(own) + slack)
            region = flat[lo:hi]
            # the q-gram lemma again, for this item: most of its pairs must be there
            there = set(pair_slots(region).tolist())
            if sum(pair in there for pair in self.own_pairs[k].tolist()) < len(own) - 1 - 2 * slack:
                continue
            distance, at, end = fit_distance(own, region)
            if distance <= slack:
                found = (distance, lo + at - int(first[r]), lo + end - int(first[r]))
                best[r, k] = min(best.get((r, k), found), found)
        for (r, k), (distance, at, end) in best.items():
            yield r, k, at, end, distance


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_BYTES (or one item); equal texts are one item, the least id."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    size = F.octet_length("text").cast("long")
    total = items.agg(F.sum(size).alias("n")).first()["n"] or 0
    parts = -(-2 * total // BLOCK_BYTES) or 1
    dealt = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    if parts > 1:
        dealt = materialise(dealt, "items")
    for part in range(parts):
        yield [(r["item_id"], r["text"]) for r in dealt.where(F.col("part") == part).select("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, start, end, distance, similarity``: documents that hold an item.

    For each document and item the stretch of words (end exclusive) nearest to the
    item, where 1 - edits / words of the item reaches ``similarity``. Items are
    compared word by word, without case and punctuation. Null texts hold nothing, nor
    are null items and those without words held; items of equal text are one, under
    the least item_id; repeated rows and rows without doc_id each report; an empty
    table gives an empty table. The documents are read once for each block of items,
    whole and in place.
    """
    return _contaminated(docs, benchmark, similarity).drop("row_hash")


def _contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", text_hash().alias("row_hash"), whole_text().alias("text"))
    schema = f"doc_id {kind}, row_hash long, item_id long, start long, end long, distance long, n_words long"
    found = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(_searchable(block))
        part = narrow.mapInArrow(_reporter(shared, similarity), schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("similarity", 1 - F.col("distance") / F.col("n_words")).drop("n_words")


def _searchable(block: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    return [(i, own) for i, own in ((i, np.array(words(t), np.uint64)) for i, t in block) if len(own)]


def _searched(batches: Iterator[pa.RecordBatch], items: list[tuple[int, np.ndarray]], similarity: float, at: int, most_bytes: int = 2 << 20):
    """Parts of the batches, each with what ``ItemIndex.search`` finds in its column ``at``."""
    index, known = ItemIndex(items, similarity), Known(_hashed, np.uint64)
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(ends, (int(ends[row - 1]) if row else 0) + most_bytes, "right")))
            part, row = batch.slice(row, to - row), to
            flat, count = _word_hashes(pc.fill_null(part.column(at), ""), known)
            yield part, list(index.search(flat, np.cumsum(count) - count, count))


def _reporter(shared, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for part, rows in _searched(batches, items, similarity, 2):
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(columns[0], pa.int64())) for c in (0, 1)), pa.array([items[k][0] for k in columns[1]], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[2:]), pa.array([len(items[k][1]) for k in columns[1]], pa.int64())],
                names=["doc_id", "row_hash", "item_id", "start", "end", "distance", "n_words"],
            )

    return run


def _hashed(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of chunks in a row, and their number in each."""
    flat, length = [], []
    for chunk in chunks.to_pylist():
        own = words(chunk)
        flat += own
        length.append(len(own))
    return np.array(flat, np.uint64), np.array(length, np.int64)


def _word_hashes(texts: pa.Array, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row and their number in each text."""
    split = pc.split_pattern(texts, " ")
    coded = pc.list_flatten(split).dictionary_encode()
    per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    pool, start, length = known.ids(coded.dictionary)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    spread = length[codes]
    count = np.add.reduceat(spread, np.cumsum(per_text) - per_text) if len(per_text) else np.zeros(0, np.int64)
    return gathered(pool, start[codes], spread), count


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay, whatever their names.

    Each row is judged by its own text: rows that share a doc_id, or have none, may
    part. An empty table gives an empty table.
    """
    return without(docs, _contaminated(docs, benchmark, similarity), "contaminated-rows")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
