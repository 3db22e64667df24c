"""Best-fit packing by linear grouping over a histogram of lengths.

The lengths are integers up to the capacity, so a histogram of at most that many
counts says all a packer needs, however many documents there are. On it, the
large lengths are sorted and cut into groups of equal cardinality, each rounded
up to its largest length; the few sizes that remain are packed by configurations
(column generation), and the actual lengths take the places of the rounded ones.
Rounding up wastes what a place is larger than its document. So only SHARE of each
configuration's times is kept, and its smallest place stays open: the documents
this leaves, and the small ones, go best-fit, largest first, into all the room
there is. The outcome is a table of runs: "of length L, the documents ranked a to
b go to sequences s, s+1, ... at offset o". A broadcast join with that table, whose
size depends on the capacity alone, places every document.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import materialise, numbered, table, whole_text
from orrery.llm.tokens import crc32, pieces_of

CAPACITY = 1024
#: More groups round less, but their configurations are harder to optimise; 24 to 96 end within 0.1 % of each other.
GROUPS = 48
SMALL = 8
#: Pieces that one bucket of a length ranks, or thereabouts.
RANKED = 50_000
#: Share of each configuration's times that is kept; the rest goes best-fit.
SHARE = 0.7


def _knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value (unbounded multiples)."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for fill in range(1, room + 1):
        best[fill] = best[fill - 1]
        fits = sizes <= fill
        if fits.any():
            gain = np.where(fits, best[fill - np.minimum(sizes, fill)] + values, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[fill] + 1e-12:
                best[fill], pick[fill] = gain[k], k
    config, fill = np.zeros(len(sizes), np.int64), room
    while fill > 0:
        if pick[fill] < 0:
            fill -= 1
        else:
            config[pick[fill]] += 1
            fill -= int(sizes[pick[fill]])
    return float(best[room]), config


def configurations(sizes: list[int], counts: list[int], room: int, share: float = 1.0, rounds: int = 600) -> list[tuple[list[int], int]]:
    """``(multiples of each size, times)`` that hold at most ``counts``, few in number.

    Solves the linear relaxation by column generation with a revised simplex
    basis and keeps the whole part of ``share`` of each configuration.
    """
    n = len(sizes)
    if not n:
        return []
    size, want = np.array(sizes), np.array(counts, float)
    columns = [np.eye(n, dtype=np.int64)[k] * (room // s) for k, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    times = np.linalg.solve(basis, want)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(n))
        value, config = _knapsack(size, np.maximum(dual, 0), room)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, config.astype(float))
        falls = step > 1e-9
        if not falls.any():
            break
        ratio = np.where(falls, times / np.where(falls, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = config
        basis[:, out] = config
        times = np.maximum(np.linalg.solve(basis, want), 0)
    left, found = list(counts), []
    for column, t in zip(columns, times, strict=True):
        whole = min([int(t * share + 1e-9), *(left[k] // int(m) for k, m in enumerate(column) if m)])
        if whole > 0 and column.any():
            found.append((column.tolist(), whole))
            left = [x - whole * int(m) for x, m in zip(left, column, strict=True)]
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first rank, ranks, first sequence, offset)`` that place all lengths.

    Rank r of a length (from its run's first) goes to the run's first sequence plus
    r. Sequences are numbered gapless from 0. Lengths over capacity/small are large;
    those of ``capacity`` itself are full and left out.
    """
    histogram = {x: n for x, n in histogram.items() if n and x < capacity}
    taken: Counter[int] = Counter()  # ranks given out, by length
    runs: list[tuple[int, int, int, int, int]] = []
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges of sequences

    def put(length: int, n: int, sequence: int, room: int) -> None:
        runs.append((length, taken[length], n, sequence, capacity - room))
        taken[length] += n

    large = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if x * small > capacity]
    total = sum(n for _, n in large)
    # groups of equal cardinality, largest first; a group's size is its largest length
    members: list[list[list[int]]] = []
    each = max(1, -(-total // groups))
    for length, n in large:
        while n:
            if not members or sum(c for _, c in members[-1]) == each:
                members.append([])
            part = min(n, each - sum(c for _, c in members[-1]))
            members[-1].append([length, part])
            n -= part
    sizes = [g[0][0] for g in members]
    merged = sorted(set(sizes), reverse=True)
    queues: dict[int, list[list[int]]] = {s: [] for s in merged}
    for s, g in zip(sizes, members, strict=True):
        queues[s] += g
    counts = [sum(c for _, c in queues[s]) for s in merged]
    sequence = 0
    for config, times in configurations(merged, counts, capacity, SHARE):
        ranges = [(sequence, times, capacity)]
        sequence += times
        places = [k for k, m in enumerate(config) for _ in range(m)]
        for k in places[:-1] or places:  # the smallest place stays open
            split = []
            for first, n, room in ranges:  # actual lengths take the places of the group's size
                while n:
                    length, held = queues[merged[k]][0]
                    part = min(n, held)
                    put(length, part, first, room)
                    split.append((first, part, room - length))
                    first, n = first + part, n - part
                    if part == held:
                        queues[merged[k]].pop(0)
                    else:
                        queues[merged[k]][0][1] -= part
            ranges = split
        for first, n, room in ranges:
            bins[room].append((first, n))
    rooms = sorted(bins)
    for length in sorted(histogram, reverse=True):
        n = histogram[length] - taken[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, first, held = capacity, sequence, -(-n // (capacity // length))
                sequence += held
            else:
                room = rooms[at]
                first, held = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            fit = room // length  # best fit stays in a sequence as long as it can
            full = min(held, n // fit)
            rest = n - full * fit if full < held else 0
            layers = [(first, full, fit)] if full else []
            if full < held and min(rest, fit):
                layers.append((first + full, 1, min(rest, fit)))
            used = 0
            for start, width, deep in layers:
                for level in range(deep):
                    put(length, width, start, room - level * length)
                n -= width * deep
                used += width
                _add(bins, rooms, room - deep * length, start, width)
            _add(bins, rooms, room, first + used, held - used)
    return runs


def _add(bins: dict[int, list[tuple[int, int]]], rooms: list[int], room: int, first: int, n: int) -> None:
    if n and room:
        if room not in bins:
            insort(rooms, room)
        bins[room].append((first, n))


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces: ``doc_id, row, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document of at most ``capacity`` ids is one piece. A longer one is cut into
    pieces of ``capacity`` ids, of which the first may be shorter. A null text is
    empty and has the end id alone. ``row`` numbers the pieces, with gaps; write the
    result before using it twice.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch, ids, counts in pieces_of(batches, path, True):
            rows, piece, start, length, crc, own = [], [], [], [], [], []
            at = 0
            for row, n in enumerate(counts.tolist()):
                head = n % capacity or min(n, capacity)
                bounds = [0, *range(head, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(crc32(ids[at + a : at + b]))
                    if keep_ids:
                        own.append(ids[at + a : at + b].astype(np.int32))
                at += n
            columns = [batch.column(0).take(pa.array(rows)), pa.array(np.arange(number, number + len(rows))), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            number += len(rows)
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select("doc_id", whole_text().alias("text"))
    schema = f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long"
    return narrow.mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity`` and a distinct ``row``) with ``sequence_id`` and ``offset``.

    Only the histogram of lengths goes to the driver, and only the plan of runs,
    which the capacity bounds, is broadcast. A full piece is a sequence of its own
    and is neither ranked nor shuffled. Ranks within another length are counted in
    buckets, so that none grows with the number of pieces.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    found = plan(counts, capacity, groups)
    base = max((first + n for _, _, n, first, _ in found), default=0)
    runs = spark.createDataFrame(found, "length long, lo long, n long, first long, offset long")
    most = max((n for x, n in counts.items() if x < capacity), default=0)
    ranked = numbered(pieces.where(F.col("length") < capacity), "length", "row", "rank", buckets=max(8, min(4096, most // RANKED)))
    inside = (ranked["length"] == runs["length"]) & (ranked["rank"] >= runs["lo"]) & (ranked["rank"] < runs["lo"] + runs["n"])
    placed = ranked.join(F.broadcast(runs), inside).drop(runs["length"])
    placed = placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("lo")).drop("rank", "lo", "n", "first", "row")
    full = pieces.where(F.col("length") == capacity)
    full = full.withColumns({"sequence_id": F.col("row") + F.lit(base), "offset": F.lit(0).cast("long")}).drop("row")
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack ``docs``; one row per piece, with its ids if asked for.

    Null texts are empty, repeated rows are packed once each, an empty table gives
    an empty table, columns other than doc_id and text are not read.
    """
    return pack(materialise(tokenised(docs, path, capacity, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token sequences of a packing made with ``keep_ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
