"""SimHash near-dedup: Golay-code fuzzy keys, verified links, components.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect
binary Golay code puts every 23-bit word within 3 bits of exactly one codeword.
A word's fuzzy keys are the codewords (12-bit indices) of the word and of all
words one bit away: one key if its own codeword is at most 2 bits away, else six.
Two words that differ in at most one bit hence share a key, and one of the two
need only publish its own codeword.

Three differing bits over three segments leave two cases by the pigeonhole
principle: every segment has at most one error (key: three codewords, 36 bits),
or some segment has none and another at most one (key: the exact segment and a
codeword, 30 or 35 bits, for each ordered pair). The candidates are verified by
the Hamming distance of the whole fingerprints, inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import materialise, table, whole_text
from orrery.llm.components import components

SEED = 42
MAX_BITS = 3
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GOLAY_GENERATOR = 0b110001110101
#: (shift, bits) of the segments of a fingerprint.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a UTF-8 text, as a signed 64-bit integer.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text
    of fewer than ``width`` words is one shingle, a text without words gives 0.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    runs = [words] if len(words) < width else zip(*(words[k:] for k in range(width)), strict=False)
    total, n = np.zeros(64, np.int64), 0
    block: list[int] = []
    for run in runs:
        block.append(xxhash.xxh64_intdigest(b" ".join(run), SEED))
        if len(block) == 65536:
            total, n, block = total + _bit_counts(block), n + len(block), []
    if block:
        total, n = total + _bit_counts(block), n + len(block)
    return int(np.packbits(total * 2 > n).view(">i8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp``: one row per row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [fingerprint(x.as_py(), width) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    narrow = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the high 12 bits, and the error pattern of each remainder."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_GENERATOR << bit - 11
        return word

    one = [1 << k for k in range(23)]
    patterns = [0, *one]
    patterns += [a | b for i, a in enumerate(one) for b in one[:i]]
    patterns += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    errors = np.zeros(2048, np.int64)
    for pattern in patterns:
        errors[remainder(pattern)] = pattern
    return np.array([remainder(k << 11) for k in range(4096)], np.int64), errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    high, errors = _syndromes()
    return (words ^ errors[high[words >> 11] ^ (words & 0x7FF)]) >> 11


def fuzzy_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each word's neighbourhood of one bit, and which are first of their kind."""
    flips = np.array([0, *(1 << k for k in range(bits))], np.int64)
    keys = np.sort(codeword_index(words[:, None] ^ flips), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    width = int(fresh.sum(1).max()) if len(words) else 0
    order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(keys, order, 1), np.take_along_axis(fresh, order, 1)


def _keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of fingerprints and their keys; the kind of a key is in its top bits."""
    unsigned = fps.view(np.uint64)
    parts = [((unsigned >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    if probe:
        fuzzy = [fuzzy_keys(x, b) for x, (_, b) in zip(parts, SEGMENTS, strict=True)]
    else:
        fuzzy = [(codeword_index(x)[:, None], np.ones((len(x), 1), bool)) for x in parts]
    (a, fa), (b, fb), (c, fc) = fuzzy
    triple = (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]
    mask = fa[:, :, None, None] & fb[:, None, :, None] & fc[:, None, None, :]
    owners, keys = [np.nonzero(mask)[0]], [triple[mask]]
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                kind += 1
                code, fresh = fuzzy[j]
                keys.append(((kind << 40) | (parts[i][:, None] << 12) | code)[fresh])
                owners.append(np.nonzero(fresh)[0])
    return fps[np.concatenate(owners)], np.concatenate(keys)


def _keyed(distinct: DataFrame, probe: bool, name: str, step: int = 2048) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), step):
                owner, key = _keys(np.ascontiguousarray(fps[at : at + step]), probe)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner)], names=["key", name])

    return distinct.select("fp").mapInArrow(run, f"key long, {name} long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (a < b) for all distinct fingerprints that differ in at most ``max_bits`` (3 at most).

    Fingerprints are distinct here, so a group of copies is one row, and no
    fingerprint has more than 43,744 others within three bits.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find up to 3 differing bits")
    probes, index = _keyed(distinct, True, "a"), _keyed(distinct, False, "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # a pair is found from both ends; the end with the smaller fingerprint keeps it
    return probes.join(index, "key").where(close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    component_id is the least doc_id that links reach, the row's own included.
    Null or blank texts have fingerprint 0 and link like any other; repeated rows
    give repeated rows; a null doc_id never names a component unless it is alone;
    an empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    marked = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, max_bits), "a", "b")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # settled on distinct fingerprints, so that the documents are joined once
    classes = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the least doc_id of each component only; all its columns stay.

    Rows that repeat a kept doc_id all stay. Rows without doc_id stay when their
    component has no doc_id at all.
    """
    found = near_duplicates(docs, width, max_bits)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__kept"]), "left_semi")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
