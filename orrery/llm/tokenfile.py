"""Token files: zstandard frames of single documents with one shared dictionary.

A block holds up to a few hundred documents: a header with the SHA-256 of the
dictionary, an index (document id, count of ids, offset of its frame), and one
frame per document. A reader of one short document hence needs the block's
index, the document's frame and the dictionary, nothing else. Blocks are rows of
a Parquet table, so Spark's writers commit them whole and a lost task leaves none.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import files
from orrery.llm.common import least_hashed, materialise, table, whole_text
from orrery.llm.tokens import crc32, pieces_of

MAGIC = b"OTB1"
#: magic, bytes per id, SHA-256 of the dictionary, documents, ids before the block in its part
HEADER = struct.Struct("<4sB32sIQ")
BLOCK_DOCS = 256
BLOCK_IDS = 1 << 18
#: Bounds of the sample that the dictionary is trained on.
TRAIN_DOCS, TRAIN_BYTES, DICTIONARY_BYTES = 1000, 8 << 20, 64 << 10
#: Stands for a null document id in the index.
NO_ID = -(1 << 63)
BLOCKS = "part int, block int, first_doc long, last_doc long, n_ids long, payload binary"


def serialise(ids: np.ndarray, width: int) -> bytes:
    """Ids as little-endian integers of ``width`` bytes; one that does not fit is an error."""
    if len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError(f"an id does not fit in {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, path: str, keeps_space: bool, width: int) -> bytes:
    """A dictionary trained on the id arrays of at most TRAIN_DOCS documents, each cut at TRAIN_BYTES.

    Tasks tokenise; at most TRAIN_BYTES of distinct arrays, least hash first, reach the driver.
    Empty (frames without a dictionary) where the sample is too small to train on.
    """
    sample = least_hashed(docs.select("doc_id", whole_text().alias("text")), "doc_id", TRAIN_DOCS)
    most = TRAIN_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, counts in pieces_of(batches, path, keeps_space):
            ends = np.cumsum(counts)
            own = [serialise(ids[a : min(b, a + most // width)], width) for a, b in zip(ends - counts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["own"])

    coded = materialise(sample.select("text").mapInArrow(run, "own binary").select("own", F.octet_length("own").cast("long").alias("n"), F.xxhash64("own").alias("h")), "token-samples")
    size, last = 0, None
    for row in coded.select("h", "n").orderBy("h").collect():
        if size + row["n"] > most and last is not None:
            break
        size, last = size + row["n"], row["h"]
    if last is None:
        return b""
    samples = [bytes(r["own"]) for r in coded.where(F.col("h") <= last).dropDuplicates(["h"]).orderBy("h").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


@lru_cache(4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


@lru_cache(4)
def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_block(doc_ids: list[int | None], arrays: list[np.ndarray], before: int, dictionary: bytes, width: int) -> bytes:
    pack = _compressor(dictionary).compress
    frames = [pack(serialise(x, width)) for x in arrays]
    index = np.zeros(len(frames), dtype=[("doc", "<i8"), ("ids", "<u4"), ("end", "<u8")])
    if NO_ID in doc_ids:
        raise ValueError(f"doc_id {NO_ID} stands for a document without id")
    index["doc"] = [NO_ID if x is None else x for x in doc_ids]
    index["ids"] = [len(x) for x in arrays]
    index["end"] = np.cumsum([len(x) for x in frames])
    head = HEADER.pack(MAGIC, width, hashlib.sha256(dictionary).digest(), len(frames), before)
    return head + index.tobytes() + b"".join(frames)


class Block:
    """A block as read: its index at once, a document's ids on demand."""

    def __init__(self, payload: bytes, dictionary: bytes) -> None:
        magic, self.width, digest, n, self.before = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.index = np.frombuffer(payload, [("doc", "<i8"), ("ids", "<u4"), ("end", "<u8")], n, HEADER.size)
        self.frames = memoryview(payload)[HEADER.size + self.index.nbytes :]
        self.unpack = _decompressor(dictionary).decompress

    def ids(self, row: int) -> np.ndarray:
        begin = int(self.index["end"][row - 1]) if row else 0
        frame = self.frames[begin : int(self.index["end"][row])]
        return np.frombuffer(self.unpack(frame), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        rows = np.flatnonzero(self.index["doc"] == doc_id)
        return self.ids(int(rows[0])) if len(rows) else None


def write_token_file(docs: DataFrame, path: str, keeps_space: bool, dictionary: bytes, width: int, folder: str) -> DataFrame:
    """Write ``docs`` in ascending doc_id order to ``folder``, the dictionary beside the blocks; returns the blocks.

    Columns: part (range partition), block (its place there), first_doc, last_doc,
    n_ids, payload. Ties in doc_id are in the order of the texts' hashes.
    """

    spark = docs.sparkSession
    named = [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))]
    spark.createDataFrame(named, "sha256 string, payload binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            payload = write_block(names, arrays, before, dictionary, width)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names[0]], pa.int64()), pa.array([names[-1]], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "block", "first_doc", "last_doc", "n_ids", "payload"],
            )

        for batch, ids, counts in pieces_of(batches, path, keeps_space):
            ends = np.cumsum(counts)
            for doc, a, b in zip(batch.column(0).to_pylist(), ends - counts, ends, strict=True):
                names.append(doc)
                arrays.append(ids[a:b])
                held += int(b - a)
                if len(names) == BLOCK_DOCS or held >= BLOCK_IDS:
                    yield close()
                    block, before, held = block + 1, before + held, 0
                    names, arrays = [], []
        if names:
            yield close()

    # the row's number parts equal rows, which may be many, over several ranges
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("h"), F.monotonically_increasing_id().alias("row"), whole_text().alias("text"))
    ranged = narrow.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    blocks = ranged.mapInArrow(run, BLOCKS)
    return files.write(blocks, f"{folder}/blocks")


def open_token_file(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    """Blocks and dictionary of a token file that any session wrote; a dictionary that is not the named one raises."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row["payload"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary in {folder} is damaged")
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), dictionary


def read_token_file(blocks: DataFrame, dictionary: bytes) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from its frame.

    start counts the ids of all documents before it: those of earlier parts (a sum
    over parts, of which there are as many as partitions) plus, from the block's
    header and index, those before it in its part.
    """
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_py(), dictionary)
                crc, n = [], []
                for row in range(len(block.index)):
                    ids = block.ids(row)
                    crc.append(crc32(ids))
                    n.append(len(ids))
                counts = np.array(n, np.int64)
                start = base + block.before + np.cumsum(counts) - counts
                docs = block.index["doc"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs.astype(np.int64), mask=docs == NO_ID), pa.array(start), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = blocks.join(F.broadcast(bases), "part").select("base", "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(docs: DataFrame, path: str, keeps_space: bool, width: int = 2, folder: str | None = None) -> tuple[DataFrame, bytes]:
    """Train the dictionary, write the file to ``folder`` (a new one in the shared folder by default) and open it; the blocks and the dictionary.

    Null texts are empty (the end id alone), null doc_ids come first, repeated rows
    are written once each, an empty table gives no block. ``width`` 2 holds ids below
    65,536, 4 holds any. The doc_id -2^63 stands for none in the index and raises. Columns other
    than doc_id and text are not read.
    """
    spark, folder = docs.sparkSession, folder or files.fresh(docs.sparkSession, "token-file")
    write_token_file(docs, path, keeps_space, train_dictionary(docs, path, keeps_space, width), width, folder)
    return open_token_file(spark, folder)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks, dictionary = token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), False)
    return read_token_file(blocks, dictionary)
