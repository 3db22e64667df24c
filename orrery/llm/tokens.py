"""Token ids of whole texts at column speed.

A text's ids are the ids of its space-delimited chunks, one after the other, as
these tokenizers never merge across a space. So each batch of texts is split and
dictionary-encoded by Arrow, distinct chunks are looked up by Arrow among those
known from before, and only new ones reach the tokenizers library: many in one
string, whose ids are told apart by the vocabulary's mark of a word's begin or end.
The ids are gathered by numpy. Where a byte-level tokenizer looks around white space
(a space at either end of the text, or next to other white space) the text is
encoded in one piece.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: white space of Unicode and of ASCII's separators.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = rf"(^ )|( $)|({_SPACE} )|( {_SPACE})"
#: Chunks that are encoded on their own: empty, with white space at an end, or with characters beyond these.
_ALONE = r"^$|^\s|\s$|[^\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{24f} \n\t]"
#: What a tokenizer without spaces cuts a text into, and the marks of a word's end and begin in the vocabularies.
_WORDS = r"(?i)'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_WORD_END, _SPACE_BEGIN = "</w>", "\u0120"
END_ID = 2
_CACHE: dict[tuple[str, bool], ChunkEncoder] = {}


class Memo[V]:
    """What was worked out for strings, in two generations of at most ``limit`` entries and ``most_bytes`` of strings each.

    When the young one is full it becomes the old one; what is asked for again
    moves back. So frequent strings stay, and memory is bounded. Strings of more than
    ``longest`` characters, such as texts without spaces, are worked out each time.
    """

    def __init__(self, limit: int = 400_000, most_bytes: int = 32 << 20, longest: int = 64) -> None:
        self.limit, self.most_bytes, self.longest = limit, most_bytes, longest
        self.young, self.old, self.held = {}, {}, 0

    def all(self, keys: list[str], make: Callable[[list[str]], list[V]]) -> list[V]:
        """The values of ``keys``; ``make`` works out those that are not known."""
        young, old = self.young, self.old
        found = [young.get(k) for k in keys]
        fresh = []
        for i, value in enumerate(found):
            if value is None:
                known = old.get(keys[i])
                if known is None:
                    fresh.append(i)
                else:
                    found[i] = young[keys[i]] = known
        if fresh:
            for i, value in zip(fresh, make([keys[i] for i in fresh]), strict=True):
                key = keys[i]
                found[i] = value
                if len(key) <= self.longest:
                    young[key] = value
                    self.held += len(key)
        if len(young) > self.limit or self.held > self.most_bytes:
            self.old, self.young, self.held = young, {}, 0
        return found


class Known:
    """Chunks whose ids are known: at most ``limit`` chunks (and a batch) of ``most_bytes``; full, it keeps the latest batch's.

    Chunks of more than ``longest`` bytes, such as texts without spaces, are not kept.
    ``encode`` gives the ids of chunks in a row, and how many each has.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], kind: type = np.uint32, limit: int = 400_000, most_bytes: int = 32 << 20, longest: int = 64) -> None:
        self.encode, self.limit, self.most_bytes, self.longest = encode, limit, most_bytes, longest
        self.chunks = pa.array([], pa.string())
        self.pool, self.length = np.zeros(0, kind), np.zeros(0, np.int64)

    def ids(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pool, start, length)``: each chunk's ids are a stretch of the pool."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.chunks), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        at[fresh] = len(self.length) + np.arange(len(fresh))
        new = distinct.take(pa.array(fresh))
        ids, length = self.encode(new)
        pool, length = np.concatenate([self.pool, ids]), np.concatenate([self.length, length])
        start = np.cumsum(length) - length
        keep = np.flatnonzero(pc.binary_length(distinct).to_numpy(zero_copy_only=False) <= self.longest)
        if len(self.chunks) + len(fresh) > self.limit or self.chunks.nbytes + new.nbytes > self.most_bytes:
            chunks, kept = distinct.take(pa.array(keep)), at[keep]
        else:
            keep = np.intersect1d(keep, fresh, assume_unique=True)
            chunks, kept = pa.concat_arrays([self.chunks, distinct.take(pa.array(keep))]), np.concatenate([np.arange(len(self.length)), at[keep]])
        self.chunks, self.length, self.pool = chunks, length[kept], gathered(pool, start[kept], length[kept])
        return pool, start[at], length[at]


def gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` from each start, of each length, in a row."""
    return pool[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]


class ChunkEncoder:
    """Encodes batches of texts with a tokenizer file.

    ``keeps_space``: a chunk is encoded with the space before it, as byte-level
    tokenizers do; otherwise the tokenizer drops white space.
    """

    def __init__(self, path: str, keeps_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.keeps_space = keeps_space
        vocabulary = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, number in vocabulary.items():
            self.marked[number] = token.startswith(_SPACE_BEGIN) if keeps_space else token.endswith(_WORD_END)
        self.inner, self.heads = Known(self._inner), Known(self._alone)

    def _alone(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text by itself, in a row, and how many."""
        length, parts = [], []
        for at in range(0, len(texts), 4096):
            for found in self.tokenizer.encode_batch_fast(texts.slice(at, 4096).to_pylist(), add_special_tokens=False):
                length.append(len(own := found.ids))
                parts.append(np.array(own, np.uint32))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array(length, np.int64)

    def _spaced(self, chunks: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise("", chunks, " ") if self.keeps_space else chunks

    def _inner(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that follow a space."""
        alone = pc.match_substring_regex(chunks, _ALONE).to_numpy(zero_copy_only=False)
        plain, others = np.flatnonzero(~alone), np.flatnonzero(alone)
        if not len(plain):
            return self._alone(self._spaced(chunks))
        own = chunks.take(pa.array(plain))
        ids, count = self._joined(own.to_pylist()), None
        marks = np.flatnonzero(self.marked[ids])
        if self.keeps_space:
            if len(marks) == len(own):
                count = np.diff(marks, append=len(ids))
        else:
            words = pc.count_substring_regex(own, _WORDS).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(marks) == int(words.sum()):
                count = np.diff(np.append(-1, marks)[np.cumsum(words)], prepend=-1)
        if count is None:
            return self._alone(self._spaced(chunks))
        more, more_count = self._alone(self._spaced(chunks.take(pa.array(others))))
        length = np.empty(len(chunks), np.int64)
        length[plain], length[others] = count, more_count
        start = np.empty(len(chunks), np.int64)
        start[plain], start[others] = np.cumsum(count) - count, len(ids) + np.cumsum(more_count) - more_count
        return gathered(np.concatenate([ids, more]), start, length), length

    def _joined(self, chunks: list[str], step: int = 256) -> np.ndarray:
        """Ids of many chunks in one go."""
        lead = " " if self.keeps_space else ""
        texts = [lead + " ".join(chunks[at : at + step]) for at in range(0, len(chunks), step)]
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the count of each text."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        words = pc.split_pattern(texts, " ")
        flat = pc.list_flatten(words)
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(per_text) - per_text
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pool, start, length = self.inner.ids(coded.dictionary)
        if self.keeps_space:
            heads = flat.take(pa.array(first)).dictionary_encode()
            more, head_start, head_length = self.heads.ids(heads.dictionary)
            index = index.copy()
            index[first] = len(start) + heads.indices.to_numpy(zero_copy_only=False)
            start, length = np.concatenate([start, head_start + len(pool)]), np.concatenate([length, head_length])
            pool = np.concatenate([pool, more])
        spread = length[index]
        ids, counts = gathered(pool, start[index], spread), np.add.reduceat(spread, first)
        if self.keeps_space:
            uneven = np.flatnonzero(pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False))
            if len(uneven):
                ids, counts = self._replaced(texts, ids, counts, uneven)
        return ids, counts

    def _replaced(self, texts: pa.Array, ids: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, length = self._alone(texts.take(pa.array(rows)))
        start = np.cumsum(counts) - counts
        start[rows] = len(ids) + np.cumsum(length) - length
        counts = counts.copy()
        counts[rows] = length
        return gathered(np.concatenate([ids, whole]), start, counts), counts


def encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """One encoder a process, so that chunks stay known from batch to batch."""
    key = (path, keeps_space)
    if key not in _CACHE:
        _CACHE[key] = ChunkEncoder(path, keeps_space)
    return _CACHE[key]


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, keeps_space: bool, most_bytes: int = 3 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of bounded size, each with the ids of its column ``text`` (END_ID after each text) and their counts."""
    code = encoder(path, keeps_space)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            part = batch.slice(at, to - at)
            ids, counts = code.encode(pc.fill_null(part.column(batch.schema.get_field_index("text")), ""))
            yield part, np.insert(ids, np.cumsum(counts), END_ID).astype("<u4"), counts + 1
            at = to


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
