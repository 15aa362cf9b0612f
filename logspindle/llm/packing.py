"""Order-preserving packing of token streams by dynamic programming."""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import kept, map_arrow
from . import textvec as tv

#: Tokens of a sequence.
LENGTH = 2048
#: The id that ends each document.
END = 1
#: Penalties, in tokens of padding: for a cut inside a document at a sentence's end, for one anywhere else, and for each sequence.
SENTENCE_CUT, HARD_CUT, SEQUENCE = 4, 32, 16
#: Bytes of text that are encoded and planned together (a longer document makes them more).
RUN = 2 << 20
#: Words whose ids a worker keeps: beyond these, the half that was used last stays.
CACHE = 400_000
#: Words of more tokens aren't kept.
LONG = 64
#: New words that the tokenizer gets as one text.
LINE = 64
# Letters of Latin-1, then ASCII signs but the apostrophe, which the tokenizer may join to letters.
_WORD_AND_SIGNS = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<signs>[!-&(-/:-@\\[-`{-~]*)$"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    For tokenizers that drop white space, never look across it and ignore case: a text's ids are those of its parts between
    blanks and line feeds. A part of letters and signs after them is two pieces to the tokenizer. Parts are told apart
    and looked up as Arrow columns; the tokenizer sees only pieces that the cache lacks.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_piece = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_piece[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.ends_sentence = np.zeros(len(self.ends_piece), bool)
        self.ends_sentence[[i for t in (".", "!", "?") if (i := self.tokenizer.token_to_id(t + "</w>")) is not None]] = True
        # the cache: pieces, where their ids begin in ``ids`` and how many they are, and when each was used last
        self.pieces = pa.array([""], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.begin, self.size, self.used = (np.zeros(1, np.int64) for _ in range(3))
        self.now = 0

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` one after the other, and the number of each word's. Words of one piece are encoded many at once, cut where a token ends a piece."""
        lines = [" ".join(words[i : i + LINE]) for i in range(0, len(words), LINE)]
        ids = self._batch(lines)[0]
        cuts = np.flatnonzero(self.ends_piece[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) else self._batch(words)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.array([len(i) for i in got], np.int64)
        return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size

    def _entries(self, pieces: pa.Array, whole: np.ndarray) -> np.ndarray:
        """The cache's entry of each piece (all different), learned where it is new. ``whole``: pieces that are one piece to the tokenizer."""
        at = pc.index_in(pieces, value_set=self.pieces)
        new = at.is_null()
        if (n := at.null_count) == 0:
            at = at.to_numpy()
        else:
            mask = new.to_numpy(zero_copy_only=False)
            fresh, one = pieces.filter(new), whole[mask]
            parts = []
            for kind, learn in ((one, self._words), (~one, self._batch)):
                if kind.any():
                    own = fresh.filter(pa.array(kind))
                    parts.append((own, *learn(own.to_pylist()), np.flatnonzero(kind)))
            where = np.empty(n, np.int64)
            where[np.concatenate([p[3] for p in parts])] = np.arange(n) + len(self.size)
            size = np.concatenate([p[2] for p in parts])
            self.pieces = pa.concat_arrays([self.pieces, *[p[0] for p in parts]])
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.ids = np.concatenate([self.ids, *[p[1] for p in parts]])
            self.size, self.used = np.concatenate([self.size, size]), np.concatenate([self.used, np.zeros(n, np.int64)])
            at = at.fill_null(0).to_numpy().astype(np.int64)
            at[mask] = where
        self.used[at] = self.now
        return at

    def _forget(self) -> None:
        """Keeps short pieces only, and of these the ones used last."""
        keep = self.size <= LONG
        least = np.partition(self.used, -CACHE // 2)[-CACHE // 2] if len(self.used) > CACHE // 2 else 0
        keep &= self.used > least if (self.used > least).any() else np.arange(len(self.used)) >= len(self.used) - CACHE // 2
        keep[0] = True
        self.pieces = self.pieces.filter(pa.array(keep))
        self.ids = self.ids[np.repeat(keep, self.size)]
        self.size, self.used = self.size[keep], self.used[keep]
        self.begin = np.cumsum(self.size) - self.size

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and the number of each text's, from UTF-8 bytes and the texts' offsets."""
        self.now += 1
        raw = np.where(raw == 10, np.uint8(32), raw)
        texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(raw))
        split = pc.split_pattern(texts, " ")
        of, cuts = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        parts = of.dictionary
        cut = pc.extract_regex(parts, _WORD_AND_SIGNS)
        plain = cut.is_valid()
        words = pc.if_else(plain, pc.utf8_lower(cut.field("word")), parts).dictionary_encode()
        signs = pc.if_else(plain, cut.field("signs"), "").dictionary_encode()
        whole = np.zeros(len(words.dictionary), bool)
        whole[words.indices.to_numpy()] = plain.to_numpy(zero_copy_only=False)
        word = self._entries(words.dictionary, whole)[words.indices.to_numpy()]
        sign = self._entries(signs.dictionary, np.array(signs.dictionary) != "")[signs.indices.to_numpy()]
        both = np.stack([word, sign], 1)[of.indices.to_numpy()].ravel()
        size = self.size[both]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[both] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.append(0, ends)[cuts * 2]
        if len(self.size) > CACHE or len(self.ids) > CACHE * 8 or (self.size > LONG).any():
            self._forget()
        return ids, np.diff(ends)


def plan(ends: np.ndarray, sentences: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ends of the sequences of a stream of ``ends[-1]`` tokens.

    ``ends``: where documents end; ``sentences``: where sentences end. Minimises the padding (up to ``length``, none
    for a sequence whose size is a power of two) plus the cuts' penalties. f(j), the least cost up to boundary j, is
    pen(j) + length - b(j) + min(f(i) + b(i)) over the boundaries i within ``length`` before j: that minimum slides
    with j, so a monotone queue gives it in constant time.
    """
    total = int(ends[-1])
    pen_at = np.full(total + 1, -1, np.int64)  # by position, -1 where no boundary is
    pen_at[sentences[sentences <= total]] = SENTENCE_CUT
    pen_at[ends] = pen_at[0] = 0
    b = np.flatnonzero(pen_at >= 0)
    gaps = np.flatnonzero(np.diff(b) > length)
    if len(gaps):  # no boundary within reach: cuts at full length
        pen_at[np.concatenate([np.arange(b[g] + length, b[g + 1], length) for g in gaps])] = HARD_CUT
        b = np.flatnonzero(pen_at >= 0)
    pen = pen_at[b]
    index = pen_at
    index[b] = np.arange(len(b))
    exact: dict[int, list[int]] = {}
    size = 1
    while size < length:
        j = np.searchsorted(b, size)
        at = index[b[j:] - size]
        for k in np.flatnonzero(at >= 0).tolist():
            exact.setdefault(int(j) + k, []).append(int(at[k]))
        size *= 2
    pos, cost = b.tolist(), (pen + SEQUENCE).tolist()
    f, back = [0] * len(pos), [0] * len(pos)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + b(i), i), rising
    for j in range(1, len(pos)):
        here = pos[j]
        while here - pos[queue[0][1]] > length:
            queue.popleft()
        least, i = queue[0]
        least += length - here
        if j in exact:
            for k in exact[j]:
                if f[k] < least:
                    least, i = f[k], k
        f[j], back[j] = least + cost[j], i
        key = f[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(pos) - 1
    while j > 0:
        cuts.append(pos[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, run_bytes: int = RUN, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document that a sequence of at most ``length`` tokens holds, in the order of the rows.

    doc_id, start (the document's ids before the piece), length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), doc_tokens, sequence_id, offset (of the piece in its sequence), and with ``with_ids`` the ids
    themselves. Each document ends with the id ``END``; a null or empty text is that id alone. Each partition is packed by itself,
    ``run_bytes`` of text at a time, so memory is bounded and a task that runs again gives the same rows; a sequence's number
    holds its partition's. Rows that repeat an id are documents of their own, null ids stay, no rows give no pieces.
    """
    path = tokenizer or tokenizer_path()
    schema = _SCHEMA + (", ids array<int>" if with_ids else "")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Ids of rows, bytes and offsets of their texts."""
        ids, raws, sizes, n = [], [], [], 0
        for batch in batches:
            raw, off = tv.text_buffer(batch.column(1))
            for lo, hi in tv.runs(off, run_bytes):
                ids.append(batch.column(0).slice(lo, hi - lo))
                raws.append(raw[off[lo] : off[hi]])
                sizes.append(np.diff(off[lo : hi + 1]))
                n += len(raws[-1])
                if n >= run_bytes:
                    yield pa.concat_arrays(ids), np.concatenate(raws), np.append(0, np.cumsum(np.concatenate(sizes)))
                    ids, raws, sizes, n = [], [], [], 0
        if ids:
            yield pa.concat_arrays(ids), np.concatenate(raws), np.append(0, np.cumsum(np.concatenate(sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(path, lambda: Encoder(path))
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for ids, raw, off in runs(batches):
            tokens, sizes = encoder(raw, off)
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            stream = np.full(int(ends[-1]), END, np.uint32)
            own = np.ones(len(stream), bool)
            own[ends - 1] = False
            stream[own] = tokens
            cuts = plan(ends, np.flatnonzero(encoder.ends_sentence[stream]) + 1, length)
            stops = np.union1d(ends, cuts)
            starts = np.concatenate([[0], stops[:-1]])
            doc, seq = np.searchsorted(ends, starts, "right"), np.searchsorted(cuts, starts, "right")
            first, opened = ends - sizes, np.concatenate([[0], cuts[:-1]])
            bytes_ = memoryview(stream.astype("<u4").tobytes())
            crc = [zlib.crc32(bytes_[4 * a : 4 * z]) for a, z in zip(starts.tolist(), stops.tolist(), strict=True)]
            columns = [ids.take(pa.array(doc)), pa.array(starts - first[doc]), pa.array(stops - starts), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(seq + base), pa.array(starts - opened[seq])]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(stream.astype(np.int32))))
            base += len(cuts)
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema, keeps=path)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
