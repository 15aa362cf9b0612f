"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow
from . import textvec as tv
from .shared import settle, spare

#: Words of a window.
WINDOW = 10
#: Extra words that a proximity match may hold.
SLOP = 3
#: Bytes of text of an index segment (a longer document is a segment of its own).
SEGMENT = 2 << 20
#: Positions left free between documents, so that no match spans two.
GAP = 64
#: Bytes of test items that go to the executors at once; more are searched in blocks.
BLOCK = 16 << 20

# terms (unsigned 64 bits), where each one's positions end, and the positions as differences from the one before (32 bits) are kept as bytes
_INDEX = "segment long, docs array<long>, n_words array<long>, first array<long>, terms binary, ends binary, positions binary"
_FOUND = "segment long, number int, doc_id long, n_words long, n_hit long, matches array<struct<item_id:string,kind:string,start:long,length:long>>"
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


def _postings(h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, where each one's positions end, and the positions, rising within a term."""
    order = np.argsort(h)
    h = h[order]
    new = h[1:] != h[:-1]
    both = np.cumsum(np.append(0, new)[: len(h)]) << 32 | pos[order]
    both.sort()
    cut = np.flatnonzero(np.append(new, True)) if len(h) else np.zeros(0, np.int64)
    return h[cut], cut + 1, (both & 0xFFFFFFFF).astype(np.int32)


def _segments(segment: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
        for batch in batches:
            raw, off = tv.text_buffer(batch.column(1))
            for lo, hi in tv.runs(off, segment):
                part, at = tv.LOWER[raw[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
                starts, ends, row = tv.words(part, at, tv.ALNUM)
                n = np.bincount(row, minlength=hi - lo).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(n + GAP)[:-1]])
                terms, ends, pos = _postings(tv.word_hashes(part, starts, ends), np.arange(len(row)) + row * GAP)
                ids = batch.column(0).slice(lo, hi - lo).cast(pa.int64())
                raws = [terms.astype("<u8"), ends.astype("<i4"), np.diff(pos, prepend=np.int32(0)).astype("<i4")]
                columns = [pa.array([number], pa.int64()), *[one(x) for x in (ids, n, first)], *[pa.array([x.tobytes()], pa.binary()) for x in raws]]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _INDEX.split(", ")])
                number += 1

    return make


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Token postings of all words of ``docs``, stored: a row for each segment of documents, with positions by term hash.

    A segment's positions count words through its documents, ``GAP`` free ones between two; ``docs``, ``n_words`` and ``first``
    have each document's id, number of words and first position.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return settle(map_arrow(texts, _segments(segment), _INDEX), compression="zstd", **{"parquet.block.size.row.check.min": 8})


class Windows(NamedTuple):
    """Different windows of a block of items: their words as places in ``terms``, and the items that have each."""

    names: list[str | None]
    terms: np.ndarray
    at: np.ndarray
    cuts: np.ndarray
    owners: np.ndarray
    owner_cuts: np.ndarray


def windows_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Windows:
    """The windows of (item, text); an item of fewer words is one window, of none no window."""
    seen: dict[bytes, list[int]] = {}
    for i, (_, text) in enumerate(items):
        if words := _words(text):
            h = tv.string_hashes(words)
            for k in range(max(1, len(h) - window + 1)):
                own = seen.setdefault(h[k : k + window].tobytes(), [])
                if not own or own[-1] != i:
                    own.append(i)
    ends = lambda sizes: np.append(0, np.cumsum(np.array(list(sizes), np.int64)))
    terms, at = np.unique(np.frombuffer(b"".join(seen), np.uint64), return_inverse=True)
    return Windows([name for name, _ in items], terms, at, ends(len(k) // 8 for k in seen), np.array([i for v in seen.values() for i in v], np.int64), ends(map(len, seen.values())))


def _words(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace").lower()
    return raw.translate(bytes(b if tv.ALNUM[b] else 32 for b in range(256))).split()


def _phrase(lists: list[np.ndarray]) -> np.ndarray:
    """Starts of the phrase: offset-adjusted lists intersected from the rarest on."""
    order = sorted(range(len(lists)), key=lambda i: len(lists[i]))
    at = lists[order[0]] - order[0]
    for i in order[1:]:
        if not len(at):
            break
        where = np.minimum(np.searchsorted(lists[i], at + i), len(lists[i]) - 1)
        at = at[lists[i][where] == at + i]
    return at


def _near(lists: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of places that have the words in order with at most ``slop`` others between, but one at least."""
    rare = min(range(len(lists)), key=lambda i: len(lists[i]))
    begin = np.unique((lists[rare] - rare)[:, None] - np.arange(slop + 1)[None, :])
    where = np.minimum(np.searchsorted(lists[0], begin), len(lists[0]) - 1)
    begin = begin[lists[0][where] == begin]
    if not len(begin):
        return begin, begin
    at, ok = begin, np.ones(len(begin), bool)
    for x in lists[1:]:
        where = np.searchsorted(x, at, "right")
        ok &= where < len(x)
        at = x[np.minimum(where, len(x) - 1)]
    length = at - begin + 1
    ok &= (length > len(lists)) & (length <= len(lists) + slop)
    return begin[ok], length[ok]


def _merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and end of the spans that overlapping or touching ones of one key make together."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start, end
    group = np.cumsum(np.append(0, key[1:] != key[:-1])) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + group)
    new = np.append(True, start[1:] + group[1:] > far[:-1])
    cut = np.flatnonzero(new)
    return key[cut], start[cut], far[np.append(cut[1:], len(key)) - 1] - group[cut]


def _hits(words: Windows, slop: int | None, terms: np.ndarray, begin: np.ndarray, ends: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window, kind (0: phrase, 1: proximity), position and length of what a segment has of the windows."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(words.at):
        return none, none, none, none
    near = np.minimum(np.searchsorted(terms, words.terms), len(terms) - 1)
    term = np.where(terms[near] == words.terms, near, -1)[words.at]
    found = [(none, none, none, none)]
    for w in np.flatnonzero(np.minimum.reduceat(term, words.cuts[:-1]) >= 0).tolist():
        lists = [pos[begin[t] : ends[t]] for t in term[words.cuts[w] : words.cuts[w + 1]].tolist()]
        at = _phrase(lists)
        if len(at):
            found.append((np.full(len(at), w), np.zeros(len(at), np.int64), at, np.full(len(at), len(lists))))
        if slop:
            at, size = _near(lists, slop)
            if len(at):
                found.append((np.full(len(at), w), np.ones(len(at), np.int64), at, size))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _finder(words: Windows, slop: int | None):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(words.names, pa.string())
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n, first = (batch.column(i).slice(r, 1).flatten() for i in range(1, 4))
                n, first = n.to_numpy(), first.to_numpy()
                terms, ends, pos = (np.frombuffer(batch.column(i)[r].as_buffer(), kind) for i, kind in ((4, "<u8"), (5, "<i4"), (6, "<i4")))
                w, kind, at, size = _hits(words, slop, terms, np.append(0, ends)[:-1], ends, np.cumsum(pos, dtype=np.int64))
                doc = np.searchsorted(first, at, "right") - 1
                start = at - first[doc]
                exact = kind == 0
                d, a, z = _merged(doc[exact], start[exact], (start + size)[exact])
                n_hit = np.bincount(d, weights=z - a, minlength=len(n)).astype(np.int64)
                # a span for each item: windows that several items have count for each
                many = np.diff(words.owner_cuts)[w]
                each = np.repeat(np.arange(len(w)), many)
                owner = words.owners[np.repeat(words.owner_cuts[:-1][w] - (np.cumsum(many) - many), many) + np.arange(len(each))]
                items = max(1, len(words.names))
                key, a, z = _merged((doc[each] * 2 + kind[each]) * items + owner, start[each], (start + size)[each])
                spans = pa.StructArray.from_arrays([names.take(pa.array(key % items)), pa.array(["phrase", "proximity"]).take(pa.array(key // items % 2)), pa.array(a), pa.array(z - a)], fields=list(_MATCHES.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(key // items // 2, minlength=len(n)))), pa.int32()), spans)
                segment = pa.array(np.full(len(n), batch.column(0)[r].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([segment, pa.array(np.arange(len(n)), pa.int32()), ids, pa.array(n), pa.array(n_hit), lists], [c.split()[0] for c in _FOUND.split(", ")])

    return find


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_hit anew from the phrases of all blocks."""
    for batch in batches:
        flat = batch.column(5).flatten()
        row = np.repeat(np.arange(batch.num_rows), batch.column(5).value_lengths().to_numpy())
        exact = np.array([k == "phrase" for k in flat.field(1).to_pylist()], bool)
        start = flat.field(2).to_numpy()[exact]
        d, a, z = _merged(row[exact], start, start + flat.field(3).to_numpy()[exact])
        n_hit = np.bincount(d, weights=z - a, minlength=batch.num_rows).astype(np.int64)
        yield batch.set_column(4, "n_hit", pa.array(n_hit))


def search(index: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = SLOP, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit and matches (item_id, kind, start, length in words) of each document of a stored ``index``.

    Kind ``phrase`` is word for word, ``proximity`` in order with up to ``slop`` words between (``slop`` None: not looked for); overlapping or
    touching windows of one item and kind are one match. The items are sent to the executors in blocks of at most about ``block``
    bytes of text, however many there are; each block is a pass over the index, not over the texts.
    """
    if window + (slop or 0) > GAP:
        raise ValueError(f"windows of at most {GAP} words")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    out = None
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = sorted(((r["item"], r["text"]) for r in mine.toLocalIterator()), key=lambda x: (x[0] or "", x[1]))
        found = map_arrow(index, _finder(windows_of(rows, window), slop), _FOUND)
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        out = settle(out)  # a block's windows needn't stay in the plan
        out = out.groupBy("segment", "number").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.flatten(F.collect_list("matches")).alias("matches"))
        out = map_arrow(out, _union, _FOUND)
    return out.drop("segment", "number")


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = SLOP, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but those in which ``search`` finds a match, exact or near.

    Each row is decided by its own text, whatever its id: the index holds 64-bit hashes of the texts; where two texts share one,
    they are searched again under numbers of their own.
    """
    key, sha = spare(docs, "__key"), spare(docs, "__sha")
    look = lambda df, id_col: search(build_index(df, id_col=id_col, text_col="text"), benchmark, item_col=item_col, item_text_col=item_text_col, window=window, slop=slop, block=block).where(F.size("matches") > 0)
    texts = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    hits = settle(look(texts, "key").select(F.col("doc_id").alias("key")).distinct())
    meant = settle(texts.join(hits, "key", "left_semi").select("key", F.sha2("text", 256).alias("sha")).distinct())
    if meant.count() == hits.count():
        return docs.withColumn(key, F.xxhash64(text_col)).join(hits.withColumnRenamed("key", key), key, "left_anti").select(*docs.columns)
    some = settle(texts.join(hits, "key", "left_semi").withColumn("sha", F.sha2("text", 256)).dropDuplicates(["sha"]).withColumn("number", F.monotonically_increasing_id()))
    bad = some.join(look(some, "number").select(F.col("doc_id").alias("number")).distinct(), "number").select(F.col("sha").alias(sha))
    return docs.withColumn(sha, F.sha2(text_col, 256)).join(settle(bad), sha, "left_anti").select(*docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = SLOP, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids with an exact window), near_items, contaminated for each document.

    Builds and stores the index of ``docs``, then searches it. A document's words are hit where they lie inside an exact occurrence of a
    window of ``window`` consecutive words of an item (an item of fewer words is one window). Null and empty texts have no words; items without words match
    nothing; an item with a null id counts in n_hit and contaminated but is in no list of ids; rows that repeat an id get a row each; a null id stays; an empty benchmark hits nothing.
    """
    out = search(build_index(docs, id_col=id_col, text_col=text_col), benchmark, item_col=item_col, item_text_col=item_text_col, window=window, slop=slop, block=block)
    of = lambda kind: F.array_sort(F.array_distinct(F.array_compact(F.transform(F.filter("matches", lambda m: m["kind"] == kind), lambda x: x["item_id"]))))
    return out.select("doc_id", "n_words", "matches", "n_hit", of("phrase").alias("items"), of("proximity").alias("near_items")).withColumn("contaminated", F.col("n_hit") > 0)


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))
