"""N-gram Jaccard join: parity sketches, pigeonhole blocks per size band, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow
from . import textvec as tv
from .shared import discard, join_hot, store

SHINGLE = 5
#: Two sets link when NUMERATOR * union <= 100 * intersection.
PERCENT = 75
#: Sets up to SMALL / similarity are also keyed by single shingles (see ``_keys``).
SMALL = 24
#: Blocks of a sketch that become keys, at least; sketches with fewer blocks are drawn again with other hashes.
BLOCKS = 56
#: Shingles that a block has to hold to become a key.
FULL = 2
#: Members of a key group that are compared with each other at once; larger groups are compared with leaders first.
GROUP = 24
#: Shingle counts by hash, in so many places (a megabyte of levels), order the shingles of prefixes; written in slices.
PLACES, SLICE = 1 << 20, 1 << 14
#: Members of a shingle's group that one task compares; larger groups are dealt out as pairs of parts.
PART = 128
#: 64-bit words, at least, of the parity sketch that is compared before sets are.
SKETCH = 8
#: So many rows at most are broadcast; more are joined by a shuffle.
BROADCAST = 1 << 20
#: Bytes of text handled at once (a longer document alone).
RUN = 1 << 19


def shingles(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each distinct shingle, ordered by both. Rows of fewer words have one, of none no shingle."""
    raw = tv.LOWER[raw]
    starts, ends, row = tv.words(raw, off, tv.BETWEEN_SPACES)
    h = tv.word_hashes(raw, starts, ends)
    n = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(n) - n
    held = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.zeros(int(held.sum()), np.uint64)
    start = np.cumsum(held) - held
    if len(h) >= size:
        g = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            g = tv.mix(g ^ h[k : len(h) - size + 1 + k]) + np.uint64(k + 1)
        out[np.repeat(n >= size, held)] = g[row[: len(g)] == row[size - 1 :]]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            g = np.zeros(len(short), np.uint64)
            for i in range(k):
                g = tv.mix(g ^ h[first[short] + i]) + np.uint64(i + 1)
            out[start[short]] = tv.mix(g ^ np.uint64(k << 32))
    row, g = np.repeat(np.arange(len(n)), held), tv.mix(out)
    _sort_rows(g, held)
    if not len(g):
        return row, g
    new = np.append(True, (row[1:] != row[:-1]) | (g[1:] != g[:-1]))
    return row[new], g[new]


def _sort_rows(values: np.ndarray, n: np.ndarray) -> None:
    """Sorts each row's ``n`` values, in place: many short sorts are several times as fast as one of pairs."""
    ends = np.cumsum(n)
    many = n > 1
    for a, b in zip((ends - n)[many].tolist(), ends[many].tolist(), strict=True):
        values[a:b].sort()


def bands(percent: int = PERCENT) -> np.ndarray:
    """Lower ends of the size bands: a set's partners lie in its own band or a neighbouring one."""
    at = [1]
    while at[-1] < 1 << 40:
        at.append(max(at[-1] + 1, -(-at[-1] * 100 // percent)))
    return np.array(at, np.int64)


def _keys(row: np.ndarray, g: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the pigeonhole blocks of each set's parity sketches.

    A sketch has a bit for each hash value and holds the parity of the shingles that fall on it, so the Hamming distance of
    two sketches is at most the symmetric difference of the sets, which for linked sets whose smaller one has a
    shingles is at most d = a (1/t - 1). Cut into d + 1 blocks, at least one block is equal. A block's key is its
    bit pattern (as the exclusive or of a random number for each set bit), its number and the band for which d was taken;
    a set has sketches for its own band and the one below, as the smaller set of a pair may lie there.

    Blocks of few shingles say little and are left out, and of sketches with many blocks, ``BLOCKS`` suffice: equal
    blocks are then found with a chance beyond 1 - 1e-7 even for pairs at the threshold itself (``link`` looks for the others
    afterwards); sketches of fewer blocks are drawn repeatedly up to that number. For small sets, where d + 1 is small, that doesn't hold; they get keys of single
    shingles instead: of the least hashes, so many that two linked sets must share one.
    """
    edge = bands(percent)
    start = np.cumsum(n) - n
    rows, keys = [], []
    small = n * percent <= SMALL * 100
    take = np.where(small, n - -(-n * percent // 100) + 1, 0)
    rank = np.arange(len(row)) - start[row]
    pick = rank < take[row]
    rows.append(row[pick])
    keys.append(tv.mix(g[pick] ^ np.uint64(0xA5A5)))
    band = np.searchsorted(edge, n, "right") - 1
    for below in (0, 1):
        level = band - below
        top = edge[np.minimum(level + 1, len(edge) - 1)] - 1  # the largest size of the band
        parts = top * (100 - percent) // percent + 1
        use = (n >= SMALL) & (level >= 0)
        draws = np.where(use, -(-BLOCKS // parts), 0)
        for draw in range(int(draws.max(initial=0))):
            mine = np.flatnonzero((draw < draws)[row])
            r = row[mine]
            bit = tv.mix(g[mine] + np.uint64(1 + draw * 0x51ED27))
            block = (bit % parts[r].astype(np.uint64)).astype(np.int64)
            keep = block < BLOCKS
            r, bit, block = r[keep], bit[keep], block[keep]
            if not len(r):
                continue
            at = r * (BLOCKS + 1) + block
            order = np.argsort(at, kind="stable")
            at, bit = at[order], bit[order]
            cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            held = np.diff(np.append(cut, len(at)))
            # 2**32 positions a sketch: each set bit stands for a random number, equal bits cancel
            pattern = np.bitwise_xor.reduceat(tv.mix(bit >> np.uint64(32)), cut)
            full = held >= FULL
            at, pattern = at[cut][full], pattern[full]
            r = at // (BLOCKS + 1)
            tag = (level[r] << 20) + (np.int64(draw) << 10) + at % (BLOCKS + 1)
            rows.append(r)
            keys.append(tv.mix(pattern ^ tv.mix(tag.astype(np.uint64) + np.uint64(1 << 50))))
    return np.concatenate(rows), np.concatenate(keys)


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    order = np.argsort(row, kind="stable")
    ends = np.cumsum(np.bincount(row, minlength=rows))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values[order].view(np.int64)))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, rows and hashes of shingles, and set sizes of (id, text) rows, a run of documents at a time."""
    raw, off = tv.text_buffer(batch.column(1))
    for lo, hi in tv.runs(off, RUN):
        row, g = shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield batch.column(0).slice(lo, hi - lo), row, g, np.bincount(row, minlength=hi - lo)


def _map(docs: DataFrame, schema: str, of) -> DataFrame:
    """Rows of (doc_id, text) through ``of(ids, row, hashes, sizes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _each(batch):
                yield of(*part)

    return map_arrow(docs, run, schema)


def _fingerprint(row: np.ndarray, g: np.ndarray, rows: int) -> list[pa.Array]:
    """128 bits for each set, in two columns."""
    sums = [np.zeros(rows, np.uint64) for _ in range(2)]
    for i in range(2):
        np.add.at(sums[i], row, tv.mix(g + np.uint64(i * 7919 + 11)))
    return [pa.array(s.view(np.int64)) for s in sums]


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (h1, h2) and the set's keys.

    Rows with n_shingles -1 have counts instead: those of the partition's shingles in the slice h1 of the places, packed by zstandard.
    """
    names = ["doc_id", "n_shingles", "h1", "h2", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PLACES, np.int64)
        for batch in batches:
            for ids, row, g, n in _each(batch):
                np.add.at(counts, g & np.uint64(PLACES - 1), 1)
                own, keys = _keys(row, g, n, percent)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), *_fingerprint(row, g, len(n)), _lists(own, keys, len(n)), pa.nulls(len(n), pa.binary())], names)
        slices = counts.reshape(-1, SLICE)
        used = np.flatnonzero(slices.any(1))
        packed = [zstandard.compress(x.astype("<u4" if x.max() < 1 << 32 else "<u8").tobytes(), 1) for x in slices[used]]
        none = pa.array(np.zeros(len(used), np.int64))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.array(np.full(len(used), -1)), pa.array(used), none, pa.nulls(len(used), pa.list_(pa.int64())), pa.array(packed, pa.binary())], names)

    return map_arrow(docs, run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, counts binary")


def sets(docs: DataFrame) -> DataFrame:
    """h1, h2 and the set's hashes, ascending."""
    return _map(docs, "h1 long, h2 long, hashes array<long>", lambda ids, row, g, n: pa.RecordBatch.from_arrays([*_fingerprint(row, g, len(n)), _lists(row, g, len(n))], ["h1", "h2", "hashes"]))


def candidates(reps: DataFrame) -> DataFrame:
    """Pairs (a < b) of ``reps`` (id, keys, more) that share a key.

    Members of a key group of up to ``GROUP`` are paired with each other. In a larger one each member is paired with one of the
    group's leaders, its smallest and its largest id, by the key: near copies share dozens of keys and so meet both.
    What that leaves apart is for ``cross_pairs``.
    """
    rows = reps.select("id", F.explode("keys").alias("key"))
    lead = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.max("id").alias("high"))
    lead = store(lead.where(F.col("size") > 1), [reps])
    two = lead.where(F.col("size") == 2).select(F.col("low").alias("a"), F.col("high").alias("b"))
    shared = store(join_hot(rows, lead.where(F.col("size") > 2), ["key"], "size"), [reps])
    some = shared.where(F.col("size") <= GROUP).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("m"))
    inner = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, GROUP), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = some.select(F.explode(inner).alias("p")).select("p.a", "p.b")
    led = shared.where(F.col("size") > GROUP).select("id", F.when(F.col("key") % 2 == 0, F.col("low")).otherwise(F.col("high")).alias("leader"))
    many = led.where(F.col("id") != F.col("leader")).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    return two.unionByName(pairs).unionByName(many).distinct()


def levels(base: DataFrame) -> np.ndarray:
    """How common shingles are, from the counts in ``base``: the logarithm of the count at each of ``PLACES`` places, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                at, raw = batch.column(0)[i].as_py(), zstandard.decompress(batch.column(1)[i].as_py())
                sums[at] = sums.get(at, 0) + np.frombuffer(raw, "<u4" if len(raw) == 4 * SLICE else "<u8").astype(np.int64)
        rows = [np.floor(4 * np.log2(n + 1.0)).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(rows, pa.binary())], ["slice", "level"])

    out = np.zeros((PLACES // SLICE, SLICE), np.uint8)
    for r in map_arrow(base.where("n_shingles = -1").select("h1", "counts").repartition("h1"), run, "slice long, level binary").collect():  # a megabyte
        out[r["slice"]] = np.frombuffer(r["level"], np.uint8)
    return out.ravel()


def prefix_columns(row: np.ndarray, g: np.ndarray, n: np.ndarray, level: np.ndarray, percent: int) -> list[pa.Array]:
    """Each set's size, its prefix and its parity sketch.

    Shingles are ordered from rare to common. Two linked sets share a shingle of their prefixes of n - ceil(t n) + 1 in any
    order that all sets have in common, so places that several shingles fall on cost time, not links. A token is a shingle's level and 56 bits
    of its hash; shingles that fall on one token only make more candidates. A sketch has two bits and more for each shingle, in a
    power of two of words, so that a longer one folds to a shorter one.
    """
    tokens = level[g & np.uint64(PLACES - 1)].astype(np.uint64) << np.uint64(56) | g >> np.uint64(8)
    _sort_rows(tokens, n)
    rank = np.arange(len(g)) - (np.cumsum(n) - n)[row]
    pick = rank < (n - -(-n * percent // 100) + 1)[row]
    words = SKETCH << np.ceil(np.log2(np.maximum(1, n / (SKETCH * 32)))).astype(np.int64)
    ends = np.cumsum(words)
    bits = np.zeros(int(words.sum()), np.uint64)
    bit = tv.mix(g + np.uint64(0x77))
    np.bitwise_xor.at(bits, (ends - words)[row] + (bit >> np.uint64(6) & (words - 1).astype(np.uint64)[row]).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    sketch = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends * 8).astype(np.int32)), pa.py_buffer(bits.tobytes())])
    return [pa.array(n.astype(np.int64)), _lists(row[pick], tokens[pick], len(n)), sketch]


def prefixes(docs: DataFrame, level: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """h1, h2, n, tokens (the set's prefix, rare shingles first) and bits (its parity sketch)."""
    of = lambda ids, row, g, n: pa.RecordBatch.from_arrays([*_fingerprint(row, g, len(n)), *prefix_columns(row, g, n, level, percent)], ["h1", "h2", "n", "tokens", "bits"])
    return _map(docs, "h1 long, h2 long, n long, tokens array<long>, bits binary", of)


def cross_pairs(held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every pair (a < b) of ``held`` (id, component, n, tokens, bits) from two components that may link: none that links is missing.

    Pairs share a shingle of their prefixes, after which enough shingles are left in both sets, and the Hamming distance of their
    parity sketches is no larger than the symmetric difference of a linked pair.
    """
    rank, left = F.col("rank"), F.col("n") - F.col("rank")
    # of a linked pair, the smaller set has a shared shingle so early that twice its size counts
    early = rank <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    rows = held.select("id", "component", "n", F.posexplode("tokens").alias("rank", "token"))
    rows = rows.select("id", "component", "n", left.alias("left"), "token", early.alias("early"))
    first = F.min(F.when(F.col("early"), F.col("n")))
    span = [F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), first.alias("first")]
    # few rare shingles lie in several components: they go to the tasks where they are few enough
    mixed = store(rows.groupBy("token").agg(*span).where((F.col("lo") < F.col("hi")) & F.col("first").isNotNull()).select("token", "size"), [held])
    rows = _with_tokens(held, mixed, percent) if mixed.count() <= BROADCAST else join_hot(rows, mixed, ["token"], "size").drop("size")
    rows = store(rows.withColumn("reach", F.floor(F.col("left") * (100 + percent) / percent).cast("long") - F.col("n")), [held])
    # a set whose partners would all be smaller than the token's smallest set, or out of the others' reach, has none by this token
    ends = store(rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.max("reach").alias("far"), first.alias("first")), [rows])
    fits = (F.col("reach") >= F.col("least")) & (F.col("n") <= F.col("far")) & (F.col("early") | (F.col("n") >= F.col("first")))
    fit = store(join_hot(rows, ends, ["token"], "size").where(fits).drop("size", "least", "far", "first"), [rows, ends])
    # members of a token's largest component aren't compared with each other: each lies in one part, and the others come to it
    sizes = fit.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("token").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
    parts = lambda n: F.ceil(n / PART).cast("long")
    of = store(sizes.where("components > 1").select("token", "size", F.col("top.component").alias("top"), parts(F.col("top.n")).alias("tops"), parts(F.col("size") - F.col("top.n")).alias("others")), [fit])
    in_top = F.col("component") == F.col("top")
    upto = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    zero, own = F.lit(0).cast("long"), F.col("own")
    cells = (
        F.when(F.col("size") <= PART, F.array(cell(0, zero, zero)))
        .when(in_top, upto("others", lambda x: cell(1, x, own)))
        .otherwise(F.concat(upto("others", lambda x: cell(0, F.least(own, x), F.greatest(own, x))), upto("tops", lambda x: cell(1, own, x))))
    )
    dealt = join_hot(fit, of, ["token"], "size").withColumn("own", F.pmod(F.xxhash64("id"), F.when(in_top, F.col("tops")).otherwise(F.col("others"))))
    dealt = dealt.withColumn("cell", F.explode(cells)).withColumn("own", F.when(in_top, F.lit(-1).cast("long")).otherwise(own))
    member = F.struct("id", "component", "n", "left", "own", F.col("early").cast("long").alias("early")).alias("m")
    groups = dealt.groupBy("token", "cell").agg(F.collect_list(member).alias("m")).select(((F.col("cell.kind") == 0) & (F.col("cell.i") == F.col("cell.j"))).alias("alike"), "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(1)
            off, flat = m.offsets.to_numpy(), m.flatten()
            ids, comp, n, left, own, early = (flat.field(k).to_numpy() for k in range(6))
            off = off - off[0]
            found = []
            for lo, hi, one in zip(off[:-1].tolist(), off[1:].tolist(), batch.column(0).to_pylist(), strict=True):
                c, o = comp[lo:hi], own[lo:hi]
                may = c[:, None] != c[None, :]
                if not one:
                    may &= o[:, None] != o[None, :]
                x, y = np.nonzero(np.triu(may, 1))
                x, y = x + lo, y + lo
                both, total = np.minimum(left[x], left[y]), n[x] + n[y]
                fit = (both * (100 + percent) >= total * percent) & ((early[x] > 0) & (n[x] <= n[y]) | (early[y] > 0) & (n[y] <= n[x]))
                x, y, total = x[fit], y[fit], total[fit]
                small = ids[x] < ids[y]
                found.append(np.stack([np.where(small, ids[x], ids[y]), np.where(small, ids[y], ids[x]), total]))
            got = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], ["a", "b", "total"])

    return near_sketches(map_arrow(groups, run, "a long, b long, total long").distinct(), held, percent)


def _with_tokens(held: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """``held``'s rows for each token (id, component, n, left, token, early) that ``tokens`` (8 MB at most) has."""
    known = np.sort(tokens.select("token").toArrow().column(0).to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(3), batch.column(2).to_numpy()
            size = lists.value_lengths().to_numpy()
            row, flat = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()
            rank = np.arange(len(flat)) - (np.cumsum(size) - size)[row]
            hit = known.take(np.searchsorted(known, flat), mode="clip") == flat if len(known) else np.zeros(len(flat), bool)
            row, rank, n = row[hit], rank[hit], n[row[hit]]
            early = rank <= n + -(n * 2 * percent) // (100 + percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(n), pa.array(n - rank), pa.array(flat[hit]), pa.array(early)], ["id", "component", "n", "left", "token", "early"])

    return map_arrow(held.select("id", "component", "n", "tokens"), run, "id long, component long, n long, left long, token long, early boolean")


def near_sketches(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, total: their sizes together) whose parity sketches are as near as a linked pair's."""
    bits = lambda x: held.select(F.col("id").alias(x), F.col("bits").alias("bits_" + x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.zeros(batch.num_rows, np.int64)
            wide = [batch.column(i).to_pylist() for i in (3, 4)]
            words = np.array([[len(b) >> 3 for b in w] for w in wide], np.int64).reshape(2, -1)
            for x, y in np.unique(words, axis=1).T.tolist():
                at = np.flatnonzero((words[0] == x) & (words[1] == y))
                a, b = (np.bitwise_xor.reduce(np.frombuffer(b"".join([w[i] for i in at]), np.uint64).reshape(len(at), -1, min(x, y)), 1) for w in wide)
                apart[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            near = pa.array(apart * (100 + percent) <= batch.column(2).to_numpy() * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    rows = pairs.join(bits("a"), "a").join(bits("b"), "b").select("a", "b", "total", "bits_a", "bits_b")
    return map_arrow(rows, run, "a long, b long")


def verify(pairs: DataFrame, hashed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` whose sets (``hashed``: id, hashes) link."""
    a = hashed.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    b = hashed.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    union = F.size("ha") + F.size("hb") - both
    return pairs.join(a, "a").join(b, "b").where(both.cast("long") * 100 >= union.cast("long") * percent).select("a", "b")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` small rows, stored in as few files as these need."""
    return store(df.coalesce(max(1, rows >> 18)))


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of the stored ``edges`` (a, b), by large and small stars; stored."""
    n = edges.count()
    now = _few(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _few(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size"), n)
        large = join_hot(both, low, ["u"], "size").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "u", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("x"), "m"), F.struct(F.col("v").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.m").alias("v"))
        before, now = now, _few(small.where(F.col("u") != F.col("v")).distinct(), n)
        discard(before)
        discard(low)
        n, s = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if (n, s) == mark:
            break
        mark = (n, s)
    own = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return _few(own.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), 2 * n)


def _texts_of(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``rows`` (doc_id, text) that may hold the sets of ``ids`` (low: a document with the set), and ``ids`` for the joins to come."""
    if ids.count() <= BROADCAST:
        ids = F.broadcast(ids)
    some = rows.join(ids.select(F.col("low").alias("doc_id")).where(F.col("doc_id").isNotNull()), "doc_id", "left_semi")
    return some.unionByName(rows.where(F.col("doc_id").isNull())), ids


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    A set: the distinct 5-word shingles of the lower-cased text (ASCII letters), words being what stands between ASCII white
    space; the whole sequence where there are fewer words; empty for null, empty and blank texts, which link with
    nothing. Two rows link when their sets' Jaccard similarity is at least ``percent`` / 100. component_id is the smallest doc_id
    that links lead to, the row's own included. Rows with one set are one node, known by the set's fingerprint: rows that repeat an id
    are rows of their own, each linked by its own text, and rows without an id take part (their component_id is null only where no row of the
    component has an id).

    Candidates from the sketches' blocks are verified on the sets. Blocks that are left out (see ``_keys``) and large
    key groups may hide links; so a second step looks for all pairs that can link across the components so far, by the rarest shingles of each set: no link is missed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = store(sketches(rows, percent))
    own = base.where("n_shingles >= 0").drop("keys", "counts")
    full = base.where("n_shingles > 0")
    reps = full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys"))
    reps = store(reps.withColumn("id", F.monotonically_increasing_id()), [base])
    repeats = not own.groupBy("doc_id").count().where("count > 1").isEmpty()
    once = lambda df: df.dropDuplicates(["id"]) if repeats else df
    names = reps.select("id", "low", "h1", "h2")

    def hashed(pairs: DataFrame) -> DataFrame:
        ids = store(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(names, "id"), [reps, pairs])
        texts, ids = _texts_of(rows, ids)
        return store(once(sets(texts).join(ids, ["h1", "h2"]).select("id", "hashes")))

    pairs = store(candidates(reps), [reps])
    held = hashed(pairs)
    # first each id with its smallest partner, then what that hasn't joined
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    edges = store(verify(first, held, percent), [pairs, held])
    joined = components(edges)
    comp = lambda x: joined.select(F.col("id").alias(x), F.col("component").alias("c" + x))
    apart = pairs.join(first, ["a", "b"], "left_anti").join(comp("a"), "a", "left").join(comp("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    edges = store(edges.unionByName(verify(apart, held, percent)), [edges, pairs, held])
    found = components(edges)
    discard(held)
    # all pairs of sets from different components that can link
    mine = store(names.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), [reps, found])
    texts, mine = _texts_of(rows, mine)
    sets_ = store(once(prefixes(texts, levels(base), percent).where("n > 0").join(mine, ["h1", "h2"]).select("id", "component", "n", "tokens", "bits")))
    more = store(cross_pairs(sets_, percent), [sets_])
    discard(sets_)
    if not more.isEmpty():
        held = hashed(more)
        last = store(verify(more, held, percent), [more, held])
        if not last.isEmpty():
            found = components(store(edges.unionByName(last), [edges, last]))
    named = names.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    out = own.join(store(named.join(lowest, "component").select("h1", "h2", "component_id"), [reps, found]), ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (read from files) but those that a row with a smaller id links to, directly or over others.

    Of each component one row stays, the one with the smallest id (of equal ids any one; rows without an id come last). Rows whose sets
    are empty all stay. Rows are told apart by their place in the files, so neither repeated nor missing ids hide anything.
    """
    placed = docs.withColumn("__row", F.monotonically_increasing_id())
    linked = link(placed, id_col="__row", text_col=text_col, percent=percent).where("n_shingles > 0").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "__row")
    groups = linked.join(linked.groupBy("component_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("component_id"), "component_id", "left_semi")
    groups = store(groups.join(placed.select("__row", id_col), "__row").withColumn("order", order))
    kept = groups.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.__row").alias("__row"))
    rest = store(groups.select("__row").join(kept, "__row", "left_anti"))
    return placed.join(rest, "__row", "left_anti").drop("__row")


def query(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
