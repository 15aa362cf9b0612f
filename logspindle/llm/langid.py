"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import map_arrow

#: Bound of what is learned: bytes of text of each language's dictionary, and the labelled rows that may give them.
DICT_BYTES = 110 << 10
ROWS = 120
#: Bytes of all dictionaries: many languages get smaller ones.
ALL_BYTES = 64 << 20
LEVEL = 6
#: The second smallest size must be so much (relative) and so many bytes above the smallest, or the margin is narrow. Held
#: out, learned languages have 10 % and more as a rule; unlearned ones and random letters reach 2 % only in short texts.
MARGIN = 0.02
GAP = 12
#: Bytes of text that are compressed at a time: in a longer piece the text's own words outweigh the dictionary's.
PIECE = 8 << 10
#: Texts of at most so many compressed bytes are compressed again after samples of each language: alone, so little text shows
#: no difference. What a text adds to a sample, on the average, is its size then, with margins of its own.
SHORT = 100
SAMPLES, SAMPLE = 8, 400
SHORT_MARGIN, SHORT_GAP = 0.1, 2.0
_NOT_LETTERS = re.compile(r"[^\w]+|[\d_]+")
_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character is a letter; signs like ½ or Ⅷ, which patterns take for word characters, are none."""
    return any(c.isalpha() for m in _WORD.finditer(text) for c in m[0])


def normal(text: str) -> str:
    """Lower case, everything but letters as single spaces."""
    return " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language of ``docs`` (rows with null text or language are left out).

    Learned from at most ``rows`` whole texts of each language, those with the smallest hashes of their ids, of which the
    shortest that have at least 200 bytes are taken until ``dict_bytes`` are full; only these come to the driver. Of rows that repeat an id and
    language the least text counts. With many languages the dictionaries share ``ALL_BYTES``.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    some = known.select("id", "lang", F.octet_length("text").alias("size")).withColumn("place", place).where(F.col("place") <= rows)
    some = some.groupBy("id", "lang").agg(F.min("size").alias("size")).collect()  # at most ``rows`` short rows a language
    by: dict[str, list] = {}
    for r in some:
        by.setdefault(r["lang"], []).append((r["size"] < 200, r["size"], r["id"]))
    dict_bytes = min(dict_bytes, ALL_BYTES // max(1, len(by)))
    chosen = set()
    for lang, sizes in by.items():
        n = 0
        for _, size, i in sorted(sizes):
            if n and n + size > dict_bytes:
                break
            chosen.add((i, lang))
            n += size
    if not chosen:
        return {}
    texts = known.where(F.col("id").isin([i for i, _ in chosen])).groupBy("id", "lang").agg(F.min("text").alias("text")).collect()
    got: dict[str, list[str]] = {lang: [] for lang in by}
    for r in texts:
        if (r["id"], r["lang"]) in chosen:
            got[r["lang"]].append(normal(r["text"]))
    # the shortest first, so that what is near the end, and so cheapest to refer to, is long
    return {lang: "".join(dict.fromkeys(sorted(own, key=lambda t: (len(t) < 200, len(t), t)))).encode("utf-8", "replace")[-dict_bytes:] for lang, own in got.items()}


class Classifier:
    """Sizes of a text under each language's dictionary. The last part of a dictionary serves as the samples for short texts."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.coders, self.samples = [], []
        for lang in self.langs:
            raw = dictionaries[lang]
            size = min(SAMPLE, len(raw) // (2 * SAMPLES))
            held = raw[len(raw) - SAMPLES * size :]
            d = zstandard.ZstdCompressionDict(raw[: len(raw) - len(held)] or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coder = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            parts = [held[i * size : (i + 1) * size] for i in range(SAMPLES)]
            self.coders.append(coder)
            self.samples.append([(p, len(coder.compress(p))) for p in parts])

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        raw = normal(text).encode("utf-8", "replace")
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        least, second = sorted(sizes)[:2]
        wide = max(MARGIN * second, GAP)
        if least <= SHORT:
            sizes = [sum(len(c.compress(p + raw)) - n for p, n in own) / SAMPLES for c, own in zip(self.coders, self.samples, strict=True)]
            least, second = sorted(sizes)[:2]
            wide = max(SHORT_MARGIN * second, SHORT_GAP)
        margin = (second - least) / max(second, 1.0)
        return self.langs[sizes.index(least)], min(1.0, 0.5 + 2.5 * margin), second - least < wide


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of ``docs``.

    ``und`` (score 0, rejected) if the text is null, has no letter or nothing was learned. A score is 0.5 at no margin.
    Each text gets the language of the smallest size, the first by name of several. ``rejected`` marks texts with a margin under ``MARGIN``
    or ``GAP``, and of at most ``SHORT`` compressed bytes those under ``SHORT_MARGIN`` or ``SHORT_GAP``. Rows that repeat get a row each; null ids stay; other columns
    aren't looked at. Whole texts are compressed, of any length, in pieces of ``PIECE`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                got = [judge(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, but those that ``identify`` rejects."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(dictionaries)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                yield part.filter(pa.array([not judge(t.as_py())[2] for t in part.column(at)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
