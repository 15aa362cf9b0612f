"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow

# The patterns of the base kinds, anchored and possessive where that changes no match but spares
# rescanning of long runs.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Further kinds of this operator.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i)(?<![A-Za-z0-9_])(?:token|secret|password|passwd|api_?key)\x20?[=:]\x20?[\"']?([A-Za-z0-9_./+=-]{16,})")
_WORD = re.compile(r"[^\W_]+")
_SECRET_HINT = re.compile(r"(?i)token|secret|passw|api_?key")
# Words near a span that raise its score, and such that lower it.
NEAR = {
    "email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "address", "server", "login"), "card": ("card", "visa", "mastercard", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security"), "secret": ("key", "login", "auth"),
}
AGAINST = {
    "email": ("example", "noreply"), "ip": ("version", "release", "section", "chapter"), "card": ("order", "serial", "isbn", "tracking", "invoice"),
    "phone": ("order", "serial", "isbn", "version"), "iban": ("serial", "part", "model"), "ssn": ("order", "serial", "part", "model"), "secret": ("example", "placeholder", "dummy"),
}
#: A kind's score without context. Spans below KEEP are dropped, but for the base kinds, which are kept with what score they have.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.85, "ssn": 0.45, "secret": 0.65}
#: What near words add or take, the characters looked at on either side, and the score that keeps a span.
BONUS, MALUS, REACH, KEEP = 0.2, 0.3, 40, 0.5
BASE = ("email", "ip", "card", "phone")
ORDER = ("email", "ip", "card", "phone", "iban", "ssn", "secret")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    back = digits[::-1]
    return (sum(map(int, back[0::2])) + sum(twice[int(d)] for d in back[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _AT.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def spans(text: str | None) -> list[Span]:
    """All spans of ``text``, by kind as in ``ORDER``, then start; offsets count code points."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += (("email", a, b) for a, b in _emails(text))
    found += (("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
    found += (("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d))
    if "+" in text:
        found += (("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
    found += (("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0]))
    found += (("ssn", *m.span()) for m in _SSN.finditer(text))
    if _SECRET_HINT.search(text):
        found += (("secret", *m.span(1)) for m in _SECRET.finditer(text))
    out = []
    for kind, a, b in found:
        words = _around(text, a, b)
        score = PRIOR[kind] + BONUS * (not words.isdisjoint(NEAR[kind])) - MALUS * (not words.isdisjoint(AGAINST[kind]))
        if score >= KEEP or kind in BASE:
            out.append(Span(kind, a, b, round(min(1.0, score), 2)))
    return out


def _around(text: str, start: int, end: int) -> set[str]:
    """The whole words within ``REACH`` characters of a span, in lower case."""
    lo, hi = max(0, start - REACH), min(len(text), end + REACH)
    while 0 < lo < start and text[lo - 1].isalnum() and text[lo].isalnum():
        lo += 1  # a word that is cut
    while end < hi < len(text) and text[hi - 1].isalnum() and text[hi].isalnum():
        hi -= 1
    return set(_WORD.findall(text[lo:start].lower())) | set(_WORD.findall(text[end:hi].lower()))


_SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
_STRUCT = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, score) of every row of ``docs``.

    A span's score is its kind's, more with one of the words of ``NEAR`` in reach and less with one of ``AGAINST``. The base kinds (email, ip,
    card, phone) stay whatever their score, so that callers set the bar; the others need ``KEEP``. Null and empty texts have no spans; rows that repeat get a row each; null ids stay; other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                got = [[s._asdict() for s in spans(t.as_py())] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, _STRUCT)], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, _SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    likely = F.size(F.filter("spans", lambda s: s["score"] >= KEEP)).cast("long")
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), likely.alias("n_likely"), scores.alias("scores"))
