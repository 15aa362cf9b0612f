"""Toxicity by Levenshtein automata intersected with a lexicon trie, and scores of the context around each match."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow
from . import textvec as tv
from .langid import held_out

#: Bound of what is learned from: labelled rows (those with the smallest hashes of their ids).
ROWS = 8000
#: A term needs so many toxic documents and so large a share of its documents.
MIN_DOCS, MIN_SHARE = 6, 0.6
#: Lengths of the stems that are tried beside whole words.
STEMS = range(4, 10)
#: Whole words from this length on are also found with one edit (insertion, deletion, substitution, transposition).
FUZZY_FROM = 5
#: Pseudo-documents of a term's weight, and the share that they have for misspelled matches.
PRIOR_DOCS, PRIOR_FUZZY, OFTEN = 3.0, 0.6, 10
#: Characters of the context window, and what its signs do: a quotation scales a match down, an address scales the doubt down.
REACH, QUOTED, ADDRESSED = 40, 0.6, 0.5
PREDICT = 0.3
#: States and words that a task keeps.
STATES, WORDS = 50_000, 300_000
_WORD = re.compile(r"[^\W_]+")
# Signs of a quotation or a report, and of speaking to someone.
_REPORT = frozenset("said says quote quoted quotes called calls reported wrote word term dit citation sagte zitat dijo cita".split())
_ADDRESS = frozenset("you your youre u du dich dein tu vous toi te usted ustedes".split())
_OPEN, _CLOSE = "\"'“‘«„", "\"'”’»“"


@dataclass
class Lexicon:
    """terms: (text, is a stem) to its weights (exact, misspelled); base: the share of toxic texts without any."""

    terms: dict[tuple[str, bool], tuple[float, float]] = field(default_factory=dict)
    base: float = 0.0


class Matcher:
    """Runs words through the product of the lexicon's trie and the Levenshtein automaton of one edit.

    The product is made deterministic lazily: a state is the set of (trie node, edits, awaited character) that the
    characters so far lead to. A stem is accepted as soon as its end is reached without edits.
    """

    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[tuple[str, bool], int]]] = [[]]
        self.allow = [0]
        for term in sorted(terms):
            text, stem = term
            edits = int(not stem and len(text) >= FUZZY_FROM)
            node = 0
            self.allow[0] = max(self.allow[0], edits)
            for c in text:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append([])
                    self.allow.append(0)
                self.allow[node] = max(self.allow[node], edits)
            self.ends[node].append((term, edits))
        self._reset()
        self.words: dict[str, tuple] = {}

    def _reset(self):
        self.start = self._close({(0, 0, "")})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}

    def _close(self, states: set) -> frozenset:
        """Adds what leaving out characters of the term leads to."""
        for node, e, wait in list(states):
            if not wait and e == 0:
                states.update((k, 1, "") for k in self.children[node].values() if self.allow[k] >= 1)
        return frozenset(states)

    def _step(self, states: frozenset, c: str) -> frozenset:
        out = set()
        for node, e, wait in states:
            if wait:
                if c == wait:
                    out.add((node, e, ""))
                continue
            kids = self.children[node]
            if c in kids and self.allow[kids[c]] >= e:
                out.add((kids[c], e, ""))
            if e == 0 and self.allow[node] >= 1:
                out.add((node, 1, ""))  # an extra character
                for x, k in kids.items():
                    if self.allow[k] >= 1:
                        out.add((k, 1, ""))  # another character
                        if c != x and c in self.children[k] and self.allow[self.children[k][c]] >= 1:
                            out.add((self.children[k][c], 1, x))  # two that changed places
        return self._close(out)

    def __call__(self, word: str) -> tuple:
        """((term, misspelled), ...) of a lower-case word."""
        known = self.words.get(word)
        if known is not None:
            return known
        state, found = self.start, {}
        for c in word:
            key = (state, c)
            after = self.steps.get(key)
            if after is None:
                if len(self.steps) > STATES:
                    self._reset()
                after = self.steps[key] = self._step(state, c)
            state = after
            if not state:
                break
            for node, e, wait in state:
                if e == 0 and not wait:
                    for term, _ in self.ends[node]:
                        if term[1]:
                            found[term] = False
        else:
            for node, e, wait in state:
                if not wait:
                    for term, edits in self.ends[node]:
                        if not term[1] and e <= edits:
                            found[term] = bool(e) and found.get(term, True)
        if len(self.words) > WORDS:
            self.words.clear()
        out = self.words[word] = tuple(found.items())
        return out


def context(text: str, start: int, end: int) -> str:
    """``quoted``, ``addressed`` or ``plain``: how the words around text[start:end] stand to it."""
    if start and end < len(text) and text[start - 1] in _OPEN and text[end] in _CLOSE:
        return "quoted"
    around = set(_WORD.findall(text[max(0, start - REACH) : start])) | set(_WORD.findall(text[end : end + REACH]))
    return "quoted" if around & _REPORT else "addressed" if around & _ADDRESS else "plain"


def score(text: str | None, lexicon: Lexicon, match: Matcher) -> tuple[float, list[tuple[str, int, int, bool, str]]]:
    """The chance that at least one match is abuse, and the matches: term, start, end, misspelled, context."""
    low = (text or "").lower()
    if not any(match(w) for w in set(_WORD.findall(low))):
        return lexicon.base, []
    doubt: dict[str, float] = {}  # by word; misspelled ones share one
    found = []
    for m in _WORD.finditer(low):
        if got := match(m[0]):
            how = context(low, *m.span())
            w, term, fuzzy = max((lexicon.terms[t][f], t, f) for t, f in got)
            w = w * QUOTED if how == "quoted" else 1 - (1 - w) * ADDRESSED if how == "addressed" else w
            key = "" if fuzzy else m[0]
            doubt[key] = min(doubt.get(key, 1.0), 1 - w)
            found.append((term[0], *m.span(), fuzzy, how))
    return 1 - (1 - lexicon.base) * float(np.prod(list(doubt.values()))), found


def _gist(text: str) -> tuple[list[str], list[int]]:
    """The different words of a text, in order, and marks that near copies share: four minima of hashed word triples."""
    words = _WORD.findall(text.lower())
    if not words:
        return [], []
    h = tv.string_hashes([w.encode("utf-8", "replace") for w in words])
    g = h[:-2] ^ (h[1:-1] << np.uint64(1)) ^ (h[2:] << np.uint64(2)) if len(h) > 2 else h
    return sorted(set(words)), [int(tv.mix(g + np.uint64(7919 * i)).min().view(np.int64)) for i in range(1, 5)]


def _distinct(gists: list[tuple[list[str], list[int], int]]) -> list[tuple[set[str], int]]:
    """Word sets without near copies (texts that share one of their marks); of copies with both labels the clean one counts."""
    seen: set[tuple[int, int]] = set()
    out = []
    for words, minima, toxic in sorted(gists, key=lambda g: (g[2], g[1], g[0])):
        marks = set(enumerate(minima))
        if words and not marks & seen:
            out.append((set(words), toxic))
        seen |= marks
    return out


def learn(texts: list[tuple[str, int]]) -> Lexicon:
    """A lexicon from (text, toxic 0/1): words and stems that mark toxic texts, with weights by how well they do."""
    return learn_gists([(*_gist(text), toxic) for text, toxic in texts])


def learn_gists(gists: list[tuple[list[str], list[int], int]]) -> Lexicon:
    """``learn`` from the texts' words and marks."""
    rows = _distinct(gists)
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for words, toxic in rows:
        features = {(w, False) for w in words}
        for k in STEMS:
            features.update((w[:k], True) for w in words if len(w) >= k)
        counts[toxic].update(features)
    good = {f: n for f, n in counts[1].items() if n >= MIN_DOCS and n >= MIN_SHARE * (n + counts[0][f])}
    word: dict[str, int] = {}  # by stem, the toxic texts of its commonest word
    for (text, stem), n in good.items():
        if not stem:
            for k in STEMS:
                word[text[:k]] = max(word.get(text[:k], 0), n)
    chosen: dict[tuple[str, bool], int] = {}
    under: dict[tuple[str, bool], tuple[str, bool]] = {}  # words beside the stem that they begin with, for their misspelled forms
    for f in sorted(good, key=lambda f: (not f[1], len(f[0]), f[0])):  # stems first, the shortest first
        text, stem = f
        if over := next(((text[:k], True) for k in STEMS if k <= len(text) and (text[:k], True) in chosen), None):
            if not stem and len(text) >= FUZZY_FROM:
                under[f] = over
            continue
        if stem and word.get(text, 0) >= 0.8 * good[f]:
            continue  # one word makes it
        chosen[f] = good[f]
    # a term's weight is its share of toxic texts where it is the only evidence; where that is scarce, its share of all that have it
    # stands in, with clean ones counted OFTEN times since toxic texts have several terms
    match = Matcher({**chosen, **under})
    alone: dict[tuple, list[int]] = {}
    bare = [0, 0]
    for words, toxic in rows:
        exact: dict[str, tuple] = {}
        fuzzy: dict[str, tuple] = {}
        for w in words:
            for term, wrong in match(w):
                if wrong or term not in under:  # exact forms are the stem's
                    (fuzzy if wrong else exact)[w] = term
        if not exact and not fuzzy:
            bare[toxic] += 1
        for term in set((exact if len(exact) == 1 else {} if exact else fuzzy).values()):
            alone.setdefault((term, not exact), [0, 0])[toxic] += 1

    def weight(term, wrong):
        clean, toxic = alone.get((term, wrong), (0, 0))
        share = good[term] / (good[term] + OFTEN * counts[0][term] + MIN_DOCS)
        return (toxic + PRIOR_DOCS * (PRIOR_FUZZY if wrong else share)) / (toxic + clean + PRIOR_DOCS)

    return Lexicon({t: (weight(under.get(t, t), False), weight(t, True)) for t in (*chosen, *under)}, bare[1] / max(1, sum(bare)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS) -> Lexicon:
    """A lexicon from at most ``rows`` labelled rows, those with the smallest hashes of their ids.

    Only the texts' different words and marks come to the driver. Of rows that repeat an id the least text counts, of labels the largest.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = {r[0]: r[1] for r in marks.orderBy(F.xxhash64(id_col), id_col).limit(rows).collect()}
    if not chosen:
        return Lexicon()
    some = docs.where(F.col(id_col).isin(list(chosen)) & F.col(text_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                got = [_gist(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["id", "words", "marks"])

    got = map_arrow(some.select("id", "text"), run, "id long, words array<string>, marks array<long>").toLocalIterator()
    return learn_gists([(r["words"], r["marks"], int(chosen[r["id"]] == 1)) for r in got])


def rate(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and matches of every row of ``docs``.

    Null and empty texts, and texts without a match, have the lexicon's base score. Rows that repeat get a row each, null
    ids stay, other columns aren't looked at, whole texts are read.
    """
    kind = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("misspelled", pa.bool_()), ("context", pa.string())]))
    names = ("term", "start", "end", "misspelled", "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(lexicon.terms)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                got = [score(t.as_py(), lexicon, match) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([[dict(zip(names, x, strict=True)) for x in g[1]] for g in got], kind)], ["doc_id", "score", "matches"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double, matches array<struct<term:string,start:long,end:long,misspelled:boolean,context:string>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = rate(docs, train(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), F.size("matches").cast("long").alias("n_matches"))
