"""The corpus operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspindle.llm import decontaminate, hostrep, jaccard, langid, lines, media, packing, pii, shards, shared, toxicity, webp
from logspindle.llm import textvec as tv

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha string, spans string"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, texts, sources=None, langs=None):
    """With extra columns and a clash of names."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- words


@given(st.lists(st.text(alphabet="aB9é \n.x", max_size=20), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_match_the_pattern(texts):
    raws = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    buf = tv.LOWER[np.frombuffer(b"".join(raws), np.uint8)]
    starts, ends, row = tv.words(buf, off, tv.ALNUM)
    got = [(int(r), bytes(buf[a:b])) for a, b, r in zip(starts, ends, row, strict=True)]
    assert got == [(i, w) for i, r in enumerate(raws) for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.lower())]
    if got:
        assert list(tv.word_hashes(buf, starts, ends)) == list(tv.string_hashes([w for _, w in got]))


# --- 1: lines


def test_lines(spark):
    texts = [f"head\nown {i}\n\nown {i}" for i in range(10)] + [None, "", "head", "head "]
    sources = ["a"] * 10 + ["a", None, "b", "b"]
    rows = {r.doc_id: r for r in lines.dedup_lines(frame(spark, texts, sources), ratio=0.5, min_pages=2).collect()}
    assert rows[0].text == texts[0] and rows[0].n_dropped == 0  # the first page keeps it
    assert all(rows[i].text == f"own {i}\n\nown {i}" and rows[i].n_dropped == 1 for i in range(1, 10))
    assert rows[10].text is None and rows[10].n_lines == 0 and rows[11].text == ""
    assert rows[12].text == "head" and rows[13].text == "" and rows[13].text_sha == "x"
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_lines_of_small_sites(spark):
    texts = ["foot\na", "foot\nb", "foot\nc", "one\nx", "one\ny", "z"]
    rows = {r.doc_id: r for r in lines.dedup_lines(frame(spark, texts, ["s"] * 3 + ["t"] * 3)).collect()}
    assert [rows[i].text for i in range(6)] == ["foot\na", "b", "c", "one\nx", "y", "z"]


# --- 2: decontamination


def brute_hits(texts, items, window=10):
    out = []
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for t in texts:
        w, hit, found = words(t), set(), set()
        for name, item in items:
            iw = words(item)
            for s in {tuple(iw[i : i + window]) for i in range(max(1, len(iw) - window + 1))} if iw else ():
                for p in range(len(w) - len(s) + 1):
                    if tuple(w[p : p + len(s)]) == s:
                        hit.update(range(p, p + len(s)))
                        found.add(name)
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination_is_exact(spark, block):
    rng = random.Random(1)
    items = [(str(i), prose(rng, n)) for i, n in enumerate([30, 12, 10, 4, 1, 25])] + [("e", ""), ("n", None)]
    texts = [prose(rng, 60) for _ in range(20)]
    texts += [f"{prose(rng, 9)}, {items[0][1].upper()}! {prose(rng, 5)}", f"{items[1][1]} {items[1][1]}", items[3][1], None, "", "É w1 É", items[5][1][:80], texts[0]]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = decontaminate.decontaminate(frame(spark, texts), bench, block=block, slop=None).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in rows} == dict(enumerate(brute_hits(texts, items)))
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(frame(spark, ["a b"]), bench.limit(0)).first().contaminated is False


def test_proximity(spark):
    item = " ".join(WORDS[:10])
    loose = " ".join([*WORDS[:4], "new", *WORDS[4:10]])
    far = " ".join([*WORDS[:4], "a", "b", "c", "d", "e", *WORDS[4:10]])
    rows = decontaminate.decontaminate(frame(spark, [item, loose, far]), spark.createDataFrame([("i", item)], "item_id string, text string"), slop=3).orderBy("doc_id").collect()
    assert [(r.contaminated, list(r.near_items)) for r in rows] == [(True, []), (False, ["i"]), (False, [])]


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_items_without_an_id_are_searched(spark, block):
    items = [(None, " ".join(WORDS[:12])), (None, None), ("i", " ".join(WORDS[20:32]))]
    texts = [" ".join(WORDS[:12]), " ".join(WORDS[:32]), " ".join(WORDS[40:60])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = decontaminate.decontaminate(frame(spark, texts), bench, block=block).orderBy("doc_id").collect()
    assert [(r.n_hit, list(r["items"]), list(r.near_items), r.contaminated) for r in rows] == [(12, [], [], True), (24, ["i"], [], True), (0, [], [], False)]


def test_one_word_repeated_costs_little(spark):
    """Windows that are equal count once, and their hits are spans, not words."""
    items = [("a", " ".join(["la"] * 600)), ("b", " ".join(["la"] * 12))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    (r,) = decontaminate.decontaminate(frame(spark, [" ".join(["la"] * 3000)]), bench).collect()
    assert (r.n_hit, list(r["items"]), len([m for m in r.matches if m.kind == "phrase"])) == (3000, ["a", "b"], 2)
    assert len(decontaminate.windows_of(items).cuts) == 2


def test_stored_index_serves_many_benchmarks(spark):
    rng = random.Random(21)
    texts = [prose(rng, 50) for _ in range(30)] + ["x" * 300_000 + " " + " ".join(WORDS[:12]), None]
    index = decontaminate.build_index(frame(spark, texts), segment=2000)
    assert index.count() > 3
    for n in (3, 5):
        items = [(str(i), " ".join(texts[i].split()[5 : 5 + 4 * n])) for i in range(n)] + [("far", " ".join(WORDS[:12]))]
        found = {r.doc_id: r for r in decontaminate.search(index, spark.createDataFrame(items, "item_id string, text string"), slop=None).collect()}
        assert {i: (r.n_words, r.n_hit, sorted({m.item_id for m in r.matches})) for i, r in found.items()} == dict(enumerate(brute_hits(texts, items)))
        assert all(" ".join(texts[i].split()[m.start : m.start + m.length]) == dict(items)[m.item_id] for i, r in found.items() for m in r.matches)
    with pytest.raises(ValueError):
        decontaminate.search(index, spark.createDataFrame(items, "item_id string, text string"), window=70)


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    item = " ".join(WORDS[:12])
    docs = spark.createDataFrame([(1, item), (2, "clean words"), (3, None)], "doc_id long, text string").withColumn("__key", F.lit("k"))
    monkeypatch.setattr(decontaminate.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([("i", item)], "item_id string, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == docs.columns


# --- 3: toxicity


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["moronic", "blockhead"]
    rows = [(prose(rng, 30) + (" " + rng.choice(bad) if t else ""), t) for t in [0, 0, 1] * 60]
    lexicon = toxicity.learn(rows)
    match = toxicity.Matcher(lexicon.terms)
    assert {t[0] for t in lexicon.terms} & {"moronic", "moro"} and match("blockhead")
    assert match("blokhead") and match("blockkhead") and match("blockhaed") and match("b1ockhead") and not match("bl0ckhaed") and not match("w12")
    plain, quoted = toxicity.score("you are a blockhead", lexicon, match)[0], toxicity.score('he said "blockhead"', lexicon, match)[0]
    assert plain > quoted > lexicon.base and toxicity.score(None, lexicon, match) == (lexicon.base, [])
    out = toxicity.rate(frame(spark, ["Blockhead!", None, "", "w1"]), lexicon).orderBy("doc_id").collect()
    assert [r.score >= 0.3 for r in out] == [True, False, False, False] and out[0].matches[0].start == 0
    assert toxicity.rate(empty(spark), lexicon).count() == 0 and toxicity.learn([]).terms == {}
    docs = frame(spark, [t for t, _ in rows] + [None, "", "long " * 100_000])
    again = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    marks = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] + [(0, None), (None, 1), (len(rows), 1)], "doc_id long, toxic int")
    assert toxicity.train(again, marks) == lexicon
    assert toxicity.rate(again, lexicon).count() == len(rows) + 11


def test_words_under_a_stem_keep_their_edit():
    rng = random.Random(5)
    rows = [(prose(rng, 30) + " " + rng.choice(["moronic", "moronism", "moronity"]) * t, t) for t in [0, 0, 1] * 60]
    lexicon = toxicity.learn(rows)
    match = toxicity.Matcher(lexicon.terms)
    stems = [t for t, stem in lexicon.terms if stem]
    assert stems and all(any(w.startswith(t) for t in stems) for w in ("moronic", "moronism", "moronity"))
    for word in ("mronic", "mxronism", "omronity"):
        assert any(wrong for _, wrong in match(word)) and toxicity.score(word, lexicon, match)[0] > lexicon.base
    exact = {lexicon.terms[t][0] for t, wrong in match("moronic") if not wrong}
    assert len(exact) == 1 and not match("w12")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(st.text(alphabet="abc", min_size=3, max_size=8))
@settings(max_examples=200, deadline=None)
def test_automaton_finds_one_edit(word):
    term = "abcabc"
    swaps = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)}
    found = dict(toxicity.Matcher({(term, False): (1, 1)})(word))
    assert bool(found) == (levenshtein(word, term) <= 1 or word in swaps)
    assert found.get((term, False), True) is (word != term)


# --- 4: language


def test_language(spark):
    rng = random.Random(3)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    kinds = {"xx": ["tho", "ing", "er", "wha", "ly"], "yy": ["schu", "keit", "ein", "ver", "ung"]}
    texts, langs = zip(*[(make(p, 80), k) for _ in range(40) for k, p in kinds.items()], strict=True)
    docs = frame(spark, list(texts), langs=list(langs))
    judge = langid.train(docs.where(~langid.held_out()))
    assert sorted(judge) == ["xx", "yy"] and all(len(d) <= langid.DICT_BYTES for d in judge.values())
    rows = langid.identify(docs, judge).collect()
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    odd = langid.identify(frame(spark, [None, "", "12 !!", "x"]), judge).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd][:3] == ["und"] * 3 and odd[3].lang_pred in kinds
    assert langid.keep_identified(frame(spark, [None, texts[0]]), judge).collect()[0].doc_id == 1
    assert langid.train(empty(spark)) == {} and langid.identify(empty(spark), judge).count() == 0
    signs = langid.identify(frame(spark, ["½ ² ① Ⅷ _ 7", "½ " * 50_000]), judge).collect()
    assert [(r.lang_pred, r.rejected) for r in signs] == [("und", True)] * 2
    (long,) = langid.identify(frame(spark, [texts[0] * 400]), judge).collect()
    assert (long.lang_pred, long.rejected) == (langs[0], False)


def test_many_languages_and_repeated_ids(spark):
    rng = random.Random(17)
    rows = [(i % 40, f"l{i % 300}", prose(rng, 30)) for i in range(600)] + [(None, "l0", "x"), (1, None, "x"), (1, "l0", None)]
    judge = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), rows=1)
    assert len(judge) == 300 and all(judge.values())


def test_language_rejects_what_it_has_not_learned():
    rng = random.Random(4)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    kinds = {"xx": ["tho", "ing", "er", "wha", "ly"], "yy": ["schu", "keit", "ein", "ver", "ung"], "zz": ["cion", "que", "mos", "ado", "lla"]}
    judge = langid.Classifier({k: langid.normal(make(p, 4000)).encode() for k, p in kinds.items()})
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (20, 60, 200, 1000) for _ in range(40)]
    assert sum(not judge(t)[2] for t in junk) <= 2
    # Another language, spelled with other syllables.
    other = ["cki", "owa", "prz", "nie", "sta", "zyk"]
    assert all(judge(make(other, n))[2] for n in (200, 1000, 5000))
    # Learned languages stay, of a few words and of many pieces.
    for k, p in kinds.items():
        assert [judge(make(p, n))[::2] for n in (5, 30, 300, 60000)] == [(k, False)] * 4


# --- 5: hosts


def test_hosts(spark):
    urls = ["https://A.Example.net/en/x?q", "http://x.net", "http://z.net/", "http://example.com/de/1#f", "http://notexample.com/de/1", "http://k.org/fr/", "nothing", None, "ftp://h?x"]
    urls += ["http://bad.com/p"] * 30 + ["http://good.com/p"] * 30 + ["http://new.com/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 if i < 39 else 0) for i in range(9, 69)] + [(9, None), (None, 1)], "id long, bad int")
    rows = {r.page_id: r for r in hostrep.judge(pages, labels).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(9)] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("x.net", "", None, "allow"), ("z.net", "/", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"),
        ("notexample.com", "/de/1", None, "allow"), ("k.org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h", "", None, "allow"),
    ]
    assert rows[9].verdict == "block" and rows[40].verdict == "allow" and rows[69].verdict == "allow" and len(rows) == len(urls)
    assert hostrep.judge(pages.limit(0), labels).count() == 0 and hostrep.judge(pages, labels.limit(0)).where("verdict = 'block'").count() == 2


# --- 6: Jaccard join


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_jaccard_join_is_whole(spark):
    rng = random.Random(4)
    texts = [None, "", "  \t", "one", "ONE", "one two", "one two three four five six", "one two three four five six seven"]
    for n in (6, 9, 14, 23, 24, 28, 32, 60, 150, 900):
        base = prose(rng, n).split()
        for k in range(8):
            copy = list(base)
            for _ in range(k * n // 160 + (k > 0)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
            texts.append(" ".join(copy[: len(copy) - k // 2]))
    shared = prose(rng, 60)
    texts += [f"{prose(rng, 80)} {shared} {prose(rng, 80)}" for _ in range(40)]  # one passage is no link
    big = prose(rng, 200).split()
    texts += [" ".join(w if rng.random() > 0.004 else "q" for w in big) for _ in range(60)]  # more near copies than a group
    rows = jaccard.link(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)
    assert jaccard.link(empty(spark)).count() == 0


def test_jaccard_join_beyond_leaders(spark, monkeypatch):
    """Chains of which few texts link with a group's leaders, and one passage in texts that don't link."""
    rng = random.Random(11)
    texts = []
    for n in (60, 120, 120):
        now = prose(rng, n).split()
        for _ in range(45):
            now = list(now)
            for _ in range(n // 60):
                now[rng.randrange(n)] = rng.choice(WORDS)
            texts.append(" ".join(now))
    shared = prose(rng, 90)
    texts += [f"{prose(rng, 30)} {shared} {prose(rng, 30)}" for _ in range(60)]
    rng.shuffle(texts)
    monkeypatch.setattr(jaccard, "GROUP", 2)  # so that leaders are all that larger groups meet at first
    monkeypatch.setattr(jaccard, "PART", 5)
    rows = jaccard.link(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_jaccard_join_with_repeated_and_missing_ids(spark):
    rng = random.Random(14)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (7, a + " x"), (9, b + " y"), (None, c), (12, c + " z"), (13, c), (None, prose(rng, 30)), (5, a), (20, None), (20, "")]
    want = sorted([(5, 5), (5, 5), (7, 5), (9, 5), (None, 12), (12, 12), (13, 12), (None, None), (5, 5), (20, 20), (20, 20)], key=str)
    for order in (rows, rows[::-1], sorted(rows, key=str)):
        for parts in (1, 4):
            docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
            assert sorted([(r.doc_id, r.component_id) for r in jaccard.link(docs).collect()], key=str) == want


def test_jaccard_join_needs_no_blocks(spark, monkeypatch):
    """What the sketches miss, here everything, the second step finds."""
    rng = random.Random(15)
    texts = []
    for n in (3, 12, 40, 200):
        base = prose(rng, n).split()
        for k in range(6):
            texts.append(" ".join(w if rng.random() > 0.02 * k else rng.choice(WORDS) for w in base))
    monkeypatch.setattr(jaccard, "candidates", lambda reps: reps.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    monkeypatch.setattr(shared, "HOT", 2)
    rows = jaccard.link(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_one_row_of_each_group_stays(spark, tmp_path):
    rng = random.Random(16)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, b), (5, a), (7, a + " x"), (None, b + " y"), (None, None), (None, "lone words"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__extra", F.lit(1))
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    kept = jaccard.keep_one(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=str) == sorted([(5, a), (5, b), (None, None), (None, "lone words"), (3, None), (3, "")], key=str)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_cross_pairs_miss_no_link(spark, monkeypatch, broadcast):
    monkeypatch.setattr(jaccard, "PART", 7)
    monkeypatch.setattr(shared, "HOT", 5)
    monkeypatch.setattr(jaccard, "BROADCAST", broadcast)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets_ = []
    for size in (1, 2, 4, 30, 30, 55):
        for _ in range(25):
            sets_.append(set(rng.choice(pool[: size + 4], size, replace=False).tolist()))
    comp = rng.integers(0, 20, len(sets_)).tolist()
    g = np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in sets_])
    n = np.array([len(s) for s in sets_])
    level = np.bincount(g & np.uint64(jaccard.PLACES - 1), minlength=jaccard.PLACES).astype(np.uint8)
    columns = [c.to_pylist() for c in jaccard.prefix_columns(np.repeat(np.arange(len(n)), n), g, n, level, 75)]
    held = spark.createDataFrame(list(zip(range(len(n)), comp, *columns, strict=True)), "id long, component long, n long, tokens array<long>, bits binary").repartition(5)
    got = {(r.a, r.b) for r in jaccard.cross_pairs(held).collect()}
    for i, a in enumerate(sets_):
        for j in range(i + 1, len(sets_)):
            b = sets_[j]
            if comp[i] == comp[j]:
                assert (i, j) not in got
            elif 100 * len(a & b) >= 75 * len(a | b):
                assert (i, j) in got


def test_intermediate_tables_start_few_processes(spark, monkeypatch):
    """Hadoop starts one for each file and folder on a local disk, and more for checksum files."""
    of = lambda df: Path(df._settled_at.removeprefix("file:"))
    values = spark.range(3000, numPartitions=3).select("id", F.xxhash64("id").alias("h"))
    stored = shared.settle(values)
    assert sorted(f.suffix for f in of(stored).iterdir()) == [".parquet"] * 3
    assert sorted(stored.collect()) == sorted(values.collect())
    many = spark.range(1000, numPartitions=300)
    few = shared.settle(many, [stored])
    assert len(list(of(few).iterdir())) == shared.WAVES * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in few.collect()) == list(range(1000))
    monkeypatch.setattr(shared, "FILE_BITS", 4)  # more bytes, more files
    assert len(list(of(shared.settle(many, [stored])).iterdir())) == 300
    file = max(of(stored).iterdir())
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        stored.collect()


def test_tables_stored_by_workers_are_whole(spark):
    """What a task that doesn't count has written isn't read; types, nulls and empty tables stay."""
    rows = [(1, "a", b"\x00", [1, None], [], True, 0.5), (None, None, None, None, None, None, None), (3, "", b"", [], ["é"], False, None)]
    given = spark.createDataFrame(rows, "a long, b string, c binary, d array<long>, e array<string>, f boolean, g double")
    stored = shared.store(given)
    path = Path(stored._settled_at.removeprefix("file://"))
    files = list(path.iterdir())
    assert files and {f.suffix for f in files} == {".parquet"}
    (path / ".again.parquet").write_bytes(files[0].read_bytes())
    assert stored.schema == given.schema and sorted(stored.collect(), key=str) == sorted(given.collect(), key=str)
    assert shared.store(given.limit(0)).collect() == []
    shared.discard(stored)
    assert not path.exists()


def test_jaccard_join_keeps_few_files(spark, monkeypatch):
    """However many partitions the session's shuffles have."""
    rng = random.Random(17)
    texts = [prose(rng, 60) for _ in range(12)]
    texts = [f"{t} {k}" for t in texts for k in range(3)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    stored, store = [], shared.store
    monkeypatch.setattr(jaccard, "store", lambda *a: stored.append(store(*a)) or stored[-1])
    monkeypatch.setattr(jaccard, "discard", lambda df: None)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = jaccard.link(frame(spark, texts)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)
    assert max(len(list(Path(x._settled_at.removeprefix("file:")).glob("*.parquet"))) for x in stored) <= 2 * spark.sparkContext.defaultParallelism


def test_sketch_blocks_are_a_pigeonhole():
    """At least one block of the sketch of linked sets is equal, for all sizes."""
    rng = np.random.default_rng(5)
    for n in (24, 31, 60, 200, 1500):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.sort(np.append(a[: n - n // 9], rng.integers(0, 1 << 63, n // 9 - 1, dtype=np.uint64)))
        row = np.repeat([0, 1], [n, len(b)])
        own, keys = jaccard._keys(row, np.concatenate([np.sort(a), b]), np.array([n, len(b)]), 75)
        assert set(keys[own == 0]) & set(keys[own == 1])


# --- 7: WebP


def test_media_uses_what_makes_a_file_smaller():
    """References in texts, the palette where there are few values, the predictors in pictures; all forms come back."""
    rng = random.Random(18)
    text = " ".join(rng.choice(["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "every", "single", "day"]) for _ in range(600)).encode()
    noise = bytes(rng.randrange(256) for _ in range(6400))
    slope = ((np.arange(100)[:, None] * 3 + np.arange(64) * 2 + np.array([rng.randrange(3) for _ in range(6400)]).reshape(100, 64)) & 255).astype(np.uint8).tobytes()
    few = bytes(rng.choice(b"0123456789") for _ in range(6400))
    kinds = {}
    for name, data in {"text": text, "noise": noise, "slope": slope, "few": few, "two": bytes(rng.choice(b"ab") for _ in range(6400)), "run": b"a" * 70_000 + b"b"}.items():
        stored = media.store(media.payload(data))
        assert media.samples_of(media.load(stored)) == media.payload(data)
        kinds[name] = (len(stored) / len(data),)
    bits = lambda data: sum(-n / len(data) * np.log2(n / len(data)) for n in np.bincount(np.frombuffer(data, np.uint8)) if n)
    assert kinds["text"][0] < 0.7 * bits(text) / 8 and kinds["noise"][0] < 1.03 and kinds["slope"][0] < 0.5 and kinds["few"][0] < 0.46 and kinds["two"][0] < 0.15 and kinds["run"][0] < 0.01


@given(st.binary(max_size=700), st.integers(0, 300), st.integers(1, 300))
@settings(max_examples=150, deadline=None)
def test_references_round_trip(data, back, size):
    data = data + data[max(0, len(data) - back) :] * 2 + data[:size] + bytes([7]) * size
    body = media.payload(data)
    assert media.samples_of(media.load(media.store(body))) == body


@given(st.binary(max_size=700))
@settings(max_examples=80, deadline=None)
def test_media_round_trip(data):
    body = media.payload(data)
    assert len(body) % 64 == 0 and len(body) and media.samples_of(media.load(media.store(body))) == body


def test_media_query_columns(spark):
    texts = ["hello", None, "", "é" * 1000, "hello"]
    rows = media.to_media(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        body = media.payload(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(body), hashlib.sha256(body).hexdigest())
        assert r.tail_crc32 == zlib.crc32(body[-64:]) and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert rows[0].feature == rows[4].feature and rows[1].media == rows[2].media
    back = media.from_media(spark.createDataFrame([(1, rows[0].media), (2, None), (3, bytearray(b"no"))], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert (back[0].width, back[0].height, len(back[0].pixels)) == (64, 1, 256) and back[1].width is None and back[2].pixels is None


class Stream(webp.Writer):
    """Writes streams with the format's other parts."""

    def header(self, width, height):
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(0, 4)

    def flat(self, size):
        """A code of 256 symbols of eight bits; symbols are then written by ``byte``."""
        lengths = np.zeros(size, np.int64)
        lengths[:256] = 8
        self.put_code(lengths)

    def byte(self, v):
        self.put(int(f"{v:08b}"[::-1], 2), 8)

    def image(self, pixels, main=False):
        """Literal pixels (a, r, g, b)."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        for size in (280, 256, 256, 256):
            self.flat(size)
        self.put(0b101, 3)
        self.put(0, 8)
        for a, r, g, b in pixels:
            for v in (g, r, b, a):
                self.byte(v)


def pixels_of(image):
    return [tuple(int(v) for v in (p[3], p[0], p[1], p[2])) for p in image.reshape(-1, 4)]


def test_webp_transforms():
    rng = random.Random(6)
    w, h = 7, 5
    raw = [tuple(rng.randrange(256) for _ in range(4)) for _ in range(w * h)]
    for mode in range(14):  # predictor: what the inverse gives is predicted and restored
        s = Stream()
        s.header(w, h)
        s.put(1, 1)
        s.put(0, 2)
        s.put(1, 3)
        s.image([(255, 0, mode, 0)])
        s.put(0, 1)
        want = [a << 24 | r << 16 | g << 8 | b for a, r, g, b in raw]
        left = []
        for at, p in enumerate(want):
            q = webp.predict(want, at, w, [mode], 3)
            left.append(tuple((p >> k) - (q >> k) & 255 for k in (24, 16, 8, 0)))
        s.image(left, main=True)
        assert pixels_of(webp.decode(webp.riff(s.bytes()))) == raw, mode
    s = Stream()  # cross colour, then subtract green
    s.header(w, h)
    s.put(1, 1)
    s.put(1, 2)
    s.put(1, 3)
    s.image([(255, 250, 3, 200)])
    s.put(1, 1)
    s.put(2, 2)
    s.put(0, 1)
    s.image(raw, main=True)
    sign = lambda v: v - 256 if v > 127 else v
    want = []
    for a, r, g, b in raw:
        r, b = r + g & 255, b + g & 255
        r = r + (sign(200) * sign(g) >> 5) & 255
        b = b + (sign(3) * sign(g) >> 5) + (sign(250) * sign(r) >> 5) & 255
        want.append((a, r, g, b))
    assert pixels_of(webp.decode(webp.riff(s.bytes()))) == want
    palette = [(255, 10, 20, 30), (255, 40, 50, 60), (128, 1, 2, 3)]
    s = Stream()  # three colours: four pixels in a byte
    s.header(5, 2)
    s.put(1, 1)
    s.put(3, 2)
    s.put(2, 8)
    s.image([palette[0], *[tuple((y - x) & 255 for x, y in zip(p, q, strict=True)) for p, q in zip(palette, palette[1:], strict=False)]])
    s.put(0, 1)
    index = [[0, 1, 2, 1, 0], [2, 2, 1, 3, 0]]
    packed = [v for row in index for v in (row[0] | row[1] << 2 | row[2] << 4 | row[3] << 6, row[4])]
    s.image([(255, 0, v, 0) for v in packed], main=True)
    assert pixels_of(webp.decode(webp.riff(s.bytes()))) == [([*palette, (0, 0, 0, 0)])[i] for row in index for i in row]


def test_webp_references_cache_and_groups():
    colours = [(255, 9, 8, 7), (255, 1, 2, 3)]
    s = Stream()
    s.header(16, 1)
    s.put(0, 1)
    s.put(1, 1)
    s.put(4, 4)  # a cache of 16 colours
    s.put(0, 1)
    green = np.zeros(280 + 16, np.int64)
    slot = (webp._CACHE_MULT * 0xFF090807 & 0xFFFFFFFF) >> 28
    symbols = {8: None, 2: None, 256 + 4: None, 280 + slot: None}
    green[list(symbols)] = 2
    s.put_code(green)
    codes = webp.canonical(green)
    for _ in range(2):  # red and blue
        s.flat(256)
    one = np.zeros(256, np.int64)
    one[255] = 1
    s.put_code(one)
    dist = np.zeros(40, np.int64)
    dist[1] = 1  # near distance 2: one to the left
    s.put_code(dist)
    for a, r, g, b in colours:
        s.put(int(codes[g]), 2)
        s.byte(r)
        s.byte(b)
    s.put(int(codes[280 + slot]), 2)  # the first colour again
    s.put(int(codes[256 + 4]), 2)  # length 5 + one extra bit
    s.put(0, 1)
    s.put(int(codes[256 + 4]), 2)
    s.put(1, 1)
    for _ in range(2):
        s.put(int(codes[280 + slot]), 2)
    assert pixels_of(webp.decode(webp.riff(s.bytes()))) == [colours[0], colours[1], *[colours[0]] * 14]
    s = Stream()  # two groups of codes, by blocks of four columns
    s.header(8, 1)
    s.put(0, 1)
    s.put(0, 1)
    s.put(1, 1)
    s.put(0, 3)
    s.image([(255, 0, 0, 0), (255, 0, 1, 0)])
    for value in (5, 6):
        for symbol in (value, value, value, 255, 0):
            one = np.zeros(256, np.int64)
            one[symbol] = 1
            s.put_code(one)
    assert pixels_of(webp.decode(webp.riff(s.bytes()))) == [(255, 5, 5, 5)] * 4 + [(255, 6, 6, 6)] * 4
    for bad in (b"", b"RIFF", webp.riff(b""), webp.riff(b"\xff" * 30)):
        with pytest.raises(webp.WebPError):
            webp.decode(bad)
    assert len(webp._NEAR) == 120 and webp._NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp._NEAR[-1] == (8, 7)


# --- 8: shards


def test_shards(spark):
    rng = random.Random(7)
    docs = frame(spark, [prose(rng, rng.randrange(1, 60)) for _ in range(300)] + [None, "", "x" * 5000])
    rows = shards.shard(docs, limit=2000).collect()
    assert len(rows) == 303
    by = {}
    for r in rows:
        by.setdefault(r.shard_id, []).append(r)
        bits = f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:13], 16):052b}"
        assert bits.startswith(r.shard_id.split(".")[0])
    for own in by.values():
        total = sum(r.n_bytes for r in own)
        assert total <= 2000 or len([r for r in own if r.n_bytes]) == 1
        assert all(r.shard_bytes == total for r in own)
    same = docs.withColumn("doc_id", F.lit(1).cast("long"))  # one key has all rows
    rows = shards.shard(same.where("length(text) < 2000"), limit=2000).collect()
    sizes = {}
    for r in rows:
        sizes[r.shard_id] = sizes.get(r.shard_id, 0) + r.n_bytes
    assert len(rows) == 301 and max(sizes.values()) <= 2000 and len(sizes) > 5
    odd = docs.limit(20).withColumns({n: F.lit("mine") for n in ("prefix", "__h", "__from", "__order", "depth", "h", "k", "n_bytes")})
    kept = shards.shard(odd, limit=500).collect()
    assert len(kept) == 20 and all(r.prefix == r["__h"] == r["__from"] == r["__order"] == r.depth == r.h == r.k == "mine" and r.n_bytes != "mine" for r in kept)
    assert shards.shard(empty(spark)).count() == 0 and shards.shard(docs.limit(1)).first().shard_id == ""


# --- 9: PII

_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


@given(st.text(alphabet="a.@-+%01 4(é\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_kinds_match_the_patterns(text):
    got = [(s.kind, s.start, s.end) for s in pii.spans(text) if s.kind in _PLAIN]
    assert got == [(k, *m.span()) for k, (p, ok) in _PLAIN.items() for m in re.finditer(p, text) if ok(m[0])]


def test_pii(spark):
    text = "mail a.b@c.de, card 4111 1111 1111 1111, call +49 (30) 1234567, IBAN GB82 WEST 1234 5698 7654 32, host 10.0.0.1 or 300.1.1.1, token = \"abcdefabcdef012345\""
    assert [s.kind for s in pii.spans(text)] == ["email", "ip", "card", "phone", "iban", "secret"]
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83 WEST 1234 5698 7654 32")
    near, bare = pii.spans("ssn 123-45-6789")[0].score, pii.spans("123-45-6789")
    assert near >= pii.KEEP and not bare
    assert not pii.spans("classn 123-45-6789") and not pii.spans("ssn of the part, serial 123-45-6789")  # whole words; words that speak against it
    score = lambda t: pii.spans(t)[0].score
    assert score("host 10.0.0.1") > score("ship 10.0.0.1") == score("10.0.0.1") > score("version 10.0.0.1") > 0  # a base span stays
    assert score("x" * 38 + " ip 10.0.0.1") > score("zip" + " " * 38 + "10.0.0.1") == score("10.0.0.1")  # a word that the reach cuts isn't read
    rows = pii.find(frame(spark, [text, None, "", "1" * 200_000, "@" * 50_000 + "a" * 50_000])).orderBy("doc_id").collect()
    assert [len(r.spans) for r in rows] == [6, 0, 0, 0, 0] and pii.find(empty(spark)).count() == 0


# --- 10: packing


def test_packing(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(1, 900)) + "." for _ in range(40)] + [None, "", "a" * 30_000, "Don't! É 12 " * 50]
    rows = packing.pack(frame(spark, texts).repartition(3), with_ids=True, run_bytes=9000).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for i, text in enumerate(texts):
        own = sorted(docs[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1]) and all(r.doc_tokens == own[-1].start + own[-1].length for r in own)
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1]) and own[-1].offset + own[-1].length <= 2048
    assert packing.pack(empty(spark)).count() == 0


def test_plan_is_optimal():
    rng = random.Random(9)
    for _ in range(60):
        length, ends = 16, np.cumsum([rng.randint(1, 30) for _ in range(rng.randint(1, 10))])
        sentences = np.array(sorted(rng.sample(range(1, int(ends[-1]) + 1), int(ends[-1]) // 5)), np.int64)
        pen = lambda x: 0 if x in ends else packing.SENTENCE_CUT if x in sentences else packing.HARD_CUT  # noqa: E731, B023
        pad = lambda n: 0 if n & (n - 1) == 0 else length - n  # noqa: E731, B023
        spots = [0]
        for x in sorted({*ends.tolist(), *sentences.tolist()}):
            while x - spots[-1] > length:
                spots.append(spots[-1] + length)
            spots.append(x)
        best = {0: 0}
        for i, x in enumerate(spots[1:], 1):
            best[x] = min(best[y] + pad(x - y) for y in spots[:i] if x - y <= length) + pen(x) + packing.SEQUENCE
        cuts = packing.plan(ends, sentences, length).tolist()
        assert sum(pad(x - y) + pen(x) + packing.SEQUENCE for y, x in zip([0, *cuts], cuts, strict=False)) == best[int(ends[-1])]


# --- the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(10)
    base = [prose(rng, 120) + f"\nfooter\nunique {i}" for i in range(30)]
    item = prose(rng, 20)
    texts = [*base, base[3] + " end", base[4], f"{prose(rng, 40)} {item} {prose(rng, 40)}", None, "123"]
    frame(spark, texts).select(*cp.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in cp.STAGES[:-1]:
        docs = cp.settle(stage(spark, docs, str(tmp_path)))
        assert docs.columns == cp.COLUMNS
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = set(range(33))
    assert kept[0] == everything and kept[1] == everything and kept[2] == everything - {30, 31} and kept[3] == kept[2] - {32}
    assert {r.doc_id for r in docs.where("text like '%footer%'").collect()} == {0}
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == kept[3]


def leaks(spark, folder, texts, item):
    """What the stage leaves of (id, text)."""
    import corpus_pipeline as cp

    rows = [(i, t, "en", "s", None) for i, t in texts]
    docs = cp.settle(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return sorted(((r.doc_id, r.text) for r in cp.benchmark_leaks(spark, docs, str(folder)).collect()), key=str)


def test_pipeline_drops_items_with_a_word_inserted(spark, tmp_path):
    rng = random.Random(11)
    words = WORDS[:14]
    near, far = " ".join([*words[:7], "new", *words[7:]]), " ".join([*words[:7], *"abcdefg", *words[7:]])
    texts = [(i, f"{prose(rng, 30)} {t} {prose(rng, 30)}") for i, t in enumerate([" ".join(words), near, far, ""])]
    assert [i for i, _ in leaks(spark, tmp_path, texts, " ".join(words))] == [2, 3]


def test_pipeline_drops_leaks_by_row(spark, tmp_path):
    rng = random.Random(12)
    item, clean = prose(rng, 20), prose(rng, 40)
    texts = [(None, item), (None, clean), (1, item + " x"), (1, clean), (2, None), (3, "")]
    assert leaks(spark, tmp_path, texts, item) == sorted([(None, clean), (1, clean), (2, None), (3, "")], key=str)
    docs = spark.createDataFrame(texts * 40, "doc_id long, text string")
    bench = spark.createDataFrame([(str(i), prose(rng, 15)) for i in range(6)] + [(None, item)], "item_id string, text string")
    for block in (1 << 20, 200):
        found = decontaminate.decontaminate(docs, bench, block=block).where(F.size("matches") == 0).count()
        assert decontaminate.keep_clean(docs, bench, block=block).count() == found == 160
