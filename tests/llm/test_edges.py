"""Every registered corpus query on tables of nothing but edge cases, and on empty ones."""

import random

import pytest

import corpus_pipeline
from logspindle.llm import queries

WORDS = [f"w{i}" for i in range(300)]
#: Names that the operators use themselves.
CLASH = ["id", "line", "site", "token", "host", "path", "rule", "score", "matches", "items", "n_words", "n_hit", "spans", "lang_pred", "component_id", "shard_id", "sequence_id", "h1", "h2", "row", "place"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
LABELS = "doc_id long, quality int, toxic int, text string, score double"
PAGES = "page_id long, url string, html string, doc_id string, host string, path string, verdict string"
BENCHMARK = "item_id string, text string, doc_id string, n_words string"
BY_DOCUMENT = ["op1_line_dedup", "op2_decontamination", "op3_toxicity", "op4_language_id", "op6_jaccard_join", "op7_media_columns", "op8_sharding", "op9_pii"]
NAMES = [*queries.queries(), "pipeline"]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def documents():
    a, b, item = prose(1, 60), prose(2, 60), prose(3, 12)
    texts = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", "fr", "s"), (4, "a", None, "s"), (4, "½ 12 ²", "en", None),
        (None, a, "en", "s"), (5, a, "en", "s"), (5, b, "fr", "t"), (6, a, "en", "s"), (7, a + " x", "en", "s"), (9, b + " y", "fr", "t"), (9, b + " y", "fr", "t"),
        (10, prose(4, 60_000), "en", "s"), (11, "q" * 300_000, "fr", "t"), (12, "w " * 20_000, "en", "s"), (13, "line\n" * 5_000, "en", "s"),
        (14, f"{prose(5, 30)} {item} {prose(6, 30)}", "fr", "t"), (None, item, "en", None), (None, None, None, None), (15, "\u0000퟿\U0001f600 é", "fr", "t"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), *(["clash"] * len(CLASH))) for i, t, lang, source in texts], item


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    rows, item = documents()
    return _write(spark, tmp_path_factory.mktemp("edges"), rows, [(1, 0, 1, "x", 0.5), (1, 0, 1, "x", 0.5), (5, 1, 0, None, None), (5, 0, 1, None, None), (None, 1, 1, None, None), (9, None, None, None, None)], [
        (1, None, None), (2, "", None), (3, "no scheme", ""), (None, "http://EXAMPLE.net/en/x?y", None), (4, "http://example.net/en/x", None), (4, "http://a.net", None), (5, "https://example.com/de/#f", None), (6, "ftp://x.org/fr/" + "p" * 100_000, None), (6, "://", None), (7, "http:///only", None),
    ], [("i1", item), ("i1", item), (None, item), ("i2", None), ("i3", ""), ("i4", prose(7, 4)), ("i5", "w " * 500)])


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("none"), [], [], [], [])


def _write(spark, folder, docs, labels, pages, benchmark):
    spark.createDataFrame(docs, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*p, "clash", "clash", "clash", "clash") for p in pages], PAGES).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(*b, "clash", "clash") for b in benchmark], BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def run(spark, name, folder):
    return corpus_pipeline.run(spark, folder) if name == "pipeline" else queries.queries()[name](spark, folder)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert run(spark, name, empty_dir).collect() == []


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_a_row_for_each_document(spark, edge_dir, name):
    """Null and repeated ids keep their rows; equal texts of one source get equal values."""
    key = lambda i: (i is None, i or 0)
    out = [r.asDict() for r in run(spark, name, edge_dir).collect()]
    assert sorted((r["doc_id"] for r in out), key=key) == sorted((d[0] for d in documents()[0]), key=key)
    nines = [r for r in out if r["doc_id"] == 9]
    assert nines[0] == nines[1] or name == "op1_line_dedup"  # there the second of the rows loses lines


def test_values_of_edge_cases(spark, edge_dir):
    by = lambda name: {r["doc_id"]: r for r in run(spark, name, edge_dir).collect()}
    leaks = by("op2_decontamination")
    assert leaks[1]["n_words"] == leaks[2]["n_words"] == 0 and leaks[12]["contaminated"] and leaks[14]["n_hit"] == 12 and leaks[10]["n_words"] == 60_000
    assert leaks[14]["n_items"] == 1 and not leaks[5]["contaminated"]
    langs = by("op4_language_id")
    assert [langs[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and langs[11]["lang_pred"] in ("en", "fr")
    links = run(spark, "op6_jaccard_join", edge_dir).collect()
    assert {r["component_id"] for r in links if r["doc_id"] in (5, 6, 7, 9)} == {5}
    assert {r["n_shingles"] for r in links if r["doc_id"] in (1, 2, 3)} == {0} and {r["n_shingles"] for r in links if r["doc_id"] in (11, 12)} == {1}
    toxic = by("op3_toxicity")
    assert all(0 <= r["score"] <= 1 for r in toxic.values()) and toxic[1]["score"] == toxic[2]["score"]


def test_every_page_is_judged(spark, edge_dir):
    out = run(spark, "op5_url_filter", edge_dir).collect()
    assert len(out) == 10 and all(r["verdict"] in ("allow", "block") for r in out)
    assert {(r["host"], r["rule"], r["verdict"]) for r in out if r["host"].startswith("example")} == {("example.net", "example.net/en/", "allow"), ("example.com", "example.com/de/", "block")}


def test_pieces_cover_every_document(spark, edge_dir):
    pieces = [r.asDict() for r in run(spark, "op10_packing", edge_dir).collect()]
    docs = documents()[0]
    whole = sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
    assert sum(p["length"] for p in pieces) == whole and sum(p["start"] == 0 for p in pieces) == len(docs)
    at: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(at.values()) <= 2048


def test_the_pipeline_keeps_clean_rows(spark, edge_dir):
    kept = {r["doc_id"] for r in run(spark, "pipeline", edge_dir).collect()}
    assert kept <= {d[0] for d in documents()[0]} and not kept & {1, 2, 3, 12, 14}
