"""The four stages of the pipeline on nulls, empty and very long texts, ties, repeats, an empty table and extra columns."""

from collections import Counter

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the house and the garden of this old town are near that river with many boats and their people who work there every day of the week"
GERMAN = "das haus und der garten dieser alten stadt sind nahe bei dem fluss mit vielen booten und ihren leuten die dort jeden tag der woche arbeiten"


def said(text, k):
    words = text.split()
    return " ".join(words[(k * 7 + 3 * j) % len(words)] for j in range(24))


TRAINING = [(1000 + k, said(ENGLISH if k % 2 else GERMAN, k), "en" if k % 2 else "de", "s", 1) for k in range(200)]
LONG = " ".join(f"{w}{k}" for k in range(6000) for w in ENGLISH.split()[:10])
ROWS = [
    (1, ENGLISH, "en", "a", 5), (2, ENGLISH, None, None, None), (1, ENGLISH, "en", "a", 5), (None, ENGLISH, "en", "a", 5), (None, None, None, None, None),
    (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, "  \n \t", "en", "a", 5), (6, "12345 !!", "en", "a", 8), (7, GERMAN, "de", "b", 7), (8, LONG, "en", "b", 9), (9, LONG + " more", "en", "b", 9),
    (10, f"{GERMAN}\n{ENGLISH}\nown end", "de", "c", 1), (11, f"{GERMAN}\n{ENGLISH}\nother end here", "de", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + TRAINING, SCHEMA).repartition(3).cache()


def told(df):
    return Counter((r.doc_id, r.text) for r in df.collect() if r.doc_id is None or r.doc_id < 1000)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table_and_extra_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.limit(0), "").count() == 0
    some = docs.selectExpr("*", "1 AS component_id", "2 AS __row", "3 AS likely", "4 AS lang_pred", "5 AS lines_removed", "6 AS `x.y`")
    assert stage(spark, some, "").columns == stage(spark, docs, "").columns
    if name != "packing":
        assert told(stage(spark, some, "")) == told(stage(spark, docs, ""))


def test_language_id(spark, docs):
    out = told(corpus_pipeline.language_id(spark, docs, ""))
    assert out[1, ENGLISH] == 2 and out[None, ENGLISH] == 1 and out[8, LONG] == 1 and out[7, GERMAN] == 1
    assert not {3, 4, 5, 6} & {i for i, _ in out} and (None, None) not in out
    kept = corpus_pipeline.language_id(spark, docs, "").where("doc_id >= 1000").count()
    assert kept >= 198


def test_line_dedup(spark, docs):
    out = told(corpus_pipeline.line_dedup(spark, docs, ""))
    assert out[3, None] == out[4, ""] == out[5, "  \n \t"] == out[None, None] == 1  # nothing was taken from them
    assert out[10, f"{GERMAN}\n{ENGLISH}\nown end"] == 1 and out[11, "other end here"] == 1
    assert out[1, ENGLISH] == 2 and out[None, ENGLISH] == 1 and out[8, LONG] == 1 and out[9, LONG + " more"] == 1
    row = corpus_pipeline.line_dedup(spark, docs, "").where("doc_id = 11").first()
    assert (row.n_chars, row.source, row.lang) == (14, "c", "de")


def test_near_duplicates(spark, docs):
    out = told(corpus_pipeline.near_duplicates(spark, docs, ""))
    assert out[1, ENGLISH] == 1 and (2, ENGLISH) not in out and (None, ENGLISH) not in out  # the least id stays, once
    assert out[8, LONG] == 1 and (9, LONG + " more") not in out
    assert out[3, None] == out[4, ""] == out[5, "  \n \t"] == out[None, None] == out[6, "12345 !!"] == 1


def test_packing(spark, docs):
    rows = corpus_pipeline.pack(spark, docs, "").collect()
    spans = Counter()
    for r in rows:
        spans[r.doc_id, r.doc_tokens] += r.length
    assert spans[3, 1] == spans[4, 1] == spans[5, 1] == 1 and spans[None, 1] == 1
    assert sum(n for (i, _), n in spans.items() if i == 8) == max(t for i, t in spans if i == 8) > 2048
    assert all(r.offset + r.length <= 2048 for r in rows)
