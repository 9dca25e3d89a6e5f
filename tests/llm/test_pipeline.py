"""The pipeline and the queries of this subpackage on the small tables."""

from collections import Counter

import pytest
from pyspark.sql import Row
from test_llm_operators import WORDS, brute_classes, lines_left

import corpus_pipeline
from marea.llm import words
from marea.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
            assert out.count() > 0.8 * docs.count()
            docs = out.cache()
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    tokens = lambda df: df.agg({"length": "sum"}).first()[0]  # noqa: E731  where windows are cut depends on partitions
    assert tokens(corpus_pipeline.run(spark, SF)) == tokens(out)


def test_run_is_brute_force(spark, tmp_path):
    """Over planted exact and near copies: an exact copy goes whole, and what is packed are the texts found by brute force."""
    some = sorted(spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect(), key=lambda r: r.doc_id)[:120]
    rows = [tuple(r) for r in some]
    for r in some[:60]:
        w = r.text.split(" ")
        near = " ".join([*w[: len(w) // 2], "planted", *w[len(w) // 2 + 1 :]])
        rows += [(10**6 + r.doc_id, r.text, *r[2:]), (2 * 10**6 + r.doc_id, near, *r[2:])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    told = sorted(corpus_pipeline.language_id(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect(), key=lambda r: r.doc_id)
    left = {r.doc_id: t for r, t in zip(told, lines_left([r.text for r in told]), strict=True) if t.split() or t == r.text}
    copies = {r.doc_id for r in told if 10**6 <= r.doc_id < 2 * 10**6}
    short = {r.doc_id for r in told if "\n" not in r.text}
    assert copies and not (copies & set(left)) - short
    classes = brute_classes([Row(doc_id=i, text=t) for i, t in left.items()])
    kept = {i: left[i] for i, _, c in classes if i == c}
    assert not copies & set(kept)
    out = corpus_pipeline.run(spark, str(tmp_path))
    n = {i: len(x) // 4 + 1 for i, x in zip(kept, words.word_tokenizer(WORDS)()(list(kept.values())), strict=True)}
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(n)
    assert out.agg({"length": "sum"}).first()[0] == sum(n.values())


def test_near_duplicates_by_row(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, a), (2, a + " more"), (3, b), (3, "other words of the same id here"), (None, a), (None, "c " + b), (None, "alone without an id"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == Counter([(1, a), (3, b), rows[4], rows[7], (4, ""), (5, None)])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, tmp_path, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/q")
    c.execute(f"CREATE TABLE wanted AS {ORACLE_SQL[name]}")
    cols = ", ".join(sorted(r[0] for r in c.execute("DESCRIBE wanted").fetchall()))
    got = f"(SELECT {cols} FROM '{tmp_path}/q/*.parquet')"
    for a, b in (("wanted", got), (got, "wanted")):
        assert c.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
