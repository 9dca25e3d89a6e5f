"""Divergence of sources from each other and from their language, by joint count histograms.

Terms are counted by task, then by language and term. How two sources differ depends on a term only through its two
counts, so for each pair of sources the terms are tallied by (count, count): cells where both counts are positive come
from the terms' lists of sources; cells with a zero follow from each source's own histogram less what its terms share
with the other, and the cell of two zeros from the number of terms. The divergence is evaluated once a cell and weighed
by the cell's number of terms. Shares are whole numbers, so all sums are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import hot_join, released, written

#: Distinct terms a task holds, over all its groups, before it gives them on.
HELD = 400_000
#: A share of 1 is so many units.
UNITS = 1_000_000_000
#: Letters, lower-cased, and all that isn't ASCII stay; the rest parts terms.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The runs of letters A-Z, a-z (lower-cased) and characters beyond ASCII of a UTF-8 text."""
    return text.translate(_TERMS).split()


def term_counts(docs: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it); a group may come in several parts that add up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (of, by), (n, rows) in held.items():
                if n:
                    words = pa.array(list(n), pa.binary()).cast(pa.string())
                    yield pa.record_batch([pa.repeat(of, len(n)), pa.repeat(by, len(n)), words, pa.array(list(n.values()), pa.int64()), pa.array(list(map(rows.__getitem__, n)), pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for of, by, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                found = terms(raw)
                n, rows = held.setdefault((of, by), (Counter(), Counter()))
                before = len(n)
                n.update(found)
                rows.update(set(found))
                size += len(n) - before
                if size > HELD:
                    yield from told()
                    size = 0
        yield from told()
        released()

    return docs.select(lang, source, text).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: str, n: str, v: str) -> str:
    """SQL of a term's share in units, with one occurrence more for each of the v terms; null if there are no terms."""
    return f"1 + CAST({UNITS} * CAST({count} + 1 AS DECIMAL(20,0)) AS DECIMAL(38,0)) div CAST(nullif({n} + {v}, 0) AS DECIMAL(20,0))"


def distance(p: str, q: str) -> str:
    """SQL of the squared difference over the second share, a whole number."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others (part pair) and which terms it has more than its language (part term, to rank top).

    A language keeps the terms that min_docs of its rows hold. Null text, language or source count as the empty string;
    each row is a document, repeated ones too; a group without kept terms has its pairs; a language without kept terms
    has distances of 0; one source alone has no pairs; an empty table gives no rows; other columns are not read.
    Term rows are shuffled once, pre-counted by task. Lists of a term's sources are no longer than a language has sources.
    Groups of many terms meet their sizes in parts.
    """
    lang, source = (F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))
    counts = term_counts(docs, lang, source, F.coalesce(F.col(text_col), F.lit("")))
    one = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = one.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("at"))
    kept = written(by_term.where(F.col("docs") >= min_docs).select("lang", "term", "total", "at"), "terms")
    own = kept.select("lang", "term", "total", F.inline("at"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    histogram = written(own.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")), "histogram")
    of_group = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("group_n"), F.sum("m").alias("terms"))
    known = docs.select(lang, source).distinct().join(langs, "lang", "left").join(of_group, ["lang", "source"], "left")
    sizes = written(known.fillna(0, ["v", "lang_n", "group_n", "terms"]), "groups")
    found = _pairs(kept, histogram, sizes).withColumn("part", F.lit("pair")).unionByName(_terms(own, sizes, top).withColumn("part", F.lit("term")))
    return found.select("lang", "source", "part", "item", "value", "rank")


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(own: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    group = F.struct("lang", "source").alias("g")
    total = sizes.agg(F.coalesce(F.sum("terms"), F.lit(0)).alias("n")).first()["n"]
    met = hot_join(own.select(group, "term", "total", F.col("n").alias("c")), sizes.where("terms > 0").select(group, "v", "lang_n", "group_n", F.col("terms").alias("n")), "g", total)
    shares = met.withColumns({"p": F.expr(share("c", "group_n", "v")), "q": F.expr(share("total", "lang_n", "v"))})
    more = shares.where("p > q").select("g.lang", "g.source", F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    return _ranked(more).where(F.col("rank") <= top)


def _pairs(kept: DataFrame, histogram: DataFrame, sizes: DataFrame) -> DataFrame:
    """Both directions of every two sources of a language; rows of the result, so there are as many of them as it has."""
    side = lambda x: sizes.select("lang", F.col("source").alias(x), F.col("group_n").alias(f"n{x}"), F.col("terms").alias(f"t{x}"), "v")
    pairs = written(side("a").join(side("b").drop("v"), "lang").where("a < b"), "pairs")
    listed = kept.where(F.size("at") > 1).select("lang", F.explode("at").alias("x"), "at")
    both = listed.select("lang", "x", F.explode(F.expr("filter(at, y -> y.source > x.source)")).alias("y"))
    joint = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("ca"), F.col("y.n").alias("cb")).agg(F.count(F.lit(1)).alias("m"))
    # A term in both leaves the cells with a zero that it would else be counted in.
    cell = lambda ca, cb, m: f"named_struct('ca', {ca}, 'cb', {cb}, 'm', {m})"
    spread = joint.select("lang", "a", "b", F.inline(F.expr(f"array({cell('ca', 'cb', 'm')}, {cell('ca', '0L', '-m')}, {cell('0L', 'cb', '-m')}, {cell('0L', '0L', 'm')})")))
    alone = lambda x, ca, cb: pairs.select("lang", "a", "b").join(histogram.withColumnRenamed("source", x), ["lang", x]).select("lang", "a", "b", ca, cb, "m")
    n, zero = F.col("n"), F.lit(0).cast("long")
    cells = spread.unionByName(alone("a", n.alias("ca"), zero.alias("cb"))).unionByName(alone("b", zero.alias("ca"), n.alias("cb")))
    cells = cells.unionByName(pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), F.expr("v - ta - tb").alias("m")))
    tally = cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    met = tally.join(pairs, ["lang", "a", "b"]).withColumns({"p": F.expr(share("ca", "na", "v")), "q": F.expr(share("cb", "nb", "v"))})
    weighed = lambda p, q: F.coalesce(F.sum(F.expr(f"m * ({distance(p, q)})")), F.lit(0))
    sums = met.groupBy("lang", "a", "b").agg(weighed("p", "q").alias("ab"), weighed("q", "p").alias("ba"))
    way = lambda p, q: f"named_struct('source', {p}, 'item', {q}, 'value', {p}{q})"
    return _ranked(sums.select("lang", F.inline(F.expr(f"array({way('a', 'b')}, {way('b', 'a')})"))))
