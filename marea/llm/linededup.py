"""Removal of lines that repeat across the corpus in the company of a neighbour.

Every line is hashed once; a rolling hash goes over the hashes of two lines on end (blank lines between belong to them), and
content alone chooses boundaries by it: a pair whose hash is the least of the `window` pairs to either side begins a chunk,
which goes to the next such pair, so where a passage begins and ends in its host moves its inner boundaries by nothing.
With window 1 every pair is a chunk and chunks overlap; a repeated passage of two lines or more then goes whole. With
longer windows a chunk is longer, fewer are shuffled, and the ends of a passage outside its whole chunks stay. Only where
asked for, a line of at least min_words words is a chunk of its own. Chunks that occur more than once are kept at their first
place (smallest id, then position) and removed elsewhere, after their bytes were compared with those of the first. A
single line else stays.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, fresh, hot_join, likely, written

#: Factor of the rolling hash, modulo 2 ** 128: a fixed odd number.
_ROLL, _MASK = 0x9E3779B97F4A7C15F39CC0605CEDC835, (1 << 128) - 1


def chunks(text: str | None, min_words: int | None = None, window: int = 1) -> list[tuple[int, int, bytes]]:
    """(start, end, rolled hash) of the chunks of a text that may be removed: lines start to end - 1."""
    lines = text.encode().split(b"\n") if text else []
    pairs, single = [], []  # (first line, line after the last, hash); (line, hash)
    before = rolled = None
    for k, line in enumerate(lines):
        own = int.from_bytes(hashlib.blake2b(line, digest_size=16).digest(), "little")
        if rolled is not None:
            rolled = (rolled * _ROLL + own) & _MASK  # blank lines too
        if not line.strip():
            continue
        long = min_words is not None and len(line.split()) >= min_words
        if before is not None and not (long and before[1]):  # two long ones are found alone
            pairs.append((before[0], k + 1, rolled))
        if long:
            single.append((k, k + 1, (own * _ROLL + 1) & _MASK))
        before, rolled = (k, long), own
    if window > 1:
        pairs = _between_boundaries(pairs, window)
    return [(s, e, h.to_bytes(16, "little")) for s, e, h in sorted(pairs + single)]


def _between_boundaries(pairs: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int]]:
    """Chunks from one pair whose hash is the least within window to the next one; their hash rolls over those of their pairs."""
    hashes = [h for _, _, h in pairs]
    chosen = [k for k, h in enumerate(hashes) if h == min(hashes[max(0, k - window + 1) : k + window])]
    out = []
    for a, z in zip(chosen, chosen[1:], strict=False):
        if all(x[1] - 1 == y[0] for x, y in zip(pairs[a:z], pairs[a + 1 : z + 1], strict=True)):  # one after another
            rolled = 0
            for h in hashes[a:z]:
                rolled = (rolled * _ROLL + h) & _MASK
            out.append((pairs[a][0], pairs[z - 1][1], rolled))
    return out


def without_lines(text: str, gone: list[int]) -> str:
    gone = set(gone)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None, window: int = 1) -> DataFrame:
    """docs with repeated chunks removed from text_col, and two columns more: lines_removed and lines_total.

    min_words makes a single line of so many words a chunk; without it only lines on end are, by boundaries of window. A chunk that overlaps its
    own first place (a line many times on end) loses only what that place doesn't hold. A document that consists of
    repeated chunks only ends with the empty text. Null texts stay null (0 lines), rows of null id stay whole and count
    for nothing. Rows with one id and one text are one document, all treated alike. Other columns are carried as they are,
    but for earlier ones of the two new names. Texts that hold no repeated chunk are not shuffled. Hot chunks are met by
    broadcast of their first places, and their bytes by so many copies of the first as they have thousands of places.
    """
    identity = [F.col(id_col).cast("string").alias("i"), F.xxhash64(F.col(text_col)).alias("h")]
    found = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("own"), *identity, F.col(text_col).alias("t"))

    @F.pandas_udf("array<struct<s:int,e:int,k:binary>>")
    def index(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks(t, min_words, window) for t in texts], dtype=object)

    places = written(found.select("own", "i", "h", F.explode(index("t")).alias("c")).select("own", "i", "h", "c.*"), "chunks")
    order = F.struct("own", "h", "s")
    firsts = places.groupBy("k").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where("first != last").select("k", "first", "n", F.col("n").alias("places"))
    repeated = hot_join(places, firsts, "k", places.count()).select("i", "h", "s", "e", "k", "places", (order == F.col("first")).alias("is_first"))
    whole = repeated.repartition("i", "h").distinct()  # rows of one id and one text are one document
    marks = written(whole.groupBy("i", "h").agg(F.collect_list(F.struct("s", "e", "k", "places", "is_first")).alias("m")), "marks")  # at most two a line
    dropped(places)

    @F.pandas_udf("array<binary>")
    def bodies(texts: pd.Series, marks: pd.Series) -> pd.Series:
        cut = lambda t, m: (lines := t.encode().split(b"\n")) and [b"\n".join(lines[x["s"] : x["e"]]) for x in m]
        return pd.Series([cut(t, m) for t, m in zip(texts, marks, strict=True)], dtype=object)

    keyed = likely(found.select("i", "h", "t"), "h", marks).join(marks, ["i", "h"]).dropDuplicates(["i", "h"])
    spelled = written(keyed.select("i", "h", F.explode(F.arrays_zip("m", bodies("t", "m").alias("b"))).alias("x")).select("i", "h", "x.m.*", F.col("x.b").alias("b")), "repeats")
    dropped(marks)
    parts = F.ceil(F.col("places") / PLACES).cast("int")
    kept = spelled.where("is_first").select("k", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("b").alias("first_b"), F.col("i").alias("first_i"), F.col("h").alias("first_h"), F.col("e").alias("first_e"))
    others = spelled.where("not is_first").withColumn("part", F.pmod(F.xxhash64("i", "h", "s"), parts).cast("int"))
    same = others.join(kept, ["k", "part"]).where("b = first_b")
    start = F.when((F.col("i") == F.col("first_i")) & (F.col("h") == F.col("first_h")), F.greatest("s", "first_e")).otherwise(F.col("s"))
    lines = same.withColumn("s", start).where("s < e").withColumn("n", F.sequence("s", F.col("e") - 1))
    gone = written(lines.groupBy("i", "h").agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("gone")), "gone")
    dropped(spelled)  # the bytes of all repeats: nothing reads them any more
    return _cut(docs, gone, id_col, text_col)


#: Words from which the queries count a single line as a passage.
PASSAGE = 50
#: Places of one chunk that are compared with one copy of its first.
PLACES = 1_000


def _cut(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if m is None or t is None else without_lines(t, list(m)) for t, m in zip(texts, spans, strict=True)], dtype=object)

    i, h, lost, flag = fresh(docs, "i", "h", "gone", "likely")
    told = ("lines_removed", "lines_total")

    def lines(df: DataFrame, removed: Column, text: Column) -> DataFrame:
        total = F.coalesce(F.when(F.col(text_col) == "", 0).otherwise(F.size(F.split(F.col(text_col), "\n"))), F.lit(0))
        return df.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in told], removed.alias(told[0]), total.alias(told[1]))

    named = docs.withColumns({i: F.col(id_col).cast("string"), h: F.xxhash64(F.col(text_col))})
    split = likely(named, h, gone.withColumnRenamed("h", h), keep_rest=flag)
    rest = lines(split.where(~F.col(flag)), F.lit(0), F.col(text_col))
    met = split.where(flag).join(gone.withColumnsRenamed({"i": i, "h": h, "gone": lost}), [i, h], "left")
    some = lines(met, F.size(F.coalesce(lost, F.array().cast("array<int>"))), F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(lost))))
    return rest.unionByName(some)
