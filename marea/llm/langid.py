"""Language identification by error-correcting output codes.

Every language gets a codeword. Each bit is predicted by a binary classifier over hashed character n-grams: a linear
score, the mean log odds of the text's n-grams between the languages whose codeword has the bit and the others. Decoding
is weighted by loss: each bit's logistic loss against each codeword counts by the bit's reliability, and the nearest
codeword wins. A text is ambiguous if the second nearest is almost as near: nearer than it is for nearly all texts of the sample
that the classifiers get right.

Training counts n-grams of a bounded sample: the max_rows labelled rows of lowest hashed id.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SLOTS = 1 << 15
#: Code points scored in one go; longer texts go in chunks that end at a word's end, whose sums are added.
CHUNK = 1 << 16
#: Shares of a language's n-grams are whole numbers of this unit, so that sums over tasks don't depend on their order.
UNIT = 1 << 40
_DROP = re.compile(r"[\W\d_]+")


def _chunks(text: str) -> Iterator[str]:
    """text's lower-cased words in blanks, cut between words once a chunk is long."""
    clean, at = _DROP.sub(" ", text.lower()), 0
    while len(clean) - at > CHUNK:
        end = clean.find(" ", at + CHUNK)
        if end < 0:
            break
        yield f" {clean[at:end]} "
        at = end
    yield f" {clean[at:]} "


def _grams(clean: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, slots) of the 1-, 2- and 3-grams of words in blanks; none spans two blanks on end."""
    codes = np.frombuffer(clean.encode("utf-32-le"), "<u4").astype(np.uint32)
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (codes[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (codes[2:] + np.uint32(0x1B873593))) * np.uint32(0xC2B2AE35)
    letters = codes != 32
    for hashed, kept in ((one, letters), (two, letters[:-1] | letters[1:]), (three, letters[1:-1])):
        at = np.flatnonzero(kept)
        yield at, hashed[at] >> np.uint32(17)


def ngram_slots(text: str) -> Iterator[np.ndarray]:
    """Slots of the character 1- to 3-grams of text's lower-cased words, each word in blanks; chunk by chunk."""
    for chunk in _chunks(text):
        yield np.concatenate([slots for _, slots in _grams(chunk)])


def codewords(k: int, bits: int = 24, seed: int = 5) -> np.ndarray:
    """k codewords of +1 and -1: all splits of up to 5 languages, else random columns with both values, rows apart."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 5:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array(columns, np.float64).reshape(-1, k).T
    rng, best = np.random.default_rng(seed), None
    if k > 64:  # long random words are far apart; those too near another one are drawn again
        code = rng.choice([-1.0, 1.0], size=(k, 8 * k.bit_length()))
        least = code.shape[1] // 5
        for _ in range(100):
            near = [i for at in range(0, k, 512) for i in (at + np.flatnonzero((np.triu((code.shape[1] - code[at : at + 512] @ code.T) / 2 < least, at + 1)).any(1))).tolist()]
            if not near:
                break
            code[near] = rng.choice([-1.0, 1.0], size=(len(near), code.shape[1]))
        return code
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(k, max(bits, 2 * k.bit_length())))
        if (np.abs(code.sum(0)) == k).any():
            continue
        apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


class Model:
    """langs, code [language, bit], odds [slot, bit], weight [bit], scale, and margin, the difference of losses below which a text is ambiguous."""

    def __init__(self, langs: list[str], counts: np.ndarray | None = None, margin: float = 0.02, sums: np.ndarray | None = None):
        """From counts [language, slot], or from sums [slot, 1 + bit]: all languages' shares, then those of each bit's languages."""
        self.langs, self.code, self.margin = langs, codewords(len(langs)), margin
        if sums is None:
            counts = counts.astype(np.float64)
            share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * SLOTS)  # languages weigh alike
            sums = np.concatenate([share.sum(0)[:, None], share.T @ (self.code > 0)], 1) if len(langs) else np.zeros((SLOTS, 1))
        bits, reach = [], []
        for k, column in enumerate(self.code.T):
            with_bit, without = sums[:, k + 1], sums[:, 0] - sums[:, k + 1]
            n, m = (column > 0).sum(), (column < 0).sum()
            odds = np.log(with_bit / n) - np.log(without / m)
            bits.append(odds - (with_bit @ odds / n + without @ odds / m) / 2)
            reach.append(max(1e-6, (with_bit @ odds - without @ odds) / len(langs)))  # the languages' mean margin
        self.odds = np.array(bits, np.float32).reshape(-1, SLOTS).T.copy()
        reach = np.array(reach)
        self.weight = reach / reach.sum() if len(reach) else reach
        self.scale = 4 / reach if len(reach) else reach

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(means, n): each text's mean odds for every bit, and its n-grams (0 for a text without letters); short texts are summed together."""
        totals, n = np.zeros((len(texts), self.odds.shape[1])), np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[int] = []
        size = 0

        def told() -> None:
            starts = np.cumsum([0, *map(len, held)])[:-1]
            for at, slots in _grams("".join(held)):
                whose = np.searchsorted(starts, at, "right") - 1
                first = np.flatnonzero(np.diff(whose, prepend=-1))
                if len(first):
                    own = np.array(owners)[whose[first]]
                    np.add.at(totals, own, np.add.reduceat(self.odds[slots], first, 0, np.float64))
                    np.add.at(n, own, np.diff(first, append=len(slots)))

        for k, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                for chunk in _chunks(text):
                    held.append(chunk)
                    owners.append(k)
                    size += len(chunk)
                    if size > CHUNK:
                        told()
                        held, owners, size = [], [], 0
        if held:
            told()
        return totals / np.maximum(n, 1)[:, None], n

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool, float]]:
        """(language or und, score from 0 to 1, ambiguous, difference of the two least losses) of each text."""
        means, n = self.scores(texts)
        out: list[tuple[str, float, bool, float]] = []
        for at in range(0, len(texts), 64):
            z = means[at : at + 64] * self.scale
            # each bit's loss for either sign, weighed, then summed over the codewords' signs
            plus, minus = np.logaddexp(0, -z) * self.weight, np.logaddexp(0, z) * self.weight
            losses = minus.sum(1)[:, None] + (plus - minus) @ (self.code > 0).T
            for loss, some in zip(losses, n[at : at + 64].tolist(), strict=True):
                if not some or not self.langs:
                    out.append(("und", 0.0, True, 0.0))
                elif len(self.langs) == 1:
                    out.append((self.langs[0], 1.0, False, float("inf")))
                else:
                    near = np.argsort(loss, kind="stable")[:2]
                    odds = np.exp(-(loss - loss.min()) * 8)
                    gap = float(loss[near[1]] - loss[near[0]])
                    out.append((self.langs[near[0]], float(odds[near[0]] / odds.sum()), gap < self.margin, gap))
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool, float]:
        return self.predict_all([text])[0]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000, doubtful: float = 0.001) -> Model:
    """The model of a bounded sample: the max_rows distinct (id, text, language) rows with the lowest hash of their id; every language in it is learned.

    Counts by language and slot stay a table; what reaches the driver is the names of languages, max_rows at most, and one
    row per slot and bit. The margin of ambiguity is such that of the sample's texts told rightly, the share doubtful is
    nearer to a second language; exact over the sample, so runs agree. Null texts and languages are left out; rows of one
    id with other texts are rows of their own, repeated ones count once; no labelled rows at all make a model that answers und.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.xxhash64(F.col(id_col)).alias("o"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    chosen = rows.select("i", "o", "h", "l").distinct().orderBy("o", "i", "h", "l").limit(max_rows)
    same = rows["i"].eqNullSafe(chosen["i"]) & (rows["h"] == chosen["h"]) & (rows["l"] == chosen["l"])
    sampled = rows.join(F.broadcast(chosen), same, "left_semi").dropDuplicates(["i", "h", "l"]).select("t", "l")  # max_rows rows are broadcast at most
    sampled = written(sampled, "sample")
    langs = sorted(r["l"] for r in sampled.select("l").distinct().collect())
    code = codewords(len(langs))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("l")["t"]:
                own = sums.get(lang, 0)
                for text in texts:
                    own = own + np.bincount(np.concatenate(list(ngram_slots(text))), minlength=SLOTS)
                sums[lang] = own
                if len(sums) > 100:
                    yield from told(sums)
        yield from told(sums)

    def told(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"l": lang, "s": at, "n": own[at]})
        sums.clear()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole shares of slots, of all languages (bit -1) and of those that have a bit."""
        sums = np.zeros((SLOTS, code.shape[1] + 1), np.int64)
        at = {lang: k for k, lang in enumerate(langs)}
        has = np.concatenate([np.ones((len(langs), 1), bool), code > 0], 1) if langs else np.zeros((0, 1), bool)
        for batch in batches:
            for lang, part in batch.groupby("l"):
                share = np.array([n * UNIT * 2 // (2 * total + SLOTS) for n, total in zip(part["n"].tolist(), part["total"].tolist(), strict=True)], np.int64)
                sums[part["s"].to_numpy()] += share[:, None] * has[at[lang]]
        s, b = np.nonzero(sums)
        yield pd.DataFrame({"s": s, "b": b, "v": sums[s, b]})

    counts = written(sampled.mapInPandas(count, "l string, s int, n long").groupBy("l", "s").agg(F.sum("n").alias("n")), "ngrams")
    totals = counts.groupBy("l").agg(F.sum("n").alias("total"))
    got = counts.join(F.broadcast(totals), "l").coalesce(8).mapInPandas(weigh, "s int, b int, v long").groupBy("s", "b").agg(F.sum("v").alias("v")).toPandas()
    known = {r["l"]: r["total"] for r in totals.collect()}
    base = np.array([1 / (2 * known.get(lang, 0) + SLOTS) for lang in langs])  # half an n-gram more in every slot
    sums = np.zeros((SLOTS, code.shape[1] + 1))
    sums[got["s"], got["b"]] = got["v"] / UNIT
    sums += np.concatenate([[base.sum()], base @ (code > 0)]) if langs else 0
    model = Model(langs, sums=sums)
    if len(langs) > 1:
        right = sampled.select("l", predict(F.col("t"), model).alias("p")).where("l = p.lang_pred")
        model.margin = right.agg(F.percentile("p.gap", F.lit(doubtful)).alias("m")).first()["m"] or model.margin
    return model


def predict(text: Column, model: Model) -> Column:
    """struct<lang_pred, score, ambiguous, gap> of each text."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean, gap double")
    def predicted(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict_all(s.tolist()), columns=["lang_pred", "score", "ambiguous", "gap"])

    return predicted(text)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for rows whose crc32 of the id as text leaves 0 by folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row; only rows not held out are learned from.

    Texts that are null or have no letter are und with score 0. One row per input row, whatever its id.
    """
    model = fit(docs.where(~held_out()), max_rows=max_rows)
    return docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")
