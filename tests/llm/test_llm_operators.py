"""The ten operators on small fixtures with nulls, empty and long texts, ties and repeats, against brute force."""

import hashlib
import html as entities
import random
import re
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marea.llm import bpe, graph, html, jaccard, langid, linededup, media, packing, tokencount, topk, warc, words
from marea.llm.shared import filesystem, new_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
R = random.Random(7)
VOCAB = ["".join(R.choice("abcdeoirst") for _ in range(R.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + r.choice(["", "", ",", "."]) for _ in range(n))


BASE = prose(120, 1)
TEXTS = [None, "", "  \n ", "one two", "one two", "ONE\tTWO", "a b c d e", BASE, BASE, BASE.upper(), BASE + " tail", "x " + BASE, prose(118, 3), "é" * 3000, "don't  I'LL\n\nstop!! <|endoftext|> ñandú ßtraße 12345 \U0001f600", prose(9000, 4), " ".join(BASE.split()[:100]), "\x1c\x85 odd\x0bspace"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(TEXTS)] + [(7, BASE, None, 0), (None, BASE, None, 1), (None, None, "en", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").repartition(3).cache()


def no_rows(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_bpe_is_tiktoken_and_round_trips(spark, docs):
    import tiktoken

    ranks = bpe.load_ranks(RANKS)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(ranks)}, special_tokens={})
    rows = docs.select("*", bpe.encode(F.col("text"), RANKS, public_tokenizers.PATTERN).alias("ids")).withColumn("raw", bpe.decode(F.col("ids"), RANKS, public_tokenizers.PATTERN)).collect()
    for r in rows:
        assert list(r.ids) == t.encode_ordinary(r.text or "") and bytes(r.raw) == (r.text or "").encode()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())
    assert got == Counter((r.doc_id, len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()) for r in rows)
    assert bpe.round_trip(no_rows(spark, docs), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_keeps_patterns_apart(spark):
    one = spark.createDataFrame([("ab cd",)], "t string").repartition(1)
    n = [one.select(F.size(bpe.encode(F.col("t"), RANKS, p)).alias("n")).first().n for p in (r"\S+|\s+", r"[\s\S]")]
    assert n[1] == 5 and n[0] < 5
    long = spark.createDataFrame([(1, "word " * 100_000 + "x" * 3000)], "doc_id long, text string")
    r = bpe.round_trip(long, RANKS, public_tokenizers.PATTERN).first()
    assert r.decoded_sha256 == hashlib.sha256(("word " * 100_000 + "x" * 3000).encode()).hexdigest() and r.n_tokens > 100_000


def reference_ids(text, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = plain
    return t.encode(text or "", add_special_tokens=False).ids


def test_word_tokenizer_is_the_library():
    texts = [t or "" for t in TEXTS] + ["".join(R.choice("abcÉéß'.,! \n12AZ<|>endoftext-́") for _ in range(200)) for _ in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.word_tokenizer(WORDS)()(texts)] == [reference_ids(t) for t in texts]


@pytest.mark.parametrize("block", [500, 4_000_000])
def test_packing_covers_every_token_once(spark, docs, block):
    rows = packing.pack(docs, words.word_tokenizer(WORDS), block_tokens=block).collect()
    wanted = Counter()
    for r in docs.collect():
        wanted[r.doc_id, len(reference_ids(r.text)) + 1] += len(reference_ids(r.text)) + 1
    got = Counter()
    windows = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
        if r.doc_id not in (None, 7):
            ids = np.array(reference_ids(TEXTS[r.doc_id]) + [1], "<u4")
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert got == wanted
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(no_rows(spark, docs), words.word_tokenizer(WORDS)).count() == 0


def test_tightest_window_is_a_linear_scan():
    for seed in range(12):
        r = random.Random(seed)
        pieces = [(i, 0, r.choice((r.randint(1, 64), 7, 32, 64))) for i in range(400)]
        rooms, wanted = [], []
        for piece in sorted(pieces, key=lambda p: (-p[2], p[0])):
            fits = [(room, k) for k, room in enumerate(rooms) if room >= piece[2]]
            if not fits:
                fits = [(64, len(rooms))]
                rooms.append(64)
            rooms[min(fits)[1]] -= piece[2]
            wanted.append(min(fits)[0])
        got = []
        windows = packing.best_fit_decreasing(pieces, 64)
        assert len(windows) == len(rooms) and sorted(64 - sum(p[2] for p in w) for w in windows) == sorted(rooms)
        before = {}
        for w in windows:
            room = 64
            for p in w:
                before[p[0]], room = room, room - p[2]
        got = [before[p[0]] for p in sorted(pieces, key=lambda p: (-p[2], p[0]))]
        assert got == wanted  # each piece met the least room of all windows that could hold it


def test_best_fit_and_padding():
    r = random.Random(3)
    pieces = [(i, 0, 700 if i % 3 else r.randint(1, 2048)) for i in range(2000)]
    fitted = packing.best_fit_decreasing(pieces, 2048)
    assert Counter(p for w in fitted for p in w) == Counter(pieces) and all(sum(p[2] for p in w) <= 2048 for w in fitted)
    filled = packing.fill_gaps(fitted, 2048, 0.01)
    total = sum(p[2] for p in pieces)
    assert sum(p[2] for w in filled for p in w) == total and all(sum(p[2] for p in w) <= 2048 for w in filled)
    assert len(filled) * 2048 - total <= max(2048, 0.01 * total)


def brute_classes(rows):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    at = {i: i for i in ids}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((top(i), top(j)))
                at[y] = x
    out = Counter()
    for i, s in sets:
        same = [top(j) for j, t in sets if j is not None and t == s and s]
        out[i, len(s), top(i) if i is not None else min(same, default=None)] += 1
    return out


@pytest.mark.parametrize("part", [2000, 3])
def test_jaccard_is_brute_force(spark, docs, part):
    near = []
    for k in range(24):  # a family of near copies, not all near each other
        w = BASE.split()
        for x in random.Random(k).sample(range(len(w)), k % 5):
            w[x] = f"w{k}{x}"
        near.append((100 + k, " ".join(w), None, 0))
    both = docs.unionByName(spark.createDataFrame(near, docs.schema))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(both, log2=12, part=part).collect())
    assert got == brute_classes(both.collect())
    assert jaccard.classes(no_rows(spark, docs), log2=12).count() == 0


def test_jaccard_repeated_ids(spark):
    a, b = BASE, prose(60, 77)
    rows = [(3, b), (5, a), (5, b), (9, a), (11, "other"), (11, None), (12, None), (None, b), (None, prose(50, 78)), (13, "other"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id) for r in jaccard.classes(df, log2=12).collect())
    assert got == Counter([(3, 3), (5, 3), (5, 3), (9, 3), (11, 11), (11, 11), (12, 12), (None, 3), (None, None), (13, 11), (2, 2)])


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_jaccard_buckets_over_many_tasks(spark, parts):
    r = random.Random(parts)
    rows = [(k, r.choice((10, 12, 13, 40, 50, 5000)), 77) for k in range(300)] + [(k, r.randint(5, 60), r.randint(0, 30)) for k in range(300, 500)]
    got = {(x.g, x.doc) for x in jaccard._buckets(spark.createDataFrame(rows, "doc long, n int, member long"), parts).collect()}
    wanted, bucket, last = set(), [], None
    for member, n, doc in sorted((m, n, d) for d, n, m in rows) + [(None, 0, 0)]:
        if last and not (last[0] == member and 3 * n <= 4 * last[1]):
            wanted |= {(min(bucket), d) for d in bucket if d != min(bucket)}
            bucket = []
        last = member, n
        bucket.append(doc)
    assert got == wanted


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (40, 40), (50, 51), (51, 50)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 32: 30, 50: 50, 51: 50}


def test_langid(spark):
    letters = {"aa": "abcde", "bb": "fghij", "cc": "éèêëñ", "dd": "klmno"}
    rows = [(i, " ".join("".join(R.choice(letters[k]) for _ in range(5)) for _ in range(12)), k, 0) for i, k in enumerate(list(letters) * 30)]
    rows += [(1000, None, "aa", 0), (1001, "", "aa", 0), (1002, "123 !!", "bb", 0), (1003, "abc", None, 0), (None, "fgh fgh", "bb", 0), (1004, "abcde " * 40_000, "aa", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    for i, t, lang, _ in rows:
        assert got[i].held_out == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        if not t or i == 1002:
            assert got[i].lang_pred == "und" and got[i].score == 0
        elif lang:
            assert got[i].lang_pred == lang
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], df.schema)).count() == 0
    code = langid.codewords(9)
    assert code.shape[0] == 9 and len({tuple(c) for c in code}) == 9


def brute_slots(text):
    """Slots of the n-grams of a short text, one by one."""
    line, m32 = [32, *map(ord, re.sub(r"[\W\d_]+", " ", text.lower())), 32], 2**32 - 1
    one = [c * 0x9E3779B1 & m32 for c in line]
    two = [(one[k] ^ (line[k + 1] + 0x7F4A7C15 & m32)) * 0x85EBCA6B & m32 for k in range(len(line) - 1)]
    three = [(two[k] ^ (line[k + 2] + 0x1B873593 & m32)) * 0xC2B2AE35 & m32 for k in range(len(line) - 2)]
    own = [one[k] for k in range(len(line)) if line[k] != 32] + [two[k] for k in range(len(two)) if line[k : k + 2] != [32, 32]] + [three[k] for k in range(len(three)) if line[k + 1] != 32]
    return [x >> 17 for x in own]


@pytest.mark.parametrize("k", [2, 3, 5, 7])
def test_langid_decoding_is_brute_force(k):
    r = random.Random(k)
    vocab = [["".join(r.choice("abcdefghijklmnop"[j : j + 9]) for _ in range(r.randint(2, 7))) for _ in range(60)] for j in range(k)]
    counts = np.zeros((k, langid.SLOTS), np.int64)
    for j in range(k):
        for s in brute_slots(" ".join(r.choices(vocab[j], k=400))):
            counts[j, s] += 1
    model = langid.Model([f"l{j}" for j in range(k)], counts, margin=0.3)
    code = model.code
    assert len({tuple(c) for c in code}) == k and all(len(set(c)) == 2 for c in code.T)
    share = [[(x + 0.5) / (row.sum() + 0.5 * langid.SLOTS) for x in row.tolist()] for row in counts]
    right = 0
    for t in range(40):
        text = " ".join(r.choices(vocab[t % k], k=6) + (r.choices(vocab[(t + 1) % k], k=6) if t >= 30 else []))
        slots, loss = brute_slots(text), [0.0] * k
        assert Counter(slots) == Counter(x for part in langid.ngram_slots(text) for x in part.tolist())
        for b in range(code.shape[1]):
            plus, minus = ([j for j in range(k) if code[j, b] * sign > 0] for sign in (1, -1))
            odds = lambda s: np.log(sum(share[j][s] for j in plus) / len(plus)) - np.log(sum(share[j][s] for j in minus) / len(minus))  # noqa: B023, E731
            whole = np.log(np.mean([share[j] for j in plus], axis=0)) - np.log(np.mean([share[j] for j in minus], axis=0))
            middle = (np.mean([np.dot(share[j], whole) for j in plus]) + np.mean([np.dot(share[j], whole) for j in minus])) / 2
            score = sum(odds(s) - middle for s in slots) / len(slots)
            for j in range(k):
                loss[j] += model.weight[b] * np.log1p(np.exp(-code[j, b] * score * model.scale[b]))
        lang, told, ambiguous, gap = model.predict(text)
        order = sorted(range(k), key=lambda j: loss[j])  # noqa: B023
        assert lang == f"l{order[0]}" and abs(gap - (loss[order[1]] - loss[order[0]])) < 1e-3 and ambiguous == (gap < 0.3)
        assert abs(told - 1 / sum(np.exp(-8 * (x - min(loss))) for x in loss)) < 1e-3
        right += lang == f"l{t % k}"
    assert right > 30 and abs(model.weight.sum() - 1) < 1e-9


def test_langid_margin_and_bound(spark):
    r = random.Random(9)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    text = lambda k, n=30: " ".join("".join(r.choice(letters[k]) for _ in range(5)) for _ in range(n))
    rows = [(i, text(k), k) for i, k in enumerate(list(letters) * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.margin > 0.02
    mixed = [model.predict(text("aa", 15) + " " + text("cc", 15)) for _ in range(40)]
    clean = [model.predict(text(k)) for k in letters for _ in range(40)]
    assert sum(x[2] for x in mixed) > 20 and sum(x[2] for x in clean) <= 2
    assert langid.fit(df, max_rows=1).langs[0] in letters
    same = spark.createDataFrame([(None, text("aa"), "aa")] * 50 + [(1, text("bb"), "bb") for _ in range(30)], df.schema)  # repeated and null ids: rows count, repeated ones once
    assert langid.fit(same, max_rows=2).langs == ["aa", "bb"] or langid.fit(same, max_rows=2).langs == ["bb"]
    got = langid.fit(df, max_rows=1).predict(text("aa"))
    assert got[1:3] == (1.0, False)


def test_langid_learns_every_language(spark):
    r = random.Random(11)
    vocab = {f"l{k:03d}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäöüéßñ", k=r.randint(3, 8))) for _ in range(25)] for k in range(600)}
    rows = [(i, " ".join(r.choices(vocab[k], k=60)), k) for i, k in enumerate(list(vocab) * 4)] + [(99_999, " ".join(r.choices(vocab["l000"], k=60)), "l000")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted(vocab)
    told = model.predict_all([" ".join(r.choices(vocab[k], k=60)) for k in vocab])
    assert sum(a == k for (a, *_), k in zip(told, vocab, strict=True)) > 590


def test_langid_long_texts_are_scored_whole(monkeypatch):
    r = random.Random(12)
    text = " ".join("".join(r.choices("abcdé1 ", k=r.randint(1, 9))) for _ in range(2000)) + "z" * 500
    whole = Counter(brute_slots(text))
    for size in (7, 64, 1000):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert Counter(x for part in langid.ngram_slots(text) for x in part.tolist()) == whole
    counts = np.random.default_rng(1).integers(0, 9, (3, langid.SLOTS))
    model = langid.Model(["a", "b", "c"], counts)
    some = [text, None, "", "12 !", "abc", text[:100], "é"]
    for size in (64, 1 << 16):
        monkeypatch.setattr(langid, "CHUNK", size)
        means, n = model.scores(some)
        for k, t in enumerate(some):
            slots = brute_slots(t or "") if t and any(map(str.isalpha, t)) else []
            assert n[k] == len(slots) and np.allclose(means[k], model.odds[slots].mean(0) if slots else 0, atol=1e-4)


def test_topk_is_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.25, 0.125]) for _ in range(4)]) for i in range(160)] + [(161, None), (162, [1.0, None, 0.0, 1.0]), (150, [0.1, 0.2, 0.3, 0.4]), (163, [1.0, float("nan"), 0.0, 0.0]), (164, [2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (200, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0, shard=16, tile=2).collect())
    good = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for q in {i for i, _ in good if i % 50 == 0}:
        vq = min(v for i, v in good if i == q)
        best = sorted(((-sum(a * b for a, b in zip(vq, v, strict=True)), i) for i, v in good if i != q and len(v) == len(vq)))[:5]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(wanted)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_media_round_trip(spark, docs):
    rows = media.text_media(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    for r in rows:
        if r.doc_id is None:
            continue
        raw = (TEXTS[r.doc_id] or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        seen = Counter(full)
        mode = max(range(256), key=lambda b: (seen[b], -b))
        assert r.feature == f"rows={len(full) // 64};sum={sum(full)};squares={sum(b * b for b in full)};zeros={seen[0]};mode={mode};distinct={len(seen)}"
        assert r.height * 64 == r.payload_bytes and r.media_sha256 == r.digest and r.media_bytes == r.length
    with tarfile.open(filesystem(rows[0].shard)[1]) as t:
        assert all(hashlib.sha256(t.extractfile(m).read()).hexdigest() == m.name for m in t)
    assert media.text_media(no_rows(spark, docs)).count() == 0


def test_line_dedup(spark):
    passage = prose(60, 11)
    a = "\n".join(f"line {k} {VOCAB[k]}" for k in range(40))
    rows = [(1, a, 0), (2, "new start\n" + a + "\nnew end", 0), (3, f"before\n{passage}\nafter", 0), (4, f"other\n{passage}\nwords", 0), (5, None, 0), (6, "", 0), (7, "Les.", 0), (8, "Les.", 0), (9, a, 0), (9, a, 0), (None, a, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines_total long").repartition(3)
    got = defaultdict(list)
    for r in linededup.dedup_lines(df, min_words=50).collect():
        got[r.doc_id].append(r)
    text = {k: v[0].text for k, v in got.items()}
    assert sum(map(len, got.values())) == len(rows)
    assert text[1] == a and text[None] == a and text[5] is None and text[6] == "" and text[7] == text[8] == "Les."
    assert text[2].startswith("new start") and text[2].endswith("new end") and len(text[2]) < 0.4 * len(a)  # cuts find each other again
    assert passage in text[3] and text[4] == "other\nwords"
    assert [r.lines_removed for r in got[9]] == [got[9][0].lines_removed] * 2 and got[9][0].lines_removed >= 36
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def lines_left(texts, min_words=50):
    """Brute force of dedup_lines on texts in order of their ids, without blank lines."""
    first, out = {}, []
    for doc, lines in enumerate(t.split("\n") for t in texts):
        long = [len(a.encode().split()) >= min_words for a in lines]
        gone = set()
        for k in range(len(lines)):
            for end in [k + 1] * long[k] + [k + 2] * (k + 1 < len(lines) and not all(long[k : k + 2])):
                seen, until = first.setdefault(tuple(lines[k:end]), (doc, end))
                gone.update(range(max(k, until) if seen == doc else k, end))
        out.append("\n".join(a for k, a in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("lines, words", [(5, 12), (6, 15), (8, 10), (10, 20), (2, 12)])
def test_line_dedup_of_passages(spark, lines, words):
    texts = []
    for trial in range(40):  # a passage of short lines, pasted among the lines of two documents
        passage = [prose(words, (trial, k, lines).__repr__()) for k in range(lines)]
        for copy in range(2):
            host = [prose(12, (trial, k, copy).__repr__()) for k in range(6 + copy)]
            texts.append("\n".join(host[:3] + passage + host[3:]))
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        assert got[k].lines_removed == lines * (k % 2)
        assert got[k].text == ("\n".join(t.split("\n")[:3] + t.split("\n")[3 + lines :]) if k % 2 else t)


@pytest.mark.parametrize("window", [2, 3])
def test_line_dedup_by_boundaries(spark, window):
    texts = []
    for trial in range(30):
        passage = [prose(12, (trial, k, window).__repr__()) for k in range(24)]
        for copy in range(2):
            host = [prose(12, (trial, k, copy, window).__repr__()) for k in range(6 + copy)]
            texts.append("\n".join(host[:3] + passage + host[3:]))
    left = [linededup.chunks(t, None, window) for t in texts]
    assert sum(map(len, left)) < sum(len(linededup.chunks(t)) for t in texts) / window
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=window).collect()}
    for k, t in enumerate(texts):
        if k % 2:
            gone = set(t.split("\n")) - set(got[k].text.split("\n"))
            assert gone <= set(texts[k - 1].split("\n")) and got[k].lines_removed == len(gone) > 5  # inner chunks only
        else:
            assert got[k].text == t


def test_line_dedup_is_brute_force(spark):
    r = random.Random(3)
    pool = [prose(r.choice([3, 9, 20, 55]), 900 + k) for k in range(30)]
    texts = []
    for k in range(120):
        lines = r.choice(texts).split("\n")[r.randint(0, 2) :] if texts and r.random() < 0.5 else r.sample(pool, r.randint(1, 9))
        texts.append("\n".join(lines + ([prose(8, 5000 + k)] if r.random() < 0.5 else [])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.text for x in linededup.dedup_lines(df, min_words=50).collect()}
    assert [got[k] for k in range(len(texts))] == lines_left(texts)
    got = {x.doc_id: x.text for x in linededup.dedup_lines(df).collect()}
    assert [got[k] for k in range(len(texts))] == lines_left(texts, 10**9)
    odd = ["x\nx\nx\nx", "a\n\nb\n", "new\na\n\nb\nmore", "a\nb"]
    got = {x.doc_id: x.text for x in linededup.dedup_lines(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    assert got == {0: "x\nx", 1: odd[1], 2: "new\nmore", 3: odd[3]}


def test_line_dedup_names_and_hot_chunks(spark):
    a = "first line here\nsecond line here"
    rows = [(k, f"{a}\nown {k}", k, "x", "y") for k in range(2500)] + [(9000, "long\n" * 200_000, 0, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone int, Likely string, `a.b` string").repartition(3)
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "lines_removed", "lines_total"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == rows[0][1] and all(got[k].text == f"own {k}" and got[k]["__gone"] == k for k in range(1, 2500))
    assert got[9000].text == "long\nlong\n" and got[9000].lines_removed == 199_998


def test_warc(spark):
    page = "<p>" + "x" * 200
    rows = [(1, "http://A.com/b", page), (2, "http://a.com/b", page), (3, None, page), (4, "https://b.org:80/?q=1", "short"), (5, "u\r\nWARC-Type: revisit", "short"), (6, "", None), (0, "http://c.net", page), (None, "http://a.com", page), (2, "http://a.com/b", page), (2, "http://a.com/c", "é" * 500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.archive(df).collect()
    wanted = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = 0 if h == page and i else None
        wanted[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first is not None else "response", first] += 1
    assert Counter(tuple(r[:5]) for r in got) == wanted
    merged = warc.merge_runs(warc.captures(warc.write_archives(df, new_dir(spark, "t"))))
    placed = merged.select("_metadata.file_name", "_metadata.row_index", "url_key", "timestamp").collect()
    history = [tuple(r)[2:] for r in sorted(placed)]
    assert history == sorted(history) and len(history) == len(rows)
    assert warc.archive(df.limit(0)).count() == 0


def test_loser_tree():
    for k in range(9):
        runs = [sorted((random.Random(i * 9 + k).randint(0, 9), i, j) for j in range(i)) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("block", [64, 4 << 20])
def test_token_counts(spark, docs, block):
    got = Counter((r.doc_id, r.n_tokens) for r in tokencount.token_counts(docs, words.plain_word_tokenizer(WORDS), 49_407, block).collect())
    assert got == Counter((r.doc_id, len(reference_ids(r.text, True))) for r in docs.collect())
    assert tokencount.token_counts(no_rows(spark, docs), words.plain_word_tokenizer(WORDS), 49_407).count() == 0


def test_html(spark):
    boiler = "Sign in to read all of our stories every single day"
    rows = [
        (1, "http://h.com/1", "<html><body><nav><a>Menu</a></nav><article><h1>T &amp; t</h1><p>One<b>two\n  three<br>four<p>Five<div class='comments'><p>me too</div><aside>ad</aside></article><footer>f</footer>"),
        (2, "http://h.com/2", f"<body><div><p>{boiler}</p><p>Unique words of the second page here</p></div><div class=ad>buy</div>"),
        (3, "http://h.com/3", f"<body><div><p>{boiler}</p><p>Other words that only page three has</p></div>"),
        (4, "http://else.org", f"<p>{boiler}</p><script>var t='</p>'</script><p>x < y &lt; z"),
        (5, None, None),
        (6, "", ""),
        (2, "http://h.com/2", "<main><p>Main text</main><p>out"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter((r.page_id, r.text, r.n_chars) for r in html.main_text(df).collect())
    texts = [(1, "T & t\n\nOnetwo three four\n\nFive"), (2, "Unique words of the second page here"), (3, "Other words that only page three has"), (4, f"{boiler}\n\nx < y < z"), (5, ""), (6, ""), (2, "Main text")]
    assert got == Counter((i, t, len(t)) for i, t in texts)
    assert html.main_text(df.limit(0)).count() == 0
    assert entities.unescape("&amp;") == "&"
