"""BPE over a lexicon transducer, against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marea.llm import lexicon as L

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "  x  \n\n y\t\tz ", "a" * 3000, "ab" * 5000, "\x1ca.\x1c b", "don't I'll 've 'D they're",
    "中文字符。Ünïcödé ԱՁ ՘࢏ᲊ x", "　a  b c\x85d", "\U0001f642\U0001f642 ퟿\U0010ffff é́", "x" * 70 + " " + "é" * 70, "a\r\nb\x0b\x0cc",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_transducer_is_minimal_and_spells_ids():
    words = {b"talk": (5,), b"talks": (6,), b"talking": (5, 9), b"walk": (7,), b"walks": (8,), b"walking": (7, 9), b"w": (1, 2, 3), b"king": (7, 9)}
    lexicon = L.Lexicon(L.compile_lexicon(list(words.items())))
    assert lexicon.lookup(list(words)) == [np.array(i, "<u4").tobytes() for i in words.values()]
    assert lexicon.lookup([b"", b"wal", b"walkin", b"talkings", b"zz", b"x" * 99]) == [None] * 6
    same = L.Lexicon(L.compile_lexicon([(a + b"xyz", (k,)) for k, a in enumerate((b"a", b"b", b"c"))]))
    assert len(same.of["final"]) == 5  # the root, and one chain for the suffix that all share
    assert L.Lexicon(L.compile_lexicon([])).lookup([b"a"]) == [None]


def test_random_lexicons_keep_every_word():
    rng = random.Random(3)
    for _ in range(40):
        made = {bytes(rng.choices(b"abc", k=rng.randrange(1, 7))): tuple(rng.choices(range(4), k=rng.randrange(1, 5))) for _ in range(60)}
        lexicon = L.Lexicon(L.compile_lexicon(list(made.items())))
        others = [bytes(rng.choices(b"abc", k=rng.randrange(1, 8))) for _ in range(60)]
        for w, got in zip([*made, *others], lexicon.lookup([*made, *others]), strict=True):
            assert got == (np.array(made[w], "<u4").tobytes() if w in made else None)


def test_encoder_equals_library_on_odd_texts_and_all_code_points(library):
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), 0x3000, 0x2003, 0x4E2D, 0x558, 0x1F600, 0x301, 0x5D0, 0x661]] + [" "] * 90 + ["\n"] * 30 + list("etaoin") * 20
    texts = [t for t in ODD if t is not None] + ["".join(rng.choices(pool, k=rng.randrange(1, 150))) for _ in range(1500)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}." for c in points[k : k + 64]) for k in range(0, len(points), 640)]
    encoder = L.Encoder(L.merges_of(PATH), public_tokenizers.PATTERN, None)
    for text, raw, want in zip(texts, encoder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == want.ids, text[:80]
        assert encoder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_round_trip_rows(spark, library):
    long = "word, other-word 12 " * 150_000  # 3 MB
    rows = [(k, t, "x") for k, t in enumerate([*ODD, long])] + [(3, "the same id", "x"), (None, "no id", "x"), (4, ODD[5], "x"), (4, ODD[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = L.round_trip(docs, PATH, public_tokenizers.PATTERN, max_words=3).collect()
    want = [(i, *expected(library, t)) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert L.round_trip(docs.where("false"), PATH, public_tokenizers.PATTERN).collect() == []
    nulls = docs.where("text is null")
    assert [r["n_tokens"] for r in L.round_trip(nulls, PATH, public_tokenizers.PATTERN).collect()] == [0]


def test_encode_and_decode_columns(spark):
    docs = spark.createDataFrame([("Hello world<|endoftext|>",), (None,)], "text string")
    name = L.build(docs.union(docs), PATH, public_tokenizers.PATTERN)
    got = docs.select(L.encode(F.col("text"), PATH, public_tokenizers.PATTERN, name).alias("ids")).select("ids", L.decode(F.col("ids"), PATH, public_tokenizers.PATTERN).alias("back")).collect()
    assert [r["back"] for r in got] == ["Hello world<|endoftext|>", ""] and got[0]["ids"][-1] == 50256 and list(got[1]["ids"]) == []


def test_query(spark, library):
    from marea.llm.queries import QUERIES

    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_lexicon"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: expected(library, r["text"]) for r in docs}
