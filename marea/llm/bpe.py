"""Byte-level BPE over a rank vocabulary, run by a sentencepiece model that is serialised from it.

The model has one piece for each ranked byte string, in rank order, so that piece numbers are ranks. Bytes are mapped
one to one to visible characters; a piece's score is its negative rank, so sentencepiece merges the adjacent pair of
lowest rank first, leftmost on ties. Normalisation is the identity. Pre-tokens (matches of a pattern) are encoded
separately; one that is itself in the vocabulary is that single id. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens a task remembers; the memo is emptied beyond that, which changes no result.
MEMO = 300_000


def load_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64, space, rank), by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


@lru_cache(None)
def byte_chars() -> str:
    """256 distinct visible characters, one per byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    spare = iter(range(256, 512))
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    out = b""
    n &= (1 << 64) - 1
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(no: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(no << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(no << 3) + _varint(value)
    return _varint(no << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece BPE model of a rank vocabulary; its last piece, the unknown one, is never used if all bytes have ranks."""
    if missing := [b for b in range(256) if bytes([b]) not in set(tokens)]:
        raise ValueError(f"{len(missing)} single bytes have no rank")
    chars = byte_chars()
    # Fixed values of the public model format: pieces = 1 (piece 1, score 2, type 3: normal 1, unknown 2), trainer = 2, normaliser = 3.
    pieces = b"".join(
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1))
        for rank, token in enumerate(tokens)
    )
    unknown = _field(1, _field(1, "⁇unknown".encode()) + _field(2, -float(len(tokens))) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary in one Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.map = dict(enumerate(byte_chars()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.memo: dict[str, tuple[int, ...]] = {}

    def piece(self, pretoken: str) -> tuple[int, ...]:
        raw = pretoken.encode()
        one = self.whole.get(raw)
        return (one,) if one is not None else tuple(self.model.encode(raw.decode("latin-1").translate(self.map)))

    def encode(self, text: str) -> list[int]:
        words, memo = self.split(text), self.memo
        try:
            return list(chain.from_iterable(map(memo.__getitem__, words)))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in set(words):
                if w not in memo:
                    memo[w] = self.piece(w)
            return list(chain.from_iterable(map(memo.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a vocabulary file and a pattern, built once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids; null counts as the empty text. path is read on every executor."""

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return s.map(lambda t: c.encode(t or ""))

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes of ids; null counts as no ids, an id outside the vocabulary is an error."""

    @F.pandas_udf("binary")
    def raw(s: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return s.map(lambda x: c.decode([] if x is None else list(x)))

    return raw(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids.

    Null text is the empty one (no ids). Every input row gives one row, repeated ids included; other columns are not
    carried. One narrow stage: no shuffle, and ids never leave the task that made them.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(s: pd.Series) -> pd.DataFrame:
        c = codec(path, pattern)
        names = list(map(str, range(len(c.tokens))))
        rows = []
        for text in s:
            ids = c.encode(text or "")
            rows.append((len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = docs.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col)).alias("d"))
    return made.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
