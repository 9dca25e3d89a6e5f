"""BPE over a lexicon: a minimal acyclic transducer spells the ids of frequent words, unseen words are merged exactly.

Words are pre-tokens. All documents are counted; the most frequent words (`max_words`, a bound on the lexicon that changes
no result) are compiled with their ids into an automaton whose states are shared by equal suffixes and whose arcs carry
ids: what all continuations of a prefix have in common stands as early as it can, so that suffixes without ids of their
own are shared among words. The automaton is one file of flat arrays; Spark hands it to every executor
(`SparkContext.addFile`), where all workers map the same pages. Many words walk it at once, a byte a step. A word that it
doesn't hold is merged by the ranks of its adjacent pairs, the lowest first and leftmost on ties.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars
from .shared import dropped, filesystem, new_dir, released, written

#: Words of a lexicon, at most, and distinct units (white space and what follows it) a worker remembers or counts before it starts anew.
MAX_WORDS, MEMO = 60_000, 700_000
#: Units of more characters are not remembered.
LONG = 64
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A pre-token never holds white space after anything else, so a text may be cut before white space that follows something.
_UNITS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
#: Below this code point the pattern's classes are the same in every Unicode version; units beyond are cut by the library's own.
_SETTLED = "\u0530"
_TAIL = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
_NO_RANK = 1 << 30


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file image of the minimal transducer of (word, ids), words distinct and not empty, in any order.

    Words are added in byte order. The states of the last word's path are still open; those beyond the prefix it shares
    with the next are closed, which replaces each by a known state of the same arcs, ids and finality, if there is one.
    """
    known: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    finals: list[tuple[int, ...] | None] = []

    def close(state: list) -> int:
        form = (state[1], tuple(map(tuple, state[0])))
        if form not in known:
            known[form] = len(finals)
            finals.append(state[1])
            arcs_of.append(form[1])
        return known[form]

    path, before = [[[], None]], b""  # of each open state: arcs [byte, target, ids], and the ids that end a word there
    for word, ids in sorted(entries):
        shared = 0
        while shared < len(before) and shared < len(word) and before[shared] == word[shared]:
            shared += 1
        while len(path) > shared + 1:
            closed = close(path.pop())
            path[-1][0][-1][1] = closed
        for at in range(shared):
            arc = path[at][0][-1]
            same = 0
            while same < len(arc[2]) and same < len(ids) and arc[2][same] == ids[same]:
                same += 1
            if rest := arc[2][same:]:  # what the words don't share moves behind the arc
                below = path[at + 1]
                for onward in below[0]:
                    onward[2] = rest + onward[2]
                if below[1] is not None:
                    below[1] = rest + below[1]
                arc[2] = arc[2][:same]
            ids = ids[same:]
        for byte in word[shared:]:
            path[-1][0].append([byte, None, ids])
            path.append([[], None])
            ids = ()
        path[-1][1] = ids
        before = word
    while len(path) > 1:
        closed = close(path.pop())
        path[-1][0][-1][1] = closed
    root = close(path.pop())
    spelled: dict[tuple[int, ...], int] = {(): 0}
    ref = lambda ids: spelled.setdefault(ids, len(spelled))
    rows = [(s << 8 | byte, target, ref(ids)) for s, arcs in enumerate(arcs_of) for byte, target, ids in arcs]
    arrays = {f"arc_{n}": np.array([r[k] for r in rows], "<u4") for k, n in enumerate(("key", "to", "ids"))}
    arrays["final"] = np.array([-1 if f is None else ref(f) for f in finals], "<i4")
    arrays["starts"] = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype("<u4")
    arrays["ids"] = np.array([i for x in spelled for i in x], "<u4")
    head = json.dumps({"root": root, "longest": max(map(len, (w for w, _ in entries)), default=0), "arrays": {k: [v.dtype.str, len(v)] for k, v in arrays.items()}}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(v.tobytes() + b"\0" * (-v.nbytes % 8) for v in arrays.values())


class Lexicon:
    """A compiled lexicon over a buffer, usually a mapped file."""

    def __init__(self, image):
        view = memoryview(image)
        at = 8 + int.from_bytes(view[:8], "little")
        head = json.loads(bytes(view[8:at]))
        self.root, self.longest, self.of = head["root"], head["longest"], {}
        for name, (kind, n) in head["arrays"].items():
            self.of[name] = np.frombuffer(view, kind, n, at)
            at += self.of[name].nbytes + -self.of[name].nbytes % 8

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        """Of each word its ids as little-endian 32-bit numbers, or None where the lexicon doesn't hold it."""
        key, to, said, final = (self.of[k] for k in ("arc_key", "arc_to", "arc_ids", "final"))
        out: list[bytes | None] = [None] * len(words)
        lengths = np.array(list(map(len, words)), np.int64)
        raw, begins = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        state, live = np.full(len(words), self.root, np.int64), np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        met = [(np.zeros(0, np.int64),) * 2]
        ended = [np.zeros(0, np.int64)]
        for step in range(self.longest if len(key) else 0):
            if not len(live):
                break
            want = state[live] << 8 | raw[begins[live] + step]
            arc = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[arc] == want
            live, arc = live[hit], arc[hit]
            state[live] = to[arc]
            met.append((live[said[arc] > 0], said[arc][said[arc] > 0].astype(np.int64)))
            done = lengths[live] == step + 1
            ended.append(live[done])
            live = live[~done]
        for w in np.concatenate(ended).tolist():
            if final[state[w]] >= 0:
                out[w] = b""
        met.append((at := np.concatenate(ended), np.maximum(final[state[at]], 0).astype(np.int64)))
        pool, starts = self.of["ids"].tobytes(), self.of["starts"].tolist()
        for at, refs in met:  # in the order of the steps
            for w, r in zip(at.tolist(), refs.tolist(), strict=True):
                if out[w] is not None and r:
                    out[w] += pool[4 * starts[r] : 4 * starts[r + 1]]
        return out


class Merges:
    """Pieces and ranked merges of a byte-level BPE tokenizer file; what its results depend on and this module doesn't know is refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += ["normalizer"] * bool(spec["normalizer"]) + [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t[k]]
        if odd or model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE file: {odd or [model['type'], before]}")
        chars, vocabulary = byte_chars(), model["vocab"]
        byte_of = {c: b for b, c in enumerate(chars)}
        spell = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.bytes_of = {c: bytes([b]) for c, b in byte_of.items()}
        self.pieces = {i: spell(t) for t, i in vocabulary.items()} | {t["id"]: spell(t["content"]) for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.single = [vocabulary.get(c) for c in chars]
        if None in self.single:
            raise ValueError("single bytes without an id")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(vocabulary[a], vocabulary[b]): (k, vocabulary[a + b]) for k, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair, self.rank_of_pair = keys[order], np.array([r for r, _ in self.rank.values()], np.int32)[order]
        self.made = np.zeros(len(pairs) + 1, np.int32)
        self.made[[r for r, _ in self.rank.values()]] = [i for _, i in self.rank.values()]
        self.spell_pieces = Spelling([self.pieces.get(i, b"") for i in range(max(self.pieces) + 1)])
        self.spell_numbers = Spelling([b"%d," % i for i in range(max(self.pieces) + 1)])

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens as little-endian 32-bit numbers: short ones many at once, each of them by one merge a round."""
        out = [b""] * len(words)
        short = sorted((k for k, w in enumerate(words) if 0 < len(w) <= LONG), key=lambda k: len(words[k]))
        for at in range(0, len(short), 4096):
            self._merge_together([words[k] for k in short[at : at + 4096]], short[at : at + 4096], out)
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = np.array(self._merge_long([self.single[b] for b in w]), "<u4").tobytes()
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pair):
            return np.full(left.shape, _NO_RANK, np.int32)
        key = left.astype(np.int64) << 32 | right  # that of a place beyond the word, -1, is negative and met nowhere
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank_of_pair[at], np.int32(_NO_RANK))

    def _merge_together(self, words: list[bytes], names: list[int], out: list[bytes]) -> None:
        lengths, name = np.array(list(map(len, words))), np.array(names)
        ids = np.full((len(words), int(lengths.max()) + 1), -1, np.int32)
        ids[np.arange(ids.shape[1]) < lengths[:, None]] = np.array(self.single, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = rank.argmin(1)  # the first of the least
            least = rank[np.arange(len(ids)), at]
            if (done := least == _NO_RANK).any():
                rows = ids[done]
                held = rows >= 0
                raw, ends = rows[held].astype("<i4").tobytes(), (4 * np.cumsum(held.sum(1))).tolist()
                for k, a, z in zip(name[done].tolist(), [0, *ends], ends, strict=False):
                    out[k] = raw[a:z]
                ids, rank, at, least, name = ids[~done], rank[~done], at[~done], least[~done], name[~done]
                if not len(ids):
                    break
            row, n = np.arange(len(ids)), ids.shape[1]
            cols = np.arange(n, dtype=at.dtype)
            ids = ids[cols != at[:, None] + 1].reshape(len(row), n - 1)  # the right part goes, the left one is the merged
            ids[row, at] = self.made[least]
            rank = rank[cols[:-1] != at[:, None]].reshape(len(row), n - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            rank[before, at[before] - 1] = self._ranks(ids[before, at[before] - 1], ids[before, at[before]])
            rank[after, at[after]] = self._ranks(ids[after, at[after]], ids[after, at[after] + 1])

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """As merge, by a heap of pairs over a linked list: n log n."""
        n, rank = len(ids), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[p][0], k, rank[p][1], p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, at, new, pair = heapq.heappop(heap)
            to = right[at]
            if ids[at] != pair[0] or to >= n or ids[to] != pair[1]:
                continue  # one of the two has been merged since
            ids[at], ids[to], right[at] = new, -1, right[to]
            if right[to] < n:
                left[right[to]] = at
            for a, b in ((left[at], at), (at, right[at])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in rank:
                    heapq.heappush(heap, (rank[p][0], a, rank[p][1], p))
        return tuple(i for i in ids if i >= 0)


class Spelling:
    """Byte strings by number; many are joined in one gather."""

    def __init__(self, strings: list[bytes]):
        self.pool, self.length = np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings)), np.int64)
        self.start = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        return self.pool[np.repeat(self.start[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()


class Encoder:
    """Encoder and decoder of one tokenizer file and pattern in one Python worker; lexicon may be None."""

    def __init__(self, merges: Merges, pattern: str, lexicon: Lexicon | None):
        import regex
        from tokenizers import pre_tokenizers

        self.merges, self.lexicon, self.memo = merges, lexicon, {}
        self.split, self.library = regex.compile(pattern).findall, pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(merges.added, key=len, reverse=True))) + ")").split if merges.added else None

    def pretokens(self, unit: str) -> list[bytes]:
        head = unit[1:] if unit[0] == " " else unit
        stem = head.rstrip(_TAIL)
        if stem.isalpha() and (stem.isascii() or max(stem) < _SETTLED):  # a word, perhaps with a run of punctuation
            cut = len(unit) - len(head) + len(stem)
            return [unit.encode()] if cut == len(unit) else [unit[:cut].encode(), unit[cut:].encode()]
        if max(unit) < _SETTLED:
            return [w.encode() for w in self.split(unit)]
        of = self.merges.bytes_of
        return [b"".join(map(of.__getitem__, w)) for w, _ in self.library.pre_tokenize_str(unit)]

    def units(self, text: str) -> list[str]:
        """The units of a text; strings of added tokens are units of their own."""
        parts = self.at_added(text) if self.at_added else [text]
        return _UNITS(text) if len(parts) == 1 else [u for k, part in enumerate(parts) for u in ([part] if k % 2 else _UNITS(part))]

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of new units; the short ones are remembered."""
        if not units:
            return {}
        split = {u: self.pretokens(u) for u in units}
        words = list({w for ws in split.values() for w in ws})
        known = dict(zip(words, self.lexicon.lookup(words) if self.lexicon else [None] * len(words), strict=True))
        unseen = [w for w, ids in known.items() if ids is None]
        known.update(zip(unseen, self.merges.merge(unseen), strict=True))
        made = {u: known[ws[0]] if len(ws) == 1 else b"".join(map(known.__getitem__, ws)) for u, ws in split.items()}
        self.memo.update((u, ids) for u, ids in made.items() if len(u) <= LONG)
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian 32-bit numbers."""
        out, added = [], {t: np.array([i], "<u4").tobytes() for t, i in self.merges.added.items()}
        for at in range(0, len(texts), 128):
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo.update(added)
            split = [self.units(t) for t in texts[at : at + 128]]
            known = [list(map(self.memo.get, units)) for units in split]
            some = [None in ids for ids in known]
            made = self._learn(list({u for units, ids, new in zip(split, known, some, strict=True) if new for u, x in zip(units, ids, strict=True) if x is None}))
            for units, ids, new in zip(split, known, some, strict=True):
                out.append(b"".join([made[u] if x is None else x for u, x in zip(units, ids, strict=True)] if new else ids))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.merges.spell_pieces.join(ids).decode("utf-8", "replace")


_MERGES: dict[str, Merges] = {}
_ENCODERS: dict[tuple, Encoder] = {}


def merges_of(path: str) -> Merges:
    if path not in _MERGES:
        _MERGES[path] = Merges(path)
    return _MERGES[path]


def encoder(path: str, pattern: str, lexicon: str | None) -> Encoder:
    """The worker's encoder of a tokenizer file, a pattern and a lexicon file handed out by name; made once, the last one is kept."""
    if (path, pattern, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, pattern, lexicon] = Encoder(merges_of(path), pattern, Lexicon.mapped(SparkFiles.get(lexicon)) if lexicon else None)
    return _ENCODERS[path, pattern, lexicon]


def word_counts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """word binary, n long: how often each pre-token occurs in all texts. Tasks count by unit and give what they hold once it is much."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(merges_of(path), pattern, None)
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            words: Counter = Counter()
            for unit, n in held.items():
                for w in own.pretokens(unit) if unit not in own.merges.added else ():
                    words[w] += n
            return pa.record_batch([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.update(own.units(text))
                if len(held) > MEMO:
                    yield told()
                    held.clear()
        if held:
            yield told()
        held.clear()
        released()

    return docs.select(F.col(text_col)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, path: str, pattern: str, text_col: str = "text", max_words: int = MAX_WORDS) -> str:
    """Compiles the lexicon of a corpus into the shared folder and hands it out; returns the name executors know it by.

    The driver holds max_words words at most: classes of near counts go in whole, the most frequent first, while they fit.
    Words that occur once are left out.
    """
    spark, merges = docs.sparkSession, merges_of(path)
    counted = written(word_counts(docs, path, pattern, text_col).where("n > 1").withColumn("often", F.floor(F.log2("n") * 64).cast("int")), "words")
    kept, least = 0, None
    for r in counted.groupBy("often").count().orderBy(F.desc("often")).collect():  # 64 rows an octave
        kept += r["count"]
        if kept > max_words:
            break
        least = r["often"]
    words = [bytes(r["word"]) for r in counted.where(F.col("often") >= least).select("word").collect()] if least is not None else []
    dropped(counted)
    image = compile_lexicon([(w, tuple(np.frombuffer(ids, "<u4").tolist())) for w, ids in zip(words, merges.merge(words), strict=True)])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = new_dir(spark, "lexicon")
    store, at = filesystem(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/{name}") as f:
        f.write(image)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode(text: Column, path: str, pattern: str, lexicon: str | None) -> Column:
    """array<int> of token ids; null counts as the empty text. path is read on every executor."""

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        made = encoder(path, pattern, lexicon).encode([t or "" for t in s])
        return pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for x in made], dtype=object)

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The text of ids, special tokens spelled out, bytes that are no UTF-8 replaced; null counts as no ids."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        own = encoder(path, pattern, None)
        return s.map(lambda x: own.decode(np.asarray([] if x is None else x, np.int64)))

    return text(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded over the corpus's own lexicon, then decoded from the ids.

    Null text is the empty one (no ids, the empty text's digests). Every row gives one row, repeated and null ids included;
    other columns are not carried; an empty table gives no rows. Only word counts are shuffled.
    """
    lexicon = build(docs, path, pattern, text_col, max_words)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, lexicon)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows = batch.slice(at, 128), []
                for raw in own.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids = np.frombuffer(raw, "<u4")
                    rows.append((len(ids), sha(own.merges.spell_numbers.join(ids)[:-1]), sha(own.decode(ids).encode())))
                n, spelled, decoded = zip(*rows, strict=True)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        released()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
