"""Whole-text ids of a word-level BPE tokenizer file, with a memo of the words a worker has met."""

from __future__ import annotations

import numpy as np

#: Bytes of a generation of a worker's memo, about; of the one before, words met again are carried over. No result depends on it.
MEMO = 64 << 20
#: What a word takes beside its own bytes and those of its ids: two byte strings and an entry of a table.
_ENTRY = 180

#: Punctuation that, after a word and before white space, is a token run of its own; no quote and nothing that begins a special token.
_TAIL = b'!"#$%&()*+,-./:;=?@[]^_`{}~'


def _is_word(w: str) -> bool:
    """Letters only that normalisation keeps letters: one pre-token, in any company of white space."""
    return w.isalpha() and max(w) < "\u0250" and "\u0130" not in w


class WordTokenizer:
    """encode(texts) gives, per text, what tokenizers gives for it without special tokens, as little-endian 32-bit ids.

    Only for tokenizers that drop white space, lower-case, and mark the ends of words (word_bpe_49k.json): there, words
    between ASCII white space are encoded independently, so each distinct one is encoded once a worker. Plain words are
    encoded many at a time and told apart by their last pieces; punctuation after one is a run of its own.
    Texts are ASCII-lowered beforehand only where all of the text is ASCII and no special token can arise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.bytes = 0

    def forget(self) -> None:
        """Drops all words: called as a task ends, since a worker goes on to other work."""
        self.memo, self.before, self.bytes = {}, {}, 0

    def _learn(self, words: set[bytes], split: list[list[bytes]]) -> None:
        """Puts new words, and after a change of generation all words of split, into the memo."""
        if (size := self.bytes + _ENTRY * len(self.memo)) > MEMO:
            self.memo, self.before, self.bytes = {}, self.memo, 0
            words = set().union(*split)
        elif size > MEMO // 2:
            self.before = {}
        memo, stems, plain, tails, other = self.memo, [], set(), set(), []
        for w in [w for w in words if w in self.before]:
            memo[w] = self.before[w]
        for w in words.difference(memo):
            stem = w.rstrip(_TAIL)
            if stem.isalpha() or (stem and not stem.isascii() and _is_word(stem.decode())):
                plain.add(stem)
                if len(stem) < len(w):
                    tails.add(w[len(stem) :])
                    stems.append((w, stem, w[len(stem) :]))
            else:
                other.append(w.decode())
        plain = plain.difference(memo)
        other += [t.decode() for t in tails.difference(memo)]
        if plain:
            joined = list(plain)
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(joined).decode()], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), 0
            for w, end in zip(joined, ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist(), strict=True):
                memo[w], at = raw[at:end], end
        for text, made in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            memo[text.encode()] = np.array(made.ids, "<u4").tobytes()
        for w, stem, tail in stems:
            memo[w] = memo[stem] + memo[tail]
        self.bytes += 5 * sum(map(len, words))  # ids: a word's bytes four times at most

    @staticmethod
    def _words(text: str) -> list[bytes]:
        raw = text.encode()
        return (raw.lower() if len(raw) == len(text) and b"<|" not in raw else raw).split()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            split = [self._words(t) for t in texts[at : at + 256]]
            if new := set().union(*split).difference(self.memo):
                self._learn(new, split)
            out += [b"".join(map(self.memo.__getitem__, words)) for words in split]
        return out


_MADE: dict[object, WordTokenizer] = {}


def word_tokenizer(path: str):
    """A function that gives the worker's encode function for a tokenizer file, made once."""

    def get():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _MADE:
            _MADE[path] = WordTokenizer(path)
        return _MADE[path].encode

    return get


def plain_word_tokenizer(path: str):
    """As word_tokenizer, with the strings of special tokens read as ordinary text."""

    def get():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if (path, "plain") not in _MADE:
            _MADE[path, "plain"] = WordTokenizer(path)
            _MADE[path, "plain"].tokenizer.encode_special_tokens = True
        return _MADE[path, "plain"].encode

    return get


def forget() -> None:
    """Drops the words of all tokenizers of this worker."""
    for made in _MADE.values():
        made.forget()
