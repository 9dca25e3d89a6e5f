"""Source divergence and the conversation trie against plain Python, on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from marea.llm import divergence as D
from marea.llm import trie as T


def divergence_by_hand(rows, min_docs, top):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in mine for w in set(d[2]))
        kept = [w for w, n in seen.items() if n >= min_docs]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[k] for k in kept) + len(kept)) for w in kept}
        counts = {s: Counter(w for d in mine if d[1] == s for w in d[2]) for s in {d[1] for d in mine}}
        ps, q = {s: share(c) for s, c in counts.items()}, share(Counter(w for d in mine for w in d[2]))
        for s, p in ps.items():
            pair = [(o, sum((p[w] - r[w]) ** 2 // r[w] for w in kept)) for o, r in ps.items() if o != s]
            term = [(w, (p[w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[w] > q[w]]
            for part, found, last in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:last])]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "délta", "Éta", "中文", "z", "a1b", "x_y", "it's", "\x00nul", "\x7fdel"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "", None, "s2"])) for _ in range(200)]
    rows += [(None, "en", "empty"), ("", "fr", "one"), ("only here", "it", "b"), ("only there", "it", "a"), ("", None, None), (" word" * 600_000, "en", "s1")] + [("same same row", "en", "s9")] * 5
    docs = spark.createDataFrame([(k % 7, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, item string, value int")
    want = divergence_by_hand(rows, 3, 5)
    assert sorted(tuple(r) for r in D.divergence(docs, top=5).collect()) == want
    assert {r[:3] for r in want} >= {("it", "a", "pair"), ("en", "empty", "pair")}
    assert D.divergence(docs.where("false")).collect() == []


def test_divergence_flushes_and_parts(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices("abcdefghij", k=12)), "en", f"s{rng.randrange(3)}") for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    want = divergence_by_hand(rows, 3, 200)
    assert sorted(tuple(r) for r in D.divergence(docs).collect()) == want
    n, parts = Counter(), D.term_counts(docs, docs["lang"], docs["source"], docs["text"]).collect()
    for r in parts:
        n[r["term"]] += r["n"]
    assert sum(n.values()) == 720 and all(r["docs"] <= r["n"] for r in parts)


def trie_by_hand(rows, group=5, heads=9):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % heads for c in turns}
    whole = {c: turns.get(c - c % group, [])[: h[c]] + ts[h[c] :] for c, ts in turns.items()}
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, ms in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(ms) - 1) * (len(k[-1][1].encode()) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if len(whole[c]) == len(k)).encode()).hexdigest()
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else -1, len(members[k]), children[k], leaves[k], saved[k], sha(k)) for k in members)


def rows_of(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_of_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    rng = random.Random(6)
    rows = []
    for conv in range(60):
        rows += [(conv, t, rng.choice(["user", "é", None]), rng.choice(["a", "bé", None, ""])) for t in range(rng.randrange(1, 14))]
    rows += [(7, None, "user", "null turn"), (7, None, "user", "null turn"), (8, 1, "b", "tie"), (8, 1, "a", "tie"), (None, 1, "user", "no id")]
    rows += [(100, t, "user", "same") for t in range(120)] + [(c, t, "user", "same") for c in (101, 105, 110) for t in range(60)]  # long chains, nested
    rows += [(1000 + 5 * k, t, "user", f"{min(t, k)}") for k in range(12) for t in range(k, 14)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", depth int").repartition(3)
    assert rows_of(T.conversation_trie(turns)) == trie_by_hand(rows)


def test_trie_of_hot_prefixes_and_copies(spark):
    rows = [(5 * c, t, "user", f"system {t}" if t < 3 else f"{c % 7} {t}") for c in range(1500) for t in range(4)]  # all share three turns, many are copies
    rows += [(3, t, "user", "x" * 2_000_000) for t in range(12)]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(T.conversation_trie(turns)) == trie_by_hand(rows)


def test_trie_of_small_tables(spark):
    turns = spark.createDataFrame([(4, 0, "user", "gone")], SCHEMA)
    assert rows_of(T.conversation_trie(turns)) == trie_by_hand([(4, 0, "user", "gone")])
    assert T.conversation_trie(turns.where("false")).collect() == []
    assert T.conversation_trie(turns.selectExpr("CAST(NULL AS BIGINT) AS conv_id", "turn", "role", "text")).collect() == []
