"""Exact n-gram Jaccard join, down to connected components, with signature trees.

1. A document's set is the 64-bit hashes of its distinct word shingles. Equal sets are one class, represented by the
   smallest id.
2. Candidates. Two sets this similar share one of their first n - ceil(t n) + 1 members under any common order. The order
   puts members that are frequent in the corpus last (by the counts of a fixed-size sketch over all documents), so that
   a common passage hardly ever brings documents together. All classes that share a member form a bucket; a bucket joins
   the group named after its smallest class. All pairs that can be similar meet in a group, and the many buckets of one
   family of copies collapse into one.
3. Groups. In a group a signature tree holds OR-combined bitmaps and size ranges; pairs of nodes are traversed together
   and dropped when the largest possible overlap is too small, or when all below is already linked. What is left is
   verified on the whole sets. A group too large for one task is dealt into parts that share pivots; once these are
   linked, only the classes outside the group's main component still meet the other parts.
4. Links are joined to components over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import dropped, hot_join, likely, released, written

#: Words whose hash a worker remembers; the memo is emptied beyond that, which changes no result.
MEMO = 250_000
#: Shingles that one task holds of a group, about; a group with more is dealt into parts.
SHINGLES = 8_000_000
_memo: dict[bytes, int] = {}
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles of width words: A-Z lowered, words split at ASCII white space; fewer words are one shingle."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    try:
        h = np.fromiter(map(_memo.__getitem__, words), np.uint64, n)
    except KeyError:
        if len(_memo) > MEMO:
            _memo.clear()
        for w in set(words):
            if w not in _memo:
                _memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(_memo.__getitem__, words), np.uint64, n)
    span = min(n, width)
    out = np.full(n - span + 1, span, np.uint64)
    for j in range(span):
        out = (out * _U(0x9E3779B97F4A7C15)) ^ h[j : n - span + 1 + j]
        out = (out ^ (out >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return np.unique(_mix(out))


def _forget() -> None:
    """Empties the memo as a task ends."""
    _memo.clear()
    released()


def slot_levels(docs: DataFrame, text: str, width: int, log2: int) -> np.ndarray:
    """For each of 2**log2 slots of the hash range, how often its members occur, from 0 (least) to 255; counted over all documents.

    The driver gets 2**log2 numbers, whatever the corpus. Where slots hold many members, a frequent one still lifts its
    slot above others, so that members of low slots are the rarer ones.
    """
    shift, part = _U(64 - log2), 1 << 12

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total, held, n = np.zeros(1 << log2, np.int64), [], 0

        def add():
            if held:
                np.add(total, np.bincount((np.concatenate(held) >> shift).astype(np.int64), minlength=1 << log2), out=total)
                held.clear()

        for batch in batches:
            for t in batch[text]:
                held.append(shingles(t, width))
                n += len(held[-1])
                if n > 1 << 20:
                    add()
                    n = 0
        add()
        _forget()
        rows = total.reshape(-1, min(part, 1 << log2)).astype(np.int32)
        some = np.flatnonzero(rows.any(1))
        yield pd.DataFrame({"part": some, "counts": [rows[k].tobytes() for k in some]})

    def add_up(f: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int32) for c in f["counts"]], axis=0, dtype=np.int64)
        return pd.DataFrame({"part": [f["part"].iloc[0]], "counts": [total.tobytes()]})

    summed = docs.select(text).mapInPandas(sketch, "part int, counts binary").groupBy("part").applyInPandas(add_up, "part int, counts binary").toPandas()
    counts = np.zeros((max(1, (1 << log2) // part), min(part, 1 << log2)), np.int64)
    for k, c in zip(summed["part"], summed["counts"], strict=True):
        counts[k] = np.frombuffer(c, np.int64)
    counts = counts.ravel()
    return np.searchsorted(np.unique(np.quantile(counts, np.arange(1, 256) / 256)), counts, side="left").astype(np.uint8)


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two, at least twice n, so that bitmaps of like sizes fold to one width."""
    return 1 << min(17, max(8, (2 * n - 1).bit_length()))


def signature(s: np.ndarray, width: int) -> np.ndarray:
    """The bitmap, as bytes, of the low bits of a set's hashes."""
    bits = np.zeros(width, bool)
    bits[(s & _U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a smaller width: its parts, combined by OR."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, width // 8), axis=0)


class SignatureTree:
    """Members of a group in an order that puts like ones together, under nodes with OR-combined bitmaps and size ranges."""

    LEAF = 16

    def __init__(self, size: np.ndarray, least: np.ndarray, bitmaps: list[np.ndarray], sets: list[np.ndarray] | None = None):
        """bitmaps are of one width; without sets, what may be linked counts as linked."""
        self.sets = sets
        self.order = np.lexsort((size, least))
        self.size = size[self.order]
        self.maps = np.stack([bitmaps[k] for k in self.order]).view(np.uint64)
        self.excess = self.size - np.bitwise_count(self.maps).sum(1, dtype=np.int64)  # shingles that share a bit with another of the set
        self.nodes = [self._node(a, min(a + self.LEAF, len(size)), ()) for a in range(0, len(size), self.LEAF)]
        top = list(range(len(self.nodes)))
        while len(top) > 1:
            above = []
            for k in range(0, len(top), 4):
                below = tuple(top[k : k + 4])
                self.nodes.append(self._node(self.nodes[below[0]][0], self.nodes[below[-1]][1], below))
                above.append(len(self.nodes) - 1)
            top = above
        self.root = top[0]

    def _node(self, a: int, b: int, below: tuple[int, ...]):
        return a, b, below, np.bitwise_or.reduce(self.maps[a:b]), int(self.size[a:b].min()), int(self.size[a:b].max()), int(self.excess[a:b].max())

    def may_link(self, x, y) -> bool:
        """If some pair below two nodes can have 7 * overlap >= 3 * (sum of sizes)."""
        if 3 * x[4] > 4 * y[5] or 3 * y[4] > 4 * x[5]:
            return False
        most = min(x[5], y[5], int(np.bitwise_count(x[3] & y[3]).sum()) + min(x[6], y[6]))
        return 7 * most >= 3 * (x[4] + y[4])

    def link(self, labels: np.ndarray) -> np.ndarray:
        """labels (one per set; equal: linked before) after all links; only pairs not linked yet are verified."""
        labels = labels[self.order].copy()
        stack = [(self.root, self.root)]
        while stack:
            i, j = stack.pop()
            x, y = self.nodes[i], self.nodes[j]
            first = labels[x[0]]
            if (labels[x[0] : x[1]] == first).all() and (labels[y[0] : y[1]] == first).all():
                continue
            if i != j and not self.may_link(x, y):
                continue
            if not x[2] and not y[2]:
                self._leaves(x, y, i == j, labels)
            elif i == j:
                stack += [(a, b) for k, a in enumerate(x[2]) for b in x[2][k + 1 :]] + [(a, a) for a in x[2]]
            elif x[2]:
                stack += [(a, j) for a in x[2]]
            else:
                stack += [(i, b) for b in y[2]]
        out = np.empty_like(labels)
        out[self.order] = labels
        return out

    def _leaves(self, x, y, same: bool, labels: np.ndarray) -> None:
        a, b = np.arange(x[0], x[1]), np.arange(y[0], y[1])
        most = np.bitwise_count(self.maps[a][:, None, :] & self.maps[b][None, :, :]).sum(2, dtype=np.int64) + np.minimum(self.excess[a][:, None], self.excess[b][None, :])
        both, less = self.size[a][:, None] + self.size[b][None, :], np.minimum(self.size[a][:, None], self.size[b][None, :])
        fits = (7 * np.minimum(most, less) >= 3 * both) & (3 * (both - less) <= 4 * less) & (less > 0)
        if same:
            fits &= a[:, None] < b[None, :]
        for p, q in np.argwhere(fits):
            p, q = a[p], b[q]
            if labels[p] == labels[q]:
                continue
            if self.sets is None or similar(self.sets[self.order[p]], self.sets[self.order[q]]):
                labels[labels == labels[q]] = labels[p]


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """If 100 * intersection >= 75 * union, of two sorted sets."""
    s, t = (s, t) if len(s) <= len(t) else (t, s)
    at = np.searchsorted(t, s)
    return 7 * int((t[np.minimum(at, len(t) - 1)] == s).sum()) >= 3 * (len(s) + len(t))


def link_sets(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """labels (equal: linked before) after all links between the sets."""
    size = np.array([len(s) for s in sets])
    width = width_of(int(np.median(size)))
    least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
    return SignatureTree(size, least, [signature(s, width) for s in sets], sets).link(labels)


def may_link_sets(size: np.ndarray, least: np.ndarray, bitmaps: list[np.ndarray]) -> np.ndarray:
    """Labels that are equal at least where sets could be linked, from sizes and bitmaps (each of width_of its size) alone."""
    labels = np.arange(len(size))
    band = np.floor(np.log(size) / np.log(4 / 3) + 1e-9).astype(int)  # sizes that can be linked are in one band or in neighbours
    for b in np.unique(band):
        at = np.flatnonzero((band == b) | (band == b + 1))
        if len(at) < 2:
            continue
        width = min(8 * len(bitmaps[k]) for k in at)
        new = SignatureTree(size[at], least[at], [folded(bitmaps[k], width) for k in at]).link(labels[at])
        for old, now in set(zip(labels[at].tolist(), new.tolist(), strict=True)):
            if old != now:
                labels[labels == old] = now
    return labels


def _narrowed(members: DataFrame, made: DataFrame, part: int) -> DataFrame:
    """Groups (g, doc) cut down to members that sizes and bitmaps let be linked; groups of more than part members stay as they are."""
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    sized = members.join(sizes, "g")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def solve() -> Iterator[pd.DataFrame]:
            if len(held) < 2:
                return
            doc, n, low, maps = (list(c) for c in zip(*held, strict=True))
            doc, labels = np.array(doc), may_link_sets(np.array(n), np.array(low), [np.frombuffer(m, np.uint8) for m in maps])
            first = np.full(len(doc), np.iinfo(np.int64).max)
            np.minimum.at(first, labels, doc)
            many = np.bincount(labels, minlength=len(doc))[labels] > 1
            if many.any():
                yield pd.DataFrame({"g": first[labels][many], "doc": doc[many]})

        for batch in batches:
            for g, *row in batch[["g", "doc", "n", "low", "map"]].itertuples(index=False):
                if g != key:
                    yield from solve()
                    key, held = g, []
                held.append(row)
        yield from solve()

    small = sized.where(F.col("m") <= part).select("g", "doc").join(made, "doc").repartition("g").sortWithinPartitions("g", "doc")
    kept = small.mapInPandas(run, "g long, doc long").unionByName(sized.where(F.col("m") > part).select("g", "doc"))
    return written(kept.distinct(), "groups")


def _linked(groups: DataFrame, width: int) -> DataFrame:
    """Edges (u, v) inside each group of rows (g, part, doc, text[, label]); a part is read whole by one task."""

    def solve(docs: list[int], sets: list[np.ndarray], labels: list) -> pd.DataFrame | None:
        if len(docs) < 2:
            return None
        ids = np.array(docs, np.int64)
        start = np.unique(np.array(labels, np.int64), return_inverse=True)[1].reshape(-1)
        end = link_sets(sets, start)
        first = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(first, end, ids)
        own = first[end]
        moved = own != ids
        return pd.DataFrame({"u": ids[moved], "v": own[moved]}) if moved.any() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, docs, sets, labels = None, [], [], []
        for batch in batches:
            for g, part, doc, text, label in batch.itertuples(index=False):
                if (g, part) != key:
                    if (out := solve(docs, sets, labels)) is not None:
                        yield out
                    key, docs, sets, labels = (g, part), [], [], []
                docs.append(doc)
                sets.append(shingles(text, width))
                labels.append(label)
        if (out := solve(docs, sets, labels)) is not None:
            yield out
        docs, sets, labels = [], [], []
        _forget()

    cut = groups.select("g", "part", "doc", "text", "label").repartition("g", "part").sortWithinPartitions("g", "part", "doc")
    return cut.mapInPandas(run, "u long, v long").distinct()


BUCKET = ["g", "doc", "part", "member", "n"]
#: Entries that one task puts into buckets, about.
ENTRIES = 2_000_000


def _buckets(entries: DataFrame, parts: int) -> DataFrame:
    """(g, doc) of every member that several documents of entries (doc, n, member) share, g being the bucket's smallest document.

    Entries are dealt by ranges of (member, n, doc), so a hot member goes to as many tasks as it needs. A bucket falls
    apart where sizes make a step that no pair can bridge. The first and last buckets of a task may go on in others:
    these are told by their ends, two rows a task, and get one name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not got or not sum(len(c[0]) for c in got):
            return
        own = 2 * TaskContext.get().partitionId()
        doc, n, member = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((doc, n, member))
        doc, n, member = doc[order], n[order].astype(np.int64), member[order]
        start = np.flatnonzero(np.r_[True, (member[1:] != member[:-1]) | (3 * n[1:] > 4 * n[:-1])])
        length = np.diff(np.r_[start, len(member)])
        least = np.minimum.reduceat(doc, start)
        center, part = np.repeat(least, length), np.full(len(doc), -1)
        part[start[-1] :] = own + 1
        part[: length[0]] = own  # a task of one bucket has but this part
        keep = (center != doc) | (part >= 0)
        pairs = np.unique(np.stack([center[keep], doc[keep], part[keep]]), axis=1)
        none = pa.nulls(pairs.shape[1], pa.int64())
        yield pa.record_batch([*map(pa.array, pairs), none, none], BUCKET)
        ends = [(int(least[0]), None, own, int(member[0]), int(n[0])), (int(least[-1]), None, own + (len(start) > 1), int(member[-1]), int(n[-1]))]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*ends, strict=True)], BUCKET)
        del got, doc, n, member, order, start, length, least, center, part, keep, pairs, none
        released()

    ordered = entries.select("doc", "n", "member").repartitionByRange(parts, "member", "n", "doc")
    found = written(ordered.mapInArrow(run, ", ".join(f"{c} long" for c in BUCKET)), "buckets")
    names = _across([tuple(r)[:1] + tuple(r)[2:] for r in found.where("doc is null").collect()])  # two rows a task
    renamed = entries.sparkSession.createDataFrame(list(names.items()) or [(-2, 0)], "part long, name long")
    edge = found.where("doc is not null and part >= 0").join(F.broadcast(renamed), "part", "left").select(F.coalesce("name", "g").alias("g"), "doc")
    return found.where("doc is not null and part < 0").select("g", "doc").unionByName(edge).where("g != doc").distinct()


def _across(ends: list[tuple[int, int, int, int]]) -> dict[int, int]:
    """The common name of parts of buckets that go on from task to task, of the ends (least, part, member, n) of each task, first and last."""
    names: dict[int, int] = {}
    chain: list[tuple[int, int]] = []

    def close() -> None:
        if len({part for _, part in chain}) > 1:
            names.update(dict.fromkeys((part for _, part in chain), min(least for least, _ in chain)))
        chain.clear()

    before = None
    ordered = sorted(ends, key=lambda e: (e[1] // 2, e[2], e[3], e[1]))
    for k, (least, part, member, n) in enumerate(ordered):
        first = k % 2 == 0
        goes_on = before is not None and (part == before[0] if not first else before[1] == member and 3 * n <= 4 * before[2])
        if not goes_on:
            close()
        chain.append((least, part))
        before = part, member, n
    close()
    return names


def classes(docs: DataFrame, width: int = 5, log2: int = 20, part: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; linked are sets with 100 * intersection >= 75 * union.

    Null texts and texts without words have no shingles and no links: their component is their own id. A row of null id
    has the component of its equals, else null. Rows with one id are one document, linked by any of its texts. Verified
    are 64-bit hashes of shingles, not their words. part bounds what one task holds of a group, not what is compared.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(slot_levels(rows, "text", width, log2))  # 2**log2 bytes
    shift = _U(64 - log2)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            n, keys, cut, ends, low, maps = [], [], [], [0], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, width)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                rare_first = np.argsort(level[(s >> shift).astype(np.int64)], kind="stable")
                head = s[rare_first[: len(s) - (3 * len(s) + 3) // 4 + 1 if len(s) else 0]]
                cut.append(head)
                ends.append(ends[-1] + len(head))
                low.append(int(s[0]) >> 1 if len(s) else None)
                maps.append(signature(s, width_of(len(s))).tobytes() if len(s) else None)
            flat = np.concatenate(cut).view(np.int64) if cut else np.empty(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(low, pa.int64()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names)
        _forget()

    names = ["doc", "n", "key", "low", "map", "head"]
    made = written(rows.mapInArrow(features, "doc long, n long, key binary, low long, map binary, head array<long>"), "shingles")
    own = made.where("key is not null").groupBy("key").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"))
    own = written(own.where("rep is not null"), "classes")
    # Heads are large, so copies are told by a bitmap; the few that it lets through go with the pairs, which are small. A bucket's name is a representative anyway.
    reps = own.select(F.col("rep").alias("doc")).distinct()
    heads = likely(made.where("key is not null and doc is not null"), "doc", reps)
    entries = heads.select("doc", F.col("n").cast("int").alias("n"), F.explode("head").alias("member"))
    n_entries = made.agg(F.sum(F.size("head"))).first()[0] or 0
    met = _buckets(entries, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_entries // ENTRIES)))
    met = written(met.join(reps, "doc", "left_semi").select("g", "doc"), "groups")
    met = met.unionByName(met.select("g", F.col("g").alias("doc")).distinct())
    members = _narrowed(met, likely(made.select("doc", "n", "low", "map"), "doc", met), part)
    shares = F.greatest(F.count(F.lit(1)) / part, F.sum("n") / SHINGLES)
    sizes = members.join(made.select("doc", "n"), "doc").groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.ceil(shares).cast("int").alias("parts"))
    dealt = members.join(sizes, "g").select("g", "doc", "m", "parts", F.xxhash64("doc").alias("h"))
    everywhere = (F.col("doc") == F.col("g")) | (F.pmod("h", F.col("m")) < 16)  # pivots, in all parts of a large group
    at = F.when(everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod("h", "parts").cast("int")))
    dealt = dealt.select("g", "doc", F.explode(at).alias("part"))
    texts = rows.where("doc is not null and text is not null")
    found = written(_linked(dealt.join(likely(texts, "doc", dealt), "doc").withColumn("label", F.col("doc")), width), "links")
    joined = components(found)

    large = members.join(sizes.where("parts > 1"), "g").select("g", "doc", "parts")
    if not large.isEmpty():
        known = large.join(joined, large["doc"] == joined["node"], "left").select("g", "doc", "parts", F.coalesce("component", "doc").alias("label"))
        main = known.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("m"), F.max("n").alias("in_main"))
        open_ = known.join(main.where("in_main < m"), "g")
        of = lambda c: F.greatest(F.lit(1), F.ceil(F.col("parts") * c / F.col("m"))).cast("int")
        inner, outer = of(F.col("in_main")), of(F.col("m") - F.col("in_main"))
        h = F.xxhash64("doc")
        in_main = F.col("label") == F.col("main")
        # Parts are named a * 2**20 + b: part a of those outside the main component meets part b of those in it, or, from 2**19 on, part b outside.
        with_outer = F.transform(F.sequence(F.lit(0), outer - 1), lambda a: a * (1 << 20) + F.pmod(h, inner))
        own_part = F.pmod(h, outer)
        with_inner = F.transform(F.sequence(F.lit(0), inner - 1), lambda b: own_part * (1 << 20) + b)
        with_other = F.transform(F.sequence(F.lit(0), outer - 1), lambda b: F.least(own_part, b) * (1 << 20) + (1 << 19) + F.greatest(own_part, b))
        blocks = open_.select("g", "doc", "label", F.explode(F.when(in_main, with_outer).otherwise(F.concat(with_inner, with_other))).alias("part"))
        more = _linked(blocks.join(likely(texts, "doc", blocks), "doc"), width)
        stars = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
        joined = components(stars.unionByName(more))

    # A class is resolved once and handed to its rows; rows of an id with several texts link the classes of these.
    whole, made = made, written(made.select("doc", "n", "key"), "sizes")
    dropped(whole)
    several = made.where("key is not null and doc is not null").groupBy("doc").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a != b").select("doc")
    bonds = made.join(several, "doc", "left_semi").join(own.select("key", "rep"), "key").select(F.col("doc").alias("u"), F.col("rep").alias("v")).distinct()
    if not several.isEmpty():
        joined = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(bonds))
    named = own.join(joined, own["rep"] == joined["node"], "left").select("key", "n", F.coalesce("component", "rep").alias("component_id"))
    told = hot_join(made.where("key is not null").select("doc", F.col("n").alias("size"), "key"), named, "key", made.count(), "left")
    bare = made.where("key is null").select("doc", F.col("n").alias("size"))
    bare = bare.join(joined, bare["doc"] == joined["node"], "left").select("doc", "size", F.col("component").alias("component_id"))
    out = told.select("doc", "size", "component_id").unionByName(bare)
    return out.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
