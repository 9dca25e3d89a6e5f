"""Main text of web pages by what repeats across a host's pages, with the markup to protect and to support.

1. A page is cut into blocks, each in a zone of its markup: article, main, undecided, weak furniture (a compound class
   name such as share-box inside an article or main), or furniture (menus, headers, footers, sidebars, adverts, forms,
   comments, hidden parts).
2. The token streams of a host's pages form one suffix array. It is sparse: suffixes begin at block starts and at
   content-chosen tokens (least hash of a window), so equal passages are cut alike wherever they stand, and order is by
   phrase, the tokens from one cut to the next. First, phrases on one page only are counted out; suffixes of the others
   are put in order, and a suffix's longest common prefix with neighbours of distinct pages is the run that repeats there.
   Longer runs go on at the next suffix, so no length bounds them.
3. Verdict. Runs of min_tokens tokens, or of a whole block, cover their tokens. Undecided blocks, those of main and weak
   furniture go if half of their tokens is covered. Blocks of an article stay, furniture goes, however often they repeat. A
   page with an article has no other text; without, main; without either, its undecided blocks. An article in a wrapper
   named like furniture (layout sidebar) counts if the page has no other article or main.

Every page goes through the array and gets its text by the one verdict, which reads the page again with the runs on its open
blocks; none is told by its markup alone. Distinct pages are told by their token streams outside furniture, so copies of a
page count once.
One host may have a third of all pages: the array is dealt by phrases, not by hosts, and a phrase with too many suffixes
is refined by the phrases after it until its groups are small.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import likely, released, written

_U = np.uint64
#: Groups of suffixes that may be large enough to be refined, at most.
MOST_LARGE = 10_000
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64, endpoint=False)

# Element names and class words of the public HTML vocabulary and of common page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math canvas object select button audio video".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = set("nav footer aside menu dialog search head".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup sidebar sidenav menu nav navbar navigation topbar "
    "breadcrumb breadcrumbs footer masthead comment comments disqus replies social share sharing related recommended widget "
    "pagination pager toolbar".split()
)
#: Of these, names that page layouts also give to what is around the article; and names that words inside a sentence may bear.
LAYOUT_WORDS = set("sidebar sidenav menu nav navbar navigation topbar banner masthead footer widget toolbar overlay modal".split())
PLAIN_WORDS = LAYOUT_WORDS | set("notice promo promotion popup subscription signup".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: WEAK_A and WEAK_M: weak furniture inside an article or main. OUTER: weak furniture elsewhere, in which an article or main may still open.
#: WRAPPED: furniture by a layout's name, in which an article or main opens ASIDE, which is text only if the page has no other.
UNDECIDED, ARTICLE, MAIN, WEAK_A, WEAK_M, OUTER, DROPPED, WRAPPED, ASIDE = ZONES = range(9)
_WEAK = {ARTICLE: WEAK_A, WEAK_A: WEAK_A, MAIN: WEAK_M, WEAK_M: WEAK_M}


def zone_of(name: str, attrs: str, outer: int) -> int:
    """The zone that an element opens inside outer."""
    if outer == DROPPED or name in FURNITURE or (name == "header" and outer not in (ARTICLE, WEAK_A, ASIDE)):
        return DROPPED
    if name == "form":
        return OUTER if outer in (UNDECIDED, OUTER) else DROPPED  # a form around the whole page is no form of the article
    inner, whole = outer, name in ("article", "main")
    if attrs and name not in ("html", "body"):
        for key, *value in _ATTR.findall(attrs):
            key, value = key.lower(), "".join(value).lower()
            if key in ("class", "id") and not whole and not (key == "id" and name in HEADINGS):  # a heading's id names its section
                words = FURNITURE_WORDS.intersection(value.split())
                if name not in BLOCK:
                    words -= PLAIN_WORDS
                if words and words <= LAYOUT_WORDS and outer in (UNDECIDED, OUTER, WRAPPED):
                    inner = WRAPPED
                elif words:
                    return DROPPED
                elif inner != WRAPPED and name in BLOCK and not FURNITURE_WORDS.isdisjoint(re.split(r"[\s_-]+", value)):
                    inner = _WEAK.get(outer, OUTER if outer in (UNDECIDED, OUTER) else outer)
            if key == "class" and name == "article" and not {"comment", "comments", "ad", "advert"}.isdisjoint(re.split(r"[\s_-]+", value)):
                return DROPPED
            if (key == "role" and value in FURNITURE_ROLES) or (key == "style" and _HIDDEN.search(value)) or (key == "hidden") or (key == "aria-hidden" and value == "true"):
                return DROPPED
            if key == "role" and value == "main" and outer in (UNDECIDED, OUTER):
                return MAIN
    if outer in (WRAPPED, ASIDE):
        return ASIDE if whole else outer
    if name == "article" and outer not in (WEAK_A, WEAK_M):
        return ARTICLE
    return MAIN if name == "main" and outer in (UNDECIDED, OUTER) else inner


def end_of(name: str, page: str, at: int) -> int:
    """Where the element that was opened just before at ends, elements of its name inside counted; at itself if it doesn't."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order: character references decoded, white space one space, trimmed, none empty."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, at, held = UNDECIDED, 0, []
    n = len(page)

    def flush() -> None:
        if held:
            if text := " ".join(entities.unescape("".join(held)).split()):
                out.append((zone, text))
            held.clear()

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCK or (name in RAW and not closing):
            if name in BLOCK:
                flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    zone = stack[-1][1] if stack else UNDECIDED
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:  # an inline end tag doesn't reach out of its block
                    break
            continue
        if name in RAW:
            if not attrs.endswith("/") or name in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in VOID or (attrs.endswith("/") and name not in BLOCK):
            continue
        if name in BLOCK:
            closes = {"p"} | ({name} if name in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
            while stack and (stack[-1][0] in closes or stack[-1][0] not in BLOCK):  # what the block start ends implicitly
                stack.pop()
            zone = stack[-1][1] if stack else UNDECIDED
        inner = zone_of(name, attrs, zone)
        if inner != zone and name not in BLOCK:
            if inner == DROPPED:  # an inline advert inside a block: its text goes, the block goes on
                at = end_of(name, page, at)
                held.append(" ")
                continue
            inner = zone
        stack.append((name, inner))
        zone = inner
    flush()
    return out


def host_of(url: str | None) -> str:
    """The lower-cased host of a URL without user and port; empty for null or none, also where no URL can be read from it."""
    try:
        return re.sub(r"^.*@|:\d*$", "", urlsplit(re.sub(r"[\s\[\]]", "", url or "")).netloc.lower())
    except ValueError:
        return ""


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size in _power:
        return _power[size]
    base = 0x9E3779B97F4A7C15
    made = tuple(np.cumprod(np.r_[_U(1), np.full(size - 1, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
    if size <= 1 << 17:
        _power[size] = made
    return made


def _hashes(text: str) -> np.ndarray:
    """A hash of each word of a text with single spaces: polynomials in the words' bytes, as differences of one running sum."""
    raw = np.frombuffer(text.encode(), np.uint8)
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=total[1:])
    space = np.flatnonzero(raw == 32)
    start, end = np.zeros(len(space) + 1, np.int64), np.full(len(space) + 1, len(raw), np.int64)
    start[1:], end[:-1] = space + 1, space
    return _mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(np.uint64))


def _starts(of: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(of), bool)
    np.not_equal(of[1:], of[:-1], out=out[1:])
    return out


def phrases(stream: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, tokens, hash) of each phrase of a page's blocks in order, and the mixed hashes of all tokens.

    A phrase begins with a block and at each token whose pair hash is the least of some window inside its block, so a
    passage is cut alike on every page, but for its first and last tokens, fewer than window, where it isn't whole blocks.
    """
    sizes = np.array([b.count(" ") + 1 for b in stream], np.int64)
    h = _hashes(" ".join(stream).lower())
    of = np.repeat(np.arange(len(sizes)), sizes)
    cut = _starts(of)
    if len(h) > window:
        pair = h * _U(0x9E3779B97F4A7C15)
        pair[:-1] ^= h[1:]
        pair = _mix(pair)
        views = np.lib.stride_tricks.sliding_window_view(pair, window)
        inside = np.flatnonzero(of[: len(views)] == of[window - 1 :])
        cut[inside + views[inside].argmin(1)] = True
    at = np.flatnonzero(cut)
    length = np.diff(at, append=len(h))
    place = (np.arange(len(h)) - np.repeat(at, length)).astype(np.uint64)
    mixed = _mix(h ^ (place * _U(0xD6E8FEB86659FD93)))
    return of[at], length, _mix(np.add.reduceat(mixed, at) ^ length.astype(np.uint64)), h


def _marks(n: int, zones: list[int]) -> np.ndarray:
    out = np.zeros(n, bool)
    out[zones] = True
    return out


def _page(page: str) -> tuple[list[str], np.ndarray]:
    """The texts and zones of a page's blocks; an article aside is one if there is no other article or main, else furniture."""
    found = blocks(page)
    zones = np.array([z for z, _ in found], np.int64)
    other = np.isin(zones, (ARTICLE, WEAK_A, MAIN, WEAK_M)).any()
    zones[zones == ASIDE] = DROPPED if other else ARTICLE
    zones[zones == WRAPPED] = DROPPED
    return [t for _, t in found], zones


def _open_zones(zones: np.ndarray) -> list[int]:
    """The zones of a page whose blocks repeats decide."""
    some = set(zones.tolist())
    if not some.isdisjoint((ARTICLE, WEAK_A)):
        return [WEAK_A]
    return [UNDECIDED] if some.isdisjoint((MAIN, WEAK_M)) else [MAIN, WEAK_M]


def sequence(page: str, host: int, window: int) -> tuple | None:
    """A page's stream as (content, phrases, open): the phrases' names on that host, and if repeats decide their block; None for a page without text."""
    texts, zones = _page(page)
    if not texts:
        return None
    block, length, phrase, h = phrases(texts, window)
    named = _mix(phrase ^ _U(host))
    content = h[np.repeat((zones != DROPPED)[block], length)]
    content = np.add.reduce(_mix(content ^ (np.arange(len(content), dtype=np.uint64) * _U(0x9E3779B97F4A7C15))), dtype=np.uint64) ^ _U(len(content))
    return content, named, _marks(len(ZONES), _open_zones(zones))[zones][block]


def main_blocks(page: str, runs: list[tuple[int, int]], window: int, min_tokens: int) -> str:
    """The kept text of a page: runs are (phrase, phrases) that repeat elsewhere."""
    texts, zones = _page(page)
    if not texts:
        return ""
    open_ = _open_zones(zones)
    kept = _marks(len(ZONES), [*open_, ARTICLE])[zones]
    if runs:
        block, length, _, _ = phrases(texts, window)
        ends = np.cumsum(length)
        last = np.r_[block[1:] != block[:-1], True]
        covered = np.zeros(ends[-1] + 1, np.int64)
        for at, n in runs:
            a, b = ends[at] - length[at], ends[at + n - 1]
            tail = np.flatnonzero(last[at : at + n])
            if b - a >= min_tokens:
                covered[a:b] = 1
            elif (not at or last[at - 1]) and len(tail):
                covered[a : ends[at + tail[-1]]] = 1  # whole blocks, however short
        tokens = np.bincount(block, length).astype(np.int64)
        share = np.add.reduceat(covered[:-1], np.cumsum(tokens) - tokens) / tokens
        kept &= ~(_marks(len(ZONES), open_)[zones] & (share >= 0.5))
    return "\n\n".join(t for t, k in zip(texts, kept, strict=True) if k)


def _order(s: DataFrame, depth: int, part: int) -> DataFrame:
    """The runs of suffixes s (k1, k2, at, open, d, u0..): how many first phrases each shares with a suffix of another content.

    Groups of equal first phrases are put in suffix order and neighbours compared. A group of more than part suffixes is
    refined by the next phrase; what is alike in all depth phrases needs no order, only the least and greatest content.
    """
    us = [f"u{k}" for k in range(depth)]
    keys = ["k1", "k2", "at", "open"]
    rest, done = s.withColumn("known", F.lit(0)), []
    for level in range(1, depth + 1):
        g = F.xxhash64(F.lit(level), *us[:level])
        large = rest.groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("a"), F.max("d").alias("b")).where(F.col("n") > part)
        large = large.select("g", (F.col("a") != F.col("b")).alias("shared")).collect()  # fewer than MOST_LARGE, as part is at least a MOST_LARGE-th of all
        if not large:
            done.append(rest.select(*keys, "d", "known", *us, g.alias("g")))
            rest = None
            break
        is_large = g.isin([r["g"] for r in large])
        done.append(rest.where(~is_large).select(*keys, "d", "known", *us, g.alias("g")))
        known = F.when(g.isin([r["g"] for r in large if r["shared"]]), sum((F.col(u) != 0).cast("int") for u in us[:level])).otherwise(F.col("known"))
        rest = rest.where(is_large).withColumn("known", known)
    cut = done[0]
    for more in done[1:]:
        cut = cut.unionByName(more)

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solve(f: pd.DataFrame) -> pd.DataFrame:
            u = f[us].to_numpy()
            d, g = f["d"].to_numpy(), f["g"].to_numpy()
            n = len(f)
            same = np.cumprod(np.r_["0", np.zeros((1, depth), np.int64), (u[1:] == u[:-1]) & (u[1:] != 0)], axis=1).sum(1) * np.r_[False, g[1:] == g[:-1]]
            best = f["known"].to_numpy(np.int64).copy()
            # A neighbour of one's own content hands on what it shares with those before it, cut to what both share.
            for step in (1, -1):
                carry, shared = np.zeros(n, np.int64), same if step == 1 else np.r_[same[1:], 0]
                differs = np.r_[True, d[1:] != d[:-1]] if step == 1 else np.r_[d[1:] != d[:-1], True]
                if step == -1:
                    shared, differs = shared[::-1], differs[::-1]
                carry[differs] = shared[differs]
                for i in np.flatnonzero(~differs & (shared > 0)):
                    carry[i] = min(shared[i], carry[i - 1])
                best = np.maximum(best, carry if step == 1 else carry[::-1])
            return pd.DataFrame({**{c: f[c] for c in keys}, "n": best})[best > 0]

        size = 0
        for batch in batches:
            goes_on = bool(held) and len(batch) > 0 and batch["g"].iloc[-1] == held[0]["g"].iloc[0]
            held.append(batch)
            size += len(batch)
            if size < 20_000 or goes_on:  # one group only: joined once it has ended
                continue
            f, size = pd.concat(held, ignore_index=True), 0
            last = int(np.searchsorted(f["g"].to_numpy(), f["g"].iloc[-1]))  # the last group may go on
            if last:
                yield solve(f.iloc[:last])
            held = [f.iloc[last:]]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    parts = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut.repartitionByRange(parts, "g").sortWithinPartitions("g", *us, "d")
    found = ordered.mapInPandas(neighbours, "k1 long, k2 long, at int, open boolean, n int")
    if rest is not None:
        found = found.unionByName(rest.where("known > 0").select(*keys, F.col("known").alias("n")))
    return found


def main_text(pages: DataFrame, min_tokens: int = 6, window: int = 16, part: int = 2_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Null html is empty, a null URL counts as a host of its own name, no text is ''.

    Rows are judged one by one, also if ids or rows repeat; copies of a page don't make each other boilerplate. No text is
    capped; other columns are not carried. part is the least number of suffixes that one group may have before it is
    refined; it grows with the input, so that at most MOST_LARGE groups are larger.
    """
    depth = 4
    us = [f"u{k}" for k in range(depth)]
    html = F.coalesce(F.col(html_col), F.lit(""))
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("h"))
    read = read.withColumns({"k1": F.xxhash64("url", "h"), "k2": F.xxhash64(F.lit(7), "h", "url")})

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(a, b, *s) for a, b, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (s := sequence(h, xxhash.xxh3_64_intdigest(host_of(u)), window))]
            if got:
                a, b, content, named, open_ = zip(*got, strict=True)
                lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).astype(kind)))
                plain = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.array(content, np.uint64).view(np.int64))]
                yield pa.record_batch([*plain, lists(named, np.int64), lists(open_, bool)], ["k1", "k2", "d", "u", "open"])
        released()

    made = read.select("k1", "k2", "url", "h").mapInArrow(sequences, "k1 long, k2 long, d long, u array<long>, open array<boolean>")
    made = written(made, "sequences")
    counted = made.select("d", F.explode("u").alias("u0")).groupBy("u0").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    shared = written(counted.where("a != b").select("u0"), "phrases")
    after = [F.slice("u", k + 1, F.greatest(F.size("u") - k, F.lit(0))).alias(us[k]) for k in range(depth)]
    placed = made.select("k1", "k2", "d", F.posexplode(F.arrays_zip(*after, "open")).alias("at", "s"))
    placed = placed.select("k1", "k2", "at", "s.open", "d", *[F.coalesce(f"s.{u}", F.lit(0)).alias(u) for u in us])
    s = written(likely(placed, "u0", shared), "suffixes")
    part = max(part, -(-s.count() // MOST_LARGE))
    runs = _order(s, depth, part).where("open").select("k1", "k2", F.struct("at", "n").alias("run"))
    marks = written(runs.groupBy("k1", "k2").agg(F.collect_set("run").alias("runs")), "marks")  # at most a page's phrases

    @F.pandas_udf("string")
    def kept(h: pd.Series, runs: pd.Series) -> pd.Series:
        pairs = lambda r: [] if r is None else [(x["at"], x["n"]) for x in r]
        return pd.Series([main_blocks(p, pairs(r), window, min_tokens) for p, r in zip(h, runs, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def unmarked(h: pd.Series) -> pd.Series:
        return pd.Series([main_blocks(p, [], window, min_tokens) for p in h], dtype=object)

    found = likely(read, "k1", marks, keep_rest="likely")  # pages without a run on an open block aren't shuffled
    some = found.where("likely").join(marks.hint("merge"), ["k1", "k2"], "left").select("page_id", "url", kept("h", "runs").alias("text"))
    out = found.where("not likely").select("page_id", "url", unmarked("h").alias("text")).unionByName(some)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
