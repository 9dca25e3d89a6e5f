"""HTML extraction against a brute-force finder of repeats, on pages without a marked article, and its edge cases."""

import random
from collections import Counter, defaultdict

import pytest

from marea.llm import html

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefghilmnoprstu") for _ in range(R.randint(2, 8))) for _ in range(4000)]
SCHEMA = "page_id long, url string, html string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def covered(pages, min_tokens):
    """Per page, which tokens lie in a run of min_tokens tokens, or in a whole block, that a page of the host with another text has."""
    out = []
    for host, blocks in pages:
        stream = [w for b in blocks for w in b.split()]
        hit = [False] * len(stream)
        for other_host, other in pages:
            if other_host != host or other == blocks:
                continue
            theirs = [w for b in other for w in b.split()]
            grams = {tuple(theirs[k : k + min_tokens]) for k in range(len(theirs) - min_tokens + 1)}
            for k in range(len(stream) - min_tokens + 1):
                if tuple(stream[k : k + min_tokens]) in grams:
                    hit[k : k + min_tokens] = [True] * min_tokens
            at = 0
            for b in blocks:
                n = len(b.split())
                if b in other:
                    hit[at : at + n] = [True] * n
                at += n
        out.append(hit)
    return out


def corpus():
    r, pages = random.Random(5), []
    for host in range(3):
        shared = [prose(n, (host, "shared", k).__repr__()) for k, n in enumerate((2, 3, 7, 12, 40, 150))]
        inner = [prose(120, (host, "inner", k).__repr__()) for k in range(3)]
        for page in range(12):
            blocks = []
            for k in range(r.randint(3, 9)):
                x, seed = r.random(), (host, page, k).__repr__()
                if x < 0.35:
                    blocks.append(r.choice(shared))
                elif x < 0.55:  # a passage in the middle of a block
                    blocks.append(f"{prose(r.choice((3, 20)), seed)} {r.choice(inner)} {prose(r.choice((2, 30, 400)), seed + 'b')}")
                else:
                    blocks.append(prose(r.randint(3, 60), seed))
            pages.append((f"h{host}.com", blocks))
    return pages


def extracted(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return Counter((x.page_id, x.text) for x in html.main_text(df, **options).collect())


@pytest.mark.parametrize("part", [2_000, 2])
def test_blocks_go_as_brute_force_says(spark, part):
    pages, window = corpus(), 16
    rows = [(k, f"http://{host}/{k}", "".join(f"<div>{b}</div>" for b in blocks)) for k, (host, blocks) in enumerate(pages)]
    got = dict(x for x in extracted(spark, rows, part=part))
    sure = Counter()
    for k, ((_, blocks), hit) in enumerate(zip(pages, covered(pages, 6), strict=True)):
        kept, at = got[k].split("\n\n") if got[k] else [], 0
        assert [b for b in blocks if b in kept] == kept  # whole blocks, in page order
        for b in blocks:
            n = len(b.split())
            own = sum(hit[at : at + n])
            at += n
            if 2 * own < n:
                sure["stays"] += 1
                assert b in kept
            elif 2 * (own - 2 * window * (own < n)) >= n:  # a run's ragged ends, shorter than a window each, may not count
                sure["goes"] += 1
                assert b not in kept
    assert min(sure["stays"], sure["goes"]) > 50 and sum(sure.values()) > 0.9 * sum(len(b) for _, b in pages)


def test_refined_groups_give_the_same(spark):
    rows = [(k, f"http://{host}/{k}", "".join(f"<p>{b}" for b in blocks)) for k, (host, blocks) in enumerate(corpus())]
    assert extracted(spark, rows, part=1) == extracted(spark, rows)


def test_copies_and_templates(spark):
    body = [prose(40, f"t{k}") for k in range(24)]
    rows = [(k, f"https://news.example/{k}", f"<article><p>{body[k]}</p><p>Share this story with friends</p>{'<p>Part of a series</p>' if k < 5 else ''}<div class='read-more share-box'>{'More from us' if k % 2 else f'only {k}'}</div></article><p>out</p>") for k in range(24)]
    copies = [(100 + k, "https://copies.example/" + str(k), f"<div>{body[0]}</div><div>{body[1]}</div><footer>{k}</footer>") for k in range(5)]
    few = [(200 + k, "https://few.example/" + str(k), f"<article><p>{body[k]}</p><p>Share this story with friends</p></article>") for k in range(5)]
    got = extracted(spark, rows + copies + few)
    wanted = Counter((k, "\n\n".join([body[k], "Share this story with friends"] + ["Part of a series"] * (k < 5) + ([] if k % 2 else [f"only {k}"]))) for k in range(24))
    wanted += Counter((100 + k, f"{body[0]}\n\n{body[1]}") for k in range(5)) + Counter((200 + k, f"{body[k]}\n\nShare this story with friends") for k in range(5))
    assert got == wanted


@pytest.mark.parametrize("pages", [19, 24, 60])
def test_articles_keep_what_every_page_has(spark, pages):
    body = [prose(30, f"h{k}") for k in range(pages)]
    rows = [(k, f"https://manual.example/{k}", f"<article><h1>Title {k}</h1><h2>Summary</h2><p>{body[k]}</p><h2 id=menu>References</h2><p>End</p></article>") for k in range(pages)]
    assert extracted(spark, rows) == Counter((k, f"Title {k}\n\nSummary\n\n{body[k]}\n\nReferences\n\nEnd") for k in range(pages))


def test_evidence_of_decided_pages(spark):
    menu = "Home and garden and all the rest of it"
    rows = [(k, f"https://mixed.example/{k}", f"<div>{menu}</div><article><p>{prose(30, f'm{k}')}</p></article>") for k in range(3)]
    rows += [(10, "https://mixed.example/10", f"<div>{menu}</div><div>{prose(30, 'open')}</div>"), (11, "https://alone.example/", f"<div>{menu}</div><div>{prose(30, 'open')}</div>")]
    wanted = Counter((k, prose(30, f"m{k}")) for k in range(3)) + Counter([(10, prose(30, "open")), (11, f"{menu}\n\n{prose(30, 'open')}")])
    assert extracted(spark, rows) == wanted


def test_every_page_goes_through_the_array(spark, monkeypatch):
    rows = [(k, f"https://h{k % 2}.example/{k}", f"<nav>Home and garden {k % 2}</nav><article><p>{prose(60, f'w{k // 4}')}</p><p>{prose(30, f'o{k}')}</p></article>") for k in range(8)]
    ordered, write = [], html.written
    monkeypatch.setattr(html, "written", lambda df, name: ordered.append((name, write(df, name))) or ordered[-1][1])
    monkeypatch.setattr(html, "_order", lambda s, *options, order=html._order: ordered.append(("runs", order(s, *options))) or ordered[-1][1])
    got = extracted(spark, rows)
    made = dict(ordered)
    assert made["sequences"].count() == made["suffixes"].select("k1").distinct().count() == 8
    assert made["runs"].groupBy("k1").agg({"n": "max"}).where("`max(n)` > 1").count() == 8  # the shared passages, of articles too
    assert got == Counter((k, f"{prose(60, f'w{k // 4}')}\n\n{prose(30, f'o{k}')}") for k in range(8))


CASES = {
    "<article>a<span class=ad>x<span>y</span>z</span>b</article>": "a b",
    "<article>a<span class=ad>x never closed</article>": "a x never closed",
    "<div class='has-sidebar'><article><p>text</p></article><p>side</p></div>": "text",
    "<form action=/><main><p>text</p><form><p>sign up</p></form></main></form>": "text",
    "<article><table class='share-price'><tr><td>12</td></tr></table></article>": "12",
    "<div class=sidebar><article>teaser</article></div><article>text</article>": "text",
    "<article>text<article class=comment>me</article></article>": "text",
    "<header>top</header><article><header><h1>T</h1></header>x</article>": "T\n\nx",
    "<div class='main-menu'>m</div><p>text": "text",
    "<div class='layout sidebar'><article>text</article><p>side</p></div>": "text",
    "<div class='layout sidebar'><article>teaser</article></div><main>text</main>": "text",
    "<div class=comments><article>me</article></div><p>text": "text",
    "<article><h2 id=menu>Menu</h2><p>soup</p></article>": "Menu\n\nsoup",
    "<article><p>a <span class=banner>red banner</span> hung</p></article>": "a red banner hung",
    "": "",
    None: "",
    "plain &lt;b&gt; &eacute;": "plain <b> é",
    "<p>" + "long words " * 200_000: ("long words " * 200_000).strip(),
    "<article></article><article> </article>": "",
}


def test_cases(spark):
    rows = [(k, f"http://case{k}.org", h) for k, h in enumerate(CASES)]
    rows += [(None, "http://a℀b.com/", "<p>a host that cannot be read"), (50, None, "<p>no address"), (50, None, "<p>no address"), (51, "http://[::1", "<p>six")]
    wanted = Counter({(k, t): 1 for k, t in enumerate(CASES.values())}) + Counter([(None, "a host that cannot be read"), (50, "no address"), (50, "no address"), (51, "six")])
    assert extracted(spark, rows) == wanted
    df = spark.createDataFrame([(1, "http://x.com", "<p>t", 5, 6)], SCHEMA + ", text long, k1 long")
    assert html.main_text(df).columns == ["page_id", "url", "text", "n_chars"] and html.main_text(df).first().text == "t"
    assert html.main_text(df.limit(0)).count() == 0


def test_phrases_cut_alike():
    for seed in range(30):
        passage, seen = prose(100, seed), defaultdict(set)
        for k in range(2):
            block, length, phrase, h = html.phrases([prose(50 * k + 3, seed + 99), prose(17, (k, seed).__repr__()) + " " + passage + " " + prose(20, (seed, k).__repr__())], 16)
            assert length.sum() == len(h) and (length > 0).all()
            at = length.cumsum()
            seen[k] = {(int(e), int(n), int(p)) for e, n, p in zip(at, length, phrase, strict=True)}
        both = {p for _, _, p in seen[0]} & {p for _, _, p in seen[1]}
        assert sum(n for _, n, p in seen[0] if p in both) >= 100 - 2 * 16
