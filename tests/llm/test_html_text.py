import random
import re
import time

import numpy as np
import pytest

from sparkweft.llm.html_text import LONG, blocks, candidates, extract, host_of, page_counts, suffix_ranks


def test_suffix_ranks():
    r = random.Random(1)
    t = [r.randrange(3) for _ in range(60)]
    for depth in (1, 2, 3, 5, 8):
        order, rank = suffix_ranks(np.array(t), depth)
        keys = [t[i : i + depth] for i in range(60)]
        assert [keys[i] for i in order] == sorted(keys)
        assert all((keys[i] == keys[j]) == (rank[i] == rank[j]) for i in range(60) for j in range(i))


def test_page_counts():
    """Pages of every substring that the array groups, against all substrings of all pages."""
    r = random.Random(2)
    for _ in range(30):
        sizes = [r.randrange(0, 14) for _ in range(5)]
        page = np.repeat(np.arange(5), sizes)
        t = np.array([r.randrange(3) for _ in page], np.int64)
        end = np.cumsum(sizes)[page] if len(page) else page
        want = {}
        for i in range(len(t)):
            if i + 4 <= end[i]:
                want.setdefault(tuple(t[i : i + 4]), set()).add(int(page[i]))
        at, n = page_counts(t, page, end, 4)
        assert {tuple(t[i : i + 4]): k for i, k in zip(at, n)} == {g: len(p) for g, p in want.items()} and len(at) == len(want)


def texts(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in extract(df, **kw).collect()}


HEAD = "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a:b}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>a</a></ul></nav><!-- c > d --><div class=\"ad\">Buy now</div>"
FOOT = "<footer>&copy; me</footer></body></html>"


def test_pages(spark):
    rows = [
        (1, "http://a.com/1", HEAD + "<article><h1>Head  &lt;1&gt;</h1><p><b>One<br><p>Two\n\t lines&nbsp;here <i>in</i>line</p><div class=comments>me too</div><div class='share-bar'>x</div></article>" + FOOT),
        (2, "http://a.com/2", None), (3, "http://a.com/3", ""), (4, None, "just text &#233; &am"),
        (5, "http://b.com/", HEAD + "<main><p>kept</p><aside>no</aside><form><input><p>no</p></form><section><p>also <a href=x>link</a></p></section></main><p>outside</p>" + FOOT),
        (6, "x", "<article><p>a < b and c &gt; d</p><p title='>'>q</p></article>"), (7, "y", "<p>unclosed <script>var x = '<p>no</p>'"), (8, "z", "<div hidden>no</div><div style='display:none'>no</div><div role=navigation>no</div>yes"),
        (9, "w", "<article><header><h1>T</h1></header><p>x</p></article>"),
    ]
    got = texts(spark, rows)
    assert got == {1: "Head <1>\nOne\nTwo lines here inline", 2: "", 3: "", 4: "just text é &am", 5: "kept\nalso link", 6: "a < b and c > d\nq", 7: "unclosed", 8: "yes", 9: "T\nx"}


def plain(pages):
    """Kept text of pages [(host, texts, inside)], from the rules alone: no arrays, no hashes, no shards."""
    hosts = {}
    for host, texts, _ in pages:
        if texts:
            hosts.setdefault(host, set()).add(tuple(texts))
    share = {}
    for host, found in hosts.items():
        held = {}
        for texts in found:
            w = " ".join(texts).lower().split(" ")
            for g in {tuple(w[i : i + LONG]) for i in range(len(w) - LONG + 1)}:
                held[g] = held.get(g, 0) + 1
        share[host] = {g: n / len(found) for g, n in held.items() if n >= 3 and 10 * n >= len(found)}
    out = []
    for host, texts, inside in pages:
        w = " ".join(texts).lower().split(" ")
        mark = [False] * len(w)
        for i in range(len(w) - LONG + 1):
            if share.get(host, {}).get(tuple(w[i : i + LONG]), 0) >= (0.5 if inside else 0.1):
                mark[i : i + LONG] = [True] * LONG
        line = "".join("1" if m else "0" for m in mark)
        copy = any(len(x) >= 0.8 * len(w) for x in re.findall("1+", line)) or inside and 2 * sum(mark) >= len(w) and "0" * LONG not in line
        kept, at = [], 0
        for t in texts:
            own = t.split(" ")
            kept.append(t if copy else " ".join(x for x, m in zip(own, mark[at : at + len(own)]) if not m))
            at += len(own)
        out.append("\n".join(k for k in kept if k))
    return out


def host_pages(seed):
    """Pages of hosts of several sizes: notices on some, most or few pages, whole or within other text, mirrored pages and near copies."""
    r = random.Random(seed)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    out = []
    for host, many in (("a.org", 90), ("b.org", 25), ("c.org", 4), ("d.org", 2), ("e.org", 1)):
        notices = [(say(r.choice([5, 9, 20, 60])), r.choice([0.05, 0.12, 0.3, 0.6, 0.95])) for _ in range(6)]
        shared, copied = say(200), say(40)
        for i in range(many):
            texts = [say(r.choice([3, 12, 40])) for _ in range(r.randrange(1, 5))]
            for n, p in notices:
                if r.random() < p:
                    texts.insert(r.randrange(len(texts) + 1), n if r.random() < 0.8 else f"{say(3)} {n} {say(3)}")
            if i % 10 == 3:
                texts = [copied, "the same on every mirror"]
            elif i % 10 == 5:
                texts = [shared + " " + say(4)]
            out.append((host, texts, r.random() < 0.5))
    return out


@pytest.mark.parametrize("kw", [{}, {"shard": 4000}, {"shard": 1500}])
def test_against_rules(spark, kw):
    """The returned text of whole pages, in and outside articles, by the rules; the same whatever the shards."""
    pages = host_pages(4)
    wrap = lambda texts, inside: ("<article>" if inside else "<div>") + "".join(f"<p>{t}</p>" for t in texts) + ("</article>" if inside else "</div>")
    rows = [(i, f"http://{h}/{i}", f"<body><nav>menu {i}</nav>{wrap(t, inside)}<footer>all the rest of it</footer></body>") for i, (h, t, inside) in enumerate(pages)]
    want = plain(pages)
    assert texts(spark, rows, **kw) == dict(enumerate(want))
    dropped = sum(w.count("\n") + 1 < len(t) for w, (_, t, _) in zip(want, pages))
    # Notices that stand within a block go, and its own words stay.
    assert sum(any(b not in w.split("\n") and b[: b.find(" ", 4)] in w for b in t) for w, (_, t, _) in zip(want, pages)) > 5
    assert dropped > 20 and sum(w.count("\n") + 1 < len(t) for w, (_, t, inside) in zip(want, pages) if inside) > 5


def test_boilerplate_without_article(spark):
    say = random.Random(3)
    prose = [" ".join(f"w{say.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    page = lambda i: f"<div>welcome to the very best site of all</div><div>{prose[i]}</div><div>all text here is ours and only ours</div>"
    rows = [(i, f"http://h.org/{i}", page(i)) for i in range(40)]
    for kw in ({}, {"shard": 4000}):
        assert texts(spark, rows, **kw) == dict(enumerate(prose))
    copies = [(1, "http://h.org/1", "<article><p>" + prose[0] + "</p></article>"), (2, "http://h.org/2", "<article><p>" + prose[0] + "</p></article>"), (2, "http://h.org/2", "")]
    df = spark.createDataFrame(copies, "page_id long, url string, html string")
    assert sorted(r.text for r in extract(df).collect()) == sorted([prose[0], prose[0], ""])
    mirrors = [(i, f"http://h.org/{i}", f"<div>{prose[0]}</div>") for i in range(30)]
    assert set(texts(spark, mirrors).values()) == {prose[0]}
    assert extract(df.limit(0)).count() == 0


def test_notice_in_articles(spark):
    """What half of a host's articles repeat goes, without any telling name; copies of an article stay whole."""
    say = random.Random(8)
    prose = [" ".join(f"w{say.randrange(10**6)}" for _ in range(40)) for _ in range(12)]
    notice = "we use small files on your device to make this site work"
    rows = [(i, f"http://h.org/{i}", f"<article><p>{p}</p><p>{notice}</p></article>") for i, p in enumerate(prose)]
    near = [(100 + i, f"http://n.org/{i}", f"<article><p>{prose[0]}</p><p>{prose[1]}</p><p>part {i}</p></article>") for i in range(12)]
    assert texts(spark, rows + near) == dict(enumerate(prose)) | {100 + i: f"{prose[0]}\n{prose[1]}\npart {i}" for i in range(12)}


def test_tags_are_hints():
    text = lambda page: candidates(page)[0]
    assert text("<article><p class='legal'>The legal history of Rome</p><section id='related-work'><p>a</p></section><div class='comment-analysis'>b</div></article>") == ["The legal history of Rome", "a", "b"]
    assert text("<main><ul><li>Skip to</ul><article><p>x</p></article><p>More from us</p></main>") == ["x"]
    assert text("<div class=byline>Subscribe for more</div><p>x</p>") == ["x"]
    assert text("<article><p>x</p><div class='comments'><article class='comment'>me too</article></div><div class='ad'>buy</div><article class='comment'>no</article></article>") == ["x"]
    assert text("<aside><article>teaser</article></aside><div><p>x</p></div>") == ["x"]


def test_names_are_doubts():
    """A class name that holds a telling word among others, or one of several meanings, does not cost a page its text."""
    text = lambda page: candidates(page)[0]
    prose = "Article 5 of the treaty says what the states owe one another"
    for name in ("legal", "search", "comments-on-the-law", "related-work", "notice", "menu-history", "header-files-explained"):
        for at in ("class", "id"):
            assert text(f"<div {at}='{name}'><p>{prose}</p></div>") == [prose], name
            assert text(f"<section {at}='wide {name}'><p>{prose}</p><p>All rights reserved</p></section>") == [prose], name
            assert text(f"<article><p {at}='{name}'>{prose}</p></article>") == [prose], name
    for name in ("footer", "site-footer", "sidebar-left", "user-comments", "cookie-notice", "nav", "main-menu", "wide related-posts", "ad-slot-2", "Newsletter_Box"):
        assert text(f"<div class='{name}'><p>{prose}</p></div><p>x</p>") == ["x"], name
    assert text(f"<p><a href=x>{prose}</a></p><p>x</p>") == [prose, "x"]
    assert text("<p><a href=x>Home</a> <a href=y>About</a></p><div><a href=x>Home</a></div><p>x</p>") == ["x"]
    assert text("<article><p>x</p></article><article class='card'><p>read this, too</p></article>") == ["x"]
    assert text("<article class='card'><p>a</p></article><article class='card'><p>b</p></article>") == ["a", "b"]


def test_runs_are_cut(spark):
    """Own words beside shared ones stay and the shared ones go, however much of the block or the article is shared; the array alone decides, on every page of the corpus."""
    say = random.Random(11)
    draw = lambda n: " ".join(f"w{say.randrange(10**6)}" for _ in range(n))
    long, short, foot = draw(60), draw(10), draw(12)
    own = [[draw(9), draw(30), draw(40)] for _ in range(20)]
    rows, want = [], {}
    for i, (a, b, c) in enumerate(own):
        # An article with a notice longer than its own words, and one in the midst of a paragraph.
        rows.append((i, f"http://in.org/{i}", f"<article><p>{a} {short}</p><p>{b}</p><p>{long}</p></article>"))
        want[i] = f"{a}\n{b}"
        # No telling tag or name.
        rows.append((100 + i, f"http://out.org/{i}", f"<div><div>{foot}</div><div>{a} {short} {b}</div><div>{c} {foot}</div></div>"))
        want[100 + i] = f"{a} {b}\n{c}"
        # A doubtful name: what repeats goes, what doesn't stays.
        rows.append((200 + i, f"http://doubt.org/{i}", f"<div class='legal'><p>{foot}</p><p>{b}</p></div><div>{c}</div>"))
        want[200 + i] = f"{b}\n{c}"
        # Near copies of an article, with a word changed here and there.
        w = long.split(" ")
        w[10], w[40] = f"x{i}", f"y{i}"
        rows.append((300 + i, f"http://near.org/{i}", f"<article><p>{' '.join(w)}</p></article>"))
        want[300 + i] = " ".join(w)
    assert texts(spark, rows) == want
    tags = {i: "\n".join(candidates(html)[0]) for i, _, html in rows}
    assert sum(tags[i] != want[i] for i in want) == 60


def test_long_and_deep_pages():
    """Time in proportion to the page, however deep its elements nest or however many are left open."""
    def took(page):
        t = time.process_time()
        blocks(page)
        return time.process_time() - t

    for make in (lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<p><b>" * n + "x", lambda n: "<div>" * n + "</i>" * n, lambda n: "<p>" + "<span>" * n + "<div>" * n, lambda n: "<a title='" * n, lambda n: "<!-- " * n):
        small, large = min(took(make(5000)) for _ in range(3)), min(took(make(40_000)) for _ in range(2))
        assert large < 24 * small + 0.1
    assert candidates("<article><p>" + "word " * 300_000 + "</p></article>")[0] == [("word " * 300_000).strip()]


def test_host():
    assert [host_of(u) for u in ("http://A.com:80/x", "//u@b.org?q", None, "nonsense", "https://c.net#d")] == ["a.com", "b.org", "", "", "c.net"]


def test_table(spark, sf_dir):
    """Every page of the table has an article, repeated by no notice: its text, cut by a plain pattern, comes out whole."""
    import html as entities

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got.values())
    for p in pages.collect():
        inner = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert got[p.page_id].text == "\n".join(x for x in want if x)
