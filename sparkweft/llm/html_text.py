"""Main text of web pages by host suffix arrays (operator 2).

A page is cut into blocks at its block-level tags. The blocks of a host's
pages form one token stream, and the stream's suffixes are sorted by rank
doubling: suffixes that share their first ``LONG`` tokens stand together, and
those that come from ``COMMON`` of the host's distinct pages, and ``FEWEST``
pages at least, begin a long substring that the host repeats. (A longer
repeated substring is a chain of such places, so no deeper order is needed.)
The tokens that such substrings cover are boilerplate and are cut out, within a
block, too; unique runs stay, down to single words.

Pages of equal text count once, so mirrored pages are no repetition. Inside an
article a run goes only if half of the host's distinct pages repeat it. A page
or article that is one repeated run from end to end is a mirror and stays, as
does an article that is mostly repeated and has no run of ``LONG`` words of its
own: near copies of an article stay whole.

Large hosts are dealt into shards of about ``SHARD`` characters by their
text's hash, each with a suffix array of its own. A substring common on the
host is as common in one of its shards at least; so the shards' common
substrings are the candidates, every distinct page of the host is searched for
them, and the sums decide. The result does not depend on the shards.

Tags are hints: where a page has article elements, text is what stands in
them (else in main, else anywhere); articles named as teasers go where others
are not. Menus, headers and footers of a page, sidebars, forms, hidden elements
and the like are known by tag and role, and by class and id where the whole
name means nothing else. A name that only holds such a word is a doubt:
outside an article its blocks stay if they are ``LONG`` words or more of
unlinked text, which the array can judge, and go if shorter. Null and empty
pages give the empty text. Repeated rows give a row each; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import byte_view, grams, lean, null_as_empty, rows_of, stored, words

#: Tokens of a long substring; characters of a shard, about.
LONG, SHARD = 8, 16_000_000
#: Share of a host's distinct pages from which a substring is boilerplate outside and inside an article, and pages at least.
COMMON, COMMON_INSIDE, FEWEST = 0.1, 0.5, 3
#: Share of a page in one common run from which it is a copy, not boilerplate; share of an article without a long run of its own in common runs.
MIRROR, MIRROR_INSIDE = 0.8, 0.5
#: Rows of a host table that may be broadcast: some 100 bytes each.
FEW_HOSTS, FEW_WINDOWS = 100_000, 1_000_000

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "textarea", "title"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
OUT_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "head", "button", "dialog"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "toolbar", "dialog", "alert", "alertdialog"}
#: Words of class and id names that make it doubtful, outside an article, whether the element holds text of one.
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|byline|footer|sidebar|side-bar|rail|widget\w*|related|recommend\w*|share|sharing|social|comments?|comment-?list|respond|disqus|replies|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|pagination|pager|toolbar|skip-?link|disclaimer|copyright|legal)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Words that decide, if a name has no others than these, doubtful ones and words for parts of a page.
CERTAIN = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr",
    "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "pager", "pagination", "popup", "promo", "promotion", "rail", "recommendations", "recommended", "related",
    "sharing", "sidebar", "signup", "skip", "social", "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
UNSURE = {"copyright", "disclaimer", "legal", "notice", "overlay", "replies", "respond", "search", "share"}
PARTS = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "form", "global", "group", "icon", "icons", "inner", "item", "items", "left", "link", "links",
    "list", "main", "outer", "page", "panel", "post", "posts", "primary", "reader", "right", "row", "secondary", "section", "side", "site", "slot", "stories", "story", "text", "thread", "top", "unit", "user", "wrap", "wrapper",
}
#: Whole class and id names whose element holds no article text inside an article either.
INNER_NAMES = re.compile(
    r"(?:^|\s)(?:ads?|adverts?|advertisement|sponsored|promo|(?:reader-|user-)?comments?(?:-list|-section|-form|-area)?|respond|disqus(?:_thread)?|replies|(?:social-)?(?:share|sharing)(?:-bar|-buttons?|-links?)?|social(?:-links|-bar)?|newsletter(?:-signup|-box)?|subscribe(?:-box)?|signup|cookies?-?(?:notice|banner|consent)?|gdpr|popup|modal|breadcrumbs?|pagination|pager|toolbar|sidebar|widget|skip-?link|related-(?:posts|articles|links|stories))(?=$|\s)",
    re.IGNORECASE,
)
#: Names of articles that stand for others.
TEASER = re.compile(r"(?:^|[\s_-])(?:card|teaser|preview|tile)(?=$|[\s_-])", re.IGNORECASE)
CLOSES = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _certain(names: str) -> bool:
    """Whether one of several class or id names says nothing but that its element holds no article text."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[_-]+|\d+", name) if w]
        if any(w in CERTAIN for w in words) and all(w in CERTAIN or w in UNSURE or w in PARTS for w in words):
            return True
    return False


def _out(tag: str, attrs: str, inside: bool) -> int:
    """What an element's tag and attributes say of article text in it: OUT (it holds none), DOUBT, TEASED (an article that stands for another) or 0. Headers inside an article are its own."""
    if tag in OUT_TAGS and not (inside and tag == "header"):
        return OUT
    if "=" not in attrs and "hidden" not in attrs:
        return 0
    found = 0
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in OUT_ROLES:
            return OUT
        if name == "style" and _HIDDEN.search(value):
            return OUT
        if name not in ("class", "id"):
            continue
        if inside:
            if INNER_NAMES.search(value):
                return OUT
        elif tag == "article":
            found = found or TEASED * bool(TEASER.search(value))
        elif tag not in ("html", "body", "main") and OUT_NAMES.search(value):
            if _certain(value):
                return OUT
            found = DOUBT
    return found


#: Where a block stands: in an article, in main, in something that holds no text, or perhaps none, in a teaser.
ARTICLE, MAIN, OUT, DOUBT, TEASED = 1, 2, 4, 8, 16


def blocks(page: str) -> list[tuple[str, int, float]]:
    """(text, where it stands, share of link characters, 0 for a paragraph of one link) of every block with text. Each tag costs its own length and the elements that it closes."""
    found: list[tuple[str, int, float]] = []
    parts: list[str] = []
    linked = links = 0
    stack: list[tuple[str, int]] = []  # open elements, and what each says of its text
    opened: dict[str, int] = {}  # how often each tag is open
    said = {0: 0, OUT: 0, DOUBT: 0, TEASED: 0}  # by how many open elements

    def close() -> None:
        nonlocal linked, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                where = ARTICLE * (opened.get("article", 0) > 0) | MAIN * (opened.get("main", 0) > 0) | sum(k for k, n in said.items() if n)
                found.append((text, where, 0.0 if links == 1 and opened.get("p") else min(1.0, linked / len(text))))
            parts.clear()
        linked, links = 0, opened.get("a", 0)

    def pop() -> str:
        tag, told = stack.pop()
        said[told] -= 1
        opened[tag] -= 1
        return tag

    def say(text: str) -> None:
        nonlocal linked
        text = entities.unescape(text) if "&" in text else text
        parts.append(text)
        if opened.get("a"):
            linked += len(text)

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                close()
            if opened.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in RAW:
            # Ends at its own end tag, whatever stands between.
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCK:
            close()
            while stack and tag in CLOSES.get(stack[-1][0], ()):
                pop()
            if tag not in ("br", "hr") and opened.get("p"):
                while pop() != "p":
                    pass
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        told = _out(tag, m[3], opened.get("article", 0) > 0)
        stack.append((tag, told))
        opened[tag] = opened.get(tag, 0) + 1
        said[told] += 1
        links += tag == "a"
    close()
    return found


def candidates(page: str) -> tuple[list[str], bool]:
    """Blocks that may be text, by the tags alone, and whether they stand in an article."""
    found = [(t, where, link) for t, where, link in blocks(page) if not where & OUT and not (where & DOUBT and (link >= 0.5 or t.count(" ") < LONG - 1))]
    for kind in (ARTICLE, MAIN):
        if mine := [(text, where & TEASED) for text, where, _ in found if where & kind]:
            whole = any(not teased for _, teased in mine)
            return [text for text, teased in mine if not (whole and teased)], True
    return [text for text, _, link in found if link < 0.5], False


def suffix_ranks(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, rank of every suffix by its first ``depth`` tokens), by rank doubling; suffixes that end early come first."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth:
        step = min(width, depth - width)
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        new = np.concatenate(([0], np.cumsum(both[order][1:] != both[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        width += step
    return order, rank


def page_counts(tokens: np.ndarray, page: np.ndarray, page_end: np.ndarray, depth: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """(place, pages) of one suffix of each group that shares its first ``depth`` tokens, and how many pages the group comes from. page_end: where each token's page ends in the stream."""
    order, rank = suffix_ranks(tokens, depth)
    at = order[(np.arange(len(tokens)) + depth <= page_end)[order]]
    if not len(at):
        return at, at
    r, p = rank[at], page[at]
    # Sorted by rank, then place: pages come in order within a group.
    new = np.concatenate(([True], r[1:] != r[:-1]))
    other = new | np.concatenate(([True], p[1:] != p[:-1]))
    first = np.flatnonzero(new)
    return at[first], np.add.reduceat(other.astype(np.int64), first)


def cover(hashes: np.ndarray, size: int, known: np.ndarray, share: np.ndarray, depth: int = LONG) -> np.ndarray:
    """For each of a page's ``size`` tokens the greatest share of pages that repeat a substring over it; hashes: of its substrings, in order."""
    out = np.zeros(size)
    if not len(known) or not len(hashes):
        return out
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    value = np.where(known[at] == hashes, share[at], 0.0)
    for k in range(depth):
        np.maximum(out[k : k + len(value)], value, out=out[k : k + len(value)])
    return out


def runs(mark: np.ndarray) -> np.ndarray:
    """Lengths of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.astype(np.int8), [0]))))
    return edges[1::2] - edges[::2]


def main_text(texts: list[str], inside: bool, sizes: np.ndarray, shares: np.ndarray) -> str:
    """One page's blocks without their common runs; sizes: tokens of each block, shares: of each token, the share of pages that repeat it."""
    common = shares >= (COMMON_INSIDE if inside else COMMON)
    if common.any():
        copy = runs(common).max() >= MIRROR * len(common)
        if inside and not copy:
            copy = common.mean() >= MIRROR_INSIDE and runs(~common).max(initial=0) < LONG
        if not copy:
            first = np.concatenate(([0], np.cumsum(sizes)))
            own = []
            for text, a, b in zip(texts, first[:-1], first[1:]):
                if common[a:b].any():
                    text = " ".join(w for w, gone in zip(text.split(" "), common[a:b]) if not gone)
                if text:
                    own.append(text)
            texts = own
    return "\n".join(texts)


_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("content", pa.int64()), ("n", pa.int64()), ("first", pa.bool_()), ("inside", pa.bool_()), ("blob", pa.binary())])
_PARSED_SQL = "page_id long, url string, host string, content long, n long, first boolean, inside boolean, blob binary"
#: Texts that a parsing task remembers, to tell which it has met.
MET = 1 << 20


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    import zstandard

    press, met = zstandard.ZstdCompressor(), set()
    for batch in batches:
        urls = rows_of(batch, "url").to_pylist()
        hosts = [host_of(u) for u in urls]
        found = [candidates(x.as_py()) for x in rows_of(batch, "html")]
        # Blocks hold no line break.
        texts = ["\n".join(t).encode() for t, _ in found]
        content = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts]
        first = []
        for key in zip(hosts, content):
            first.append(key not in met)
            if len(met) < MET:
                met.add(key)
        yield pa.RecordBatch.from_arrays(
            [rows_of(batch, "page_id"), pa.array(urls, pa.string()), pa.array(hosts, pa.string()), pa.array(content, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(first, pa.bool_()), pa.array([i for _, i in found], pa.bool_()), pa.array([press.compress(t) for t in texts], pa.binary())],
            schema=_PARSED,
        )


def unpack(blob: bytes, press) -> list[str]:
    raw = press.decompress(blob).decode()
    return raw.split("\n") if raw else []


def tokens_of(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes of all pages, tokens of each block, first block of each page)."""
    texts = pa.array([b for p in pages for b in p], pa.string())
    cuts = np.concatenate(([0], np.cumsum([len(p) for p in pages])))
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), cuts
    raw, ends = byte_view(texts)
    _, _, tokens, first = words(raw, ends)
    return tokens, np.diff(first), cuts


_COUNTS = pa.schema([("host", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _common_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards sorted by host, shard and content: long substrings that are as common there as on the whole host, at least, with their pages in the shard."""
    import zstandard

    press = zstandard.ZstdDecompressor()

    def close(host: str, pages: list, many: int) -> Iterator[pa.RecordBatch]:
        tokens, sizes, cuts = tokens_of(pages)
        per = np.array([sizes[a:b].sum() for a, b in zip(cuts[:-1], cuts[1:])], np.int64)
        page = np.repeat(np.arange(len(pages)), per)
        at, n = page_counts(tokens, page, np.cumsum(per)[page] if len(page) else page)
        keep = n * many >= least(many) * len(pages)
        if keep.any():
            with np.errstate(over="ignore"):
                hashes = grams(tokens, LONG)[at[keep]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(hashes), pa.string()), pa.array(hashes), pa.array(n[keep])], schema=_COUNTS)

    now, last, pages, many = None, None, [], 0
    for batch in batches:
        for host, shard, content, pages_of_host, blob in zip(*(rows_of(batch, c).to_pylist() for c in ("host", "shard", "content", "pages", "blob"))):
            if (host, shard) != now:
                if pages:
                    yield from close(now[0], pages, many)
                now, last, pages, many = (host, shard), None, [], pages_of_host
            if content != last:
                last = content
                pages.append(unpack(blob, press))
    if pages:
        yield from close(now[0], pages, many)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of its host's sorted candidates each page holds, by their places in that list; pages that hold none are left out."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, places = [], []
        tokens, sizes, cuts = tokens_of([unpack(b, press) for b in rows_of(batch, "blob").to_pylist()])
        first = np.concatenate(([0], np.cumsum(sizes)))[cuts]
        with np.errstate(over="ignore"):
            hashes = grams(tokens, LONG).view(np.int64)
        for i, known in enumerate(rows_of(batch, "known")):
            names, mine = known.values.to_numpy(), np.unique(hashes[first[i] : max(first[i], first[i + 1] - LONG + 1)])
            at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
            if (hit := names[at] == mine).any():
                rows.append(i)
                places.append(at[hit].astype(np.int32))
        keep = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([rows_of(batch, "host").take(keep), rows_of(batch, "content").take(keep), pa.array(places, pa.list_(pa.int32()))], names=["host", "content", "held"])


def least(pages: int) -> int:
    """Pages that a common substring of a host of so many distinct pages has."""
    return max(FEWEST, int(np.ceil(COMMON * pages)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        pages = [unpack(b, press) for b in rows_of(batch, "blob").to_pylist()]
        tokens, sizes, cuts = tokens_of(pages)
        first = np.concatenate(([0], np.cumsum(sizes)))
        with np.errstate(over="ignore"):
            hashes = grams(tokens, LONG).view(np.int64)
        out = []
        for i, (texts, inside, known, share) in enumerate(zip(pages, rows_of(batch, "inside").to_pylist(), rows_of(batch, "known"), rows_of(batch, "share"))):
            a, b = first[cuts[i]], first[cuts[i + 1]]
            names = np.array(known.as_py() or [], np.int64)
            shares = cover(hashes[a : max(a, b - LONG + 1)], b - a, names, np.array(share.as_py() or [], np.float64))
            out.append(main_text(texts, inside, sizes[cuts[i] : cuts[i + 1]], shares))
        yield pa.RecordBatch.from_arrays([rows_of(batch, "page_id"), rows_of(batch, "url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _few(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast a table only behind a check of its size; beyond, the join moves both sides."""
    return F.broadcast(df) if rows <= most else df


def extract(pages: DataFrame, shard: int = SHARD) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``."""
    rows = null_as_empty(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), "html")
    parsed = stored(rows.mapInArrow(lean(_parse), _PARSED_SQL), "parsed")
    once = parsed.where("first and n > 0")
    # A text met by several tasks counts once for the pages; for the size of shards it may count a few times.
    counted = once.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    sizes = once.groupBy("host").agg(F.ceil(F.sum("n") / shard).cast("long").alias("shards"))
    hosts = stored(counted.join(sizes, "host").where(F.col("pages") >= FEWEST).withColumn("shards", F.greatest("shards", F.lit(1))), "hosts")
    many = hosts.count()

    there = once.select("host", "content", "blob").join(_few(hosts, many, FEW_HOSTS), "host").withColumn("shard", F.pmod("content", F.col("shards")))
    dealt = there.repartition("host", "shard").sortWithinPartitions("host", "shard", "content")
    here = stored(dealt.mapInArrow(lean(_common_here), "host string, gram long, n long").join(_few(hosts, many, FEW_HOSTS), "host"), "candidates")
    # Hosts of several shards: what any shard holds common is looked for in every distinct page.
    asked = stored(here.where("shards > 1").groupBy("host", "pages").agg(F.array_sort(F.collect_set("gram")).alias("known")), "asked")
    told = asked.agg(F.sum(F.size("known")).alias("n")).first().n or 0
    held = once.select("host", "content", "blob").join(_few(asked, told, FEW_WINDOWS), "host").mapInArrow(lean(_held), "host string, content long, held array<int>")
    sums = held.distinct().select("host", F.explode("held").alias("at")).groupBy("host", "at").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.join(asked.select("host", "pages", F.posexplode("known").alias("at", "gram")), ["host", "at"])
    cols = ["host", "gram", "n", "pages"]
    common = here.where("shards = 1").select(cols).unionByName(sums.select(cols))
    common = common.where(F.col("n") >= F.greatest(F.lit(FEWEST), F.ceil(F.lit(COMMON) * F.col("pages"))))
    # Bounded by the tokens of some ten pages a host, whatever its size.
    lists = common.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("gram", (F.col("n") / F.col("pages")).alias("share")))).alias("known"))
    lists = stored(lists.select("host", F.col("known.gram").alias("known"), F.col("known.share").alias("share")), "common")
    told = lists.agg(F.sum(F.size("known")).alias("n")).first().n or 0
    out = parsed.select("page_id", "url", "host", "inside", "blob").join(_few(lists, told, FEW_WINDOWS), "host", "left")
    return out.mapInArrow(lean(_texts), "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
