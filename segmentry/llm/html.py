"""Main text of web pages by paths that the pages of a host agree on.

A page is read into blocks of text, each with the containers it stands in. Containers are scored by the text of their
blocks less what is linked; what stands inside an article or a main element counts for the whole of it. The generalised path of a container (tags and classes from the body down, digits replaced)
collects its score on all pages of its host in Spark, so pages on which the article is short or a box is long are
outvoted. Each page is then read again and gives the blocks of the highest-ranked path of its host that it has; a page
that has none of them gives those of its own best container.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and comments are left by tag, role and class;
of a header inside an article the headings stay. Character references are decoded, white space in a block becomes one
space, and blocks are joined by line feeds.

Defined results: a null or empty page, and one without text, gives an empty text; a null or odd address is the host "";
repeated rows give equal texts; ties between paths go to the less deep, then the first by digest; an empty table
gives an empty result; extra columns are ignored. Reading is linear in the page, also for containers that are never
closed; the distance-weighted scores take one vector addition over the depth for each container with text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.llm.common import small_side, written

# A path wins with at least this share of the votes of its host's best path.
LEAST_SHARE = 0.05
# Up to so many winning paths travel with a host; pages of a host with more look theirs up by a join.
LISTED = 64
# Hosts whose lists are broadcast (at most 1 KB each); more are joined by shuffle.
HOSTS = 100_000

# A comment, a declaration, a tag, the rest of a tag that never ends, text, a stray sign.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[a-zA-Z/][^>]*\Z|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg select annotation annotation-xml".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br svg annotation annotation-xml math semantics mi mn mo ms mrow mtext mspace msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mfenced menclose mtable mtr mtd mmultiscripts".split())
_LEFT_TAGS = frozenset("nav footer aside form button head dialog menu object audio video canvas fieldset datalist".split())
_CONTAINERS = frozenset("body main article section div td center".split())
_KEPT_TAGS = frozenset("html body main article".split())
_ARTICLE = re.compile(r"""\brole\s*=\s*["']?(article|main)\b|\bitemprop\s*=\s*["']?(article)Body\b""", re.I)
_HEADINGS = frozenset("h1 h2 h3".split())
_LEFT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
# Words that mark a class or id as not belonging to the article.
_LEFT_WORD = re.compile(
    r"(?:nav|navbar|navigation|menu|footer|header|masthead|topbar|sidebar|side|aside|ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|promo|promotion"
    r"|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|recommended"
    r"|recommendations|comment|comments|disqus|respond|reply|replies|discussion|breadcrumb|breadcrumbs|pagination|pager|toolbar|widget|copyright|hidden)")
# Words that may stand beside them in a name ("post-footer", "ad-slot-1"). Beside any other word ("share-price", "side-by-side") they mark nothing inside an article.
_BESIDE = re.compile(
    r"(?:\d+|box|bar|block|area|unit|slot|wrap|wrapper|container|inner|outer|section|module|panel|list|links|link|items|item|buttons|button|icons|icon|text|content|top|bottom|left|right|main|global|site"
    r"|page|post|article|entry|story|blog|news|user|users|reader|readers|form|area|thread|count|title|mobile|desktop|sticky|fixed|js|c|l|u|o|m|the|to|more|in|us|up|of|for|primary|secondary|tools|tool)")
# Names that a section of an article may have as its subject.
_SUBJECTS = frozenset("discussion related".split())
# A class such as "with-sidebar" or "no-ads" describes a page, not a box.
_ABOUT_PAGE = re.compile(r"^(?:with|has|have|no|without|is|not|single|page|layout|js)[-_]")
_CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
_SCOPE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "p": "div article section td body"}


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    container: int


@dataclass
class Page:
    """Blocks in page order; containers by number (a parent before its children): path, as a digest of the parent's path and the name, parent, depth."""

    blocks: list[Block] = field(default_factory=list)
    paths: list[bytes] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)  # "article", "main" or empty


def _marks(tag: str, word: str, inside: bool) -> bool:
    """Whether a class or id tells that an element is not part of the article; inside of one its whole name has to."""
    if _ABOUT_PAGE.match(word):
        return False
    parts = [part for part in re.split(r"[-_]+", word) if part]
    hits = [part for part in parts if _LEFT_WORD.fullmatch(part)]
    if not inside or not hits:
        return bool(hits)
    return not (tag == "section" and word in _SUBJECTS) and all(part in hits or _BESIDE.fullmatch(part) for part in parts)


def _left(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is not part of the article (``inside`` one: an article or main element), and its generalised class."""
    classes, words = "", ()
    if attributes and not attributes.isspace():
        found = {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
        classes = found.get("class", "")
        words = f"{classes} {found.get('id', '')}".lower().split()
        if tag not in _KEPT_TAGS and ("hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _LEFT_ROLES or "display:none" in found.get("style", "").replace(" ", "").lower()):
            return True, classes
    if tag in _LEFT_TAGS:
        return True, classes
    if tag in _KEPT_TAGS:
        return False, classes
    return any(_marks(tag, w, inside) for w in words), classes


def _path(parent: bytes, name: str) -> bytes:
    return hashlib.blake2b(parent + name.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def read_page(source: str) -> Page:
    page = Page([], [_path(b"", "body")], [-1], [0], [""])
    open_tags: Counter = Counter()
    stack: list[tuple[str, bool, bool, int]] = []  # tag, left, header of an article, container
    left = heads = 0
    container, pieces, linked, in_link = 0, [], 0, 0
    heading = False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            page.blocks.append(Block(text, min(linked, len(text)), heading, container))
        pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal left, heads, container, in_link
        tag, was_left, was_head, before = stack.pop()
        open_tags[tag] -= 1
        left -= was_left
        heads -= was_head
        container = before
        in_link -= tag == "a"

    position, end = 0, len(source)
    while position < end:
        m = _TOKEN.match(source, position)
        position = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue
            if not left and (not heads or heading):
                text = entities.unescape(text) if "&" in text else text
                pieces.append(text)
                if in_link:
                    linked += len(text)
            continue
        tag, attributes = tag.lower(), m[3]
        block = tag not in _INLINE
        if block:
            flush()
        if m[1]:
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            heading = any(s[0] in _HEADINGS for s in stack[-3:])
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, position)
            if tag == "template" or not attributes.endswith("/") or tag not in ("svg", "math"):
                position = close.end() if close else end
            continue
        if tag in _VOID:
            if tag == "br":
                pieces.append(" ")
            continue
        if block:
            # An open paragraph ends where a block begins; list items, rows and cells end at the next of their kind.
            ends, scope = _CLOSED_BY.get(tag, "p").split(), _SCOPE.get(tag, _SCOPE["p"]).split()
            for s in reversed(stack) if any(open_tags[t] > 0 for t in ends) else ():
                if s[0] in scope:
                    break
                if s[0] in ends:
                    while stack[-1] is not s:
                        pop()
                    pop()
                    break
        inside = open_tags["article"] > 0 or open_tags["main"] > 0
        out, classes = _left(tag, attributes, inside)
        head = False
        if tag == "header" or (out and "header" in classes.lower() and tag not in _LEFT_TAGS):
            out, head = not inside, inside
        before = container
        if tag in _CONTAINERS and not (tag == "body" and container == 0 and not page.blocks):
            name = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes.split()})])
            page.paths.append(_path(page.paths[container], name))
            page.parents.append(container)
            page.depths.append(page.depths[container] + 1)
            named = _ARTICLE.search(attributes) if attributes else None
            page.kinds.append(tag if tag in ("article", "main") else (named[1] or named[2]).lower() if named else "")
            container = len(page.paths) - 1
        stack.append((tag, out, head, before))
        open_tags[tag] += 1
        left += out
        heads += head
        in_link += tag == "a"
        heading = tag in _HEADINGS or (not block and heading)
    flush()
    return page


def container_scores(page: Page) -> dict[int, float]:
    """Score of each container: its own blocks count whole, those of containers inside by a half, a third and so on.

    What is inside an article, or else a main element, is taken for the outermost of them, which counts all of its blocks
    whole. A container is taken for its parent as long as the parent adds nothing but headings, so that titles are
    included, or, outside such elements, more text of its own than it adds from other containers.
    """
    n = len(page.paths)
    worth, direct, own = np.zeros(n), np.zeros(n), np.zeros(n)  # of what stands in a container directly: worth, length, worth without headings
    plain = np.zeros(n, dtype=bool)  # has direct text that is no heading
    for b in page.blocks:
        w = max(0.0, len(b.text) - 2.0 * b.linked)
        worth[b.container] += w
        direct[b.container] += len(b.text)
        if not b.heading:
            own[b.container] += w
            plain[b.container] = True
    whole, size = worth.copy(), direct.copy()
    kids = np.zeros(n, dtype=np.int64)  # children with text
    holds, holds_article = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)  # has an article or main element with text inside
    for c in range(n - 1, 0, -1):
        if size[c]:
            up, kind = page.parents[c], page.kinds[c]
            whole[up] += whole[c]
            size[up] += size[c]
            kids[up] += 1
            holds[up] |= holds[c] or kind != ""
            holds_article[up] |= holds_article[c] or kind == "article"
    scores = _distance_scores(page, worth)
    # The outermost article and main element around each container.
    around: dict[str, list[int]] = {"article": [], "main": []}
    for kind, outermost in around.items():
        for c, up in enumerate(page.parents):
            above = outermost[up] if up >= 0 else -1
            outermost.append(above if above >= 0 else c if page.kinds[c] == kind else -1)
    # What a container is taken for, by whether it neither stands in nor holds a marked element.
    taken: dict[bool, list[int]] = {False: [], True: []}
    for top, up in enumerate(page.parents):
        titles = up > 0 and kids[up] == 1 and not plain[up]
        for unmarked, tops in taken.items():
            within = up >= 0 and (unmarked and not holds[up] and page.kinds[up] == "" or around["main"][up] >= 0)
            rises = titles or within and own[up] > size[up] - direct[up] - size[top]
            tops.append(tops[up] if rises and up >= 0 else top)
    risen: dict[int, float] = {}
    for c in np.flatnonzero(size).tolist():
        article, main, s = around["article"][c], around["main"][c], float(scores[c])
        top = article if article >= 0 else main if main >= 0 else c
        if top == c and page.kinds[c] and (page.kinds[c] == "article" or not holds_article[c]):
            s = float(whole[c])
        top = taken[bool(article < 0 and main < 0 and not holds[c])][top]
        risen[top] = max(risen.get(top, 0.0), s)
    return risen


def _distance_scores(page: Page, worth: np.ndarray) -> np.ndarray:
    """Per container the worth of all containers in it, divided by one more than how far down they are."""
    scores, depths = np.zeros(len(worth)), page.depths
    share = 1.0 / np.arange(1, max(depths) + 2)
    at, total = [], np.zeros(max(depths) + 1)  # the open containers by depth, and their sums so far
    for c, depth in enumerate(depths):
        for closed in range(len(at) - 1, depth - 1, -1):
            scores[at.pop()] = total[closed]
            total[closed] = 0.0
        at.append(c)
        if worth[c] > 0:
            total[: depth + 1] += worth[c] * share[depth::-1]
    scores[at] = total[: len(at)]
    return scores


def page_votes(source: str | None) -> list[tuple[bytes, int, float]]:
    """Paths of a page's containers with their depth and their share of the page's best score."""
    page = read_page(source or "")
    scores = container_scores(page)
    best = max(scores.values(), default=0.0)
    votes: dict[bytes, tuple[int, float]] = {}
    for c, s in scores.items():
        if best > 0:
            votes[page.paths[c]] = max(votes.get(page.paths[c], (0, 0.0)), (page.depths[c], s / best))
    return [(path, depth, share) for path, (depth, share) in votes.items()]


def _with_text(page: Page) -> list[int]:
    """Containers with text in them."""
    used = {b.container for b in page.blocks}
    for c in range(len(page.paths) - 1, 0, -1):
        if c in used:
            used.add(page.parents[c])
    return sorted(used)


def page_text(source: str | None, paths: list[bytes]) -> str:
    """Blocks of the first of ``paths`` that the page has, or of its own best container."""
    page = read_page(source or "")
    have = {page.paths[c] for c in _with_text(page)}
    path = next((p for p in paths if p in have), None)
    if path is None:
        scores = container_scores(page)
        if not scores:
            return ""
        path = page.paths[max(scores, key=lambda c: (scores[c], -c))]
    chosen: list[bool] = []
    for own, up in zip(page.paths, page.parents):
        chosen.append(own == path or up >= 0 and chosen[up])
    return "\n".join(b.text for b in page.blocks if chosen[b.container])


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1), F.lit("")))


def _per_page(pages: DataFrame, columns: str, rows_of) -> DataFrame:
    """Rows of ``rows_of(html)`` after the first column of ``pages`` (``key, html``)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, *row) for key, source in zip(batch.column(0).to_pylist(), batch.column("html").to_pylist()) for row in rows_of(source)]
            types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in found], types[c.split()[1]]) for i, c in enumerate(columns.split(", "))], names=names)

    return pages.mapInArrow(run, columns)


def _votes(source: str | None) -> list[tuple[bytes, int, int]]:
    # Whole numbers add up alike in any order.
    counted = [(path, depth, int(round(share * 1000))) for path, depth, share in page_votes(source)]
    return [row for row in counted if row[2]]


def _text_paths(source: str | None) -> list[tuple[bytes]]:
    page = read_page(source or "")
    return [(path,) for path in {page.paths[c] for c in _with_text(page)}]


def path_votes(pages: DataFrame) -> DataFrame:
    """``host, path, depth, votes``: what the pages of a host give to each path."""
    cast = _per_page(pages.select(_host("url").alias("host"), "html"), "host string, path binary, depth int, votes bigint", _votes)
    return cast.groupBy("host", "path").agg(F.min("depth").alias("depth"), F.sum("votes").alias("votes"))


def host_paths(totals: DataFrame, listed: int | None = None) -> DataFrame:
    """``host, paths, best, crowded``: winning paths, best first, and the votes of the best; a crowded host has more than ``listed`` and no list."""
    listed = listed or LISTED
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "depth", "path"))).filter(F.col("rank") <= listed + 1)
    ordered = ranked.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "votes"))).alias("r"))
    best = F.get("r", F.lit(0))["votes"]
    winning = F.transform(F.filter("r", lambda x: x["votes"] >= LEAST_SHARE * best), lambda x: x["path"])
    crowded = F.size(winning) > listed
    return ordered.select("host", F.when(~crowded, winning).alias("paths"), best.alias("best"), crowded.alias("crowded"))


def _looked_up(pages: DataFrame, totals: DataFrame, hosts: DataFrame) -> DataFrame:
    """``page_id, url, html, paths`` of the pages of crowded hosts: the best winning path that each page has.

    Equal pages share one key and one answer.
    """
    crowded = hosts.filter("crowded").select("host", "best")
    key = F.sha2(F.to_json(F.struct("host", "html")), 256)
    rows = pages.join(small_side(crowded.select("host")), "host", "left_semi").withColumn("__key", key)
    won = totals.join(small_side(crowded), "host").filter(F.col("votes") >= LEAST_SHARE * F.col("best"))
    named = rows.select("__key", "host", "html").dropDuplicates(["__key"])
    had = _per_page(named.select(F.concat_ws(" ", "__key", "host").alias("key"), "html"), "key string, path binary", _text_paths)
    had = had.select(F.substring("key", 1, 64).alias("__key"), F.expr("substring(key, 66)").alias("host"), "path")
    first = had.join(won, ["host", "path"]).groupBy("__key").agg(F.min_by("path", F.struct(-F.col("votes"), "depth", "path")).alias("path"))
    return rows.join(first, "__key", "left").select("page_id", "url", "html", F.when(F.col("path").isNotNull(), F.array("path")).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(source, paths or []) for source, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    totals = written(path_votes(pages))
    hosts = written(host_paths(totals))
    named = pages.select("page_id", "url", "html", _host("url").alias("host"))
    listed = named.join(small_side(hosts.select("host", "paths", "crowded"), HOSTS), "host", "left").filter("crowded IS NULL OR NOT crowded").select("page_id", "url", "html", "paths")
    if not hosts.filter("crowded").isEmpty():
        listed = listed.unionByName(_looked_up(named, totals, hosts))
    return listed.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
