"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text they hold outside links and boilerplate; pages vote
with these scores on the generalised tag-class path of their best container, per host, in Spark;
each page is then extracted again with its host's winning path, or its own best container if the
path finds nothing there. An element inside it whose classes say in part only that it is no main
text is left out if the host's pages agree: if its blocks repeat on ``REPEATS`` different pages.
Pages are not shuffled while the winners fit ``BROADCAST_HOSTS``; with more, they are joined on the
host. A page is read once from left to right, in time and memory that grow with its length alone.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import columns, words

#: Winning paths and repeated blocks of hosts are broadcast up to so many (some 100 bytes each).
BROADCAST_HOSTS = 50_000
#: Pages of a host with different main text on which a doubtful block is that of the site.
REPEATS = 3
#: Share of doubtful text that counts for a container's score.
DOUBT = 0.3
# Elements without content or an end tag, and those of running text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
# Elements whose content is not parsed, and those that never hold main text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BOILERPLATE = frozenset("nav footer aside form noscript button select svg math template dialog menu canvas object audio video head fieldset".split()) | RAW
# Containers that can be a page's main one, and words that name such a container.
CONTAINERS = frozenset("body main article section div td center".split())
MAIN_WORDS = frozenset("article content entry main post story text body page wrapper container layout".split())
# Words of classes, ids and roles of what is no main text.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription sidebar sidebars aside widget widgets menu menus nav navbar navigation navigate breadcrumb breadcrumbs pagination pager share sharing social related recommended "
    "recommendations comment comments commentlist respond reply replies disqus footer header masthead toolbar login signup search complementary contentinfo dialog skip toc outbrain taboola copyright hidden".split()
)
# Words that say nothing by themselves beside one of SIDE_WORDS.
NEUTRAL = frozenset(
    "area bar bottom box button buttons col column count desktop fixed form global group heading holder icon icons inner item items left link links list main meta mobile module outer panel post posts "
    "primary region right row secondary section site slot small sticky stories title top unit wrap wrapper zone article articles block container content page".split()
)
# Elements of running text, which a class alone does not set aside.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption figure".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)")
_NOT_SHOWN = re.compile(r"display\s*+:\s*+none")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
#: Numbers beyond all code points, which are not worth their conversion.
_FAR_REFERENCE = re.compile(r"&#(?:0*+[0-9]{8,}|[xX]0*+[0-9a-fA-F]{7,});?")
#: Elements that end an open element of these names when they start.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table".split())
#: How sure it is that an element's text is not the article's.
MAIN, DOUBTFUL, SIDE = range(3)


def _named(token: str, heads: frozenset[str]) -> int:
    """What a class, id or role says; ``heads`` are words that say nothing here."""
    parts = [w.lower() for w in _WORD.findall(token)]
    if not parts or parts[0] in ("has", "with", "no", "without"):
        return MAIN
    if parts[-1] in SIDE_WORDS - heads or parts[0] in SIDE_WORDS - {"header", "masthead"} and not MAIN_WORDS & set(parts[1:]):
        return SIDE if all(p in SIDE_WORDS or p in NEUTRAL for p in parts) else DOUBTFUL
    return MAIN


def _standing(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """MAIN, DOUBTFUL or SIDE by an element's own name and attributes."""
    if tag in BOILERPLATE:
        return SIDE
    if tag in ("html", "body", "article", "main"):
        return MAIN
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _NOT_SHOWN.search(attributes.get("style", "")):
        return SIDE
    if tag == "header":
        return MAIN if in_article else SIDE
    heads = frozenset(("header", "masthead")) if in_article else frozenset()
    names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split()
    found = max((_named(token, heads) for token in names), default=MAIN)
    return DOUBTFUL if found == SIDE and tag in TEXT else found


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Generalised tag and classes: digits become #, so that numbered classes agree."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes]).replace(">", "_")


def _plain(raw: str) -> str:
    """Character references decoded, white space as one space."""
    if "&" in raw:
        raw = html.unescape(_FAR_REFERENCE.sub("\ufffd", raw))
    return _SPACE.sub(" ", raw).strip()


def block_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


def _tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it ends an element, name, attributes) of every tag; no name for comments and declarations.

    A quoted value may hold ``>`` but no ``<``; a tag that is malformed so far ends at the next
    ``>``. Each search goes on where an earlier one ended, or is limited by the next ``<``. The
    caller may send a position from which to go on.
    """
    size = len(source)
    at, close = source.find("<"), -1
    while at >= 0:
        after = source.find("<", at + 1)
        found = None
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            found = (at, size if end < 0 else end + 3, False, "", "")
        elif m := _TAG.match(source, at, after if after >= 0 else size):
            found = (at, m.end(), bool(m[1]), m[2].lower(), m[3])
        else:
            m = _LOOSE.match(source, at, after if after >= 0 else size)
            if m or source.startswith(("<!", "<?"), at):
                if close < at:
                    close = source.find(">", at)
                    close = size if close < 0 else close
                if close < size:
                    found = (at, close + 1, bool(m and m[1]), m[2].lower() if m else "", source[m.end() : close] if m else "")
        if found:
            on = yield found
            to = max(found[1], on or 0)
            after = after if after >= to else source.find("<", to) if to < size else -1
        at = after


class Page:
    """Blocks of text in page order, each with its container; containers with parent, path and a bonus.

    A path is a number: that of its parent's path and the step from there, so that a page's paths
    take no more memory than its tags.
    """

    def __init__(self, source: str):
        self.parent, self.path, self.bonus = [-1], [0], [0.5]
        self.steps: dict[tuple[int, str], int] = {}
        self.chain: list[tuple[int, str]] = [(-1, "")]
        self.blocks: list[tuple[str, int, int, bool]] = []  # text, container, characters in links, doubtful
        stack: list[tuple[str, int, int, bool]] = []  # tag, container, standing, in an article
        open_tags: dict[str, int] = {}
        buffer: list[str] = []
        linked = in_link = 0

        def flush():
            nonlocal linked
            if buffer:
                standing = stack[-1][2] if stack else MAIN
                text = "" if standing == SIDE else _plain("".join(buffer))
                if text:
                    self.blocks.append((text, stack[-1][1] if stack else 0, linked, standing == DOUBTFUL))
                buffer.clear()
            linked = 0

        def push(tag: str, *rest):
            stack.append((tag, *rest))
            open_tags[tag] = open_tags.get(tag, 0) + 1

        def pop() -> str:
            tag = stack.pop()[0]
            open_tags[tag] -= 1
            return tag

        at, size = 0, len(source)
        tags = _tags(source)
        m = next(tags, None)
        while True:
            to = m[0] if m else size
            if to > at:
                buffer.append(source[at:to])
                if in_link:
                    linked += to - at
            if not m:
                break
            _, at, ends, tag, raw = m
            go_on = None
            if not tag:
                pass
            elif ends:
                if tag in INLINE:
                    if tag == "a":
                        in_link = 0
                    if open_tags.get(tag):  # an inline element that was set aside
                        flush()
                        while pop() != tag:
                            pass
                else:
                    flush()
                    if open_tags.get(tag):
                        while pop() != tag:
                            pass
                        in_link = 0
            else:
                attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if "=" in raw else {}
                if "hidden" in raw and _HIDDEN.search(raw):
                    attributes["hidden"] = ""
                if tag in RAW:
                    end = _ENDS[tag].search(source, at)
                    end = source.find(">", end.start()) if end else -1
                    at = go_on = end + 1 if end >= 0 else size
                    if tag in ("textarea", "title", "iframe"):
                        flush()
                elif tag in VOID:
                    if tag == "hr":
                        flush()
                    elif tag == "br":
                        buffer.append(" ")
                else:
                    top = stack[-1] if stack else ("", 0, MAIN, False)
                    standing = _standing(tag, attributes, top[3])
                    if tag in INLINE:
                        if tag == "a":
                            in_link = 1
                        if standing == SIDE > top[2]:
                            flush()
                            push(tag, top[1], SIDE, top[3])
                    else:
                        flush()
                        closes = ("p", *_CLOSES.get(tag, ()))
                        if any(open_tags.get(name) for name in closes):  # implied end tags
                            for k in range(len(stack) - 1, -1, -1):
                                name = stack[k][0]
                                if name in closes:
                                    while len(stack) > k:
                                        pop()
                                    break
                                if name in CONTAINERS or name in _SCOPE and tag != "p":
                                    break
                        top = stack[-1] if stack else ("", 0, MAIN, False)
                        standing = max(top[2], _standing(tag, attributes, top[3]))
                        container = top[1]
                        if tag in CONTAINERS and standing < SIDE:
                            container = self._contain(container, tag, attributes)
                        push(tag, container, standing, top[3] or tag in ("article", "main"))
            try:
                m = tags.send(go_on)
            except StopIteration:
                m = None
        flush()

    def _contain(self, parent: int, tag: str, attributes: dict[str, str]) -> int:
        named = set(_WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('itemprop', '')}".lower()))
        step = self.path[parent], _step(tag, attributes)
        if step not in self.steps:
            self.steps[step] = len(self.chain)
            self.chain.append(step)
        self.parent.append(parent)
        self.path.append(self.steps[step])
        self.bonus.append(2.0 if tag in ("article", "main") else 0.5 if tag == "body" else 1.5 if named & MAIN_WORDS else 1.0)
        return len(self.parent) - 1

    def path_text(self, path: int) -> str:
        steps = []
        while path > 0:
            path, step = self.chain[path]
            steps.append(step)
        return "".join(f">{s}" for s in reversed(steps))

    def best(self) -> tuple[int, float]:
        """Path and score of the best container, the first of equals."""
        plain = [0.0] * len(self.parent)
        for text, c, linked, doubtful in self.blocks:
            plain[c] += max(0.0, len(text) - 1.5 * linked) * (DOUBT if doubtful else 1.0)
        for c in range(len(plain) - 1, 0, -1):  # a container's number is greater than its parent's
            plain[self.parent[c]] += plain[c]
        scores = [p * b for p, b in zip(plain, self.bonus, strict=True)]
        i = max(range(len(scores)), key=scores.__getitem__)
        return self.path[i], scores[i]

    def find(self, path: str) -> int:
        """The number of a path's text, -1 if the page does not have it."""
        at = 0
        for step in path.split(">")[1:]:
            at = self.steps.get((at, step), -1)
            if at < 0:
                break
        return at

    def within(self, path: int) -> list[tuple[str, bool]]:
        """Blocks inside every container of that path, and whether they are doubtful."""
        inside = [p == path for p in self.path]
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return [(t, doubtful) for t, c, _, doubtful in self.blocks if inside[c]]


def host_of(url: str = "url") -> F.Column:
    """Lower-case host of an URL, with or without a scheme before ``//``; empty if there is none.

    User, port and dots at the end are cut off; an address in brackets keeps them.
    """
    host = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns host, html to votes: (host, path, score) summed within the batch, and (host, block, page) of doubtful blocks."""
    for batch in batches:
        votes: dict[tuple[str, str], float] = {}
        doubts: set[tuple[str, int, int]] = set()
        for host, source in zip(batch.column(0).to_pylist(), words.text_bytes(batch.column(1)), strict=True):
            page = Page(source.decode("utf-8", "replace"))
            path, score = page.best()
            if score > 0:
                votes[host, page.path_text(path)] = votes.get((host, page.path_text(path)), 0.0) + score
            if any(b[3] for b in page.blocks):
                sure = block_key("\n".join(b[0] for b in page.blocks if not b[3]))
                doubts.update((host, block_key(b[0]), sure) for b in page.blocks if b[3])
        more = list(doubts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([h for h, _ in votes] + [d[0] for d in more], pa.string()),
                pa.array([p for _, p in votes] + [None] * len(more), pa.string()),
                pa.array([*votes.values(), *[0.0] * len(more)], pa.float64()),
                pa.array([None] * len(votes) + [d[1] for d in more], pa.int64()),
                pa.array([None] * len(votes) + [d[2] for d in more], pa.int64()),
            ],
            names=["host", "path", "score", "block", "page"],
        )


def extract(source: str, winner: str | None = None, repeated: frozenset[int] = frozenset()) -> str:
    """The page's text: inside the winner, or its own best container, without doubtful blocks that repeat."""
    page = Page(source)
    path = page.find(winner) if winner is not None else -1
    blocks = page.within(path) if path >= 0 else []
    if not blocks:
        path, score = page.best()
        blocks = page.within(path if score > 0 else 0)
    return "\n".join(t for t, doubtful in blocks if not (doubtful and repeated and block_key(t) in repeated))


def _extract(known, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of n columns and host, html, or html, path, blocks if nothing is broadcast, to the n columns and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if known is None:
                found = [(p, frozenset(b or ())) for p, b in zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True)]
                htmls = batch.column(n)
            else:
                found = [known.value.get(h, (None, frozenset())) for h in batch.column(n).to_pylist()]
                htmls = batch.column(n + 1)
            texts = [extract(s.decode("utf-8", "replace"), *w) for s, w in zip(words.text_bytes(htmls), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=[*batch.schema.names[:n], "text"])

    return run


def host_winners(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, blocks): each host's winning path, null if no page of it has text, and the keys of doubtful blocks that repeat."""
    votes = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(words.lean(_vote), "host string, path string, score double, block long, page long")
    counted = votes.groupBy("host", "path", "block").agg(F.round(F.sum("score"), 3).alias("score"), F.countDistinct("page").alias("n"))
    best = F.max(F.when(F.col("path").isNotNull(), F.struct("score", F.length("path"), F.expr("path"))))
    return counted.groupBy("host").agg(best.alias("w"), F.collect_list(F.when(F.col("n") >= REPEATS, F.col("block"))).alias("blocks")).select("host", F.col("w.path").alias("path"), "blocks")


def extract_text(spark: SparkSession, pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with its html replaced by the column text (replaced if it exists).

    Null and empty html have an empty text; a null url or one without a host votes with its like.
    Ties between paths go to the longer path, then to the last by code point; repeated rows vote
    each, but a page and its copies are one page for what repeats on a host.
    """
    scratch = Scratch(spark, "html")
    own = [c for c in columns.others(pages, "text") if c != html_col]
    winners = scratch.table(host_winners(pages, url_col, html_col), "winners")
    if (winners.agg(F.sum(1 + F.size("blocks"))).first()[0] or 0) <= BROADCAST_HOSTS:
        known = spark.sparkContext.broadcast({r[0]: (r[1], frozenset(r[2])) for r in winners.collect()})
        return columns.mapped(pages, own, _extract(known, len(own)), "text string", host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    rows = pages.select(columns.packed(own), host_of(url_col).alias("host"), F.col(html_col).alias("html")).join(winners, "host", "left")
    rows = rows.select(*columns.unpacked(own), F.struct("html", "path", "blocks").alias(given := columns.free(own)))
    return columns.mapped(rows, own, _extract(None, len(own)), "text string", *[F.col(given)[x].alias(x) for x in ("html", "path", "blocks")])


def op8_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    found = extract_text(spark, pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
