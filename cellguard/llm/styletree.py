"""Main-text extraction with a site style tree.

The DOMs of one host's pages are merged: a node of the site's tree is a path of block elements with their classes and
ids (digits masked). A node has, over the ``m`` pages that show it,

* content: the distinct block texts below it (digits masked). A text on ``k`` of the ``m`` pages has entropy
  ``log k / log m``; content importance is one less the mean entropy, so what every page repeats has none;
* presentation: the distinct sequences of inline tags and blocks by which pages lay it out. Its importance is the
  entropy, to base ``m``, of the pages over the ``l`` sequences;
* composite importance ``(1 - g**l) * presentation + g**l * content`` with ``g`` = 0.9.

Blocks of nodes below ``LOW`` leave the page. A node on fewer than ``LEAST_PAGES`` pages has no evidence against it.

Mark-up whose meaning is fixed is taken at its word beside the tree, for two reasons: a host of few pages has no
evidence, and copies of one article on a host look like boilerplate. So navigation, forms, adverts and the like (by
element, role or class word) never stay; if a page has an ``article`` (else ``main``), only what is in it can stay, and
plain paragraphs and headings directly in it always do. If nothing would stay, the tree's verdict on the page is void.

Distribution: pages are parsed in tasks; (host, node, text) counts are aggregated partially before the shuffle, so a
host that holds a third of all pages is a few rows a task. The low nodes of the hosts, a row a host, are written
first, so that Spark knows their size: it broadcasts them if small, and else joins by host, splitting hot hosts. The
html itself is shuffled only then.

Defined results. Null or empty html gives an empty text; a page without a host is judged by its mark-up alone; repeated
rows count as often as they stand and each gives a row; other columns are ignored. An unclosed comment or tag runs to
the end of the page. White space is what Unicode calls so, no-break spaces included; a line break element is white
space.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellguard.session import cut_lineage

DAMPING, LOW, LEAST_PAGES = 0.9, 0.4, 3

# Element names of HTML by their role here, and words that name noise in classes, ids and roles.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style title textarea noscript template iframe svg math object canvas audio video noembed noframes "
             "xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span "
             "strike strong sub sup time tt u var ruby rt rp img wbr br".split())
NOISE = set("nav footer aside form button select option datalist fieldset menu dialog head".split())
CONTENT = set("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption figure "
              "figcaption header".split())
WORDS = set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav "
            "navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar cookie cookies consent gdpr "
            "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share "
            "sharing social related recommended comment comments commentlist disqus reply replies respond discussion "
            "widget widgets toolbar pagination pager copyright search complementary contentinfo dialog form".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "menu", "dl", "table", "select"}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]{0,65536}+"|'[^']{0,65536}+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOST_PATTERN = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
HOST = re.compile(HOST_PATTERN)
DIGITS = re.compile(r"\d+")
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
MAINS = ("article", "main")


def host_of(url: str | None) -> str | None:
    found = HOST.match(url or "")
    return found.group(1).lower() if found else None


@dataclass(slots=True)
class Block:
    """One block of text: its node in the site tree, the inline tags in it, and what its mark-up says."""

    node: str
    text: str
    inline: str
    noise: bool
    main: str  # article or main if one is around it, or nothing
    plain: bool  # directly in the innermost of them, in content elements without class or id


@dataclass(slots=True)
class Element:
    tag: str
    step: str  # its part of the node
    noise: bool


def element(tag: str, attributes: str, in_main: bool) -> tuple[Element, str]:
    """The element and, if it holds main text, as what."""
    found: dict[str, str] = {}
    if "=" in attributes or "hidden" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), "".join(values))
    words = set()
    for name in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        parts = NAME.findall(CAMEL.sub(" ", name).lower())
        if parts[:1] not in (["has"], ["with"], ["no"]):
            words.update(parts)
    if in_main or tag in HEADINGS:
        words.discard("header")
    noise = tag in NOISE or tag == "header" and not in_main or "hidden" in found or (
        found.get("aria-hidden", "").lower() == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower()
        or tag not in ("html", "body", "main") and bool(words & WORDS))
    role = found.get("role", "").lower()
    main = role if role in MAINS else "article" if "articlebody" in found.get("itemprop", "").lower() else tag
    names = [*sorted(found.get("class", "").split()), *("#" + x for x in found.get("id", "").split())]
    step = "" if tag in ("html", "body") else ".".join([tag, *(DIGITS.sub("0", x) for x in names)])
    return Element(tag, step, noise), main if main in MAINS and not noise else ""


class Page:
    """Reads the blocks of one page in a single pass over its tags."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.stack: list[Element] = []
        self.opened: Counter = Counter()
        self.mains: list[tuple[int, str]] = []  # how deep, and as what
        self.noise = 0
        self.texts: list[str] = []
        self.inline: list[str] = []
        self.cut: list[str] = []  # noisy inline element around the text, once for each nested one of its name
        at, end = 0, len(source)
        while at < end:
            lt = source.find("<", at)
            lt = end if lt < 0 else lt
            self.say(source[at:lt])
            at = self.tag(source, lt) if lt < end else end
        self.flush()

    def say(self, piece: str) -> None:
        if piece and not self.cut:
            self.texts.append(html.unescape(piece) if "&" in piece else piece)

    def tag(self, source: str, lt: int) -> int:
        """Take what starts with the ``<`` at ``lt``; returns where the text goes on."""
        found = TAG.match(source, lt)
        if not found:
            after = source[lt + 1:lt + 2]
            if source.startswith("<!--", lt):
                stop = source.find("-->", lt + 4)
                return len(source) if stop < 0 else stop + 3
            if after in ("!", "?", "/") or after.isascii() and after.isalpha():
                stop = source.find(">", lt)  # a declaration, or a tag whose quotes do not close
                return len(source) if stop < 0 else stop + 1
            self.say("<")
            return lt + 1
        closing, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
        if tag in HIDDEN:
            if closing or attributes.endswith("/"):
                return found.end()
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, found.end())
            return stop.end() if stop else len(source)
        if tag in INLINE:
            self.inside(tag, bool(closing), attributes)
            return found.end()
        self.flush()
        if closing:
            if self.opened[tag]:
                self.close(tag)
        elif tag not in VOID:
            self.open(tag, attributes)
        return found.end()

    def inside(self, tag: str, closing: bool, attributes: str) -> None:
        if tag in ("br", "wbr"):
            self.texts.append(" " if tag == "br" else "")
        elif closing:
            if self.cut and self.cut[-1] == tag:
                self.cut.pop()
        elif tag not in VOID:
            self.inline.append(tag)
            if self.cut:
                self.cut += [tag] * (self.cut[-1] == tag)
            elif attributes and element(tag, attributes, bool(self.mains))[0].noise:
                self.cut.append(tag)

    def flush(self) -> None:
        text = " ".join("".join(self.texts).split())
        if text:
            inner = self.stack[self.mains[-1][0]:] if self.mains else []
            main = min((m for _, m in self.mains), default="")  # article before main
            self.blocks.append(Block(
                ">".join(e.step for e in self.stack if e.step), text, ",".join(self.inline), self.noise > 0, main,
                bool(main) and all(e.step in CONTENT for e in inner)))
        self.texts, self.inline, self.cut = [], [], []

    def open(self, tag: str, attributes: str) -> None:
        if self.opened["p"] and tag not in ("html", "body"):
            self.close("p")
        ends = CLOSES.get(tag, ())
        for k in range(len(self.stack) - 1, -1, -1) if ends else ():
            if self.stack[k].tag in LISTS:
                break
            if self.stack[k].tag in ends:
                while len(self.stack) > k:
                    self.pop()
        e, main = element(tag, attributes, bool(self.mains))
        self.stack.append(e)
        self.opened[tag] += 1
        self.noise += e.noise
        if main:
            self.mains.append((len(self.stack), main))

    def pop(self) -> str:
        e = self.stack.pop()
        self.opened[e.tag] -= 1
        self.noise -= e.noise
        while self.mains and self.mains[-1][0] > len(self.stack):
            self.mains.pop()
        return e.tag

    def close(self, tag: str) -> None:
        while self.pop() != tag:
            pass


def key(*parts: str) -> int:
    """A signed 64-bit hash."""
    import xxhash

    value = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def masked(text: str) -> str:
    return DIGITS.sub("0", text)


STANDS, SAYS, LOOKS = 0, 1, 2  # a page has the node; with this text; with this layout


def features(page: str) -> set[tuple[int, int, int]]:
    """(node, kind, what) of one page, each once."""
    found, looks = set(), {}
    for b in Page(page).blocks:
        node = key(b.node)
        found.add((node, SAYS, key(masked(b.text))))
        looks.setdefault(node, []).append(b.inline)
    for node, inline in looks.items():
        found.add((node, STANDS, 0))
        found.add((node, LOOKS, key(";".join(inline))))
    return found


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, content, presentation, importance): the merged trees of all hosts."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()  # of this batch: copies and site furniture meet here already
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                host, page = host_of(url), page.as_py()
                if host is not None and page:
                    for one in features(page):
                        rows[host, *one] += 1
            hosts, nodes, kinds, whats = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(nodes, pa.int64()), pa.array(kinds, pa.int32()),
                 pa.array(whats, pa.int64()), pa.array(rows.values(), pa.int64())],
                names=["host", "node", "kind", "what", "k"])

    seen = (pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(told, "host string, node long, kind int, what long, k long")
            .groupBy("host", "node", "kind", "what").agg(F.sum("k").alias("k")))

    def over(kind: int, c):
        return F.when(F.col("kind") == kind, c)

    k = F.col("k").cast("double")
    sums = seen.groupBy("host", "node").agg(
        F.max(over(STANDS, F.col("k"))).alias("pages"), F.avg(over(SAYS, F.log(k))).alias("log_k"),
        F.sum(over(LOOKS, k * F.log(k))).alias("k_log_k"), F.sum(over(LOOKS, F.lit(1))).alias("looks"))
    m = F.col("pages").cast("double")
    enough = F.col("pages") >= LEAST_PAGES
    content = F.when(enough, 1 - F.col("log_k") / F.log(m)).otherwise(1.0)
    presentation = F.when(enough, 1 - F.col("k_log_k") / (m * F.log(m))).otherwise(1.0)
    damped = F.pow(F.lit(DAMPING), F.col("looks"))
    return (sums.withColumn("content", content).withColumn("presentation", presentation)
            .withColumn("importance", (1 - damped) * F.col("presentation") + damped * F.col("content"))
            .select("host", "node", "pages", "content", "presentation", "importance"))


def main_blocks(blocks: list[Block], low: set[int]) -> list[Block]:
    """The blocks that stay."""
    clean = [b for b in blocks if not b.noise]
    inside = next((r for m in MAINS if (r := [b for b in clean if b.main == m])), clean)
    return [b for b in inside if (b.main and b.plain) or key(b.node) not in low] or inside


RESULT = "page_id long, url string, text string, n_chars long, n_blocks long, n_low long, n_kept long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, blocks on the page, blocks of low nodes, blocks kept) of every page."""
    few = style_tree(pages).where(F.col("importance") < LOW).groupBy("host").agg(F.collect_list("node").alias("low"))
    low = cut_lineage(few, "style-tree")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page, nodes in zip(*(batch.column(i) for i in range(4))):
                blocks = Page(page.as_py() or "").blocks
                gone = set(nodes.as_py() or ())
                kept = main_blocks(blocks, gone)
                text = "\n".join(b.text for b in kept)
                rows.append((page_id.as_py(), url.as_py(), text, len(text), len(blocks),
                             sum(key(b.node) in gone for b in blocks), len(kept)))
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4))], names=[f.split()[0] for f in RESULT.split(", ")])

    own = F.regexp_extract(F.col("url"), HOST_PATTERN, 1)
    held = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).select(
        "page_id", "url", "html", F.lower(F.when(own != "", own)).alias("host"))
    return held.join(low, "host", "left").select("page_id", "url", "html", "low").mapInArrow(told, RESULT)
