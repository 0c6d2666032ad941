"""Main text of web pages, with site templates found by counting element subtrees.

Every page is read once as a stream of tags, and every element is hashed, subtree by subtree: menus, footers and
adverts as well as what holds text. The hashes are counted per host in Spark over pages with different bodies, and a
subtree that recurs on many of them is a template of the site and is deleted. Inside an <article> or <main> only boxes
can be templates, counted over different articles; the article itself and its paragraphs are the page's own, however
often they are copied. What recurs on too few pages to be counted, or on none (reader comments), is told by its tag,
role or class. An article is the main text if it holds a fair share of what is left; otherwise all that is left is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage

#: A subtree is a template if it is on at least so many different pages of its host ...
MIN_PAGES = 5
#: ... and on at least this share of them.
MIN_SHARE = 0.2
#: ... or on so many, whatever the share.
MANY_PAGES = 1000
#: Share of the text left that an <article> or <main> must hold to be the main text.
MAIN_SHARE = 0.2
#: Templates up to which the table is sent to every task; above, pages look theirs up by a join.
MAX_BROADCAST = 100_000

# fixed values: HTML's element names by kind
_RAW = "script|style|textarea|title|noscript|iframe|template|noframes|xmp"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
_UNSEEN = frozenset(
    "head select option datalist svg math canvas object video audio map script style textarea title noscript iframe template noframes xmp".split()
)
_BESIDE = frozenset("nav header footer aside form button dialog menu".split())
# fixed values: names that sites give to what is no main text, alone or as the last part after a dash
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner nav navbar navigation menu sidebar "
    "footer header masthead breadcrumb breadcrumbs cookie cookies consent notice notification popup modal overlay newsletter subscribe "
    "share sharing social related recommended comment comments disqus replies widget toolbar pagination pager login signup search "
    "contentinfo complementary alert".split()
)
# fixed values: last parts that only say what kind of box it is; the part before is the name then
_KINDS = frozenset(
    "area bar block box button buttons col column container content form group holder inner item items link links list main module outer panel "
    "primary row section slot top bottom unit wrap wrapper".split()
)
#: Of these, what an <article> can be named without being the main one.
_ASIDE_ARTICLES = frozenset("ad ads advert sponsored promo related recommended comment comments replies".split())
#: Parts that only say whether or where something is shown.
_STATES = frozenset("has no not with without is show hide hidden enabled disabled left right open closed".split())
#: What can be a template inside an <article> or <main>.
_BOXES = frozenset("div section ul ol dl table figure details fieldset".split())
_CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_SCOPES = frozenset("ul ol dl table body html article main section div nav aside header footer form".split())
#: Attributes: a quote opens a value only after an equals sign.
_ATTRS = r"(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?|[^=>])*+"
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|(?P<open>\Z)))|<(?P<raw>" + _RAW + r")(?=[\s/>])" + _ATTRS + r">.*?(?:</(?P=raw)\s*>|(?P<unshut>\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>" + _ATTRS + r")>|<[!?][^>]*>|</[^a-zA-Z][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _named_aside(tag: str, attrs: str) -> bool:
    """Whether class, id or role name an element as no main text: "site-footer" and "comments-list" do, "has-sidebar" and "social-history" do not."""
    if tag in ("html", "body", "main"):
        return False
    names = _ASIDE_ARTICLES if tag == "article" else _NAMES
    for values in map(re.Match.groups, _NAMED.finditer(attrs)):
        for token in next(v for v in values if v is not None).lower().split():
            parts = re.split("[-_]+", token)
            while len(parts) > 1 and parts[-1] in _KINDS:
                parts.pop()
            if parts[-1] in names and not _STATES & set(parts):
                return True
    return False


@dataclass
class _Open:
    tag: str
    skipped: bool
    #: Whether the innermost block is skipped; its text then counts for the subtree's hash alone.
    hidden: bool
    main: bool
    first: int
    digest: object = field(default=None)


@dataclass
class Parsed:
    """blocks: (text, in main, innermost hashed subtree or -1); subtrees: (hash, parent, in main, can be a template)."""

    blocks: list[tuple[str, bool, int]]
    subtrees: list[tuple[int, int, bool, bool]]
    has_main: bool

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        gone = [own and h in templates for h, _, _, own in self.subtrees]
        for i, (_, parent, _, _) in enumerate(self.subtrees):
            gone[i] = gone[i] or parent >= 0 and gone[parent]
        left = [(t, main) for t, main, at in self.blocks if not (at >= 0 and gone[at])]
        chosen = self.has_main and _fair(left)
        return " ".join(t for t, main in left if main or not chosen)

    def counted(self) -> set[tuple[int, int, int]]:
        """(part, body, subtree) to count; 0 stands for the part itself.

        Parts are what lies outside articles, on pages with (1) and without (0) an article of a fair share, and what
        lies inside (2). So a template has to recur only over pages that can hold it.
        """
        blocks = [(t, main) for t, main, _ in self.blocks]
        outside, whole, inside = int(self.has_main and _fair(blocks)), _digest(t for t, _ in blocks), _digest(t for t, main in blocks if main)
        found = {(outside, whole, 0)}
        if self.has_main:
            found.add((2, inside, 0))
        for h, _, main, own in self.subtrees:
            if own:
                found.add((2, inside, h) if main else (outside, whole, h))
        return found


def _fair(blocks: list[tuple[str, bool]]) -> bool:
    """Whether the blocks in main hold a fair share of the text."""
    return sum(len(t) for t, main in blocks if main) >= MAIN_SHARE * sum(len(t) for t, _ in blocks)


def _digest(texts: Iterable[str]) -> int:
    h = xxhash.xxh64("\0".join(texts)).intdigest()
    return h - (1 << 64) if h >> 63 else h


def parse(page: str | None, hashed: bool = True, named: bool = True) -> Parsed:
    """Blocks of a page in order. Missing end tags are closed by the enclosing element, as browsers do.

    ``named``: whether tags, roles and classes tell what is main text and what is none; without, only what browsers never show is left out.
    """
    source = page or ""
    # no tag ends after the last ">"
    last_end = source.rfind(">") + 1
    never = _UNSEEN | _BESIDE if named else _UNSEEN
    stack = [_Open("", False, False, False, -1)]
    is_open: Counter[str] = Counter()
    blocks: list[tuple[str, bool, int]] = []
    subtrees: list[list] = []
    buffer: list[str] = []
    has_main = False

    def take(text: str) -> None:
        top = stack[-1]
        if not top.skipped or (hashed and top.hidden):
            buffer.append(text)

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            top = stack[-1]
            if not top.hidden:
                blocks.append((text, top.main, top.first))
            if top.first >= 0:
                subtrees[top.first][2].update(text)

    def close(count: int) -> None:
        for _ in range(count):
            node = stack.pop()
            is_open[node.tag] -= 1
            if node.digest is not None:
                h = node.digest.intdigest()
                subtrees[node.first][0] = h - (1 << 64) if h >> 63 else h
                # inline elements lie between
                if stack[-1].first >= 0:
                    subtrees[stack[-1].first][2].update(f"\0{h}")

    def depth_of(tags: frozenset[str], through: frozenset[str] | None = None, until: frozenset[str] = frozenset()) -> int:
        """How far up the nearest open one of ``tags`` is, 0 if none; only ``through`` may lie below it, and the search ends at ``until``."""
        if any(is_open[t] for t in tags):
            for i in range(1, len(stack)):
                tag = stack[-i].tag
                if tag in tags:
                    return i
                if tag in until or (through is not None and tag not in through):
                    return 0
        return 0

    last = 0
    for m in _TOKEN.finditer(source, 0, last_end):
        if m.start() > last:
            take(html.unescape(source[last : m.start()]))
        last = m.end()
        if m["open"] is not None or m["unshut"] is not None:
            last = len(source)
        if m["raw"] or not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag == "br" or tag == "hr":
            buffer.append("\n")
            continue
        if tag in _VOID:
            continue
        block = tag not in _INLINE
        if m["end"]:
            depth = depth_of(frozenset([tag]), None if block else _INLINE)
            if block:
                flush()
            close(depth)
            continue
        if block:
            flush()
            if tag in _CLOSED_BY:
                close(depth_of(_CLOSED_BY[tag], until=_SCOPES))
            elif tag == "body" or tag == "html":
                # the head ends here, closed or not
                while len(stack) > 1 and stack[-1].tag in ("head", "title"):
                    close(1)
        top = stack[-1]
        main = top.main or (named and tag in ("article", "main"))
        skipped = top.skipped or tag in never or (named and "=" in m["attrs"] and _named_aside(tag, m["attrs"]))
        node = _Open(tag, skipped, skipped if block else top.hidden, main, top.first)
        has_main = has_main or (main and not skipped)
        if hashed and main and not top.main and not skipped:
            # what holds an article is no template
            at = top.first
            while at >= 0 and not subtrees[at][5]:
                subtrees[at][4], subtrees[at][5] = False, True
                at = subtrees[at][1]
        if hashed and block and tag not in ("html", "body", "head"):
            node.digest = xxhash.xxh64(f"<{tag}")
            node.first = len(subtrees)
            subtrees.append([0, top.first, node.digest, main, skipped or not main or tag in _BOXES, False])
        stack.append(node)
        is_open[tag] += 1
    if last < len(source):
        take(html.unescape(source[last:]))
    flush()
    close(len(stack) - 1)
    return Parsed(blocks, [(h, p, inside, own) for h, p, _, inside, own, _ in subtrees], has_main)


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY_PAGES, named: bool = True) -> DataFrame:
    """(host, subtree) of the subtrees that recur over different pages of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, parts, bodies, trees = [], [], [], []
            for host, page in zip(b.column(0), b.column(1)):
                name = host.as_py()
                for part, body, h in parse(page.as_py(), named=named).counted():
                    hosts.append(name)
                    parts.append(part)
                    bodies.append(body)
                    trees.append(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(parts, pa.int32()), pa.array(bodies, pa.int64()), pa.array(trees, pa.int64())],
                ["host", "part", "body", "subtree"],
            )

    seen = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "host string, part int, body long, subtree long"
    )
    # two steps, so that a large host is spread over its pages' bodies first
    once = seen.groupBy("host", "part", "subtree", "body").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "part", "subtree").agg(F.sum("one").alias("n"))
    counts = cut_lineage(counts.where((F.col("n") >= min_pages) | (F.col("subtree") == 0)))
    totals = counts.where("subtree = 0").select(F.col("host").alias("h"), F.col("part").alias("p"), F.col("n").alias("total"))
    return (
        counts.where("subtree <> 0")
        .join(totals, (F.col("host") == F.col("h")) & (F.col("part") == F.col("p")))
        .where((F.col("n") >= min_pages) & ((F.col("n") >= F.col("total") * min_share) | (F.col("n") >= many)))
        .select("host", "subtree")
        .distinct()
    )


def main_text(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, max_broadcast: int = MAX_BROADCAST, named: bool = True
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page has an empty text. A null or odd url belongs to the host "". Copies of a whole page count
    once towards a template. Repeated rows and null ids get a row each; a very long page is read in one pass, in time
    in proportion to its length; an empty table gives an empty result; other columns are ignored. Without ``named``
    templates alone decide what is left out.
    """
    templates = cut_lineage(site_templates(pages, min_pages, min_share, named=named))
    src = pages.select("page_id", "url", _host(F.col("url")).alias("_host"), F.col("html").cast("string").alias("_html"))
    if templates.count() <= max_broadcast:
        known: dict[str, set[int]] = {}
        for r in templates.collect():
            known.setdefault(r.host, set()).add(r.subtree)
        sent = pages.sparkSession.sparkContext.broadcast(known)
        src = src.select("page_id", "url", "_host", "_html", F.lit(None).cast("array<bigint>").alias("_gone"))
    else:
        sent = None
        src = _with_templates(src, templates, named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for host, page, gone in zip(b.column(2), b.column(3), b.column(4)):
                found = sent.value.get(host.as_py(), ()) if sent is not None else gone.as_py() or ()
                texts.append(parse(page.as_py(), bool(found), named).text(frozenset(found)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def _with_templates(src: DataFrame, templates: DataFrame, named: bool) -> DataFrame:
    """Pages with the templates among their own subtrees (_gone), found by an equi-join of page subtrees and templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, hosts, trees = [], [], []
            for key, host, page in zip(b.column(0), b.column(1), b.column(2)):
                for h in {x for x, _, _, own in parse(page.as_py(), named=named).subtrees if own}:
                    keys.append(key.as_py())
                    hosts.append(host.as_py())
                    trees.append(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(hosts, pa.string()), pa.array(trees, pa.int64())], ["key", "h", "t"]
            )

    # a page is known by its content, so equal pages share what is found
    keyed = src.withColumn("_key", F.sha2(F.concat_ws("\0", F.col("page_id").cast("string"), "_host", F.coalesce("_html", F.lit(""))), 256))
    own = keyed.select("_key", "_host", "_html").mapInArrow(run, "key string, h string, t long")
    found = own.join(templates, (F.col("h") == F.col("host")) & (F.col("t") == F.col("subtree")))
    gone = found.groupBy("key").agg(F.collect_set("t").alias("_gone"))
    return keyed.join(gone, F.col("_key") == F.col("key"), "left").select("page_id", "url", "_host", "_html", "_gone")
