"""Main text of web pages by a site style tree.

Pages of one host are merged into one tree of element paths (tags with their
ids and classes).  A path has presentation nodes, the sequences of child tags
that pages show there, and content nodes, the texts that pages have there:

* presentation importance: entropy of the child sequences over the pages that
  have the path, as a share of its maximum;
* content importance: 1 - H(a) averaged over the texts a, where H(a) is the
  entropy of a's spread over the pages, 0 if one page has it and 1 if all have.

A branch's importance is their weighted sum as a share of that of the host's
path with the most text (copies of a page lower both), times a prior: below one
for what is labelled by tag, role or class as menu, header, footer, sidebar,
notice, advert, form or comments, above one for plain blocks of an ``article``
or ``main`` element.  Branches below ``THRESHOLD`` are cut from each page.  Where
a host has fewer than ``LEAST_PAGES`` pages with a path, nothing is known but the
prior.  Furniture whose words differ from page to page is told by its label only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, materialize, slices, with_columns

#: Pages that must have a path, its importance below which it is cut, the weight of looks against words.
LEAST_PAGES, THRESHOLD, LOOKS = 5, 0.4, 0.1
#: What a label says: priors of furniture, of what has no label, and of an article's plain blocks.
FURNITURE, UNLABELLED, ARTICLE = 0.3, 1.0, 1.5
#: Cut paths up to this many rows (20 bytes each) are broadcast; beyond it they are joined by host.
BROADCAST_ROWS = 100_000

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead tr ul".split()
)
#: Start tags that end an open element: the tag, what it ends, and what the search stops at.
_LIST, _TABLE = frozenset({"ul", "ol", "menu", "dir"}), frozenset({"table"})
ENDS = {"li": (frozenset({"li"}), _LIST), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "option": (frozenset({"option"}), frozenset({"select"}))}
ENDS |= {t: (frozenset({"td", "th"}), _TABLE) for t in ("td", "th")} | {"tr": (frozenset({"tr"}), _TABLE)} | {t: (frozenset({"thead", "tbody", "tfoot"}), _TABLE) for t in ("thead", "tbody", "tfoot")}
#: Block elements that end an open paragraph, and what holds a paragraph of its own.
ENDS_P = BLOCK - frozenset({"br", "button", "option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head", "template", "legend", "textarea"})
P_STOPS = frozenset({"button", "td", "th", "caption", "table", "template", "object", "html"})
#: End tags close nothing outside of the cell or table that they are in, but for these.
CELLS = frozenset({"td", "th", "table"})
TABLE_ENDS = frozenset("table tr td th tbody thead tfoot body html article main".split())

#: Elements that are never main text, by tag, by role, and by a word of their class or id.
NOISE_TAGS = frozenset("head title script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas audio video dialog menu search datalist label fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus"
    " footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination popup promo promotion promotions"
    " recommended related replies respond rss search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset({"comment", "comments", "commentlist", "disqus", "replies", "respond"})

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
STARTS_TAG = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass(slots=True)
class Element:
    tag: str
    #: A hash of the path, and that of the nearest block's.
    path: int
    block: int
    noisy: bool
    #: By class or id only, which a page's first article or main overrules.
    named: bool
    inside: int
    #: Unmarked since the article or main above it.
    plain: bool
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    path: int
    text: str
    noisy: bool
    #: 2 in an article, 1 in a main element, 0 elsewhere.
    inside: int
    plain: bool

    @property
    def prior(self) -> float:
        return FURNITURE if self.noisy else ARTICLE if self.plain and self.inside else UNLABELLED

    @property
    def node(self) -> int:
        """The branch in the tree: the path, and what its label says."""
        return digest(f"{self.path} {self.prior}")


def digest(text: str) -> int:
    n = xxhash.xxh64_intdigest(text)
    return n - 2**64 if n >= 2**63 else n


class Page:
    """Blocks of text in page order, and each element's path and child tags.

    One pass: the time is in proportion to the page's size, whatever is nested or
    left open in it.  A comment that doesn't end goes to the end of the page, as
    does a tag; after a tag whose quotes don't end, quotes count no more.
    """

    def __init__(self, html: str | None):
        self.blocks: list[Block] = []
        self.looks: list[tuple[int, str]] = []
        self.found = False
        self.stack = [Element("", 0, 0, False, False, 0, False)]
        #: Places in the stack of the open elements of each tag.
        self.open: dict[str, list[int]] = {}
        self.text: list[str] = []
        self._read(html or "")

    def _flush(self) -> None:
        if self.text:
            said = " ".join(unescape("".join(self.text)).split())
            self.text.clear()
            if said:
                at = self.stack[-1]
                self.blocks.append(Block(at.block, said, at.noisy or at.named, at.inside, at.plain))

    def _close(self, size: int) -> None:
        while len(self.stack) > size:
            e = self.stack[-1]
            if e.tag in BLOCK or e.noisy or e.named:
                self._flush()
            self.stack.pop()
            self.open[e.tag].pop()
            self.looks.append((e.path, " ".join(t for t, before in zip(e.children, [None, *e.children], strict=False) if t != before)))

    def _last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _end_open(self, ends: frozenset[str], stops: frozenset[str]) -> None:
        at = self._last(ends)
        if at > self._last(stops):
            self._close(at)

    def _open(self, tag: str, raw: str, closed: bool) -> None:
        if tag in ENDS_P and self.open.get("p"):
            self._end_open(frozenset({"p"}), P_STOPS)
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        values = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}
        marks = [unescape(values.get(k, "")) for k in ("id", "class")] if values else ["", ""]
        words = {w for m in marks for w in WORDS.findall(CAMEL.sub(" ", m).lower())} if values else frozenset()
        up = self.stack[-1]
        tagged = tag in NOISE_TAGS or bool(values) and (values.get("role", "").lower() in NOISE_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower())
        tagged = tagged or tag == "header" and not up.inside
        named = bool(words & NOISE_WORDS) or not up.inside and "header" in words
        inside, plain, noisy, held = up.inside, up.plain and not words, up.noisy or tagged, up.named or named
        if tag in ("body", "html"):
            noisy, held = up.noisy, False
        if tag in ("article", "main") and not words & COMMENT_WORDS and not noisy:
            if not self.found:
                held = False
            inside, plain, self.found = max(inside, 2 if tag == "article" else 1), True, True
        if tag in BLOCK or noisy != up.noisy or held != up.named:
            self._flush()
        if tag in VOID:
            if tag not in ("br", "wbr"):
                up.children.append(tag)
            return
        up.children.append(tag)
        if closed and tag in ("path", "circle", "rect", "use"):
            return
        name = tag + "".join(f"{'#.'[i]}{re.sub(r'[0-9]+', '0', m.lower())}" for i, m in enumerate(marks) if m)
        path = digest(f"{up.path}/{name}")
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, path, path if tag in BLOCK else up.block, noisy, held, inside, plain))

    def _end(self, tag: str) -> None:
        at = self._last((tag,))
        if at and (tag in TABLE_ENDS or at >= self._last(CELLS)):
            self._close(at)
        elif not at and tag in ("p", "br"):
            self._flush()

    def _read(self, html: str) -> None:
        at, end, pattern, sections = 0, len(html), TAG, True
        while at < end:
            start = html.find("<", at)
            if start < 0:
                self.text.append(html[at:])
                break
            if start > at:
                self.text.append(html[at:start])
            at = start
            if html.startswith(("<!", "<?"), at):
                if html.startswith("<!--", at):
                    close, skip = html.find("-->", at + 4), 3
                else:
                    close, skip = -1, 3
                    if sections and html.startswith("<![CDATA[", at):
                        close = html.find("]]>", at + 9)
                        sections = close >= 0
                        if sections:
                            self.text.append(html[at + 9 : close].replace("&", "&amp;"))
                    if close < 0:
                        close, skip = html.find(">", at), 1
                at = close + skip if close >= 0 else end
                continue
            if not STARTS_TAG.match(html, at):
                self.text.append("<")
                at += 1
                continue
            m = pattern.match(html, at)
            if m is None and pattern is TAG:
                pattern = PLAIN_TAG
                m = pattern.match(html, at)
            if m is None:
                break  # a tag that doesn't end
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._open(tag, m[3], m[3].endswith("/"))
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                if tag == "textarea":
                    self.text.append(html[at : close.start() if close else end])
                after = html.find(">", close.end()) if close else -1
                at = after + 1 if after >= 0 else end
                if self.stack[-1].tag == tag:
                    self._close(len(self.stack) - 1)
        self._close(1)
        self._flush()

    def kept(self, cut: set[int]) -> str:
        """The main text: of articles if they have any, else of main elements, else of the whole page."""
        clean = [b for b in self.blocks if b.prior >= THRESHOLD and not (cut and b.node in cut)]
        most = max((b.inside for b in clean), default=0)
        return " ".join(b.text for b in clean if b.inside == most)


def branches(pages: DataFrame) -> DataFrame:
    """host, path (a hash), m, size, prior, importance of every branch with a text; ``pages`` has host and html.

    Every count is summed before it is shuffled, and keyed by host, path and
    what is found there, so that no host's pages meet in one task.
    """

    def nodes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            rows: dict[tuple, list[int]] = {}
            for host, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                page = Page(html)
                found: dict[tuple, int] = {}
                ways: dict[int, set] = {}
                for b in page.blocks:
                    node = b.node
                    ways.setdefault(b.path, set()).add((node, b.prior))
                    key = (node, b.prior, True, digest(b.text))
                    found[key] = found.get(key, 0) + len(b.text)
                for path, look in page.looks:
                    for node, prior in ways.get(path, ()):
                        found.setdefault((node, prior, False, digest(look)), 0)
                for key, size in found.items():
                    n = rows.setdefault((host, *key), [0, 0])
                    n[0] += 1
                    n[1] += size
            keys, counts = list(zip(*rows, strict=True)) or [()] * 5, list(rows.values())
            columns = [*keys, [c[0] for c in counts], [c[1] for c in counts]]
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "prior", "content", "what", "n", "size"])
            rows.clear()
        give_back()

    seen = pages.where("host <> ''").select("host", "html").mapInArrow(nodes, "host string, path long, prior double, content boolean, what long, n long, size long")
    found = seen.groupBy("host", "path", "prior", "content", "what").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    texts, looks = F.col("content"), ~F.col("content")
    n_log = F.col("n") * F.log("n")
    summed = found.groupBy("host", "path", "prior").agg(
        F.sum(F.when(looks, F.col("n"))).alias("m"),
        F.sum(F.when(looks, n_log)).alias("look_log"),
        F.sum(F.when(texts, F.col("n"))).alias("said"),
        F.sum(F.when(texts, n_log)).alias("said_log"),
        F.sum(F.when(texts, F.col("size"))).alias("size"),
    )
    log_m = F.log("m")
    presentation = (log_m - F.col("look_log") / F.col("m")) / log_m
    content = F.greatest(1 - F.col("said_log") / F.col("said") / log_m, F.lit(0.0))
    told = F.when(F.col("m") >= LEAST_PAGES, LOOKS * presentation + (1 - LOOKS) * content)
    scored = materialize(summed.where("said > 0").withColumn("told", told), "style-nodes")
    main = scored.where("told is not null").groupBy("host").agg(F.max_by("told", F.struct("size", "path")).alias("most"))
    share = F.when(F.col("told").isNull() | (F.col("most") <= 0), 1.0).otherwise(F.least(F.col("told") / F.col("most"), F.lit(1.0)))
    return scored.join(main, "host", "left").select("host", "path", F.coalesce("m", F.lit(0)).alias("m"), "size", "prior", (share * F.col("prior")).alias("importance"))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path: the branches of low importance that a page would keep by its labels alone."""
    return branches(pages).where((F.col("importance") < THRESHOLD) & (F.col("prior") >= THRESHOLD)).select("host", "path")


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add each page's main text; null and empty pages have an empty one, pages without a host no style tree.

    Character references are decoded, white space in a block is one space, and
    blocks are joined by one space in page order.  A column named ``text_col``
    is replaced.
    """
    rows = df.drop(text_col).withColumn("__host", F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), HOST, 1)))
    cut = materialize(style_tree(rows.select(F.col("__host").alias("host"), F.col(html_col).alias("html"))), "style-tree")
    n = cut.count()
    by_host = cut.groupBy(F.col("host").alias("__host")).agg(F.collect_set("path").alias("__cut"))  # at most the paths of one tree
    joined = rows.withColumn("__cut", F.lit(None).cast("array<long>")) if not n else rows.join(F.broadcast(by_host) if n <= BROADCAST_ROWS else by_host, "__host", "left")

    def run(html: pa.Array, cut_paths: pa.Array) -> Iterator[pa.Array]:
        yield pa.array([Page(h).kept(set(c or ())) for h, c in zip(html.to_pylist(), cut_paths.to_pylist(), strict=True)], pa.string())

    return with_columns(joined, [html_col, "__cut"], {text_col: "string"}, run).drop("__host", "__cut")
