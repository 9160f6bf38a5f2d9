"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of elements with their classes, and holds how often each
presentation (sequence of child elements) and each content (texts below) occurs on the host's pages. A node's importance
is the larger entropy of the two by the logarithm of its pages: 0 for a branch that is the same everywhere, 1 for one that
always differs, 1 if it stands on a single page.

A page's branches go by importance, weighted by their meaning in HTML. Elements that never hold main text (menus, scripts,
footers and so on) have none and are no part of the tree. Every other block goes if one of the branches it stands in is of
low importance: under ``LOW`` for a container, under half of that for paragraphs and other elements of text. Headings and
labels belong to what they name and go only with the branch around them. Doubtful is a branch whose role, class or id names
it a notice, advert, comment and so on, and, where a page marks an article, a branch outside it: it goes unless its
importance times its share of the page's text is at least ``HALF``; a branch doubtful both ways always goes. An article in a
doubtful branch is the page's article if the page has no other.

Null pages and urls count as empty: no text; pages without a host are a host together. Character references are decoded, white
space inside a block becomes one space, blocks are joined by line ends. Broken markup is read as browsers do, roughly:
paragraphs and items end where the next begins, a closing mark closes what is open inside it. Repeated rows count as pages
of their own in the result; in the tree, pages of a host with the same blocks count once, so that copies of a page do
not make its branches look like the site's. No page loses its last block to the tree. An empty table gives no rows. Counts
of a host are combined before the shuffle, so one host may hold most pages.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.textbatch import slices
from quillgrid.session import stored

LOW = 0.2
HALF = 0.5
MIN_PAGES = 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without main text, and the words of roles, classes and ids that make a branch doubtful.
NO_TEXT = frozenset("head nav footer aside script style noscript template iframe object svg canvas button select option textarea dialog menu audio video map".split())
NO_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer login menu modal nav navbar "
    "navigation newsletter notice notices popup promo promoted promotion related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
MAIN = frozenset(("article", "main"))
#: What a page as a whole stands in is not doubtful by its name.
WHOLE = MAIN | {"html", "body"}
#: Elements of text weigh twice as much as containers; labels go only with what is around them.
TEXT_ELEMENTS = frozenset("p blockquote pre table tbody tr td dl dd figure article main body html".split())
LABELS = frozenset("h1 h2 h3 h4 h5 h6 thead th dt caption figcaption".split())
#: What ends an open element of the same kind.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPES = frozenset("article main section div body html ul ol dl table blockquote td th aside nav footer header form".split())
_WORD = re.compile(r"[^\W\d_]+")


def _number(text: str) -> int:
    n = xxhash.xxh64_intdigest(text)
    return n - (1 << 64) if n >> 63 else n


class Page(HTMLParser):
    """Blocks and nodes of a page, without the branches that never hold main text.

    ``blocks``: (paths of the branches the text stands in, text, in an article, the outermost branch that its name makes
    doubtful, the doubtful branch around its article). ``children`` and ``contents``: by path the presentation and the texts.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool, bool, str, str]] = []  # element, path, without text, in an article, doubtful branch, that around the article
        self.blocks: list[tuple[list[str], str, bool, str, str]] = []
        self.children: dict[str, list[str]] = {}
        self.contents: dict[str, list[str]] = {}
        self.buffer: list[str] = []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        _, _, silent, inside, doubt, around = self.open[-1] if self.open else ("", "", False, False, "", "")
        if not text or silent:
            return
        paths = list(dict.fromkeys(path for _, path, *_ in self.open if path))
        for path in paths:
            self.contents.setdefault(path, []).append(text)
        self.blocks.append((paths, text, inside, doubt, around))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name in _ENDS.get(tag, ()) or (name == "p" and tag not in _ENDS):
                    del self.open[at:]
                    break
                if name in _SCOPES:
                    break
        said = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().replace("/", " ")
        _, above, silent, inside, doubt, around = self.open[-1] if self.open else ("", "", False, False, "", "")
        if tag in MAIN and not inside:
            inside, doubt, around = True, "", doubt
        silent = silent or tag in NO_TEXT
        # A header of the article may hold its title; any other is the site's.
        doubtful = tag == "form" or (tag == "header" and not inside) or tag not in WHOLE and _doubtful(said)
        name = f"{tag}.{said}" if said else tag
        if tag not in INLINE:
            row = self.children.setdefault(above, [])
            if not row or row[-1] != name:
                row.append(name)
            above = f"{above}/{name}"
            if doubtful and not doubt:
                doubt = above
        self.open.append((tag, above, silent, inside, doubt, around))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if any(name not in INLINE for name, *_ in self.open[at:]):
                    self.flush()
                del self.open[at:]
                return
            if tag in INLINE and self.open[at][0] not in INLINE:
                return

    def handle_data(self, data):
        self.buffer.append(data)


def _doubtful(said: str) -> bool:
    """Whether a class, id or role is one of the words, or made of nothing but them."""
    return any(words and NO_TEXT_WORDS.issuperset(words) for words in map(_WORD.findall, said.split()))


def _kind(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def _limit(path: str) -> float:
    """The importance under which a branch goes."""
    kind = _kind(path)
    return 0.0 if kind in LABELS else LOW / 2 if kind in TEXT_ELEMENTS else LOW


def read_page(html: str) -> tuple[list[tuple[list[int], str]], dict[int, float], list[tuple[int, int, int]]]:
    """Blocks (numbers of the branches that may go with it, text), the importance under which each branch goes, and nodes
    (number, presentation, content) of a page. Blocks that go whatever the importance is are left out."""
    page = Page(html)
    # An article in a doubtful branch is the page's if there is no other.
    plain = any(inside and not doubt and not around for *_, inside, doubt, around in page.blocks)
    inner = [inside and not (plain and around) for *_, inside, _, around in page.blocks]
    # Branches that hold an article are not outside it.
    above = {path for (paths, *_), within in zip(page.blocks, inner) if within for path in paths}
    doubts, total, share = [], 0, {}
    for (paths, text, _, named, around), within in zip(page.blocks, inner):
        outside = any(inner) and not within
        # Of a block that is doubtful both ways no branch can save it.
        named = named or (around if outside else "")
        branch = named or next((p for p in paths if p not in above), "")
        doubts.append((outside + bool(named), branch))
        total += len(text)
        if outside or named:
            share[branch] = share.get(branch, 0) + len(text)
    blocks, limits = [], {}
    for (paths, text, *_, around), (n, branch) in zip(page.blocks, doubts):
        # Importance is 1 at most, so a doubtful branch with less than half of the text goes in any case.
        if n == 2 or n and share[branch] <= HALF * total:
            continue
        under = {_number(p): _limit(p) for p in paths if _kind(p) not in LABELS}
        if n and branch:
            under[_number(branch)] = HALF * total / share[branch]
        elif not n and around:
            # The doubt ended where the page's article began.
            under.pop(_number(around), None)
        limits |= under
        blocks.append((list(under), text))
    nodes = [(_number(path), _number("\t".join(page.children.get(path, []))), _number("\n".join(texts))) for path, texts in page.contents.items()]
    return blocks, limits, nodes


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


_SCHEMA = (
    "row bigint, key {key}, url string, host string, same bigint, blocks array<struct<branches: array<bigint>, text: string>>, "
    "limits array<struct<node: bigint, under: double>>, nodes array<struct<node: bigint, presentation: bigint, content: bigint>>"
)


def _read(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for s in slices(batches, "html", 4 << 20):
            rows = {"row": [], "host": [], "same": [], "blocks": [], "limits": [], "nodes": []}
            for at, (address, source) in enumerate(zip(s.column("url").to_pylist(), s.column("html").to_pylist())):
                blocks, limits, nodes = read_page(source or "")
                rows["row"].append((part << 33) + number + at)
                rows["host"].append(host_of(address or ""))
                rows["same"].append(_number("\n".join(t for _, t in blocks)))
                rows["blocks"].append([{"branches": b, "text": t} for b, t in blocks])
                rows["limits"].append([{"node": n, "under": u} for n, u in limits.items()])
                rows["nodes"].append([{"node": n, "presentation": p, "content": c} for n, p, c in nodes])
            number += s.num_rows
            whole = {
                "row": pa.array(rows["row"], pa.int64()),
                "key": s.column("key"),
                "url": s.column("url"),
                "host": pa.array(rows["host"], pa.string()),
                "same": pa.array(rows["same"], pa.int64()),
                "blocks": pa.array(rows["blocks"], pa.list_(pa.struct([("branches", pa.list_(pa.int64())), ("text", pa.string())]))),
                "limits": pa.array(rows["limits"], pa.list_(pa.struct([("node", pa.int64()), ("under", pa.float64())]))),
                "nodes": pa.array(rows["nodes"], pa.list_(pa.struct([("node", pa.int64()), ("presentation", pa.int64()), ("content", pa.int64())]))),
            }
            yield pa.RecordBatch.from_arrays(list(whole.values()), list(whole))

    plain = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    # Stored: the tree needs all pages before the first one can be cut, and pages are parsed once.
    return stored(plain.mapInArrow(run, _SCHEMA.format(key=plain.schema["key"].dataType.simpleString())))


def _distinct(read: DataFrame) -> DataFrame:
    """One page of each group of copies on a host; only groups of several pages are joined."""
    groups = read.groupBy("host", "same").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    copies = stored(groups.where("n > 1").select("host", "same", "first"))
    return read.join(copies, ["host", "same"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("row")))


def _tree(read: DataFrame) -> DataFrame:
    nodes = read.select("host", F.inline("nodes"))
    kinds = F.array(F.struct(F.lit(True).alias("shown"), F.col("presentation").alias("value")), F.struct(F.lit(False).alias("shown"), F.col("content").alias("value")))
    each = nodes.select("host", "node", F.inline(kinds)).groupBy("host", "node", "shown", "value").agg(F.count("*").alias("n"))
    of = lambda shown: F.sum(F.when(F.col("shown") == shown, F.col("n") * F.log("n")).otherwise(0.0))
    found = each.groupBy("host", "node").agg(F.sum(F.when(F.col("shown"), F.col("n"))).alias("pages"), of(True).alias("presentation"), of(False).alias("content"))
    entropy = lambda c: F.when(F.col("pages") > 1, (F.log("pages") - F.col(c) / F.col("pages")) / F.log("pages")).otherwise(1.0).alias(c)
    both = found.select("host", "node", "pages", entropy("presentation"), entropy("content"))
    return both.withColumn("importance", F.greatest("presentation", "content"))


def style_tree(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The merged tree of all pages, copies too: a row per host and node with its pages and importance."""
    return _tree(_read(pages, key, url, html))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text (blocks joined by line ends) and n_chars."""
    read = _read(pages, key, url, html)
    # Stored, so that joins see how small they are: a site has few branches that many pages share.
    tree = stored(_tree(_distinct(read)).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < 1)).select("host", "node", "importance"))
    branches = read.select("row", "host", F.inline("limits"))
    gone = branches.join(tree, ["host", "node"]).where(F.col("importance") < F.col("under")).groupBy("row").agg(F.collect_set("node").alias("gone"))
    cut = read.select("row", "key", "url", "blocks").join(stored(gone), "row", "left")
    left = F.filter("blocks", lambda b: ~F.arrays_overlap(b["branches"], F.coalesce("gone", F.array().cast("array<bigint>"))))
    text = F.array_join(F.transform(F.when(F.size(left) > 0, left).otherwise(F.col("blocks")), lambda b: b["text"]), "\n")
    return cut.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
