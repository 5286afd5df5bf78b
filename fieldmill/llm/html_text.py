"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common

#: Parts in which a host's distinct skeletons are aligned first, so that a host with many pages is not one task.
SALTS = 32
#: Elements nested deeper than this are one with the element at this depth, in wrappers and paths; their text is read all the same.
DEPTH = 64
#: A host's pages from which texts and masses count, the share of them with the same text in a slot that makes it part of
#: the template, and the share of an element's varying text that leads to one of its children.
PAGES, TEMPLATE, LEADS = 5, 0.9, 0.5
#: Hosts whose wrappers are broadcast at most; more are joined by a shuffle.
BROADCAST_HOSTS = 20_000
_ATTRIBUTES = r"(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b" + _ATTRIBUTES + r">.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)(" + _ATTRIBUTES + r")>|<[!?][^<>]*+>|([^<]+|<)", re.S | re.I)
# Elements by their role in HTML, those that hold running text, and class words of what is not content.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOT_CONTENT = set("nav header footer aside form menu dialog button fieldset head title".split())
MAIN = set("article main".split())
TEXT_LEVEL = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr tbody table pre blockquote figure figcaption".split())
BOILERPLATE = set("nav navbar navigation menu header footer sidebar aside ad ads adv advert advertisement banner sponsor sponsored promo promotion cookie cookies consent notice alert popup modal newsletter subscribe signup share social related recommended breadcrumb breadcrumbs comment comments reply replies disqus pagination pager toolbar masthead widget legal copyright skip".split())
# Words that a class or id of boilerplate may have besides, which say where or how it is laid out.
LAYOUT = set("area bar block bottom box button center column container fixed global group inner item items left link links list main outer page primary right row secondary section site slot sticky to top unit wrap wrapper".split())
#: Marks of a wrapper's groups.
OPTIONAL, REPEATED = 1, 2
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[_-]+")
NUMBER = re.compile(r"[0-9]{3,}|/")
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


@dataclass
class Node:
    """An open element: its name, whether it or one above is boilerplate, and whether it or one above is main content."""

    tag: str
    label: str
    dropped: bool
    main: bool


def boilerplate(value: str) -> bool:
    """Whether a class among the value's is one of boilerplate: all its parts between hyphens are words of boilerplate or layout, one of them the former. `cookie-banner` is, `legal-news` is not."""
    for name in value.split():
        parts = [p for p in PARTS.split(name.lower()) if p and not p.isdigit()]
        if any(p in BOILERPLATE for p in parts) and all(p in BOILERPLATE or p in LAYOUT for p in parts):
            return True
    return False


def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(tag with its first class, boilerplate, main). An element that is main by its name or role is not boilerplate by a class."""
    drop, first, main, by_class = tag in NOT_CONTENT, "", tag in MAIN, False
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                first = first or (value.split() or [""])[0]
                by_class = by_class or boilerplate(value)
            elif name == "role":
                drop, main = drop or value.lower() in ROLES, main or value.lower() in ("main", "article")
            elif name == "hidden" and tag != "input" or name == "aria-hidden" and value == "true":
                drop = True
            elif name == "itemprop" and value == "articleBody":
                main = True
    drop = drop or by_class and not main
    first = NUMBER.sub("", first)  # a long number in a class or id differs from page to page
    return (f"{tag}.{first}" if first else tag), drop, main


def walk(page: str) -> Iterator[tuple[str, str, list[Node]]]:
    """(kind, value, open elements): 'open' and 'close' with a label, 'text' with its characters. Scripts, styles and comments are passed over."""
    stack: list[Node] = []
    count: Counter[str] = Counter()  # open elements of each name
    outer: list[int] = []  # places in the stack of those that are not inline

    def closed(at: int) -> Iterator[tuple[str, str, list[Node]]]:
        while len(stack) > at:
            yield "close", stack[-1].label, stack
            count[stack.pop().tag] -= 1
            if outer and outer[-1] >= len(stack):
                outer.pop()

    for m in TOKEN.finditer(page):
        if m[5] is not None:
            yield "text", m[5], stack
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if count[tag] > 0:
                yield from closed(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        label, drop, main = _label(tag, m[4])
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and outer and stack[outer[-1]].tag == tag:  # an open one of the same kind ends here
            yield from closed(outer[-1])
        above = stack[-1] if stack else None
        node = Node(tag, label, drop or bool(above and above.dropped), main or bool(above and above.main))
        if tag in VOID or m[4].endswith("/"):
            yield "void", label, stack
        else:
            if tag not in INLINE:
                outer.append(len(stack))
            stack.append(node)
            count[tag] += 1
            yield "open", label, stack


@dataclass
class Block:
    """A block of text, its place (labels from the root), and whether that lies in boilerplate by the names of its elements."""

    path: str
    dropped: bool
    text: str


def read(page: str) -> tuple[list[Block], tuple]:
    """(blocks in page order, skeleton): the skeleton is the page's token stream as nested atoms (label, flag, inner, mark),
    texts as ("#",), equal neighbours folded into one repeated group."""
    blocks: list[Block] = []
    piece: list[str] = []
    labels: list[str] = []
    paths = [""]
    top: list = []
    open_: list[tuple[str, int, list]] = []
    deep = 0  # open elements below DEPTH
    hidden = False

    def flush() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                blocks.append(Block(paths[-1], hidden, text))
                at = open_[-1][2] if open_ else top
                if not at or at[-1] != ("#",):
                    at.append(("#",))

    def close() -> None:
        label, flag, inner = open_.pop()
        (open_[-1][2] if open_ else top).append((label, flag, tuple(fold(inner)), 0))

    for kind, value, stack in walk(page):
        if kind == "text":
            if (now := bool(stack and stack[-1].dropped)) != hidden:
                flush()
                hidden = now
            piece.append(value)
            continue
        if kind == "void":
            if value.split(".")[0] in ("br", "hr"):
                flush()
            continue
        node = stack[-1]
        if node.tag in INLINE:
            continue
        flush()
        if kind == "open":
            if len(labels) >= DEPTH:
                deep += 1
                continue
            labels.append(node.label)
            paths.append(f"{paths[-1]}/{node.label}")
            open_.append((node.label, 2 * node.dropped + node.main, []))
        elif deep:
            deep -= 1
        else:
            close()
            labels.pop()
            paths.pop()
    flush()
    while open_:
        close()
    return blocks, tuple(fold(top))


def fold(atoms: list) -> list:
    """Resolves neighbours of one label into a repeated group: they are aligned with each other until one is left."""
    out: list = []
    for x in atoms:
        if out and out[-1][0] == x[0]:
            y = merge(out[-1], x)
            out[-1] = y if len(y) == 1 else (*y[:3], y[3] | REPEATED)
        else:
            out.append(x)
    return out


def merge(a: tuple, b: tuple) -> tuple:
    """Two atoms of one label as one: the contents are aligned, and marks of either stay."""
    return a if a == b or len(a) == 1 else (a[0], max(a[1], b[1]), tuple(align(a[2], b[2])), a[3] | b[3])


def optional(atom: tuple) -> tuple:
    return atom if len(atom) == 1 else (*atom[:3], atom[3] | OPTIONAL)


def align(a: tuple, b: tuple) -> list:
    """Aligns two token streams by labels; an atom that only one of them has stays, as an optional group.

    The longest common subsequence of labels is matched and matched atoms are aligned in turn; no atom is lost, so both
    streams read by the result.
    """
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return fold([*out, *map(optional, a[i:]), *map(optional, b[j:])])


def wrapper_of(skeletons: list[tuple]) -> tuple:
    """The wrapper of a host's pages: each skeleton in turn is aligned with what the earlier ones gave."""
    out: tuple = ()
    for s in skeletons:
        out = s if not out else tuple(align(out, s))
    return out


def named_mains(wrapper: tuple) -> list[str]:
    """Paths of the outermost elements of a wrapper that are main content by name and hold text."""
    found: list[str] = []

    def holds_text(atom: tuple) -> bool:
        return atom[0] == "#" or (atom[1] < 2 and any(map(holds_text, atom[2])))

    def visit(atoms: tuple, path: str) -> None:
        for x in atoms:
            if x[0] == "#" or x[1] >= 2:
                continue
            here = f"{path}/{x[0]}"
            if x[1] & 1 and holds_text(x):
                found.append(here)
            else:
                visit(x[2], here)

    visit(wrapper, "")
    return sorted(set(found))


def varying_main(wrapper: tuple, mass: dict[str, int]) -> list[str]:
    """The path of a wrapper's main slot: from the root down to the child that holds most of the varying text, up to what
    is one of a repeated group, an element of running text, or one that holds text itself. Of the elements on the way the first that is main by name, else the last."""
    total: Counter[str] = Counter()
    for path, n in mass.items():
        labels = path.split("/")
        for i in range(1, len(labels) + 1):
            total["/".join(labels[:i])] += n
    atoms, here, way = wrapper, "", []
    while True:
        inner = {f"{here}/{x[0]}": x for x in atoms if x[0] != "#"}
        best = max(inner, key=lambda k: (total[k], k), default=None)
        if best is None or total[best] < LEADS * total[here] or not total[best]:
            break
        x = inner[best]
        if x[3] & REPEATED or x[0].split(".")[0] in TEXT_LEVEL:
            break
        way.append((best, x[1]))
        if ("#",) in x[2]:
            break
        atoms, here = x[2], best
    if not way:
        return []
    return [next((k for k, flag in way if flag & 1), way[-1][0])]


def text_key(path: str, text: str) -> int:
    """64 bits, signed, of a block's place and text."""
    return xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(page: str, mains: list[str], template: set[int]) -> str:
    """The text of a page's blocks within the wrapper's main slots, all of it; if the page has none of them, what is outside of boilerplate and not one of the template's texts."""
    slots = tuple(mains)
    inside: list[str] = []
    outside: list[str] = []
    for b in read(page)[0]:
        if b.dropped:
            continue
        if any(b.path == m or b.path.startswith(m + "/") for m in slots):
            inside.append(b.text)
        elif not inside and not (template and text_key(b.path, b.text) in template):
            outside.append(b.text)
    return " ".join(inside if inside else outside)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One pass over the pages, as a table: rows (host, shape) with skeletons, and (host, path, key, n, chars) with the
    blocks' places and texts, pages with them and their lengths; path '' counts whole pages. Rows of a batch are added up."""
    common.arrow_batches(pages.sparkSession)
    rows = pages.select(_host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes: set[tuple[str, str]] = set()
            counts: Counter[tuple[str, str, int, int]] = Counter()
            for host, page in zip(b["host"].to_pylist(), b["_t"].to_pylist()):
                blocks, shape = read(page)
                shapes.add((host, json.dumps(shape)))
                counts.update({(host, x.path, text_key(x.path, x.text), len(x.text)) for x in blocks if not x.dropped} | {(host, "", text_key("", page), 0)})
            s, c = sorted(shapes), list(counts)
            none = [None] * len(s)
            columns = [[h for h, _ in s] + [x[0] for x in c], [x for _, x in s] + [None] * len(c), none + [x[1] for x in c], none + [x[2] for x in c], none + [counts[x] for x in c], none + [x[3] for x in c]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 3)], names=["host", "shape", "path", "key", "n", "chars"])

    return common.written(rows.mapInArrow(run, "host string, shape string, path string, key long, n long, chars long"), "pages")


def wrappers(found: DataFrame) -> DataFrame:
    """host, mains (paths of the main slots), template (keys of the texts that belong to the wrapper). found: evidence().

    Distinct skeletons of a host are aligned in parts, then the parts' wrappers: the result has the host's optional and
    repeated groups and text slots. A text that nearly all pages have at one place is template; what else stands at a place varies
    and gives it mass, and the main slot is where the mass leads. Hosts of fewer than PAGES distinct pages, or with one
    page in half of them or more, show no difference between template and content: there names of elements decide.
    """
    texts = found.where("path <> ''").groupBy("host", "path", "key").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"))
    whole = found.where("path = ''").groupBy("host", "key").agg(F.sum("n").alias("n"))
    sizes = whole.groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("unlike"), F.max("n").alias("most"))
    sizes = sizes.where((F.col("unlike") >= PAGES) & (F.col("most") * 2 < F.col("pages")))
    marked = common.cut(texts.join(sizes, "host").select("host", "path", "key", F.when(F.col("n") >= TEMPLATE * F.col("pages"), F.col("key")).alias("fixed"), (F.col("n") * F.col("chars")).alias("mass"))
                        .groupBy("host", "path").agg(F.collect_list("fixed").alias("fixed"), F.sum(F.when(F.col("fixed").isNull(), F.col("mass")).otherwise(0)).alias("mass")))
    known = marked.groupBy("host").agg(F.flatten(F.collect_list("fixed")).alias("template"), F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "mass")))).alias("mass"))

    def tuples(x):
        return tuple(map(tuples, x)) if isinstance(x, list) else x

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        w = wrapper_of([tuples(json.loads(s)) for s in sorted(pdf["shape"])])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "shape": [json.dumps(w)]})

    shapes = found.where("shape IS NOT NULL").select("host", "shape").distinct()
    parts = shapes.withColumn("_s", F.pmod(F.xxhash64("shape"), F.lit(SALTS))).groupBy("host", "_s").applyInPandas(part, "host string, shape string")
    aligned = parts.groupBy("host").applyInPandas(part, "host string, shape string")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mains = []
            for shape, mass in zip(b["shape"].to_pylist(), b["mass"].to_pylist()):
                w = tuples(json.loads(shape))
                mains.append((varying_main(w, json.loads(mass)) if mass else []) or named_mains(w))
            yield pa.RecordBatch.from_arrays([b["host"], pa.array(mains, pa.list_(pa.string())), b["template"]], names=["host", "mains", "template"])

    return aligned.join(known, "host", "left").select("host", "shape", "template", "mass").mapInArrow(choose, "host string, mains array<string>, template array<long>")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages, repeated ones too.

    The wrapper of a page's host names the slots of the main text and the template's texts. All text in the slots stays,
    such as headings that all articles of a host share. A page that lacks the slots, as one that differs from all others
    of its host may, gives what is outside of boilerplate and of the template. A null or empty html gives
    an empty text; pages with a null url share the host ''. Unclosed and wrongly nested elements are closed where their
    parents are; any depth and length is read in time linear in the length. An empty table gives an empty result; other
    columns are not read. Pages are read whole.
    """
    known = common.cut(wrappers(evidence(pages, url_col, html_col)))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_t")).withColumn("_h", _host(F.col("url")))
    small = F.broadcast(known) if known.count() <= BROADCAST_HOSTS else known
    joined = rows.join(small, rows["_h"] == known["host"], "left").select("page_id", "url", "_t", "mains", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(t, m or [], set(k or [])) for t, m, k in zip(b["_t"].to_pylist(), b["mains"].to_pylist(), b["template"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(common.table(spark, sf_dir, "pages"))
