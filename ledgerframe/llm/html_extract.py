"""Op 8, HTML extraction by equivalence classes of template tokens.

Pages of a host are dealt into groups of about 64. In a group, a token is an element at its path or a text block at its
path; tokens with the same vector of occurrences over the group's distinct pages form an equivalence class. Classes that
are frequent, large and ordered alike in every page are valid, and nest: the class that occurs once a page is the
template's skeleton, others lie in its slots. What text the template doesn't hold is in slots, and the skeleton's
deepest container that holds most of it is the main slot. Extraction keeps that slot's text without the template's own blocks,
without nested menus, asides, forms and hidden parts, and without nested slots of the skeleton whose class or id names
them as comments, adverts or notices; elements of the article itself may have any name.

Tags decide only where no template can be found: on hosts with fewer than FEWEST distinct pages in a group. There the text in
an article or main element is kept, or all that no name marks. If most pages of a group would lose most of their slot to
the template's blocks (near copies of one page), these stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import checkpoint

#: Pages in a group about; hosts of more pages than that, whose counts are broadcast at most.
GROUP, FEW = 64, 1 << 17
#: Distinct pages that show a template; longest blocks by which pages are told apart, whatever is around them.
FEWEST, LONGEST = 4, 4
SCHEMA = "page_id long, url string, text string, n_chars long"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset("html head body address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul br center option select".split())
HOLDS = frozenset("body article main section div td center fieldset details".split())
CLOSES_P = BLOCK - frozenset("html head body br option select".split())
SKIP = frozenset("head nav aside form footer menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promoted promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer"
    " comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social"
    " related recommended recommendations pagination pager widget toolbar copyright skip".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Paths:
    """Paths of elements as numbers, a parent's below its children's: one entry for each, however deep."""

    def __init__(self):
        self.of: dict[tuple[int, str], int] = {}
        self.parent, self.depth, self.named, self.holds = [0], [0], [False], [False]

    def child(self, parent: int, name: str, named: bool, holds: bool) -> int:
        """``named``: its class or id names it as something beside the article; ``holds``: it may hold a whole article."""
        k = self.of.setdefault((parent, name), len(self.parent))
        if k == len(self.parent):
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.named.append(named)
            self.holds.append(holds)
        return k

    def within(self, chosen: set[int]) -> list[bool]:
        """Of each path, whether it or one above is chosen."""
        out = [0 in chosen]
        for k in range(1, len(self.parent)):
            out.append(k in chosen or out[self.parent[k]])
        return out


class Block(NamedTuple):
    path: int
    unwanted: bool
    article: bool
    text: str


class Page(NamedTuple):
    """Text blocks in order, and paths of elements as they open."""

    blocks: list[Block]
    opened: list[int]


def _unwanted(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in SKIP or tag == "header" and not inside:
        return True
    return bool(attributes) and ("hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in ROLES or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""))))


def _named(attributes: dict[str, str]) -> bool:
    return not NAMES.isdisjoint(w.lower() for w in WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}"))


def parse(page: str, paths: Paths) -> Page:
    blocks: list[Block] = []
    opened: list[int] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, path, unwanted, in an article
    still: Counter[str] = Counter()  # open elements by tag
    piece: list[str] = []
    at = 0

    def flush() -> None:
        if piece:
            if words := html.unescape("".join(piece)).split():
                _, path, bad, inside = stack[-1] if stack else ("", 0, False, False)
                blocks.append(Block(path, bad, inside, " ".join(words)))
            piece.clear()

    def pop(to: int) -> None:
        if any(x[0] in BLOCK or x[2] for x in stack[to:]):
            flush()
        still.subtract(x[0] for x in stack[to:])
        del stack[to:]

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            piece.append(page[at:])
            break
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if still[tag] > 0:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:  # nothing in it is text
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end or tag in ("script", "style", "textarea", "title"):
                at = end.end() if end else len(page)
            continue
        if tag in CLOSES_P and still["p"] > 0:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            like = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if any(still[x] > 0 for x in like):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in like:
                        pop(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "div", "article", "section"):
                        break
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        _, path, bad, inside = stack[-1] if stack else ("", 0, False, False)
        own = bad or _unwanted(tag, attributes, inside)
        if tag in BLOCK or own != bad:
            flush()
        if tag in BLOCK:
            path = paths.child(path, tag + "".join(f".{c}" for c in sorted(attributes.get("class", "").split())), bool(attributes) and _named(attributes), tag in HOLDS)
            opened.append(path)
        if not m[0].endswith("/>"):
            stack.append((tag, path, own, inside or not own and (tag in ("article", "main") or attributes.get("role") in ("main", "article"))))
            still[tag] += 1
    flush()
    return Page(blocks, opened)


class Template(NamedTuple):
    """The main slot's path, the template's own text blocks and the paths that its skeleton marks as something else."""

    slot: int
    fixed: set[tuple[int, str]]
    beside: set[int]


def template(pages: list[Page], paths: Paths) -> Template | None:
    """From the valid equivalence classes of distinct pages. Pages with the same longest blocks are one page, whatever is
    around them: copies of an article don't make it a template."""
    distinct = list({tuple(sorted((b.text for b in p.blocks), key=lambda x: (-len(x), x))[:LONGEST]): p for p in pages}.values())
    if len(distinct) < FEWEST:
        return None
    often: Counter[tuple[int, str]] = Counter()
    for p in distinct:
        often.update({(k, "") for k in p.opened} | {(b.path, b.text) for b in p.blocks})
    vectors: dict[tuple[int, str], list[int]] = {t: [0] * len(distinct) for t, n in often.items() if 10 * n >= 9 * len(distinct)}
    where: list[dict[tuple[int, str], int]] = []
    for k, p in enumerate(distinct):
        first: dict[tuple[int, str], int] = {}
        for i, t in enumerate([(x, "") for x in p.opened] + [(b.path, b.text) for b in p.blocks]):
            if t in vectors:
                vectors[t][k] += 1
                first.setdefault(t, i)
        where.append(first)
    classes: dict[tuple[int, ...], list[tuple[int, str]]] = defaultdict(list)
    for t, v in vectors.items():
        classes[tuple(v)].append(t)
    valid = []
    for v, tokens in classes.items():
        if len(tokens) >= 2:
            orders = {tuple(sorted(range(len(tokens)), key=lambda i: w[tokens[i]])) for w, n in zip(where, v, strict=True) if n}  # noqa: B023
            if len(orders) == 1:
                valid.append((v, tokens))
    fixed = {t for _, tokens in valid for t in tokens if t[1]}
    skeleton = {t[0] for v, tokens in valid if max(v) == 1 for t in tokens if not t[1]}
    beside = {k for k in skeleton if paths.named[k]}
    out = paths.within(beside)
    mass = [0] * len(paths.parent)
    for p in distinct:
        for b in p.blocks:
            if not b.unwanted and not out[b.path] and (b.path, b.text) not in fixed:
                mass[b.path] += len(b.text)
    for k in range(len(mass) - 1, 0, -1):  # children come after their parents
        mass[paths.parent[k]] += mass[k]
    good = [k for k in skeleton if paths.holds[k] and 2 * mass[k] >= mass[0] > 0]
    if not good:
        return None
    found = Template(max(good, key=lambda k: (paths.depth[k], mass[k], k)), fixed, beside)
    bare = found._replace(fixed=set())
    poorer = sum(2 * sum(map(len, _slot(p, found, paths))) < sum(map(len, _slot(p, bare, paths))) for p in distinct)
    return found if 2 * poorer <= len(distinct) else bare


def _slot(page: Page, t: Template, paths: Paths) -> list[str]:
    inside, out = _reach(paths, t)
    return [b.text for b in page.blocks if inside[b.path] and not out[b.path] and not b.unwanted and (b.path, b.text) not in t.fixed]


def _reach(paths: Paths, t: Template) -> tuple[list[bool], list[bool]]:
    """Of each path, whether the slot holds it, and whether it is beside the article; worked out once a template."""
    key = (t.slot, frozenset(t.beside), len(paths.parent))
    if getattr(paths, "reach", (None,))[0] != key:
        paths.reach = (key, (paths.within({t.slot}), paths.within(t.beside)))
    return paths.reach[1]


def main_text(page: Page, t: Template | None, paths: Paths) -> str:
    if t:
        if text := _slot(page, t, paths):
            return " ".join(text)
    marked = paths.within({k for k, x in enumerate(paths.named) if x})
    kept = [b for b in page.blocks if not b.unwanted and not marked[b.path] and not (t and (b.path, b.text) in t.fixed)]
    return " ".join([b.text for b in kept if b.article] or [b.text for b in kept])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null and empty html give an empty text; markup that never closes ends
    with the page; repeated pages count once for a template, and repeated rows are dealt into groups like others. Nesting of any
    depth takes memory by the element. A null url belongs to a host of its own."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))
    p = p.withColumn("key", F.unhex(F.md5("host"))).withColumn("row", F.monotonically_increasing_id())  # of a file, the same each time
    # only hosts of more than GROUP pages are split, each by its own count
    sizes = checkpoint(p.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")).where("groups > 1"))
    # a few are of bounded size and go to the pages; more meet them by shuffle
    sizes = F.broadcast(sizes) if sizes.limit(FEW + 1).count() <= FEW else sizes.hint("merge")
    dealt = p.join(sizes, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id", "url", "row"), F.col("groups")), F.lit(0))).drop("key", "groups", "row")

    def run(t: pa.Table) -> pa.Table:
        paths = Paths()
        parsed = [parse(x, paths) for x in t.column("html").to_pylist()]
        found = template(parsed, paths)
        out = [main_text(p, found, paths) for p in parsed]
        return pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    return dealt.groupBy("host", "part").applyInArrow(run, SCHEMA)
