"""Main-text extraction by tree scoring.

Each page becomes a small tree. Blocks of text pass points (one, plus one for each comma, plus up to three for
length) to their container and half of them to the container above. Points are discounted by the container's share
of link text. The best container (or the article or main element around it) is kept whole, with those of its siblings
that score well or read as prose, and what stands among them; menus, page headers, footers, sidebars, notices, adverts,
scripts, styles and reader comments never count, nor do forms, unless their text shows that they wrap the page. Class words
that articles use, too (share, related, header), leave it to the share of links whether a box counts.

Each page is parsed on its own inside mapInArrow: no shuffle, memory bounded by the Arrow batch.

Nulls: null or empty HTML, and HTML without a text block, gives an empty text. Nothing is cut, however long the page.
Broken markup is read as far as it goes: tags without an end are text, stray quotes ordinary characters; time is linear.
Repeated rows each get their row; extra columns of the input are kept out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches

# Element names of HTML and usual class words of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split()
)
LEAF = set("p pre blockquote td th h1 h2 h3 h4 h5 h6 li dt dd figcaption caption summary".split())
FURNITURE = set("nav menu header footer aside head dialog search noscript template svg math object select button canvas audio video".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
SAFE = set("html body main article".split())


def _class_words(words: str) -> re.Pattern:
    return re.compile(r"(?:^|[\s_-])(?:" + words + r")(?:$|[\s_-])")


#: Words of furniture wherever they stand; of furniture unless they stand at a single paragraph; and of what its links decide about.
ALWAYS = _class_words(
    r"ad|ads|adbox|adslot|adsense|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|"
    r"sidebar\w*|comment|comments|commentlist|disqus\w*|replies|respond|breadcrumb\w*|menu|nav|navbar|navigation|topbar|toolbar|masthead|"
    r"widget|widgets|pagination|pager|skip"
)
BOXES = _class_words(r"notice\w*|alert|discussion|reply|footer")
LINKED = _class_words(r"share|sharing|social|related|recommend\w*|header|banner")
PART = re.compile(r"(?:^|\s)(?:post|entry|article|story|content|page|blog|news|section)[_-]+(?:header|banner|footer|notice)(?:$|\s)")
CLOSES = {  # an opening tag ends these open elements of the same parent
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>=]")
SKIP = re.compile(r"\s*")
ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
RAW_START = {t: re.compile(rf"<{t}(?=[\s/>])", re.I) for t in RAW}

KEEP, DROP, WEIGH = 0, 1, 2
CONTROLS = set("input select textarea button".split())
DEEP = 64  # an inline end tag looks for its start among so many open inline elements


def furniture(tag: str, attrs: str, in_article: bool) -> int:
    """DROP for an element that never counts as main text with all that is inside it, WEIGH where its links decide, else KEEP."""
    if tag in FURNITURE:
        return KEEP if tag == "header" and in_article else DROP
    if not attrs or tag in SAFE:
        return KEEP
    got = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTR.finditer(attrs)}
    if got.get("role") in ROLES or "hidden" in got or got.get("aria-hidden") == "true":
        return DROP
    if "display:none" in got.get("style", "").replace(" ", ""):
        return DROP
    names = f"{got.get('class', '')} {got.get('id', '')}"
    if ALWAYS.search(names):
        return DROP
    part = PART.search(names)
    if BOXES.search(names) and not part:
        return WEIGH if tag in LEAF else DROP if tag in BLOCK else KEEP
    if LINKED.search(names):
        return DROP if tag == "a" else KEEP if tag not in BLOCK or part or in_article and "header" in names else WEIGH
    return KEEP


def scan(source: str):
    """(text, tag, attributes) in page order: text alone, an opening tag with its attributes, or an ending tag with None.

    Quotes count only where an attribute's value begins, and only if they end; an opening bracket that nothing closes is text. Each
    character is looked at a bounded number of times: what has been found to be missing up to the end is not looked for again.
    """
    at, size = 0, len(source)
    last_end = source.rfind(">")
    last_quote = {q: source.rfind(q) for q in "\"'"}
    quotes, raw_end = True, {}

    def tag_end(i: int) -> int:
        while m := STOP.search(source, i):
            if m[0] == ">":
                return m.start()
            i = SKIP.match(source, m.end()).end()
            q = source[i : i + 1]
            if q and q in last_quote and last_quote[q] > i:
                i = source.find(q, i + 1) + 1
        return -1

    def raw_stop(tag: str, i: int) -> int:
        if raw_end.get(tag, 0) is not None and raw_end.get(tag, -1) < i:
            m = RAW_END[tag].search(source, i)
            raw_end[tag] = m.start() if m else None
        return size if raw_end[tag] is None else raw_end[tag]

    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            yield source[at:], None, None
            return
        if lt > at:
            yield source[at:lt], None, None
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 2)
            if end < 0:
                return
            at = end + 3
            continue
        if lt > last_end:
            yield source[lt:], None, None
            return
        next_one = source[lt + 1]
        if next_one in "!?" or next_one == "/" and not NAME.match(source, lt + 2):
            at = source.find(">", lt) + 1
            continue
        if next_one == "/":
            yield None, NAME.match(source, lt + 2)[0].lower(), None
            at = source.find(">", lt) + 1
            continue
        name = NAME.match(source, lt + 1)
        if not name:
            yield "<", None, None
            at = lt + 1
            continue
        tag, end = name[0].lower(), tag_end(name.end()) if quotes else -1
        if end < 0:
            quotes = False  # from here on no tag ends outside of quotes: take them for ordinary characters
            end = source.find(">", lt)
        attrs = source[name.end() : end]
        at = end + 1
        if tag not in RAW:
            yield None, tag, attrs
            continue
        stop = raw_stop(tag, at)
        if attrs.endswith("/") and (stop == size or RAW_START[tag].search(source, at, stop)):
            continue
        at = stop


class Tree:
    """Containers by number; every block: container, text and length of its link text."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.weigh = [-1], ["#root"], [False]
        self.forms: dict[int, int] = {}  # controls of every form by container
        self.blocks: list[tuple[int, str, int]] = []
        stack, parts, linked, links, dropped = [0], [], 0, 0, 0

        def flush() -> None:
            nonlocal parts, linked
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1], text, linked))
            parts, linked = [], 0

        names, drops = ["#root"], [False]  # of all open elements; inline ones are not containers
        count, outer = Counter(), [0]  # open elements by name; places of the blocks among them

        def pop() -> str:
            nonlocal dropped, links
            top = names.pop()
            count[top] -= 1
            dropped -= drops.pop()
            links -= top == "a"
            if top in BLOCK:
                flush()
                stack.pop()
                outer.pop()
            return top

        for text, tag, attrs in scan(source):
            if text is not None:
                if not dropped:
                    parts.append(text)
                    linked += len(text.strip()) if links else 0
                continue
            if attrs is None:
                # the end of an inline element does not end the block around it
                if not count[tag] or tag not in BLOCK and tag not in FURNITURE and tag not in names[outer[-1] :][-DEEP:]:
                    continue
                while pop() != tag:
                    pass
                continue
            if tag in CONTROLS and self.forms and "hidden" not in attrs.lower():
                for box in reversed(stack):
                    if box in self.forms:
                        self.forms[box] += 1
                        break
            if tag == "br":
                parts.append("\n") if not dropped else None
                continue
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                flush() if tag == "hr" else None
                continue
            if tag in BLOCK:
                flush()
                ends = CLOSES.get(tag, set()) | {"p"}
                keep = None
                for i in range(len(outer) - 1, 0, -1):
                    if names[outer[i]] not in ends:
                        break
                    keep = outer[i]
                while keep is not None and len(names) > keep:
                    pop()
            elif tag == "a" and count["a"] and "a" in names[outer[-1] :][-DEEP:]:
                while pop() != "a":
                    pass
            said = furniture(tag, attrs, count["article"] > 0)
            names.append(tag)
            count[tag] += 1
            drops.append(said == DROP)
            dropped += said == DROP
            links += tag == "a"
            if tag in BLOCK:
                self.parent.append(stack[-1])
                self.tag.append(tag)
                self.weigh.append(said == WEIGH)
                if tag == "form":
                    self.forms[len(self.tag) - 1] = 0
                stack.append(len(self.parent) - 1)
                outer.append(len(names) - 1)
        flush()

    def sums(self) -> tuple[list[int], list[int]]:
        """Length of text and of link text of every container, with those inside it."""
        length, linked = [0] * len(self.parent), [0] * len(self.parent)
        for at, text, link in self.blocks:
            length[at] += len(text)
            linked[at] += link
        for i in range(len(self.parent) - 1, 0, -1):  # parents come before their children
            length[self.parent[i]] += length[i]
            linked[self.parent[i]] += linked[i]
        return length, linked

    def drop_linked(self) -> None:
        """Leave out the weighed containers of which links make a large part, short boxes among them, and forms that are for filling in.

        A form that holds an article or main element, or 500 characters and 200 for each control, is a page's wrapper: it is kept.
        """
        if not any(self.weigh) and not self.forms:
            return
        length, linked = self.sums()
        out = [False] * len(self.parent)
        wraps = set()
        for i, tag in enumerate(self.tag):
            if self.forms and tag in ("article", "main") and length[i]:
                wraps.update(chain(self.parent, i))
        for i in range(1, len(out)):
            leaf = self.tag[i] in LEAF
            bad = self.weigh[i] and (2 * linked[i] >= length[i] if leaf else 10 * linked[i] >= 3 * length[i] or length[i] < 80)
            bad = bad or i in self.forms and i not in wraps and length[i] < max(500, 200 * self.forms[i])
            out[i] = bad or out[self.parent[i]]
        self.blocks = [b for b in self.blocks if not out[b[0]]]


def chain(parent: list[int], node: int):
    """A container and those above it."""
    while node >= 0:
        yield node
        node = parent[node]


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    tree = Tree(source)
    tree.drop_linked()
    if not tree.blocks:
        return ""
    n = len(tree.parent)
    points = [0.0] * n
    length, linked = tree.sums()
    for at, text, _ in tree.blocks:
        worth = 1 + text.count(",") + min(len(text) / 100, 3.0) if len(text) >= 25 else 0.0
        # the block's own element is a paragraph: its container gets the points
        box = tree.parent[at] if tree.tag[at] in ("p", "pre", "blockquote", "td", "h1", "h2", "h3", "h4", "li") else at
        if worth:
            points[max(box, 0)] += worth
            if box > 0:
                points[tree.parent[box]] += worth / 2
    bonus = {"article": 1.5, "main": 1.25}
    value = [
        p * (1 - min(linked[i] / length[i], 1.0)) * bonus.get(tree.tag[i], 1.0) if length[i] else 0.0
        for i, p in enumerate(points)
    ]
    best = max(range(n), key=lambda i: (value[i], -i))
    if not value[best]:
        known = [i for i in range(n) if tree.tag[i] in ("article", "main", "body") and length[i]]
        best = min(known, key=lambda i: (("article", "main", "body").index(tree.tag[i]), -length[i]), default=0)
    for wanted in ("article", "main"):
        up = [i for i in chain(tree.parent, best) if tree.tag[i] == wanted]
        if up:
            best = up[-1]
            break
    keep, above = {best}, tree.parent[best]
    beside = [i for i in range(n) if tree.parent[i] == above and above >= 0 and length[i]]
    density = {i: linked[i] / length[i] for i in beside}
    for i in beside:
        prose = tree.tag[i] in ("p", "blockquote", "pre") and length[i] > 80 and density[i] < 0.25
        if value[i] and value[i] >= 0.2 * value[best] or prose:
            keep.add(i)
    if len(keep) > 1:  # parts of one text: what stands among them belongs to it
        open_end = tree.tag[above] in ("body", "html", "#root")
        keep |= {i for i in beside if density[i] < 0.5 and (not open_end or min(keep) < i < max(keep))}
    inside = [False] * n
    for i in range(n):  # parents come before their children
        inside[i] = i in keep or (i > 0 and inside[tree.parent[i]])
    return " ".join(text for at, text, _ in tree.blocks if inside[at])


def extract(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """`keys`, text, n_chars of every row of `pages`."""
    small_batches(pages.sparkSession)
    kept = pages.select(F.struct(*keys).alias("row"), F.col(html).alias("html"))  # keys of any name

    @lean
    def run(batches):
        for b in batches:
            text = [main_text(x) for x in b.column(1).to_pylist()]
            made = [pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["row", "main", "size"])

    out = kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, main string, size long")
    return out.select("row.*", F.col("main").alias("text"), F.col("size").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, ["page_id", "url"])
