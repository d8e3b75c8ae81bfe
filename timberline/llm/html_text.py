"""Main text of web pages by tree scoring.

Every paragraph passes points for its length and commas to its parent and, halved, to its grandparent; a container's
points are discounted by its link density. The best container is kept with the siblings that score well or read like
paragraphs. Blocks inside are joined in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released, slices

#: Comments, declarations, text, and tags whose attributes are well formed; other tags are read by `attributes`.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\s+[^\s\"'>/=]+(?:=(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*)\s*(/?)>|<(/?)([a-zA-Z][^\s/>]*)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:=(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
#: The next attribute of a tag up to its value, or the tag's end.
NAME = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(\s*=\s*)?)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select noembed noframes".split())
DROP = frozenset("nav header footer aside form button menu dialog head canvas audio video fieldset label datalist map applet".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"html", "body"}
SCORED = frozenset("p pre td blockquote h1 h2 h3 h4 h5 h6 li dd".split())
#: Words in class, id or role that mark what is not the article.
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|disqus|respond|replies|reply|sidebar|side|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|header|masthead|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|toolbar|pagination|pager|login|signup|form|search|complementary|contentinfo|hidden)(?:$|[\s_-])", re.I)
#: Those of what readers wrote, which is often longer than the article.
REPLIES = re.compile(r"comments?|disqus|respond|replies|reply", re.I)
GOOD = re.compile(r"article|content|main|body|post|entry|text|story", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: End tags that don't close what is open outside of the article, main part or body they stand in.
INLINE = frozenset("p b i em strong span a".split())
SCOPES = frozenset("article main body".split())


class Node:
    __slots__ = ("tag", "parent", "children", "score", "noise", "named", "good", "length", "linked", "block", "inside")

    def __init__(self, tag: str, parent: "Node | None", noise: bool = False, good: bool = False, named: str = ""):
        self.tag, self.parent, self.noise, self.good, self.named = tag, parent, noise, good, named
        self.children: list = []
        self.score = 0.0
        self.length = self.linked = 0
        #: the nearest block, itself included, and whether it stands in an article
        self.block: Node | None = self if tag in CLOSES_P else parent.block if parent else None
        self.inside = parent is not None and (parent.inside or parent.tag == "article")


def marked(names: str) -> bool:
    """Whether a class, id or role says that this is not the article; layout names as has-sidebar don't."""
    return any(NOISE.search(n) and not re.match(r"(?:has|with|no|without|hide|show)[-_]", n, re.I) for n in names.split())


def plain(names: str) -> str:
    """The names of nothing but noise words, numbered ones too: sidebar, cookie-notice, comment-12, but not sidebar-right."""
    return " ".join(n for n in names.split() if all(NOISE.fullmatch(w) for w in re.split("[-_]", re.sub(r"([-_]?\d+)+$", "", n))))


def attributes(page: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """(name, value) pairs of a tag from behind its name, whether it closes itself, and where it ends.

    A quote opens a string only right after the equals sign; where it is never closed, the value ends at white space.
    """
    found = []
    while True:
        m = NAME.match(page, at)
        if m is None or m.end() == at:
            return found, False, len(page)
        at = m.end()
        if m.group(1):
            return found, page[at - 2] == "/", at
        value = ""
        if m.group(3):
            quote = page[at : at + 1]
            close = page.find(quote, at + 1) if quote in ("'", '"') and quote else -1
            if close >= 0:
                value, at = page[at + 1 : close], close + 1
            else:
                value = UNQUOTED.match(page, at).group()
                at += len(value)
        found.append((m.group(2), value))


UNQUOTED = re.compile(r"[^\s>]*")
CLOSERS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}


def parse(page: str) -> Node:
    """A lenient tree: open paragraphs end at the next block, open tags at their parent's end or the page's."""
    root = top = Node("html", None)
    at, end = 0, len(page)
    scopes: list[Counter] = [Counter()]  # open tags, by the article, main part or body they stand in
    whole: Counter = Counter()

    def leave(to: Node) -> Node:
        """Close everything below `to`."""
        node = top
        while node is not to:
            whole[node.tag] -= 1
            if node.tag in SCOPES and len(scopes) > 1:
                scopes.pop()
            scopes[-1][node.tag] -= 1
            node = node.parent
        return to

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m.group(7)
        if text is not None:
            top.children.append(text)
            continue
        tag, closes, itself, pairs = m.group(2), m.group(1), bool(m.group(4)), None
        if tag is None:
            if m.group(6) is None:
                continue
            tag, closes = m.group(6), m.group(5)
            pairs, itself, at = attributes(page, at)
        tag = tag.lower()
        if closes:
            if (scopes[-1] if tag in INLINE else whole)[tag] > 0:
                node = top
                while node.tag != tag:
                    node = node.parent
                top = leave(node.parent)
            continue
        if tag in RAW:
            close = CLOSERS[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag in CLOSES_P:
            node = top.block
            if node is not None and node.parent is not None and (node.tag == "p" or node.tag in ("li", "dd", "dt") and tag in ("li", "dd", "dt") and (node.tag == "li") == (tag == "li") or node.tag in HEADINGS and (tag in HEADINGS or tag in ("p", "div", "section", "article"))):
                top = leave(node.parent)
        if tag == "br":
            top.children.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                top.children.append(Node("hr", top))
            continue
        marks, hidden = "", False
        if pairs is None and m.group(3):
            pairs = ATTRIBUTE.findall(m.group(3))
        for name, value in pairs or ():
            name = name.lower()
            if name in ("class", "id", "role"):
                marks += " " + value.strip("\"'")
            elif name == "hidden" or name == "aria-hidden" and value.strip("\"'") == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
        dropped = tag in DROP or hidden
        # an article is noise by name only where readers wrote it
        counts = tag not in ("html", "body", "main") and marked(marks) and (tag != "article" or bool(REPLIES.search(plain(marks))))
        node = Node(tag, top, dropped or bool(counts), tag in ("article", "main") or bool(marks and GOOD.search(marks)), marks if counts and not dropped else "")
        node.inside &= not hidden and not (tag == "header" and counts)
        top.children.append(node)
        if not itself:
            top = node
            whole[tag] += 1
            scopes[-1][tag] += 1
            if tag in SCOPES:
                scopes.append(Counter())
    return root


def spare(root: Node) -> None:
    """Take the mark of noise from nodes that have it by name alone but hold the article.

    Such a node holds an article or main element while none stands outside of marked nodes and no more points do; or
    it holds most of the page's points, and if an article element stands outside or readers wrote it, outside is next to
    nothing. Nodes that are called nothing but a noise word, as sidebar, are spared only for an article element inside,
    and what readers wrote is not.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and (c.named or not c.noise)]
    if not any(n.named for n in order):
        return
    size: dict[Node, tuple[int, int]] = {}
    points: dict[Node, float] = {}
    holds: dict[Node, bool] = {}
    for node in reversed(order):
        length = linked = commas = 0
        own = direct = below = 0.0
        article = False
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                length += n
                linked += n * (node.tag == "a")
                commas += c.count(",") + c.count("，") + c.count("、")
                direct = max(direct, n)
            elif c in size:
                length += size[c][0]
                linked += size[c][0] if c.tag == "a" else size[c][1]
                below += points[c]
                article |= holds[c]
        if length and (node.tag in SCORED or node.tag in ("div", "section", "article", "main", "body", "html") and direct >= 25):
            own = (1 + commas + min(length / 100, 30)) * (1 - linked / length)
        size[node] = length, linked
        points[node] = max(own, below) if node.tag in SCORED else own + below
        holds[node] = article or node.tag in ("article", "main") and points[node] > 0
    while True:
        outside, marked_nodes, stack = [], [], [root]
        while stack:
            node = stack.pop()
            if node.noise:
                marked_nodes.append(node)
                continue
            outside.append(node)
            stack += [c for c in node.children if c in size]
        free = dict.fromkeys(outside, 0.0)
        for node in reversed(outside):  # points that don't come from marked nodes
            free[node] = points[node] - sum(points[c] - free.get(c, 0.0) for c in node.children if c in size)
        article = any(n.tag in ("article", "main") and free[n] > 1e-6 for n in outside)
        rest = free[root]
        for node in sorted(marked_nodes, key=lambda n: (holds[n], points[n]), reverse=True):
            only = plain(node.named)
            if REPLIES.search(only):
                continue
            most = not only and points[node] > points[root] / 2 and (rest < 10 or not article and not REPLIES.search(node.named))
            if most or holds[node] and not article and points[node] >= rest:
                node.noise, node.named = False, ""
                break
        else:
            return


def measure(root: Node) -> list[Node]:
    """Set length, linked length and points bottom up; the nodes that can hold an article."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.noise]
    for node in reversed(order):
        commas = 0
        for c in node.children:
            if isinstance(c, str):
                size = len(c.strip())
                node.length += size
                commas += c.count(",") + c.count("，") + c.count("、")
                if node.tag == "a":
                    node.linked += size
            elif not c.noise:
                node.length += c.length
                node.linked += c.length if node.tag == "a" else c.linked
        if node.tag in SCORED and node.length and node.parent is not None:
            points = 1 + commas + min(node.length / 100, 30)
            node.parent.score += points
            if node.parent.parent is not None:
                node.parent.parent.score += points / 2
        elif node.tag in ("div", "section", "article", "main", "body", "html", "td") and any(isinstance(c, str) and len(c.strip()) >= 25 for c in node.children):
            node.score += 1 + commas + min(sum(len(c) for c in node.children if isinstance(c, str)) / 100, 30)
    held = [n for n in order if n.tag not in SCORED or n.tag == "td"]
    for node in held:
        if node.good:
            node.score += 25 * bool(node.length)
        node.score *= 1 - node.linked / node.length if node.length else 0
    return [n for n in held if n.length]


def blocks(nodes: list) -> list[str]:
    """Texts of the blocks below these nodes, in page order, without noise."""
    out, line = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.noise:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.children)
        elif x.tag == "header" and x.inside:  # an article's own headings
            flush()
            stack += reversed(headings(x))
    flush()
    return out


def headings(node: Node) -> list[Node]:
    """The headings below a node, in page order, without noise."""
    out, stack = [], [c for c in reversed(node.children) if isinstance(c, Node)]
    while stack:
        x = stack.pop()
        if x.noise:
            continue
        if x.tag in HEADINGS:
            out.append(x)
        else:
            stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def main_text(page: str | None) -> str:
    """The article of a page; empty for null, empty and text-free pages and for those of nothing but noise. Ties go to
    the container that comes first. Class names alone don't make noise of what holds the article."""
    if not page:
        return ""
    root = parse(page)
    spare(root)
    return best_text(root)


def best_text(root: Node) -> str:
    """The blocks of the best container and of the siblings that belong to it."""
    held = measure(root)
    if not held:
        return ""
    best = max(held, key=lambda n: n.score)
    if best.score <= 0:
        best = root
    # a wrapper of nothing but the best container stands for it
    score = best.score
    while best.parent is not None and best.parent.length == best.length:
        best = best.parent
    if best.parent is None:
        return "\n".join(blocks([best]))
    keep = []
    for c in best.parent.children:
        if c is best:
            keep.append(c)
        elif isinstance(c, Node) and not c.noise:
            density = c.linked / c.length if c.length else 1.0
            if c.score >= max(10, 0.2 * score) or c.tag in SCORED and c.length and density < 0.25 or c.tag in ("section", "div") and c.length > 80 and density == 0 and c.score > 0:
                keep.append(c)
    return "\n".join(blocks(keep))


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with `text` (empty if none) and `n_chars`, its code points.

    Every row stands for itself: repeated rows give repeated results, null keys are kept, a null page has an empty text,
    and an empty table gives an empty one. Names of other columns don't matter; those kept may not be called text or n_chars.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema), "text string, n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in released(batches):
            for batch in slices(whole, column):
                text = [main_text(t) for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
                kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)
