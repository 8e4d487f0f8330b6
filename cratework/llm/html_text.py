"""Main text of web pages by scoring the tree of elements."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from cratework.llm.per_row import append_columns

# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, or a form's own controls.
RAW = set(
    "script style noscript template textarea title iframe noembed noframes select audio video "
    "annotation".split()
)
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An open element of the key ends when one of the values starts, up to an enclosing boundary.
IMPLIED_END = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "option": {"option", "optgroup"},
    "p": CLOSES_P,
}
ENDED_BY = {
    name: {open_name for open_name, starts in IMPLIED_END.items() if name in starts}
    for name in set().union(*IMPLIED_END.values())
}
BOUNDARY = set("table ul ol dl menu td th body html article section div main aside nav".split())
BOILERPLATE = set("nav footer aside menu dialog button".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())
#: What only a whole page has. An element around articles, and a form around any, is the page.
ARTICLES = {"main", "article"}
PAGE_PARTS = ARTICLES | {"nav", "header", "footer"}
CONTROLS = set("input textarea select button label".split())

# Words of class or id names. The first kind marks comments, notices, adverts, forms
# and menus, whatever stands beside it; the second kind gives way to a word for content.
MARKED = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo|promoted|promotions?|comments?|commentlist|disqus"
    r"|discussion|reply|replies|respond|cookies?|cookie\w+|consent|gdpr|notices?|alerts?|popups?|modal|overlay"
    r"|newsletters?|subscribe|subscription|signup|login|share|sharing|nav|navbar|navigation|menus?"
    r"|menubar|breadcrumbs?|sidebars?|footer|masthead|banner|outbrain|taboola|forms?|disclaimer"
)
MAYBE = re.compile(
    r"header|social|related|recommend\w*|widgets?|toolbar|pager|pagination|skip\w*|copyright"
    r"|search\w*|teasers?"
)
CONTENT = set("article body content entry main post story text".split())
#: After one of these, a name tells of the page's layout or state and not of the element itself.
DENIED = set("no not without with has have hide".split())
STATES = set("open closed enabled disabled on off".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|$)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HIDDEN_INPUT = re.compile(r"(?i)\btype\s*=\s*[\"']?hidden\b")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HYPHENED = re.compile(r"(?i)\b(side|nav|sign|pop)[-_](bar|up)")
#: Articles that are comments themselves.
_COMMENT = re.compile(r"(?i)(?:div[-_])?comments?(?![-_](?:open|closed|on|off)\b)(?:$|[^a-z])")
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "items", "dropped", "wraps", "weight", "score", "chars", "linked")

    def __init__(self, name: str, parent, dropped: bool = False, weight: float = 0.0):
        self.name, self.parent, self.dropped, self.weight = name, parent, dropped, weight
        self.wraps = False  # dropped only if it isn't the page itself
        self.items: list = []  # Nodes and strings, in page order
        self.score, self.chars, self.linked = 0.0, 0, 0


STRONG, WEAK = 2, 1


def _marks(name: str) -> tuple[int, bool]:
    """How one class or id name marks boilerplate, and whether it names content.

    ``post-comments``, ``commentsBody`` and ``notice-body`` mark, whatever else they say;
    ``content-with-sidebar``, ``no-sidebar`` and ``comments-open`` tell of a layout or a state.
    """
    words = [w.lower() for w in _NAME_WORDS.findall(_HYPHENED.sub(r"\1\2", name))]
    content = not CONTENT.isdisjoint(words)
    for word, after in zip(words, [*words[1:], ""], strict=True):
        if word in DENIED and after:
            return 0, content
        if MARKED.fullmatch(word) and after not in STATES:
            return STRONG, content
    weak = not content and any(map(MAYBE.fullmatch, words))
    return WEAK if weak else 0, content


def _open(name: str, attributes: str, parent: Node, in_article: bool) -> Node:
    node = Node(name, parent, name in BOILERPLATE)
    if name == "form":
        node.wraps = True
    elif name == "header":
        node.dropped = not in_article
    if not attributes or attributes.isspace():
        return node
    found: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), html.unescape(value.strip("\"'")))
    role = found.get("role", "").lower()
    node.dropped |= role in ROLES and role != "form" or "hidden" in found
    node.wraps |= role == "form"
    node.dropped |= found.get("aria-hidden", "").lower() == "true"
    node.dropped |= "display:none" in found.get("style", "").lower().replace(" ", "")
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    marks = [_marks(n) for n in names]
    if any(content for _, content in marks):
        node.weight += 25
    if name in ("article", "main"):
        node.dropped |= any(map(_COMMENT.match, names))
    elif name not in ("html", "body"):
        node.dropped |= any(mark == STRONG for mark, _ in marks)
        node.wraps |= any(mark == WEAK for mark, _ in marks)
    return node


class _Tree:
    """The open elements while a page is read.

    Counts of open names say whether an end tag, or an end that a start tag implies, has an
    element to end, so that elements are climbed over only when they are then closed, and the
    time grows with the page's length however deep it is nested.
    """

    def __init__(self):
        self.root = self.node = Node("html", None)
        self.open = Counter({"html": 1})
        self.inline = [Counter()]  # open inline elements within each open block
        self.bounds = ["html"]
        self.ending = [Counter()]  # open elements with an implied end, within each boundary

    def push(self, node: Node) -> None:
        name = node.name
        self.node = node
        self.open[name] += 1
        if name in IMPLIED_END:
            self.ending[-1][name] += 1
        if name in BOUNDARY:
            self.bounds.append(name)
            self.ending.append(Counter())
        if name in BLOCK:
            self.inline.append(Counter())
        else:
            self.inline[-1][name] += 1

    def pop(self) -> Node:
        node = self.node
        name = node.name
        self.node = node.parent
        self.open[name] -= 1
        if name in BLOCK:
            self.inline.pop()
        else:
            self.inline[-1][name] -= 1
        if name in BOUNDARY:
            self.bounds.pop()
            self.ending.pop()
        if name in IMPLIED_END:
            self.ending[-1][name] -= 1
        return node

    def close(self, name: str) -> None:
        """An end tag; an inline one doesn't end a block."""
        if name in BLOCK:
            if not self.open[name] or name in ("html", "body"):
                return
        elif not self.inline[-1][name]:
            return
        while self.pop().name != name:
            pass

    def end_implied(self, name: str) -> None:
        """Ends what the start tag of ``name`` ends, within the boundary around it."""
        ended = ENDED_BY.get(name, ())
        # A table cell is the boundary of what is in it, and may be what ends.
        while self.bounds[-1] in ended or any(self.ending[-1][n] for n in ended):
            self.pop()


def parse(page: str) -> Node:
    """The tree of elements; end tags that are left out are put where HTML implies them."""
    tree = _Tree()
    root, at = tree.root, 0
    while at < len(page):
        match = _TOKEN.search(page, at)
        if match is None:
            tree.node.items.append(page[at:])
            break
        if match.start() > at:
            tree.node.items.append(page[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            if match[0].startswith("<![CDATA["):
                tree.node.items.append(html.escape(match[0][9:].removesuffix("]]>")))
            continue
        if match[1]:
            tree.close(name)
            continue
        ended = match[3].endswith("/")
        if name in RAW and not ended:
            if name in CONTROLS:
                tree.node.items.append(Node(name, tree.node))
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "html" or name == "body" and tree.open["body"]:
            continue
        tree.end_implied(name)
        if name in VOID:
            seen = name if not _HIDDEN_INPUT.search(match[3]) else "link"
            tree.node.items.append(" " if name == "br" else Node(seen, tree.node))
            continue
        inside = tree.open["article"] + tree.open["main"] > 0
        child = _open(name, match[3], tree.node, inside)
        tree.node.items.append(child)
        if not (ended and (name not in BLOCK)):
            tree.push(child)
    return root


def _post_order(root: Node) -> Iterator[Node]:
    """All elements, children before their parents."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += [item for item in node.items if isinstance(item, Node)]
    return reversed(order)


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """Text between block boundaries in page order: its block, clean text, linked characters."""
    found, texts, links = [], [], []

    def flush(owner):
        text = _SPACES.sub(" ", html.unescape("".join(texts))).strip()
        if text:
            found.append((owner, text, min(len(text), sum(links))))
        texts.clear()
        links.clear()

    stack = [(root, root, False, iter(root.items))]
    while stack:
        node, owner, linked, items = stack[-1]
        item = next(items, None)
        if item is None:
            stack.pop()
            if node is owner:
                flush(owner)
        elif isinstance(item, str):
            texts.append(item)
            if linked:
                links.append(len(html.unescape(item).strip()))
        elif not item.dropped:
            if item.name in BLOCK:
                flush(owner)
                stack.append((item, item, linked, iter(item.items)))
            else:
                inner = linked or item.name == "a"
                stack.append((item, owner, inner, iter(item.items)))
    return found


def _drop_unless_page(root: Node) -> None:
    """Drops forms and weakly marked elements, unless the page itself stands in them.

    That is so where they hold articles, for a form also the page's header, menu or footer, and
    where nothing would be left without them and they have no controls to fill in.
    """
    articles, page_parts, controls = set(), set(), set()  # elements that hold such
    kinds = ((ARTICLES, articles), (PAGE_PARTS, page_parts), (CONTROLS, controls))
    doubtful = []
    for node in _post_order(root):
        held = page_parts if node.name == "form" else articles
        if node.wraps and not node.dropped and id(node) not in held:
            node.dropped = True
            doubtful.append(node)
        for names, holders in kinds:
            if node.parent is not None and (id(node) in holders or node.name in names):
                holders.add(id(node.parent))
    if doubtful and not _blocks(root):
        for node in doubtful:
            node.dropped = id(node) in controls


def main_text(page: str | None) -> str:
    """The article of a page, a line per block; empty if the page has none.

    Elements that are menus, headers, footers, sidebars, notices, adverts, forms or comments by
    their kind, role, class or id are left out, however much text they hold.
    """
    root = parse(page or "")
    _drop_unless_page(root)
    return _article(root)


def _article(root: Node) -> str:
    """The lines of the container that scores most.

    Each block of text is worth a point, one for each comma and up to three for its length, of
    which its link density takes its share. Its parent element gets the points, the next gets
    half, further ancestors a third of that per level; articles and elements named like content
    start ahead. The element with most points, less its link density, is the container; its
    siblings join if they have a fifth of its points, or are running text. Of the container all
    blocks stay; of siblings, and of a whole body, lists and short lines that are mostly links go.
    """
    blocks = _blocks(root)
    if not blocks:
        return ""
    scored: list[Node] = []

    def give(node, points):
        if not node.score:
            starts = {"article": 30, "main": 25, "section": 3, "div": 5, "td": 3, "pre": 3}
            low = HEADINGS | {"th", "ul", "ol", "li", "dl", "table"}
            start = starts.get(node.name, -5 if node.name in low else 0)
            node.score = 1e-9 + start + node.weight
            scored.append(node)
        node.score += points

    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
        if len(text) < 25 or owner.name in HEADINGS:
            continue
        points = 1 + len(re.findall("[,،、，]", text)) + min(3, len(text) // 100)
        points *= 1 - linked / len(text)
        up = owner.parent if owner.name in ("p", "pre", "li", "blockquote") else owner
        for level in range(6):
            if up is None:
                break
            give(up, points / (1, 2, 6, 18, 54, 162)[level])
            up = up.parent
    nodes = list(_post_order(root))
    for node in nodes:
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    if scored:
        best = max(scored, key=lambda n: n.score * (1 - n.linked / max(1, n.chars)))
    else:
        # Short texts alone: an element made or named for content, or else the page.
        made = [n for n in nodes if n.chars and (n.weight or n.name in ("article", "main"))]
        best = max(made, key=lambda n: n.chars - n.linked, default=root)
    containers = {"article", "main", "body", "div", "section", "td", "html"}
    while best.parent is not None and best.name not in containers:
        best = best.parent
    around = best
    while around is not None and around.name != "article":
        around = around.parent
    best = around or best
    whole = best.name in ("body", "html")
    chosen = {id(best): not whole}  # whether all blocks within stay
    if best.parent is not None and not whole:
        for other in best.parent.items:
            if isinstance(other, Node) and other is not best and not other.dropped:
                density = other.linked / max(1, other.chars)
                enough = other.score >= max(10, 0.2 * best.score) and density < 0.25
                prose = other.name == "p" and other.chars > 80 and density < 0.25
                if enough or prose:
                    chosen[id(other)] = False
    # From the top down, so that every element is looked at once.
    inside: dict[int, bool | None] = {}
    waiting: list[tuple[Node, bool | None]] = [(root, None)]
    while waiting:
        node, state = waiting.pop()
        state = inside[id(node)] = chosen.get(id(node), state)
        waiting += [(item, state) for item in node.items if isinstance(item, Node)]
    lines = []
    for owner, text, linked in blocks:
        state = inside[id(owner)]
        links_only = linked > 0.5 * len(text) and (len(text) < 200 or owner.name == "li")
        if state or state is False and not links_only:
            lines.append(text)
    return "\n".join(lines)


def extract_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) of each whole page.

    NULL and empty pages, and pages without an article, have an empty text. Columns of these
    names are replaced. Pages are read where they are stored; nothing is shuffled. The time for a
    page grows with its length, however deep its elements are nested.
    """

    def prepare():
        def run(values):
            texts = [main_text(v) for v in values]
            return [(t, len(t)) for t in texts]

        return run

    return append_columns(pages, [html_column], "text string, n_chars bigint", prepare)
