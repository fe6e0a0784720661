"""A forgiving HTML reader and the scoring of its tree for the main text.

The reader knows raw text elements, optional end tags and broken markup; it keeps text, tags and what class, id and role say only.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

TAG = re.compile(r"""<!--|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z!?][^>]*$""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first name ends where one of the others begins.
ENDED_BY = {
    "p": BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "body", "html"},
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "head": frozenset(["body"]),
}
#: What an optional end tag does not look beyond.
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}

#: Never part of an article; a form around one, and a header with a heading in one, are let through.
DROPPED = frozenset("nav header footer aside form fieldset button select option datalist label dialog menu head object embed applet svg canvas audio video map".split())
#: Words of class and id that mark what is not the article, if the name has no word beside them that means something else.
CERTAIN = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr notice notices notification "
    "sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead footer comment comments commentlist disqus "
    "sharing newsletter subscribe subscription signup login popup modal overlay complementary contentinfo copyright disclaimer".split()
)
#: Such words that an article's own parts may have too: they count where links prevail, or beside the page's article.
DOUBTFUL = frozenset("alert discussion foot header legal promoted promotion rail recommended recommendations related replies reply respond search share skip social tagcloud tags trending".split())
WANTED = frozenset("article body content entry main page post text blog story hentry articlebody".split())
#: Words that mean nothing of their own in a name.
NEUTRAL = frozenset(
    "area bar block bottom box btn button buttons col column container elem element footer form global group holder icon icons inner item items layer left link links list lists module outer "
    "panel posts primary region right row secondary section sections site slot stories thread title top unit wrap wrapper articles the and of user users visitor your us".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@lru_cache(100_000)
def _name(token: str) -> tuple[int, bool]:
    """What one class or id says: 2 certainly not the article, 1 in doubt, 0 nothing; and whether a word of it is wanted."""
    words = {w.lower() for w in WORD.findall(token)}
    wanted = bool(words & WANTED)
    if words - CERTAIN - DOUBTFUL - NEUTRAL - WANTED:
        return 0, wanted
    return (2 if words & CERTAIN else 1 if words & DOUBTFUL else 0), wanted


class Node:
    """mark: see `_name`; gone: whether it and all below it can't be part of the article."""

    __slots__ = ("tag", "parent", "children", "mark", "wanted", "gone", "score")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.mark, self.wanted, self.score = 0, False, 0.0
        self.gone = tag in RAW


def _describe(node: Node, attributes: str) -> None:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            node.gone = True
        elif name == "role":
            node.mark = 2 if value.strip().lower() in ROLES else node.mark
        elif name in ("class", "id"):
            if name == "id" and (node.tag in HEADINGS or node.tag == "p"):
                continue  # an anchor made from what it says
            for token in value.split():
                mark, wanted = _name(token)
                node.mark = max(node.mark, min(mark, 1) if name == "id" and node.tag == "section" else mark)
                node.wanted = node.wanted or wanted


class _Open:
    """The open elements, with the places of those of each name and of those that are blocks."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at `place` and all within it."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def end(self, name: str) -> None:
        """An end tag closes the innermost element of its name, unless that is inline and a block lies within; stray ones say nothing."""
        places = self.places.get(name)
        if places and (name in BLOCK or not self.blocks or self.blocks[-1] < places[-1]):
            self.cut(places[-1])

    def begin(self, name: str) -> Node:
        """Closes what a new element of this name ends, and gives its parent. An open p, or item of the new one's kind, may lie above inline elements that were left open."""
        while name in ENDED_BY.get(self.nodes[-1].tag, ()):
            self.cut(len(self.nodes) - 1)
        if name in BLOCK:
            stop, ended = SCOPE.get(name, ()), None
            for place in reversed(self.blocks):
                tag = self.nodes[place].tag
                if tag in stop:
                    break
                if name in ENDED_BY.get(tag, ()):
                    ended = place
                elif tag not in ENDED_BY:
                    break
            if ended is not None:
                self.cut(ended)
        return self.nodes[-1]


def parse(html: str) -> Node:
    """The tree of a page; ends that are missing are put where a browser would. Its time is in proportion to the page, however deep."""
    root = Node("#root", None)
    open_ = _Open(root)
    pos, size = 0, len(html)
    while pos < size:
        m = TAG.search(html, pos)
        if m is None:
            open_.nodes[-1].children.append(html[pos:])
            break
        if m.start() > pos:
            open_.nodes[-1].children.append(html[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0] == "<!--":
                end = html.find("-->", pos)
                pos = size if end < 0 else end + 3
            continue
        name = name.lower()
        if m[1] or m[4]:
            open_.end(name)
            continue
        parent = open_.begin(name)
        node = Node(name, parent)
        if attributes := m[3] or m[6]:
            _describe(node, attributes)
        parent.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(html, pos)
            pos = size if end is None else end.end()
        elif name not in VOID and not (attributes and attributes.endswith("/") and name not in BLOCK):
            open_.push(node)
    _judge(root)
    return root


def _judge(root: Node) -> None:
    """Sets `gone` where an element can't be part of the article: by its name, by what its class or id says, by its links."""
    order, stack = [], [(root, False, False)]
    inside: dict[int, tuple[bool, bool]] = {}
    while stack:
        node, main, article = stack.pop()
        order.append(node)
        inside[id(node)] = main, article
        if node.mark < 2 and node.tag in ("article", "main"):
            main, article = True, article or node.tag == "article"
        stack.extend((c, main, article) for c in node.children if not isinstance(c, str))
    size: dict[int, tuple[int, int, bool, bool]] = {}  # characters, those in links, whether it has a heading, and an article
    for node in reversed(order):
        own, linked, heading, article = 0, 0, node.tag in HEADINGS, node.mark < 2 and node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
            elif c.tag not in RAW:
                x = size[id(c)]
                own, linked, heading, article = own + x[0], linked + x[1], heading or x[2], article or x[3]
        size[id(node)] = own, own if node.tag == "a" else linked, heading, article
    some = size[id(root)][3]
    for node in order:
        own, linked, heading, holds = size[id(node)]
        main, article = inside[id(node)]
        if node.tag in DROPPED and not (node.tag == "form" and holds) and not (node.tag == "header" and article and heading):
            node.gone = True
        elif node.tag in ("main", "body", "html", "#root") or (holds and (node.tag != "article" or node.mark < 2)):
            continue
        elif node.mark == 2 or (node.mark == 1 and (3 * linked > own or (some and not main))):
            node.gone = True


def unwanted(node: Node) -> bool:
    """Whether an element and all below it can't be part of the article."""
    return node.gone


def _measure(root: Node) -> tuple[dict[int, tuple[int, int]], list[Node]]:
    """Characters and characters in links of every wanted element, and the elements in page order, without recursion."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.gone)
    size: dict[int, tuple[int, int]] = {}
    for node in reversed(order):
        own = linked = 0
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
            elif id(c) in size:
                a, b = size[id(c)]
                own, linked = own + a, linked + b
        size[id(node)] = (own, own if node.tag == "a" else linked)
    return size, order


def _direct(node: Node) -> str:
    """The text that stands in an element itself or in inline elements below it."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag not in BLOCK and not unwanted(c):
            stack.extend(reversed(c.children))
    return "".join(parts)


START = {"article": 25.0, "main": 15.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "body": -5.0, "html": -10.0, "#root": -10.0}


def best(root: Node) -> list[Node | str | None]:
    """The page's text: the best container and, up to the main element, what stands beside it; None where a block ends.

    Without a main element it goes up to what holds the outermost article, and without an article to the body, but at least
    one step. Beside the best container stays all that is wanted and not mostly links, however short; headings stay though they be links.
    """
    size, order = _measure(root)
    scored: dict[int, Node] = {}
    for node in order:
        if node.tag not in BLOCK:
            continue
        text = _direct(node)
        n = len(text.strip())
        if not n:
            continue
        all_, linked = size[id(node)]
        points = (1 + text.count(",") + text.count("、") + text.count("，") + min(n / 100, 3)) * (1 - linked / max(1, all_))
        up, share = node.parent if node.tag in ("p", "li", "dd", "dt", "blockquote", "pre", "td", "th") or node.tag[0] == "h" else node, 1.0
        for level in range(4):
            if up is None:
                break
            up.score += points * share
            scored[id(up)] = up
            share = 0.5 if level == 0 else share / 1.5
            up = up.parent
    if not scored:
        return [root]

    def final(node: Node) -> float:
        all_, linked = size[id(node)]
        bonus = START.get(node.tag, 0.0) + (25.0 if node.wanted else 0.0) - 25.0 * (node.mark == 1)
        return (node.score + bonus) * (1 - linked / max(1, all_))

    top = max(scored.values(), key=final)
    least = max(10.0, 0.2 * final(top))

    def kept(children: list[Node | str]) -> list[Node | str]:
        """Text and inline elements in a row are judged as one."""
        out: list[Node | str] = []
        run: list[Node | str] = []

        def close() -> None:
            own = sum(len(c.strip()) if isinstance(c, str) else size[id(c)][0] for c in run)
            if 2 * sum(size[id(c)][1] for c in run if not isinstance(c, str)) <= own:
                out.extend(run)
            run.clear()

        for c in children:
            if isinstance(c, str):
                run.append(c)
            elif id(c) in size:  # not unwanted
                all_, linked = size[id(c)]
                if c.tag not in BLOCK:
                    run.append(c)
                    continue
                close()
                if c.tag in HEADINGS or 2 * linked <= all_ or (id(c) in scored and final(c) >= least):
                    out.append(c)
        close()
        return out

    path = [top]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    outer = {x.tag: x for x in path}  # the outermost of each name
    end = outer.get("main") or (outer["article"].parent if "article" in outer else outer.get("body", root))
    before: list[Node | str | None] = []  # from the container outwards
    after: list[Node | str | None] = []
    for at in path[: max(path.index(end), 1)] if top.parent else []:
        around = at.parent.children
        i = around.index(at)
        if at.tag in BLOCK:
            before.append(None)
            after.append(None)
        before += reversed(kept(around[:i]))
        after += kept(around[i + 1 :])
    return [*reversed(before), top, *after]


def blocks(nodes: list[Node | str | None]) -> list[str]:
    """The text of the elements, block by block in page order; None ends a block, white space is made one space, empty blocks go."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif not unwanted(x):
            if x.tag == "br":
                held.append(" ")
            elif x.tag in BLOCK:
                close()
                stack.append(None)
                stack.extend(reversed(x.children))
            else:
                stack.extend(reversed(x.children))
    close()
    return out


def main_text(html: str) -> str:
    """The article of a page, its blocks joined by newlines; empty if there is none."""
    return "\n".join(blocks(best(parse(html)))) if html else ""
