"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted by how many of the
characters and tags are links (a composite text density); a node's density sum
adds its children's densities. The node of the largest sum is the core of the
article; the least density on its path to the body is the threshold that
neighbours of the path must reach to be taken as well.

What can't be seen (scripts, styles, hidden elements, form controls) is no
text. Nodes that name themselves as page furniture, by tag, role, class or id
(navigation, adverts, comments, ...), are told from the text around them by
their density as well, lowered by LOWERED: inside the core or beside its path
they go where that is below the threshold. One that holds the core, the page's
article or main element, or most of its text outside links isn't furniture.
A header inside an article or main element is the article's own. Inside these
a name that prose may bear as well (notice, legal, search, ...) lowers nothing
unless form controls or links speak for it, too.

A core that doesn't begin with a heading takes those before it: from the
nearest ancestor that has any there, outside furniture and lists of links.

Pages are read in time linear in their length, whatever is left open in them.

Defined results: null, empty and text-free pages give an empty text; repeated
rows give a row each; very long pages are read whole; an unclosed tag ends at
the next ">", an unclosed comment, script or style at the page's end, other
elements of raw text hold nothing then; extra columns
are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"[^>\"']*+")
# Elements whose content is raw text.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "caption", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
UNSEEN = frozenset(
    "script style noscript template textarea svg math iframe title head select button object embed canvas audio video xmp noembed noframes".split()
)
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
LOWERED = 0.02
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table tbody thead tfoot tr td th figure figcaption center address".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words by which class and id name page furniture.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adslot|banner|sponsor|sponsored|promo|promotion|"
    r"nav|navbar|navigation|menu|topbar|breadcrumb|breadcrumbs|header|masthead|footer|sidebar|side|aside|widget|widgets|"
    r"comment|comments|commentlist|disqus|replies|respond|discussion|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|toolbar|pagination|pager|copyright|legal|search)"
    r"(?:$|[\s_-]|\d)",
    re.I,
)
# Those of them that prose doesn't bear.
SURELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adslot|sponsor|sponsored|promo|promotion|breadcrumb|breadcrumbs|"
    r"sidebar|widget|widgets|comment|comments|commentlist|disqus|cookie|cookies|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|"
    r"share|sharing|related|recommended|recommendations|toolbar|pagination|pager)(?:$|[\s_-]|\d)",
    re.I,
)
CONTROLS = frozenset("form input button select textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
P_SCOPE = ("td", "th", "table", "button", "caption", "object")
# Start tags that end an open element of their own kind.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Node:
    __slots__ = ("tag", "items", "skip", "suspect", "named", "lowered", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "surely")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False, suspect: bool = False, named: bool = False, surely: bool = True):
        self.tag, self.parent, self.skip, self.suspect, self.named, self.surely, self.items = tag, parent, skip, suspect, named, surely, []


def _hidden(attributes: str) -> tuple[bool, bool]:
    """Whether attributes hide an element, and whether its role is furniture."""
    role = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and _INVISIBLE.search(value):
            return True, False
        role = role or name == "role" and value in ROLES
    return False, role


_WITHOUT = re.compile(r"\b(?:no|not|has|with|without)[-_]\S*")


def _named(attributes: str, words: re.Pattern = NAMED) -> bool:
    return bool(attributes) and any(n.lower() in ("class", "id") and words.search(_WITHOUT.sub("", v.strip("\"'"))) for n, v in _ATTRIBUTE.findall(attributes))


def tokens(page: str):
    """(text before, closing, tag name, attributes) of each tag; the last has
    no name. Each step goes on where the last one ended, and what is known to
    be missing from the rest of the page isn't looked for again."""
    at, text, end = 0, 0, len(page)
    gone: dict[str, bool] = {}  # what the rest of the page doesn't hold

    def find(what: str, start: int) -> int:
        if gone.get(what):
            return -1
        i = page.find(what, start)
        gone[what] = i < 0
        return i

    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            z = find("-->", lt + 4)
            yield page[text:lt], "", "", ""
            at = text = end if z < 0 else z + 3
            continue
        m = _TAG.match(page, lt + 1)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/") and (z := find(">", lt)) >= 0:
                yield page[text:lt], "", "", ""
                at = text = z + 1
            else:
                at = lt + 1
            continue
        z = m.end()
        while True:  # to the > that no quotes hold
            z = _QUOTED.match(page, z).end()
            if z >= end or page[z] == ">":
                break
            close = find(page[z], z + 1)
            if close < 0:
                z = find(">", z)
                break
            z = close + 1
        if z < 0 or z >= end:  # no > is left
            at = end
            break
        tag, attributes, after = m[2].lower(), page[m.end() : z], z + 1
        if not m[1] and tag in RAW and not attributes.endswith("/"):
            found = None if gone.get(tag) else _RAW_END[tag].search(page, after)
            gone[tag] = found is None
            if found is not None:
                after = found.start()
            elif tag in ("script", "style"):
                after = end
            else:
                attributes += "/"  # holds nothing
        yield page[text:lt], m[1], tag, attributes
        at = text = after
    yield page[text:], "", "", ""


_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def parse(page: str) -> Node:
    """A tree of nodes; items are texts and nodes in page order."""
    root = Node("body", None)
    open_: list[Node] = [root]
    where: dict[str, list[int]] = {}  # of each tag, the places of its open nodes
    suspects = False

    def last(kinds) -> int:
        return max((where[k][-1] for k in kinds if where.get(k)), default=0)

    def close(upto: int) -> None:
        while len(open_) > upto:
            where[open_.pop().tag].pop()

    for text, closing, tag, attributes in tokens(page):
        if text:
            open_[-1].items.append(text)
        if not tag or tag in ("html", "body"):
            if tag == "body" and not closing:
                close(1)
            continue
        if closing:
            if tag == "br":
                open_[-1].items.append(Node("br", open_[-1]))
            elif where.get(tag):
                close(where[tag][-1])
            continue
        if tag in CLOSES_P and where.get("p") and where["p"][-1] > (scope := last(P_SCOPE)):
            close(where["p"][bisect_right(where["p"], scope)])
        if tag in SIBLINGS:
            kinds, stops = SIBLINGS[tag]
            if (i := last(kinds)) > last(stops):
                close(i)
        if tag in HEADINGS and open_[-1].tag in HEADINGS:
            close(len(open_) - 1)
        unseen, role = _hidden(attributes) if attributes else (False, False)
        named = _named(attributes) and tag not in ("main", "article")
        furniture = role or tag in FURNITURE and not (tag == "header" and last(("article", "main")))
        node = Node(tag, open_[-1], unseen or tag in UNSEEN, furniture or named, named and not furniture, not named or _named(attributes, SURELY))
        suspects = suspects or node.named
        open_[-1].items.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            where.setdefault(tag, []).append(len(open_))
            open_.append(node)
    if suspects:
        _keep_wrappers(root)
    return root


def _keep_wrappers(root: Node) -> None:
    """Nodes that only a class or id calls furniture aren't if they hold the
    main element or most of the articles' text, or three quarters of the text of
    the article they are in (of the page, if it has no article elsewhere), all
    outside links and without the furniture in them."""
    nodes, stack, around = [], [root], {id(root): None}  # around: the article a node is in
    while stack:
        x = stack.pop()
        nodes.append(x)
        article = x if x.tag in ("article", "main") and not x.suspect else around[id(x)]
        for i in x.items:
            if isinstance(i, Node) and not i.skip and i.tag != "a":
                stack.append(i)
                around[id(i)] = article
    plain = {id(x): sum(len(_SPACE.sub(" ", i).strip()) for i in x.items if isinstance(i, str)) for x in nodes}
    articles, every = 0, plain
    kept: list[Node] = []
    for step in range(2):  # the articles' text of the page, then who holds it
        own = plain.copy()
        held, main = dict.fromkeys(plain, 0), dict.fromkeys(plain, False)
        for x in reversed(nodes):
            k = id(x)
            if x.tag in ("article", "main") and not x.suspect:
                held[k], main[k] = own[k], main[k] or x.tag == "main"
            if x.suspect and step:
                whole = every[id(around[k] or root)] if around[k] or held[k] == articles else math.inf
                if x.named and (main[k] or 2 * held[k] > articles or 4 * own[k] > 3 * whole):
                    kept.append(x)
                else:
                    continue
            if x.parent is not None:
                p = id(x.parent)
                own[p], held[p], main[p] = own[p] + own[k], held[p] + held[k], main[p] or main[k]
        articles, every = held[id(root)], own
    for x in [*kept, *_unsupported([x for x in nodes if x.suspect and x.named and not x.surely and around[id(x)]], root)]:
        x.suspect = False


def _unsupported(doubtful: list[Node], root: Node) -> list[Node]:
    """Those in which neither form controls nor links (a third of the text)
    speak for the name."""
    if not doubtful:
        return []
    nodes, stack = [], [root]
    while stack:
        x = stack.pop()
        nodes.append(x)
        stack.extend(i for i in x.items if isinstance(i, Node))
    found = {id(x): [0, 0, 0] for x in nodes}  # characters, those in links, controls
    for x in reversed(nodes):
        mine = found[id(x)]
        mine[0] += 0 if x.skip else sum(len(_SPACE.sub(" ", i).strip()) for i in x.items if isinstance(i, str))
        mine[1] = mine[0] if x.tag == "a" else mine[1]
        mine[2] += x.tag in CONTROLS
        if x.parent is not None:
            up = found[id(x.parent)]
            for k in range(3):
                up[k] += mine[k]
    return [x for x in doubtful if not found[id(x)][2] and 3 * found[id(x)][1] < found[id(x)][0]]


def _order(root: Node) -> list[Node]:
    """All nodes that can be seen, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(i for i in x.items if isinstance(i, Node) and not i.skip)
    return out


def densities(root: Node) -> list[Node]:
    """Densities and their sums, of all nodes; furniture's are lowered, and its
    text doesn't count for what it stands in."""
    nodes = _order(root)
    for x in nodes:
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        x.total = 0.0
        x.lowered = (LOWERED if x.suspect else 1.0) * (x.parent.lowered if x.parent is not None else 1.0)
    for x in reversed(nodes):
        for i in x.items:
            if isinstance(i, str):
                x.chars += len(_SPACE.sub(" ", i).strip())
            elif not i.skip and not i.suspect:
                x.chars += i.chars
                x.tags += i.tags + 1
                x.link_chars += i.link_chars
                x.link_tags += i.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
    share = root.link_chars / root.chars if root.chars else 0.0
    for x in nodes:
        if not x.chars:
            x.density = 0.0
        else:
            plain = max(x.chars - x.link_chars, 0)
            tags, links = max(x.tags, 1), max(x.link_tags, 1)
            base = math.log(x.chars * x.link_chars / max(plain, 1) + share * x.chars + math.e)
            kind = max(x.chars / max(x.link_chars, 1) * tags / links, 1.0)
            x.density = (x.chars / tags * math.log(kind, base) if x.link_chars else x.chars / tags) * x.lowered
    for x in nodes:
        if x.parent is not None and not x.suspect:
            x.parent.total += x.density
        if not any(isinstance(i, Node) and not i.skip and not i.suspect for i in x.items):
            x.total += x.density
    return nodes


def _path(x: Node | None) -> list[Node]:
    out = []
    while x is not None:
        out.append(x)
        x = x.parent
    return out


def _begins_with_heading(core: Node) -> bool:
    stack = [core]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip():
                return False
        elif not (x.skip or x.suspect):
            if x.tag in HEADINGS and x.chars:
                return True
            stack.extend(reversed(x.items))
    return False


def _headings(x: Node) -> list[Node]:
    """Headings in x, in page order, but not in furniture and lists of links:
    x itself if it is one, else the first-level ones."""
    out, stack = [], [x]
    while stack:
        y = stack.pop()
        if y.skip or y.suspect or 2 * y.link_chars >= max(y.chars, 1):
            continue
        if y.tag == "h1" or y is x and y.tag in HEADINGS:
            out.append(y)
        else:
            stack.extend(i for i in reversed(y.items) if isinstance(i, Node))
    return out


def _headlines(core: Node, kept: list[Node], root: Node) -> list[Node]:
    """kept and, if the core has no heading at its head, those before it in the
    nearest ancestor that has any there; in page order."""
    have, at = set(map(id, kept)), core
    if _begins_with_heading(core):
        return kept
    while at.parent is not None:
        found, there = [], False
        for x in at.parent.items:
            if x is at:
                break
            if isinstance(x, Node):
                got = _headings(x)
                there = there or bool(got) and id(x) in have
                found += [y for y in got if id(x) not in have]
        if found:
            place, stack = {}, [root]
            while stack:
                y = stack.pop()
                place[id(y)] = len(place)
                stack.extend(i for i in reversed(y.items) if isinstance(i, Node))
            return sorted([*kept, *found], key=lambda y: place[id(y)])
        if there:
            break
        at = at.parent
    return kept


def content(root: Node) -> list[Node]:
    """The roots of the kept subtrees, in page order; what goes from within
    them is marked."""
    for again in (True, False):
        nodes = densities(root)
        best = max(nodes, key=lambda x: x.total)
        path = _path(best)
        holders = [x for x in path if x.suspect]
        for x in holders:  # what holds the core isn't furniture
            x.suspect = False
        if not holders or not again:
            break
    if not best.chars:
        return []
    threshold = min(y.density for y in path)
    place = {id(x): i for i, x in enumerate(path)}
    core = best
    while core.parent is not None and (core.tag not in BLOCK or core.tag in TEXTUAL):
        core = core.parent  # a paragraph stands for the container it is in
    for x in path:
        if x.tag in ("article", "main") and place[id(x)] > place[id(core)]:
            core = x
            break
    kept, stack = [], [root]
    while stack:
        x = stack.pop()
        if x is core or id(x) not in place:
            links = x.link_chars / x.chars if x.chars else 0.0
            if x is core or x.density >= threshold and links < 0.5:
                kept.append(x)
            continue
        stack.extend(i for i in reversed(x.items) if isinstance(i, Node) and not i.skip)
    kept = _headlines(core, kept, root)
    inside, stack = set(), [core]
    while stack:
        x = stack.pop()
        inside.add(id(x))
        stack.extend(i for i in x.items if isinstance(i, Node) and not i.skip)
    whole = set(map(id, kept))
    for x in nodes:
        if x.suspect and x.density < threshold:
            x.skip = True
        # Lists of links beside the core are menus; those of the article itself stay.
        elif x.tag in BLOCK and x.link_tags >= 3 and x.link_chars > 0.6 * x.chars and id(x) not in inside and id(x) not in whole:
            x.skip = True
    return [x for x in kept if not x.skip]


def blocks(nodes: list[Node]) -> list[str]:
    """Block texts in page order; white space inside a block is one blank."""
    out, now = [], []

    def end() -> None:
        t = _SPACE.sub(" ", html.unescape("".join(now))).strip()
        now.clear()
        if t:
            out.append(t)

    for root in nodes:
        stack: list = [(root, 0)]
        end()
        while stack:
            x, i = stack.pop()
            if i == len(x.items):
                if x.tag in BLOCK:
                    end()
                continue
            stack.append((x, i + 1))
            item = x.items[i]
            if isinstance(item, str):
                now.append(item)
            elif item.tag in ("br", "hr"):
                end() if item.tag == "hr" else now.append("\n")
            elif item.skip:
                end() if item.tag in BLOCK else now.append(" " if item.tag == "select" else "")
            else:
                if item.tag in BLOCK:
                    end()
                stack.append((item, 0))
        end()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks(content(parse(page))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches):
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
