"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|textarea|title|svg|annotation)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text stands in blocks of its own.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a selected subtree may begin at.
CONTAINER = frozenset("article blockquote body center details div dl fieldset figure main ol section table tbody td tr ul".split())
ASIDE = frozenset("aside button dialog datalist fieldset footer form head header menu nav object option optgroup search select".split())
#: Words of class, id and role that name what is not the article: what never is, and what may be, as words like these name articles too.
NEVER = (
    r"ads?|advert\w*|sponsor\w*|cookie\w*|consent|gdpr|popup|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|comments?|respond|replies|disqus\w*|"
    r"footer|pagination|pager|contentinfo|complementary|hidden"
)
SELDOM = r"promo\w*|banner|notice|modal|overlay|widget\w*|related|recommend\w*|share|sharing|social|header|masthead|toolbar|search|alert"
HINT = re.compile(rf"(?:^|[\s_-])(?:(?P<never>{NEVER})|{SELDOM})(?:$|[\s_-])", re.I)
#: Names that tell what a page has or lacks, not what an element is.
DESCRIBED = re.compile(r"(?<!\S)(?:has|no|with|without|hide|show|is|not)[_-]\S+", re.I)
#: Names of an article's head.
HEAD_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner)(?:$|[\s_-])", re.I)
#: What the characters of a container with such a word count against those of the article found without it.
NEVER_WEIGHT, SELDOM_WEIGHT = 0.02, 0.25
#: Headings that open reader comments.
COMMENTS = re.compile(r"\W*\d*\W*(?:(?:reader|user|all|leave a|post a|add a)\s+)?(?:comments?|replies|reply|responses|commentaires?|réponses|kommentare?|antworten|comentarios?|respuestas)\W*\d*\W*", re.I)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Start tags that end an open p, li, ... of the kinds named.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("ul ol dl table td th tr tbody div section article main body html form".split())
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "up", "inside", "aside", "hint", "head", "holds", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, aside: bool = False, hint: float = 1.0):
        self.tag, self.up, self.aside, self.hint = tag, up, aside, hint
        self.head = self.holds = False  # an article's own head; something that holds an article or main element
        self.inside: list = []  # nodes and strings in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def judged(tag: str, attributes: str) -> tuple[bool, float]:
    """Is an element left out, and the weight by which its name tells against it (1: it does not)?"""
    if tag in ASIDE:
        return True, 0.0
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False, 1.0
    weight = 1.0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            value = DESCRIBED.sub(" ", value)
            for hint in HINT.finditer(value):
                weight = min(weight, NEVER_WEIGHT if hint["never"] else SELDOM_WEIGHT)
        elif name == "aria-hidden" and value == "true":
            weight = 0.0
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", '""', attributes)) or re.search(r"display\s*:\s*none", attributes, re.I):
        weight = 0.0
    return weight < 1, weight


def named_head(attributes: str) -> bool:
    """Do class, id and role name an article's head, and nothing else that is not the article?"""
    told = " ".join("".join(values) for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role"))
    rest = HEAD_NAME.sub(" ", HEAD_NAME.sub(" ", told))
    return HEAD_NAME.search(told) is not None and not HINT.search(rest)


class Path:
    """The open elements, from the root down; where each tag, block and scope stands among them, so that closing one looks at no other."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {root.tag: [0]}
        self.blocks, self.scopes = [0], [0]

    def open(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)

    def cut(self, size: int) -> None:
        """Closes all but the first size elements."""
        while len(self.nodes) > max(1, size):
            at = len(self.nodes) - 1
            self.places[self.nodes.pop().tag].pop()
            for places in (self.blocks, self.scopes):
                if places[-1] == at:
                    places.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close(self, tag: str) -> None:
        """An end tag: an inline element is not closed beyond the block that it stands in; one that fits nothing is dropped."""
        at = self.last(tag)
        if at > 0 and (tag in BLOCK or at > self.blocks[-1]):
            self.cut(at)

    def make_room(self, tag: str) -> None:
        """A block's start tag ends an open p, li, ... of the same scope."""
        scope, closing = self.scopes[-1], CLOSES.get(tag, ())
        like = max((self.last(x) for x in closing), default=-1)
        if like > scope or like == scope > 0:
            self.cut(like)
        elif self.last("p") > scope:
            self.cut(self.last("p"))


def tree(page: str) -> Node:
    """The page's nodes; end tags that fit nothing are dropped, missing ones supplied."""
    root = Node("html", None)
    path, last = Path(root), 0
    for token in TOKEN.finditer(page):
        if token.start() > last:
            path.nodes[-1].inside.append(html.unescape(page[last : token.start()]))
        last = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag or tag == "html":
            continue
        if token[2] or token[5]:
            path.close(tag)
            continue
        if tag in BLOCK or tag == "body":
            path.make_room(tag)
        at = path.nodes[-1]
        attributes = token[4] if token[6] is None else token[7] or ""
        node = Node(tag, at, *judged(tag, attributes))
        if max(path.last("article"), path.last("main")) > 0:
            if tag == "header" or 0 < node.hint < 1 and tag in CONTAINER and named_head(attributes):
                node.aside, node.hint, node.head = False, 1.0, True  # of an article's own head only headings are shown
            elif tag in HEADING and node.hint:
                node.aside, node.hint = False, 1.0  # a name does not weigh on an article's headings
        if tag not in HEADING and at.head and tag in BLOCK:
            node.aside, node.hint, node.head = True, 0.0, False
        if tag in ("article", "main"):
            up = at
            while up is not None and not up.holds:
                up.holds = True
                if up.aside and up.hint:
                    up.hint = SELDOM_WEIGHT  # what it is called is doubtful if it holds an article
                up = up.up
        at.inside.append(node)
        if tag not in VOID and not (token[0].endswith("/>") and tag not in BLOCK):
            path.open(node)
    if last < len(page):
        path.nodes[-1].inside.append(html.unescape(page[last:]))
    return root


def text_of(node: Node, most: int) -> str:
    """The beginning of a node's text, for telling short headings."""
    out, stack, size = [], [node], 0
    while stack and size <= most:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            size += len(x)
        else:
            stack += reversed(x.inside)
    return "".join(out)


def mark_comments(root: Node) -> None:
    """Containers that a heading like "Comments" opens are left out."""
    stack = [root]
    while stack:
        node = stack.pop()
        inner = [x for x in node.inside if isinstance(x, Node)]
        if inner and inner[0].tag in HEADING and node.tag in CONTAINER and node.tag not in ("body", "main", "article") and COMMENTS.fullmatch(text_of(inner[0], 60).strip()):
            node.aside, node.hint = True, 0.0
        stack += inner


def in_order(root: Node) -> list[Node]:
    """Nodes that may belong to the article, parents first; the root itself in any case."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.aside and node is not root:
            continue
        out.append(node)
        stack += [x for x in reversed(node.inside) if isinstance(x, Node)]
    return out


def weigh(nodes: list[Node], body: Node) -> None:
    """Characters, tags, link characters and link tags of each subtree; its density; the sum of its children's densities.

    Density is characters per tag times the logarithm of (characters per link
    character times tags per link tag), to a base that rises with the part of links.
    """
    for node in reversed(nodes):
        link = node.tag == "a"
        for x in node.inside:
            if isinstance(x, str):
                node.chars += len(SPACES.sub(" ", x).strip())
            elif not x.aside:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if link:
            node.link_chars = node.chars
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / math.log(base) if base > 1.0 + 1e-9 else c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)))
    for node in nodes:
        node.total = sum(x.density for x in node.inside if isinstance(x, Node) and not x.aside)


def beside(nodes: list[Node], path: list[Node], threshold: float) -> dict[int, list]:
    """For the body, the rest of the path and what is looked into beside it: what of their content stays.

    Blocks beside the selected subtree stay that reach the threshold, or have as many characters other than
    links' a tag as the least on the path, since density rises with size; and within one parent what stands between
    such blocks, the headings before them, and the paragraphs and loose text where there are several.  Mostly links never stay.
    """
    least = min((n.chars - n.link_chars) / max(1, n.tags) for n in path)
    prose = lambda n: n.chars and n.link_chars * 2 <= n.chars and not n.aside
    opened = {id(n): n for n in path[1:]}
    stays = {id(n) for n in path}
    for n in nodes:
        if n.up is not None and id(n.up) in opened and id(n) not in stays and n.tag in BLOCK:
            if prose(n) and (n.density >= threshold or n.chars - n.link_chars >= least * max(1, n.tags)):
                stays.add(id(n))
            elif n.tag in CONTAINER:
                opened[id(n)] = n
    shown: dict[int, list] = {}
    for n in reversed([x for x in nodes if id(x) in opened]):
        chosen = [k for k, x in enumerate(n.inside) if (len(x.strip()) >= max(1, least) if isinstance(x, str) else id(x) in stays)]
        shown[id(n)] = out = []
        if not chosen:
            continue
        stays.add(id(n))
        ahead, picked = False, set(chosen)
        for k in range(len(n.inside) - 1, -1, -1):
            x = n.inside[k]
            within = chosen[0] < k < chosen[-1]
            if k in picked:
                ahead = True
                out.append(x)
            elif isinstance(x, str):
                if within or len(chosen) > 1 or not x.strip():
                    out.append(x)
            elif x.tag == "br":
                out.append(x)
            elif prose(x) and (within or len(chosen) > 1 and x.tag not in CONTAINER or ahead and re.fullmatch("h[1-6]", x.tag)):
                out.append(x)
            elif x.chars:
                ahead = False
        out.reverse()
    return shown


def blocks(node: Node, keep, shown: dict[int, list]) -> list[str]:
    """Texts of a subtree's blocks; of nodes in shown only what that tells."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        if text := SPACES.sub(" ", "".join(line)).strip():
            out.append(text)
        line.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif keep(x):
            if x.tag in BLOCK:
                close()
                stack.append(None)
            stack += reversed(shown.get(id(x), x.inside))
    close()
    return out


def prose_of(root: Node) -> int:
    """Characters outside links below a node whose name tells against it, of what else may be shown."""
    total, stack = 0, [root]
    while stack:
        node = stack.pop()
        if node is not root and node.aside or node.tag == "a":
            continue
        for x in node.inside:
            if isinstance(x, str):
                total += len(SPACES.sub(" ", x).strip())
            else:
                stack.append(x)
    return total


def main_text(page: str | None) -> str:
    """The article of a page, one block a line; empty where there is none.

    The container with the largest sum of its children's densities is selected,
    and with it the article or main element that holds it.  The least density on the path from there
    to the body is the threshold: within that element nested containers that are mostly links and do not reach it go.
    Where no such element holds the container, text beside it stays by the rules of beside().
    Elements whose class, id or role names something else are left out, unless, weighed down for their name, one
    still holds more prose than was found without it; then the article is sought in that one.
    A name counts as a whole word of a class, not where it tells what the page has or lacks (has-sidebar); it does not weigh on
    headings within an article, and less on what holds an article or main element.  Of an article's own head, by its tag or its name, the
    headings stay and other blocks go, as do paragraphs that are called notices, adverts and the like: the contract leaves out headers and notices.
    Text of formulas stays; that of drawings, scripts, styles and form controls does not.
    """
    if not page:
        return ""
    root = tree(page)
    mark_comments(root)
    text, marked = article(root)
    if marked:
        return text
    named, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.aside and node is not root:
            if node.hint:
                named.append(node)
            continue
        stack += [x for x in reversed(node.inside) if isinstance(x, Node)]
    if named:
        best = max(named, key=lambda n: n.hint * prose_of(n))
        if best.hint * prose_of(best) > len(text):
            return article(best)[0]
    return text


def article(root: Node) -> tuple[str, bool]:
    """The article below a node, and whether an article or main element holds it."""
    nodes = in_order(root)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    weigh(nodes, body)
    inside = {id(body)}
    for node in nodes:
        if node.up is not None and id(node.up) in inside:
            inside.add(id(node))
    choice = [n for n in nodes if id(n) in inside and (n is body or n.tag in CONTAINER) and n.chars]
    if not choice:
        return "", False
    best = max(choice, key=lambda n: n.total)
    if not best.total:
        best = body
    path, whole = [], best
    node: Node | None = best
    while node is not None:
        path.append(node)
        if node.tag in ("article", "main"):
            whole = node
        if node is body:
            break
        node = node.up
    threshold = min(n.density for n in path)
    on_path = {id(n) for n in path}
    marked = any(n.tag in ("article", "main") for n in path)
    shown = {} if marked else beside(nodes, path, threshold)

    def keep(n: Node) -> bool:
        if n.aside and n is not root:
            return False
        if n.tag in CONTAINER and n is not whole and id(n) not in on_path and id(n) not in shown:
            # a list of links, not prose
            if n.link_chars * 2 > n.chars and n.density < threshold:
                return False
        return True

    return "\n".join(blocks(whole if marked else path[-1], keep, shown)), marked


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row; one narrow pass.

    Null and empty pages, and pages without an article, give an empty text.  Repeated rows are
    each extracted; an empty table gives no rows.  Columns other than page_id, url
    and html are not read.
    """
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x) for x in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
