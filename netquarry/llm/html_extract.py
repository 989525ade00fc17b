"""HTML extraction by wrapper induction: same-host DOM trees aligned by simple tree matching.

Pages of a host are aligned in groups of at most ``GROUP``: runs of equally labelled siblings fold into one slot, the
first tree is the wrapper, and each further tree is matched to it by simple tree matching (the order-preserving matching
of equal labels of greatest size) and adds what the wrapper lacks. The slots then decide, once for all pages of the group: a
slot whose text stays the same over the different pages, or is mostly link text, is template; a slot whose text varies is
content, unless its tag or name gives it another role (navigation, headers and footers of the page, sidebars, notices,
adverts, forms, scripts, comments of readers). Names that may also stand for content (``_WEAK``) count as a whole name
only, or where the slot is constant or mostly links. Slots of article or main elements, where there are any, bound the
text; inside them constant slots go only if they are named, and link lists only with a weak name. A page without peers
relies on roles alone.

A null html is empty; markup is repaired as browsers do (implied ends, unknown ends ignored, cut tags dropped); pages
of equal html are one page to the constancy test, so copies do not turn an article into template; repeated rows are
extracted each; an empty table gives no rows; extra columns are ignored. Pages may be nested to any depth: nodes below
``DEPTH`` belong to the slot above them. Hot hosts are split over many groups by a hash of the page: at most ``HOT`` hosts
hold more than 1/HOT of all pages each, so their table is bounded and broadcast.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP, HOT = 64, 1000
LEAST_PAGES, CONSTANT, LINKS, DEPTH = 5, 0.8, 0.7, 150

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z!?][^>]*$).*", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msup msub mfrac msqrt".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("ul ol dl table select article section div main body html aside td th".split())
#: Elements that never hold the article's text.
_DROPPED = frozenset("head nav footer aside form script style noscript template iframe select button input textarea menu dialog object embed canvas audio video svg title".split())
#: Parts of class, id or role names that mark what is not the article.
_MARKS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner banners cookie cookies consent gdpr notice notices
menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside footer footers masthead topbar toolbar login signup subscribe newsletter sharing social
comment comments disqus widget widgets popup modal pagination pager complementary contentinfo""".split())  # fmt: skip
#: Names that do so as a whole, or where the slot's text agrees; as a part they may also name content.
_WEAK = frozenset("""search share form forms header site-header page-header related recommended recommendations more-stories alert alerts announcement reply replies respond discussion
feedback overlay skip-link copyright""".split())  # fmt: skip
_KEPT = frozenset("article main body html".split())


class Node:
    __slots__ = ("tag", "names", "hidden", "items", "parent")

    def __init__(self, tag, names="", hidden=False, parent=None):
        self.tag, self.names, self.hidden, self.parent = tag, names, hidden, parent
        self.items: list = []  # texts and nodes in page order


def parse(page: str) -> Node:
    root = Node("#root")
    at, top, n = 0, root, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            top.items.append(page[at:])
            break
        if m.start() > at:
            top.items.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                top = node.parent
            continue
        if tag in _ENDS_P or tag in _CLOSES:
            shut = _CLOSES.get(tag, {"p"})
            node = top
            while node is not root and node.tag not in shut and (node.tag in _INLINE or node.tag == "p" or (tag in _CLOSES and node.tag not in _SCOPE)):
                node = node.parent
            if node is not root and node.tag in shut:
                top = node.parent
        names, hidden = "", False
        if m[3]:
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])}
            names = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip().lower()
            hidden = "display:none" in found.get("style", "").replace(" ", "").lower() or bool(re.search(r"(^|\s)hidden(\s|=|/|$)", m[3]))
        node = Node(tag, names, hidden, top)
        top.items.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in _VOID:
            top = node
    return root


def marked(node: Node) -> bool:
    """The node's role is not the article's."""
    if node.tag in _DROPPED or node.hidden:
        return True
    if node.names and node.tag not in _KEPT:
        for name in node.names.split():
            if name in _MARKS or name in _WEAK or any(p in _MARKS for p in re.split(r"[-_:]+", name)):
                return True
    return False


def _weak(names: str) -> bool:
    return any(p in _WEAK for name in names.split() for p in re.split(r"[-_:]+", name))


def text_of(node: Node, skip: set[int]) -> str:
    """The text under a node: one space between blocks and for white space inside them."""
    return measured([node], skip)[0]


def measured(members: list[Node], skip: set[int]) -> tuple[str, int]:
    """The text under the nodes, and how many characters of it stand in links."""
    out: list[str] = []
    links, inside = 0, 0
    stack: list = [x for m in reversed(members) for x in ("\n", *reversed(m.items))]
    while stack:
        y = stack.pop()
        if y is None:
            inside -= 1
        elif isinstance(y, str):
            out.append(y)
            if inside:
                links += len(y.strip())
        elif not (id(y) in skip or marked(y) or (y.tag == "header" and not _in_article(y))):
            if y.tag == "a":
                inside += 1
                stack.append(None)
            if y.tag not in _INLINE:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(y.items))
    return " ".join(entities.unescape("".join(out)).split()), links


def _in_article(node: Node) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def roots(node: Node) -> list[Node]:
    """The article elements outside other articles and, where a main element has none, the main element; in page order."""
    found: list[Node] = []
    bare: set[int] = set()  # main elements without an article
    stack: list[tuple[Node, Node | None]] = [(x, None) for x in reversed(node.items) if not isinstance(x, str)]
    while stack:
        x, main = stack.pop()
        if marked(x):
            continue
        if x.tag == "article":
            found.append(x)
            if main is not None:
                bare.discard(id(main))
            continue
        if x.tag == "main":
            found.append(x)
            bare.add(id(x))
            if main is not None:
                bare.discard(id(main))
            main = x
        stack.extend((y, main) for y in reversed(x.items) if not isinstance(y, str))
    return [x for x in found if x.tag == "article" or id(x) in bare]


class Slot:
    """A wrapper node: equally labelled sibling runs of all pages aligned to it."""

    __slots__ = ("label", "children", "pages", "texts", "chars", "links")

    def __init__(self, label):
        self.label, self.children, self.pages, self.texts, self.chars, self.links = label, [], 0, Counter(), 0, 0

    def template(self, article: bool) -> bool:
        """The slot's pages say that it is no content."""
        if self.pages < LEAST_PAGES or self.label[0] in ("#root", "html", "body", "article", "main"):
            return False
        constant = self.texts.most_common(1)[0][1] >= CONSTANT * self.pages
        linked = self.links > LINKS * self.chars
        if not article:
            return constant or linked
        return bool(self.label[1]) and (constant or (linked and _weak(self.label[1])))


def fold(members: list[Node], depth: int = 0) -> tuple:
    """(label, members, children): sibling runs of one label folded into one slot, texts left out."""
    runs: list[list[Node]] = []
    for m in members if depth < DEPTH else ():
        for x in m.items:
            if isinstance(x, str) or x.tag in _INLINE or x.tag in _VOID or x.tag in _RAW:
                continue
            label = (x.tag, x.names)
            if runs and (runs[-1][0].tag, runs[-1][0].names) == label:
                runs[-1].append(x)
            else:
                runs.append([x])
    return (members[0].tag, members[0].names), members, [fold(r, depth + 1) for r in runs]


def match(slot: Slot, tree: tuple, known: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes with equal labels: size, and the matched child pairs; ``known`` holds what is known."""
    if (id(slot), id(tree)) in known:
        return known[id(slot), id(tree)]
    a, b = slot.children, tree[2]
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    pair = {}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            w = 0
            if x.label == y[0]:
                w = match(x, y, known)[0]
                pair[i, j] = w
            size[i][j] = max(size[i - 1][j], size[i][j - 1], size[i - 1][j - 1] + w)
    i, j, found = len(a), len(b), []
    while i and j:
        if pair.get((i, j)) and size[i][j] == size[i - 1][j - 1] + pair[i, j]:
            found.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif size[i][j] == size[i - 1][j]:
            i -= 1
        else:
            j -= 1
    known[id(slot), id(tree)] = out = 1 + size[-1][-1], found[::-1]
    return out


def align(slot: Slot, tree: tuple, seen: list, known: dict) -> None:
    """Add a page's tree to the wrapper; ``seen`` collects (slot, members). ``known`` holds for the subtrees not yet added."""
    seen.append((slot, tree[1]))
    slot.pages += 1
    text, links = measured(tree[1], set())
    slot.texts[hashlib.blake2b(text.encode(), digest_size=8).digest()] += 1
    slot.chars, slot.links = slot.chars + len(text), slot.links + links
    got = dict((j, i) for i, j in match(slot, tree, known)[1])
    children, at = [], 0
    for j, y in enumerate(tree[2]):
        if j in got:
            children += slot.children[at : got[j]]
            at, own = got[j] + 1, slot.children[got[j]]
        else:
            own = Slot(y[0])
        align(own, y, seen, known)
        children.append(own)
    slot.children = children + slot.children[at:]


def extract(pages: list[str]) -> list[str]:
    """The main text of each page of one group of same-host pages."""
    trees, wrapper = {}, Slot(("#root", ""))
    seen: dict[str, list] = {}
    for page in pages:
        if page not in seen:  # an equal page has an equal text
            trees[page], seen[page] = parse(page), []
            align(wrapper, fold([trees[page]]), seen[page], {})
    texts = {}
    for page, own in seen.items():
        found = roots(trees[page])
        skip: set[int] = set()
        for slot, members in own:
            if slot.template(bool(found)):
                skip.update(map(id, members))
        texts[page] = " ".join(t for t in (text_of(x, skip) for x in found or [trees[page]]) if t)
    return [texts[p] for p in pages]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", "html", F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("")).alias("host"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
    share = rows.count() / HOT
    hot = sizes.where(F.col("n") > F.lit(max(GROUP, share))).select("host", F.ceil(F.col("n") / F.lit(GROUP)).cast("int").alias("salts"))
    dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.expr("int(pmod(xxhash64(page_id), coalesce(salts, 1)))"))
    dealt = dealt.select("host", "salt", "page_id", "url", "html").repartition("host", "salt").sortWithinPartitions("host", "salt", "page_id")

    def run(batches):
        held, key = [], None

        def flush():
            texts = extract([h or "" for _, _, h in held])
            out = pa.record_batch([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
            held.clear()
            return out

        for batch in batches:
            for host, salt, page, url, html in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (key != (host, salt) or len(held) >= 2 * GROUP):
                    yield flush()
                key = (host, salt)
                held.append((page, url, html))
        if held:
            yield flush()

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")
