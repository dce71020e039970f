"""Main text of web pages, by wrappers inferred from pages of the same host.

A page is read as a tree of block elements. Neighbouring repeats in it become
repeated groups, and a host's distinct trees are aligned one after another:
elements that match are merged, those that only one side has become optional,
and text stands as a slot. The result is the host's wrapper, a regular
expression without unions. Trees are reduced to their distinct forms before
they meet, then merged a few at a time in rounds, so neither a hot host's pages
nor its trees ever come together.

Every page is then matched against its host's wrapper, which gives each of its
texts a slot: the element of the wrapper that it stands in, so that elements
alike in tag and class are told apart by their place. Sums over the slots of a
host decide which of them are the article: slots with the same text on pages of
different content are template, unless they stand beside the article's varying
text, as its headings and labels do; the slot with most running
text is the main one, and the article is what is around it, as far up as what
joins is article rather than template, named or links; parts that are named like a menu, notice or comments
count as such only if the main slot is not inside. Tags and roles that mark no
text (nav, form, footer ...) and marks of an article are read from the page.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import join_group_facts, materialise
from framelake.llm.urls import url_host

# Names of HTML elements and of page parts.
BLOCKS = frozenset("html body head div p ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside form fieldset h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption address details summary hgroup center title noscript template iframe svg button select canvas dialog menu object video audio map".split())
RAW = frozenset(("script", "style", "textarea", "title"))
BREAKS = frozenset(("br", "hr"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = frozenset("head title script style nav footer aside form noscript template iframe svg button select textarea canvas dialog menu object video audio map".split())
NOT_TEXT_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu menubar navbar navigation nav breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments respond disqus footer toolbar widget pagination pager skip masthead".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements whose text names what follows.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption summary figcaption".split())
#: Words that a name may have besides those and still be one of them: "comment-list" is, "related-work" is not.
NEUTRAL_NAMES = frozenset("box wrapper wrap container list section area block bar content inner outer left right top bottom item items group panel link links post posts article articles icon icons button buttons main site page text message form row column unit slot zone thread".split())
ARTICLE_NAMES = frozenset(("articlebody", "article-body"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")

#: (open, next): elements that the next one closes where their end is left out.
CLOSES = frozenset((("li", "li"), ("tr", "tr"), *((a, b) for a in ("dt", "dd") for b in ("dt", "dd")), *((a, b) for a in ("td", "th") for b in ("td", "th"))))

#: Elements below this depth count as their ancestor there; their text does not suffer.
MAX_DEPTH = 100
#: Pages that must agree before a slot's text is template, trees that are merged at once, bytes of wrappers that go out by broadcast at most.
TEMPLATE_PAGES, FAN_IN, BROADCAST_BYTES = 3, 64, 32 << 20


class _Node:
    __slots__ = ("article", "children", "depth", "drop", "named", "path", "place", "sig", "tag")

    def __init__(self, tag: str, sig: str, parent: _Node | None, drop: bool, article: bool, named: bool = False) -> None:
        self.tag, self.sig, self.drop, self.article, self.place = tag, sig, drop, article, -1
        # The outermost element with a listed name.
        self.named: _Node | None = parent.named if parent and parent.named else self if named else None
        self.depth = parent.depth + 1 if parent else 0
        if self.depth > MAX_DEPTH:
            self.path, self.children, self.place = parent.path, parent.children, parent
            return
        self.path = f"{parent.path}/{sig}" if parent else ""
        self.children: list = []
        if parent:
            parent.children.append(self)


def _is_listed(name: str) -> bool:
    words = _NAME.findall(name)
    return not NOT_TEXT_NAMES.isdisjoint(words) and all(w in NOT_TEXT_NAMES or w in NEUTRAL_NAMES for w in words)


def _opened(tag: str, attributes: str, parent: _Node) -> _Node:
    sig, drop, article, named = tag, parent.drop, parent.article, False
    if tag in NOT_TEXT or tag == "header" and not article:
        drop = True
    if tag in ("article", "main"):
        article = True
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                named |= any(map(_is_listed, value.split()))
                if key == "class" and value.strip():
                    sig += "." + ".".join(re.sub(r"\d+", "", value).split())
            elif key == "role":
                drop |= value in NOT_TEXT_ROLES
                article |= value in ("main", "article")
            elif key == "itemprop":
                article |= value in ARTICLE_NAMES
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                drop = True
        named &= tag not in ("html", "body", "article", "main")
    return _Node(tag, sig, parent, drop, article, named)


def read_page(html: str | None) -> tuple[_Node, list[tuple[_Node, str, float]]]:
    """The page's tree, MAX_DEPTH levels deep, and its text blocks in order: element, text, share of it in links."""
    root = _Node("", "", None, False, False)
    stack, blocks, text, linked, link = [root], [], [], 0, 0
    opened: Counter = Counter()
    html = html or ""

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACES.sub(" ", html_lib.unescape("".join(text))).strip()
            if whole:
                blocks.append((stack[-1], whole, min(1.0, linked / len(whole))))
                own = stack[-1].children
                if not own or own[-1] != "#":
                    own.append("#")
            text.clear()
            linked = 0

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            linked += len(piece) if link else 0
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCKS:
                flush()
                while opened[tag]:
                    last = stack.pop()
                    opened[last.tag] -= 1
                    if last.tag == tag:
                        break
            elif tag == "a":
                link = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else size
        elif tag in BREAKS:
            flush()
        elif tag in BLOCKS:
            flush()
            if stack[-1].tag == "p" or (stack[-1].tag, tag) in CLOSES:
                opened[stack.pop().tag] -= 1
                if tag == "li" and stack[-1].tag == "li":
                    opened[stack.pop().tag] -= 1
            attributes = m[3] if m[2] else m[6]
            node = _opened(tag, attributes or "", stack[-1])
            if not (attributes or "").endswith("/"):
                stack.append(node)
                opened[tag] += 1
        elif tag == "a":
            link = 1
    if at < size:
        text.append(html[at:])
    flush()
    return root, blocks


# A wrapper's node is [signature, quantifier, children]: quantifier "" once, "?" optional, "+" repeated, "*" both.
# A text slot is ["#", quantifier, []], a repeated group of several elements ["()", quantifier, children].
_JOIN = {frozenset(a): b for a, b in (("?+", "*"), ("?*", "*"), ("+*", "*"))}


def _both(a: str, b: str) -> str:
    return a if a == b else b if not a else a if not b else _JOIN[frozenset(a + b)]


def _fold(nodes: list) -> list:
    """Neighbouring repeats of one to three nodes as one repeated group."""
    for width in (1, 2, 3):
        out: list = []
        for node in nodes:
            out.append(node)
            if width == 1:
                if len(out) > 1 and out[-1][0] == out[-2][0]:
                    b, a = out.pop(), out.pop()
                    out.append([a[0], _both(_both(a[1], b[1]), "+"), align(a[2], b[2])])
            else:
                last, prev = out[-width:], out[-2 * width : -width]
                if len(prev) == width and [x[0] for x in last] == [x[0] for x in prev]:
                    del out[-2 * width :]
                    out.append(["()", "+", align(prev, last)])
                elif len(out) > width and out[-width - 1][0] == "()" and [x[0] for x in out[-width - 1][2]] == [x[0] for x in last]:
                    del out[-width:]
                    out[-1] = ["()", "+", align(out[-1][2], last)]
        nodes = out
    return nodes


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of signatures, by one rule at every size.

    Row i of the table holds, as the bits of one number, where the length for
    a[i:] grows along b from its end: cleared bits are steps. Rows are kept at
    intervals and worked out again between them, so memory grows with the square root of a's length times b's.
    """
    n, m = len(a), len(b)
    places: dict[str, int] = {}
    for j, node in enumerate(b):
        places[node[0]] = places.get(node[0], 0) | 1 << (m - 1 - j)
    full = (1 << m) - 1

    def above(row: int, i: int) -> int:
        hit = row & places.get(a[i][0], 0)
        return ((row + hit) | (row - hit)) & full

    step = isqrt(n) + 1
    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row

    def block(i: int) -> dict[int, int]:
        """Rows from i, a multiple of step, to the next kept one."""
        last = min(i + step, n)
        rows = {last: kept[last]}
        for k in range(last - 1, i - 1, -1):
            rows[k] = above(rows[k + 1], k)
        return rows

    out, i, j, rows = [], 0, 0, {}
    while i < n and j < m:
        if a[i][0] == b[j][0]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        if i not in rows or i + 1 not in rows:
            rows = block(i - i % step)
        # best for (a[i + 1:], b[j:]) against (a[i:], b[j + 1:]): steps among the last m - j and m - j - 1 places.
        down = m - j - (rows[i + 1] & ((1 << m - j) - 1)).bit_count()
        right = m - j - 1 - (rows[i] & ((1 << m - j - 1) - 1)).bit_count()
        if down >= right:
            i += 1
        else:
            j += 1
    return out


def _grouped(own: list, other: list) -> list:
    """``own`` with runs of what a group of ``other`` repeats as groups that stand once."""
    for group in other:
        if group[0] == "()":
            names = [x[0] for x in group[2]]
            i = 0
            while i + len(names) <= len(own):
                if [x[0] for x in own[i : i + len(names)]] == names:
                    own = [*own[:i], ["()", "", own[i : i + len(names)]], *own[i + len(names) :]]
                i += 1
    return own


def align(a: list, b: list) -> list:
    """The least wrapper of both node lists: matches merge, the rest becomes optional, repeats fold."""
    a, b = _grouped(a, b), _grouped(b, a)
    out, i, j = [], 0, 0
    for x, y in [*_matches(a, b), (len(a), len(b))]:
        out += [[s, _both(q, "?"), c] for s, q, c in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append([a[x][0], _both(a[x][1], b[y][1]), align(a[x][2], b[y][2])])
        i, j = x + 1, y + 1
    return _fold(out)


def page_wrapper(root: _Node) -> list:
    def form(node: _Node | str) -> list:
        return ["#", "", []] if node == "#" else [node.sig, "", _fold([form(c) for c in node.children])]

    return form(root)[2]


def pattern(wrapper: list) -> str:
    """A wrapper as text: elements with their content in brackets, # a text slot, ? + * as in regular expressions."""
    return " ".join(("(" + pattern(c) + ")" if s == "()" else s + ("[" + pattern(c) + "]" if c else "")) + q for s, q, c in wrapper)


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: pages of each (host, tree)."""
    trees: Counter = Counter()

    def rows() -> pd.DataFrame:
        out = pd.DataFrame([(h, t, n) for (h, t), n in trees.items()], columns=["host", "tree", "pages"])
        trees.clear()
        return out

    for batch in batches:
        for host, html in zip(batch["host"], batch["html"], strict=True):
            trees[host, json.dumps(page_wrapper(read_page(html)[0]), separators=(",", ":"))] += 1
            if len(trees) > 50_000:
                yield rows()
    yield rows()


class Wrapper:
    """A host's wrapper with its elements numbered in page order, to match pages against it."""

    def __init__(self, nodes: list) -> None:
        self.parents: list[int] = []
        self.tags: list[str] = []
        self._top = self._read(nodes, -1)

    def _read(self, nodes: list, parent: int) -> tuple:
        """Siblings in order, groups opened: numbers, content, where a repeat may begin again, and places of each signature."""
        numbers: list[int] = []
        inside: list[tuple] = []
        again: list[int | None] = []
        at: dict[str, list[int]] = {}

        def add(siblings: list, start: int | None) -> None:
            for sig, quantifier, children in siblings:
                repeated = quantifier in ("+", "*")
                if sig == "()":
                    add(children, len(numbers) if start is None else start)
                elif sig != "#":
                    number = len(self.parents)
                    self.parents.append(parent)
                    self.tags.append(sig.partition(".")[0])
                    at.setdefault(sig, []).append(len(numbers))
                    again.append(len(numbers) if repeated and start is None else start)
                    numbers.append(number)
                    inside.append(())
                    inside[-1] = self._read(children, number)

        add(nodes, None)
        return numbers, inside, again, at

    def place(self, root: _Node) -> None:
        """Give every element of a page the number of the wrapper's element that it matches, -1 where none does."""
        todo = [(root, self._top)]
        while todo:
            node, (numbers, inside, again, at) = todo.pop()
            here = -1
            for child in node.children:
                if child == "#":
                    continue
                places = at.get(child.sig)
                if not places:
                    continue
                back = again[here] if here >= 0 else None
                k = bisect_left(places, back) if back is not None else len(places)
                if k == len(places) or places[k] > here:  # no repeat of what stands here: on to the next of its kind
                    k = bisect_left(places, here + 1)
                here = places[min(k, len(places) - 1)]
                child.place = numbers[here]
                todo.append((child, inside[here]))

    def within(self, place: int, element: int) -> bool:
        """Whether a place is an element or inside it; all are inside -1, the page."""
        while place >= 0 and place != element:
            place = self.parents[place]
        return place == element

    def parent(self, place: int) -> int:
        return self.parents[place] if place >= 0 else -1


def _number(node: _Node | None) -> int:
    """The node's place, below the depth limit its ancestor's."""
    while node is not None and isinstance(node.place, _Node):
        node = node.place
    return -1 if node is None else node.place


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def slot_paths(wrapper: list, path: str = "") -> list[str]:
    """Paths of a wrapper's text slots, each once; a repeated group adds no step to a path."""
    out: dict[str, None] = {}
    for sig, _, children in wrapper:
        if sig == "#":
            out[path] = None
        else:
            out |= dict.fromkeys(slot_paths(children, path if sig == "()" else f"{path}/{sig}"))
    return list(out)


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    wrapper: list | None = None
    for tree in sorted(rows["tree"]):
        own = json.loads(tree)
        wrapper = own if wrapper is None else align(wrapper, own)
    return pd.DataFrame({"host": [key[0]], "node": [key[1]], "tree": [json.dumps(wrapper, separators=(",", ":"))]})


def merge_trees(trees: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """host, tree: one wrapper per host, from its distinct trees.

    A tree takes a place by its hash, and every round merges the trees of
    ``fan_in`` neighbouring places; there are as many rounds as the host with
    most trees needs, so that about ``fan_in`` meet in a group.
    """
    widest = trees.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    rounds = 1
    while fan_in**rounds < widest:
        rounds += 1
    level = trees.select("host", F.pmod(F.xxhash64("tree"), F.lit(fan_in**rounds)).alias("node"), "tree")
    for _ in range(rounds):
        level = level.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("host", "node").applyInPandas(_merged, "host string, node long, tree string")
    return level.select("host", "tree")


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: host, pages, tree (the wrapper as JSON), pattern (the same as an expression). A null url has the empty host."""
    read = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    trees = materialise(read.mapInPandas(_folded, "host string, tree string, pages long").groupBy("host", "tree").agg(F.sum("pages").alias("pages")))
    counts = trees.groupBy("host").agg(F.sum("pages").alias("pages"))

    def written(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: pattern(json.loads(t)))

    return counts.join(merge_trees(trees), "host").select("host", "pages", "tree", F.pandas_udf(written, "string")("tree").alias("pattern"))


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page its blocks that tags and roles leave: slot, text, characters in links, whether marked as article, the named element it is in; own: what the page alone takes for its article."""
    known: dict[str, Wrapper] = {}
    for batch in batches:
        rows = []
        for html, tree in zip(batch["html"], batch["tree"], strict=True):
            if tree not in known:
                if len(known) > 200:
                    known.clear()
                known[tree] = Wrapper(json.loads(tree))
            root, blocks = read_page(html)
            known[tree].place(root)
            blocks = [b for b in blocks if not b[0].drop]
            slots, texts = [_number(b[0]) for b in blocks], [b[1] for b in blocks]
            linked = [round(b[2] * len(b[1])) for b in blocks]
            content = hash_text("\n".join(f"{s} {t}" for s, t in zip(slots, texts, strict=True)))
            rows.append((slots, texts, linked, [b[0].article for b in blocks], [_number(b[0].named) if b[0].named else NOT_NAMED for b in blocks], _own_article(blocks), content))
        columns = ["slots", "texts", "linked", "marked", "named", "own", "content"]
        yield pd.concat([batch[["page_id", "url", "host"]].reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1)


#: Stands for the number of the named element where there is none.
NOT_NAMED = -2


def _own_article(blocks: list[tuple[_Node, str, float]]) -> list[bool]:
    """Without its host's facts: marked blocks outside named parts, else those of the element with most running text."""
    plain = [b[0].named is None for b in blocks]
    if any(b[0].article for b in blocks):
        return [b[0].article and p for b, p in zip(blocks, plain, strict=True)]
    running: Counter = Counter()
    for (node, text, linked), p in zip(blocks, plain, strict=True):
        if p:
            running[node.path.rpartition("/")[0]] += len(text) * (1 - 2 * linked)
    if not running:
        return [False] * len(blocks)
    best = max(sorted(running), key=running.__getitem__)
    return [p and running[best] > 0 and (b[0].path + "/").startswith(best + "/") for b, p in zip(blocks, plain, strict=True)]


def article_slots(tree: str, slots: list[dict], template_pages: int = TEMPLATE_PAGES) -> tuple[list[int], list[int], list[int]]:
    """Slots of the article on pages that mark one, on pages that mark none, and template slots, of one host.

    ``slots`` has for each slot, mark and named element: contents (pages of
    different content), chars, linked, least and most (hashes of its texts).
    """
    wrapper = Wrapper(json.loads(tree))
    texts: dict[int, list[int]] = {}
    for s in slots:
        x = texts.setdefault(s["slot"], [0, s["least"], s["most"]])
        x[:] = x[0] + s["contents"], min(x[1], s["least"]), max(x[2], s["most"])
    fixed = {n for n, (contents, least, most) in texts.items() if n >= 0 and least == most and contents >= template_pages}
    out, template = [], set(fixed)
    for marked in (True, False):
        own = [s for s in slots if s["marked"] == marked]
        labels = _labels(wrapper, fixed, [s["slot"] for s in own], headings_only=not marked)
        own = [s for s in own if s["slot"] not in fixed or s["slot"] in labels]
        running: Counter = Counter()
        for plain in (True, False):
            for s in own:
                if (s["named"] == NOT_NAMED) == plain:
                    running[s["slot"]] += s["chars"] - 2 * s["linked"]
            if running and max(running.values()) > 0:
                break
        if not marked:
            # Of pages that mark none: all that is in the element around the main slot, as far up as most of what joins is article.
            around: Counter = Counter()
            for n, r in running.items():
                around[wrapper.parent(n)] += r
            holder = max(sorted(around), key=around.__getitem__) if around else -1
            if not around or around[holder] <= 0:
                out.append([])
                continue
            kin = {n for n in running if wrapper.parent(n) == holder}
            holder = _widened(wrapper, holder, [s for s in slots if not s["marked"]], fixed - labels)
            running = Counter({n: running[n] for n in kin})
            own = [s for s in own if holder == -1 or s["slot"] >= 0 and wrapper.within(s["slot"], holder)]
        main = max(sorted(running), key=running.__getitem__) if running else -1
        chosen = [s["slot"] for s in own if s["named"] == NOT_NAMED or s["named"] >= 0 and wrapper.within(main, s["named"])]
        template -= labels & set(chosen)
        out.append(chosen)
    return sorted(set(out[0])), sorted(set(out[1])), sorted(template)


def _labels(wrapper: Wrapper, fixed: set[int], slots: list[int], headings_only: bool) -> set[int]:
    """Fixed slots that belong to the text around them: their parent holds varying text itself.

    On pages that mark their article that is enough, as all else in it is
    article by the page's own word; on others it must be a heading with varying text after it.
    """
    varying = sorted({n for n in slots if n not in fixed})
    out = set()
    for n in fixed & set(slots):
        near = [v for v in varying if v >= 0 and wrapper.within(v, wrapper.parent(n))]
        if headings_only:
            near = [v for v in near if v > n] if wrapper.tags[n] in HEADINGS else []
        else:
            near = [v for v in near if wrapper.parent(v) == wrapper.parent(n) or v > n]
        if near:
            out.add(n)
    return out


def _widened(wrapper: Wrapper, holder: int, slots: list[dict], template: set[int]) -> int:
    """The element around ``holder``, as long as of the text that it adds no more is template, named or mostly links than is not."""
    while holder >= 0:
        wider = wrapper.parent(holder)
        good = bad = 0
        for s in slots:
            n = s["slot"]
            if n >= 0 and wrapper.within(n, wider) and not wrapper.within(n, holder):
                if n in template or s["named"] != NOT_NAMED or 2 * s["linked"] > s["chars"]:
                    bad += s["chars"]
                else:
                    good += s["chars"]
        if bad > good:
            break
        holder = wider
    return holder


def _host_slots(placed: DataFrame) -> DataFrame:
    """host, found: the sums of every slot of a host. Pages of the same content count once, whatever their number."""
    block = placed.select("host", "content", F.explode(F.arrays_zip("slots", "texts", "linked", "marked", "named")).alias("b"))
    text = F.xxhash64("b.texts")
    once = block.groupBy("host", "content", F.col("b.slots").alias("slot"), F.col("b.marked").alias("marked"), F.col("b.named").alias("named")).agg(
        F.sum(F.length("b.texts")).alias("chars"), F.sum("b.linked").alias("linked"), F.min(text).alias("least"), F.max(text).alias("most")
    )
    sums = once.groupBy("host", "slot", "marked", "named").agg(F.count("*").alias("contents"), *[F.sum(c).alias(c) for c in ("chars", "linked")], F.min("least").alias("least"), F.max("most").alias("most"))
    return sums.groupBy("host").agg(F.collect_list(F.struct("slot", "marked", "named", "contents", "chars", "linked", "least", "most")).alias("found"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", template_pages: int = TEMPLATE_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty html, and one without an article, has the empty text. Broken
    and cut-off markup is read as far as it goes. Rows that repeat come back as
    often. An empty table gives no rows. Further columns of ``pages`` are not
    read. Where the host's facts leave a page nothing, what the page alone shows
    counts, less template. Wrappers go to the pages by broadcast up to
    ``broadcast_bytes`` in all; beyond, those of large hosts, of which there are
    few, still do, and all others meet by host.
    """
    wrappers = materialise(infer_wrappers(pages, url_col, html_col).select("host", "pages", "tree"))
    size, total = wrappers.agg(F.coalesce(F.sum(F.length("host") + F.length("tree") + 64), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()

    def with_host(rows: DataFrame, facts: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(facts), "host", "left") if size <= broadcast_bytes else join_group_facts(rows, facts, "host", "pages", total)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", url_host(F.col("url")))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    schema = f"{kinds}, host string, slots array<int>, texts array<string>, linked array<long>, marked array<boolean>, named array<int>, own array<boolean>, content long"
    placed = materialise(with_host(rows, wrappers).select("page_id", "url", "host", "html", "tree").mapInPandas(_placed, schema))

    def decide(trees: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article_slots(t, [] if f is None else list(f), template_pages) for t, f in zip(trees, found, strict=True)], columns=["in_marked", "in_plain", "template"])

    decided = F.pandas_udf(decide, "in_marked array<int>, in_plain array<int>, template array<int>")("tree", "found")
    facts = materialise(wrappers.join(_host_slots(placed), "host").select("host", "pages", decided.alias("d")).select("host", "pages", "d.*"))
    marks = F.exists("marked", lambda m: m)
    blocks = F.arrays_zip("slots", "texts", "marked", "own")
    joined = with_host(placed, facts).withColumn("_plain", ~marks)
    chosen = F.filter(blocks, lambda b: (b["marked"] & F.array_contains("in_marked", b["slots"])) | (F.col("_plain") & F.array_contains("in_plain", b["slots"])))
    alone = F.filter(blocks, lambda b: b["own"] & ~F.array_contains("template", b["slots"]))
    text = F.array_join(F.transform(F.when(F.size(chosen) > 0, chosen).otherwise(alone), lambda b: b["texts"]), " ")
    return joined.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
