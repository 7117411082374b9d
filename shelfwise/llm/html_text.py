"""HTML extraction by composite text density.

A page is read into a tree of elements in one pass.  Elements that are
boilerplate by what they are (scripts, menus, footers, forms ...) are left
out, and those whose name (class or id) says advert, comments, cookie notice
and the like, unless the page's structure says that they hold the article:
a layout wrapper, a section named after its own heading, an element with the
title (see ``Page._named``).  For every other element the composite text density is computed:
characters per tag, adjusted by how much of the text and of the tags is
links, relative to the whole body.  The element with the largest sum of its
children's densities is the core of the page; the least density on the path
from it to the body is the threshold.  The article is the core's semantic
container (article, main) where it has one; otherwise the core together
with those neighbours along the path that reach the threshold, and the
headings among them.

Text: character references decoded, block elements and line breaks separate
blocks, white space inside a block becomes one space, blocks are joined by
one space in page order.

Defined cases: null, empty or text-free html gives empty text; text outside
any element counts as the body's; unclosed and misnested tags are closed
like browsers do; an unfinished tag or comment runs to the end of the page.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwise.llm.common import columns_of

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html br caption tbody td tfoot th thead tr legend option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an opening tag ends these open elements, up to the named containers
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
# Boilerplate by element, by role, and by a word of class or id.
DROPPED = frozenset("head script style noscript template title nav footer aside iframe svg math canvas object embed applet audio video button select textarea datalist dialog menu map noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion promos banner banners cookie cookies consent gdpr "
    "notice notices notification notifications alert disclaimer popup modal overlay newsletter subscribe subscription signup login paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar sidebar sidebars aside widget widgets "
    "header masthead footer foot colophon copyright related recommended recommendations share sharing social "
    "comment comments commentlist respond reply replies disqus discussion".split()
)
# words that also name a section's subject: a section, or an element with more words in its name, must be mostly links
SUBJECTS = frozenset("related recommended recommendations discussion social sharing subscription".split())
# words that name a subject only beside other words ("notice-period")
NOTICES = frozenset("notice notices notification notifications alert disclaimer promotion advertising".split())
# words for text that may be longer than the article that it stands beside
THREADS = frozenset("comment comments commentlist respond reply replies disqus cookie cookies consent gdpr".split())
TITLES = frozenset("header masthead banner".split())  # inside an article, or beside these words, its own title
TITLED = frozenset("entry post article section story content".split())
# words that say where a named element stands or what it is made of, not what it is about
PLACES = frozenset("slot box container wrapper inner area block list bar panel column region zone site top bottom unit item items text message thread links posts articles stories user reader readers section number".split())
MARKS = frozenset("post article entry story".split())  # an element with such a name holds an article
MARK_PARTS = frozenset("content body text main inner wrapper container".split())
NAMED_BY_ID = frozenset("div section p ul ol dl table form fieldset".split())  # inside an article ids of other elements are anchors
PROSE = 140  # characters; less text outside links is not an article
JOINED = re.compile(r"^(?:google_?ads?|adsense|adsbygoogle|sidenav|sidemenu|sitenav|mainnav|topnav|mainmenu|userComments|commentsection|cookiebar|cookiebanner)$", re.I)
NEGATED = frozenset("no not without has with hide".split())
CONTAINERS = frozenset(("article", "main"))


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)}


def _left_out(attrs: dict[str, str]) -> bool:
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _words(name: str) -> list[str]:
    return [w.lower() for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if w]


class Name:
    """What an element's class and id say: its boilerplate words, by how sure they are."""

    def __init__(self, attrs: dict[str, str], tag: str, in_article: bool) -> None:
        self.words: set[str] = set()
        self.exact = False  # one class or id says nothing but that
        self.marks = False  # it names an article
        self.id: list[str] = []  # the words of an id inside an article, which may be made from a heading
        self.heads: set[tuple[str, ...]] = set()  # classes and ids that a heading of the same words explains
        for kind in ("class", "id"):
            for name in attrs.get(kind, "").split():
                self._add(kind, name, tag, in_article)

    def _add(self, kind: str, name: str, tag: str, in_article: bool) -> None:
        words = _words(name)
        if JOINED.match(name):
            self.words.add("comments" if "comment" in name.lower() else "cookie" if "cookie" in name.lower() else "ads")
            self.exact = True
        if NEGATED.intersection(words):
            return
        titles = TITLES if in_article or TITLED.intersection(words) else frozenset()
        found = NAMES.intersection(words) - titles
        if not found:
            self.marks |= bool(MARKS.intersection(words)) and not set(words) - MARKS - MARK_PARTS
            return
        exact = all(w in NAMES or w in PLACES or w.isdigit() for w in words)
        if kind == "id" and in_article:
            if not exact or tag not in NAMED_BY_ID:
                return
            self.id = words
        if not found - SUBJECTS - NOTICES:
            self.heads.add(tuple(words))
        self.words |= found
        self.exact |= exact and (tag != "section" or bool(found - SUBJECTS))


class Page:
    """The element tree: parallel lists by element number, parents before children; 0 is the body."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.attrs = ["body"], [-1], [""]
        self.text: list[tuple[int, str]] = []  # (element, text) in page order; block breaks are a space
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        tags = self.tag
        self.open = Counter()  # open elements by name: most end tags and implied ends need no look at the stack
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self._add(stack[-1], source[at:])
                break
            if m.start() > at:
                self._add(stack[-1], source[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self._add(stack[-1], m["cdata"])
                continue
            if m["tag"] is None:
                continue
            name = m["tag"].lower()
            if m["end"]:
                self._close(stack, name)
                continue
            if name in ("html", "body"):
                continue
            if name in CLOSES_P:
                self._imply(stack, {"p"}, {"td", "th", "table", "button", "li", "div", "section", "article"})
            if name in IMPLIED:
                self._imply(stack, *IMPLIED[name])
            if name in BLOCK:
                self.text.append((stack[-1], " "))
            tags.append(name)
            self.parent.append(stack[-1])
            self.attrs.append(m["attrs"])
            if name in RAW and not m["attrs"].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else n
            elif name not in VOID:
                stack.append(len(tags) - 1)
                self.open[name] += 1

    def _cut(self, stack: list[int], i: int) -> None:
        for e in stack[i:]:
            self.open[self.tag[e]] -= 1
        del stack[i:]

    def _add(self, element: int, text: str) -> None:
        self.text.append((element, html.unescape(text) if "&" in text else text))

    def _imply(self, stack: list[int], ends: set[str], within: set[str]) -> None:
        if not any(self.open[x] for x in ends):
            return
        for i in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[i]]
            if name in ends:
                self.text.append((self.parent[stack[i]], " "))
                self._cut(stack, i)
                return
            if name in within:
                return

    def _close(self, stack: list[int], name: str) -> None:
        if name == "br" or name == "p" and not self.open["p"]:
            self.text.append((stack[-1], " "))
        if not self.open[name]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                if any(self.tag[j] in BLOCK for j in stack[i:]):
                    self.text.append((self.parent[stack[i]], " "))
                self._cut(stack, i)
                return
            # an inline end tag does not close the block that it stands in
            if name not in BLOCK and self.tag[stack[i]] in BLOCK:
                return

    def boilerplate(self) -> list[bool]:
        """Whether each element or one above it is left out."""
        n = len(self.tag)
        holds = [t in CONTAINERS for t in self.tag]
        in_article = [False] * n
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        out = [False] * n
        named: dict[int, Name] = {}
        marked = [False] * n
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            in_article[i] = in_article[up] or tag in CONTAINERS
            if out[up] or tag in DROPPED:
                out[i] = True
            elif tag == "header":
                out[i] = not holds[i] and not in_article[up]
            elif (self.attrs[i] or tag == "form") and not holds[i]:
                attrs = _attributes(self.attrs[i])
                out[i] = _left_out(attrs)
                if not out[i] and tag not in HEADINGS:
                    name = Name(attrs, tag, in_article[up])
                    if tag == "form":
                        name.words, name.exact = name.words | {"form"}, True
                    marked[i] = name.marks
                    if name.words:
                        named[i] = name
        for i in self._named(named, marked, in_article, out):
            out[i] = True
        for i in range(1, n):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def _headings(self) -> list[tuple[str, ...]]:
        """The words of the first heading in each element."""
        n = len(self.tag)
        heading, first = [0] * n, [n] * n
        for i in range(1, n):
            heading[i] = i if self.tag[i] in HEADINGS else heading[self.parent[i]]
        texts: dict[int, list[str]] = defaultdict(list)
        for e, t in self.text:
            if heading[e]:
                texts[heading[e]].append(t)
        words = {h: tuple(re.findall(r"\w+", "".join(t).lower())) for h, t in texts.items()}
        for i in range(n - 1, 0, -1):
            if i in words:
                first[i] = i
            first[self.parent[i]] = min(first[self.parent[i]], first[i])
        return [words.get(h, ()) for h in first]

    def _named(self, named: dict[int, Name], marked: list[bool], in_article: list[bool], out: list[bool]) -> list[int]:
        """Those of the elements with a boilerplate name that hold boilerplate.

        Forms count as named.  The text outside all named elements (without
        links) is what an element is held against.  One that is at most half
        as long goes.  A longer one goes too where the page marks its article
        elsewhere (article, main, or a class like "post"), or where its name
        says nothing else and prose stands outside; threads of readers and
        cookie texts go wherever prose stands outside.  Else it is a part of
        the layout: its text counts as outside, and the named elements within
        it are looked at in turn, largest first.  An element that holds the
        title, or one marked as the article with half of its text, is layout.
        Named after its own heading, a section is the article's: always for
        words that are subjects, otherwise where the article goes on after it.
        """
        n = len(self.tag)
        linked, titled = [t == "a" for t in self.tag], [t == "h1" for t in self.tag]
        plain, links, begin = [0] * n, [0] * n, [len(self.text)] * n
        for i in range(1, n):
            linked[i] = linked[i] or linked[self.parent[i]]
        for at, (e, t) in enumerate(self.text):
            begin[e] = min(begin[e], at)
            if not out[e]:
                (links if linked[e] else plain)[e] += len("".join(t.split()))
        own = list(plain)
        best = [0] * n  # the longest text of a marked element within
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            plain[up] += plain[i]
            links[up] += links[i]
            begin[up] = min(begin[up], begin[i])
            titled[up] |= titled[i]
            best[up] = max(best[up], best[i], plain[i] * (marked[i] and i not in named))

        def listed(i: int) -> bool:
            return links[i] > plain[i]

        first = self._headings() if named else []

        def subject(i: int, name: Name) -> bool:
            """Whether its words name what a section of the article is about."""
            if listed(i) or name.words - SUBJECTS - NOTICES:
                return False
            heading = tuple(w for w in first[i] if not w.isdigit())
            return not name.exact or heading in name.heads and (bool(name.words & SUBJECTS) or bool(name.id))

        named = {i: x for i, x in named.items() if not subject(i, x) and not (titled[i] and in_article[i])}
        # an id made from a heading names a section, if the article goes on after it
        after = 0
        rest = [0] * (len(self.text) + 1)
        inside = [i in named for i in range(n)]
        for i in range(1, n):
            inside[i] = inside[i] or inside[self.parent[i]]
        for at in range(len(self.text) - 1, -1, -1):
            e, t = self.text[at]
            if in_article[e] and not (out[e] or inside[e] or linked[e]):
                after += len("".join(t.split()))
            rest[at] = after
        named = {i: x for i, x in named.items() if not (x.id and tuple(x.id) == first[i] and (rest[begin[i]] >= PROSE or not x.words & THREADS))}

        # text outside named elements, all of it and that of a marked article, by the named element around it
        owner, outside, within = list(range(n)), [0] * n, defaultdict(list)
        holds_named = [False] * n
        for i in range(n - 1, 0, -1):
            holds_named[self.parent[i]] |= holds_named[i] or i in named
        claims = [False] * n
        claimed_in = [0] * n
        for i in range(n):
            if i and i not in named:
                owner[i] = owner[self.parent[i]]
            elif i:
                within[owner[self.parent[i]]].append(i)
            claims[i] = in_article[i] or (i > 0 and claims[self.parent[i]]) or marked[i] and not holds_named[i]
            outside[owner[i]] += own[i]
            claimed_in[owner[i]] += own[i] * claims[i]

        def layout(i: int) -> bool:
            if listed(i):
                return plain[i] > max(clean, PROSE)
            if 2 * plain[i] <= clean:
                return False
            if titled[i]:
                return True
            if THREADS.intersection(named[i].words):
                return plain[0] - plain[i] < PROSE and not claimed
            if best[i] and 2 * best[i] >= plain[i]:
                return True
            return not claimed and (not named[i].exact or clean < PROSE)

        clean, claimed = outside[0], claimed_in[0]
        queue = [(-plain[i], i) for i in within[0]]
        heapq.heapify(queue)
        gone = []
        while queue:
            _, i = heapq.heappop(queue)
            if not layout(i):
                gone.append(i)
                continue
            clean += outside[i]
            claimed += claimed_in[i]
            for j in within[i]:
                heapq.heappush(queue, (-plain[j], j))
        return gone


def densities(page: Page, out: list[bool]) -> list[float]:
    """Composite text density of each element."""
    n = len(page.tag)
    linked = [t == "a" for t in page.tag]
    for i in range(1, n):
        linked[i] = linked[i] or linked[page.parent[i]]
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for e, t in page.text:
        if not out[e] and (size := len("".join(t.split()))):
            chars[e] += size
            link_chars[e] += size * linked[e]
    for i in range(n - 1, 0, -1):
        if not out[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    share = link_chars[0] / max(chars[0], 1)
    found = [0.0] * n
    for i in range(n):
        c, t = chars[i], max(tags[i], 1)
        if c:
            lc, lt, rest = max(link_chars[i], 1), max(link_tags[i], 1), max(c - link_chars[i], 1)
            base = math.log(c / rest * lc + share * c + math.e)
            found[i] = max(0.0, c / t * math.log(c / lc * t / lt) / math.log(base))
    return found


def article(page: Page) -> tuple[list[bool], list[bool]]:
    """(in the article, left out) by element."""
    out = page.boilerplate()
    density = densities(page, out)
    n = len(page.tag)
    sums = [0.0] * n
    for i in range(1, n):
        if not out[i]:
            sums[page.parent[i]] += density[i]
    core = max(range(n), key=lambda i: (not out[i], sums[i], -i))
    path = [core]
    while path[-1]:
        path.append(page.parent[path[-1]])
    roots = [i for i in path if page.tag[i] in CONTAINERS][-1:]
    if not roots and sums[core] > 0 and core:
        threshold = min(density[i] for i in path)
        on_path = set(path)
        near = [i for i in range(1, n) if page.parent[i] in on_path and i not in on_path and not out[i] and page.parent[i] != core]
        roots = [core, *(i for i in near if density[i] >= threshold or page.tag[i] in HEADINGS and density[i] > 0)]
    inside = [False] * n
    for i in roots or [0]:
        inside[i] = True
    for i in range(1, n):
        inside[i] = inside[i] or inside[page.parent[i]]
    if roots and 0 not in roots:
        inside[0] = False
    return inside, out


def main_text(source: str | None) -> str:
    """The text of the page's article."""
    if not source:
        return ""
    page = Page(source)
    inside, out = article(page)
    # a block break belongs to the parent: it counts wherever it stands
    return " ".join("".join(t if inside[e] and not out[e] else " " for e, t in page.text).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = columns_of(pages, page_id="page_id", url="url", html="html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
