"""A page as a flat tree: tolerant reading of HTML, subtree hashes, and the rules that need no other page.

A page is read once from left to right into nodes in page order (a node's
subtree is a range of nodes) and events (text, block borders).  Everything else
is done over these flat lists, so deep nesting costs nothing.  Missing end tags
are implied as browsers do; end tags without an element are passed over; scripts
and styles end at their own end tag only.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape

import xxhash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul br".split()
)
_NO_PARAGRAPH = BLOCK - frozenset("br td th tr tbody thead tfoot caption option optgroup button body head html legend select".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_CELLS = frozenset("td th".split())
_ROWS = frozenset("tr tbody thead tfoot caption colgroup".split())
_LISTS = frozenset("ul ol menu dl table td th article section aside nav".split())
#: start tag: elements that it ends, and elements beyond which it doesn't reach
_ENDS = (
    {"li": (frozenset(["li"]), _LISTS), "option": (frozenset(["option"]), frozenset(["select"]))}
    | {t: (frozenset(["dt", "dd"]), _LISTS) for t in ("dt", "dd")}
    | {t: (_CELLS, frozenset(["table", "tr"])) for t in ("td", "th")}
    | {"tr": (_CELLS | {"tr", "caption", "colgroup"}, frozenset(["table", "tbody", "thead", "tfoot"]))}
    | {t: (_CELLS | _ROWS, frozenset(["table"])) for t in ("tbody", "thead", "tfoot")}
)

# One pattern for what begins with "<": a comment, a declaration, an end tag or a start tag. Quotes count only after "=".
_MARK = re.compile(
    r"""<(?:!--(?P<comment>-?>|.*?(?:--!?>|\Z))|(?P<other>[!?][^>]*(?:>|\Z))|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?P<close>>|\Z))""",
    re.S,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_ATTR = re.compile(r"""(?P<name>[^\s"'>/=]++)(?:\s*+=\s*+(?:"(?P<a>[^"]*+)"|'(?P<b>[^']*+)'|(?P<c>[^\s>]*+)))?""")
_TOLD = frozenset("class id role style hidden aria-hidden itemprop".split())
_SPACES = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

#: Elements that are never text of a page.
NOISE_TAGS = frozenset("head title script style noscript template nav aside form iframe noembed noframes svg math canvas object audio video button select textarea datalist dialog menu search".split())
#: Elements that belong to the site, unless an article has them as its own.
SITE_TAGS = frozenset("header footer".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words of a class or id that mark what isn't the article (the first or last word of a name, or the whole).
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored sponsors promo promos promotion banner popup modal overlay "
    "teaser teasers cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup signin login paywall "
    "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager toolbar sidebar sidebars sidenav topbar masthead "
    "header footer copyright share sharing social related recommended recommendations trending popular widget widgets toc skip "
    "comment comments commentlist disqus respond reply replies discussion form search searchbox disclaimer".split()
)
_OTHERS = frozenset("comment comments commentlist replies responses discussion related recommended recommendations".split())
_STATES = frozenset("has with without no is not layout page show hide hidden js open opened closed on off enabled disabled allowed".split())
#: Names (without marks between their words) of an element that holds the article.
ARTICLE_NAMES = frozenset("article articlebody articlecontent articletext content contents main maincontent pagecontent bodycontent post postbody postcontent posttext entry entrycontent entrybody story storybody storycontent".split())
#: Containers that recurrence may remove inside a marked article; its plain text blocks stay.
CONTAINERS = frozenset("section aside ul ol dl menu table figure details fieldset header footer div address".split())
LEAST_LINKS = 3


def names_of(attrs: str) -> dict[str, str]:
    """The attributes that say what an element is; of repeated ones the first."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        name = m["name"].lower()
        if name in _TOLD:
            out.setdefault(name, unescape(next((x for x in (m["a"], m["b"], m["c"]) if x is not None), "")))
    return out


def _word_groups(told: dict[str, str]) -> list[list[str]]:
    return [[w.lower() for w in _PARTS.findall(name)] for key in ("class", "id") for name in told.get(key, "").split()]


def marked_noise(told: dict[str, str]) -> bool:
    """Whether the attributes of an element say that it isn't text of the article."""
    if "hidden" in told or told.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", told.get("style", ""), re.I):
        return True
    if told.get("role", "").strip().lower() in NOISE_ROLES:
        return True
    return any(w and w[0] not in _STATES and w[-1] not in _STATES and (w[0] in NOISE_WORDS or w[-1] in NOISE_WORDS) for w in _word_groups(told))


def marked_article(told: dict[str, str]) -> bool:
    if told.get("role", "").strip().lower() in ("main", "article") or "articlebody" in told.get("itemprop", "").lower():
        return True
    return any("".join(w) in ARTICLE_NAMES for w in _word_groups(told))


class Page:
    """tag, parent, told (attributes) and last (one past the subtree) of every node; events: (node, text) or, at a border of a block, (node, None)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.told, self.last = ["#root"], [-1], [{}], [0]
        self.events: list[tuple[int, str | None]] = []
        self._read(html)
        for i in range(len(self.tag)):
            self.last[i] = self.last[i] or len(self.tag)
        self._remove_marked()

    # reading

    def _read(self, html: str) -> None:
        stack, opened, at, n = [0], {}, 0, len(html)
        tag, events = self.tag, self.events

        def shut(depth: int) -> None:
            """End the open elements from depth on."""
            for node in reversed(stack[depth:]):
                self.last[node] = len(tag)
                opened[tag[node]] -= 1
                if tag[node] in BLOCK:
                    events.append((node, None))
            del stack[depth:]

        def reach(what: frozenset, limits: frozenset) -> int:
            """Depth of the outermost open element of `what` within the limits, or 0."""
            found = 0
            for d in range(len(stack) - 1, 0, -1):
                t = tag[stack[d]]
                if t in limits:
                    break
                if t in what:
                    found = d
            return found

        while at < n:
            m = _MARK.search(html, at)
            if m is None:
                events.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                events.append((stack[-1], html[at : m.start()]))
            at = m.end()
            name = m["tag"]
            if name is None or not m["close"]:  # comment, declaration, or a tag that the page ends in
                continue
            name = name.lower()
            if m["end"]:
                if name == "br":
                    events.append((stack[-1], None))
                elif opened.get(name):
                    inline = name not in BLOCK
                    for d in range(len(stack) - 1, 0, -1):
                        t = tag[stack[d]]
                        if t == name:
                            shut(d)
                            break
                        if (inline and t in BLOCK) or (t in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "html", "body", "article", "main")):
                            break
                continue
            if opened.get("head") and name not in _IN_HEAD and name not in ("head", "html"):
                shut(next(d for d in range(len(stack)) if tag[stack[d]] == "head"))
            if name in ("html", "body") and opened.get(name):
                continue
            if name in _NO_PARAGRAPH and opened.get("p"):
                d = reach(frozenset(["p"]), frozenset(["td", "th", "table", "button", "caption", "object"]))
                if d:
                    shut(d)
            if name in _ENDS and any(opened.get(t) for t in _ENDS[name][0]):
                d = reach(*_ENDS[name])
                if d:
                    shut(d)
            node = len(tag)
            tag.append(name)
            self.parent.append(stack[-1])
            self.told.append(names_of(m["attrs"]) if m["attrs"] and not m["attrs"].isspace() else {})
            self.last.append(0)
            if name in BLOCK:
                events.append((node, None))
            if name in VOID:
                self.last[node] = node + 1
            elif name in RAW:
                end = _RAW_END[name].search(html, at)
                events.append((node, html[at : end.start() if end else n]))
                at = end.end() if end else n
                self.last[node] = node + 1
                if name in BLOCK:
                    events.append((node, None))
            else:
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1
        shut(1)

    # rules of one page

    def _remove_marked(self) -> None:
        """gone: nodes in subtrees that tags or attributes mark as no text of the article. roots: the nodes that hold the article, if any are marked."""
        n = len(self.tag)
        noisy = [t in NOISE_TAGS or (t not in ("html", "body", "main") and bool(told) and marked_noise(told)) for t, told in zip(self.tag, self.told)]
        # an element around an article is no noise, whatever it is called, unless it is for what readers or other pages say
        holds, inside = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            holds[i] = holds[i] or (self.tag[i] in ("article", "main", "body") and not noisy[i])
            holds[self.parent[i]] = holds[self.parent[i]] or holds[i]
        for i in range(1, n):
            t, p = self.tag[i], self.parent[i]
            inside[i] = inside[p] or self.tag[p] == "article"
            if t in SITE_TAGS:
                noisy[i] = noisy[i] or t == "footer" or not inside[i]
            if noisy[i]:
                words = {w for g in _word_groups(self.told[i]) for w in g}
                around = holds[i] and t not in ("article", "head", "nav") and not words & _OTHERS
                title = inside[i] and t in ("header", "hgroup", "div") and "header" in words | {t} and not words & (NOISE_WORDS - {"header"})
                noisy[i] = not (around or title)
        self.gone = [False] * n
        for i in range(1, n):
            self.gone[i] = noisy[i] or self.gone[self.parent[i]]
        self.roots = self._article()

    def _article(self) -> list[int]:
        live = [i for i in range(1, len(self.tag)) if not self.gone[i]]
        for these in (
            [i for i in live if self.tag[i] == "article"],
            [i for i in live if self.tag[i] == "main" or self.told[i].get("role", "").lower() == "main"],
            [i for i in live if self.told[i] and self.tag[i] in ("div", "section", "td") and marked_article(self.told[i])],
        ):
            size = self._sizes() if these else []
            these = [i for i in these if size[i]]
            out, past = [], 0
            for i in these:
                if i >= past:
                    out.append(i)
                    past = self.last[i]
            if out and self.tag[out[0]] not in ("article", "main"):  # of the containers that are only named so, the largest
                out = [max(out, key=lambda i: size[i])]
            if out:
                return out
        return []

    def _sizes(self) -> list[int]:
        """Characters of text in each subtree that aren't white space, without what is gone."""
        size = [0] * len(self.tag)
        for node, text in self.events:
            if text and not self.gone[node]:
                size[node] += len("".join(text.split()))
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        return size

    # subtrees

    def hashes(self, site: str) -> list[int]:
        """A 64-bit hash of each subtree on a site: tags and texts in page order, without attributes; 0 where there is no text."""
        own: list[list[str]] = [[] for _ in self.tag]
        for node, text in self.events:
            if text:
                own[node].append(unescape(text))
        child: list[list[str]] = [[] for _ in self.tag]
        out = [0] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            text = _SPACES.sub(" ", "".join(own[i])).strip()
            if text or child[i]:
                out[i] = xxhash.xxh3_64_intdigest("\0".join([site, self.tag[i], text, *reversed(child[i])]).encode("utf-8", "surrogatepass")) or 1
                child[self.parent[i]].append(f"{out[i]:x}")
        return out

    def candidates(self) -> list[int]:
        """Nodes that recurrence may remove: blocks of the page, and inside a marked article only containers that aren't plain text blocks."""
        within, roots, out = self._within(self.roots), set(self.roots), []
        for i in range(1, len(self.tag)):
            t = self.tag[i]
            if t not in BLOCK or t in ("html", "body", "head", "br", "hr") or i in roots:
                continue
            if bisect_left(self.roots, self.last[i]) > bisect_right(self.roots, i):  # around an article
                continue
            if within[i] and (t not in CONTAINERS or (t == "div" and not self.told[i])):
                continue
            out.append(i)
        return out

    def subtrees(self, site: str) -> list[tuple[int, int]]:
        """(hash, identity) of each candidate subtree.

        The identity tells pages of one site apart for counting, so that copies
        of one article count once: the hash of the marked article, or else of
        the longest block of text outside the subtree. If the page's longest
        block is inside, and nothing outside is a quarter as long, the subtree
        is the page rather than a part of it, and has the identity 0.
        """
        hashed = self.hashes(site)
        mark = xxhash.xxh3_64_intdigest(self.text(self.roots).encode("utf-8", "surrogatepass")) if self.roots else 0
        blocks = [] if mark else self._longest_blocks()
        out = {}
        for i in self.candidates():
            if hashed[i]:
                out.setdefault(hashed[i], mark or next((h for b, h, n in blocks if not i <= b < self.last[i] and (4 * n >= blocks[0][2] or not i <= blocks[0][0] < self.last[i])), 0))
        return list(out.items())

    def _longest_blocks(self) -> list[tuple[int, int, int]]:
        """(node, hash, length) of the blocks with text of their own, longest first."""
        home = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            home[i] = i if self.tag[i] in BLOCK else home[self.parent[i]]
        texts: dict[int, list[str]] = {}
        for node, text in self.events:
            if text and not self.gone[node]:
                texts.setdefault(home[node], []).append(text)
        found = [(" ".join("".join(t).split()), i) for i, t in texts.items()]
        found.sort(key=lambda x: (-len(x[0]), x[1]))
        return [(i, xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")), len(t)) for t, i in found if t]

    # text

    def _within(self, roots: list[int]) -> list[bool]:
        out = [False] * len(self.tag)
        for r in roots:
            out[r : self.last[r]] = [True] * (self.last[r] - r)
        return out

    def text(self, roots: list[int], gone: list[bool] | None = None) -> str:
        gone, within = self.gone if gone is None else gone, self._within(roots)
        return " ".join("".join([" " if t is None else unescape(t) for node, t in self.events if within[node] and not gone[node]]).split())

    def main_text(self, site: str = "", recurring: frozenset | set = frozenset()) -> str:
        """The text of the article without the subtrees that recur on the site."""
        gone = list(self.gone)
        if recurring:
            hashed = self.hashes(site)
            for i in self.candidates():
                gone[i] = gone[i] or hashed[i] in recurring
            for i in range(1, len(gone)):
                gone[i] = gone[i] or gone[self.parent[i]]
        if self.roots:
            return self.text(self.roots, gone)
        for i in self._menus(gone):
            gone[i : self.last[i]] = [True] * (self.last[i] - i)
        return self.text([0], gone)

    def _menus(self, gone: list[bool]) -> list[int]:
        """Lists and divisions of a page without a marked article whose text is all links, LEAST_LINKS of them or more."""
        linked = [False] * len(self.tag)
        links, plain = [0] * len(self.tag), [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
            links[i] = int(self.tag[i] == "a")
        for node, text in self.events:
            if text and not linked[node] and re.search(r"\w", text):
                plain[node] += 1
        for i in range(len(self.tag) - 1, 0, -1):
            links[self.parent[i]] += links[i]
            plain[self.parent[i]] += plain[i]
        return [i for i in range(1, len(self.tag)) if not gone[i] and self.tag[i] in ("ul", "ol", "div", "table", "p", "td", "section") and links[i] >= LEAST_LINKS and not plain[i]]
