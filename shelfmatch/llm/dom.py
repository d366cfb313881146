"""A small HTML tree: block-level nodes with their text blocks, and numeric features of every node."""

from __future__ import annotations

import html as _html
import math
import re
import zlib

import numpy as np

#: Element names of the HTML standard by their part in a page's layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript iframe template svg head".split())
SECTIONS = "html body div article section main header footer nav aside".split()
TEXTS = "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address".split()
LISTS = "ul ol li dl dt dd menu table thead tbody tfoot tr td th caption".split()
FORMS = "form fieldset legend button select option textarea label dialog details summary".split()
BLOCK = frozenset(SECTIONS + TEXTS + LISTS + FORMS + ["center", "hr"])
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role attributes that sites use for parts of a page.
TOKENS = {
    "content": "article content main post entry story body text prose news blog page".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toc".split(),
    "head": "header masthead topbar top logo brand".split(),
    "foot": "footer foot bottom copyright legal colophon".split(),
    "side": "sidebar side aside rail widget related recommended popular trending more".split(),
    "advert": "ad ads advert advertisement adsense banner promo sponsor sponsored sponsoring".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe subscription".split(),
    "comment": "comment comments reply replies respond discussion disqus reviews".split(),
    "share": "share sharing social follow tools meta byline tags author".split(),
    "form": "form login signup search contact input".split(),
    "hidden": "hidden invisible none".split(),
}
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)")
#: The rest of a tag; possessive, so that what doesn't fit is read once.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"(class|id|role|data-keep|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Elements that end no further than their parents when the next block begins.
_STOPS = frozenset(("ul", "ol", "dl", "table", "div", "section", "article", "form"))
_KINDS = list(TOKENS)
#: Buckets of attribute words by hash: names that no list holds are learnt from the pages.
HASHED = 24
_FLAG = {w: 1 << k for k, kind in enumerate(_KINDS) for w in TOKENS[kind]}
_GROUP = {t: g for g, tags in enumerate((["html", "body"], ["div", "center"], ["article"], ["section"], ["main"], ["header"], ["footer"], ["nav"], ["aside"], ["p"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["blockquote", "pre", "figure", "figcaption", "address"], ["ul", "ol", "dl", "menu"], ["li", "dt", "dd"], "table thead tbody tfoot tr td th caption".split(), FORMS)) for t in tags}
N_GROUPS = 16


class Tree:
    """Nodes in page order: tag, parent, depth, attribute flags, keep mark, own blocks; and blocks (node, text, link characters)."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.flags, self.mark, self.inputs = ["html"], [-1], [0], [None], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._open = [0]  # open block nodes
        self._at: dict[str, list[int]] = {}  # places of each tag, and of those that stop a search, among the open nodes
        self._stops = [0]
        self._parts: list[str] = []
        self._linked = 0
        links = 0
        for text, closing, tag, rest in tokens(source):
            if tag is None:
                self._parts.append(text)
                self._linked += len(text) if links else 0
            elif closing:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag in BLOCK:
                    self._flush()
                    if self._at.get(tag):
                        self._close(self._at[tag][-1])
            elif tag == "a":
                links += 1
            elif tag == "br":
                self._parts.append(" ")
            elif tag == "input":
                self.inputs[self._open[-1]] += 1
            elif tag in BLOCK:
                self._flush()
                links = 0
                last = max((self._at[t][-1] for t in ("p", *CLOSED_BY.get(tag, ())) if self._at.get(t)), default=0)
                if last > self._stops[-1]:
                    self._close(last)
                if tag not in ("hr", "html"):
                    self._begin(tag, rest)
        self._flush()
        del self._open, self._at, self._stops, self._parts, self._linked

    def _flush(self) -> None:
        if self._parts:
            text = "".join(self._parts)
            if "&" in text:
                text = _html.unescape(text)
            text = " ".join(text.split())
            if text:
                self.blocks.append((self._open[-1], text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _close(self, place: int) -> None:
        """Ends the open node at the place and all in it."""
        while len(self._open) > place:
            at = len(self._open) - 1
            self._at[self.tag[self._open.pop()]].pop()
            if self._stops[-1] == at:
                self._stops.pop()

    def _begin(self, tag: str, attributes: str) -> None:
        flags, mark = 0, None
        if attributes and not attributes.isspace():
            for a in _ATTR.finditer(attributes):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name == "data-keep":
                    mark = value == "1"
                elif name == "hidden":
                    flags |= _FLAG["hidden"]
                else:
                    for w in _WORD.findall(value.lower()):
                        flags |= _FLAG.get(w, 0) | 1 << len(_KINDS) + zlib.crc32(w.encode()) % HASHED
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.flags.append(flags)
        self.mark.append(mark)
        self.inputs.append(0)
        self._at.setdefault(tag, []).append(len(self._open))
        if tag in _STOPS:
            self._stops.append(len(self._open))
        self._open.append(len(self.tag) - 1)

    def ends(self) -> list[int]:
        """For each node the first node after all those in it."""
        out = list(range(1, len(self.tag) + 1))
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] = max(out[self.parent[i]], out[i])
        return out


def tokens(source: str):
    """(text, None, None, None) or ("", closing, tag, attributes) in page order; comments and raw elements are left out.

    Linear in the page: a tag whose quotes don't close is read to the next ``>`` and all later ones likewise,
    and what was once looked for in vain isn't looked for again.
    """
    at, size, begin = 0, len(source), 0  # begin: of text not given yet
    quoted, missing = True, set()
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            break
        kind = source[lt + 1 : lt + 2]
        m = rest = None
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            end = size if end < 0 else end + 3
        elif kind in ("!", "?"):
            end = source.find(">", lt) + 1
        else:
            m = _NAME.match(source, lt + 1)
            if m is None:
                at = lt + 1
                continue
            r = _REST.match(source, m.end()) if quoted else None
            if r is not None:
                rest, end = r[1], r.end()
            else:
                quoted = False
                end = source.find(">", m.end()) + 1
                rest = source[m.end() : end - 1]
        if not end:  # no tag ends from here on
            break
        if lt > begin:
            yield source[begin:lt], None, None, None
        at = begin = end
        if m is None:
            continue
        tag = m[2].lower()
        if tag not in RAW:
            yield "", bool(m[1]), tag, rest
        elif not m[1] and not (tag == "svg" and rest.rstrip().endswith("/")):
            found = None if tag in missing else _RAW_END[tag].search(source, end)
            if found is not None:
                at = begin = found.end()
            elif tag in ("script", "style", "title"):
                at = begin = size
            else:
                missing.add(tag)
    if begin < size:
        yield source[begin:], None, None, None


N_FEATURES = N_GROUPS * 2 + 2 * (len(_KINDS) + HASHED) + 20


def features(tree: Tree) -> np.ndarray:
    """One row for each node: tag and parent's tag, attribute words (by kind and by hash) of it and its ancestors, subtree density, depth, siblings, place."""
    return np.concatenate(list(feature_rows(tree)))


def feature_rows(tree: Tree, most: int = 20_000):
    """The rows of ``features`` in blocks, so that a page of very many nodes takes little memory at a time."""
    n = len(tree.tag)
    own, link, stops, count, words, first = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    so_far = 0
    for node, text, linked in tree.blocks:
        size = len(text)
        own[node] += size
        link[node] += linked
        stops[node] += text.count(".") + text.count(",")
        words[node] += text.count(" ") + 1
        count[node] += 1
        so_far += size
    total = max(so_far, 1)
    parent = tree.parent
    chars, links, dots, blocks, nodes, tokens, inputs = own[:], link[:], stops[:], count[:], [1] * n, words[:], tree.inputs[:]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        dots[p] += dots[i]
        blocks[p] += blocks[i]
        nodes[p] += nodes[i]
        tokens[p] += tokens[i]
        inputs[p] += inputs[i]
    depth, above, place, kids = [0] * n, [0] * n, [0] * n, [0] * n
    last = [0] * n
    prev_chars = [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | tree.flags[p]
        place[i] = kids[p]
        kids[p] += 1
        prev_chars[i] = chars[last[p]] if last[p] else 0
        last[p] = i
    before, seen = [0] * n, 0
    k = 0
    for i in range(n):  # characters before the node's first block
        while k < len(tree.blocks) and tree.blocks[k][0] < i:
            seen += len(tree.blocks[k][1])
            k += 1
        before[i] = seen
    log, kinds = math.log1p, len(_KINDS) + HASHED
    bits = np.arange(kinds)
    for start in range(0, n, most):
        stop = min(n, start + most)
        x = np.zeros((stop - start, N_FEATURES), np.float32)
        x[:, 2 * N_GROUPS : 2 * N_GROUPS + kinds] = np.array(tree.flags[start:stop], np.int64)[:, None] >> bits & 1
        x[:, 2 * N_GROUPS + kinds : 2 * N_GROUPS + 2 * kinds] = np.array(above[start:stop], np.int64)[:, None] >> bits & 1
        for i in range(start, stop):
            g, p = _GROUP.get(tree.tag[i], 1), parent[i]
            r = x[i - start]
            r[g] = 1
            if p >= 0:
                r[N_GROUPS + _GROUP.get(tree.tag[p], 1)] = 1
            at = 2 * N_GROUPS + 2 * kinds
            c = chars[i]
            sib = kids[p] if p >= 0 else 1
            r[at : at + 18] = (log(c), log(own[i]), links[i] / (c + 1), dots[i] / (c + 1), c / (tokens[i] + 1), log(tokens[i]), nodes[i] / (c + 1) * 10, log(nodes[i]), log(blocks[i]), c / (blocks[i] + 1), depth[i], place[i] / sib, sib, kids[i], before[i] / total, c / total, log(prev_chars[i]), inputs[i])
            r[at + 18] = chars[p] / total if p >= 0 else 1
            r[at + 19] = c / (chars[p] + 1) if p >= 0 else 1
        yield x


def decode(tree: Tree, p: np.ndarray, switch: float = 0.7) -> list[str]:
    """Text blocks kept by the best consistent choice: a node is kept whole, dropped whole, or left to its children at a price."""
    n = len(tree.tag)
    own = [0] * n
    for node, text, _ in tree.blocks:
        own[node] += len(text)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weight = np.array([0.5 + math.log1p(c) for c in own])
    yes, no = np.log(p) * weight, np.log1p(-p) * weight
    yes, no = yes.tolist(), no.tolist()
    own_yes, own_no = yes[:], no[:]
    mixed = [max(a, b) - switch if c else -0.1 * switch for a, b, c in zip(yes, no, own)]
    for i in range(n - 1, 0, -1):
        q = tree.parent[i]
        yes[q] += yes[i]
        no[q] += no[i]
        mixed[q] += max(yes[i], no[i], mixed[i])
    keep: list[bool] = [False] * n
    fixed: list[bool | None] = [None] * n
    for i in range(n):
        q = tree.parent[i]
        if q >= 0 and fixed[q] is not None:
            fixed[i] = fixed[q]
        elif yes[i] > no[i] and yes[i] >= mixed[i]:
            fixed[i] = True
        elif no[i] >= mixed[i]:
            fixed[i] = False
        keep[i] = fixed[i] if fixed[i] is not None else own_yes[i] > own_no[i]
    return [text for node, text, _ in tree.blocks if keep[node]]
