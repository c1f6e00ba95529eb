"""Pages as trees of blocks: a forgiving reader of HTML, and numbers about its nodes.

A node is a block element or a run of text within one; inline elements
belong to the run.  Numbers of a whole batch of pages are computed at once.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np

# Groups of block elements.
GROUPS = {
    "page": "",
    "article": "article main",
    "box": "div section center details dialog hgroup address",
    "paragraph": "p",
    "heading": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol dl dir menu",
    "item": "li dt dd",
    "table": "table caption thead tbody tfoot tr",
    "cell": "td th",
    "nav": "nav",
    "header": "header",
    "footer": "footer",
    "aside": "aside",
    "form": "form fieldset legend",
    "figure": "figure figcaption",
    "quote": "blockquote pre summary",
    "text": "",
}
GROUP = {name: i for i, name in enumerate(GROUPS)}
BLOCK = {tag: GROUP[name] for name, tags in GROUPS.items() for tag in tags.split()}
TEXT = GROUP["text"]

# What tells the kind of an element in its class, id, role and style.
KINDS = {
    "main": "article content main post entry story body text prose",
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs toolbar pagination pager tabs tab",
    "head": "header head masthead logo top topbar brand banner",
    "foot": "footer foot copyright bottom colophon legal contentinfo",
    "side": "sidebar aside side rail widget secondary complementary related recommended popular trending more",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promoted promotion dfp adslot adsense",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe warning",
    "form": "form login signin signup search register field input",
    "comment": "comment comments commentlist reply replies discussion disqus respond feedback",
    "share": "share sharing social follow tweet like",
    "hidden": "hidden none invisible",
}
KIND = {word: 1 << i for i, words in enumerate(KINDS.values()) for word in words.split()}
#: Ancestors' groups that are remembered beside the kinds, as further bits.
ABOVE = {GROUP[name]: 1 << (len(KINDS) + i) for i, name in enumerate(("article", "nav", "header", "footer", "aside", "form", "list", "cell", "heading"))}
ABOVE_BITS = len(KINDS) + len(ABOVE)

# Elements without an end, elements without text of the page, and what ends where another starts.
VOID = frozenset("br hr img input meta link wbr col source embed area base param track keygen".split())
RAW = frozenset("script style title textarea iframe xmp noframes noembed".split())
UNSEEN = frozenset("noscript template select button svg math canvas object video audio datalist map".split())
ENDS = {"li": ("li", "ul ol dir menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
ENDS = {tag: (frozenset(own.split()), frozenset(stop.split())) for tag, (own, stop) in ENDS.items()}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|data-main)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.!?;:,。，！？]")


@lru_cache(4096)
def kinds(attributes: str) -> tuple[int, bool]:
    """(bits of the kinds that the attributes' words tell, whether the element is labelled as main)."""
    bits, labelled = 0, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "data-main":
            labelled = True
        elif name == "hidden" or name == "aria-hidden" and "true" in value.lower():
            bits |= KIND["hidden"]
        elif name != "style":
            for word in _TOKEN.findall(value):
                bits |= KIND.get(word.lower(), 0)
        elif re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            bits |= KIND["hidden"]
    return bits, labelled


class Blocks:
    """The nodes of many pages, one after the other; a node's parent comes before it."""

    #: Of each node: page, parent, group, kinds, those of what is above it, depth, and counts of its own text.
    COLUMNS = ("page", "parent", "group", "kinds", "above", "depth", "chars", "words", "linked", "marks", "digits", "inputs", "images", "label")

    def __init__(self):
        self.rows: list[tuple] = []
        self.texts: list[str] = []
        self.pages: list[int] = []

    def _add(self, page: int, parent: int, group: int, bits: int, label: int, counts=(0, 0, 0, 0, 0, 0, 0), text: str = "") -> int:
        above = depth = 0
        if parent >= 0:
            up = self.rows[parent]
            above, depth = up[4] | up[3] | ABOVE.get(up[2], 0), up[5] + 1
        self.rows.append((page, parent, group, bits, above, depth, *counts, label))
        self.texts.append(text)
        return len(self.rows) - 1

    def read(self, html: str) -> None:
        """Add a page: its root is a node of the group ``page``."""
        page = len(self.pages)
        root = self._add(page, -1, GROUP["page"], 0, 0)
        self.pages.append(root)
        stack: list[tuple[str, int, bool]] = [("", root, False)]
        open_tags: dict[str, int] = {}
        parts: list[str] = []
        linked = images = inputs = links = 0
        low = ""

        def flush() -> None:
            nonlocal linked, images, inputs
            text = " ".join("".join(parts).split())
            parts.clear()
            if text or inputs or images:
                digits = sum(map(str.isdigit, text)) if text else 0
                counts = (len(text), text.count(" ") + 1 if text else 0, min(linked, len(text)), len(_MARKS.findall(text)), digits, inputs, images)
                self._add(page, stack[-1][1], TEXT, 0, int(stack[-1][2]), counts, text)
            linked = images = inputs = 0

        def pop(upto: int) -> None:
            while len(stack) > upto:
                tag = stack.pop()[0]
                open_tags[tag] -= 1

        at = 0
        while at <= len(html):
            found = _MARKUP.search(html, at)
            piece = html[at : found.start() if found else len(html)]
            if piece:
                piece = unescape(piece) if "&" in piece else piece
                parts.append(piece)
                if links:
                    linked += len(piece.strip())
            if not found:
                break
            at = found.end()
            if not found[2]:
                continue
            tag, end = found[2].lower(), bool(found[1])
            if tag == "a":
                links = 0 if end else 1
            elif tag == "br":
                parts.append(" ")
            elif tag == "img":
                images += not end
            elif tag == "input":
                inputs += not end
            elif tag in RAW or tag in UNSEEN:
                if end:
                    continue
                low = low or html.lower()
                close = low.find(f"</{tag}", at)
                if close >= 0:
                    at = close
                    inputs += tag in ("select", "button", "textarea")
                elif tag in RAW:
                    break
            elif tag in BLOCK or "-" in tag or tag in ("hr", "body", "head", "html"):
                flush()
                links = 0
                if tag in VOID or tag in ("body", "head", "html"):
                    continue
                if end:
                    if open_tags.get(tag):
                        upto = len(stack) - 1
                        while stack[upto][0] != tag:
                            upto -= 1
                        pop(upto)
                    continue
                if stack[-1][0] == "p":
                    pop(len(stack) - 1)
                if tag in ENDS and any(open_tags.get(t) for t in ENDS[tag][0]):
                    own, stop = ENDS[tag]
                    upto = len(stack) - 1
                    while upto and stack[upto][0] not in own and stack[upto][0] not in stop:
                        upto -= 1
                    if stack[upto][0] in own:
                        pop(upto)
                bits, labelled = kinds(found[3])
                labelled = labelled or stack[-1][2]
                node = self._add(page, stack[-1][1], BLOCK.get(tag, GROUP["box"]), bits, 0)
                stack.append((tag, node, labelled))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        flush()

    def arrays(self) -> dict[str, np.ndarray]:
        table = np.array(self.rows, np.int64).reshape(-1, len(self.COLUMNS))
        return dict(zip(self.COLUMNS, table.T))


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, the deepest first; the roots are left out."""
    order = np.argsort(-depth, kind="stable")
    bounds = np.flatnonzero(np.diff(depth[order])) + 1
    return [x for x in np.split(order, bounds) if len(x) and depth[x[0]]]


FEATURES = [
    "depth", "chars", "words", "link_density", "mark_density", "digit_density", "chars_per_node", "runs", "chars_per_run",
    "share_of_page", "share_of_parent", "before", "after", "place", "siblings", "same_siblings", "previous_chars", "next_chars",
    "previous_links", "next_links", "word_length", "inputs", "images", "paragraphs", "headings", "linked_items", "parent_group",
    *[f"is_{name}" for name in GROUPS],
    *[f"has_{name}" for name in KINDS],
    *[f"below_{i}" for i in range(ABOVE_BITS)],
]


def features(a: dict[str, np.ndarray]) -> np.ndarray:
    """A row of ``FEATURES`` for each node: its subtree's density, its attributes' words, its depth and its siblings."""
    n = len(a["page"])
    if not n:
        return np.zeros((0, len(FEATURES)), np.float32)
    parent, group = a["parent"], a["group"]
    sums = {k: a[k].astype(np.float64) for k in ("chars", "words", "linked", "marks", "digits", "inputs", "images")}
    sums["nodes"] = np.ones(n)
    sums["runs"] = (group == TEXT) & (a["chars"] > 0)
    sums["paragraphs"] = group == GROUP["paragraph"]
    sums["headings"] = group == GROUP["heading"]
    sums["items"] = group == GROUP["item"]
    sums = {k: v.astype(np.float64) for k, v in sums.items()}
    for level in levels(a["depth"]):
        for v in sums.values():
            np.add.at(v, parent[level], v[level])
    up = np.where(parent < 0, np.arange(n), parent)
    roots = np.flatnonzero(parent < 0)
    root = roots[np.searchsorted(roots, np.arange(n), side="right") - 1]
    chars, total = sums["chars"], np.maximum(sums["chars"][root], 1)
    own = np.concatenate([[0.0], np.cumsum(np.where(group == TEXT, a["chars"], 0))])
    before = own[np.arange(n)] - own[root]
    # siblings lie in order of their numbers
    order = np.lexsort((np.arange(n), parent))
    first = np.ones(n, bool)
    first[1:] = parent[order][1:] != parent[order][:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n) - start
    siblings = np.bincount(up, minlength=n)[up]
    width = len(GROUPS)
    kin = up * width + group
    _, which, same = np.unique(kin, return_inverse=True, return_counts=True)
    density = sums["linked"] / np.maximum(chars, 1)
    neighbours = np.zeros((4, n))
    before_it, after_it = order[:-1][~first[1:]], order[1:][~first[1:]]
    neighbours[0, after_it], neighbours[1, before_it] = chars[before_it], chars[after_it]
    neighbours[2, after_it], neighbours[3, before_it] = density[before_it], density[after_it]
    log = np.log1p
    columns = [
        a["depth"], log(chars), log(sums["words"]), density, sums["marks"] / np.maximum(sums["words"], 1), sums["digits"] / np.maximum(chars, 1),
        log(chars / sums["nodes"]), log(sums["runs"]), log(chars / np.maximum(sums["runs"], 1)),
        chars / total, chars / np.maximum(chars[up], 1), before / total, (before + chars) / total,
        place, log(siblings), same[which] / np.maximum(siblings, 1), log(neighbours[0]), log(neighbours[1]),
        neighbours[2], neighbours[3], chars / np.maximum(sums["words"], 1), sums["inputs"], sums["images"],
        sums["paragraphs"], sums["headings"], density * sums["items"], group[up],
        *[group == i for i in range(width)],
        *[(a["kinds"] >> i) & 1 for i in range(len(KINDS))],
        *[(a["above"] >> i) & 1 for i in range(ABOVE_BITS)],
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


def labels(a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(1 for nodes that hold labelled text, the nodes that hold text at all)."""
    y, some = a["label"] * (a["chars"] > 0), (a["chars"] > 0).astype(np.int64)
    for level in levels(a["depth"]):
        np.maximum.at(y, a["parent"][level], y[level])
        np.maximum.at(some, a["parent"][level], some[level])
    return y, some.astype(bool)


def decode(a: dict[str, np.ndarray], yes: np.ndarray) -> np.ndarray:
    """The nodes to keep, by their log-odds ``yes``: the likeliest choice in which they don't contradict each other.

    A kept node's ancestors are kept, and a kept node has a kept child or is a
    run of text; nodes without text are never kept.  One pass up the tree
    finds for each subtree what its best choice gains over dropping it whole,
    one pass down makes the choices.
    """
    n = len(yes)
    parent = a["parent"]
    some = labels(a)[1]
    gain = np.where(some, yes, -np.inf)
    taken = np.zeros(n)
    best = np.full(n, -np.inf)  # of the children
    for level in levels(a["depth"]):
        inner = level[a["group"][level] != TEXT]
        gain[inner] += np.where(np.isneginf(best[inner]), -np.inf, np.where(best[inner] > 0, taken[inner], best[inner]))
        up = parent[level]
        np.add.at(taken, up, np.maximum(gain[level], 0))
        np.maximum.at(best, up, gain[level])
    roots = np.flatnonzero(parent < 0)
    gain[roots] += np.where(np.isneginf(best[roots]), -np.inf, np.where(best[roots] > 0, taken[roots], best[roots]))
    keep = np.zeros(n, bool)
    keep[roots] = gain[roots] > 0
    for level in reversed(levels(a["depth"])):
        up = parent[level]
        # where no child is worth it by itself, a kept node keeps the first best one
        alone = (best[up] <= 0) & (gain[level] == best[up])
        chosen = keep[up] & ((gain[level] > 0) | alone) & some[level]
        rest = chosen & alone
        if rest.any():
            where = np.flatnonzero(rest)
            _, firsts = np.unique(up[where], return_index=True)
            chosen[where] = False
            chosen[where[firsts]] = True
        keep[level] = chosen
    return keep
