"""Main text of HTML pages, read through wrappers inferred from pages of the same host.

A wrapper is a union-free regular expression over tags and text slots, with optional and repeated groups,
found by folding repeats within each page and then aligning page after page: equal
tokens stay, texts that differ become slots, parts that one side lacks become
optional, runs of the same part become repeated groups. Every slot has a role: content, constant
(a text that all pages have) or other. A page is aligned with its host's wrapper, and the slots that its
texts fall into say which of them are the article. What elements say of themselves (names, classes,
roles) is evidence for the roles of slots, and the last word on texts that no wrapper knows.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, prepare
from .urls import host_column

#: Pages of a host, those of the smallest hashes, that its wrapper is inferred from.
SAMPLED = 24
#: Pages that must agree, in a part that all of them have, before a text counts as constant.
AGREE = 3
#: Share of a slot's characters that are links from which on it is a menu.
LINKED = 0.7
#: Wrappers of all hosts together that are handed to the workers as one value; more are dealt out with the pages.
HANDED_BYTES = 32 << 20
#: Pages of one host that go to one task where wrappers are dealt out.
HOT_PAGES = 100_000
#: Bits of a table of alignment kept at once; longer sequences are halved first.
ALIGN_BITS = 1 << 29

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("nav header footer aside form head script style noscript template title iframe svg math xmp noembed noframes button select option textarea object canvas audio video dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: These end where an equal one starts, unless one of CONTAINERS is in between.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table ul".split())
#: A class or id name made of these words, and of BESIDE, says that an element is no part of the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say where or of what kind a marked element is, and nothing of its own.
BESIDE = frozenset(
    "area articles aside bar block body bottom box btn button buttons center col column container content desktop div footer global group holder icons inline inner item items left link links list main mobile outer page pages panel policy post posts primary right row secondary section signup site slot stories sub text thread top unit user widget wrap wrapper".split()
)
#: Classes that make an article element one of the others: a reader's comment, a card.
ARTICLE_MARKS = frozenset("ad advert advertisement comment comments promo related reply sponsored".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTR = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"display\s*:\s*none")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) for tags and texts in order: kinds "<", "/" and "#"; comments and raw texts are passed over.

    A script or style that is never closed takes the rest, as in browsers; other raw elements that are
    never closed end with their parent.
    """
    at, n = 0, len(page)
    open_ended: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "#", "", page[at:]
            return
        if lt > at:
            yield "#", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        follow = page[lt + 1 : lt + 2]
        if follow in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (follow.isalpha() or follow == "/" and page[lt + 2 : lt + 3].isalpha()):
            yield "#", "", "<"
            at = lt + 1
            continue
        m = _TAG.match(page, lt)
        if m:
            close, name, rest, at = m[1], m[2].lower(), m[3], m.end()
        else:  # a quote is left open: the tag ends at the first >
            end = page.find(">", lt)
            if end < 0:
                return
            close, (name, _, rest), at = "/" * (follow == "/"), page[lt + 1 : end].lstrip("/").partition(" "), end + 1
            name = name.lower()
        if close:
            yield "/", name, ""
            continue
        yield "<", name, rest
        if name in RAW and not rest.endswith("/") and name not in open_ended:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if end is not None:
                at = end.start()
            elif name in ("script", "style"):
                return
            else:
                open_ended.add(name)  # nor does a later one end


def marked(names: str) -> bool:
    """Whether one of the names in a class or id attribute says that an element is no part of the article."""
    for name in names.split():
        parts = {x.lower() for x in _PARTS.findall(name)}
        if parts & MARKS and parts <= MARKS | BESIDE:
            return True
    return False


def _element(name: str, rest: str, in_main: bool) -> tuple[bool, str, bool]:
    """Whether an element is no part of an article, its label for paths, and whether it says to be the main part."""
    whole = name in ("html", "body")
    main = name in ("article", "main")
    out = name in LEFT_OUT and not (name == "header" and in_main)  # an article's own head is part of it
    label = name
    if rest and not rest.isspace():
        for key, value in _ATTR.findall(rest):
            key, value = key.lower(), value.strip("\"'")
            if key == "class":
                label += "." + ".".join(re.sub(r"\d+", "#", value.lower()).split())
                if main:
                    out |= bool({x.lower() for x in value.split()} & ARTICLE_MARKS)
                else:
                    out |= marked(value) and not whole
            elif key == "id":
                out |= not main and marked(value) and not whole
            elif key == "role":
                out |= value.lower() in ROLES
                main |= value.lower() == "main"
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value.lower()):
                out |= not whole
    main &= not out
    return out, label + ("!" if out else "*" if main else ""), main


@dataclass
class Block:
    """A text, the labels of the block elements round it, what they say, and how many characters are links."""

    text: str
    path: tuple[str, ...]
    main: bool
    out: bool
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The texts of a page in order, block by block; scripts, styles and other raw texts are none."""
    # name, left out, in the main part, label, in a link, within an inline element that is left out
    stack: list[tuple[str, bool, bool, str, bool, bool]] = []
    top = ("", False, False, "", False, False)
    found: list[Block] = []
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                found.append(Block(text, tuple(x[3] for x in stack if x[0] in BLOCK), top[2], top[1], min(linked, len(text))))
        linked = 0

    def close(i: int) -> None:
        """End the i-th open element, and those within it that are still open."""
        nonlocal top
        del stack[i + 1 :]
        top = stack[i]
        if top[0] in BLOCK and not top[5]:
            flush()
        del stack[i]
        top = stack[-1] if stack else ("", False, False, "", False, False)

    for kind, name, rest in events(page or ""):
        if kind == "#":
            if not top[5]:
                text = html.unescape(rest) if "&" in rest else rest
                held.append(text)
                if top[4]:
                    linked += len(text.strip())
            continue
        if name == "br" and not top[5]:
            held.append(" ")
        if name in BLOCK and not top[5]:
            flush()
        if kind == "<":
            if name in CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES[name]:
                        close(i)
                        break
                    if stack[i][0] in CONTAINERS:
                        break
            if name not in VOID and not rest.endswith("/"):
                no, label, main = _element(name, rest, top[2])
                top = (name, top[1] or no, (top[2] or main) and not no, label, top[4] or name == "a", top[5] or no and name not in BLOCK)
                stack.append(top)
        else:
            inline = name not in BLOCK and name not in LEFT_OUT
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if inline and stack[i][0] in BLOCK:  # an inline element ends no block
                    break
    flush()
    return found


# ---- wrappers: items are ("t", tag), ("s", path, texts, counts, places), ("o", items) and ("r", items)
# texts: one text, or two of several (enough to know whether it is constant); counts: [characters, linked ones];
# places: which blocks of a page fell into the slot


def _key(item) -> tuple:
    """What aligns: tags by name, slots by path, groups by content; repeated or optional parts align with single ones."""
    return item[:2] if item[0] in "ts" else ("g", *(_key(x) for x in item[1]))


def outline(found: list[Block]) -> list:
    """Blocks of a page as items, one slot per text, repeats folded."""
    items: list = []
    path: tuple[str, ...] = ()
    for i, b in enumerate(found):
        shared = 0
        while shared < min(len(path), len(b.path)) and path[shared] == b.path[shared]:
            shared += 1
        items += [("t", f"</{x}>") for x in reversed(path[shared:])]
        items += [("t", f"<{x}>") for x in b.path[shared:]]
        if path == b.path and path:  # a new element of the same name
            items += [("t", f"</{path[-1]}>"), ("t", f"<{path[-1]}>")]
        items.append(("s", b.path, frozenset([b.text]), [len(b.text), b.linked], [i]))
        path = b.path
    return fold(items + [("t", f"</{x}>") for x in reversed(path)])


def _numbered(items: list, numbers: dict) -> np.ndarray:
    return np.array([numbers.setdefault(_key(x), len(numbers)) for x in items], dtype=np.int64)


def fold(items: list) -> list:
    """Runs of equal parts become repeated groups, shortest parts first."""
    numbers: dict = {}
    size = 0
    ids = _numbered(items, numbers)
    while len(items) > 1:
        # distances to the next equal item: no other size can repeat
        order = np.argsort(ids, kind="stable")
        gaps = np.diff(order)[np.diff(ids[order]) == 0]
        sizes = np.unique(gaps[(gaps > size) & (2 * gaps <= len(ids))])
        for size in sizes.tolist():
            runs = np.diff(np.concatenate(([0], np.cumsum(ids[:-size] == ids[size:]))), prepend=0)[1:]
            total = np.concatenate(([0], np.cumsum(runs)))
            if (total[size:] - total[:-size] == size).any() and _repeat(items, ids, size):
                break
        else:
            break
        items = _folded(items, ids, size)
        ids = _numbered(items, numbers)
    return items


def _repeat(items: list, ids: np.ndarray, size: int) -> bool:
    """Whether a part of this size is there twice in a row; one tag alone is no part."""
    return size > 1 or any(ids[i] == ids[i + 1] and items[i][0] != "t" for i in range(len(ids) - 1))


def _folded(items: list, ids: np.ndarray, size: int) -> list:
    keys, at, out = ids.tolist(), 0, []
    while at < len(items):
        runs = 1
        while at + (runs + 1) * size <= len(items) and keys[at : at + size] == keys[at + runs * size : at + (runs + 1) * size]:
            runs += 1
        if runs > 1 and not (size == 1 and items[at][0] == "t"):
            part = items[at : at + size]
            for r in range(1, runs):
                part = [_join(a, b) for a, b in zip(part, items[at + r * size : at + (r + 1) * size])]
            out.append(part[0] if size == 1 and part[0][0] == "r" else ("r", part))
            at += runs * size
        else:
            out.append(items[at])
            at += 1
    return out


def _join(a, b):
    """Two aligned items as one."""
    if a[0] == "t":
        return a
    if a[0] == "s":
        a[4].extend(b[4])
        texts = a[2] if len(a[2]) > 1 else a[2] | b[2]
        return ("s", a[1], texts if len(texts) < 3 else frozenset(sorted(texts)[:2]), [a[3][0] + b[3][0], a[3][1] + b[3][1]], a[4])
    return ("r" if "r" in (a[0], b[0]) else "o", [_join(x, y) for x, y in zip(a[1], b[1])])


def _single_repeats(items: list, units: list[tuple]) -> list:
    """A part that repeats on the other page is a repeated group here too, if only of one."""
    if not units:
        return items
    first: dict = {}
    for u in units:
        first.setdefault(u[0], []).append(u)
    keys, at, out = [_key(x) for x in items], 0, []
    while at < len(items):
        unit = next((u for u in first.get(keys[at], ()) if tuple(keys[at : at + len(u)]) == u), None)
        if unit:
            out.append(("r", items[at : at + len(unit)]))
            at += len(unit)
        else:
            out.append(items[at])
            at += 1
    return fold(out)


def _rows(a: list, b: list) -> list[int]:
    """Bit rows of a longest common subsequence: in row i bit j is 0 where b's j-th item lengthens it over a's first i."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [full], full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of hashable items."""
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    while min(n, m) > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    head, tail = [(i, i) for i in range(low)], [(n + i, m + i) for i in range(len(a) - n)]
    x, y = a[low:n], b[low:m]
    if not x or not y:
        return head + tail
    if len(x) > 1 and len(x) * len(y) > ALIGN_BITS:
        # halve a where the two parts of b are best shared out, so that no table is large
        half = len(x) // 2
        gain = lambda row: np.concatenate(([0], np.cumsum(1 - np.array([row >> j & 1 for j in range(len(y))]))))
        left, right = gain(_rows_last(x[:half], y)), gain(_rows_last(x[half:][::-1], y[::-1]))
        cut = int((left + right[::-1]).argmax())
        mid = common(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in common(x[half:], y[cut:])]
    else:
        rows, mid, i, j = _rows(x, y), [], len(x), len(y)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i] >> (j - 1) & 1:
                    j -= 1
                    mid.append((i, j))
        mid.reverse()
    return head + [(low + i, low + j) for i, j in mid] + tail


def _rows_last(a: list, b: list) -> int:
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def _units(items: list) -> set[tuple]:
    return {tuple(_key(y) for y in x[1]) for x in items if x[0] == "r"}


def _alike(a: list, b: list) -> tuple[list, list]:
    """Both with their repeats written alike."""
    ua, ub = _units(a), _units(b)
    order = lambda us: sorted(us, key=lambda u: (-len(u), repr(u)))
    return _single_repeats(a, order(ub - ua)) if ub - ua else a, _single_repeats(b, order(ua - ub)) if ua - ub else b


def align(a: list, b: list) -> list:
    """The wrapper of two: a longest common subsequence stays, what only one side has is optional."""
    a, b = _alike(a, b)
    numbers: dict = {}
    pairs = common(_numbered(a, numbers).tolist(), _numbered(b, numbers).tolist())
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        for only in (a[i:x], b[j:y]):
            if only:
                out.append(only[0] if len(only) == 1 and only[0][0] in "ro" else ("o", only))
        if x < len(a):
            out.append(_join(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def expression(items: list) -> str:
    """The wrapper as a readable regular expression; constant texts stay, slots are #TEXT."""
    part = lambda x: x[1] if x[0] == "t" else (next(iter(x[2])) if len(x[2]) == 1 else "#TEXT") if x[0] == "s" else f"({expression(x[1])})" + ("+" if x[0] == "r" else "?")
    return "".join(map(part, items))


CONTENT, OTHER, CONSTANT = "content", "other", "constant"


def _said(path: tuple[str, ...]) -> str | None:
    """What the elements round a text say of it: the innermost that says anything, but nothing within one that is left out is content."""
    return OTHER if any(x[-1] == "!" for x in path) else CONTENT if any(x[-1] == "*" for x in path) else None


@dataclass
class Wrapper:
    """What pages of a host share: the items, from how many pages they come, and whether most of these mark their article."""

    pages: int
    items: list
    has_main: bool = False

    def __post_init__(self) -> None:
        #: Counts of characters and linked ones by path, over all slots of the path.
        self.counts: dict[tuple[str, ...], list[int]] = {}
        self.constants: dict[tuple[str, ...], set[str]] = {}
        self.slots: set[tuple[str, ...]] = set()
        self._walk(self.items, False)
        self.units = sorted(_units(self.items), key=lambda u: (-len(u), repr(u)))

    def _walk(self, items: list, loose: bool) -> None:
        for x in items:
            if x[0] == "s":
                n = self.counts.setdefault(x[1], [0, 0])
                n[0], n[1] = n[0] + x[3][0], n[1] + x[3][1]
                self.slots.add(x[1])
                if self._constant(x, loose):
                    self.constants.setdefault(x[1], set()).update(x[2])
            elif x[0] in "ro":
                self._walk(x[1], True)

    def _constant(self, slot, loose: bool) -> bool:
        return not loose and len(slot[2]) == 1 and self.pages >= AGREE

    def role(self, slot, loose: bool) -> str:
        """Role of a slot; marks come first, then whether the host marks its articles at all, then constancy and links."""
        said = _said(slot[1])
        if said or self.has_main:
            return said or OTHER
        if self._constant(slot, loose):
            return CONSTANT
        chars, linked = self.counts.get(slot[1], slot[3])
        return OTHER if linked >= LINKED * chars else CONTENT

    def texts(self, found: list[Block]) -> list[str]:
        """The article's texts among the blocks of a page."""
        keep = [False] * len(found)
        page_main = any(b.main for b in found)

        def unknown(places: list[int]) -> None:
            for i in places:
                b = found[i]
                said = _said(b.path)
                if said or page_main:
                    keep[i] = said == CONTENT
                elif b.path in self.slots:
                    keep[i] = self.role(("s", b.path, (), (b.linked, len(b.text)), []), True) == CONTENT and b.text not in self.constants.get(b.path, ())
                else:
                    keep[i] = b.linked < LINKED * len(b.text)

        def all_unknown(items: list) -> None:
            for x in items:
                if x[0] == "s":
                    unknown(x[4])
                elif x[0] in "ro":
                    all_unknown(x[1])

        def walk(own: list, wrapper: list, loose: bool) -> None:
            numbers: dict = {}
            seen = 0
            for i, j in common(_numbered(own, numbers).tolist(), _numbered(wrapper, numbers).tolist()):
                all_unknown(own[seen:i])
                seen = i + 1
                x, y = own[i], wrapper[j]
                if x[0] == "s":
                    # beside an article that the page marks nothing unmarked counts
                    role = OTHER if page_main and _said(y[1]) is None else self.role(y, loose)
                    for p in x[4]:
                        keep[p] = role == CONTENT or role == CONSTANT and found[p].text not in y[2]
                elif x[0] in "ro":
                    walk(x[1], y[1], True)
            all_unknown(own[seen:])

        own = outline(found)
        mine = _units(own)
        own = _single_repeats(own, [u for u in self.units if u not in mine])
        walk(own, self.items if not mine - set(self.units) else _single_repeats(self.items, sorted(mine - set(self.units), key=lambda u: (-len(u), repr(u)))), False)
        if self.has_main and not page_main and not any(keep):
            # the host marks its articles, this page doesn't: its texts go by its own marks
            for i, b in enumerate(found):
                keep[i] = not b.out and b.linked < LINKED * len(b.text) and b.text not in self.constants.get(b.path, ())
        return [b.text for b, k in zip(found, keep) if k]

    def dump(self) -> str:
        def plain(items: list) -> list:
            return [[x[0], x[1]] if x[0] == "t" else ["s", list(x[1]), sorted(x[2]), x[3]] if x[0] == "s" else [x[0], plain(x[1])] for x in items]

        return json.dumps([self.pages, self.has_main, plain(self.items)], ensure_ascii=True)

    @classmethod
    def load(cls, text: str) -> Wrapper:
        def back(items: list) -> list:
            return [tuple(x) if x[0] == "t" else ("s", tuple(x[1]), frozenset(x[2]), x[3], []) if x[0] == "s" else (x[0], back(x[1])) for x in items]

        pages, has_main, items = json.loads(text)
        return cls(pages, back(items), has_main)


def _different(found: list[Block], kept: list[Counter]) -> bool:
    """Whether a page's own texts are, for the greater part, not those of one already kept: copies prove nothing constant."""
    own = Counter({b.text: len(b.text) for b in found if not b.out})
    for other in kept:
        if 2 * sum(n for t, n in own.items() if t in other) > min(sum(own.values()), sum(other.values())):
            return False
    kept.append(own)
    return True


def infer(pages: list[str]) -> Wrapper | None:
    """The wrapper of the pages of a host that differ; None if none has a text.

    Copies and near copies of a page count once, or what they share would be called constant.
    Pages without a block and null pages are passed over; the order of the pages matters for ties only.
    """
    kept: list[Counter] = []
    whole, n, mains = None, 0, 0
    for page in dict.fromkeys(pages):
        found = blocks(page)
        if not found or not _different(found, kept):
            continue
        own = outline(found)
        whole = own if whole is None else align(whole, own)
        n += 1
        mains += any(b.main for b in found)
    return None if whole is None else Wrapper(n, _clear(whole), 2 * mains > n)


def _clear(items: list) -> list:
    return [(*x[:4], []) if x[0] == "s" else (x[0], _clear(x[1])) if x[0] in "ro" else x for x in items]


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The article's texts, joined by newlines, as the wrapper tells them; empty if there are none.

    Without a wrapper the page is its own. Null is the empty page. Every text of the page is either
    part of the result, whole, or left out; texts are neither cut nor changed but for white space.
    """
    found = blocks(page)
    if not found:
        return ""
    if wrapper is None:
        wrapper = Wrapper(1, _clear(outline(found)), any(b.main for b in found))
    return "\n".join(wrapper.texts(found))


def learn(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sampled: int = SAMPLED) -> DataFrame:
    """(host, wrapper, pages): each host's wrapper, as text, from `sampled` of its pages, those of the smallest hashes.

    Every host has its own sample, whatever the size of the table, taken before pages are shuffled, so a host with
    most of the pages costs no more than another. Null urls and urls without a host have no wrapper, null and
    empty pages are no evidence; repeated rows count once; other columns of pages aren't read; an empty
    table has no wrappers.
    """
    prepare(pages.sparkSession)
    own = pages.select(host_column(url_col).alias("host"), F.col(html_col).alias("html"), F.xxhash64(F.col(id_col).cast("string"), F.col(url_col)).alias("k"))
    own = own.where("host <> '' and html is not null and html <> ''")
    rows = own.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("k"))).where(F.col("n") <= sampled).drop("n")

    def per_host(group: pd.DataFrame) -> pd.DataFrame:
        w = infer(group.sort_values(["k", "html"], kind="stable")["html"].tolist())
        return pd.DataFrame([] if w is None else [(group["host"].iloc[0], w.dump())], columns=["host", "wrapper"])

    found = rows.groupBy("host").applyInPandas(per_host, "host string, wrapper string")
    return checkpointed(found.join(own.groupBy("host").agg(F.count("*").alias("pages")), "host"))


def extract(
    pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", handed_bytes: int = HANDED_BYTES, hot_pages: int = HOT_PAGES
) -> DataFrame:
    """page_id, url, text and n_chars (code points) per row of pages, with wrappers(host, wrapper, pages).

    Null and empty pages give the empty text; a page whose url has no host, or whose host has no wrapper, is its own
    wrapper. Repeated rows are extracted each; other columns are not returned; an empty table gives an empty
    result. The whole page is read, however long. Up to handed_bytes of wrappers go to every worker; more are
    dealt out with the pages, those of a host to a task for each hot_pages. Both ways give the same rows.
    """
    spark = pages.sparkSession
    prepare(spark)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_column(url_col).alias("host"))
    schema = f"page_id {dict(pages.dtypes)[id_col]}, url string, text string, n_chars long"

    def rows(b: pd.DataFrame, of) -> pd.DataFrame:
        texts = [main_text(p if isinstance(p, str) else "", of(h)) for p, h in zip(b["html"], b["host"])]
        return b[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    if (wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= handed_bytes:
        handed = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loaded: dict[str, Wrapper] = {}

            def of(host: str) -> Wrapper | None:
                if host not in loaded and host in handed.value:
                    loaded[host] = Wrapper.load(handed.value[host])
                return loaded.get(host)

            for b in batches:
                yield rows(b, of)

        return own.mapInPandas(run, schema)
    # wrappers travel ahead of their pages, to each task that has pages of the host; of hosts that are dealt
    # to several tasks there are no more than the table has rows by hot_pages
    tasks = F.ceil(F.col("pages") / hot_pages).cast("long")
    hot = wrappers.where(F.col("pages") > hot_pages).select("host", tasks.alias("tasks"))
    h = F.xxhash64("page_id", "url", F.length("html"))
    dealt = own.join(F.broadcast(hot), "host", "left").withColumn("salt", F.when(F.col("host") == "", h).otherwise(F.pmod(h, F.coalesce("tasks", F.lit(1).cast("long")))))
    ahead = wrappers.select("host", "wrapper", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("salt"))
    both = dealt.drop("tasks").withColumn("wrapper", F.lit(None).cast("string")).unionByName(ahead, allowMissingColumns=True)
    both = both.repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("wrapper").isNull())

    def merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str, Wrapper | None] = ("", None)
        for b in batches:
            known = dict([last])
            for host, text in zip(b["host"], b["wrapper"]):
                if isinstance(text, str):
                    last = (host, Wrapper.load(text))
                    known[host] = last[1]
            pages_of = b[b["wrapper"].isna()]
            if len(pages_of):
                yield rows(pages_of, known.get)

    return both.mapInPandas(merge, schema)
