"""Main text of web pages by wrappers inferred from the pages of each host.

A page becomes a stream of balanced tokens: block elements with their classes and ids, and ``#`` for text. Siblings that
repeat are folded into repeated groups. The distinct streams of a host are aligned one after another with its wrapper, a
regular expression without unions. Alignment goes level by level: elements that both have are aligned in turn; at a
mismatch the nearer of the two continuations decides what the other one lacks, which becomes optional; a group and its
repetition become a repeated group. A wrapper so holds all children of all its streams in order, and each text of a page
falls into one text slot of its host's wrapper. Streams are merged in shares by hash and the shares' wrappers then by
host, for hosts of any size alike.

The wrapper decides what a page's text is. Evidence about each slot is gathered from all pages: on how many distinct
pages it stands, how many distinct texts it has there, how long they are and how much of them is link text. Text that
few variants fill on many distinct pages is template, text that is mostly links is a menu, and the smallest element that
holds two thirds of the other text is the main region. What the page itself says outweighs this: an article element or
class makes its slots article, boilerplate elements and words (menus, adverts, forms, comments ...) take theirs out. A
page's text is that of the best kind of slot that it has, so that a page never loses all of its text. Copies of a page
count once in all evidence; a host with fewer than SEVERAL distinct pages gives none, and all other text stays.

Null html or url is the empty one; an empty page, or one of boilerplate elements only, has the empty text. Repeated rows are
extracted each; extra columns are left out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import kept, texts_of

# HTML's elements by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd tr td th body".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
LISTS = frozenset("ul ol dl table menu".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset label head noscript".split())
BOILERPLATE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie
cookies consent gdpr notice notices alert popup modal overlay comment comments respond replies reply disqus sidebar side aside related recommended recommendations
share sharing social newsletter subscribe subscription signup login breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer header masthead
topbar toolbar widget widgets skip search tags legal copyright hidden""".split())
ARTICLES = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article post entry story content main maincontent articlebody postbody entrycontent postcontent articlecontent".split())

TAG = re.compile(r"""<(?:(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>|(!--)|([!?])|(/?[a-zA-Z]))""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
QUOTE_OR_END = re.compile(r"[>\"']")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Containers that say nothing by themselves; without a class, the elements they hold are part of their token.
GENERIC = frozenset("div section span td th center font".split())
#: Wrappers of a host are merged in so many shares first.
SHARES = 256
#: Distinct values that are told apart exactly, above which their number is estimated; distinct pages that make evidence.
SKETCH, SEVERAL = 8, 3
#: Entries that a task gathers before it sends them.
GATHERED = 20_000
#: Kinds of text; a page's text is that of the first kind that it has: article, main region, other, template, menu, boilerplate by word.
PREFERRED = "amoflw"
HEADING = frozenset({"h1"})
#: Elements of running text, no regions of a page.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address".split())


def name_of(tag: str, attributes: str) -> str:
    """The element with its class, id and role, digits made equal: ``div.ad-0``."""
    if "=" not in attributes:
        return tag
    parts = sorted(f"{k.lower()[0]}={' '.join(sorted((a or b or c).split()))}" for k, a, b, c in ATTRIBUTE.findall(attributes))
    return f"{tag}.{re.sub('[0-9]+', '0', '.'.join(parts))}" if parts else tag


def kind_of(name: str) -> str:
    """``b`` for boilerplate by element, ``w`` by a word alone, ``a`` for an article, ``o`` for other elements.

    An article element, or a class, id or role of article words only (``content``, not ``post-comments``), outweighs
    boilerplate words on the same element (``has-sidebar``).
    """
    tag, _, rest = name.partition(".")
    if tag in BOILERPLATE:
        return "b"
    if tag in ARTICLES:
        return "a"
    if not rest or tag in ("html", "body"):
        return "o"
    found = [set(WORDS.findall(CAMEL.sub(" ", x).lower())) for part in re.split(r"(?:^|\.)[cir]=", rest) for x in part.split()]
    if any(w & ARTICLE_WORDS and not w & BOILERPLATE_WORDS for w in found):
        return "a"
    return "w" if any(w & BOILERPLATE_WORDS for w in found) else "o"


_names: dict[tuple[str, str], str] = {}
_kinds: dict[str, str] = {}


def _known(tag: str, attributes: str) -> str:
    key = (tag, attributes)
    if key not in _names:
        if len(_names) > 50_000:
            _names.clear()
        _names[key] = name_of(tag, attributes)
    return _names[key]


def _kind(name: str) -> str:
    if name not in _kinds:
        if len(_kinds) > 50_000:
            _kinds.clear()
        _kinds[name] = kind_of(name)
    return _kinds[name]


def _end_of_tag(page: str, at: int, gone: dict[str, bool]) -> int:
    """Behind the > that ends a tag with < or > in quotes; a quote that is never closed is an ordinary character."""
    while True:
        m = QUOTE_OR_END.search(page, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.end()
        close = -1 if gone.get(m[0]) else page.find(m[0], m.end())
        if close < 0:
            gone[m[0]] = True
        at = m.end() if close < 0 else close + 1


def events(page: str) -> Iterator[tuple[str, str]]:
    """("<", name), ("/", tag) and ("#", raw text) of a page; elements that end by rule are not ended here."""
    at, start, gone, n = 0, 0, {}, len(page)
    last = page.rfind(">")  # behind it no tag ends
    while m := TAG.search(page, at):
        closing, tag, attributes, comment, other, odd = m.groups()
        end = m.end()
        if odd:
            close = _end_of_tag(page, end, gone) if end <= last else -1
            if close < 0:
                at = m.end()
                continue
            end = close
            inner = page[m.start() + 1 : end - 1]
            closing, inner = ("/", inner[1:]) if inner[0] == "/" else ("", inner)
            tag = re.match(r"[a-zA-Z][a-zA-Z0-9:_-]*|", inner)[0]
            attributes = inner[len(tag) :]
        if m.start() > start:
            yield "#", page[start : m.start()]
        if comment or other:
            close = page.find("-->" if comment else ">", m.end() if not comment else m.end() - 2)
            end = n if close < 0 else close + (3 if comment else 1)
        elif tag:
            tag = tag.lower()
            if not closing and tag in RAW and not attributes.endswith("/"):
                # What stands in it is no page text: nothing but its own end tag ends it.
                close = -1 if gone.get(tag) else _find_end(page, tag, end)
                if close < 0:
                    gone[tag] = True
                    end = n if tag in ("script", "style", "textarea", "title") else end
                else:
                    stop = page.find(">", close)
                    end = n if stop < 0 else stop + 1
                yield "!", tag
            elif closing:
                yield "/", tag
            else:
                yield "<", _known(tag, attributes)
        at = start = end
    if start < n:
        yield "#", page[start:]


_ends: dict[str, re.Pattern] = {}


def _find_end(page: str, tag: str, at: int) -> int:
    if tag not in _ends:
        _ends[tag] = re.compile(f"</{tag}(?![a-z0-9])", re.I)
    m = _ends[tag].search(page, at)
    return m.start() if m else -1


def within(kind: str, key: str) -> str:
    """Kind of what stands in an element ``key`` that stands in ``kind``."""
    own = _kind(key if "." in key else key.partition("(")[0])
    return next(k for k in "bwao" if k in (kind, own))


class Item:
    """A token of a stream or wrapper: text (``#``), an element, or a group of siblings that repeat together.

    ``inner`` is None for text. ``blocks`` are the numbers of a page's texts, or of a wrapper's slot.
    """

    __slots__ = ("key", "inner", "many", "may_lack", "blocks", "_index")

    def __init__(self, key: str, inner: list[Item] | None = None, many: bool = False, may_lack: bool = False, blocks: list[int] | None = None):
        self.key, self.inner, self.many, self.may_lack, self.blocks, self._index = key, inner, many, may_lack, blocks or [], None

    def index(self) -> dict[str, list[int]]:
        """Where each key stands in ``inner``; kept, so only for what does not change any more."""
        if self._index is None:
            self._index = positions([x.key for x in self.inner])
        return self._index


GROUP = "\x1f"


def positions(keys: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        out.setdefault(k, []).append(i)
    return out


def following(index: dict[str, list[int]], key: str, at: int) -> int | None:
    """The first place of a key from ``at`` on."""
    there = index.get(key)
    i = bisect_left(there, at) if there else 0
    return there[i] if there and i < len(there) else None


def element(name: str, level: list[Item]) -> Item:
    """An element with its children folded; a generic one is known by what it holds."""
    if name in GENERIC:
        name = f"{name}({' '.join(sorted({re.split('[.(]', x.key, maxsplit=1)[0] for x in level}))})"
    return Item(name, folded(level))


def merge(a: Item, b: Item) -> None:
    """Generalises ``a`` so that it accepts ``b`` too."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.many, x.may_lack, x._index = x.many or y.many, x.may_lack or y.may_lack, None
        x.blocks += y.blocks
        if x.inner is not None:
            x.inner = aligned(x.inner, y.inner, todo)


def collapsed(items: list[Item], todo: list[tuple[Item, Item]] | None = None) -> list[Item]:
    """Neighbours with one key become one repeated item; what they hold is merged, or put on the list of what is to be."""
    out: list[Item] = []
    for x in items:
        if out and out[-1].key == x.key:
            out[-1].many = True
            if todo is None:
                merge(out[-1], x)
            else:
                todo.append((out[-1], x))
        else:
            out.append(x)
    return out


def folded(level: list[Item]) -> list[Item]:
    """Siblings with runs of one key, and then runs of a unit of several keys, as repeated items; short units first."""
    out = collapsed(level) if len(level) > 1 else level
    size = 2
    while 2 * size <= len(out):
        number: dict[str, int] = {}
        keys = np.array([number.setdefault(x.key, len(number)) for x in out])
        if len(number) == len(out):
            break
        same = np.flatnonzero(np.concatenate([[True], keys[size:] != keys[:-size], [True]]))
        # Between two marks lie the places that equal the one a unit further.
        runs = [(int(i), int(j - i - 1)) for i, j in zip(same, same[1:], strict=False) if j - i - 1 >= size]
        if runs:
            new, at = [], 0
            for start, length in runs:
                if start < at:
                    length, start = length - (at - start), at
                if length < size:
                    continue
                times = length // size + 1
                new += out[at:start]
                units = [out[start + k * size : start + (k + 1) * size] for k in range(times)]
                new.append(group(units[0]))
                for u in units[1:]:
                    merge(new[-1], group(u))
                new[-1].many = True
                at = start + times * size
            out = collapsed(new + out[at:])
        size += 1
    return out


def group(unit: list[Item]) -> Item:
    return Item(f"({GROUP.join(x.key for x in unit)})", unit)


def units_of(items: list[Item]) -> set[tuple[str, ...]]:
    return {tuple(x.key for x in y.inner) for y in items if y.key[0] == "("}


def grouped(items: list[Item], units: set[tuple[str, ...]]) -> list[Item]:
    """The siblings with single occurrences of known units as the groups that they are elsewhere."""
    for unit in sorted(units, key=lambda u: (-len(u), u)):
        keys, out, i = [x.key for x in items], [], 0
        while i < len(items):
            if keys[i] == unit[0] and tuple(keys[i : i + len(unit)]) == unit:
                out.append(group(items[i : i + len(unit)]))
                i += len(unit)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def aligned(a: list[Item], b: list[Item], todo: list[tuple[Item, Item]]) -> list[Item]:
    """One list of siblings that accepts both; pairs that are to be merged in turn are put on the list."""
    left, right = [x.key for x in a], [x.key for x in b]
    if left != right:
        in_a, in_b = units_of(a), units_of(b)
        if in_a or in_b:
            todo_first: list[tuple[Item, Item]] = []
            a, b = (collapsed(grouped(x, other), todo_first) for x, other in ((a, in_b - in_a), (b, in_a - in_b)))
            todo += todo_first
            left, right = [x.key for x in a], [x.key for x in b]
    if left == right:
        todo += zip(a, b, strict=True)
        return a
    in_left, in_right, out, i, j = positions(left), positions(right), [], 0, 0

    def lacks(some: list[Item]) -> None:
        for x in some:
            x.may_lack = True
        out.extend(some)

    while i < len(a) and j < len(b):
        if left[i] == right[j]:
            todo.append((a[i], b[j]))
            out.append(a[i])
            i, j = i + 1, j + 1
            continue
        p, q = following(in_left, right[j], i), following(in_right, left[i], j)
        if p is None and q is None:
            lacks([a[i], b[j]])
            i, j = i + 1, j + 1
        elif q is None or p is not None and p - i <= q - j:
            lacks(a[i:p])
            i = p
        else:
            lacks(b[j:q])
            j = q
    lacks(a[i:] + b[j:])
    return collapsed(out, todo)


def parse(page: str) -> tuple[Item, list[tuple[str, int, str]]]:
    """The folded stream of a page, and its blocks of text (text, characters in links, kind by the elements around it) in order."""
    blocks: list[tuple[str, int, str]] = []
    stack: list[tuple[str, str, str, list[Item]]] = [("", "", "o", [])]  # tag, name, kind, children
    held: list[str] = []
    linked = raw = 0
    in_link = False

    def flush() -> None:
        nonlocal held, linked, raw
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                stack[-1][3].append(Item("#", blocks=[len(blocks)]))
                blocks.append((text, len(text) * linked // max(1, raw), stack[-1][2]))
            held, linked, raw = [], 0, 0

    def close(to: int) -> None:
        while len(stack) > to:
            flush()
            _, name, _, level = stack.pop()
            if level:  # what holds no text is no part of the stream
                stack[-1][3].append(element(name, level))

    for what, value in events(page):
        if what == "#":
            held.append(value)
            raw += len(value)
            linked += len(value) if in_link else 0
        elif what == "<":
            tag = value.partition(".")[0]
            if tag == "br":
                held.append(" ")
                continue
            if tag == "a":
                in_link = True
            if tag in INLINE and (tag == value or _kind(value) not in "bw"):
                continue
            flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in SIBLINGS:
                for i in range(len(stack) - 1, max(0, len(stack) - 6), -1):
                    if stack[i][0] in SIBLINGS[tag] and tag != "p":
                        close(i)
                        if tag == "tr" and stack[-1][0] == "tr":
                            close(len(stack) - 1)
                        break
                    if stack[i][0] in LISTS or stack[i][0] in BOILERPLATE or stack[i][0] in ARTICLES:
                        break
            stack.append((tag, value, within(stack[-1][2], value), []))
        elif what == "/":
            if value == "a":
                in_link = False
            if value in VOID:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == value:
                    close(i)
                    break
        else:
            flush()
    close(1)
    flush()
    return Item("", folded(stack[0][3])), blocks


def texts_in(root: Item) -> list[Item]:
    """The text items of a stream or wrapper in order."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.inner is None:
            out.append(x)
        else:
            todo += x.inner[::-1]
    return out


def written(root: Item) -> str:
    """A stream or wrapper as lines: a digit (1 repeated, 2 optional) with the token, ``/`` where what it holds ends."""
    out: list[str] = []
    todo: list[Item | None] = root.inner[::-1]
    while todo:
        x = todo.pop()
        if x is None:
            out.append("/")
            continue
        out.append(f"{x.many + 2 * x.may_lack}{x.key}")
        if x.inner is not None:
            todo.append(None)
            todo += x.inner[::-1]
    return "\n".join(out)


def read_back(lines: str) -> Item:
    """What ``written`` wrote; text items are numbered in order."""
    stack, slot = [Item("", [])], 0
    for line in lines.split("\n") if lines else ():
        if line == "/":
            stack.pop()
            continue
        flags, key = int(line[0]), line[1:]
        x = Item(key, None if key == "#" else [], bool(flags & 1), bool(flags & 2), [slot] if key == "#" else None)
        stack[-1].inner.append(x)
        if key == "#":
            slot += 1
        else:
            stack.append(x)
    return stack[0]


def infer(streams: Iterable[Item]) -> Item:
    """A wrapper for all streams, aligned in the given order."""
    root = Item("", [])
    for k, s in enumerate(streams):
        if k:
            merge(root, s)
        else:
            root = s
    return root


def pattern(root: Item) -> str:
    """The wrapper as a regular expression over tokens, for people."""
    out = []
    for line in written(root).split("\n"):
        if line == "/":
            out.append("</>")
        elif line:
            mark = ("", "+", "?", "*")[int(line[0])]
            out.append(f"#PCDATA{mark}" if line[1:] == "#" else f"<{' '.join(line[1:].split(GROUP))}>{mark}")
    return " ".join(out)


def placed(wrapper: Item, page: Item) -> dict[int, int]:
    """Slot of the wrapper for each block of a page; blocks at places that the wrapper lacks are left out."""
    out: dict[int, int] = {}
    todo = [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        if p.inner is None:
            out.update((b, w.blocks[0]) for b in p.blocks)
            continue
        index, items = w.index(), p.inner
        if any(x.key not in index for x in items):
            items = grouped(items, units_of(w.inner))
            # A group that the wrapper does not have counts as what it repeats.
            while any(x.key[0] == "(" and x.key not in index for x in items):
                items = [y for x in items for y in (x.inner if x.key[0] == "(" and x.key not in index else [x])]
        at = 0
        for x in items:
            n = following(index, x.key, at)
            if n is None:
                if x.key not in index:
                    continue
                n = index[x.key][-1]
            else:
                at = n
            todo.append((w.inner[n], x))
    return out


def semantic(wrapper: Item) -> list[str]:
    """For each slot what its elements say: ``b`` boilerplate by element, ``w`` by word, ``a`` article, ``o`` nothing."""
    out: list[str] = []
    todo = [(wrapper, "o")]
    while todo:
        x, kind = todo.pop()
        if x.inner is None:
            out.append(kind)
        else:
            inside = within(kind, x.key) if x.key and x.key[0] != "(" else kind
            todo += [(y, inside) for y in x.inner[::-1]]
    return out


class Evidence:
    """About one slot: sketches (smallest hashes) of the distinct pages that hold it and of its distinct texts; sums over pages."""

    __slots__ = ("pages", "texts", "n", "chars", "links")

    def __init__(self, pages: Iterable[int] = (), texts: Iterable[int] = (), n: int = 0, chars: int = 0, links: int = 0):
        self.pages, self.texts, self.n, self.chars, self.links = list(pages), list(texts), n, chars, links

    def add(self, pages: Iterable[int], texts: Iterable[int], n: int, chars: int, links: int) -> None:
        self.pages, self.texts = smallest(self.pages, pages), smallest(self.texts, texts)
        self.n, self.chars, self.links = self.n + n, self.chars + chars, self.links + links

    def is_template(self) -> bool:
        p = distinct(self.pages)
        return p >= SEVERAL and SEVERAL * distinct(self.texts) <= p

    def is_menu(self) -> bool:
        return distinct(self.pages) >= SEVERAL and 2 * self.links > self.chars

    def mass(self) -> float:
        """Characters on distinct pages."""
        return self.chars / self.n * distinct(self.pages) if self.n else 0.0


def smallest(a: list[int], b: Iterable[int]) -> list[int]:
    return sorted({*a, *b})[:SKETCH]


def distinct(sketch: list[int]) -> float:
    """How many distinct hashes a sketch stands for; exact below SKETCH."""
    return len(sketch) if len(sketch) < SKETCH else max(float(SKETCH), (SKETCH - 1) * 2.0**63 / (sketch[-1] + 1))


def decide(wrapper: Item, about: dict[int, Evidence]) -> str:
    """A letter for each slot of a wrapper, of ``b`` and PREFERRED, from what its elements say and what all pages show."""
    kinds, none = semantic(wrapper), Evidence()
    seen = [about.get(i, none) for i in range(len(kinds))]
    pages: list[int] = []
    for e in seen:
        pages = smallest(pages, e.pages)
    if len(pages) < SEVERAL:
        return "".join("m" if k == "o" else k for k in kinds)
    prose = [k == "o" and not e.is_template() and not e.is_menu() for k, e in zip(kinds, seen, strict=True)]
    mass = {id(t): seen[i].mass() if prose[i] else 0.0 for i, t in enumerate(texts_in(wrapper))}
    order, todo = [], [wrapper]
    while todo:
        order.append(todo.pop())
        todo += order[-1].inner or ()
    for x in reversed(order):
        if x.inner is not None:
            mass[id(x)] = sum(mass[id(y)] for y in x.inner)
    tag = lambda x: x.key.partition("(")[0].partition(".")[0]
    region, inside = wrapper, True
    while inside:
        inside = next((y for y in region.inner if y.inner is not None and tag(y) not in RUNNING and 3 * mass[id(y)] >= 2 * mass[id(wrapper)] > 0), None)
        region = inside or region
    of_region = {t.blocks[0] for t in texts_in(region)}
    # Around the main text, what a whole page repeats is template; a region below the page's body is kept with all it holds.
    whole = tag(region) in ("", "html", "body")
    core = [i for i in sorted(of_region) if prose[i]]
    heading = {t.blocks[0] for x in order if tag(x) in HEADING for t in texts_in(x)}
    out = []
    for i, (k, e) in enumerate(zip(kinds, seen, strict=True)):
        if k == "o":
            if i in of_region and (not whole or prose[i] or core and core[0] < i < core[-1]) or prose[i] and i in heading:
                k = "m"
            elif e.is_template():
                k = "f"
            elif e.is_menu():
                k = "l"
        out.append(k)
    return "".join(out)


def main_text(page: Item, blocks: list[tuple[str, int, str]], wrapper: Item | None = None, kinds: str = "") -> str:
    """The text of a page in the best kind of its wrapper's slots that it has; a place that the wrapper lacks is judged by its own elements."""
    slot = placed(wrapper, page) if wrapper is not None else {}
    of = [kinds[slot[i]] if i in slot else own for i, (_, _, own) in enumerate(blocks)]
    wanted = next((k for k in PREFERRED if k in of), None)
    return " ".join(t for k, (t, _, _) in zip(of, blocks, strict=True) if k == wanted)


def host_column(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


OBSERVED = "host string, stream string, pages array<long>, n long, texts array<array<long>>, chars array<long>, links array<long>"
SLOTS = "host string, slot int, wrapper string, pages array<long>, texts array<long>, n long, chars long, links long"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def in_order(df: DataFrame, by: list[str], run: Callable, schema: str, *then) -> DataFrame:
    """``df`` dealt by the columns ``by``, in their order and that of ``then``, streamed through ``run``."""
    return df.repartition(*by).sortWithinPartitions(*by, *then).mapInArrow(run, schema)


def observed(pages: DataFrame) -> DataFrame:
    """A row for each distinct stream of each host, with what its pages show at each of its text items."""

    def add(known: dict, key: tuple[str, str], pages: list[int], n: int, texts: list, chars: list[int], links: list[int]) -> None:
        if key not in known:
            known[key] = [Evidence() for _ in chars]
        for e, t, c, k in zip(known[key], texts, chars, links, strict=True):
            e.add(pages, t, n, c, k)

    def row(key: tuple[str, str], es: list[Evidence]) -> tuple:
        return (*key, es[0].pages, es[0].n, [e.texts for e in es], [e.chars for e in es], [e.links for e in es])

    def watch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], list[Evidence]] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                root, blocks = parse(page)
                if not blocks:
                    continue
                items = texts_in(root)
                own = [[blocks[i] for i in x.blocks] for x in items]
                digest = xxhash.xxh3_64_intdigest("\n".join(t for t, _, _ in blocks)) >> 1
                texts = [[xxhash.xxh3_64_intdigest("\n".join(t for t, _, _ in o)) >> 1] for o in own]
                add(known, (host, written(root)), [digest], 1, texts, [sum(len(t) for t, _, _ in o) for o in own], [sum(k for _, k, _ in o) for o in own])
            if len(known) > GATHERED:
                yield batch([row(k, es) for k, es in known.items()], OBSERVED)
                known.clear()
        yield batch([row(k, es) for k, es in known.items()], OBSERVED)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], list[Evidence]] = {}
        done: list[tuple] = []
        for host, stream, *seen in rows_of(batches):
            if known and (host, stream) not in known:
                done += [row(k, es) for k, es in known.items()]
                known.clear()
                if len(done) >= 1_000:
                    yield batch(done, OBSERVED)
                    done = []
            add(known, (host, stream), *seen)
        yield batch(done + [row(k, es) for k, es in known.items()], OBSERVED)

    found = pages.select(host_column().alias("host"), "html").mapInArrow(watch, OBSERVED)
    return in_order(found, ["host", "stream"], gather, OBSERVED)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, kinds) of every host that has text: its wrapper by lines and a letter for each of its slots."""
    seen = kept(observed(pages), "streams")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, root = None, None
        for *now, stream in rows_of(batches):
            if now != key:
                if key is not None:
                    yield batch([(*key, written(root))], "host string, share int, stream string")
                key, root = now, read_back(stream)
                clear(root)
            else:
                other = read_back(stream)
                clear(other)
                merge(root, other)
        if key is not None:
            yield batch([(*key, written(root))], "host string, share int, stream string")

    def clear(root: Item) -> None:
        """Slots are numbered in the finished wrapper only."""
        for t in texts_in(root):
            t.blocks = []

    shares = seen.select("host", F.pmod(F.xxhash64("stream"), F.lit(SHARES)).cast("int").alias("share"), "stream")
    for _ in range(2):
        shares = in_order(shares, ["host", "share"], join, "host string, share int, stream string", F.length("stream"), "stream").withColumn("share", F.lit(0))
    whole = kept(shares.select("host", F.col("stream").alias("wrapper")), "wrappers")

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about: dict[tuple[str, int], Evidence] = {}
        root_of: dict[str, Item] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, s, None, e.pages, e.texts, e.n, e.chars, e.links) for (h, s), e in about.items()]
            about.clear()
            return batch(rows, SLOTS)

        for host, stream, pages_, n, texts, chars, links, wrapper in rows_of(batches):
            if wrapper not in root_of:
                if len(root_of) > 200:
                    root_of.clear()
                root_of[wrapper] = read_back(wrapper)
            for i, s in placed(root_of[wrapper], read_back(stream)).items():
                about.setdefault((host, s), Evidence()).add(pages_, texts[i], n, chars[i], links[i])
            if len(about) > GATHERED:
                yield out()
        yield out()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, wrapper, about = None, "", {}
        for h, slot, w, *seen_ in rows_of(batches):
            if h != host:
                if host is not None:
                    yield batch([(host, wrapper, decide(read_back(wrapper), about))], "host string, wrapper string, kinds string")
                host, wrapper, about = h, "", {}
            if slot < 0:
                wrapper = w
            else:
                p, t, n, c, k = seen_
                about.setdefault(slot, Evidence()).add(p, t, n, c, k)
        if host is not None:
            yield batch([(host, wrapper, decide(read_back(wrapper), about))], "host string, wrapper string, kinds string")

    slots = seen.join(whole, "host").select(*seen.columns, "wrapper").mapInArrow(match, SLOTS)
    none = lambda t: F.lit(None).cast(t)
    lines = whole.select("host", F.lit(-1).alias("slot"), "wrapper", none("array<long>").alias("pages"), none("array<long>").alias("texts"), *(F.lit(0).cast("long").alias(c) for c in ("n", "chars", "links")))
    return in_order(slots.unionByName(lines), ["host"], judge, "host string, wrapper string, kinds string", "slot")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    # Written, so that its size is known: few hosts are broadcast, many are joined by host.
    known = kept(wrappers(pages), "slots")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root_of: dict[str, Item] = {}
        for b in batches:
            out = []
            for page, wrapper, kinds in zip(texts_of(b.column(2)), b.column(3).to_pylist(), texts_of(b.column(4)), strict=True):
                if wrapper is not None and wrapper not in root_of:
                    if len(root_of) > 200:
                        root_of.clear()
                    root_of[wrapper] = read_back(wrapper)
                out.append(main_text(*parse(page), root_of.get(wrapper), kinds))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select("page_id", "url", "html", host_column().alias("host"))
    return own.join(known, "host", "left").select("page_id", "url", "html", "wrapper", "kinds").mapInArrow(run, "page_id long, url string, text string, n_chars long")
