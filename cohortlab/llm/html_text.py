"""Operator 2: main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements. Boosted trees score each node from the density of
its subtree, its attribute tokens, its depth and its siblings. Decoding then labels the whole
tree at once: a node is content with all below it, boilerplate with all below it, or mixed, and
the labelling of the highest likelihood is taken, so no node contradicts an ancestor.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# a tag whose attributes hold no "<"; what this leaves over is read by Tags
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|[^<]+|<", re.S)
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Text up to the end tag, or to the end of the page; and elements that go with all they hold.
RAW = frozenset("script style textarea title noframes".split())
UNREAD = frozenset("noscript template iframe svg object select button".split())
DROP = RAW | UNREAD | {"head"}
IN_HEAD = RAW | frozenset("html base basefont bgsound link meta noscript template".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_UNREAD = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noframes)\b(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>.*?(?:</\1\s*>|\Z)|<(/?)(noscript|template|iframe|svg|object|select|button)(?![A-Za-z0-9:-])((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>", re.S | re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"'=]+\Z")
P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# What ends an element of UNREAD that has no end tag.
BREAKS = P_ENDS | set(CLOSES) - {"option"} | {"body"}
# Attribute tokens that speak for content and for boilerplate.
GOOD = frozenset("article body content entry main post story text prose maincontent".split())
BAD = frozenset("ad ads advert advertisement aside banner breadcrumb breadcrumbs comment comments consent cookie discussion footer form header login masthead menu nav navbar navigation newsletter notice pagination popup promo related reply respond share sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
TAGS = ("article", "main", "section", "div", "p", "h", "ul", "li", "nav", "header", "footer", "aside", "form", "table", "blockquote")
FEATURES = ("text", "own", "link", "tags", "blocks", "mean", "depth", "start", "share", "index", "siblings", "sib_text", "sib_link", "good", "bad", "up_good", "up_bad", "punct", "upper", *TAGS)


def _alone(name: str, attributes: str) -> bool:
    """Whether '/>' ends the element (not for a value without quotes that ends with the slash)."""
    return name in ("svg", "object", "iframe") and attributes.endswith("/") and not _UNQUOTED.search(attributes)


def _ends(source: str) -> dict[int, int]:
    """Where the elements of UNREAD end, by the end of their start tags; those without an end tag are left out."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _UNREAD.finditer(source):
        name = (m.group(3) or "").lower()
        if not name:
            continue
        at = opened.setdefault(name, [])
        if m.group(2):
            if at:
                out[at.pop()] = m.end()
        elif not _alone(name, m.group(4)):
            if name in ("select", "button"):  # these hold none of their own kind
                at.clear()
            at.append(m.end())
    return out


class Tags:
    """The ends of tags whose attributes hold a "<". Each is read once: a quote that doesn't close
    is an ordinary character, and after a tag without an end quotes no longer count."""

    def __init__(self, source: str):
        self.source = source
        self.last = {c: source.rfind(c) for c in ">\"'"}
        self.quotes = True

    def at(self, start: int) -> tuple[str, str, str, int] | None:
        """(slash, name, attributes, end) of the tag at a "<", if it is one."""
        m = _NAME.match(self.source, start)
        if not m or m.end() > self.last[">"]:
            return None
        end = self._end(m.end())
        return m.group(1), m.group(2), self.source[m.end() : end - 1], end

    def _end(self, at: int) -> int:
        first = self.source.index(">", at) + 1
        while self.quotes:
            m = _STOP.search(self.source, at)
            if not m:
                self.quotes = False
                break
            if m.group() == ">":
                return m.end()
            at = m.end()
            if at <= self.last[m.group()]:
                at = self.source.index(m.group(), at) + 1
        return first


class Stack:
    """The open elements, with where those of each name are, so that no step walks over them all."""

    def __init__(self):
        self.held: list[tuple[str, int]] = [("#root", 0)]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, node: int) -> int:
        at = len(self.held)
        self.held.append((name, node))
        self.where.setdefault(name, []).append(at)
        if name in P_ENDS:
            self.blocks.append(at)
        return at

    def last(self, *names: str) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def drop(self, at: int) -> list[str]:
        """Closes what is open from a place on."""
        gone = [n for n, _ in self.held[at:]]
        for n in reversed(gone):
            self.where[n].pop()
            if n in P_ENDS:
                self.blocks.pop()
        del self.held[at:]
        return gone

    def close(self, names: set[str], bound: set[str]) -> None:
        """Closes the last of names, unless something of bound (for p: another block) is open in it."""
        at = self.last(*names)
        if at and self.last(*bound) < at and (names != {"p"} or self.blocks[-1] == at):
            self.drop(at)

    @property
    def node(self) -> int:
        return self.held[-1][1]

    @property
    def links(self) -> int:
        return len(self.where.get("a", ()))


class Page:
    """The block elements of a page and the runs of text in them, read in time in proportion to its length.

    A head without an end tag ends at what may not stand in it. An element of UNREAD without an
    end tag ends with its parent or at the next block; only RAW ones reach to the end of the page.
    """

    __slots__ = ("parent", "tag", "good", "bad", "runs", "child_tags")

    def __init__(self, source: str):
        self.parent, self.tag, self.good, self.bad, self.child_tags = [-1], ["#root"], [0], [0], [0]
        self.runs: list[list] = []  # [node, pieces, link characters]
        stack, tags = Stack(), None
        fresh, pos = True, 0
        head = unread = 0  # where in the stack the open head and the element of UNREAD are
        ends: dict[int, int] | None = None
        for m in _TOKEN.finditer(source):
            if m.start() < pos:
                continue
            slash, name, attributes, end = m.group(1), m.group(2), m.group(3), m.end()
            if name is None:
                piece = m.group()
                found = None
                if piece == "<":
                    tags = tags or Tags(source)
                    found = tags.at(m.start())
                if found:
                    slash, name, attributes, end = found
                    pos = end
                else:
                    if piece[0] == "<" and len(piece) > 1 or unread:  # a comment or declaration
                        continue
                    if head and not piece.isspace():
                        stack.drop(head)
                        head, fresh = 0, True
                    if fresh:
                        self.runs.append([stack.node, [], 0])
                        fresh = False
                    self.runs[-1][1].append(piece)
                    if stack.links:
                        self.runs[-1][2] += len(piece)
                    continue
            name = name.lower()
            if slash:
                at = stack.last(name)
                if at:
                    gone = stack.drop(at)
                    if not unread or at < unread:
                        fresh = fresh or any(n not in INLINE for n in gone[: unread - at if unread else None])
                    head, unread = (x if x < len(stack.held) else 0 for x in (head, unread))
                elif name not in INLINE and not unread:
                    fresh = True
                continue
            if unread and name in BREAKS:
                stack.drop(unread)
                unread = 0
            if head and not unread and name not in IN_HEAD:
                stack.drop(head)
                head, fresh = 0, True
            node = stack.node
            if name in UNREAD:
                if ends is None:
                    ends = _ends(source)
                after = ends.get(end, 0)
                pos = max(pos, after)
                if not unread and name not in ("svg", "button", "select"):
                    fresh = True
                if not after and not _alone(name, attributes):
                    at = stack.push(name, node)
                    unread = unread or at
                continue
            if unread and attributes.endswith("/"):
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, end)
                pos = close.end() if close else len(source)
                fresh = fresh or not unread
                continue
            if unread:
                if name not in VOID:
                    stack.push(name, node)
                continue
            if name in VOID:
                self.child_tags[node] += 1
                if name == "br" and not fresh:
                    self.runs[-1][1].append(" ")
                elif name not in INLINE:
                    fresh = True
                continue
            if name in P_ENDS:
                stack.close({"p"}, {"table", "td", "button"})
            if name in CLOSES and name != "p":
                stack.close(CLOSES[name], BOUND.get(name, set()))
            node = stack.node
            self.child_tags[node] += 1
            if name in INLINE:
                stack.push(name, node)
                continue
            good = bad = 0
            for a in _ATTR.finditer(attributes):
                words = set(_SPLIT.split((a.group(2) or a.group(3) or a.group(4) or "").lower()))
                good += len(words & GOOD)
                bad += len(words & BAD)
            self.parent.append(node)
            self.tag.append("h" if len(name) == 2 and name[0] == "h" and name[1].isdigit() else name)
            self.good.append(good)
            self.bad.append(bad)
            self.child_tags.append(0)
            fresh = True
            if not attributes.endswith("/"):
                at = stack.push(name, len(self.parent) - 1)
                if name == "head":
                    head = at
        dropped = {i for i, t in enumerate(self.tag) if t in DROP}
        for i in range(1, len(self.parent)):
            if self.parent[i] in dropped:
                dropped.add(i)
        done = []
        for node, pieces, linked in self.runs:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and node not in dropped:
                done.append((node, text, min(linked, len(text))))
        self.runs = done

    def features(self) -> np.ndarray:
        """A row of FEATURES for each node."""
        n = len(self.parent)
        own, linked, blocks, punct, upper = (np.zeros(n) for _ in range(5))
        first = np.full(n, np.inf)
        done = 0
        for node, text, link in self.runs:
            own[node] += len(text)
            linked[node] += link
            blocks[node] += 1
            punct[node] += sum(map(text.count, ".,;!?"))
            upper[node] += text[:1].isupper()
            first[node] = min(first[node], done)
            done += len(text)
        text, tags = own.copy(), np.array(self.child_tags, float)
        depth = np.zeros(n)
        up_good, up_bad = np.zeros(n), np.zeros(n)
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            up_good[i], up_bad[i] = up_good[p] + (self.good[p] > 0 or self.tag[p] in ("article", "main")), up_bad[p] + (self.bad[p] > 0 or self.tag[p] in ("nav", "header", "footer", "aside", "form"))
            kids[p].append(i)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for a in (text, linked, blocks, tags, punct, upper):
                a[p] += a[i]
            first[p] = min(first[p], first[i])
        out = np.zeros((n, len(FEATURES)))
        total = max(1.0, text[0])
        index, siblings, sib_text, sib_link = (np.zeros(n) for _ in range(4))
        for group in kids:
            k = len(group)
            if k:
                t, li = text[group], linked[group]
                index[group], siblings[group] = np.arange(k) / k, k
                sib_text[group] = np.log1p((t.sum() - t) / max(1, k - 1))
                sib_link[group] = (li.sum() - li) / np.maximum(1, t.sum() - t)
        safe = np.maximum(1, text)
        columns = (np.log1p(text), np.log1p(own), linked / safe, tags / safe, np.log1p(blocks), np.log1p(text / np.maximum(1, blocks)), depth, np.where(np.isinf(first), 1, first / total), text / total, index, siblings, sib_text, sib_link, self.good, self.bad, up_good, up_bad, punct / safe, upper / np.maximum(1, blocks))
        for j, c in enumerate(columns):
            out[:, j] = c
        for j, t in enumerate(TAGS):
            out[:, len(columns) + j] = [x == t for x in self.tag]
        return out

    def decode(self, p: np.ndarray, mixed: float = math.log(0.05)) -> str:
        """The text of the content under the likeliest consistent labelling."""
        p = np.clip(p, 1e-4, 1 - 1e-4)
        n = len(self.parent)
        own, below = np.zeros(n), np.zeros(n)
        for node, text, _ in self.runs:
            own[node] = 1
        # a whole page is mixed as a rule, so that costs nothing
        cost = np.array([0.0 if t in ("#root", "html", "body") else mixed for t in self.tag])
        content, boiler, free = np.log(p), np.log(1 - p), np.where(own > 0, np.maximum(np.log(p), np.log(1 - p)), 0) + cost
        content, boiler, free = content.tolist(), boiler.tolist(), free.tolist()
        has = own.copy()
        for i in range(n - 1, 0, -1):
            has[self.parent[i]] += has[i]
        best = [0.0] * n
        for i in range(n - 1, -1, -1):
            if has[i]:
                best[i] = max(content[i], boiler[i], free[i])
            if i and has[i]:
                q = self.parent[i]
                content[q] += content[i]
                boiler[q] += boiler[i]
                free[q] += best[i]
        label = [0] * n  # 1 content, -1 boilerplate, 0 mixed
        for i in range(n):
            up = label[self.parent[i]] if i else 0
            label[i] = up or (0 if free[i] >= max(content[i], boiler[i]) else 1 if content[i] >= boiler[i] else -1)
        return "\n".join(text for node, text, _ in self.runs if label[node] == 1 or label[node] == 0 and p[node] >= 0.5)


class BoostedTrees:
    """Logistic boosting of shallow trees over binned features."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [distinct_edges(x[:, j], self.bins) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)])
        self.bias = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        score, self.forest = np.full(len(y), self.bias), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-6
            leaf = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            for level in range(self.depth):
                width = 2**level
                gain, pick = np.zeros(width), np.zeros((width, 2), np.int64)
                for j, b in enumerate(binned):
                    key = leaf * self.bins + b
                    gs, hs = (np.bincount(key, v, width * self.bins).reshape(width, -1).cumsum(axis=1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    ok = (hs >= self.least) & (ht - hs >= self.least)
                    value = np.where(ok, gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1), 0)
                    at = value.argmax(axis=1)
                    v = value[np.arange(width), at]
                    better = v > gain + 1e-9
                    gain[better], pick[better] = v[better], np.stack([np.full(width, j), at], 1)[better]
                base = width - 1
                for k in range(width):
                    if gain[k] > 0:
                        feature[base + k], cut[base + k] = pick[k]
                leaf = leaf * 2 + (binned[feature[base + leaf], np.arange(len(y))] > cut[base + leaf])
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            value = self.rate * gs / (hs + 1)
            self.forest.append((feature, cut, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)]) if len(x) else np.zeros((x.shape[1], 0), np.int64)
        rows, score = np.arange(len(x)), np.full(len(x), self.bias)
        for feature, cut, value in self.forest:
            leaf = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                base = 2**level - 1
                leaf = leaf * 2 + (binned[feature[base + leaf], rows] > cut[base + leaf])
            score += value[leaf]
        return 1 / (1 + np.exp(-score))


def distinct_edges(x: np.ndarray, bins: int) -> np.ndarray:
    e = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return e[:-1] if len(e) > 1 and e[-1] >= x.max() else e


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A made-up page and the marks of its content blocks; every block starts with its mark."""
    marks: set[str] = set()
    count = 0

    def say(lo: int, hi: int, content: bool) -> str:
        nonlocal count
        count += 1
        mark = f"Q{count}Q"
        if content:
            marks.add(mark)
        ws = ["".join(rng.choice("aeiounrstlhdm") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randint(lo, hi))]
        return mark + " " + " ".join(ws)

    def attr(names: list[str], odd: float = 0.35) -> str:
        name = rng.choice(["c" + str(rng.randint(1, 99)), "box", "wrap", "row"]) if rng.random() < odd else rng.choice(names)
        return f' {rng.choice(["class", "id"])}="{name}{rng.choice(["", "-inner", " clear", "-1"])}"' if rng.random() < 0.85 else ""

    def links(n: int, words: int = 2) -> str:
        items = [f'<li><a href="/{i}">{say(1, words, False)}</a></li>' for i in range(n)]
        return f"<ul>{''.join(items)}</ul>" if rng.random() < 0.7 else "".join(f'<a href="/{i}">{say(1, words, False)}</a> ' for i in range(n))

    def nav() -> str:
        t = rng.choice(["nav", "div", "header"])
        return f"<{t}{attr(['nav', 'menu', 'navbar', 'site-header'], 0.2 if t == 'div' else 0.5)}>{links(rng.randint(2, 9))}</{t}>"

    def head() -> str:
        t = rng.choice(["header", "div"])
        return f"<{t}{attr(['header', 'masthead', 'banner'], 0.1 if t == 'div' else 0.5)}>{say(1, 6, False)}</{t}>"

    def foot() -> str:
        t = rng.choice(["footer", "footer", "div"])
        return f"<{t}{attr(['footer', 'site-footer'], 0.1 if t == 'div' else 0.6)}>&copy; {say(2, 25, False)}</{t}>"

    def aside() -> str:
        t = rng.choice(["aside", "div", "section"])
        return f"<{t}{attr(['sidebar', 'widget', 'related', 'social share'], 0.4 if t == 'aside' else 0.05)}><h3>{say(1, 4, False)}</h3>{links(rng.randint(1, 6), 6) if rng.random() < 0.6 else '<p>' + say(5, 30, False) + '</p>'}</{t}>"

    def advert() -> str:
        return f"<div{attr(['ad', 'ads', 'advert', 'sponsored', 'promo'], 0)}>{say(2, 30, False)}</div>"

    def notice() -> str:
        return f"<div{attr(['cookie-notice', 'notice', 'consent', 'newsletter', 'popup'], 0)}><p>{say(4, 30, False)}</p></div>"

    def form() -> str:
        return f"<form{attr(['search', 'signup', 'login'], 0.5)}><label>{say(1, 3, False)}</label><input name=q><p>{say(1, 9, False)}</p></form>"

    def comments() -> str:
        t = rng.choice(["div", "section"])
        each = "".join(f"<{'div' if rng.random() < 0.5 else 'p'}{attr(['comment', 'reply'], 0.3)}>{say(3, 40, False)}" for _ in range(rng.randint(1, 6)))
        return f"<{t}{attr(['comments', 'discussion', 'comment-list'], 0)}><h3>{say(1, 3, False)}</h3>{each}</{t}>"

    def body() -> str:
        out = []
        if rng.random() < 0.85:
            title = f"<h1>{say(1, 12, True)}</h1>"
            out.append(f"<header>{title}</header>" if rng.random() < 0.12 else title)
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            r = rng.random()
            long = lambda: say(1, 4, True) if rng.random() < 0.15 else say(8, 120, True)
            if r < 0.78:
                out.append(f"<p>{'<b>' if rng.random() < 0.1 else ''}{long()}{'</p>' if rng.random() < 0.9 else ''}")
            elif r < 0.86:
                out.append(f"<h2>{say(1, 8, True)}</h2>")
            elif r < 0.92:
                out.append("<ul>" + "".join(f"<li>{say(2, 25, True)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
            elif r < 0.96:
                out.append(f"<blockquote><p>{long()}</p></blockquote>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{say(1, 4, True)}</td><td>{say(1, 6, True)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            if rng.random() < 0.04:
                out.append(rng.choice([advert, aside, notice])())
        return "".join(out)

    t, names = rng.choice([("article", ["post", "story", "entry"]), ("article", ["post"]), ("main", ["main"]), ("div", ["content", "article-body", "post-content", "entry", "main"]), ("section", ["content", "story"])])
    if rng.random() < 0.1:  # laid out by a table, without a name
        cells = [f"<td>{body()}</td>"]
        cells.insert(rng.randint(0, 1), f"<td>{links(rng.randint(2, 9))}</td>")
        rows = [f"<tr><td>{links(rng.randint(2, 6))}</td></tr>", f"<tr>{''.join(cells)}</tr>", f"<tr><td>{say(2, 12, False)}</td></tr>"]
        return f"<html><head><title>{say(1, 6, False)}</title></head><body><table>{''.join(rows)}</table></body></html>", marks
    kind = rng.random()
    if kind < 0.1:  # straight in the body
        inner = body()
    else:
        inner = f"<{t}{attr(names, 0.7 if t in ('article', 'main') else 0.3)}>{body()}{comments() if rng.random() < 0.15 else ''}</{t}>"
    if kind > 0.9:
        inner = f"<div{attr([], 1)}>{inner}</div>"
    if rng.random() < 0.4:
        inner = f"<div{attr(['container', 'layout', 'page'], 0.4)}>{inner}{aside() if rng.random() < 0.5 else ''}</div>"
    before = [f() for f in (nav, head, notice, advert, form) if rng.random() < 0.5]
    after = [f() for f in (aside, comments, advert, form, notice, foot, foot) if rng.random() < 0.4]
    rng.shuffle(before)
    return f"<html><head><title>{say(1, 6, False)}</title><style>p{{}}</style></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>", marks


@functools.lru_cache(maxsize=4)
def trained(pages: int = 1000, seed: int = 7) -> BoostedTrees:
    """The model, fitted on `pages` made-up pages: a bounded sample that doesn't depend on the data."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source, marks = training_page(rng)
        page = Page(source)
        n = len(page.parent)
        good, all_ = np.zeros(n), np.zeros(n)
        for node, text, _ in page.runs:
            all_[node] += 1
            good[node] += any(w in marks for w in re.findall(r"Q\d+Q", text))
        for i in range(n - 1, 0, -1):
            all_[page.parent[i]] += all_[i]
            good[page.parent[i]] += good[i]
        pure = (all_ > 0) & ((good == 0) | (good == all_))
        xs.append(page.features()[pure])
        ys.append((good[pure] > 0).astype(float))
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract_text(sources: list[str], model: BoostedTrees) -> list[str]:
    pages = [Page(s) for s in sources]
    rows = [p.features() for p in pages]
    if not rows:
        return []
    score = model.predict(np.concatenate(rows))
    ends = np.cumsum([len(r) for r in rows])
    return [page.decode(score[e - len(r) : e]) for page, r, e in zip(pages, rows, ends)]


def main_text(pages: DataFrame, training_pages: int = 1000, seed: int = 7) -> DataFrame:
    """Adds text and n_chars (code points) to each row of pages.

    Null and empty html give an empty text; pages of any length and nesting are read in time in
    proportion to their length. Blocks stand in page order, joined by line breaks;
    nothing else is dropped. Every row is treated on its own, so ties and repeated rows get equal texts; an
    empty table gives an empty result. Input columns named text or n_chars are replaced, all others stay.
    """
    model = trained(training_pages, seed)
    src = pages.drop("text", "n_chars")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sources = [x if isinstance(x, str) else "" for x in pdf["html"]]
            out = [t for i in range(0, len(sources), 256) for t in extract_text(sources[i : i + 256], model)]
            yield pdf.assign(text=pd.Series(out, dtype=object, index=pdf.index))

    schema = T.StructType([*src.schema.fields, T.StructField("text", T.StringType())])
    return src.mapInPandas(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
