"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags. Each block is described by hashed
features of its tag path (names, classes, ids, roles), hashed words, and a few measures; a bidirectional LSTM in numpy reads
the whole sequence and gives each block the probability that it belongs to the article, so that every decision sees the
entire page. The network is small and is fitted on the driver, always alike, to invented pages whose layout is drawn from
the common vocabulary of page templates.

Defined results: null or empty html, and pages without an article block, give the empty string. Text outside any tag is a
block of its own. Unclosed tags, comments and scripts end with the page. Repeated rows and null ids are extracted as any
others; extra columns are ignored."""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, small

#: Hash space of path and word features, size of their vectors, and of a direction's hidden state.
SLOTS, VECTOR, HIDDEN = 2048, 12, 16
MEASURES = 6
#: Invented pages, passes, pages a step, and step size of the fit.
PAGES, PASSES, BATCH, RATE = 480, 10, 32, 0.02
#: Steps whose input products are held at once.
STEPS = 4096
#: Blocks that are labelled together at most (pages times the longest page), to bound memory.
AT_ONCE = 60_000

# Fixed values of HTML: elements that don't break a block, elements without an end tag, elements whose text isn't page text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg head title iframe object canvas math".split())
RAW = frozenset("script style iframe title textarea".split())
#: An open element that a new one of the same name ends.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())

#: A comment; a tag without < or > inside; or the start of any other tag, whose end Tags finds.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"<>]*"|'[^'<>]*'|[^'"<>])*+)>|<(?=[!?a-zA-Z]|/[a-zA-Z])""", re.S)
_NAMED = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile("[\"'>]")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_WORD = re.compile(r"[^\W_]+|©")


@dataclass
class Block:
    """node: number of the innermost open element in its page's Elements."""

    node: int
    text: str
    linked: int


class Elements:
    """The elements of a page by number: the parent's number and the feature names of each; 0 is the page itself."""

    def __init__(self) -> None:
        self.parent, self.signs = [0], [("t:",)]

    def add(self, parent: int, signs: tuple[str, ...]) -> int:
        self.parent.append(parent)
        self.signs.append(signs)
        return len(self.signs) - 1

    def last(self, node: int, n: int = 3) -> list[str]:
        """The last n feature names of the path to a node."""
        out: list[str] = []
        while node and len(out) < n:
            out = [*self.signs[node][-(n - len(out)) :], *out]
            node = self.parent[node]
        return out


class Ends:
    """Where a tag that holds quotes or other tags ends: at the first > outside its quotes, or else at the first >. Places from
    which no end was found before are remembered, so that all tags of a page together cost no more than its length."""

    def __init__(self, page: str) -> None:
        self.page, self.at = page, [m.start() for m in _SPECIAL.finditer(page)]
        self.twin, self.first, self.dead = [-1] * len(self.at), [-1] * (len(self.at) + 1), bytearray(len(self.at))
        seen: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            c = page[self.at[i]]
            self.first[i] = i if c == ">" else self.first[i + 1]
            if c != ">":
                self.twin[i], seen[c] = seen.get(c, -1), i

    def __call__(self, start: int) -> int | None:
        begun = i = bisect.bisect_left(self.at, start)
        path = []
        while i < len(self.at) and not self.dead[i]:
            if self.page[self.at[i]] == ">":
                return self.at[i]
            path.append(i)
            if self.twin[i] < 0:
                break
            i = self.twin[i] + 1
        for i in path:
            self.dead[i] = 1
        i = self.first[begun]
        return self.at[i] if i >= 0 else None


def _signs(name: str, attributes: str) -> tuple[str, ...]:
    """Feature names of an element."""
    out = ["t:" + name]
    for m in _ATTR.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        out += ["n:" + w.lower() for w in _NAME.findall(value)[:12]]
    return tuple(out)


def blocks(page: str | None) -> tuple[Elements, list[Block]]:
    """The page's elements, and its blocks in order, with decoded character references and single spaces. One pass: the time
    grows with the length of the page, whatever is nested or left open."""
    found, out = Elements(), []
    if not page:
        return found, out
    stack: list[tuple[str, int]] = []
    is_open: Counter[str] = Counter()
    texts: list[str] = []
    linked, at, silent, links, ends = 0, 0, 0, 0, None

    def flush():
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            out.append(Block(stack[-1][1] if stack else 0, text, linked))
        texts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if not silent and raw:
            text = html.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if links:
                linked += len(text)

    def push(name: str, attributes: str):
        stack.append((name, found.add(stack[-1][1] if stack else 0, _signs(name, attributes))))
        is_open[name] += 1

    def pop_to(name: str):
        """Ends the innermost open element of that name, and all inside it."""
        nonlocal silent
        while is_open[name]:
            last, _ = stack.pop()
            is_open[last] -= 1
            silent -= last in SILENT
            if last == name:
                break

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            break
        add(page[at : m.start()])
        at, closing, name, attributes = m.end(), m[1], m[2], m[3]
        if name is None and page[m.start() : at] == "<":
            ends = ends or Ends(page)
            end = ends(at)
            if end is None:  # no tag ends from here on, but comments may
                comment = page.find("<!--", at)
                add(page[m.start() : comment if comment >= 0 else size])
                at = comment if comment >= 0 else size
                continue
            named = _NAMED.match(page, at, end)
            at = end + 1
            if named is None:
                continue
            closing, name, attributes = named[1], named[2], page[named.end() : end]
        name = name.lower() if name else ""
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name == "br":
                texts.append(" ")
            continue
        flush()
        if closing:
            pop_to(name)
            links = 0
            continue
        if name in VOID:
            continue
        if name in SELF_ENDING:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(name)
                    break
                if stack[i][0] not in SELF_ENDING:
                    break
        if name == "body":
            pop_to("head")
        if attributes.endswith("/") and name in SILENT:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}[^<>]*+>", re.I).search(page, at)
            if name == "textarea":
                push(name, attributes)
                add(page[at : close.start() if close else size])
                flush()
                pop_to(name)
            at = close.end() if close else size
            continue
        push(name, attributes)
        silent += name in SILENT
    add(page[at:])
    flush()
    return found, out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SLOTS


@dataclass
class Sheet:
    """A page as numbers. Elements: slots of their features in one list, where each begins, their parents, and the number of
    features on the path. Blocks: their element, slots of the last features of the path, of words, and measures."""

    slots: np.ndarray
    starts: np.ndarray
    parent: list[int]
    depth: np.ndarray
    node: np.ndarray
    last: list[list[int]]
    words: list[list[int]]
    measures: np.ndarray

    def __len__(self) -> int:
        return len(self.node)


def describe(page: tuple[Elements, list[Block]]) -> Sheet:
    elements, found = page
    last, words, measures = [], [], np.zeros((len(found), MEASURES))
    n = len(found)
    slots, starts, depth, lasts = [_slot("none")], [0], [1], {0: [_slot("none")]}
    for i in range(1, len(elements.signs)):
        starts.append(len(slots))
        slots += map(_slot, elements.signs[i])
        depth.append(depth[elements.parent[i]] + len(elements.signs[i]))
    for i, b in enumerate(found):
        if b.node not in lasts:
            lasts[b.node] = [_slot("last " + s) for s in elements.last(b.node)]
        last.append(lasts[b.node])
        own = [w.lower() for w in _WORD.findall(b.text)]
        words.append([_slot("w " + w) for w in dict.fromkeys(own)] or [_slot("w")])
        size = len(b.text)
        measures[i] = (np.log1p(size) / 6, b.linked / size, b.text[-1] in ".!?…\"'»”", np.log1p(len(own)) / 4, (i + 1) / (n + 1), n < 3)
    return Sheet(np.asarray(slots), np.asarray(starts), elements.parent, np.asarray(depth), np.asarray([b.node for b in found], np.int64), last, words, measures)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots in one array, where each list begins, and sizes; no list is empty."""
    sizes = np.array([len(s) for s in lists])
    return np.concatenate([np.asarray(s) for s in lists]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


class Network:
    """Vectors, two LSTM directions and a logistic output; parameters are arrays by name."""

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = parameters

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng, width = np.random.default_rng(seed), 2 * VECTOR + MEASURES
        p = {"path": rng.normal(0, 0.3, (SLOTS, VECTOR)), "word": rng.normal(0, 0.1, (SLOTS, VECTOR))}
        for side in ("f", "b"):
            p["W" + side] = rng.normal(0, width**-0.5, (width, 4 * HIDDEN))
            p["U" + side] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            p["c" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        p["out"], p["bias"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
        return cls(p)

    def inputs(self, pages: list[Sheet]) -> tuple[np.ndarray, np.ndarray, list]:
        """x (time, page, width), mask (time, page), and what the gradient of the vectors needs. The vector of a path is the
        sum over its elements, taken from the parent's, so that nesting costs nothing."""
        longest = max(map(len, pages))
        x, mask = np.zeros((longest, len(pages), 2 * VECTOR + MEASURES)), np.zeros((longest, len(pages)))
        path, word, kept = self.p["path"], self.p["word"], []
        for j, page in enumerate(pages):
            n = len(page)
            mask[:n, j] = 1
            x[:n, j, 2 * VECTOR :] = page.measures
            total = np.add.reduceat(path[page.slots], page.starts, axis=0)
            for i in range(1, len(total)):
                total[i] += total[page.parent[i]]
            flat, starts, sizes = _flat(page.last)
            scale = 1 / np.sqrt(page.depth[page.node] + sizes)
            x[:n, j, :VECTOR] = (total[page.node] + np.add.reduceat(path[flat], starts, axis=0)) * scale[:, None]
            w_flat, w_starts, w_sizes = _flat(page.words)
            x[:n, j, VECTOR : 2 * VECTOR] = np.add.reduceat(word[w_flat], w_starts, axis=0) / np.sqrt(w_sizes)[:, None]
            kept.append((flat, sizes, scale, w_flat, w_sizes))
        return x, mask, kept

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, learning: bool = True) -> tuple[np.ndarray, list]:
        """Hidden states, and the tape that _back reads, kept while learning only."""
        t, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, tape, ahead, held = np.zeros((t, n, HIDDEN)), [], None, None
        for i in range(t) if side == "f" else range(t - 1, -1, -1):
            if i // STEPS != held:  # the inputs' share of the gates, for some steps at a time
                held = i // STEPS
                ahead = x[held * STEPS : (held + 1) * STEPS] @ self.p["W" + side] + self.p["c" + side]
            z = ahead[i % STEPS] + h @ self.p["U" + side]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            g = np.tanh(z[:, 3 * HIDDEN :])
            a, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            m = mask[i][:, None]
            new_c = f * c + a * g
            s = np.tanh(new_c)
            if learning:
                tape.append((i, h, c, a, f, o, g, s))
            c = m * new_c + (1 - m) * c
            h = m * (o * s) + (1 - m) * h
            out[i] = h
        return out, tape

    def _back(self, x, mask, side, tape, d_out, grads) -> np.ndarray:
        dx, dh, dc = np.zeros_like(x), np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
        w, u = self.p["W" + side], self.p["U" + side]
        for i, h, c, a, f, o, g, s in reversed(tape):
            m = mask[i][:, None]
            dh = dh + d_out[i]
            now, dc_now = dh * m, dc * m
            d_cell = dc_now + now * o * (1 - s * s)
            dz = np.hstack([d_cell * g * a * (1 - a), d_cell * c * f * (1 - f), now * s * o * (1 - o), d_cell * a * (1 - g * g)])
            grads["W" + side] += x[i].T @ dz
            grads["U" + side] += h.T @ dz
            grads["c" + side] += dz.sum(0)
            dx[i] = dz @ w.T
            dh = dh * (1 - m) + dz @ u.T
            dc = dc * (1 - m) + d_cell * f
        return dx

    def probabilities(self, pages: list[Sheet]) -> list[np.ndarray]:
        x, mask, _ = self.inputs(pages)
        both = np.concatenate([self._pass(x, mask, side, False)[0] for side in "fb"], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"])))
        return [p[: len(page), j] for j, page in enumerate(pages)]

    def gradient(self, pages: list[Sheet], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask, kept = self.inputs(pages)
        (fh, ft), (bh, bt) = self._pass(x, mask, "f"), self._pass(x, mask, "b")
        both = np.concatenate([fh, bh], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"])))
        y = np.zeros_like(mask)
        for j, own in enumerate(labels):
            y[: len(own), j] = own
        d = (p - y) * mask / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"], grads["bias"] = np.einsum("tn,tnh->h", d, both), np.array([d.sum()])
        d_both = d[:, :, None] * self.p["out"]
        dx = self._back(x, mask, "f", ft, d_both[:, :, :HIDDEN], grads) + self._back(x, mask, "b", bt, d_both[:, :, HIDDEN:], grads)
        for j, (page, (flat, sizes, scale, w_flat, w_sizes)) in enumerate(zip(pages, kept)):
            n = len(page)
            d_path, d_word = dx[:n, j, :VECTOR] * scale[:, None], dx[:n, j, VECTOR : 2 * VECTOR] / np.sqrt(w_sizes)[:, None]
            total = np.zeros((len(page.starts), VECTOR))
            np.add.at(total, page.node, d_path)
            for i in range(len(total) - 1, 0, -1):
                total[page.parent[i]] += total[i]
            np.add.at(grads["path"], page.slots, np.repeat(total, np.diff([*page.starts, len(page.slots)]), axis=0))
            np.add.at(grads["path"], flat, np.repeat(d_path, sizes, axis=0))
            np.add.at(grads["word"], w_flat, np.repeat(d_word, w_sizes, axis=0))
        return grads


# Fixed words of page templates: classes of article containers and of everything else, and phrases that the latter hold.
_ARTICLE = "content post entry article story body text main page blog single prose".split()
_OTHER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination toc links".split(), "header": "header masthead topbar banner logo branding".split(),
    "footer": "footer copyright bottom colophon legal".split(), "aside": "sidebar aside widget related recommended trending popular tags rail".split(),
    "notice": "cookie consent notice alert popup modal gdpr overlay warning".split(), "ad": "ad ads advert advertisement promo sponsor sponsored banner affiliate".split(),
    "form": "form search login signup newsletter subscribe contact".split(), "comments": "comments comment reply replies discussion disqus respond thread".split(), "share": "share social follow".split(),
}
_PHRASES = {
    "nav": "Home|About|Contact|News|Products|Blog|Archive|Next|Previous|Menu", "header": "Welcome|Home|Log in|Search|Skip to content",
    "footer": "© 2024|All rights reserved|Privacy policy|Terms of use|Imprint|Contact us", "aside": "Related posts|Popular|You may also like|Tags|Latest news|Archives",
    "notice": "We use cookies|Accept|This site uses cookies to improve|Your browser is outdated|Dismiss", "ad": "Advertisement|Sponsored|Buy now|Special offer|Shop",
    "form": "Subscribe|Enter your email|Search|Sign up|Log in|Send|Name", "comments": "Comments|Reply|Leave a comment|says|Posted by|Great post", "share": "Share|Tweet|Follow us",
}
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section", "notice": "div", "ad": "div", "share": "div"}
_SYLLABLES = "the an er on re in ti ou le de la en st es ar al or is un che der ung que ción men to ra si".split()


def invented_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page, and the texts of its article blocks."""
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))
    serial = iter(range(10**6))

    def sentence(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(lo, hi)))).capitalize() + (pick([".", ".", ".", ""]) + f" {next(serial)}x")

    good: set[str] = set()

    def other(kind: str) -> str:
        tag = _TAGS[kind] if rng.random() < 0.6 else pick(["div", "section", "div", "ul"])
        named = tag in ("div", "section", "ul") or rng.random() < 0.3
        attribute = f' {pick(["class", "class", "id"])}="{pick(["", "site-", "main-", "page-", "l-"])}{pick(_OTHER[kind])}{pick(["", "", "-box", "-wrap", " clearfix"])}"' if named else ""
        items = []
        for _ in range(int(rng.integers(1, 6))):
            text = (pick(_PHRASES[kind].split("|")) + " " if rng.random() < 0.4 else "") + (sentence(1, 5) if rng.random() < 0.6 else sentence(5, 40))
            if kind in ("nav", "share") or rng.random() < 0.2:
                items.append(f'<li><a href="/x">{text}</a></li>' if rng.random() < 0.7 else f'<a href="#">{text}</a>')
            elif kind == "form":
                items.append(f'<label>{text}</label><input name="q"><button>{pick(["Go", "Send"])} {next(serial)}</button>')
            else:
                items.append(pick(["<p>{}</p>", "<div>{}</div>", "{}", "<p><span>{}</span></p>", "<h3>{}</h3>"]).format(text))
        inner = "".join(items)
        return f"<{tag}{attribute}>{'<ul>' + inner + '</ul>' if kind == 'nav' and rng.random() < 0.7 else inner}</{tag}>"

    def block(lo: int, hi: int) -> str:
        kind = rng.random()
        text = sentence(lo, hi)
        if kind < 0.08:  # an article may say what a menu says, or say one thing over and over
            text = pick(_PHRASES[pick(list(_PHRASES))].split("|")) + " " + (text if kind < 0.04 else f"{next(serial)}x")
        elif kind < 0.11:
            text = (word() + " ") * int(rng.integers(5, 60)) + f"{next(serial)}x"
        good.add(text)
        return text

    def article() -> str:
        parts = [f"<{pick(['h1', 'h1', 'h2'])}>{block(2, 14)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.72:
                text = block(1, 90) if rng.random() < 0.9 else block(1, 4)
                parts.append(f"<p>{text}</p>" if rng.random() < 0.85 else f"<p>{text}<br>")
            elif kind < 0.8:
                parts.append(f"<h2>{block(1, 8)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{block(1, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{block(5, 40)}</blockquote>")
            elif kind < 0.93:
                parts.append(f"<table><tr><td>{block(1, 6)}</td><td>{block(1, 6)}</td></tr></table>")
            elif kind < 0.97:
                parts.append(other(pick(["ad", "share", "aside", "form"])))
            else:
                parts.append(f"<pre>{block(3, 20)}</pre>")
        tag = pick(["article", "article", "main", "div", "div", "section"])
        named = tag in ("div", "section") or rng.random() < 0.2
        attribute = f' {pick(["class", "id"])}="{pick(["", "post-", "entry-", "article-", "main-"])}{pick(_ARTICLE)}"' if named else ""
        return f"<{tag}{attribute}>{''.join(parts)}</{tag}>"

    before = [other(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if rng.random() < 0.4]
    after = [other(k) for k in ("share", "ad", "comments", "aside", "form", "notice", "footer") if rng.random() < 0.4]
    body = "".join([*before, article(), *after])
    if rng.random() < 0.3:
        body = f'<div id="{pick(["wrapper", "page", "container", "app", "root"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{body}</body></html>", good


@lru_cache(1)
def fit(pages: int = PAGES, passes: int = PASSES, seed: int = 5) -> Network:
    """The network fitted by Adam to invented pages; deterministic, and fitted once in a driver."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, good = invented_page(rng)
        found = blocks(page)
        if found[1]:
            data.append((describe(found), np.array([b.text in good for b in found[1]], float)))
    net = Network.fresh()
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(data))
        for i in range(0, len(order), BATCH):
            pick = [data[j] for j in order[i : i + BATCH]]
            grads, step = net.gradient([d for d, _ in pick], [y for _, y in pick]), step + 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.p[k] = net.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def main_texts(net: Network, pages: list[str | None]) -> list[str]:
    """The article text of each page."""
    found = [blocks(p) for p in pages]
    order = sorted((i for i, (_, b) in enumerate(found) if b), key=lambda i: len(found[i][1]))
    out, group = [""] * len(pages), []

    def label():
        for i, p in zip(group, net.probabilities([describe(found[i]) for i in group])):
            out[i] = "\n\n".join(b.text for b, x in zip(found[i][1], p) if x >= 0.5)
        group.clear()

    for i in order:
        if group and (len(group) + 1) * len(found[i][1]) > AT_ONCE or len(group) >= 256:
            label()
        group.append(i)
    if group:
        label()
    return out


def extract(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast((net or fit()).p)  # of fixed size

    def run(batches):
        own = Network(sent.value)
        for b in small(batches):
            texts = main_texts(own, b.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").transform(bounded).mapInArrow(run, "page_id long, url string, text string, n_chars long")
