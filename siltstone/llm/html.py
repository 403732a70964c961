"""HTML extraction: a bidirectional LSTM labels every block of a page as main text or not.

A page becomes its sequence of leaf blocks: the text between block-level tags, with the path of open tags (names,
class and id words). Each block is a vector of hashed path words, hashed text words and a few shares; the network reads
the whole sequence in both directions, so a block is judged by the document around it. It is trained in numpy on
invented pages of many layouts and on a bounded sample of the input, labelled by its own semantic tags.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, SHARES, HIDDEN = 96, 24, 8, 20
INPUT = PATH_DIM + WORD_DIM + SHARES
#: Invented pages and sampled pages (in the order of a hash of the id) that training reads; a page counts as runs of so
#: many blocks, and so many runs are learned from.
INVENTED, SAMPLED, RUN, RUNS = 700, 150, 256, 200
#: Blocks and pages that are labelled at a time; a longer page is read by itself, in slices that hand on their state.
BATCH_BLOCKS, BATCH_PAGES = 8192, 64
#: Open elements that a path holds; deeper ones keep their text, with the path that far. Browsers have such a bound too.
DEPTH = 128

#: Fixed values of the HTML standard: elements that start a block, have no content, or hold no text for readers.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template textarea svg iframe".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def tokens(html: str):
    """(text, closing, name, attributes) of the page's parts: texts have no name, tags no text.

    Comments, declarations and raw elements give nothing. A tag ends at the first ``>`` outside of quotes or, where a
    quote stays open, at the first one at all. Linear in the page's length: what a scan has found to lead nowhere is
    remembered by ``dead``, the places of quotes from which no end can be reached.
    """
    at, size, last, dead = 0, len(html), html.rfind(">"), set()

    def end(i: int) -> int:
        """Behind the ``>`` of the tag whose attributes begin at i; i is not beyond the last one."""
        first, path = i, []
        while True:
            m = _STOP.search(html, i)
            if m is None or m.start() in dead:
                break
            if m[0] == ">":
                return m.end()
            path.append(m.start())
            close = html.find(m[0], m.end())
            if close < 0:
                break
            i = close + 1
        dead.update(path)
        return html.find(">", first) + 1

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield html[at:lt], "", None, ""
        if lt == size:
            return
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            at = size if close < 0 else close + 3
            continue
        head = html[lt + 1 : lt + 2]
        closing = "/" if head == "/" else ""
        name = _NAME.match(html, lt + 1 + len(closing))
        if lt > last or not (name or head in ("!", "?", "/")) or head == "":
            yield "<", "", None, ""
            at = lt + 1
            continue
        if not name:
            at = html.find(">", lt) + 1
            continue
        at = end(name.end())
        attrs, word = html[name.end() : at - 1], name[0].lower()
        if word in RAW_TAGS and not closing:
            if word != "svg" or not attrs.endswith("/"):
                close = _RAW_END[word].search(html, at)
                at = close.end() if close else size
            continue
        yield "", closing, word, attrs


_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW_TAGS}


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path words, text, characters inside links) of each leaf block, in page order; head and raw elements have none."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    beyond: Counter[str] = Counter()
    path: tuple[str, ...] | None = ()
    text: list[str] = []
    linked = 0
    links = heads = 0

    def flush():
        nonlocal linked
        if text:
            if not heads and (said := " ".join("".join(text).split())):
                out.append((path, said, min(linked, len(said))))
            text.clear()
        linked = 0

    def drop(to: int):
        nonlocal links, heads
        for name, _ in stack[to:]:
            links -= name == "a"
            heads -= name in ("head", "title")
        del stack[to:]

    for piece, closing, name, attrs in tokens(html or ""):
        if name is None:
            if not text and path is None:
                path = tuple(w for n, marks in stack if n in BLOCK_TAGS or marks for w in (n, *(f".{x}" for x in marks)))
            if "&" in piece:
                piece = unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece.strip())
            continue
        if name in BLOCK_TAGS:
            flush()
        elif name == "br":
            text.append(" ")
        if closing:
            if beyond[name]:
                beyond[name] -= 1
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    drop(i)
                    break
        elif name not in VOID_TAGS and not attrs.endswith("/"):
            if name in BLOCK_TAGS:
                closes = _CLOSES.get(name, ())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] in closes:
                        drop(i)
                        break
                    if stack[i][0] in BLOCK_TAGS:
                        break
                if name == "body":
                    for i, (open_, _) in enumerate(stack):
                        if open_ == "head":
                            drop(i)
                            break
            marks = tuple(dict.fromkeys(w.lower() for a in _MARK.findall(attrs) for w in _PART.findall("".join(a)))) if attrs else ()
            if name not in BLOCK_TAGS and name != "a" and not marks:
                continue  # it says nothing about its text
            if len(stack) >= DEPTH:
                beyond[name] += 1
                continue
            stack.append((name, marks))
            links += name == "a"
            heads += name in ("head", "title")
        else:
            continue
        if not text:
            path = None
    flush()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}
_words: dict[str, int] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    found = _paths.get(path)
    if found is None:
        found = np.zeros(PATH_DIM, np.float32)
        for w in set(path):
            found[zlib.crc32(w.encode()) % PATH_DIM] += 1.0
        for w in path[-2:]:
            found[zlib.crc32(f"last {w}".encode()) % PATH_DIM] += 0.5
        if len(_paths) < 50_000:
            _paths[path] = found
    return found


def vectors(page: list[tuple[tuple[str, ...], str, int]], at: int = 0, size: int | None = None) -> np.ndarray:
    """A vector a block; ``page`` may be a slice, from block ``at`` on, of a page of ``size`` blocks."""
    size = size or len(page)
    out = np.zeros((len(page), INPUT), np.float32)
    for i, (path, text, linked) in enumerate(page):
        out[i, :PATH_DIM] = _path_vector(path)
        words = text.split(" ")
        slots = []
        for w in words:
            k = _words.get(w)
            if k is None:
                k = zlib.crc32(w.lower().encode()) % WORD_DIM
                if len(_words) < 200_000:
                    _words[w] = k
            slots.append(k)
        n = len(words)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(slots, minlength=WORD_DIM) / n
        out[i, PATH_DIM + WORD_DIM :] = (min(n, 100) / 100, np.log1p(n) / 6, linked / len(text), min(sum(text.count(c) for c in ".!?"), 5) / 5, min(text.count(","), 5) / 5, text[-1] in ".!?:;\"'", (at + i) / size, sum(map(text.count, "0123456789")) / len(text))
    return out


def _cell(x, wx, wh, b, state=None):
    """An LSTM over (steps, rows, INPUT), from ``state`` on; everything that its gradient needs."""
    steps, rows = x.shape[:2]
    n = wh.shape[0]
    pre = x.reshape(-1, x.shape[2]) @ wx + b
    pre = pre.reshape(steps, rows, 4 * n)
    h, c = np.zeros((steps + 1, rows, n), np.float32), np.zeros((steps + 1, rows, n), np.float32)
    if state is not None:
        h[0], c[0] = state
    gates = np.empty_like(pre)
    for t in range(steps):
        z = pre[t] + h[t] @ wh
        g = gates[t]
        g[:, : 3 * n] = 1 / (1 + np.exp(-z[:, : 3 * n]))
        g[:, 3 * n :] = np.tanh(z[:, 3 * n :])
        c[t + 1] = g[:, n : 2 * n] * c[t] + g[:, :n] * g[:, 3 * n :]
        h[t + 1] = g[:, 2 * n : 3 * n] * np.tanh(c[t + 1])
    return h, c, gates


def _cell_back(x, wx, wh, h, c, gates, dh_all):
    n = wh.shape[0]
    dz = np.empty_like(gates)
    dh, dc = np.zeros_like(h[0]), np.zeros_like(c[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * n : (k + 1) * n] for k in range(4))
        dh = dh + dh_all[t]
        tc = np.tanh(c[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dc = dc * f
        dh = dz[t] @ wh.T
    flat = dz.reshape(-1, 4 * n)
    return x.reshape(-1, x.shape[2]).T @ flat, h[:-1].reshape(-1, n).T @ flat, flat.sum(0)


def _padded(pages: list[np.ndarray]):
    """(steps, pages, INPUT) left aligned, the same with each page reversed, lengths."""
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((lengths.max(), len(pages), INPUT), np.float32)
    back = np.zeros_like(x)
    for j, p in enumerate(pages):
        x[: len(p), j], back[: len(p), j] = p, p[::-1]
    return x, back, lengths


class Labeller:
    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.params = []
        for _ in range(2):
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1
            self.params += [scale(INPUT, 4 * HIDDEN), scale(HIDDEN, 4 * HIDDEN), b]
        self.params += [scale(2 * HIDDEN, 1), np.zeros(1, np.float32)]

    def _forward(self, pages):
        x, back, lengths = _padded(pages)
        one, two = _cell(x, *self.params[:3]), _cell(back, *self.params[3:6])
        both = [np.concatenate([one[0][1 : n + 1, j], two[0][1 : n + 1, j][::-1]], 1) for j, n in enumerate(lengths)]
        flat = np.concatenate(both)
        z = (flat @ self.params[6] + self.params[7])[:, 0]
        return x, back, lengths, one, two, flat, 1 / (1 + np.exp(-z))

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each block, the probability that it is main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < BATCH_PAGES and (to - at + 1) * len(pages[order[to]]) <= BATCH_BLOCKS:
                to += 1
            part = order[at:to]
            *_, lengths, _, _, _, p = self._forward([pages[i] for i in part])
            for i, own in zip(part, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = own
            at = to
        return out

    def read(self, page: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
        """``chances`` of one page of any length: both directions in slices, so that only a number a block is held."""
        z = np.full(len(page), self.params[7][0], np.float32)
        edges = range(0, len(page), BATCH_BLOCKS)
        for params, out, turn, order in ((self.params[:3], self.params[6][:HIDDEN], 1, edges), (self.params[3:6], self.params[6][HIDDEN:], -1, reversed(edges))):
            state = None
            for lo in order:
                x = vectors(page[lo : lo + BATCH_BLOCKS], lo, len(page))[::turn, None]
                h, c, _ = _cell(x, *params, state)
                state = h[-1], c[-1]
                z[lo : lo + len(x)] += (h[1:, 0] @ out)[::turn, 0]
        return 1 / (1 + np.exp(-z))

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 10, rate: float = 0.01, seed: int = 23) -> None:
        rng = np.random.default_rng(seed)
        first, second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [order[i : i + 16] for i in range(0, len(order), 16)]
        step = 0
        for _ in range(epochs):
            for k in rng.permutation(len(groups)):
                part = groups[k]
                x, back, lengths, one, two, flat, p = self._forward([pages[i] for i in part])
                err = ((p - np.concatenate([labels[i] for i in part])) / len(p)).astype(np.float32)[:, None]
                d = err @ self.params[6].T
                d1, d2 = np.zeros_like(one[0][1:]), np.zeros_like(two[0][1:])
                for j, own in enumerate(np.split(d, np.cumsum(lengths)[:-1])):
                    d1[: len(own), j], d2[: len(own), j] = own[:, :HIDDEN], own[::-1, HIDDEN:]
                grads = [*_cell_back(x, self.params[0], self.params[1], *one, d1), *_cell_back(back, self.params[3], self.params[4], *two, d2), flat.T @ err, err.sum(0)]
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                for q, g, m, v in zip(self.params, grads, first, second, strict=True):
                    g = g * min(1, 1 / max(norm, 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            rate *= 0.8


#: Class and id words of invented layouts.
_SIDE = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topbar links pagination pager tags toolbar skip".split(),
    "header": "header masthead banner top logo site branding hero".split(),
    "footer": "footer foot bottom copyright legal colophon credits".split(),
    "aside": "sidebar aside related widget recommended popular trending teaser promo side rail".split(),
    "notice": "cookie consent gdpr notice alert popup modal overlay message disclaimer newsletter paywall".split(),
    "ad": "ad ads advert advertisement sponsored sponsor adsbygoogle adbox banner promoted".split(),
    "form": "form search login signup subscribe contact newsletter".split(),
    "comments": "comments comment commentlist discussion replies reply responses disqus respond".split(),
    "share": "share social sharing follow buttons meta byline author".split(),
}
_MAIN = "content article post entry main body story text single page copy detail".split()
_SAID = ["Cookie settings", "Subscribe to our newsletter", "All rights reserved", "Read more", "Related articles", "Log in", "Sign up", "Share this", "Leave a reply", "Advertisement", "Privacy policy", "Terms of use", "Contact us", "About", "Search", "Home"]


def invented_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of one of many layouts, and whether each of its blocks is main text."""
    pieces = ["".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouéäñ") for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "n", "s", "r", "tion", "ung"]) for _ in range(200)]
    html: list[str] = []
    labels: list[bool] = []

    def words(lo, hi):
        said = [rng.choice(pieces) for _ in range(rng.randint(lo, hi))]
        return " ".join(said)

    def sentences(lo, hi):
        return " ".join(words(2, 14).capitalize() + rng.choice(".....!?") for _ in range(rng.randint(lo, hi)))

    def leaf(tag, text, main, inner=""):
        html.append(f"<{tag}{inner}>{text}</{tag}>")
        labels.append(main)

    def mark(options):
        w = rng.choice(options)
        w = rng.choice([w, f"{w}-{rng.choice(['box', 'wrap', 'area', 'inner', 'list', '1'])}", f"{rng.choice(['site', 'page', 'the'])}-{w}"])
        return f' {rng.choice(["class", "class", "id"])}="{w}"'

    def links():
        tag = rng.choice(["ul", "ol", "div"])
        html.append(f"<{tag}>")
        for _ in range(rng.randint(2, 9)):
            leaf("li" if tag != "div" else "p", f'<a href="/{words(1, 1)}">{words(1, 4)}</a>', False)
        html.append(f"</{tag}>")

    def side(kind, nested=False):
        plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        semantic = plain and rng.random() < 0.6
        tag = plain if semantic else rng.choice(["div", "div", "section"])
        html.append(f"<{tag}{mark(_SIDE[kind]) if not semantic or rng.random() < 0.4 else ''}>")
        if kind in ("nav", "share"):
            links()
        elif kind == "header":
            leaf(rng.choice(["h1", "p", "div"]), words(1, 5), False)
            if rng.random() < 0.4:
                links()
        elif kind == "footer":
            leaf(rng.choice(["p", "div", "span"]), rng.choice(["&copy; ", "© 2024 ", ""]) + rng.choice([sentences(1, 3), rng.choice(_SAID)]), False)
            if rng.random() < 0.3:
                links()
        elif kind == "form":
            leaf("label", words(1, 3), False)
            leaf("button", rng.choice(_SAID), False)
        elif kind == "comments":
            leaf(rng.choice(["h2", "h3"]), rng.choice(["Comments", words(1, 3)]), False)
            for _ in range(rng.randint(1, 5)):
                html.append(f"<div{mark(_SIDE['comments'])}>" if rng.random() < 0.6 else "<div>")
                leaf(rng.choice(["p", "div"]), sentences(1, 4), False)
                html.append("</div>")
        else:
            if rng.random() < 0.3:
                leaf(rng.choice(["h3", "h4"]), rng.choice(_SAID), False)
            for _ in range(rng.randint(1, 2)):
                text = rng.choice([sentences(1, 4), words(2, 9), rng.choice(_SAID)])
                if rng.random() < 0.5:
                    leaf("p", text, False)
                elif html[-1].startswith(f"<{tag}"):
                    html.append(text)
                    labels.append(False)
                    break
                else:
                    leaf("p", text, False)
        html.append(f"</{tag}>")

    for kind in rng.sample(["header", "nav", "notice", "ad", "form", "aside", "share"], rng.randint(0, 4)):
        side(kind)
    shell = rng.choice(["article", "article", "article", "main", "main article", "div", "div", "section", ""])
    opened = []
    for tag in shell.split():
        html.append(f"<{tag}{mark(_MAIN) if tag in ('div', 'section') or rng.random() < 0.3 else ''}>")
        opened.append(tag)
    if rng.random() < 0.85:
        wrap = rng.random() < 0.15 and opened
        html.append("<header>" if wrap else "")
        leaf(rng.choice(["h1", "h1", "h2"]), rng.choice([words(2, 10).capitalize(), sentences(1, 2)]), True)
        html.append("</header>" if wrap else "")
    for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
        kind = rng.random()
        if kind < 0.7:
            text = sentences(1, rng.choice([1, 2, 6, 10]))
            if rng.random() < 0.15:
                html.append(f"<p><b>{text}<br>")
                labels.append(True)
            else:
                text = rng.choice([text, text, f"<b>{text}</b>", f'{text} <a href="/x">{words(1, 4)}</a> {sentences(1, 2)}'])
                leaf("p", text, True)
        elif kind < 0.78:
            leaf(rng.choice(["h2", "h3"]), words(1, 8).capitalize(), True)
        elif kind < 0.84:
            html.append("<ul>")
            for _ in range(rng.randint(1, 5)):
                leaf("li", rng.choice([words(2, 12), sentences(1, 2)]), True)
            html.append("</ul>")
        elif kind < 0.90:
            leaf(rng.choice(["blockquote", "pre", "figcaption", "td", "dd"]), rng.choice([sentences(1, 3), words(1, 6)]), True)
        else:
            html.append("</p>")
            side(rng.choice(["ad", "share", "aside", "notice", "ad", "nav", "form"]), True)
    if opened and rng.random() < 0.2:
        html.append("</p>")
        side(rng.choice(["comments", "share", "footer"]), True)
    html += [f"</{tag}>" for tag in reversed(opened)]
    if not opened:
        html.append("</p>")
    for kind in rng.sample(["comments", "aside", "ad", "nav", "form", "notice", "footer"], rng.randint(0, 3)):
        side(kind)
    if rng.random() < 0.6:
        side("footer")
    page = f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{''.join(html)}</body></html>"
    return page, labels


_AWAY = frozenset(w for kind, some in _SIDE.items() if kind != "header" for w in some)


def own_labels(page: list[tuple[tuple[str, ...], str, int]]) -> list[bool] | None:
    """Labels from a page's semantic tags; None where it has no article or main element."""
    if not any("article" in p or "main" in p for p, _, _ in page):
        return None
    return [("article" in p or "main" in p) and not {"nav", "aside", "footer", "form"} & set(p) and not any(w[1:] in _AWAY for w in p if w[0] == ".") for p, _, _ in page]


def _sampled(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(x, y): runs of blocks, as vectors and their own labels, of a bounded sample of whole pages. Parsed where they are
    read; of the pages only those under a hash that about twice SAMPLED reach are looked at, equal rows once."""
    space = 1 << 30
    some = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h")).withColumn("k", F.pmod(F.xxhash64("i", F.lit(5)), F.lit(space)))
    some = some.where((F.col("k") <= space * 2 * SAMPLED // max(1, pages.count())) & (F.length("h") > 0)).dropDuplicates(["i", "h"])

    def run(batches):
        for pdf in batches:
            for k, page in zip(pdf["k"], map(blocks, pdf["h"]), strict=True):
                own = own_labels(page) if page else None
                for lo in range(0, len(page) if own else 0, RUN):
                    x = vectors(page[lo : lo + RUN], lo, len(page))
                    yield pd.DataFrame({"k": [k], "lo": [lo], "x": [x.tobytes()], "y": [np.array(own[lo : lo + RUN], np.bool_).tobytes()]})

    some = some.orderBy("k", "i", "h").limit(SAMPLED)
    return some.select("k", "h").mapInPandas(run, "k long, lo long, x binary, y binary").orderBy(F.xxhash64("k", "lo"), "k", "lo").limit(RUNS).select("x", "y")


def train(pages: DataFrame | None = None, *, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    rng = random.Random(99)
    seqs, labels = [], []
    for _ in range(INVENTED):
        html, own = invented_page(rng)
        found = blocks(html)
        if found and len(found) == len(own):
            seqs.append(vectors(found))
            labels.append(np.array(own, np.float32))
    if pages is not None:
        for r in _sampled(pages, id_col, html_col).collect():
            seqs.append(np.frombuffer(r.x, np.float32).reshape(-1, INPUT))
            labels.append(np.frombuffer(r.y, np.bool_).astype(np.float32))
    net = Labeller()
    net.train(seqs, labels)
    return net


def extract(pages: DataFrame, net: Labeller | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: page_id, url, text, n_blocks, n_main.

    The text is the blocks labelled as main text, in page order, one a line; it is empty where there are none, as for
    null or empty html. Every block of a page is read and labelled, however long it is. Repeated rows each give a row;
    other columns are ignored; an empty table gives none. No shuffle.
    """
    net = net or train(pages, id_col=id_col, html_col=html_col)
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def read(htmls: pd.Series) -> pd.DataFrame:
        net, out, held, n = shared.value, [], [], 0

        def label():
            short = [b if len(b) <= BATCH_BLOCKS else [] for b in held]
            for page, p in zip(held, net.chances([vectors(b) for b in short]), strict=True):
                main = (net.read(page) if len(page) > BATCH_BLOCKS else p) > 0.5
                out.append(("\n".join(t for (_, t, _), m in zip(page, main, strict=True) if m), len(page), int(main.sum())))
            held.clear()

        for html in htmls:
            held.append(blocks(html))
            n += len(held[-1])
            if n >= 4 * BATCH_BLOCKS:
                label()
                n = 0
        label()
        return pd.DataFrame(out, columns=["text", "n_blocks", "n_main"])

    found = F.pandas_udf(read, "text string, n_blocks long, n_main long")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), found(F.col(html_col)).alias("x")).select("page_id", "url", "x.text", "x.n_blocks", "x.n_main")
