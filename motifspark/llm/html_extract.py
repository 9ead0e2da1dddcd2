"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags. Each block has a vector:
learned vectors of the hashed parts of its tag path (tag names, class and id words), learned
vectors of its hashed words, and a few measures. A bidirectional LSTM, in numpy, reads the
page's blocks in order and labels each as article or not, so a block's label depends on the
whole page. It is trained, once a process, on pages of a small grammar (page_grammar.py).

Scripts, styles, comments, head, form controls and markup have no blocks. Character
references are decoded; white space inside a block becomes one space; blocks labelled as
article are joined in page order by one space.

Defined cases: a null or empty html gives the empty text, as does a page without an article
block. Broken markup is read as far as it goes: an unclosed tag lasts until its parent ends,
a cut-off tag is dropped. Only scripts, styles, text areas and comments run to the end of the
page; an unclosed head ends at the first text or tag of a body, an unclosed option, select,
button, title, iframe, svg or math at the next block-level tag too. Pages of any length and depth
are read whole; over a page of more than ``RUN`` blocks the two LSTMs go in runs of that many,
each starting from the state in which the run before it ended. A block whose two labels tie is
no article. Rows repeating a page_id are answered each; a null page_id is carried along. An
empty table gives no rows. Columns other than page_id, url and html are ignored, whatever
their names.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts
from .page_grammar import PageGrammar

PATHS, WORDS, PDIM, WDIM, MEASURES, HIDDEN, RUN = 1024, 512, 16, 6, 6, 20, 2000
#: HTML's elements by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|textarea"
DROPPED = "noscript|template|select|svg|math|iframe|object|canvas|head|button|title|option"
UNSHOWN = set(DROPPED.split("|"))
UNBROKEN = {"svg", "math", "canvas"}  # text goes on around them
SHORT_LIVED = {"option", "select", "button", "title", "iframe", "svg", "math"}
OF_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BLOCKS = CLOSES_P | set("body caption center dd details dt figcaption figure li summary tbody td tfoot th thead tr".split())
CLOSED_BY = {"option": {"option"}, "optgroup": {"option", "optgroup"}, "button": {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"option": {"select", "datalist", "optgroup"}, "optgroup": {"select", "datalist"}, "button": {"table", "td", "th"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_RAW = r"<!--.*?(?:-->|\Z)|<(" + RAW + r")(?![\w:-])[^>]*>.*?(?:</\1\s*>|\Z)|"
_DROPPED = r"<(/?)(" + DROPPED + r")(?![\w:-])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>"
TOKEN = re.compile(_RAW + _DROPPED + r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S | re.I)
PAIRED = re.compile(_RAW + _DROPPED, re.S | re.I)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")


@lru_cache(200_000)
def _hash(kind: str, text: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{text}".encode("utf-8", "surrogatepass")) % size


class Path:
    """The open elements above a block: what the innermost adds to the path of the one around it."""

    __slots__ = ("above", "parts", "kids")

    def __init__(self, above: "Path | None" = None, parts: tuple[int, ...] = ()):
        self.above, self.parts, self.kids = above, parts, {}

    def below(self, parts: tuple[int, ...]) -> "Path":
        """The path of an element in this one: the same object for the same parts."""
        out = self.kids.get(parts)
        if out is None:
            out = self.kids[parts] = Path(self, parts)
        return out

    def all(self) -> list[int]:
        out, at = [], self
        while at is not None:
            out += at.parts
            at = at.above
        return out


class Block:
    __slots__ = ("path", "text", "linked", "role")

    def __init__(self, path: Path, text: str, linked: int, role: str = ""):
        self.path, self.text, self.linked, self.role = path, text, linked, role


@lru_cache(100_000)
def _part(tag: str, attributes: str) -> tuple[int, ...]:
    """The hashed parts that one element adds to a path."""
    out = [_hash("t", tag, PATHS)]
    for m in NAMED.finditer(attributes):
        name = (m[1] or m[2] or m[3] or "").lower()
        out += [_hash("c", x, PATHS) for x in PART.findall(name)]
    return tuple(out)


def closed(page: str) -> dict[int, int]:
    """Where each dropped element that has an end tag starts and ends."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in PAIRED.finditer(page):
        if m[3] is None:
            continue
        own = open_.setdefault(tag := m[3].lower(), [])
        if not m[2]:
            if not (tag in ("svg", "math") and m[4].endswith("/")):
                own.append(m.start())
        elif own:
            out[own.pop()] = m.end()
    return out


def blocks_of(page: str | None, marks: bool = False, root: Path | None = None) -> list[Block]:
    """The blocks of a page in order. ``marks``: control characters name the parts' roles (training). ``root``: one for pages whose paths are to be shared."""
    root = root or Path()
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    named: dict[str, int] = {}  # the open elements by name
    buffer: list[str] = []
    linked, in_link, hidden, role = 0, 0, 0, ""

    def flush() -> None:
        nonlocal linked
        if buffer:
            raw = "".join(buffer)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(stack[-1][1] if stack else root, text, linked, role))
            buffer.clear()
        linked = 0

    def text_in(raw: str) -> None:
        nonlocal role, linked
        if marks and ("\1" in raw or "\2" in raw):
            for piece in re.split("([\1\2])", raw):
                if piece in ("\1", "\2"):
                    flush()
                    role = piece
                elif piece:
                    buffer.append(piece)
            return
        buffer.append(raw)
        linked += len(raw) * (in_link > 0)

    def cut(a: int) -> None:
        """Ends the open elements from a on."""
        nonlocal in_link, hidden
        for t, _ in stack[a:]:
            named[t] -= 1
            in_link -= t == "a"
            hidden -= t in UNSHOWN
        del stack[a:]

    def last(tags: set[str], stops: set[str]) -> int | None:
        """Where the innermost of ``tags`` is open, not looking past ``stops``."""
        for t in tags:
            if named.get(t):
                break
        else:
            return None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stops:
                return None
        return None

    page = page or ""
    ends = closed(page)
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            raw = page[at : m.start()]
            if hidden and stack[-1][0] == "head" and not raw.isspace():
                cut(len(stack) - 1)
            if not hidden:
                text_in(raw)
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            if m[1] and not hidden:
                flush()
            continue
        tag, attributes = tag.lower(), m[4] if m[3] else m[7]
        if m[2] or m[5]:
            k = last({tag}, set())
            if k is not None:
                shown = hidden == 0 or any(t in UNSHOWN for t, _ in stack[k:])
                if shown and tag not in INLINE and tag not in UNBROKEN:
                    flush()
                cut(k)
            elif not hidden and tag not in INLINE:
                flush()
            continue
        if hidden:
            if tag not in OF_HEAD and (k := last({"head"}, set())) is not None:
                cut(k)
            if tag in BLOCKS:
                while hidden and (k := last(UNSHOWN, set())) is not None and stack[k][0] in SHORT_LIVED:
                    cut(k)
        if not hidden and tag not in INLINE and tag not in UNBROKEN:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and (k := last({"p"}, {"table", "td", "th", "button"})) is not None:
            cut(k)
        if tag in CLOSED_BY and (k := last(CLOSED_BY[tag], STOPS[tag])) is not None:
            cut(k)
        if tag in UNSHOWN and m.start() in ends:
            at = ends[m.start()]
        elif not attributes.endswith("/"):
            above = stack[-1][1] if stack else root
            plain = hidden or tag in INLINE or tag in UNSHOWN
            stack.append((tag, above if plain else above.below(_part(tag, attributes))))
            named[tag] = named.get(tag, 0) + 1
            in_link += tag == "a"
            hidden += tag in UNSHOWN
    if at < len(page):
        raw = page[at:]
        if hidden and stack[-1][0] == "head" and not raw.isspace():
            cut(len(stack) - 1)
        if not hidden:
            text_in(raw)
    flush()
    return out


@lru_cache(100_000)
def _word(word: str) -> int:
    return _hash("w", word.strip(".,;:!?()"), WORDS)


def inputs(blocks: list[Block], a: int = 0, b: int | None = None) -> tuple[list[Path], list[list[int]], np.ndarray]:
    """Paths, hashed words (all of a block's) and measures of a page's blocks from a to b."""
    measures, words = [], []
    last = len(blocks) - 1
    some = blocks[a:b]
    for i, x in enumerate(some, a):
        own = x.text.split()
        n = len(x.text)
        words.append([_word(w.lower()) for w in own])
        measures.append((min(2.0, len(own) ** 0.5 / 6), min(1.0, x.linked / n), x.text.count(".") / (1 + len(own)), x.text[-1] in ".!?", i == 0, i == last))
    return [x.path for x in some], words, np.array(measures, np.float32)


class Labeller:
    """Embeddings, a forward and a backward LSTM, and a logistic output."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        d = PDIM + WDIM + MEASURES
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"path": r.normal(0, 0.3, (PATHS, PDIM)), "word": r.normal(0, 0.1, (WORDS, WDIM)), "o": g(2 * HIDDEN, 1)[:, 0], "ob": np.zeros(1)}
        for k in "fb":
            self.p |= {k + "x": g(d, 4 * HIDDEN), k + "h": g(HIDDEN, 4 * HIDDEN), k + "c": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def embed(self, pages: list) -> tuple[np.ndarray, np.ndarray, list]:
        """Padded block vectors (time, page, value), a mask, and which vectors each block took."""
        steps = max(len(x[0]) for x in pages)
        out = np.zeros((steps, len(pages), PDIM + WDIM + MEASURES), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        took = []
        known: dict[Path, np.ndarray] = {}
        path, word = self.p["path"], self.p["word"]

        def vector(at: Path) -> np.ndarray:
            """The sum of the vectors of a path's parts, from that of the path above."""
            todo = []
            while at is not None and at not in known:
                todo.append(at)
                at = at.above
            v = known[at] if at is not None else np.zeros(PDIM, np.float32)
            for at in reversed(todo):
                v = known[at] = v + path[list(at.parts)].sum(axis=0) if at.parts else v
            return v

        for j, (paths, words, measures) in enumerate(pages):
            n = len(paths)
            mask[:n, j] = 1
            out[:n, j, PDIM + WDIM :] = measures
            for t, a in enumerate(paths):
                out[t, j, :PDIM] = vector(a)
            lens = np.array([len(b) for b in words])
            flat = word[[w for b in words for w in b]]
            out[:n, j, PDIM : PDIM + WDIM] = np.add.reduceat(flat, np.cumsum(lens) - lens, axis=0) / lens[:, None]
            took += [(t, j, a, b) for t, (a, b) in enumerate(zip(paths, words))]
        return out, mask, took

    def lstm(self, k: str, x: np.ndarray, mask: np.ndarray, keep: bool, state: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """The states of all steps, what the gradients need, and the last state; ``state`` is the one to start from."""
        steps, n, _ = x.shape
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        hs, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        gates = x @ self.p[k + "x"] + self.p[k + "c"]
        for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.p[k + "h"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = (f * c + i * g) * m
            tc = np.tanh(c2)
            h2 = o * tc * m
            if keep:
                kept.append((t, i, f, o, g, c, tc, h, m))
            h, c = h2, c2
            hs[t] = h
        return hs, kept, (h, c)

    def logits(self, pages: list, keep: bool = False):
        x, mask, took = self.embed(pages)
        f, kf, _ = self.lstm("f", x, mask, keep)
        b, kb, _ = self.lstm("b", x, mask, keep)
        h = np.concatenate([f, b], axis=2)
        return h @ self.p["o"] + self.p["ob"][0], (x, mask, took, h, kf, kb)

    def gradients(self, pages: list, labels: np.ndarray) -> dict[str, np.ndarray]:
        z, (x, mask, took, h, kf, kb) = self.logits(pages, True)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * mask / mask.sum()
        g = {"o": np.einsum("tn,tnh->h", d, h), "ob": np.array([d.sum()])}
        dh = d[:, :, None] * self.p["o"]
        dx = np.zeros_like(x)
        for k, kept, own in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[:, :, HIDDEN:])):
            wx, wh = self.p[k + "x"], self.p[k + "h"]
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN)
            nh, nc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
            for t, i, f, o, cand, c, tc, before, m in reversed(kept):
                ah = (own[t] + nh) * m
                ac = (ah * o * (1 - tc**2) + nc) * m
                dz = np.concatenate([ac * cand * i * (1 - i), ac * c * f * (1 - f), ah * tc * o * (1 - o), ac * i * (1 - cand**2)], axis=1)
                gx += x[t].T @ dz
                gh += before.T @ dz
                gc += dz.sum(axis=0)
                dx[t] += dz @ wx.T
                nh, nc = dz @ wh.T, ac * f
            g |= {k + "x": gx, k + "h": gh, k + "c": gc}
        g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        for t, j, a, b in took:
            if own := a.all():
                np.add.at(g["path"], own, dx[t, j, :PDIM])
            if b:
                np.add.at(g["word"], b, dx[t, j, PDIM : PDIM + WDIM] / len(b))
        return g

    def fit(self, pages: list, labels: list[np.ndarray], epochs: int = 10, batch: int = 16, rate: float = 0.01) -> "Labeller":
        """Adam over shuffled batches of pages of about equal length."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        r, step = np.random.default_rng(4), 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for e in range(epochs):
            for k in r.permutation(len(groups)):
                own = [pages[i] for i in groups[k]]
                y = np.zeros((max(len(x[0]) for x in own), len(own)))
                for j, i in enumerate(groups[k]):
                    y[: len(labels[i]), j] = labels[i]
                step += 1
                lr = rate * (1 - e / epochs)
                for name, g in self.gradients(own, y).items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return self

    def long_logits(self, page: list[Block]) -> np.ndarray:
        """The logits of a page's blocks, run by run: memory holds the block vectors and the states of one run."""
        runs = []
        for k in range(0, len(page), RUN):
            x, mask, _ = self.embed([inputs(page, k, k + RUN)])
            runs.append((k, x, mask))
        z = np.full(len(page), self.p["ob"][0])
        for name, o, order in (("f", self.p["o"][:HIDDEN], runs), ("b", self.p["o"][HIDDEN:], runs[::-1])):
            state = None
            for k, x, mask in order:
                hs, _, state = self.lstm(name, x, mask, False, state)
                z[k : k + RUN] += hs[:, 0] @ o
        return z

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which of its blocks are article."""
        out = [np.zeros(len(p), bool) for p in pages]
        short = sorted((i for i, p in enumerate(pages) if 0 < len(p) <= RUN), key=lambda i: len(pages[i]))
        for a in range(0, len(short), 128):
            own = short[a : a + 128]
            z, _ = self.logits([inputs(pages[i]) for i in own])
            for j, i in enumerate(own):
                out[i] = z[: len(pages[i]), j] > 0
        for i, p in enumerate(pages):
            if len(p) > RUN:
                out[i] = self.long_logits(p) > 0
        return out


@lru_cache(1)
def trained(pages: int = 420, seed: int = 11) -> Labeller:
    """The labeller, fitted on ``pages`` pages of the grammar."""
    grammar = PageGrammar(seed)
    seen = [b for b in (blocks_of(grammar.page(), marks=True) for _ in range(pages)) if b]
    return Labeller().fit([inputs(b) for b in seen], [np.array([x.role == "\2" for x in b], float) for b in seen])


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    root = Path()
    blocks = [blocks_of(p, root=root) for p in pages]
    return [" ".join(b.text for b, ok in zip(own, keep) if ok) for own, keep in zip(blocks, model.label(blocks))]


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast((model or trained()).p)  # some 40,000 numbers

    def run(html: list[str]) -> dict:
        own = Labeller.__new__(Labeller)
        own.p = sent.value
        texts = [t for a in range(0, len(html), 256) for t in main_texts(own, html[a : a + 256])]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    own = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    return over_texts(own, run, "text string, n_chars long", "url", key="page_id", column="html")
