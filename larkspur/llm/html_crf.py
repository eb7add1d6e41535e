"""Main-text extraction with a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, the stretches of text between block-level tags.
Each block has features of its ancestors (tags, words of class and id) and of
its text; the chain's two states say whether a block is main text.  The model is
trained here, on labelled pages that ``training_pages`` lays out in the ways
that sites commonly do: their blocks' labels are known as they are made.  The
most likely labels are found by Viterbi's recursion.

Scripts, styles, heads, comments and templates are markup and never blocks.
Character references are decoded; white space in a block becomes one space; line
breaks within a block are white space.  Main blocks are joined in page order by
two line feeds; nothing else is dropped or cut.  A null or empty page has an
empty text; repeated rows each get theirs; unclosed and stray tags are allowed.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style head template noscript svg iframe object canvas select textarea".split())
#: A tag that ends the open ones named, unless a container lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div article section main nav aside header footer form body html blockquote figure".split())
MAIN, OTHER = 1, 0
#: Features on fewer training pages than this are left out.
RARE = 4


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, linked: int, path: tuple) -> None:
        self.text, self.linked, self.path = text, linked, path


class _Cutter(HTMLParser):
    """Leaf blocks of a page; ``path`` holds each ancestor's tag and its class and id words."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.dropped = 0
        self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.linked, tuple(self.stack)))
        self.parts, self.linked = [], 0

    def pop_to(self, i: int) -> None:
        for tag, _ in self.stack[i:]:
            self.links -= tag == "a"
            self.dropped -= tag in DROPPED
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in INLINE:
            if tag in VOID:
                return
        else:
            self.flush()
            ends = CLOSES.get(tag, set()) | {"p"}
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    self.pop_to(i)
                    break
                if self.stack[i][0] in CONTAINERS:
                    break
            if tag in VOID:
                return
            if tag == "body":  # also ends a head that was left open
                self.pop_to(next((i for i, x in enumerate(self.stack) if x[0] == "head"), len(self.stack)))
        words = []
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label") and value:
                words += re.findall(r"[a-z]+", value.lower())
            elif name == "hidden" or (name == "style" and value and re.search(r"display\s*:\s*none", value)):
                words.append("hidden")
        self.stack.append((tag, tuple(words)))
        self.links += tag == "a"
        self.dropped += tag in DROPPED

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return  # an inline tag doesn't end blocks

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str) -> list[Block]:
    cutter = _Cutter()
    cutter.feed(html)
    cutter.close()
    cutter.flush()
    return cutter.blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for b in blocks:
        tags = {t for t, _ in b.path} - {"html", "body"}
        words = {w for _, ws in b.path for w in ws}
        n = b.text.count(" ") + 1
        own = [f"tag={t}" for t in tags if t not in INLINE] + [f"class={w}" for w in words]
        own.append(f"leaf={next((t for t, _ in reversed(b.path) if t not in INLINE), '')}")
        own.append("words=" + ("1" if n < 2 else "4" if n < 5 else "12" if n < 13 else "30" if n < 31 else "more"))
        share = b.linked / max(1, len(b.text))
        own.append("links=" + ("none" if share == 0 else "some" if share < 0.4 else "most"))
        if b.text[-1] in ".!?…\"”»":
            own.append("ended")
        if "©" in b.text or "copyright" in b.text.lower():
            own.append("copyright")
        if not any(c.isalpha() for c in b.text):
            own.append("no letters")
        out.append(own)
    return out


class Model:
    """Weights: ``state[f]`` for a main block with feature ``f`` (other: 0), and moves between states."""

    def __init__(self, state: dict[str, float], moves: list[list[float]], begin: list[float]) -> None:
        self.state, self.moves, self.begin = state, moves, begin

    def decode(self, names: list[list[str]]) -> list[int]:
        """The most likely states, by Viterbi."""
        if not names:
            return []
        scores = [sum(self.state.get(f, 0.0) for f in own) for own in names]
        best = [self.begin[0], self.begin[1] + scores[0]]
        back = []
        for s in scores[1:]:
            come = [max((best[i] + self.moves[i][j], i) for i in (0, 1)) for j in (0, 1)]
            back.append([c[1] for c in come])
            best = [come[0][0], come[1][0] + s]
        states = [int(best[1] > best[0])]
        for b in reversed(back):
            states.append(b[states[-1]])
        return states[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.15, decay: float = 0.02) -> Model:
    """Maximum likelihood by gradient steps (Adam); expectations by the forward-backward recursion,
    all pages at once."""
    on = Counter(f for names, _ in pages for f in {f for own in names for f in own})
    index = {f: i for i, f in enumerate(f for f, k in on.items() if k >= RARE)}
    most, n, m = max(len(y) for _, y in pages), len(pages), len(index)
    x = np.zeros((n, most, m), np.float32)
    y = np.zeros((n, most), np.int64)
    live = np.zeros((n, most))
    for i, (names, labels) in enumerate(pages):
        for t, own in enumerate(names):
            x[i, t, [index[f] for f in own if f in index]] = 1
        y[i, : len(labels)] = labels
        live[i, : len(labels)] = 1
    flat = x.reshape(-1, m)
    theta = np.zeros(m + 6)
    first = second = np.zeros_like(theta)
    hit = np.zeros((n, most, 2))
    np.put_along_axis(hit, y[..., None], 1, 2)
    hit *= live[..., None]
    seen_moves = np.einsum("nti,ntj->ij", hit[:, :-1], hit[:, 1:])
    for step in range(1, rounds + 1):
        w, moves, begin = theta[:m], theta[m : m + 4].reshape(2, 2), theta[m + 4 :]
        s = np.zeros((n, most, 2))
        s[..., 1] = (flat @ w).reshape(n, most)
        a = np.zeros((n, most, 2))
        b = np.zeros((n, most, 2))
        a[:, 0] = begin + s[:, 0]
        for t in range(1, most):
            a[:, t] = np.logaddexp(a[:, t - 1, :1] + moves[0], a[:, t - 1, 1:] + moves[1]) + s[:, t]
            a[:, t] = np.where(live[:, t, None] > 0, a[:, t], a[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = s[:, t + 1] + b[:, t + 1]
            b[:, t] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            b[:, t] = np.where(live[:, t + 1, None] > 0, b[:, t], 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - z[:, None, None]) * live[..., None]
        pair = np.exp(a[:, :-1, :, None] + moves + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        gradient = np.concatenate([
            flat.T @ (hit - p)[..., 1].ravel(),
            (seen_moves - pair.sum((0, 1))).ravel(),
            (hit - p)[:, 0].sum(0),
        ]) / n - decay * theta / 10
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in index.items()}, theta[m : m + 4].reshape(2, 2).tolist(), theta[m + 4 :].tolist())


def training_pages(count: int = 240, seed: int = 7) -> Iterator[tuple[str, list[int]]]:
    """Labelled pages: html and the label of each leaf block, in page order."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioustrnlmdpkc") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 4, high: int = 40) -> str:
        return words(low, high).capitalize() + rng.choice("...?!")

    def prose() -> str:
        text = " ".join(sentence(1, 30) for _ in range(rng.choice((1, 1, 2, 3, 6))))
        if rng.random() < 0.2:
            text = " ".join(w + rng.choice(("###", "***", "$$$", "&amp;&amp;&amp;", "%%%", "")) for w in text.split())
        if rng.random() < 0.2:
            text = text.replace(" ", f' <a href="/{words(1, 1)}">{words(1, 3)}</a> ', 1)
        return text if rng.random() < 0.7 else f"<b>{text}<br>" if rng.random() < 0.5 else f"<em>{words(1, 2)}</em> {text}"

    def tagged(tag: str, names: tuple[str, ...], body: str) -> str:
        name = rng.choice((*names, "", "")) if tag not in ("div", "section", "ul") else rng.choice(names)
        attr = f' {rng.choice(("class", "id"))}="{name}{rng.choice(("", "", " x" + words(1, 1)))}"' if name else ""
        return f"<{tag}{attr}>{body}</{tag}>"

    def links(tag: str, names: tuple[str, ...], low: int = 2, high: int = 9) -> tuple[str, list[int]]:
        n = rng.randint(low, high)
        items = "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(n))
        return tagged(tag, names, f"<ul>{items}</ul>"), [OTHER] * n

    def boxed(tag: str, names: tuple[str, ...], low: int = 1, high: int = 3) -> tuple[str, list[int]]:
        n = rng.randint(low, high)
        inner = sentence() if n == 1 and rng.random() < 0.6 else "".join(f"<p>{sentence()}</p>" for _ in range(n))
        return tagged(tag, names, inner), [OTHER] * n

    def extra() -> tuple[str, list[int]]:
        return rng.choice((
            lambda: boxed("div", ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")),
            lambda: boxed("div", ("notice", "cookie", "cookie-notice", "consent", "alert", "gdpr-banner")),
            lambda: boxed("div", ("newsletter", "subscribe", "share", "social", "related", "recommended", "popular")),
            lambda: boxed("aside", ("sidebar", "related", "widget", "side")),
            lambda: boxed("div", ("sidebar", "side-bar", "widget", "rail")),
            lambda: links("div", ("menu", "breadcrumb", "breadcrumbs", "tags", "pagination", "related-links")),
            lambda: form(),
        ))()

    def form() -> tuple[str, list[int]]:
        body = f"<label>{words(1, 3)}</label><input name=q>" + (f"<p>{sentence()}</p>" if rng.random() < 0.5 else "") + f"<button>{words(1, 2)}</button>"
        return f"<form>{body}</form>", [OTHER] * (2 + ("<p>" in body))

    def comments() -> tuple[str, list[int]]:
        n = rng.randint(1, 5)
        each = "".join(tagged("div", ("comment", "comment-body", "reply"), f"<p>{prose()}</p>") for _ in range(n))
        head = f"<h3>{words(1, 3)}</h3>" if rng.random() < 0.5 else ""
        return tagged(rng.choice(("section", "div")), ("comments", "discussion", "responses", "comment-list"), head + each), [OTHER] * (n + bool(head))

    def article() -> tuple[str, list[int]]:
        body, labels = [f"<h1>{words(2, 12)}</h1>"] if rng.random() < 0.9 else [], []
        labels += [MAIN] * len(body)
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.75:
                body.append(f"<p>{prose()}" + ("</p>" if rng.random() < 0.9 else ""))
                labels.append(MAIN)
            elif kind < 0.85:
                body.append(f"<h{rng.randint(2, 3)}>{words(1, 8)}</h{2}>".replace("</h2>", "") + f"<p>{prose()}</p>")
                labels += [MAIN] * 2
            elif kind < 0.9:
                n = rng.randint(2, 5)
                body.append("<ul>" + "".join(f"<li>{sentence(1, 12)}</li>" for _ in range(n)) + "</ul>")
                labels += [MAIN] * n
            elif kind < 0.93:
                body.append(f"<blockquote><p>{prose()}</p></blockquote>")
                labels.append(MAIN)
            elif kind < 0.95:
                body.append("<table><tr>" + "".join(f"<td>{words(1, 3)}</td>" for _ in range(3)) + "</tr></table>")
                labels += [MAIN] * 3
            else:
                html, own = extra()
                body.append(html)
                labels += own
        inner = "".join(body)
        way = rng.random()
        if way < 0.45:
            return tagged("article", ("post", "article", "entry"), inner), labels
        if way < 0.6:
            return tagged("main", ("content", "main"), inner), labels
        if way < 0.7:
            return f"<main><article>{inner}</article></main>", labels
        return tagged("div", ("content", "article", "article-body", "post", "entry-content", "main", "story", "text", "body"), inner), labels

    for _ in range(count):
        parts: list[tuple[str, list[int]]] = []
        if rng.random() < 0.7:
            parts.append(links(*rng.choice((("nav", ("nav", "menu")), ("div", ("nav", "menu", "navbar", "topnav")), ("header", ("header", "top"))))))
        if rng.random() < 0.3:
            parts.append(boxed(*rng.choice((("header", ("header", "masthead")), ("div", ("header", "masthead", "site-header"))))))
        parts += [extra() for _ in range(rng.choice((0, 1, 1, 2)))]
        parts.append(article())
        parts += [extra() for _ in range(rng.choice((0, 0, 1, 2)))]
        if rng.random() < 0.4:
            parts.append(comments())
        if rng.random() < 0.8:
            body = rng.choice((f"&copy; {words(1, 4)} &middot; {sentence()}", sentence(), words(2, 8)))
            parts.append((tagged(*rng.choice((("footer", ("footer",)), ("div", ("footer", "bottom", "site-footer")))), body), [OTHER]))
        head = f"<head><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        wrap = rng.choice(("%s", "%s", '<div class="wrapper">%s</div>', '<div id="page"><div class="container">%s</div></div>'))
        yield f"<!DOCTYPE html><html>{head}<body>{wrap % ''.join(p for p, _ in parts)}</body></html>", [x for _, own in parts for x in own]


def trained(count: int = 240, seed: int = 7) -> Model:
    """The model, from ``count`` labelled pages (the bound on what is fitted on the driver)."""
    pages = []
    for html, labels in training_pages(count, seed):
        blocks = leaf_blocks(html)
        if len(blocks) == len(labels):
            pages.append((features(blocks), labels))
    return train(pages)


def main_text(html: str, model: Model) -> str:
    blocks = leaf_blocks(html)
    states = model.decode(features(blocks))
    return "\n\n".join(b.text for b, s in zip(blocks, states, strict=True) if s == MAIN)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", model) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
