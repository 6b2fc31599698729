"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks: runs of text between block-level tags, each with the path of elements it stands in. A
bidirectional LSTM reads a vector of each block's path and of its hashed words, and labels every block with the whole page
as context: article, or anything around it. It is fitted here, in numpy, on a bounded sample of the pages themselves.
Blocks of pages with `<article>` or `<main>` label themselves; the same texts are also dealt into made-up layouts with other
elements and class names, so that the labels do not hang on one kind of markup.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm._common import SPACED_WORD, in_parts, span_hashes, text_bytes, words

#: Pages that the labeller is fitted on, at most, and the longest of them in characters; made-up layouts for each.
MAX_PAGES, MAX_PAGE_CHARS, LAYOUTS = 400, 100_000, 3
#: Sizes of the vectors of paths and of words, and of the state of each direction.
PATH_SIZE, WORD_SIZE, STATE = 192, 32, 12
#: Pages of a batch in fitting and passes over all of them.
BATCH, EPOCHS = 32, 8
#: Blocks that are labelled at once, about; one longer page is labelled alone.
BLOCKS_AT_ONCE = 8_192

# Elements that end a run of text, those without an end, and those whose content is not shown.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset(["hr"])
HIDDEN_TAGS = frozenset("script style title template noscript iframe svg".split())
#: Elements that a like one ends.
REPEATED_TAGS = frozenset("li dt dd td th tr option p".split())

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S
)
_NAMES = re.compile(r"""\b(class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WHITE = re.compile("[\x20\x09-\x0d]+")


# ---------------------------------------------------------------- blocks


@dataclass(frozen=True)
class Block:
    """A run of text: the elements around it, outermost first, as `tag.class#id`, and how much of it is links."""

    path: tuple[str, ...]
    text: str
    linked: float


@functools.lru_cache(maxsize=4096)
def _element(tag: str, attributes: str) -> str:
    named = [("." if kind.lower() == "class" else "#") + name.lower() for kind, names in _NAMES.findall(attributes) for name in names.strip("\"'").split()]
    return tag + "".join(named)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, with character references decoded and white space folded; empty ones left out."""
    page = page or ""
    found: list[Block] = []
    path: list[str] = []
    tags: list[str] = []
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text:
                found.append(Block(tuple(path), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    while at < len(page):
        match = _TAG.search(page, at)
        start = len(page) if match is None else match.start()
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        if match is None:
            break
        at = match.end()
        tag = match[2] or match[5]
        if not tag:
            continue
        tag, closes = tag.lower(), match[1] or match[4]
        if tag in HIDDEN_TAGS and not closes:
            # Up to its end tag, or to the end of the page.
            hidden = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = len(page) if hidden is None else hidden.end()
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closes
        elif tag in BLOCK_TAGS:
            end_block()
            if closes:
                if tag in tags:
                    keep = len(tags) - 1 - tags[::-1].index(tag)
                    del tags[keep:], path[keep:]
            else:
                if tags and (tags[-1] == "p" or tags[-1] == tag and tag in REPEATED_TAGS):
                    tags.pop(), path.pop()
                if tag not in VOID_TAGS:
                    tags.append(tag)
                    path.append(_element(tag, match[3] or match[6] or ""))
    end_block()
    return found


# ---------------------------------------------------------------- vectors

_STATISTICS = 7


@functools.lru_cache(maxsize=8192)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed elements and names of a path; those of the innermost two count on their own as well."""
    vector = np.zeros(PATH_SIZE, np.float32)
    for depth, element in enumerate(reversed(path)):
        tag, *names = re.split(r"[.#]", element)
        tokens = [tag, *names, *(part for name in names for part in re.split(r"[-_]+", name))]
        for token in [*tokens, *(f"{depth}:{t}" for t in tokens if depth < 2)]:
            code = zlib.crc32(token.encode())
            vector[[code % PATH_SIZE, code // PATH_SIZE % PATH_SIZE]] = 1
    return vector


def block_vectors(found: list[Block]) -> np.ndarray:
    """A vector of each block of a page: its path, its hashed words, and some statistics."""
    out = np.zeros((len(found), PATH_SIZE + WORD_SIZE + _STATISTICS), np.float32)
    if not found:
        return out
    data, offsets = text_bytes(pa.array([b.text for b in found]))
    starts, ends, first = words(data, offsets, SPACED_WORD)
    hashes = span_hashes(data, starts, ends, lowered=True)
    n = np.diff(first)
    row = np.repeat(np.arange(len(found)), n)
    sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
    cells = row * WORD_SIZE + (hashes % np.uint64(WORD_SIZE)).astype(np.int64)
    bags = np.bincount(cells, sign, len(found) * WORD_SIZE).reshape(-1, WORD_SIZE)
    # Of length one, whatever the words: a word that is repeated a hundred times weighs no more than others.
    out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = bags / np.maximum(1, np.linalg.norm(bags, axis=1))[:, None]
    for i, block in enumerate(found):
        out[i, :PATH_SIZE] = _path_vector(block.path)
        out[i, -_STATISTICS:] = (
            np.log1p(len(block.text)) / 5,
            np.log1p(n[i]) / 4,
            block.linked,
            block.text[-1] in ".!?",
            "\N{COPYRIGHT SIGN}" in block.text,
            i / len(found),
            len(block.path) / 8,
        )
    return out


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _direction(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = False):
    """States of one direction over [time, page, vector]; padded places leave the state as it is."""
    steps, pages, _ = x.shape
    size = u.shape[0]
    gates = x @ w + b
    h = c = np.zeros((pages, size), np.float32)
    states, kept = np.zeros((steps, pages, size), np.float32), []
    for t in range(steps):
        z = gates[t] + h @ u
        ifo, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
        i, f, o = ifo[:, :size], ifo[:, size : 2 * size], ifo[:, 2 * size :]
        m = mask[t][:, None]
        new_c = f * c + i * g
        squeezed = np.tanh(new_c)
        if keep:
            kept.append((h, c, i, f, o, g, squeezed, m))
        c = np.where(m, new_c, c)
        h = np.where(m, o * squeezed, h)
        states[t] = h
    return states, kept


def _direction_back(x: np.ndarray, u: np.ndarray, kept: list, errors: np.ndarray):
    """Gradients of one direction's weights, given those of its states."""
    steps, pages, _ = x.shape
    size = u.shape[0]
    dz_all = np.zeros((steps, pages, 4 * size), np.float32)
    du = np.zeros_like(u)
    dh = dc = np.zeros((pages, size), np.float32)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, squeezed, m = kept[t]
        dh = dh + errors[t]
        live_h, live_c = dh * m, dc * m
        dc_new = live_c + live_h * o * (1 - squeezed**2)
        dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), live_h * squeezed * o * (1 - o), dc_new * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh = dz @ u.T + dh * ~m
        dc = dc_new * f + dc * ~m
    flat = dz_all.reshape(-1, 4 * size)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[time, page, vector] of several pages, and which places are filled."""
    longest = max(len(p) for p in pages)
    x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(pages)), bool)
    for i, page in enumerate(pages):
        x[: len(page), i], mask[: len(page), i] = page, True
    return x, mask


class Labeller:
    """A bidirectional LSTM over the blocks of a page; its weights are a few ten thousand numbers."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + _STATISTICS
        self.weights: dict[str, np.ndarray] = {"out": np.zeros(2 * STATE, np.float32), "bias": np.zeros(1, np.float32)}
        for side in ("ahead", "back"):
            self.weights[f"w_{side}"] = rng.normal(0, size**-0.5, (size, 4 * STATE)).astype(np.float32)
            self.weights[f"u_{side}"] = rng.normal(0, STATE**-0.5, (STATE, 4 * STATE)).astype(np.float32)
            self.weights[f"b_{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), STATE)
        self.weights["out"] = rng.normal(0, 0.3, 2 * STATE).astype(np.float32)

    def _states(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        w = self.weights
        ahead = _direction(x, mask, w["w_ahead"], w["u_ahead"], w["b_ahead"], keep)
        back = _direction(x[::-1], mask[::-1], w["w_back"], w["u_back"], w["b_back"], keep)
        return ahead, back

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """How likely each block of each page is part of the article; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(len(p)) for p in pages]
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            taken = []
            while order and (not taken or 2 * len(pages[order[-1]]) >= longest and longest * len(taken) < BLOCKS_AT_ONCE):
                taken.append(order.pop())
            x, mask = _padded([pages[i] for i in taken])
            (ahead, _), (back, _) = self._states(x, mask)
            logits = np.concatenate([ahead, back[::-1]], axis=2) @ self.weights["out"] + self.weights["bias"]
            for column, i in enumerate(taken):
                out[i] = _sigmoid(logits[: len(pages[i]), column])
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], seed: int = 12) -> None:
        """Weights that tell the labels, by Adam over batches of pages."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(EPOCHS):
            # Pages of like length go together, the batches in any order.
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i]), rng.random()))
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            rng.shuffle(batches)
            for batch in batches:
                x, mask = _padded([pages[i] for i in batch])
                y = np.zeros(mask.shape, np.float32)
                for column, i in enumerate(batch):
                    y[: len(labels[i]), column] = labels[i]
                step += 1
                for name, gradient in self._gradients(x, mask, y).items():
                    first[name] += 0.1 * (gradient - first[name])
                    second[name] += 0.001 * (gradient**2 - second[name])
                    rate = 0.01 * (1 - epoch / EPOCHS)
                    move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.weights[name] = (self.weights[name] - rate * move).astype(np.float32)

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        (ahead, kept_ahead), (back, kept_back) = self._states(x, mask, keep=True)
        states = np.concatenate([ahead, back[::-1]], axis=2)
        p = _sigmoid(states @ self.weights["out"] + self.weights["bias"])
        error = ((p - y) * mask / max(1, mask.sum())).astype(np.float32)
        errors = error[:, :, None] * self.weights["out"]
        found = {"out": np.tensordot(error, states, 2), "bias": np.array([error.sum()], np.float32)}
        sides = (("ahead", x, kept_ahead, errors[:, :, :STATE]), ("back", x[::-1], kept_back, errors[::-1, :, STATE:]))
        for side, seen, kept, own in sides:
            found[f"w_{side}"], found[f"u_{side}"], found[f"b_{side}"] = _direction_back(seen, self.weights[f"u_{side}"], kept, own)
        return found


# ---------------------------------------------------------------- what it learns from

# Elements and names that tell what a block is; of the layouts that are made up, and of the labels.
ARTICLE_PLACES = (
    "article", "main", "article.post", "div.content", "div.entry-content", "div.article-body", "div.post", "section.story", "div#main", "div.text", "main article", "div.post-content", "section.content",
)
ARTICLE_ITEMS = ("p", "p", "p", "p", "h2", "h3", "blockquote", "ul li", "ol li", "pre", "table tr td", "div", "section p", "div p")
OTHER_PLACES = {
    "menu": ("nav ul li", "nav", "div.menu ul li", "ul.nav li", "div.navbar", "div.breadcrumb", "nav.main-nav ul li", "div#menu ul li", "menu li"),
    "header": ("header", "header.site-header", "div.header", "div#header", "div.masthead p", "header p"),
    "footer": ("footer", "div.footer", "div#footer p", "footer.site-footer p", "div.copyright", "footer p"),
    "sidebar": ("aside", "aside.sidebar p", "div.sidebar", "div#sidebar ul li", "div.widget p", "section.related ul li", "div.related", "aside p", "aside ul li"),
    "notice": ("div.notice", "div.cookie-banner", "div.alert p", "div.consent p", "section.notice p", "p.notice", "div.cookies", "div.disclaimer", "dialog p"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.advertisement p", "div.sponsored p", "aside.ad", "div.promo", "section.banner p", "div.ad-slot"),
    "form": ("form", "form p", "form.newsletter p", "div.subscribe", "form.search", "form fieldset", "form button", "form select option", "div.signup p", "form fieldset legend"),
    "comments": ("section.comments p", "div.comments div.comment p", "div#comments p", "ol.comment-list li.comment", "section#comments article.comment p", "div.comment-body p", "ul.comments li", "section.comments h3"),
    "share": ("div.share", "div.social ul li", "div.tags", "div.pagination", "div.share-buttons", "div.pager"),
}
_OTHER_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "menu", "dialog"])
_OTHER_NAMES = frozenset(
    "ad ads advert advertisement alert banner breadcrumb comment comments consent cookie cookies copyright disclaimer footer masthead menu nav navbar newsletter "
    "notice pager pagination promo related share sidebar signup social sponsored subscribe tags widget".split()
)


def own_labels(found: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article: inside it, and not inside what is marked otherwise; None for other pages."""

    def label(path: tuple[str, ...]) -> int:
        inside = False
        for element in path:
            tag, *names = re.split(r"[.#]", element)
            if tag in _OTHER_TAGS or any(part in _OTHER_NAMES for name in names for part in re.split(r"[-_]+", name)):
                return 0
            inside = inside or tag in ("article", "main")
        return int(inside)

    labels = np.array([label(b.path) for b in found], np.float32)
    return labels if labels.any() else None


def made_up(rng: np.random.Generator, article: list[str], others: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page of a made-up layout: the article's texts and texts from around it, in random places, with their labels."""
    out: list[tuple[Block, int]] = []
    pick = lambda options: options[rng.integers(len(options))]
    around = [*pick((("html", "body"), ("html", "body"), ("body",), ())), *pick(((), ("div.wrapper",), ("div#page", "div.container"), ("div",)))]

    def unnamed(place: list[str]) -> list[str]:
        # Some names are no known ones, so that texts and neighbours must tell.
        return [re.sub(r"([.#])[^.#]+", lambda m: f"{m[1]}x{rng.integers(1000)}", e) if rng.random() < 0.15 else e for e in place]

    def region(kind: str, inside: list[str]) -> None:
        place = unnamed(pick(OTHER_PLACES[kind]).split())
        for _ in range(rng.integers(1, 8 if kind in ("menu", "comments", "sidebar") else 3)):
            text = pick(article) if kind == "comments" or kind in ("notice", "advert", "sidebar") and rng.random() < 0.4 else pick(others)
            linked = float(rng.random() < (0.8 if kind in ("menu", "share") else 0.3))
            out.append((Block((*inside, *place), text, linked), 0))

    for kind in ("notice", "header", "menu", "advert"):
        if rng.random() < 0.5:
            region(kind, around)
    if rng.random() < 0.2:
        region("sidebar", around)
    holder = [*around, *unnamed(pick(ARTICLE_PLACES).split())]
    out.append((Block((*holder, pick(("h1", "h1", "h2"))), pick(article)[:80].strip() or "x", 0.0), 1))
    for text in article:
        item = pick(ARTICLE_ITEMS) if rng.random() < 0.4 else "p"
        out.append((Block((*holder, *item.split()), text, float(rng.random() < 0.1) * rng.random()), 1))
        if rng.random() < 0.06:
            region(pick(("advert", "notice", "sidebar", "form", "share")), holder)
    if rng.random() < 0.2:
        region("comments", holder)
    for kind in ("share", "comments", "form", "sidebar", "advert", "menu", "footer"):
        if rng.random() < 0.4:
            region(kind, around)
    return [b for b, _ in out], np.array([label for _, label in out], np.float32)


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> Labeller:
    """A labeller fitted on at most `max_pages` pages of up to MAX_PAGE_CHARS characters, chosen by a hash of the id.

    Pages that mark no article teach nothing; without any that does, the layouts are filled with made-up words.
    """
    usable = pages.where(F.col("html").isNotNull() & (F.length("html") <= MAX_PAGE_CHARS))
    sample = usable.select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(max_pages).toArrow()
    rng = np.random.default_rng(13)
    known = [(found, labels) for found in map(blocks, sample["html"].to_pylist()) if (labels := own_labels(found)) is not None]
    articles = [[b.text for b, label in zip(found, labels, strict=True) if label] for found, labels in known]
    others = [b.text for found, labels in known for b, label in zip(found, labels, strict=True) if not label]
    if not known:
        word = lambda: "".join(rng.choice(list("abdeilmnorst"), rng.integers(2, 9)))
        articles = [[" ".join(word() for _ in range(rng.integers(3, 60))).capitalize() + "." for _ in range(rng.integers(1, 12))] for _ in range(100)]
    others = others or ["Home", "About us", "Contact", "\N{COPYRIGHT SIGN} all rights reserved", "Share"]
    # Texts of a few blocks stand for those of a very long article.
    layouts = [made_up(rng, article[:40], others) for article in articles for _ in range(LAYOUTS)]
    examples = [(block_vectors(found), labels) for found, labels in [*known, *layouts]]
    labeller = Labeller()
    labeller.fit([x for x, _ in examples], [y for _, y in examples])
    return labeller


# ---------------------------------------------------------------- pages


def _labelled(batches: Iterator[pa.RecordBatch], labeller: Labeller) -> Iterator[tuple[pa.RecordBatch, list[list[Block]], list[np.ndarray]]]:
    for batch in in_parts(batches, 200):
        found = [blocks(page) for page in batch.column("html").to_pylist()]
        yield batch, found, labeller.scores([block_vectors(f) for f in found])


def label_blocks(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, block, path, text, score) of every block of every page: how likely it is part of the article.

    Null and empty pages, and pages without text, have no rows. Rows that repeat a page_id, and those without one, each have
    their own. Other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, scores in _labelled(batches, labeller):
            ids = batch.column("page_id").to_pylist()
            told = [(i, n, "/".join(b.path), b.text, float(s)) for i, f, own in zip(ids, found, scores, strict=True) for n, (b, s) in enumerate(zip(f, own, strict=True))]
            columns = zip(*told, strict=True) if told else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "block", "path", "text", "score"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    return source.mapInArrow(rows, "page_id long, block long, path string, text string, score double")


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: the blocks of its article, a line each, and their code points.

    Character references are decoded and white space in a block becomes one space. Null and empty pages, and pages without
    an article, have an empty text. Rows that repeat a page_id, and those without one, each have their own row. Pages are
    read whole, whatever their length. Other columns are ignored; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, scores in _labelled(batches, labeller):
            texts = ["\n".join(b.text for b, s in zip(f, own, strict=True) if s >= 0.5) for f, own in zip(found, scores, strict=True)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return source.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
