"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its blocks: runs of text between tags that break
lines, each with the path of open tags (names, classes, ids, roles) that it is in and
the box (the innermost element that holds blocks) it stands in. A bidirectional LSTM in
numpy reads, for each block, the hashed path, hashed words and a few measures, also of
its box, and says of every block in the light of the whole page whether it belongs to
the article.

No table has labels for blocks, so the network learns from pages of the table itself.
Pages that speak for themselves are labelled by the names in their paths (``CONTENT``,
``OTHER``). Outside an article any such name speaks against a block; inside one only those
of comments, forms, adverts and menus do (``WITHIN``), and others (``related``, ``tags``) only
with a second sign, that the block is mostly links. Compound names count as a whole; their
parts speak outside an article only. Pages without such names are labelled by what their
blocks are: the box of the first main heading, or else the one with most text outside links,
is the article, but for lists of links; menus, short lines and lines that other pages have
as well are not, elsewhere; the rest is left out of the loss, as are blocks whose names say
nothing.

Training pages are varied: most lose their telling names (containers become neutral
elements with random names, the labels stay), so that the network has to tell an article by
its blocks, their boxes and their neighbours; others have names exchanged for others of
their kind; boilerplate blocks of other pages are put in, and parts of articles get boxes
under names that say nothing there. A page in neutral containers is read the same way.

Null and empty pages have no blocks and an empty text. Unclosed tags, comments, stray
closing tags and odd quotes are read as browsers read them, near enough. Pages of any
length are read in whole; memory follows the longest page alone. Repeated rows and ties
give repeated results, a column of the output's name gives way, and a table without
rows, or without a page that has any text, gives empty results.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.llm._arrow import append_columns, slices, texts_of

#: What follows a tag's name: attributes with quoted, unquoted or no value, as HTML reads them.
ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"
#: Comments; elements whose content is no text of the page; tags; declarations.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|textarea|select|noembed|noframes)(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<svg(?=[\s/>]){ATTRIBUTES}(?:(?<=/)>|>.*?(?:</svg\s*>|\Z))|<(/?)([a-z][^\s/>]*)({ATTRIBUTES})>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+")
PARTS = re.compile(r"[-_]+")
#: Tags that stay within a line, and tags without an end.
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names in a path that speak for or against a block.
CONTENT = frozenset("article main content post entry story body-text post-content entry-content article-body main-content".split())
OTHER = frozenset(
    "head nav header footer aside form button ad ads advert advertisement banner sponsor promo menu navbar breadcrumb breadcrumbs sidebar side "
    "widget cookie cookies notice alert popup modal newsletter subscribe login search comment comments reply replies respond discussion disqus share "
    "social related recommended pagination pager tags copyright legal noscript".split()
)
#: Names that speak for an article itself, not for a frame that may hold more.
ARTICLE = CONTENT - {"main", "content", "main-content"}
#: Names that also speak against a block inside an article, and those whose parts of compound names do.
WITHIN = frozenset(
    "form button noscript ad ads advert advertisement banner sponsor promo nav menu navbar breadcrumb breadcrumbs pagination pager aside sidebar footer cookie cookies notice alert popup modal "
    "newsletter subscribe login search comment comments reply replies respond discussion disqus".split()
)
REMARKS = frozenset("comment comments disqus ad ads advert advertisement".split())
#: What goes before the parts of a compound name in a path.
PART = "~"
#: Share of a block's characters in links from which a name that says little inside an article speaks against it.
MOSTLY_LINKS = 0.5
#: Elements that are blocks of text and not boxes of such, and telling names that are elements.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption table thead tbody tfoot tr td th caption address details summary".split())
ELEMENTS = frozenset("article main nav header footer aside".split())
#: Telling names that stay when a page is made neutral: there is no other element for these.
KEPT_NAMES = frozenset("head form button noscript".split())
PATH_BITS, WORD_BITS, MEASURES = 1024, 32, 11
INPUT, HIDDEN = PATH_BITS + WORD_BITS + MEASURES, 16
#: What a name on a block's path counts for, beside measures of about 1.
NAME = 3.0
#: Training: pages sampled, passes, pages a step, step size.
PAGES, EPOCHS, PAGES_A_STEP, RATE = 200, 32, 8, 0.015
#: Pages that do not speak for themselves, and characters of the longest page, that are taken to fit the network.
SILENT_PAGES, LONGEST_PAGE = 120, 200_000
#: Pages of the sample that must have a line for it to be a common one; words of a line that is short.
COMMON_PAGES, SHORT_LINE = 3, 8
#: Blocks (with filling) that are labelled at a time, but at least one page.
BLOCKS_AT_ONCE = 1 << 15

Block = tuple[str, tuple[str, ...], int, int]  # text, path, characters inside links, box
Labelled = tuple[Block, int]


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    held: list[str] = []
    linked = anchors = at = 0

    def flush() -> None:
        nonlocal held, linked
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        if text:
            path = tuple(w for s in stack if s[0] not in INLINE for w in s[1])
            box = next((s[2] for s in reversed(stack) if s[0] not in INLINE and s[0] not in TEXTUAL), -1)
            out.append((text, path, min(linked, len(text)), box))
        held, linked = [], 0

    def close(k: int) -> None:
        nonlocal anchors
        anchors -= sum(s[0] == "a" for s in stack[k:])
        del stack[k:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            held.append(piece)
            if anchors:
                linked += len(piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if m[2]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None and tag in INLINE:
                # Blocks that began inside stay open.
                anchors -= tag == "a"
                del stack[k]
            elif k is not None:
                close(k)
            continue
        if tag not in INLINE:
            # A new block ends an open paragraph; a list item or cell ends the one before it.
            ends = ("p", tag) if tag in ("li", "td", "th", "tr", "dt", "dd", "option") else ("p",)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        stack.append((tag, (tag, *names_of(m[4])), m.start()))
        anchors += tag == "a"
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def names_of(attributes: str) -> list[str]:
    """The words of a tag's class, id and role, in lower case; of compound ones (``cookie-notice``) the parts too, marked as such."""
    if not attributes or attributes.isspace():
        return []
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role") and m[2]:
            found.setdefault(name, m[2].strip("\"'").lower())  # the first of a name counts
    words = [w for value in found.values() for w in value.split()]
    return [x for w in words for x in dict.fromkeys((w, *(PART + part for part in PARTS.split(w) if part and part != w)))]


class Hashed(dict):
    """Words to numbers below ``size``, known ones to a number of their own; keeps those it saw first, up to a bound."""

    def __init__(self, size: int, known: list[str] = ()):
        super().__init__({w: k for k, w in enumerate(known)})
        self.size, self.known = size, len(known)

    def __missing__(self, word: str) -> int:
        code = self.known + zlib.crc32(word.encode("utf-8", "replace")) % (self.size - self.known)
        if len(self) < 200_000:
            self[word] = code
        return code


PATH_CODES, WORD_CODES = Hashed(PATH_BITS, sorted(CONTENT | OTHER | TEXTUAL | {PART + w for w in OTHER} | {"html", "body", "div", "section"})), Hashed(WORD_BITS)


class Paths(dict):
    """Paths to the different numbers of their names; keeps those it saw first, up to a bound."""

    def __missing__(self, path: tuple[str, ...]) -> tuple[int, ...]:
        codes = tuple(dict.fromkeys(map(PATH_CODES.__getitem__, path)))
        if len(self) < 20_000 and len(path) < 100:
            self[path] = codes
        return codes


CODES_OF_PATHS = Paths()


class Features(NamedTuple):
    """What is known of a page's blocks: the numbers of the names on each one's path, and a row of words and measures in half precision."""

    paths: list[tuple[int, ...]]
    rest: np.ndarray


def features_of(blocks: list[Block]) -> Features:
    """One entry for each block."""
    if not blocks:
        return Features([], np.zeros((0, INPUT - PATH_BITS), np.float16))
    sizes, counts, heads = {}, {}, set()
    for text, path, linked, box in blocks:
        sizes[box] = sizes.get(box, 0) + len(text) - linked
        counts[box] = counts.get(box, 0) + 1
        if path and path[-1] == "h1":
            heads.add(box)
    whole, last = max(1, sum(sizes.values())), max(1, len(blocks) - 1)
    words, n_words, measures = [], [], []
    for i, (text, path, linked, box) in enumerate(blocks):
        said = text.split()
        words += map(WORD_CODES.__getitem__, said)
        n_words.append(len(said))
        measures.append((
            min(len(said), 400) ** 0.5 / 10, linked / len(text), sum(map(text.count, ".,;!?")) / len(said),
            i / last, 1.0, sizes[box] / whole, min(counts[box], 50) ** 0.5 / 5, box in heads,
            i > 0 and blocks[i - 1][3] == box, i + 1 < len(blocks) and blocks[i + 1][3] == box, len(path) > 0 and path[-1] in TEXTUAL,
        ))
    n = len(blocks)
    rest = np.empty((n, WORD_BITS + MEASURES), np.float16)
    codes = np.bincount(np.repeat(np.arange(n), n_words) * WORD_BITS + np.array(words, np.int64), minlength=n * WORD_BITS).reshape(n, WORD_BITS)
    rest[:, :WORD_BITS] = np.sqrt(codes / np.array(n_words)[:, None])
    rest[:, WORD_BITS:] = np.array(measures, np.float32)
    return Features([CODES_OF_PATHS[b[1]] for b in blocks], rest)


def marked(paths: list[tuple[int, ...]]) -> np.ndarray:
    """A row for each path, with ``NAME`` at the numbers of its names."""
    x = np.zeros((len(paths), PATH_BITS), np.float32)
    x[np.repeat(np.arange(len(paths)), [len(c) for c in paths]), np.array([k for c in paths for k in c], np.int64)] = NAME
    return x


def new_params(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for way in ("f", "b"):
        p[way + "x"] = (rng.standard_normal((INPUT, 4 * HIDDEN)) * 0.1).astype(np.float32)
        p[way + "h"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
        p[way + "c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    p["out"] = (rng.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
    p["own"] = np.zeros(INPUT, np.float32)
    # What names say before the pages do.
    for names, weight in ((ARTICLE, 0.5), (OTHER - WITHIN, -0.5), (WITHIN, -3.0), ({PART + w for w in OTHER - REMARKS}, -0.5), ({PART + w for w in REMARKS}, -3.0)):
        p["own"][[PATH_CODES[w] for w in names]] = weight
    p["bias"] = np.zeros(1, np.float32)
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w in single precision, some rows at a time."""
    flat = x.reshape(-1, INPUT)
    parts = [np.asarray(flat[a : a + 8192], w.dtype) @ w for a in range(0, len(flat), 8192)]
    return np.concatenate(parts).reshape(*x.shape[:-1], *w.shape[1:])


def run_way(p: dict, way: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, page, HIDDEN) of one direction, and what its gradient needs. x: (time, page, INPUT)."""
    return run_steps(p, way, product(x, p[way + "x"]), mask)


def run_steps(p: dict, way: str, z_x: np.ndarray, mask: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """As ``run_way``, from products of blocks and weights (time, page, 4 * HIDDEN); without ``keep`` nothing for a gradient."""
    steps, pages = z_x.shape[:2]
    z_x = z_x + p[way + "c"]
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        z = z_x[t] + h @ p[way + "h"]
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        m = mask[t][:, None]
        if keep:
            kept.append((t, h, c, i, f, o, g, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, new_c, c)
        out[t] = h
    return out, kept


def back_way(p: dict, way: str, x: np.ndarray, kept: list, d_out: np.ndarray) -> dict:
    pages = x.shape[1]
    d_h, d_c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    d_z = np.zeros((x.shape[0], pages, 4 * HIDDEN), np.float32)
    g_h = np.zeros_like(p[way + "h"])
    for t, h, c, i, f, o, g, tc, m in reversed(kept):
        dh = d_h + d_out[t]
        live = dh * m
        dc = d_c * m + live * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), live * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        d_z[t] = dz
        g_h += h.T @ dz
        d_h, d_c = np.where(m, dz @ p[way + "h"].T, dh), np.where(m, dc * f, d_c)
    flat = d_z.reshape(-1, 4 * HIDDEN)
    return {way + "x": x.reshape(-1, INPUT).T @ flat, way + "h": g_h, way + "c": flat.sum(0)}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pages side by side as (time, page, columns), and which of that is no filling."""
    steps = max(len(x) for x in pages)
    if len(pages) == 1:
        return pages[0][:, None], np.ones((steps, 1), bool)
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), pages[0].dtype), np.zeros((steps, len(pages)), bool)
    for k, one in enumerate(pages):
        x[: len(one), k], mask[: len(one), k] = one, True
    return x, mask


def products(weights: np.ndarray, pages: list[Features]) -> list[np.ndarray]:
    """Blocks of pages times the weights of their features; a path is multiplied once, whatever the number of blocks on it."""
    met: dict[tuple[int, ...], int] = {}
    at = np.array([met.setdefault(c, len(met)) for page in pages for c in page.paths], np.int64)
    paths = list(met)
    of_paths = np.concatenate([marked(paths[a : a + 1024]) @ weights[:PATH_BITS] for a in range(0, len(paths), 1024)])
    out = np.concatenate([x.rest for x in pages]).astype(np.float32) @ weights[PATH_BITS:]
    for a in range(0, len(at), 8192):
        out[a : a + 8192] += of_paths[at[a : a + 8192]]
    return np.split(out, np.cumsum([len(x.paths) for x in pages])[:-1])


def label_pages(p: dict, pages: list[Features], at_once: int = BLOCKS_AT_ONCE) -> list[np.ndarray]:
    """The probability of each block of each page to belong to the article."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    sizes = [len(x.paths) for x in pages]
    some = sorted((k for k, n in enumerate(sizes) if n), key=sizes.__getitem__)
    weights = np.column_stack([p["fx"], p["bx"], p["own"]])
    while some:
        ids = [some.pop()]
        while some and (len(ids) + 1) * sizes[ids[0]] <= at_once:
            ids.append(some.pop())
        z, mask = padded(products(weights, [pages[k] for k in ids]))
        both = np.concatenate([run_steps(p, way, z[:, :, a : a + 4 * HIDDEN], mask, keep=False)[0] for way, a in (("f", 0), ("b", 4 * HIDDEN))], axis=2)
        prob = sigmoid(both @ p["out"] + z[:, :, -1] + p["bias"][0])
        for n, k in enumerate(ids):
            out[k] = prob[: sizes[k], n]
    return out


def spoken_label(block: Block) -> int:
    """1 where a block's path speaks for the article, 0 where it speaks against it (as comments or forms in it do), else -1."""
    text, path, linked, _ = block
    whole = [w for w in path if not w.startswith(PART)]
    inside = next((k for k in range(len(path) - 1, -1, -1) if path[k] in ARTICLE), None)
    if inside is not None:
        after = path[inside + 1 :]
        if any(w in OTHER for w in path[:inside]) or any(w in WITHIN or w[: len(PART)] == PART and w[len(PART) :] in REMARKS for w in after):
            return 0
        return 0 if linked >= MOSTLY_LINKS * len(text) and any(w in OTHER for w in after) else 1
    if any(w in OTHER for w in whole):
        return 0
    said = any(w.removeprefix(PART) in OTHER for w in path)
    return (-1 if said else 1) if any(w in CONTENT for w in whole) else 0 if said else -1


def seeded_labels(blocks: list[Block], common: set[str]) -> list[int]:
    """Labels of a page without telling names by what its blocks are; ``common``: lines that several pages have. All -1 where nothing tells."""
    free: dict[int, int] = {}
    for text, path, linked, box in blocks:
        if "head" not in path and text not in common:
            free[box] = free.get(box, 0) + len(text) - linked
    first = next((box for text, path, _, box in blocks if path and path[-1] == "h1" and box in free), None)
    most = max(free, key=free.get, default=None)
    # A heading's box may hold the heading alone.
    main = first if first is not None and 4 * free[first] >= free[most] else most
    if main is None or first is None and free[main] < 40 * SHORT_LINE:
        return [-1] * len(blocks)
    out = []
    for text, path, linked, box in blocks:
        links = linked >= MOSTLY_LINKS * len(text)
        if "head" in path or links:
            out.append(0)
        elif box == main:
            out.append(1)
        else:
            out.append(0 if text in common or len(text.split()) < SHORT_LINE or len(text) < free[main] / 20 else -1)
    return out


def labelled_pages(pages: list[list[Block]]) -> list[list[Labelled]]:
    """Pages with labels of their blocks: by names where those speak for an article, else by what blocks are. Pages that neither tells are left out."""
    met = Counter(text for page in pages for text in {b[0] for b in page})
    common = {text for text, n in met.items() if n >= COMMON_PAGES}
    out = []
    for page in pages:
        labels = [spoken_label(b) for b in page]
        if 1 not in labels:
            labels = seeded_labels(page, common)
        if 1 in labels:
            out.append(list(zip(page, labels)))
    return out


def neutral(page: list[Labelled], rng: np.random.Generator, hidden: frozenset[str]) -> list[Labelled]:
    """The page without some telling names: elements become ``div``, other names a random one each, or none."""
    names: dict[str, tuple[str, ...]] = {}

    def other(w: str) -> tuple[str, ...]:
        if w in KEPT_NAMES or w.removeprefix(PART) not in hidden:
            return (w,)
        if w not in names:
            drawn = (f"k{rng.integers(1 << 30)}",) if rng.random() < 0.6 else ()
            names[w] = (("div" if rng.random() < 0.7 else "section"), *drawn) if w in ELEMENTS else drawn
        return names[w]

    return [((text, tuple(y for w in path for y in other(w)), linked, box), label) for (text, path, linked, box), label in page]


def terse(block: Block, rng: np.random.Generator) -> list[Block]:
    """A block as it is, or sometimes its first words, or those several times."""
    if rng.random() < 0.6:
        return [block]
    text, path, linked, box = block
    short = " ".join(text.split()[: rng.integers(1, 6)])
    return [(short, path, min(linked, len(short)), box)] * int(rng.choice([1, 1, 2, 8]))


def renamed(page: list[Labelled], rng: np.random.Generator) -> list[Labelled]:
    """The page with another name of its kind for its article."""
    name = sorted(CONTENT)[rng.integers(len(CONTENT))]
    new = ("div", name) if rng.random() < 0.9 else (name,)
    return [((text, tuple(y for w in path for y in (new if w in ("article", "main") else (w,))), linked, box), label) for (text, path, linked, box), label in page]


def with_boilerplate(page: list[Labelled], pages: list[list[Block]], rng: np.random.Generator, named: bool) -> list[Labelled]:
    """The page with a box of blocks of other pages under a name that speaks against it, perhaps with a heading of its own.

    Where the name will not be seen (``named``), the box stands outside the article and mostly holds links or short lines.
    """
    inside = next((p[: p.index(w) + 1] for (_, p, _, _), _ in page for w in p if w in CONTENT), None)
    outer = ("html", "body") if not named or inside is None or rng.random() < 0.6 else inside
    names = sorted(OTHER if outer != inside else WITHIN)
    name = names[rng.integers(len(names))]
    tag = () if name in ELEMENTS or name in KEPT_NAMES else ("div",) if rng.random() < 0.7 else ("section",)
    compound = tag and rng.random() < 0.4 and (outer != inside or name in REMARKS)
    path, leaf = (*outer, *tag, *((f"{name}-k{rng.integers(1 << 20)}", PART + name) if compound else (name,))), [("p",), (), ("ul", "li"), ("div",)][rng.integers(4)]
    linked = rng.random() < (0.3 if named else 0.5)
    brief = not named and rng.random() < 0.8
    box = -2 - int(rng.integers(1 << 30))
    added = []
    for k in range(rng.integers(1, 7)):
        source = pages[rng.integers(len(pages))]
        text = source[rng.integers(len(source))][0]
        heading = k == 0 and rng.random() < 0.4
        if heading or brief or rng.random() < 0.3:
            text = " ".join(text.split()[: rng.integers(1, 7)])
        added.append(((text, (*path, f"h{rng.integers(2, 5)}") if heading else path + leaf, len(text) if linked and not heading else 0, box), 0))
    borders = [k for k in range(len(page) + 1) if k in (0, len(page)) or page[k][0][3] != page[k - 1][0][3]]
    at = int(rng.integers(len(page) + 1)) if named and rng.random() < 0.3 else borders[rng.integers(len(borders))]
    return page[:at] + added + page[at:]


def with_section(page: list[Labelled], rng: np.random.Generator) -> list[Labelled]:
    """The page with some consecutive blocks of its article in a box of their own, under a name that says nothing there."""
    article = [k for k, (_, label) in enumerate(page) if label == 1]
    a, n = article[rng.integers(len(article))], int(rng.integers(1, 6))
    vague = sorted(OTHER - WITHIN - ELEMENTS - KEPT_NAMES)
    name = vague[rng.integers(len(vague))]
    names = (f"{name}-k{rng.integers(1 << 20)}", PART + name) if rng.random() < 0.5 else (name,)
    box = -2 - int(rng.integers(1 << 30))
    out = list(page)
    for k in range(a, min(a + n, len(page))):
        (text, path, linked, _), label = page[k]
        if label != 1:
            break
        out[k] = ((text, (*path[:-1], "section", *names, *path[-1:]), linked, box), 1)
    return out


def varied(labelled: list[Labelled], pages: list[list[Block]], rng: np.random.Generator) -> list[Labelled]:
    """A page like this one, with labels."""
    page, way = labelled, rng.random()
    named = way < 0.7
    if rng.random() < 0.4:
        # Articles also hold short lines, and the same line many times over.
        page = [(t, label) for b, label in page for t in terse(b, rng)]
    if rng.random() < 0.3:
        # Some articles are in several boxes.
        page = [((*b[:3], b[3] * 8 + int(rng.integers(2)) + 1) if label == 1 else b, label) for b, label in page]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        page = with_section(page, rng)
    if rng.random() < 0.8:
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            page = with_boilerplate(page, pages, rng, named)
    if way < 0.4:
        return renamed(page, rng) if way < 0.2 else page
    return neutral(page, rng, CONTENT if named else CONTENT | OTHER)


def fit(pages: list[str], epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """Fit the labeller on variations of the sampled pages, by Adam."""
    p, rng = new_params(seed), np.random.default_rng(seed)
    labelled = labelled_pages([b for b in map(blocks_of, pages) if b])
    read = [[b for b, _ in page] for page in labelled]
    if not read:
        return p | {"out": p["out"] * 0, "bias": p["bias"] - 1}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 5e-4
        order = rng.permutation(len(read))
        for a in range(0, len(order), PAGES_A_STEP):
            chosen = [varied(labelled[k], read, rng) for k in order[a : a + PAGES_A_STEP]]
            known = [features_of([b for b, _ in page]) for page in chosen]
            x, mask = padded([np.column_stack([marked(one.paths), one.rest]) for one in known])
            y = np.zeros(mask.shape, np.float32)
            for k, page in enumerate(chosen):
                y[: len(page), k] = [label for _, label in page]
            step += 1
            for k, g in gradients(p, x, mask, np.maximum(y, 0), (y >= 0) & mask).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                # The weights of single names count on few blocks of a step; they move faster.
                p[k] -= (rate * (4 if k == "own" else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, counts: np.ndarray) -> dict:
    """Gradients of the mean log loss over the blocks that count."""
    (f, kept_f), (b, kept_b) = run_way(p, "f", x, mask), run_way(p, "b", x, mask)
    both = np.concatenate([f, b], axis=2)
    d = ((sigmoid(both @ p["out"] + product(x, p["own"]) + p["bias"][0]) - y) * counts / max(1, counts.sum())).astype(np.float32)
    d_both = d[:, :, None] * p["out"]
    out = back_way(p, "f", x, kept_f, d_both[:, :, :HIDDEN]) | back_way(p, "b", x, kept_b, d_both[:, :, HIDDEN:])
    return out | {"out": np.einsum("tph,tp->h", both, d), "own": np.einsum("tpi,tp->i", x, d), "bias": d.sum(keepdims=True).reshape(1)}


def sample_pages(pages: DataFrame, rows: int = PAGES, silent: int = SILENT_PAGES) -> list[str]:
    """Pages to fit on: ``rows`` at most that may speak for themselves and ``silent`` of the others, of ``LONGEST_PAGE`` characters at most.

    Those with the smallest hashes of their page_id, one of each.
    """
    speaks = F.col("html").rlike("(?i)(<(article|main)[\\s>/])|((class|id|role)\\s*=[^>]*(" + "|".join(sorted(CONTENT)) + "))")
    usable = pages.where(F.col("page_id").isNotNull() & (F.length("html") <= LONGEST_PAGE) & (F.length("html") > 0)).select("page_id", "html", speaks.alias("speaks"))
    chosen = [usable.where(F.col("speaks") == kind).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(n) for kind, n in ((True, rows), (False, silent))]
    listed = F.broadcast(chosen[0].union(chosen[1]).distinct())
    got = usable.join(listed, "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").toArrow()
    return texts_of(got["html"].combine_chunks())


def extract(pages: DataFrame, params: dict[str, np.ndarray], html: str = "html", output: str = "text") -> DataFrame:
    """``pages`` with the main text of each, blocks joined by line feeds."""

    def make():
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            pages, out = texts_of(columns[0]), []
            for a, b in slices(pages):
                read = [blocks_of(t) for t in pages[a:b]]
                found = label_pages(params, [features_of(x) for x in read])
                out += ["\n".join(x[0] for x, y in zip(page, prob) if y >= 0.5) for page, prob in zip(read, found)]
            return [pa.array(out, pa.string())]

        return work

    return append_columns(pages, [html], T.StructType([T.StructField(output, T.StringType())]), make)
