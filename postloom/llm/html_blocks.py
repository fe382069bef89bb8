"""HTML pages as sequences of text blocks, and blocks as numbers."""

from __future__ import annotations

import html
import re
import sys
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A quote counts where a value begins, and only if it is closed.  Nothing is tried twice (possessive).
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|\Z)",
    re.DOTALL,
)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DIGIT = re.compile(r"\d")
WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset("script style".split())
HIDDEN = CODE | frozenset("template title iframe".split())
# The void elements that separate words.
BREAKS = frozenset("br hr".split())
# Innermost elements a path holds.
DEEPEST = 64
# These stand for what they hold, so paths leave them out.
TRANSPARENT = frozenset("noscript object".split())
# Drawings and formulas: only their elements may close themselves by a slash.
FOREIGN = frozenset("svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle mfenced "
    "mmultiscripts mprescripts mpadded mphantom mspace merror menclose semantics annotation".split()
)
CLOSED_BY_BLOCK = frozenset(("p",))
CLOSED_BY_ITSELF = frozenset("li dt dd tr td th option p".split())

PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 96, 32, 8
DIMS = PATH_DIMS + WORD_DIMS + SHAPE_DIMS


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]  # of each open element: its tag and the words of its names
    text: str
    linked: int  # characters within links


def names_of(tag: str, rest: str) -> tuple[str, ...]:
    found = [tag]
    for groups in NAMES.findall(rest):
        found += [w.lower() for w in WORDS_OF_NAME.findall("".join(groups))]
    return tuple(found)


EDGES = {tag: re.compile(rf"<(/?){tag}\b[^>]*+(?:>|\Z)", re.I) for tag in HIDDEN}


class Ends:
    """Where hidden elements of a page are over; every tag of them is looked for once."""

    def __init__(self, page: str):
        self.page = page
        self.none: set[str] = set()  # tags without a further end
        self.templates: dict[int, int] | None = None

    def after(self, tag: str, start: int, at: int) -> int | None:
        """End of the element whose start tag lies from ``start`` to ``at``; None if it is not closed."""
        if tag == "template":  # they may hold templates
            if self.templates is None:
                self.templates, open_at = {}, []
                for edge in EDGES[tag].finditer(self.page):
                    if not edge[1]:
                        open_at.append(edge.start())
                    elif open_at:
                        self.templates[open_at.pop()] = edge.end()
            return self.templates.get(start)
        if tag in self.none:
            return None
        for edge in EDGES[tag].finditer(self.page, at):
            if edge[1]:
                return edge.end()
        self.none.add(tag)
        return None


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks in page order: character references decoded, white space as one space, trimmed."""
    page = page or ""
    ends = Ends(page)
    stack: list[tuple[str, ...]] = []
    blocks: list[int] = []  # places in the stack of what is not inline
    outer: list[tuple[str, ...]] = []  # of these, what paths hold
    opened: dict[str, int] = {}  # open elements by tag
    found: list[Block] = []
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = tuple(outer[-DEEPEST:])
                if linked * 2 > len(text):
                    path += (("a",),)
                found.append(Block(path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(index: int) -> None:
        while len(stack) > index:
            tag = stack.pop()[0]
            opened[tag] -= 1
            if tag not in INLINE:
                blocks.pop()
                if tag not in TRANSPARENT:
                    outer.pop()

    def text(start: int, end: int) -> None:
        nonlocal linked
        if end > start:
            piece = page[start:end]
            parts.append(piece)
            if opened.get("a"):
                linked += len(piece.strip())

    search = TOKEN.search
    while True:
        token = search(page, at)
        if token is None:
            text(at, len(page))
            break
        text(at, token.start())
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"]:
            if tag not in INLINE:
                flush()
            if opened.get(tag):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        drawing = tag in FOREIGN or any(opened.get(t) for t in FOREIGN)
        if token["rest"].endswith("/") and drawing:
            continue
        if tag in HIDDEN:
            # Code and other text that is not shown: up to its own end tag, whatever it contains.  A page
            # without that tag goes on behind the start tag, but for code, which is never text.
            end = ends.after(tag, token.start(), at)
            at = end if end is not None else len(page) if tag in CODE else at
            continue
        if tag in VOID:
            if tag in BREAKS:
                parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            if blocks:
                last = stack[blocks[-1]][0]
                if last in CLOSED_BY_BLOCK or (last == tag and tag in CLOSED_BY_ITSELF):
                    close(blocks[-1])
            blocks.append(len(stack))
        names = names_of(tag, token["rest"])
        if tag not in INLINE and tag not in TRANSPARENT:
            outer.append(names)
        stack.append(names)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return found


class Numbers:
    """Feature vectors of blocks; vectors of paths and codes of words are remembered."""

    def __init__(self) -> None:
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, path: tuple) -> np.ndarray:
        vector = self.paths.get(path)
        if vector is None:
            vector = np.zeros(PATH_DIMS, np.float32)
            for depth, names in enumerate(reversed(path)):
                for name in names:
                    code = zlib.crc32(name.encode())
                    vector[code % PATH_DIMS] += 1.0 if code & 0x8000 else -1.0
                if depth < 2:  # the two innermost elements also by their place
                    code = zlib.crc32(f"{depth}{names[0]}".encode())
                    vector[code % PATH_DIMS] += 1.0 if code & 0x8000 else -1.0
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = vector
        return vector

    def of(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), DIMS), np.float32)
        words = self.words
        for row, block in zip(out, blocks):
            row[:PATH_DIMS] = self._path(block.path)
            tokens = block.text.split()
            codes = []
            for token in tokens:
                code = words.get(token)
                if code is None:
                    if len(words) > 500_000:
                        words.clear()
                    code = words[token] = zlib.crc32(token.lower().encode()) % WORD_DIMS
                codes.append(code)
            row[PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(codes, minlength=WORD_DIMS) / len(tokens) ** 0.5
            n = len(block.text)
            row[PATH_DIMS + WORD_DIMS :] = (
                min(np.log1p(n) / 5, 2),
                min(np.log1p(len(tokens)) / 4, 2),
                block.linked / n,
                block.text[-1] in ".!?:;\"'”»…",
                min(len(block.path) / 8, 2),
                DIGIT.search(block.text) is not None,
                block.text.startswith(("©", "(c)", "Copyright")),
                1.0,
            )
        np.clip(out, -4, 4, out=out)
        return out
