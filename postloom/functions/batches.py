"""The few steps no built-in expression covers, each a small function over one Arrow batch.

Four uses: folding letters to their unaccented form, the words of duplicate keys, reading elements out of
HTML, and the sequential rule for a small remainder of duplicates.  The module
is pickled by value, so that executors need no copy of the package.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is code, not text.
CODE = frozenset(("script", "style", "template"))


def combining_marks() -> str:
    """Character class of all code points with a non-zero combining class."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    ranges: list[list[int]] = []
    for c in marks:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


MARKS = combining_marks()


def first_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``seq`` of the rows, given in order, that share none of their keys with a row kept before.

    Only ever given a remainder of checked size.
    """
    taken: dict[str, set] = {}
    for rows in batches:
        keys = [k for k in rows.columns if k != "seq"]
        kept = []
        for row in rows.itertuples(index=False):
            own = {k: getattr(row, k) for k in keys}
            if not any(value in taken.setdefault(k, set()) for k, value in own.items()):
                kept.append(row.seq)
                for k, value in own.items():
                    taken[k].add(value)
        yield pd.DataFrame({"seq": pd.Series(kept, dtype="int64")})


def fold_lists(lists: pa.Array) -> pa.Array:
    """Compatibility-decompose every string of every list and drop the combining marks."""
    texts = pc.utf8_normalize(lists.flatten().cast(pa.string()), form="NFKD")
    texts = pc.replace_substring_regex(texts, pattern=MARKS, replacement="")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths)])
    return pa.ListArray.from_arrays(offsets, texts, mask=lists.is_null())


# Characters beyond ASCII, and words of ASCII texts, both as the patterns of ``keys`` have them.
_ODD = re.compile(r"[^\x00-\x7f]+")
_TO_BLANKS = bytes(c if chr(c).isalnum() or c == 95 else 32 for c in range(128)) + bytes([32]) * 128
_LEVELS = (
    ("sr", re.compile(r"sr(?<!\wsr)(?:\.(?=\w)|(?!\w))", re.ASCII), "senior"),
    ("jr", re.compile(r"jr(?<!\wjr)(?:\.(?=\w)|(?!\w))", re.ASCII), "junior"),
    ("mid", re.compile(r"mid(?<!\wmid)[- ]?level(?!\w)", re.ASCII), "pleno"),
)
# Rows whose texts are Python objects at one time, whatever the size of a batch; folded runs kept beside them.
ROWS, RUNS = 64, 20_000


def _key_text(text: str, folded: dict[str, str]) -> str:
    """The words of a text that is ASCII once it is folded; another text is only folded."""
    if not text.isascii():
        text = _ODD.sub(lambda run: folded[run[0]], text)
        if not text.isascii():
            return text
    text = text.lower()
    for part, pattern, level in _LEVELS:
        if part in text:
            text = pattern.sub(level, text)
    return b" ".join(text.encode().translate(_TO_BLANKS).split()).decode()


def key_texts(lists: pa.Array) -> pa.Array:
    """:func:`_key_text` of every string of every list; runs beyond ASCII are folded once, however often they come."""
    parts, folded = [pa.array([], pa.list_(pa.string()))], {}
    for start in range(0, len(lists), ROWS):
        rows = [row or [] for row in lists.slice(start, ROWS).to_pylist()]
        runs = {r for row in rows for t in row if not t.isascii() for r in _ODD.findall(t)}
        if len(folded) > RUNS:
            folded.clear()
        new = list(runs - folded.keys())
        for run, parts_of in zip(new, pc.utf8_normalize(pa.array(new, pa.string()), form="NFKD").to_pylist()):
            folded[run] = "".join(c for c in parts_of if not unicodedata.combining(c))
        words = [[_key_text(t, folded) for t in row] for row in rows]
        parts.append(pa.array(words, pa.list_(pa.string())))
    return pa.concat_arrays(parts)


def unescape_texts(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


class ElementReader(HTMLParser):
    """Text and one attribute of the elements that match simple selectors.

    A selector is a dict with any of ``tag``, ``token`` (a class name), ``part`` (text inside the
    class attribute), ``attr`` (attribute that must be there, non-empty with ``filled``), ``has``
    ((attribute, text it must contain)).  ``get`` names the attribute to return instead of text.
    """

    def __init__(self, wanted: dict[str, list[dict]]):
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.open: list[tuple[str, list[list[str]]]] = []
        self.pieces: list[str] = []
        self.matches: dict[str, list] = {name: [] for name in wanted}
        self.same_text = False  # the parser may deliver one text in parts

    @staticmethod
    def fits(selector: dict, tag: str, attrs: dict[str, str]) -> bool:
        classes = attrs.get("class") or ""
        if "tag" in selector and selector["tag"] != tag:
            return False
        if "token" in selector and selector["token"] not in classes.split():
            return False
        if "part" in selector and selector["part"] not in classes:
            return False
        if "attr" in selector and not (
            attrs.get(selector["attr"]) if selector.get("filled") else selector["attr"] in attrs
        ):
            return False
        name, text = selector.get("has", (None, ""))
        return name is None or text in (attrs.get(name) or "")

    def handle_starttag(self, tag, attrs):
        values = {}
        for name, value in attrs:
            values[name] = value or ""
        targets = []
        self.same_text = False
        for name, selectors in self.wanted.items():
            hit = next((s for s in selectors if self.fits(s, tag, values)), None)
            if hit is None:
                continue
            if "get" in hit:
                self.matches[name].append(values.get(hit["get"]))
            else:
                text: list[str] = []
                self.matches[name].append(text)
                targets.append(text)
        if tag not in VOID:
            self.open.append((tag, targets))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_comment(self, data):
        self.same_text = False

    def handle_endtag(self, tag):
        self.same_text = False
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        if any(tag in CODE for tag, _ in self.open):
            return
        for texts in (self.pieces, *(t for _, targets in self.open for t in targets)):
            if self.same_text:
                texts[-1] += data
            else:
                texts.append(data)
        self.same_text = True


def read_elements(page: str | None, firsts: dict, alls: dict) -> dict:
    reader = ElementReader({**firsts, **alls})
    reader.feed(page or "")
    reader.close()

    def value(match):
        return match if match is None or isinstance(match, str) else " ".join(match)

    row = {name: value(reader.matches[name][0]) if reader.matches[name] else None for name in firsts}
    row |= {name: [value(m) for m in reader.matches[name]] for name in alls}
    return row | {"text": " ".join(reader.pieces), "lines": "\n".join(reader.pieces)}


# Pages whose elements are Python objects at one time, whatever the size of a batch.
PAGES = 64


def read_in_slices(pages: pa.Array, read, kind: pa.DataType) -> pa.Array:
    """``read`` of every page, as values of ``kind``."""
    parts = [pa.array([], kind)]
    for start in range(0, len(pages), PAGES):
        parts.append(pa.array([read(p) for p in pages.slice(start, PAGES).to_pylist()], kind))
    return pa.concat_arrays(parts)


def read_pages(firsts: dict[str, list[dict]], alls: dict[str, list[dict]]):
    """Function for an Arrow UDF: one HTML column in, one struct of element texts out."""
    text, texts = pa.string(), pa.list_(pa.string())
    fields = [(n, text) for n in firsts] + [(n, texts) for n in alls]
    kind = pa.struct([*fields, ("text", text), ("lines", text)])

    def run(pages: pa.Array) -> pa.Array:
        return read_in_slices(pages, lambda p: read_elements(p, firsts, alls), kind)

    return run


class CardReader(ElementReader):
    """Elements of every card of a result page: of the outermost boxes, or of items of a list."""

    def __init__(self, wanted: dict[str, list[dict]], boxes: list[dict], lists: list[dict]):
        super().__init__(wanted)
        self.boxes, self.lists = boxes, lists
        self.list_at: list[int] = []  # depths of open lists
        self.card_at: int | None = None
        self.cards: list[tuple[dict, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        values = {name: value or "" for name, value in attrs}
        if self.card_at is None:
            item = tag == "li" and bool(self.list_at) and self.list_at[-1] + 1 == len(self.open)
            if item or any(self.fits(box, tag, values) for box in self.boxes):
                self.card_at = len(self.open)
                self.matches, self.pieces = {name: [] for name in self.wanted}, []
                self.cards.append((self.matches, self.pieces))
            elif any(self.fits(x, tag, values) for x in self.lists):
                self.list_at.append(len(self.open))
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        depth = len(self.open)
        if self.card_at is not None and depth <= self.card_at:
            self.card_at, self.matches, self.pieces = None, {name: [] for name in self.wanted}, []
        while self.list_at and depth <= self.list_at[-1]:
            self.list_at.pop()


def read_card_list(firsts: dict[str, list[dict]], boxes: list[dict], lists: list[dict]):
    """Function for an Arrow UDF: one HTML column in, a list of card structs out.

    A page without any box is one card itself, as a stored single card is.
    """
    text = pa.string()
    kind = pa.list_(pa.struct([*((n, text) for n in firsts), ("text", text), ("lines", text)]))

    def cards(page: str | None) -> list[dict]:
        reader = CardReader(firsts, boxes, lists)
        reader.feed(page or "")
        reader.close()
        if not reader.cards:
            return [read_elements(page, firsts, {})]
        rows = []
        for matches, pieces in reader.cards:
            firsts_of = {n: m[0] if m else None for n, m in matches.items()}
            row = {n: m if m is None or isinstance(m, str) else " ".join(m) for n, m in firsts_of.items()}
            rows.append(row | {"text": " ".join(pieces), "lines": "\n".join(pieces)})
        return rows

    def run(pages: pa.Array) -> pa.Array:
        return read_in_slices(pages, cards, kind)

    return run
