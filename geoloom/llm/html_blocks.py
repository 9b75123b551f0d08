"""HTML to a sequence of text blocks, and the numeric features that the block labeller reads.

A page is read leniently and in linear time: unclosed and crossed tags, attributes without quotes and broken comments
all give some sequence of blocks. A block is the text between two block-level tags; inline tags and line breaks join
their text.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np

#: Tags whose content is no text of the page.
SILENT = frozenset("script style template noscript svg math iframe object canvas audio video select textarea".split())
#: Of these, those whose content runs to the end of the page when their end tag is missing.
RAW = frozenset("script style iframe textarea".split())
#: Tags that can be in a head; any other opening tag, or text, ends it.
HEAD = frozenset("base link meta title script style noscript template html head".split())
#: Tags that do not end a block. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, when that is open: paragraphs and list items are often left open. Fixed values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")

#: A block's path tells of so many open elements, the innermost, and of so many names of each: what is described of the
#: page, not what is read of it.
DEPTH, NAMES = 12, 12
PATH_BUCKETS, WORD_BUCKETS, FIGURES = 256, 128, 10
WIDTH = PATH_BUCKETS + WORD_BUCKETS + FIGURES


@dataclass
class Block:
    path: tuple[str, ...]  # features of the open tags, the innermost last
    text: str
    link_chars: int


def _names(attrs: str) -> list[str]:
    if "=" not in attrs:
        return []
    return [p.lower() for _, value in _ATTR.findall(attrs) for p in _PART.findall(value)][:NAMES]


def unescape(text: str) -> str:
    """Character references decoded, numbers of any length too."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return htmllib.unescape(text) if "&" in text else text


class Scanner:
    """Tags of a page from left to right. A character is looked at a bounded number of times: where an end is missing,
    that is remembered."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.spare = 4 * len(page)  # characters that may be read in vain for the end of quoted values
        self.absent: set[str] = set()

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: the first > outside the quotes of values, else the first."""
        page, first = self.page, at
        while self.spare > 0:
            m = _STOP.search(page, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            at, before = m.end(), m.start() - 1
            while before >= first and page[before].isspace():
                before -= 1
            if before >= first and page[before] == "=":
                close = page.find(m[0], at)
                if close < 0:
                    break
                at = close + 1
        self.spare -= len(page) - first
        return page.find(">", first)

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """The next tag, comment or declaration from ``at`` on: (start, end, name, is it an end tag, attributes); at the
        end of the page its length twice."""
        page, i = self.page, at - 1
        while (i := page.find("<", i + 1)) >= 0:
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                return i, len(page) if end < 0 else end + 3, "", False, ""
            if i > self.last:
                break  # no tag ends after this
            if page[i + 1] in "!?":
                return i, page.find(">", i) + 1, "", False, ""
            closing = page[i + 1] == "/"
            m = _NAME.match(page, i + 1 + closing)
            if m:
                end = self._end(m.end())
                return i, end + 1, m[0].lower(), closing, page[m.end() : end]
        return len(page), len(page), "", False, ""

    def after(self, tag: str, at: int) -> int:
        """Where the next end tag of ``tag`` ends; -1 if there is none."""
        if tag in self.absent:
            return -1
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        if end < 0:
            self.absent.add(tag)
        return end + 1 if end >= 0 else -1


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order, each with white space turned to single spaces and trimmed; empty ones left out."""
    page = page or ""
    scan = Scanner(page)
    stack: list[str] = []
    outer: list[tuple[int, str, tuple[str, ...]]] = []  # of these the block-level ones: place in the stack, tag, features
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    in_head = False
    opened: Counter[str] = Counter()

    def cut(i: int) -> None:
        for t in stack[i:]:
            opened[t] -= 1
        del stack[i:]
        while outer and outer[-1][0] >= i:
            outer.pop()

    def put(text: str) -> None:
        parts.append(text)
        if opened["a"]:
            link_parts.append(text)

    def end_block() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                path = tuple(f for _, _, feats in outer[-DEPTH:] for f in feats)
                out.append(Block(path, text, len(_SPACE.sub(" ", unescape("".join(link_parts))).strip())))
            parts.clear()
            link_parts.clear()

    at = 0
    while at < len(page):
        start, end, tag, closing, attrs = scan.next(at)
        if start > at:
            in_head = in_head and page[at:start].isspace()
            put(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "head":
            end_block()
            in_head = not closing
            continue
        if in_head:
            in_head = tag in HEAD if not closing else tag not in ("body", "html", "br")
        if not closing:
            if tag in SILENT or (in_head and tag == "title"):
                if not attrs.rstrip().endswith("/"):
                    found = scan.after(tag, at)
                    if found >= 0:
                        at = found
                    elif tag in RAW:
                        break
                continue
            if tag in INLINE:
                if tag == "br":
                    put(" ")
                if tag not in VOID:
                    opened[tag] += 1
                    stack.append(tag)
                continue
            end_block()
            if tag in VOID:
                continue
            if tag == "p" or tag not in CLOSES:  # block-level tags end an open paragraph
                if outer and outer[-1][1] == "p":
                    cut(outer[-1][0])
            else:  # through inline tags and paragraphs left open
                k = len(outer) - 1
                while k >= 0 and (outer[k][1] in CLOSES[tag] or outer[k][1] == "p"):
                    if outer[k][1] in CLOSES[tag]:
                        cut(outer[k][0])
                    k -= 1
            opened[tag] += 1
            outer.append((len(stack), tag, (f"<{tag}", *(f".{n}" for n in _names(attrs)))))
            stack.append(tag)
        else:
            if tag not in INLINE:
                end_block()
            if opened[tag] > 0:
                i = len(stack) - 1
                while stack[i] != tag:
                    i -= 1
                cut(i)
    end_block()
    return out


_bucket: dict[str, int] = {}


def path_bucket(feature: str) -> int:
    """The feature's hash bucket; a bounded memo of hashes."""
    n = _bucket.get(feature)
    if n is None:
        if len(_bucket) > 100_000:
            _bucket.clear()
        n = _bucket[feature] = crc32(feature.encode()) % PATH_BUCKETS
    return n


def features(seq: list[Block], first: int = 0, of: int | None = None, total: int | None = None) -> np.ndarray:
    """One row per block: hashed tag path, hashed words (both square-rooted shares), and figures of the text.

    ``seq`` may be a part of a page of ``of`` blocks and ``total`` characters that begins at block ``first``."""
    of = len(seq) if of is None else of
    x = np.zeros((len(seq), WIDTH), np.float32)
    if not seq:
        return x
    # Words of all blocks at once: a polynomial hash of each run of bytes between spaces.
    joined = b" ".join(b.text.lower().encode("utf-8", "surrogatepass") for b in seq) + b" "
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    offset = np.arange(len(data), dtype=np.int64) - np.repeat(starts, ends - starts + 1)
    mixed = (data.astype(np.uint64) + np.uint64(7)) * (offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xC2B2AE3D27D4EB4F))
    hashed = (np.add.reduceat(mixed, starts) >> np.uint64(40)) % np.uint64(WORD_BUCKETS)
    sizes = np.array([len(b.text.encode("utf-8", "surrogatepass")) + 1 for b in seq])
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    words = np.bincount(owner * WORD_BUCKETS + hashed.astype(np.int64), minlength=len(seq) * WORD_BUCKETS).reshape(len(seq), WORD_BUCKETS)
    n_words = np.maximum(words.sum(axis=1, keepdims=True), 1)
    x[:, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = np.sqrt(words / n_words)
    total = max(sum(len(b.text) for b in seq) if total is None else total, 1)
    for i, b in enumerate(seq):
        for depth, f in enumerate(reversed(b.path)):
            x[i, path_bucket(f)] = max(x[i, path_bucket(f)], 1.0 if depth < 4 else 0.7)
        n = len(b.text)
        x[i, PATH_BUCKETS + WORD_BUCKETS :] = (
            math.log1p(n) / 6, math.log1p(int(n_words[i, 0])) / 4, min(b.link_chars / max(n, 1), 1.0), n / total,
            sum(map(b.text.count, ".,;?!")) / int(n_words[i, 0]), b.text[-1:] in ".!?\"”", (first + i) / of, (of - first - i) / of, min(len(b.path), 12) / 12, 1.0,
        )
    return x
