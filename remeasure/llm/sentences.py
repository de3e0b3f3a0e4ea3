"""Problem 9: the sentences of every text, whatever its language and script.

Method: a hidden-event n-gram language model. Between two words there may be a boundary, an
event that isn't seen. Where a final mark, a closed quotation, a bracketed interruption or, in
Thai, white space leaves open whether a sentence ends, the model weighs how often the words
before end a sentence against how often they are followed by the next word within one; in Thai the
syllables on both sides take the place of words. Its counts come from all texts: paragraphs show
which words end and begin sentences for certain, and expectation maximisation carries that over to
the open places. Forward-backward posteriors over each paragraph then decide. Blank lines,
quotations and brackets bound what may be decided.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remeasure.session import stored

# Final marks, and pairs of quotation marks and brackets.
MARKS = ".!?…。．！？｡।॥።፧؟۔‼⁇⁈⁉។៕၊။༎"
GREEK_QUESTION = ";;"
QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", '"': '"', "「": "」", "『": "』", "›": "‹", "‹": "›", "《": "》"}
BRACKETS = {"(": ")", "[": "]", "（": "）", "［": "］", "〔": "〕", "【": "】", "{": "}", "｛": "｝"}
INTRODUCERS = ":：፦"

#: A word of the model has at least this share of all occurrences, and a word with the next one a fifth of it:
#: at most 20,000 names of each kind and 100,000 pairs.
LEAST_SHARE = 1 / 20_000
LEAST_COUNT = 20.0
EM_ROUNDS = 6
#: Marks that end a sentence unless what follows says otherwise.
SURE, SURE_CHANCE = ("!", "。"), 0.98
#: Classes of list numbers and initials, which don't end the sentence they begin.
NUMBERS = (".#", ".X")
#: The class of syllables before white space. Sentences of these scripts end there as a rule.
THAI = "thai_"
DASHES = ("–", "—", "-", "‐", "/")

_OPEN = {**QUOTES, **BRACKETS}
_CLOSE = frozenset("".join(_OPEN.values()))
_EITHER = _CLOSE | set(_OPEN)
_MARK_SET = frozenset(MARKS)
_BLANK_LINE = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])[^\S\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ])\s*| \s*")
#: Thai and Lao: no spaces between words.
_THAI = "\u0e00-\u0eff"
_OTHER = re.escape("".join(sorted(set(_OPEN) | _CLOSE)) + GREEK_QUESTION)
_MARK = re.escape(MARKS)
#: A run of marks, or one quotation mark or bracket; with Thai also white space beside it.
_POINTS = re.compile(rf"[{_MARK}{_OTHER}](?:(?<=[{_MARK}])[{_MARK}]+)?")
_THAI_POINTS = re.compile(rf"[{_MARK}]+|[{_OTHER}]|(?<=[{_THAI})\]）])\s+(?=\S)|\s+(?=[{_THAI}])")
#: A quotation mark or bracket.
_EITHER_SIGN = re.compile(f"[{re.escape(''.join(sorted(_EITHER)))}]")
_HAS_THAI = re.compile(f"[{_THAI}]")
#: What isn't a letter or a mark that belongs to one.
_NO_WORD = r"\s\d!-/:-@\[-`{-\xbf\u2010-\u205e\u3001-\u301f\uff01-\uff1f\u0964\u0965\u1361-\u1368\u061f\u06d4\u060c\u061b"
_WORD = re.compile(f"[^{_NO_WORD}]+")
#: A written syllable of Thai or Lao: a consonant, a vowel before it, and the marks that follow.
_SYLLABLE = "[\u0e40-\u0e44\u0ec0-\u0ec4]?[\u0e01-\u0e2e\u0e81-\u0eae][\u0e30-\u0e3a\u0e45\u0e47-\u0e4e\u0eb0-\u0ebc\u0ec8-\u0ecd]*"
_SYLLABLES = re.compile(_SYLLABLE)
_LAST_SYLLABLE = re.compile(f"{_SYLLABLE}[^{_NO_WORD}]?$")
_BLANKS_SET = " \t\xa0\u3000\u202f¿¡"
_BLANKS = r" \t\xa0\u3000\u202f¿¡"
#: What stands in brackets as the mark of a list item.
_LIST_MARK = re.compile(r"\s*[0-9A-Za-z]{0,3}\s*")
_NUMBER = re.compile(r"\d+[.)](?=\s)")
_DIGITS = re.compile(r"\d+(?:[.,:/]\d+)*")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯ｦ-ﾟ]")


#: What follows a place, up to the end of its first word: a word in brackets, the first letter in quotation marks, a
#: syllable, a word, a number; one character of the scripts without spaces.
_FOLLOWING = re.compile(
    rf"[{re.escape(''.join(BRACKETS))}][{_BLANKS}]*[^{_NO_WORD}]*|[{re.escape(''.join(QUOTES))}¿¡][{_BLANKS}]*.?|{_SYLLABLE}|[^{_NO_WORD}\u2e80-\U0010ffff]+|\d+(?:[.)]\s?)?|.", re.S
)

#: A sign or digit that begins a word, with the next word; and an opening mark that stands by itself before one.
_SIGN = re.compile(r"([^\s\w]|\d)[¿¡]*(\w*)")
_LISTED = re.compile(r"\d+[.)]")
_APART = re.compile(rf"[{re.escape(''.join(_OPEN))}¿¡]\s+(\w)")


def _kind(ch: str) -> str:
    """The class of a letter."""
    return "X" if ch.isupper() else "x" if ch.islower() else "o"


@lru_cache(50_000)
def _shape(word: str) -> str:
    """The class of a word that is too rare for the model."""
    if "#" in word:
        return "#"
    letters = [ch for ch in word if ch.isalpha()]
    if not letters:
        return "-"
    if "." in word:
        return "dotted"
    if letters[0].isupper():
        return "X" if len(letters) == 1 else "Xx" if len(letters) > 3 else "Xx-short"
    if letters[0].islower():
        return "xx" if len(letters) > 3 else "xx-short"
    return "oo" if len(letters) > 3 else "oo-short"


_LEADING, _TRAILING = "".join(_OPEN) + "¿¡§–—-", "".join(_CLOSE)


@lru_cache(100_000)
def _named(word: str) -> str:
    """A word before a mark as the model names it: digits as #, without quotation marks and brackets."""
    if word[-1] > "\u2e7f" or _CJK.search(word):
        word = re.sub(r"^.*[^\x00-\x7f]", "", word)
    return _DIGITS.sub("#", word).lstrip(_LEADING).rstrip(_TRAILING)


@lru_cache(100_000)
def _with_earlier(earlier: str, last: str) -> str:
    return _DIGITS.sub("#", earlier) + " " + last + "."


def _words_before(text: str, start: int, at: int) -> list[str]:
    """The words before ``at``, the last one or two of them whole, however long they are.

    A word ends at white space; letters of scripts without spaces are no part of what follows them.
    """
    reach = 40
    while True:
        low = max(start, at - reach)
        words = text[low:at].rsplit(None, 2)
        if low == start or len(words) > 2 or (words and _CJK.search(words[0])):
            return words
        reach *= 4


_NONE: list[str] = []


def _before(text: str, start: int, at: int, mark: str) -> tuple[str, str]:
    """(two words, one word) that stand before the mark at ``at``, as the model names them."""
    kind = mark[0]
    if kind != ".":
        if kind in "!！?？؟‼⁇⁈⁉;;":
            return "!", "!"
        if kind in "。．｡।॥።፧۔។៕၊။༎":
            return "。", "。"
    low = at - 40
    words = text[low:at].rsplit(None, 2) if low > start else _NONE
    if len(words) < 3:
        words = _words_before(text, start, at)
    last = _named(words[-1]) if words and not text[at - 1].isspace() else ""
    if len(mark) > 1 or kind == "…":
        if at > start and _CJK.match(text, at - 1):
            return "。", "。"
        return (name := last + "…"), name
    return _with_earlier(words[-2] if len(words) > 1 else "^", last), last + "."


def _syllable_before(text: str, start: int, at: int) -> str:
    """The last syllable before white space, as the model names it."""
    found = _LAST_SYLLABLE.search(text, max(start, at - 8), at)
    return (found.group() if found else text[at - 1]) + "_"


def _following(text: str, at: int, end: int) -> tuple[str, str]:
    return _after(_FOLLOWING.match(text, at, end).group())


@lru_cache(100_000)
def _after(following: str) -> tuple[str, str]:
    """(word, class) of what follows a place (see _FOLLOWING)."""
    ch = following[0]
    if ch.isalpha():
        if _SYLLABLES.match(following):
            return following, "th"
        word = _WORD.match(following)
        name = word.group() if word else ch
        return ("oo", "oo") if _CJK.match(name) else (name, _shape(name))
    if ch.isdigit():
        return ("#.", "#.") if _NUMBER.match(following) else ("#", "#")
    if ch in _OPEN or ch in "¿¡":
        inner = following[1:].lstrip(_BLANKS_SET)
        word = _WORD.match(inner) if ch in BRACKETS else None
        return ch + (word.group() if word else _kind(inner[:1])), ch + _kind(inner[:1])
    return ch, ch


def _spans(text: str, start: int, end: int, thai: bool) -> tuple[list[re.Match], dict[int, int]]:
    """The points of a paragraph and, by the place of their opening, where outer quotations and brackets close."""
    points = list((_THAI_POINTS if thai else _POINTS).finditer(text, start, end))
    signs = _EITHER_SIGN.finditer(text, start, end)
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()  # closing marks that something in the stack waits for
    pairs: dict[int, int] = {}
    for m in signs:
        at = m.start()
        ch = text[at]
        left = text[at - 1] if at > start else " "
        right = text[at + 1] if at + 1 < end else " "
        if ch in "’'" and left.isalpha() and right.isalpha():
            continue
        # the search only passes what is taken off the stack
        k = next(k for k in range(len(stack) - 1, -1, -1) if ch in _OPEN[stack[k][0]]) if waiting[ch] else -1
        if k >= 0 and not (ch in _OPEN and ch != '"' and left.isspace() and right.isalnum() and ch not in "“»«‘"):
            pairs[stack[k][1]] = at
            for opened, _ in stack[k:]:
                waiting.subtract(_OPEN[opened])
            del stack[k:]
        elif ch in _OPEN and not (ch in "»›" and not right.isalnum()):
            stack.append((ch, at))
            waiting.update(_OPEN[ch])
    outer: dict[int, int] = {}
    reach = -1
    for at in sorted(pairs):
        if at > reach:
            outer[at], reach = pairs[at], pairs[at]
    return points, outer


#: A place where a sentence may end: (end, start of what follows, name). The name says, divided by
#: tabs, how the sentence would end there and what the model knows: the two words before, the word
#: before, the word after and its class. How is 'm' (mark), 'q' (quotation), 'b' (bracket) or 's'
#: (white space), and 0; 1 if only one word, bracket or quotation lies between the place and the one
#: before; 2 where a sentence begins for certain before that word.
Place = tuple[int, int, str]


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts between blank lines, without white space at their ends."""
    at = 0
    cuts = [(m.start(), m.end()) for m in _BLANK_LINE.finditer(text)] + [(len(text), len(text))]
    for cut, following in cuts:
        start, end = at, cut
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start < end:
            yield start, end
        at = following


def _last_word(text: str, start: int, at: int) -> str:
    words = _words_before(text, start, at) if at > start and not text[at - 1].isspace() else []
    return words[-1] if words else ""


def _is_greek(text: str, start: int, at: int) -> bool:
    """Whether the last letter before ``at`` is a Greek one."""
    at -= 1
    while at >= start and not text[at].isalpha():
        at -= 1
    return at >= start and _GREEK.match(text, at) is not None


_BLOCKED = frozenset(MARKS + ",;:，、；：") | (_CLOSE - set(_OPEN))


def _joined(text: str, start: int, at: int, stop: int) -> bool:
    """A mark with nothing between it and the next character may end a sentence."""
    last, then = text[stop - 1], text[stop]
    if last in "。！？．｡।॥።፧؟۔":
        return True
    if not (then.isupper() or then in BRACKETS or then in "“«„¿¡" or (then.isalpha() and not then.islower())):
        return False
    word = _last_word(text, start, at)
    if "@" in word or "://" in word or word.startswith("www."):
        return False
    if stop - at == 1 and last == ".":
        prior = text[at - 1] if at > start else " "
        return len(word) > 2 and (prior in ")]”»" or prior.isdigit() or (prior.isalpha() and not prior.isupper()))
    return True


def places(text: str, start: int, end: int, thai: bool = True) -> tuple[list[Place], tuple[str, str] | None]:
    """The open places of a paragraph in order, and the words that end it (None without a final mark)."""
    points, outer = _spans(text, start, end, thai)
    found: list[Place] = []
    last: tuple[str, str] | None = None
    fresh = start  # where the text after the last place begins
    skip = -1
    following, after = _FOLLOWING.match, _after
    for m in points:
        at, stop = m.span()
        if at < skip:
            continue
        ch = text[at]
        if ch in _MARK_SET:
            if stop < end and ch in ".!?…" and ((then := text[stop]).isdigit() or then.islower()):
                continue
            by, linked = "m", 0
        elif at in outer:
            close = outer[at]
            skip = stop = close + 1
            inner = close - 1
            while inner > at and text[inner].isspace():
                inner -= 1
            if ch in BRACKETS:
                if at != fresh or _LIST_MARK.fullmatch(text, at + 1, close):
                    continue
                w2 = w1 = "()"
                by, linked = "b", 1
            else:
                ends = text[inner]
                if not (ends in _MARK_SET or (ends in GREEK_QUESTION and _is_greek(text, start, inner))):
                    continue
                lead = at - 1
                while lead > start and text[lead].isspace():
                    lead -= 1
                intro = "^" if at == fresh else ":" if at > start and text[lead] in INTRODUCERS else "m"
                w2, w1 = intro + text[close], intro + "”"
                by, linked = "q", 0
        elif ch in _EITHER:
            continue
        elif ch in GREEK_QUESTION:
            if not _is_greek(text, start, at):
                continue
            by, linked = "m", 0
        else:  # white space beside Thai
            if at < fresh or stop >= end or "\n" in m.group() or "\r" in m.group():
                continue
            a, b = text[at - 1], text[stop]
            if a.isdigit() or b.isdigit() or (a.isalpha() and a < "ɐ") or (b.isalpha() and b < "ɐ") or b in _MARK_SET:
                continue
            if not ("\u0e00" <= a <= "\u0eff" or a in _CLOSE) or (b in BRACKETS and stop not in outer):
                continue
            if not ("\u0e00" <= b <= "\u0eff" or b in BRACKETS or b in QUOTES or b.isalpha()):
                continue
            w2 = w1 = _syllable_before(text, start, at)
            by, linked = "s", 0
        k = stop
        while k < end and text[k].isspace():
            k += 1
        if k >= end:
            last = _before(text, start, at, m.group()) if by == "m" else (w2, w1)
            continue
        if text[k] in _BLOCKED:
            continue
        if by == "m":
            if k == stop and not _joined(text, start, at, stop):
                continue
            w2, w1 = _before(text, start, at, m.group())
            if len(w1) == 2 or "#" in w1:
                # a number or an initial: does a sentence begin with it?
                linked = int(text.find(" ", fresh, at) < 0 and text.find("\n", fresh, at) < 0)
                if not linked and w2.split(" ")[0][-1:] in INTRODUCERS:
                    linked = 2  # after a speaker's label, where a sentence begins
        c, cc = after(following(text, k, end).group())
        found.append((at if by == "s" else stop, k, f"{by}{linked}\t{w2}\t{w1}\t{c}\t{cc}"))
        fresh = k
    if thai and last is None and "\u0e00" <= text[end - 1] <= "\u0eff":
        last = (w1 := _syllable_before(text, start, end)), w1
    return found, last


# ---------------------------------------------------------------- counts over all texts


def scan(text: str) -> list[tuple[int, int, list[Place], tuple[str, str] | None]]:
    """(start, end, places, last words) of every paragraph of ``text``."""
    thai = _HAS_THAI.search(text) is not None
    return [(start, end, *places(text, start, end, thai)) for start, end in paragraphs(text)]


class Counts:
    """What the model needs to know of the texts of a task."""

    def __init__(self):
        self.places: Counter = Counter()
        self.borders: Counter = Counter()
        self.tokens: Counter = Counter()
        self.waiting: list[pa.Array] = []
        self.apart: Counter = Counter()

    def add(self, text: str, scanned: list) -> None:
        borders = self.borders
        for start, end, found, last in scanned:
            if found:
                self.places.update([name for _, _, name in found])
            if last is not None:
                borders["end", last[0], last[1], "", ""] += 1
            borders["begin", "", "", *_following(text, start, end)] += 1
        self.apart.update(m[0][0] + _kind(m[1]) for m in _APART.finditer(text))

    def add_words(self, texts: pa.Array) -> None:
        """Counts the words of whole columns, about a million at a time, outside Python."""
        self.waiting.append(pc.utf8_split_whitespace(texts).flatten())
        if sum(map(len, self.waiting)) > 1_000_000:
            self.count_words()

    def count_words(self) -> None:
        if self.waiting:
            words, counts = pc.value_counts(pa.chunked_array(self.waiting)).flatten()
            self.waiting = []
            tokens = self.tokens
            for word, n in zip(words.to_pylist(), counts.to_pylist()):
                tokens[word] += n
            # texts that begin or end with white space have empty words there
            tokens.pop("", None)
            tokens.pop(None, None)

    def __len__(self) -> int:
        return len(self.places) + len(self.tokens)

    def rows(self) -> Counter:
        """(kind, w2, w1, c, cc) with counts; kinds: open and linked place, end and begin of a paragraph, word."""
        self.count_words()
        out = Counter(self.borders)
        for name, n in self.places.items():
            how, w2, w1, c, cc = name.split("\t")
            if how[0] != "b":
                out["linked" if how[1] != "0" and _class_of(w1) in NUMBERS else "open", w2, w1, c, cc] += n
        for token, n in self.tokens.items():
            for word in _WORD.findall(token):
                if "\u0e00" <= word[0] <= "\u0eff":
                    for syllable in _SYLLABLES.findall(word):
                        out["word", "", "", syllable, "th"] += n
                elif word[0] < "\u2e80":
                    out["word", "", "", word, _shape(word)] += n
            sign = _SIGN.match(token)
            if sign is None or (len(token) == 1 and token in _OPEN):
                continue
            ch, then = sign.groups()
            shape = "#." if _LISTED.fullmatch(token) else "#" if ch.isdigit() else ch + _kind(then[:1]) if ch in _OPEN or ch in "¿¡" else ch
            out["word", "", "", ch + then if ch in BRACKETS and then else shape, shape] += n
        for name, n in self.apart.items():
            out["word", "", "", name, name] += n
        return out


_SCANNED = "doc_id bigint, bounds array<int>, at array<int>, next array<int>, names array<string>, kind string, w2 string, w1 string, wc string, c string, cc string, n bigint"
_NAMES = ["doc_id", "bounds", "at", "next", "names", "kind", "w2", "w1", "wc", "c", "cc", "n"]
_KINDS = [pa.int64(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.string()), *[pa.string()] * 6, pa.int64()]


def _batch(columns: list) -> pa.RecordBatch:
    length = len(next(c for c in columns if c is not None))
    return pa.RecordBatch.from_arrays([pa.nulls(length, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _lists(lengths: list[int], values: list, kind: pa.DataType) -> pa.Array:
    """``values`` cut into lists of these lengths."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the places of every text, and rows with the counts of the task.

    bounds holds start, end and number of places of each paragraph; at, next and names the places.
    """
    counts = Counts()

    def flushed() -> pa.RecordBatch:
        rows = counts.rows()
        kind, w2, w1, c, cc = zip(*rows)
        return _batch([None] * 5 + [kind, w2, w1, [_class_of(w) if w else "" for w in w1], c, cc, list(rows.values())])

    for whole in batches:
        for first in range(0, whole.num_rows, 256):
            part = whole.slice(first, 256)
            counts.add_words(part.column(1))
            ids, n_bounds, bounds, n_places, found_at = [], [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                scanned = scan(text) if text else []
                if scanned:
                    counts.add(text, scanned)
                    ids.append(doc_id)
                    n_bounds.append(3 * len(scanned))
                    before = len(found_at)
                    for start, end, found, _ in scanned:
                        bounds += (start, end, len(found))
                        found_at += found
                    n_places.append(len(found_at) - before)
            if ids:
                at, following, names = zip(*found_at) if found_at else ((), (), ())
                lists = [_lists(n_bounds, bounds, pa.int32()), *[_lists(n_places, v, pa.int32()) for v in (at, following)], _lists(n_places, names, pa.string())]
                yield _batch([ids, *lists, *[None] * 7])
            if len(counts) > 300_000:
                yield flushed()
                counts = Counts()
    counts.count_words()
    if len(counts):
        yield flushed()


@lru_cache(100_000)
def _class_of(w1: str) -> str:
    """The class that stands for a rare word before a mark."""
    if w1 in ("!", "。", "()") or w1[:1] in "^:m" and w1[-1:] in "”":
        return w1
    if w1[-1] == "_":
        return THAI
    return ("…" if w1.endswith("…") else ".") + _shape(w1[:-1])


class Model:
    """Chance of a boundary after words (``end``), and of the next word with a boundary and without."""

    def __init__(self, end: dict[str, float], next_b: dict[str, float], next_n: dict[str, float]):
        self.end, self.next_b, self.next_n = end, next_b, next_n
        self.steps: dict[str, tuple] = {}

    def w(self, w2: str, w1: str) -> str:
        if w2 in self.end:
            return w2
        return w1 if w1 in self.end else _class_of(w1)

    def c(self, c: str, cc: str) -> str:
        return c if c in self.next_b else "<" + cc

    def weights(self, w: str, c: str) -> tuple[float, float]:
        """(boundary, none): chance of the event after w, times that of c after the event."""
        return self.weighed(self.end.get(w, 0.02 if w == ".X" else SURE_CHANCE if w == THAI else 0.5), c)

    def weighed(self, theta: float, c: str) -> tuple[float, float]:
        if c in ("oo", "<oo"):  # scripts without spaces: only the words before tell
            return theta, 1 - theta
        return theta * self.next_b.get(c, 1e-6), (1 - theta) * self.next_n.get(c, 1e-6)

    def step(self, name: str) -> tuple:
        """(weights of boundary and none without a boundary at the place before, the same with one, how the place is linked)."""
        known = self.steps.get(name)
        if known is not None:
            return known
        how, w2, w1, c, cc = name.split("\t")
        linked = int(how[1])
        low = cc.startswith("xx") or c in DASHES
        c = self.c(c, cc)
        if how[0] == "b":
            free, begun = self.weighed(0.001, c), self.weighed(0.999, c)
        else:
            free = begun = self.weights(self.w(w2, w1), c)
            if linked and _class_of(w1) == ".X":
                begun = self.weighed(0.001, c)
            elif linked and _class_of(w1) == ".#":
                # the sentence that a list number begins goes on like any sentence begins
                chance = sum(self.weighed(0.999, c))
                begun = (1e-4 * chance, chance)
        if low:
            free, begun = (free[0] * 1e-3, free[1]), (begun[0] * 1e-3, begun[1])
        if len(self.steps) >= 200_000:
            self.steps.clear()
        self.steps[name] = found = (free, begun, linked)
        return found


def scanned(documents: DataFrame) -> DataFrame:
    """The places of every text and the counts of all texts, made in one pass and written once."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stored(texts.mapInArrow(_scan_batches, _SCANNED))


def fit(scan_of: DataFrame, least_share: float = LEAST_SHARE, rounds: int = EM_ROUNDS) -> Model:
    """The model from the counts of all texts, ``scan_of`` being the result of ``scanned``.

    Words and pairs below ``least_share`` of all occurrences are counted under their class, so
    what comes to the driver has a bounded number of rows, whatever the number of texts.
    """
    raw = stored(scan_of.where("kind is not null").groupBy("kind", "w2", "w1", "wc", "c", "cc").agg(F.sum("n").alias("n")))
    sums = {r["kind"]: r["n"] for r in raw.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    n_open = sum(sums.get(k, 0) for k in ("open", "linked", "end"))
    if not n_open:
        return Model({}, {}, {})
    marked = raw.where("kind in ('open', 'end')")

    def kept(df: DataFrame, column: str, total: int) -> set[str]:
        """At most 1 / least_share names."""
        rows = df.groupBy(column).agg(F.sum("n").alias("n")).where(F.col("n") >= max(LEAST_COUNT, least_share * total)).select(column).collect()
        return {r[0] for r in rows}

    two, one = kept(marked, "w2", n_open), kept(marked, "w1", n_open)
    follow = kept(raw.where("kind in ('open', 'linked', 'begin')"), "c", n_open)
    common = kept(raw.where("kind = 'word'"), "c", max(sums.get("word", 0), 1))
    spark = scan_of.sparkSession
    # every name has one row, so the tables are bounded like the sets
    t2 = F.broadcast(spark.createDataFrame(pd.DataFrame({"w2": sorted(two), "k2": True}), "w2 string, k2 boolean"))
    t1 = F.broadcast(spark.createDataFrame(pd.DataFrame({"w1": sorted(one), "k1": True}), "w1 string, k1 boolean"))
    tc = F.broadcast(spark.createDataFrame(pd.DataFrame({"c": sorted(follow | common), "kc": True}), "c string, kc boolean"))
    named = raw.join(t2, "w2", "left").join(t1, "w1", "left").join(tc, "c", "left")
    w = F.when(F.col("k2"), F.col("w2")).when(F.col("k1"), F.col("w1")).otherwise(F.col("wc"))
    c = F.when(F.col("kc"), F.col("c")).otherwise(F.concat(F.lit("<"), "cc"))
    before = F.when(F.col("kind").isin("open", "end"), w).otherwise("").alias("w")
    named = stored(named.select("kind", before, c.alias("c"), "cc", "n").groupBy("kind", "w", "c", "cc").agg(F.sum("n").alias("n")))
    ends = {r["w"]: r["n"] for r in named.where("kind = 'end'").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    begins = {r["c"]: r["n"] for r in named.where("kind = 'begin'").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    words = {r["c"]: r["n"] for r in named.where("kind = 'word'").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    opened = named.where("kind = 'open'")
    frequent = F.col("n") >= max(2.0, least_share * n_open / 5)
    # rare pairs count under the class of the next word: at most one row for each w and class
    folded = opened.withColumn("c", F.when(frequent, F.col("c")).otherwise(F.concat(F.lit("<"), "cc"))).groupBy("w", "c").agg(F.sum("n").alias("n"))
    pairs = [(r["w"], r["c"], r["n"]) for r in folded.collect()]
    return _maximised(pairs, ends, begins, words, rounds)


def _maximised(pairs: list[tuple[str, str, int]], ends: dict[str, int], begins: dict[str, int], words: dict[str, int], rounds: int) -> Model:
    """Expectation maximisation over the open places (w, c, count), starting from what paragraphs show.

    What follows a boundary is known from the beginnings of paragraphs and from what follows sure
    marks; what follows none is every other word. The rounds find how often each w ends a sentence.
    """
    seen: Counter = Counter()
    first: Counter = Counter(begins)
    for w, c, n in pairs:
        seen[w] += n
        if (w in SURE or w[-1] == "_") and not c.startswith("<xx") and not c[:1].islower() and c not in DASHES:
            first[c] += n
    # how many boundaries inside paragraphs there are for each at a paragraph's end, from sure marks
    sure = sum(n for w, n in seen.items() if w in SURE)
    ratio = max(sure / max(sum(ends.get(w, 0) for w in SURE), 1), 1.0)
    names = {c for _, c, _ in pairs} | set(first) | set(words)
    total_first = sum(first.values()) or 1
    next_b = {c: (first[c] + 0.05) / total_first for c in names}
    theta = {w: SURE_CHANCE if w in SURE or w[-1] == "_" else min(max((ends.get(w, 0) * ratio + 0.02) / (n + 1.0), 0.002), 0.98) for w, n in seen.items()}
    boundaries = sum(n * theta[w] for w, n in seen.items()) + sum(begins.values())
    model = Model(theta, next_b, {})
    for turn in range(rounds + 1):
        # words less those that boundaries account for
        inside = {c: max(words.get(c, 0) - next_b[c] * boundaries, 0.01 * words.get(c, 0)) + 0.05 for c in names}
        total_n = sum(inside.values())
        model = Model(theta, next_b, {c: n / total_n for c, n in inside.items()})
        if turn == rounds:
            break
        got: Counter = Counter()
        for w, c, n in pairs:
            b, none = model.weights(w, c)
            got[w] += n * b / (b + none)
        boundaries = sum(got.values()) + sum(begins.values())
        theta = {}
        for w, n in seen.items():
            # what paragraphs show counts like a tenth of the open places more
            shown = 1.0 if w[-1] == "_" else min(ends.get(w, 0) * ratio / n, 1.0)
            weight = 5 + n / 10
            theta[w] = SURE_CHANCE if w in SURE else min(max((got[w] + weight * shown) / (n + weight), 0.0005), 0.9995)
            if shown < 0.02 and n >= 20 and w not in SURE:
                # words that hardly ever end a paragraph hardly ever end a sentence
                theta[w] = min(theta[w], max(shown, 0.0005))
    return model


# ---------------------------------------------------------------- decisions


def posteriors(steps: list[tuple]) -> list[float]:
    """The chance of a boundary at each place of a paragraph, by forward-backward over their steps (see ``Model.step``).

    A linked place depends on the one before: a number or initial that begins a sentence doesn't
    end it, and a bracket that stands alone ends where it began, between sentences. Where none is
    linked, the places of the bigram model don't depend on each other.
    """
    if not any(linked for _, _, linked in steps):
        return [b / ((b + n) or 1.0) for (b, n), _, _ in steps]
    # the first place of a paragraph follows a boundary, too
    steps = [(begun if linked == 2 or (linked and not i) else free, begun if linked else free) for i, (free, begun, linked) in enumerate(steps)]
    forward = []
    b, n = 0.0, 1.0
    for free, begun in steps:
        b, n = b * begun[0] + n * free[0], b * begun[1] + n * free[1]
        s = (b + n) or 1.0
        b, n = b / s, n / s
        forward.append((b, n))
    out = [0.0] * len(steps)
    rb, rn = 1.0, 1.0
    for i in range(len(steps) - 1, -1, -1):
        fb, fn = forward[i]
        top = fb * rb
        out[i] = top / ((top + fn * rn) or 1.0)
        free, begun = steps[i]
        rb, rn = begun[0] * rb + begun[1] * rn, free[0] * rb + free[1] * rn
        s = (rb + rn) or 1.0
        rb, rn = rb / s, rn / s
    return out


def chosen(bounds: np.ndarray, at: np.ndarray, following: np.ndarray, names: np.ndarray, steps: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, start, end) of the sentences of paragraphs with these bounds (start, end, number of places) and places.

    names holds the number in ``steps`` of each place's name. Places of paragraphs without links are
    decided together; the others go through ``posteriors``.
    """
    weights = np.array([free for free, _, _ in steps], float).reshape(-1, 2)
    linked = np.array([link for _, _, link in steps], np.int64)
    own = np.repeat(np.arange(len(bounds)), bounds[:, 2])
    ends_here = (weights[:, 0] > weights[:, 1])[names] if len(names) else np.zeros(0, bool)
    first = np.cumsum(bounds[:, 2]) - bounds[:, 2]
    for k in np.unique(own[linked[names] > 0]) if len(names) else ():
        here = slice(first[k], first[k] + bounds[k, 2])
        ends_here[here] = [chance > 0.5 for chance in posteriors([steps[n] for n in names[here]])]
    cuts = np.flatnonzero(ends_here)
    # a paragraph has one sentence more than cuts
    sentences_of = np.bincount(own[cuts], minlength=len(bounds)) + 1
    last = np.cumsum(sentences_of) - 1
    starts, ends = np.empty(sentences_of.sum(), np.int64), np.empty(sentences_of.sum(), np.int64)
    before = np.arange(len(cuts)) + own[cuts]
    ends[before], starts[before + 1] = at[cuts], following[cuts]
    starts[last - sentences_of + 1], ends[last] = bounds[:, 0], bounds[:, 1]
    return np.repeat(np.arange(len(bounds)), sentences_of), starts, ends


def split_text(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of ``text``."""
    found = scan(text)
    every = [p for _, _, own, _ in found for p in own]
    bounds = np.array([(start, end, len(own)) for start, end, own, _ in found], np.int64).reshape(-1, 3)
    steps = [model.step(name) for _, _, name in every]
    at, following = (np.array([p[k] for p in every], np.int64) for k in (0, 1))
    return list(zip(*[x.tolist() for x in chosen(bounds, at, following, np.arange(len(every)), steps)[1:]]))


def _choose_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds, at, following = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3))
            bounds = bounds.reshape(-1, 3)
            names = batch.column(4).flatten().dictionary_encode()
            steps = [fitted.step(name) for name in names.dictionary.to_pylist()]
            paragraph, starts, ends = chosen(bounds, at, following, names.indices.to_numpy(), steps)
            per_text = batch.column(1).value_lengths().to_numpy() // 3
            row = np.repeat(np.arange(batch.num_rows), per_text)[paragraph]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], names=["doc_id", "start_pos", "end_pos"])

    return run


def sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence, in code points from 0, end excluded.

    Sentences have no white space at their ends and together hold all that isn't white space.
    Null, empty and blank texts have none; repeated rows are split as often as they occur; other
    columns are left out. ``model`` is fitted on ``documents`` unless it is given.
    """
    found = scanned(documents)
    fitted = documents.sparkSession.sparkContext.broadcast(model or fit(found))
    return found.where("kind is null").select("doc_id", "bounds", "at", "next", "names").mapInArrow(_choose_batches(fitted), "doc_id bigint, start_pos int, end_pos int")
