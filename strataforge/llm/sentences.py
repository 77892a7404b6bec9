"""Problem 9: sentence units of texts in any script.

Marks are read into symbols with a little context (is this dot part of a number, a name, an abbreviation, a pause?); a finite
transducer over the symbols, whose states say in which quotation marks or parentheses a place lies, decides which of them end
a unit. A long text is cut into chunks of `CHUNK` symbols; each chunk is a function from its first state to its last, all
chunks of a batch are run at once for every state, the functions are composed by a parallel prefix scan, and
each chunk is then run once from the state the scan found for it.

Rules: a line break always ends a unit. Final marks end one outside quotation marks and parentheses; a closing quotation mark
right after a final mark ends one if the statement does not go on behind it (lower case, a particle or a pause mark follow). A dot
within a name or number, after an abbreviation, an initial, an ordinal, and an ellipsis end nothing, unless for abbreviations
that may stand last and ellipses a capital follows. Next to a Thai letter a blank ends a unit. Opening marks without a closing mark of
their own in their line are plain text.

Brackets and paired quotation marks may be nested to any depth: the transducer has as many states as the deepest nesting of the
texts at hand asks for, and a text nested deeper than `DEEP` is run by a counter under the same rules. All look-arounds are bounded by a word or take what is known of the line, so time is linear in a text's length.

Defined cases: null and blank texts have no units; outer blanks belong to no unit; every other character lies in exactly one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Symbols in a chunk; nesting up to which states are laid out in a table (beyond it a counter runs the same rules).
CHUNK, DEEP = 256, 32
# Abbreviations that end nothing, that may stand last, and that a number or letter follows.
NEVER = set(
    "cf e.g i.e vs viz approx ca mr mrs ms dr prof st bzw vgl ggf evtl inkl sog z.b d.h u.a p.ex ex env mme mlle см ок т.е напр им ул rev gen hon dept"
    .split()
)
LAST = set("etc inc ltd co corp jr sr bros u.s u.k u.n e.u a.m p.m usw al т.д т.п д др пр cie gmbh z.t".split())
NUMBERED = set("no nos nr fig figs sec secs abb app ch chap kap tab eq vol pp p v n ref refs art bd рис п табл стр гл".split())
ORDINAL_AFTER = set("am die der das den dem des im vom zum zur beim ab bis seit".split())
_ARTICLE = max(map(len, ORDINAL_AFTER))

_OPEN = {"„": 2, "«": 3, "「": 4, "『": 5, "(": 6, "（": 6, "[": 7, "【": 7, "《": 8, "〈": 8}
_CLOSE = {"»": 3, "」": 4, "』": 5, ")": 6, "）": 6, "]": 7, "】": 7, "》": 8, "〉": 8}
_CLOSED_BY = {"“": (2,), "”": (2,)} | {c: (k,) for c, k in _CLOSE.items()}
_QUOTES = {0, 1, 2, 3, 4, 5}
_EVENT = re.compile("[\n\r\v\f\x85\u2028\u2029]|[.!?。！？｡．…।॥؟۔]+|[\"“”„«»「」『』()（）\\[\\]【】《》〈〉]|(?<=[฀-๿])[^\\S\n\r]+|[^\\S\n\r]+(?=[฀-๿])")
_FINAL = set("!?。！？｡।॥؟۔")
_WIDE = set("。！？｡．")
_GOES_ON = set("，、；：,;:。．.！？!?と的之をがはのに")
_HAN = re.compile("[぀-ヿ㐀-鿿가-힯]")
_LEAD = re.compile(r"[ \t]*(?:#{1,6}|[-*+•·>]+|\d+[.)])")
_INK, _WORD_BEFORE = re.compile(r"\S"), re.compile(r"\S+\Z")

TYPES = 9
(_PAD, _BREAK, _END), _S_OPEN, _S_CLOSE, _S_CLOSE_END = range(3), 3, 3 + TYPES, 3 + 2 * TYPES
_S_TOGGLE, _S_TOGGLE_END, _S_LOW, _S_LOW_END, _S_HIGH, _S_HIGH_END = range(3 + 3 * TYPES, 9 + 3 * TYPES)
SYMBOLS = 9 + 3 * TYPES


@lru_cache(maxsize=32)
def tables(nesting: int) -> tuple[np.ndarray, np.ndarray]:
    """The transducer for texts nested up to `nesting` deep: next state and whether a unit ends, by symbol and state.

    State 0 is outside; the others are a kind of mark and how deep it is nested in its own kind.
    """
    states = 1 + TYPES * nesting
    step, ends = np.tile(np.arange(states, dtype=np.int32), (SYMBOLS, 1)), np.zeros((SYMBOLS, states), bool)

    def state(kind: int, depth: int) -> int:
        return 1 + kind * nesting + depth - 1 if depth else 0

    step[_BREAK], ends[_BREAK], ends[_END, 0] = 0, True, True
    for kind in range(TYPES):
        step[_S_OPEN + kind, 0] = state(kind, 1)
        for depth in range(1, nesting + 1):
            step[_S_OPEN + kind, state(kind, depth)] = state(kind, min(nesting, depth + 1))
            for symbol in (_S_CLOSE, _S_CLOSE_END):
                step[symbol + kind, state(kind, depth)] = state(kind, depth - 1)
        ends[_S_CLOSE_END + kind, state(kind, 1)] = True
    for symbol, opens, closes in ((_S_TOGGLE, 0, (0,)), (_S_LOW, 1, (2,)), (_S_HIGH, None, (1, 2))):
        for s in (symbol, symbol + 1):
            if opens is not None:
                step[s, 0] = state(opens, 1)
            for kind in closes:
                for depth in range(1, nesting + 1):
                    step[s, state(kind, depth)] = state(kind, depth - 1)
                ends[symbol + 1, state(kind, 1)] = True
    return step, ends


def _after_blank(text: str, at: int) -> tuple[str, int]:
    """The next character behind blanks within the line, or the empty text, and its place."""
    while at < len(text) and text[at].isspace() and text[at] not in "\n\r":
        at += 1
    return (text[at], at) if at < len(text) and text[at] not in "\n\r" else ("", at)


def _dot_ends(text: str, at: int, after: int, line: int) -> bool:
    """Whether the single dot at `at` can end a statement; `after` is the place behind it, `line` where its line begins."""
    if after >= len(text) or text[after] in "\n\r":
        return True
    if not text[after].isspace():
        return bool(_HAN.match(text[after])) and not text[at - 1 : at].isdigit()
    begin = at
    while begin and not text[begin - 1].isspace():
        begin -= 1
    word = text[begin:at].lstrip("([{\"'“„«（「『").lower()
    following, place = _after_blank(text, after)
    if not following:
        return True
    if word in NEVER:
        return False
    if word in LAST or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
        return following.isupper() or bool(_HAN.match(following))
    if word in NUMBERED and (following.isdigit() or following.isupper() and not text[place + 1 : place + 2].isalpha()):
        return False
    if len(word) == 1 and word.isalpha() and not _HAN.match(word):
        return False
    if word.isdigit() and len(word) <= 3:
        last = begin
        while last > line and text[last - 1].isspace():
            last -= 1
        if last <= line:
            return False
        # No article is longer than `_ARTICLE` letters; one more would show the blank before it.
        article = _WORD_BEFORE.search(text[max(line, last - _ARTICLE - 1) : last])[0].lower()
        if following.isupper() and article in ORDINAL_AFTER:
            return False
    return True


def _quote_ends(text: str, at: int) -> bool:
    """Whether the closing quotation mark at `at` comes right after a final mark and nothing of the statement follows."""
    before = at - 1
    while before >= 0 and text[before].isspace():
        before -= 1
    mark = text[before] if before >= 0 else ""
    if mark not in _FINAL and mark not in ".．" or not mark:
        return False
    following, place = _after_blank(text, at + 1)
    if not following or following in _GOES_ON or following in _CLOSE or following in "”\"":
        return False
    if mark in _WIDE:
        return True
    return following.isupper() or (place > at + 1 and (bool(_HAN.match(following)) or following in "“„«\"「" or following.isdigit()))


def _matched(events: list[re.Match]) -> set[int]:
    """The places of opening marks that have a closing mark of their own in their line, the nearest pairs first."""
    free, found = [0] * TYPES, set()
    for m in reversed(events):
        char = m[0][0]
        if char in "\n\r":
            free = [0] * TYPES
        elif char in _OPEN:
            if free[_OPEN[char]]:
                free[_OPEN[char]] -= 1
                found.add(m.start())
        else:
            for kind in _CLOSED_BY.get(char, ()):
                free[kind] += 1
    return found


def nesting(streams: list[list[int]]) -> list[int]:
    """For each stream a power of two that no kind of mark is nested deeper than within a line."""
    found = []
    for stream in streams:
        deepest = 1
        found.append(1)
        if sum(_S_OPEN <= x < _S_CLOSE for x in stream) < 2:
            continue
        own = [0] * TYPES
        for symbol in stream:
            if symbol == _BREAK:
                own = [0] * TYPES
            elif _S_OPEN <= symbol < _S_CLOSE:
                own[symbol - _S_OPEN] += 1
                deepest = max(deepest, own[symbol - _S_OPEN])
            else:
                kind = 2 if symbol >= _S_LOW else (symbol - _S_OPEN) % TYPES if _S_CLOSE <= symbol < _S_TOGGLE else None
                if kind is not None and own[kind]:
                    own[kind] -= 1
        found[-1] = 1 << (deepest - 1).bit_length()
    return found


def run_counter(stream: list[int]) -> np.ndarray:
    """Which symbols end a unit, by the transducer's rules with a counter for the depth: for nesting no table of states is made for."""
    kind, depth, out = -1, 0, np.zeros(len(stream), bool)
    for k, symbol in enumerate(stream):
        if symbol == _BREAK:
            depth, out[k] = 0, True
        elif symbol == _END:
            out[k] = not depth
        elif _S_OPEN <= symbol < _S_CLOSE or symbol in (_S_TOGGLE, _S_TOGGLE_END, _S_LOW, _S_LOW_END) and not depth:
            own = symbol - _S_OPEN if symbol < _S_CLOSE else 0 if symbol < _S_LOW else 1
            if not depth:
                kind, depth = own, 1
            elif kind == own:
                depth += 1
        elif symbol >= _S_CLOSE and depth:
            closes = ((symbol - _S_OPEN) % TYPES,) if symbol < _S_TOGGLE else (0,) if symbol < _S_LOW else (2,) if symbol < _S_HIGH else (1, 2)
            if kind in closes:
                final = _S_CLOSE_END <= symbol < _S_TOGGLE or symbol in (_S_TOGGLE_END, _S_LOW_END, _S_HIGH_END)
                out[k] = final and depth == 1
                depth -= 1
    return out


def symbols(text: str) -> tuple[list[int], list[int]]:
    """The symbols of a text and the place a unit would end for each."""
    found, places = [], []
    closing: dict[str, tuple[int, int]] = {}
    line_start = 0
    events = list(_EVENT.finditer(text))
    matched = _matched(events)

    def closes(chars: str, at: int) -> bool:
        """Whether one of `chars` stands behind `at` in its line."""
        kept = closing.get(chars)
        if kept is None or not kept[0] <= at < kept[1]:
            line = len(text)
            for b in "\n\r":
                if (k := text.find(b, at, line)) >= 0:
                    line = k
            hits = [k for c in chars if (k := text.rfind(c, at + 1, line)) >= 0]
            kept = closing[chars] = (at, line, max(hits, default=-1))
        return kept[2] > at

    for m in events:
        at, end, run = m.start(), m.end(), m[0]
        char = run[0]
        symbol = None
        if char in "\n\r\v\f\x85\u2028\u2029":
            if char in "\n\r":
                line_start = end
            symbol, end = _BREAK, at
        elif char.isspace():
            lead = _LEAD.match(text, line_start, at)
            if (lead is None or lead.end() < at) and _INK.search(text, line_start, at):
                symbol, end = _END, at
        elif char in ".!?。！？｡．…।॥؟۔":
            following = text[end : end + 1]
            if not _FINAL.isdisjoint(run):
                if run[-1] not in "!?" or not (following.isascii() and following.isalnum() or following in "=&/"):
                    symbol = _END
                elif not following:
                    symbol = _END
            elif run in (".", "．"):
                symbol = _END if _dot_ends(text, at, end, line_start) else None
            else:
                after, place = _after_blank(text, end)
                symbol = _END if not after or after.isupper() and place > end else None
        elif char == '"':
            if closes('"', at):
                symbol = _S_TOGGLE_END if _quote_ends(text, at) else _S_TOGGLE
            else:
                symbol = (_S_CLOSE_END if _quote_ends(text, at) else _S_CLOSE) + 0
        elif char == "“":
            if closes("”", at):
                symbol = _S_LOW_END if _quote_ends(text, at) else _S_LOW
            else:
                symbol = (_S_CLOSE_END if _quote_ends(text, at) else _S_CLOSE) + 2
        elif char == "”":
            symbol = _S_HIGH_END if _quote_ends(text, at) else _S_HIGH
        elif char in _OPEN:
            if at in matched:
                symbol = _S_OPEN + _OPEN[char]
        else:
            kind = _CLOSE[char]
            symbol = (_S_CLOSE_END if kind in _QUOTES and _quote_ends(text, at) else _S_CLOSE) + kind
        if symbol is not None:
            found.append(symbol)
            places.append(end)
    return found, places


def run_transducer(streams: list[list[int]], chunk: int = CHUNK) -> list[np.ndarray]:
    """For each stream of symbols, which of them end a unit; long streams by composed chunks."""
    depths = nesting(streams)
    if max(depths, default=1) > DEEP:
        usual = iter(run_transducer([s for s, n in zip(streams, depths) if n <= DEEP], chunk))
        return [next(usual) if n <= DEEP else run_counter(s) for s, n in zip(streams, depths)]
    step, ends = tables(max(depths, default=1))
    rows, owner, index = [], [], []
    for k, s in enumerate(streams):
        for i in range(0, max(1, len(s)), chunk):
            rows.append(s[i : i + chunk])
            owner.append(k)
            index.append(i // chunk)
    width = max(map(len, rows), default=0)
    grid = np.zeros((len(rows), max(1, width)), np.int16)
    for r, s in enumerate(rows):
        grid[r, : len(s)] = s
    owner_a, index_a = np.array(owner), np.array(index)
    start = np.zeros(len(rows), np.int32)
    if len(rows) > len(streams):
        several = np.flatnonzero(np.isin(owner_a, owner_a[index_a > 0]))
        function = np.tile(np.arange(step.shape[1], dtype=np.int32), (len(several), 1))
        for j in range(grid.shape[1]):
            function = step[grid[several, j][:, None], function]
        reach, own, no = 1, owner_a[several], index_a[several]
        while reach <= no.max():  # inclusive prefix scan within each text
            behind = np.flatnonzero(no >= reach)
            function[behind] = np.take_along_axis(function[behind], function[behind - reach], axis=1)
            reach *= 2
        later = np.flatnonzero(no > 0)
        start[several[later]] = function[later - 1, 0]
        assert (own[later - 1] == own[later]).all()
    ended, state = np.zeros(grid.shape, bool), start
    for j in range(grid.shape[1]):
        ended[:, j] = ends[grid[:, j], state]
        state = step[grid[:, j], state]
    out: list[list[np.ndarray]] = [[] for _ in streams]
    for r, k in enumerate(owner):
        out[k].append(ended[r, : len(rows[r])])
    return [np.concatenate(x) for x in out]


def units(texts: list[str]) -> list[list[tuple[int, int]]]:
    """(start, end) of the units of each text."""
    read = [symbols(t) for t in texts]
    out = []
    for text, (_, places), ended in zip(texts, read, run_transducer([s for s, _ in read])):
        rows, begin = [], 0
        for end in [*(p for p, e in zip(places, ended.tolist()) if e), len(text)]:
            part = text[begin:end]
            left, right = len(part) - len(part.lstrip()), len(part.rstrip())
            if right > left:
                rows.append((begin + left, begin + right))
            begin = max(begin, end)
        out.append(rows)
    return out


def sentences(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, sentence_no, start_char, end_char, sentence): the units of every text in order, numbered from 1."""
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
                rows = [(i, n, s, e, t[s:e]) for i, t, found in zip(ids, texts, units(texts)) for n, (s, e) in enumerate(found, 1)]
                cols = list(zip(*rows)) or [[]] * 5
                kinds = [batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "sentence_no", "start_char", "end_char", "sentence"])

    return rows.mapInArrow(run, f"id {kind}, sentence_no int, start_char int, end_char int, sentence string")
