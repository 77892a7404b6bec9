"""Problem 7: evaluation passages inside corpus documents.

Size-partitioned MinHash containment search. An item leaks if one of its windows (15 words in a row, or 32 letters and
digits for languages written without blanks) stands in a document. A window is a small set of shingles (11 of five words, or
17 of sixteen characters); a document is partitioned by size into all its overlapping windows of the same number of shingles, so
that where an item's window is contained, the document's window is the same set and has the same MinHash, whatever the
document's length: containment 1 of equal sizes, found with certainty. A key combines the MinHashes of four hash functions, so that windows
which merely share some shingles (set phrases) seldom meet. An item leaks from one window on, so for an item of w windows the least
containment asked for is 1 / w: all its windows are searched, not a sample of them.

The items' keys are marked in a bitmap of `PER_KEY` bits for each key counted, `MOST_BITS` (32 MB) at most, which is what every executor
gets; a document goes on only with windows whose keys are marked there, which loses none. Beyond that bound more unmarked windows
pass by chance and the join sorts them out: slower, never fewer. Items and documents meet on the keys in a shuffled join that
carries the windows' own words, never whole texts, and a pair counts only where the words are equal too: the exact shingles of one window.

Words are runs of letters and digits of the case-folded canonical form. Defined cases: null ids, texts and passages are left out;
a passage shorter than one window leaks nowhere; copies of documents count each; a null language is one written with blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from .canonical import canonical

_WORD = re.compile(r"[^\W_]+")
WORDS, WORD_SHINGLE, CHARS, CHAR_SHINGLE = 15, 5, 32, 16
ROWS, BLOCK = 4, 200
PER_KEY, PROBES, MOST_BITS, PAGE = 16, 8, 1 << 28, 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of the case-folded form."""
    return _WORD.findall(canonical(text).casefold())


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b >> np.uint64(7)) ^ (b << np.uint64(57))) * _MIX
    h ^= h >> np.uint64(29)
    return h


def _runs(codes: np.ndarray, width: int, join) -> np.ndarray:
    """`join` folded over each `width` codes in a row, by doubling; for a join that may see a code twice, or a power of two and less than one more."""
    done = 1
    while done * 2 <= width:
        codes = join(codes[:-done], codes[done:])
        done *= 2
    return codes if done == width else join(codes[: len(codes) - (width - done)], codes[width - done :])


def _signatures(codes: np.ndarray, sizes: np.ndarray, shingle: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, begin) of all windows of `window` codes of texts laid end to end, as sets of shingles of `shingle` codes: ROWS MinHashes in one key.

    Windows that reach over the end of a text are left out.
    """
    if len(codes) < window:
        return np.array([], np.uint64), np.array([], np.int64)
    with np.errstate(over="ignore"):
        h = _runs(codes, shingle, _mixed)
        key = np.zeros(len(codes) - window + 1, np.uint64)
        for row in range(1, ROWS + 1):
            other = (h ^ np.uint64(row * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) * _MIX
            other ^= other >> np.uint64(32)
            key = (key ^ _runs(other, window - shingle + 1, np.minimum)) * _MIX
            key ^= key >> np.uint64(29)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(key)]
    whole = np.flatnonzero(np.arange(len(key)) + window <= ends[owner])
    return key[whole], whole


@lru_cache(maxsize=1)
def _letters_and_digits() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


class Windows:
    """All word windows and character windows of some texts: `keys` (the kind is the last bit), `owner` the text of each, and its own words on demand.

    A word's code is the sum of its characters' codes, each mixed with its place in the word.
    """

    def __init__(self, texts: list[str]):
        plain = [canonical(t).casefold() for t in texts]
        flat = np.frombuffer("\0".join([*plain, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in plain])
        there = _letters_and_digits()[flat]
        begins = there & np.concatenate([[True], ~there[:-1]])
        self.chars, owner = flat[there], text_of[there]
        chars = self.chars.astype(np.uint64)
        self.starts = np.append(np.flatnonzero(begins[there]), len(chars))
        starts = self.starts[:-1]
        place = np.arange(len(chars)) - np.repeat(starts, np.diff(self.starts))
        with np.errstate(over="ignore"):
            mixed = (chars + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) | np.uint64(1))
            mixed = (mixed ^ mixed >> np.uint64(31)) * _MIX
            mixed ^= mixed >> np.uint64(29)
            words = np.add.reduceat(mixed, starts) if len(starts) else chars
        a, x = _signatures(words, np.bincount(owner[starts], minlength=len(texts)), WORD_SHINGLE, WORDS)
        b, y = _signatures(chars, np.bincount(owner, minlength=len(texts)), CHAR_SHINGLE, CHARS)
        self.keys, self.begin = np.concatenate([a & ~np.uint64(1), b | np.uint64(1)]), np.concatenate([x, y])
        self.owner = np.concatenate([owner[starts][x] if len(x) else x, owner[y] if len(y) else y])

    def _text(self, start: int, end: int) -> str:
        return self.chars[start:end].tobytes().decode("utf-32-le", "surrogatepass")

    def words(self, k: int) -> str:
        """The words of window k, a blank between them, or its characters."""
        at = int(self.begin[k])
        if self.keys[k] & np.uint64(1):
            return self._text(at, at + CHARS)
        return " ".join(self._text(s, e) for s, e in zip(self.starts[at : at + WORDS].tolist(), self.starts[at + 1 : at + WORDS + 1].tolist()))

    def rows(self, wanted: np.ndarray, ids: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(id, key, words) of the wanted windows, each once for a text."""
        own = {(int(self.owner[k]), int(self.keys[k]), self.words(k)): None for k in wanted.tolist()}
        return (
            ids.take(pa.array([o for o, _, _ in own], pa.int64())), pa.array(np.array([k for _, k, _ in own], np.uint64).view(np.int64)),
            pa.array([w.encode("utf-8", "surrogatepass") for _, _, w in own], pa.binary()),
        )


def _item_pass(unspaced: tuple[str, ...]):
    """Rows (item_id, key, words) of the windows of each passage's language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                by_chars = np.array([lang in unspaced for lang in batch.column(2).to_pylist()], bool)
                found = Windows(batch.column(1).to_pylist())
                wanted = np.flatnonzero(by_chars[found.owner] == (found.keys & np.uint64(1)).astype(bool))
                yield pa.RecordBatch.from_arrays(list(found.rows(wanted, batch.column(0))), names=["item_id", "key", "words"])

    return run


def _place(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Where each key is marked at one of the PROBES, which are mixed apart; bits is at most 2 ** 32."""
    with np.errstate(over="ignore"):
        h = (keys ^ np.uint64((probe + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * _MIX
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD1B54A32D192ED03)
        return (h >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)


def _mark_pass(bits: int):
    """Pages (page, bits) of the bitmap with this partition's keys marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            for probe in range(PROBES):
                order = np.sort(_place(np.asarray(batch.column(0)).view(np.uint64), probe, bits))
                page, first = np.unique(order >> np.uint64(15), return_index=True)
                for p, own in zip(page.tolist(), np.split(order, first[1:])):
                    marks = pages.setdefault(p, np.zeros(PAGE // 8, np.uint8))
                    np.bitwise_or.at(marks, (own % np.uint64(PAGE) >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (own & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([m.tobytes() for m in pages.values()], pa.binary())], names=["page", "bits"])

    return run


def key_filter(keys: DataFrame) -> bytes:
    """A bitmap with all values of `key` marked; its size follows their number, up to MOST_BITS."""
    count = keys.count()
    bits = min(MOST_BITS, PAGE * (PER_KEY * count // PAGE + 1))  # whole pages
    bitmap = np.zeros(bits // 8, np.uint8)
    # Rows are pages of 4 kB: together a bitmap for each of the few partitions.
    for page, marks in keys.coalesce(4).mapInArrow(_mark_pass(bits), "page bigint, bits binary").toLocalIterator():
        bitmap[page * PAGE // 8 : (page + 1) * PAGE // 8] |= np.frombuffer(marks, np.uint8)
    return bitmap.tobytes()


def marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where in `keys` (uint64) those are that the bitmap of `key_filter` has: all that were marked, and few others."""
    wanted = np.arange(len(keys))
    for probe in range(PROBES):
        place = _place(keys[wanted], probe, len(marks) * 8)
        wanted = wanted[(marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return wanted


def _document_pass(bitmap):
    """Rows (doc_id, key, words) of the windows whose keys an item may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bitmap.value, np.uint8)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                found = Windows(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(list(found.rows(marked(found.keys, marks), batch.column(0))), names=["doc_id", "key", "words"])

    return run


def shared_run(document: list[str], passage: list[str], by_chars: bool) -> tuple[bool, float]:
    """Whether a whole window is shared, and the share of the passage's windows that are."""
    if by_chars:
        doc, own = "".join(document), "".join(passage)
        total = len(own) - CHARS + 1
        hits = sum(own[i : i + CHARS] in doc for i in range(total))
    else:
        doc, total = " " + " ".join(document) + " ", len(passage) - WORDS + 1
        hits = sum(" " + " ".join(passage[i : i + WORDS]) + " " in doc for i in range(total))
    return hits > 0, hits / total if total > 0 else 0.0


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", language: str = "language", unspaced: tuple[str, ...] = ("zh", "ja")
) -> DataFrame:
    """(doc_id, item_id, share): every document with every item it holds a window of, and the share of the item's different windows."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    held = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage"), F.lower(F.trim(F.split(F.col(language), "[-_]")[0])).alias("lang"))
    held = held.where("item_id is not null and passage is not null")
    d, i = docs.schema["doc_id"].dataType.simpleString(), held.schema["item_id"].dataType.simpleString()
    windows = written(held.select("item_id", "passage", "lang").mapInArrow(_item_pass(unspaced), f"item_id {i}, key bigint, words binary").distinct())
    bitmap = spark.sparkContext.broadcast(key_filter(windows.select("key").distinct()))
    suspects = docs.mapInArrow(_document_pass(bitmap), f"doc_id {d}, key bigint, words binary")
    hits = suspects.join(windows, ["key", "words"]).groupBy("doc_id", "item_id").agg(F.countDistinct("words").alias("hits"))
    whole = windows.groupBy("item_id").agg(F.countDistinct("words").alias("whole"))
    return hits.join(whole, "item_id").select("doc_id", "item_id", (F.col("hits") / F.col("whole")).alias("share"))
