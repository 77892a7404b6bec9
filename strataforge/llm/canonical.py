"""Problem 1: one form for texts a reader cannot tell apart.

Every word with a character that is not plain is walked, as stored, through a trie of vocabulary words by a weighted edit
automaton: taking an edge whose character is drawn like the word's next character costs nothing, whatever the two are encoded as (another
alphabet, full width, one letter for two, an accent apart), skipping a character that shows nothing costs nothing, any other edit costs
one. With the cost bound 0 (the default) only words that look the same are met, and the vocabulary's spelling is taken; words not met are
spelled by table. Both depend only on what the word looks like, so equal looks give equal forms and different looks different ones.
Plain Latin words stay as they are without a walk, so whatever can be written in Latin letters is: there only Latin words are taken.

The vocabulary is that of a public tokenizer (a fixed file, its path is a parameter; a missing file is an error), so the form
of a text depends on no other text.

Defined cases: null stays null, the empty text stays empty; letter case, accents, raised, circled and
fraction digits, punctuation, the number of blanks and line breaks are kept. CR LF, NEL and the Unicode line
and paragraph separators become a line feed, tabs a blank. Joiners stay where they change the drawing
(after Arabic and Indic letters, within emoji).
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.tables import written

# Letters of other alphabets and the Latin letters they are drawn like (after the public Unicode confusables).
ALIKE = {
    "cyrillic": ("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХЅІЈҮԚԜ", "aeopcyxijshdqwABEKMHOPCTYXSIJYQW"),
    "greek": ("οϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿ", "ojABEZHIKMNOPTYXJ"),
    "armenian": ("օսՕՍ", "ouOU"),
}
# Hyphens drawn alike; characters that show nothing beside the category Cf.
HYPHENS = "‐‑﹣－"
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

PROTOTYPE = {ord(c): k for own, latin in ALIKE.values() for c, k in zip(own, latin)}
DRAWN_LIKE: dict[str, str] = {}
for _code, _plain in PROTOTYPE.items():
    DRAWN_LIKE[_plain] = DRAWN_LIKE.get(_plain, _plain) + chr(_code)
BACK = {script: {k: c for c, k in reversed(list(zip(own, latin)))} for script, (own, latin) in ALIKE.items()}
_JOINED = re.compile("(?<![؀-ࣿऀ-\u0dff\u1000-႟ក-៿\U0001f000-\U0001faff☀-➿️])[‌‍]")
_LETTER = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u0300-\u036f\u0370-\u058f\u1e00-\u1fff]+")
_FOREIGN = re.compile("[\u0370-\u058f\u1f00-\u1fff]")
# A text without any of these has its form already.
_SUSPECT = re.compile(
    "[^\\n\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u0131\\u0134-\\u017f\\u0e00-\\u0e7f\\u3001-\\u303f\\u3041-\\u3098\\u309b-\\u30ff\\u3400-\\u9fff"
    "\\uff01-\\uff0c\\uff0e\\uff0f\\uff1a-\\uff20\\uff3b-\\uff40\\uff5b-\\uff65\\u2012-\\u2027\\u00b2\\u00b3\\u2460-\\u24ff]"
)


class _Fold(dict):
    """Character to what it is written as; filled by rule when first asked."""

    def __missing__(self, code: int) -> str | None:
        char = chr(code)
        kind = unicodedata.category(char)
        if char in HYPHENS:
            out = "-"
        elif kind == "Zs" or char == "\t":
            out = " "
        elif char in "\x85\u2028\u2029":
            out = "\n"
        elif char in "‌‍":
            out = char
        elif kind == "Cf" and not 0x600 <= code <= 0x8FF or char in UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE0FFF:
            out = None
        elif (
            0xFB00 <= code <= 0xFB06  # ligatures
            or 0x2160 <= code <= 0x217F  # letters of Roman numbers
            or 0x2E80 <= code <= 0x2FD5  # radicals
            or 0xF900 <= code <= 0xFAFF or 0x2F800 <= code <= 0x2FA1F  # doubled ideographs
            or 0xFF66 <= code <= 0xFFDC  # narrow kana and hangul
            or (0xFF01 <= code <= 0xFF5E and unicodedata.normalize("NFKC", char).isalnum())
            or 0x132 <= code <= 0x133 or 0x1C4 <= code <= 0x1CC or 0x1F1 <= code <= 0x1F3  # two letters in one
        ):
            out = unicodedata.normalize("NFKC", char)
        else:
            out = char
        self[code] = out
        return out


_FOLD = _Fold()


def look(word: str) -> str:
    """What a folded word looks like: Latin letters wherever another alphabet's letter is drawn alike."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(PROTOTYPE))


@lru_cache(maxsize=100_000)
def drawn(char: str) -> tuple[str, ...]:
    """What a character is drawn as: decomposed characters of the Latin alphabet where there is one alike; none if it shows nothing."""
    if char in "‌‍":
        return ()
    folded = char.translate(_FOLD)
    return tuple(PROTOTYPE.get(ord(c), c) for c in unicodedata.normalize("NFD", folded))


class Trie:
    """Vocabulary words by decomposed characters, with the edit automaton that walks them."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for char in unicodedata.normalize("NFD", word):
                node = node.setdefault(char, {})
            node.setdefault("", word)

    def nearest(self, word: str, bound: int = 0) -> str | None:
        """The vocabulary word of least cost within `bound`, among equals the first in code point order; only a Latin one if the word can be Latin."""
        marks = _ordered([c for char in word for c in drawn(char)])
        states: list[tuple[dict, int]] = [(self.root, 0)]
        for own in marks:
            least: dict[int, tuple[dict, int]] = {}
            for node, cost in states:
                # Edges drawn like `own` are free; with a bound, leaving out a character of the word, taking another edge or an edge more cost one.
                steps = [(node[edge], cost) for edge in DRAWN_LIKE.get(own, own) if edge in node]
                if bound:
                    others = [below for edge, below in node.items() if edge]
                    steps += [(node, cost + 1), *((below, cost + 1) for below in others)]
                    steps += [(under[edge], cost + 1) for under in others for edge in DRAWN_LIKE.get(own, own) if edge in under]
                for below, now in steps:
                    if now <= bound and now < least.get(id(below), (None, bound + 1))[1]:
                        least[id(below)] = (below, now)
            states = list(least.values())
            if not states:
                return None
        if bound:  # one edge more at the end
            states += [(below, cost + 1) for node, cost in states if cost < bound for edge, below in node.items() if edge]
        latin = not any(_FOREIGN.match(c) for c in marks)
        ends = sorted((cost, node[""]) for node, cost in states if "" in node and not (latin and _FOREIGN.search(node[""])))
        return ends[0][1] if ends else None


def _ordered(marks: list[str]) -> list[str]:
    """Decomposed characters with the accents of each letter in their fixed order."""
    return list(unicodedata.normalize("NFD", "".join(marks)))


@lru_cache(maxsize=4)
def vocabulary(path: str | None) -> Trie:
    """The words of one alphabet, Latin or another, in a public tokenizer's file of ranks, the default being its many-language one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    words = []
    with open(path, "rb") as lines:
        for line in lines:
            try:
                word = base64.b64decode(line.split()[0]).decode().strip()
            except (UnicodeDecodeError, IndexError):
                continue
            if len(word) > 1 and _LETTER.fullmatch(word) and len(alphabets(word)) == 1:
                words.append(word)
    return Trie(words)


def alphabets(word: str) -> set[str]:
    """The alphabets a word's letters belong to."""
    return {"accent" if 0x300 <= ord(c) <= 0x36F else _alphabet(ord(c)) for c in unicodedata.normalize("NFD", word)} - {"accent"}


def _alphabet(code: int) -> str:
    return "greek" if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000 else "cyrillic" if 0x400 <= code < 0x530 else "armenian" if 0x530 <= code < 0x590 else "latin"


def by_table(word: str) -> str:
    """The spelling of a folded word by table: in its own alphabet where that can write all of it, else in Latin letters where there are any alike."""
    seen = look(word)
    plain = unicodedata.normalize("NFD", seen)
    scripts = alphabets(seen) - {"latin"}
    if len(scripts) != 1:
        return seen
    back = BACK[scripts.pop()]
    if any(c not in back for c in plain if c.isascii() and c.isalpha()):
        return seen
    return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in plain))


@lru_cache(maxsize=200_000)
def spelling(word: str, path: str | None = None) -> str:
    """The one spelling of all words, as stored, that look like `word`."""
    if (known := vocabulary(path).nearest(word)) is not None:
        return unicodedata.normalize("NFC", known)
    return by_table(unicodedata.normalize("NFC", word.translate(_FOLD).replace("‌", "").replace("‍", "")))


@lru_cache(maxsize=1)
def _word_pattern() -> re.Pattern:
    """Words as stored: letters in any encoding, and characters that show nothing behind a letter; found by rule over all characters."""
    letters, unseen = [], []
    for code in [*range(0x41, 0x7B), *range(0x80, 0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE1000)]:
        folded = _FOLD[code]
        if folded is None or chr(code) in "‌‍":
            unseen.append(code)
        elif _LETTER.fullmatch(unicodedata.normalize("NFD", folded)):
            letters.append(code)
    inside = _ranges(letters)
    return re.compile(f"[{inside}](?:[{inside}{_ranges(unseen)}]*[{inside}])?")


def _ranges(codes: list[int]) -> str:
    out, first = [], None
    for k, code in enumerate(codes):
        first = code if first is None else first
        if k + 1 == len(codes) or codes[k + 1] != code + 1:
            out.append(re.escape(chr(first)) + "-" + re.escape(chr(code)))
            first = None
    return "".join(out)


def canonical(text: str | None, path: str | None = None) -> str | None:
    """The one form of `text`."""
    if text is None or not _SUSPECT.search(text):
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _word_pattern().sub(lambda m: m[0] if m[0].isascii() or not _SUSPECT.search(m[0]) else spelling(m[0], path), text)
    text = text.translate(_FOLD)
    if "‌" in text or "‍" in text:
        text = _JOINED.sub("", text)
    return unicodedata.normalize("NFC", text)


def canonical_column(text: str, path: str | None = None) -> Column:
    """The one form of the column `text`, as an Arrow-batched function."""

    @F.pandas_udf(StringType())
    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda t: canonical(t, path), na_action="ignore")

    return fold(F.col(text))


def with_canonical(df: DataFrame, text: str, out: str = "canonical", path: str | None = None) -> DataFrame:
    """`df` with the one form of column `text` in a further column `out`; a column of that name is replaced. All rows stay."""
    return df.withColumn(out, canonical_column(text, path))


def _digests(df: DataFrame, row_id: str, text: str, path: str | None) -> DataFrame:
    """(id, own, form): 128-bit digests of each text and of its one form, in one pass over the texts; null ids and texts are left out."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, form = [], []
            for t in batch.column(1).to_pylist():
                own.append(xxhash.xxh3_128_digest(t))
                form.append(xxhash.xxh3_128_digest(now) if (now := canonical(t, path)) is not t else own[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(form, pa.binary())], names=["id", "own", "form"])

    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return written(rows.mapInArrow(digests, f"id {rows.schema['id'].dataType.simpleString()}, own binary, form binary"))


def _spellings(rows: DataFrame) -> DataFrame:
    """(form, own, rows, least): the stored spellings of every form that has one besides itself, with their number of rows and smallest id."""
    odd = rows.where("own <> form").select("form").distinct()
    return rows.groupBy("form", "own").agg(F.count("*").alias("rows"), F.min("id").alias("least")).join(odd, "form", "left_semi")


def look_alike_classes(df: DataFrame, row_id: str, text: str, path: str | None = None) -> DataFrame:
    """(class_id, id, spelling_id, class_rows, spellings): one row for each row whose text looks like another, differently stored one.

    `class_id` is the smallest id of all rows that look the same, `spelling_id` the smallest of those stored the same. No pairs are made.
    """
    rows = _digests(df, row_id, text, path)
    spellings = _spellings(rows)
    whole = spellings.groupBy("form").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_rows"), F.count("*").alias("spellings")).where("spellings > 1")
    placed = spellings.join(whole, "form").select("own", "class_id", F.col("least").alias("spelling_id"), "class_rows", "spellings")
    return rows.select("own", "id").join(placed, "own").select("class_id", "id", "spelling_id", "class_rows", "spellings")


def look_alike_pairs(df: DataFrame, row_id: str, text: str, path: str | None = None) -> DataFrame:
    """(id_a, id_b): rows whose texts look the same but differ, the smaller id first.

    Pairs are formed between different spellings, each a group of equal texts, and only then spread over the rows of the two,
    so the rows of a hot text never meet each other.
    """
    rows = _digests(df, row_id, text, path)
    own = _spellings(rows).select("form", "own")
    a, b = own.select("form", F.col("own").alias("own_a")), own.select("form", F.col("own").alias("own_b"))
    spellings = a.join(b, "form").where("own_a < own_b").select("own_a", "own_b")
    rows_a, rows_b = rows.select(F.col("own").alias("own_a"), F.col("id").alias("x")), rows.select(F.col("own").alias("own_b"), F.col("id").alias("y"))
    pairs = spellings.join(rows_a, "own_a").join(rows_b, "own_b")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
