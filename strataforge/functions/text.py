"""Text expressions that stay in the JVM, and the exact tokenizer as an Arrow-batched function."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed value: the token pattern, on the NFKC and case-folded text.
TOKEN = "[a-z][a-z0-9_.-]*|[0-9]+|[㐀-鿿]+"
_TOKEN = re.compile(TOKEN)


def tokens_of(text: str) -> list[str]:
    """Latin words, digit runs and pairs of neighbouring Han characters (a single one stays) after NFKC and full case folding."""
    out: list[str] = []
    for word in _TOKEN.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold()):
        out.extend([word[i : i + 2] for i in range(max(1, len(word) - 1))] if word[0] >= "㐀" else [word])
    return out


@F.pandas_udf(ArrayType(StringType()))
def _tokens(x: pd.Series) -> pd.Series:
    return x.map(tokens_of)


def tokens(text: Column) -> Column:
    """The tokens of a text column; null gives none. Built-in expressions know neither NFKC nor full case folding, hence one Arrow-batched function."""
    return _tokens(F.coalesce(text, F.lit("")))


def squeeze(text: Column) -> Column:
    """Blanks and line breaks collapsed to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(squeeze(text), 256)


# The same in the SQL the queries are compared with.
SQL_TOKEN = TOKEN.replace("㐀", "\\x{3400}").replace("鿿", "\\x{9fff}")


@lru_cache(maxsize=1)
def _compatibility() -> tuple[str, str, list[tuple[str, str]], list[tuple[str, str]]]:
    """By rule over all characters: those NFKC writes as one other character and those, as several, where a token character is among them; and letters folded to several."""
    single, multiple, folded = [], [], []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if plain != unicodedata.normalize("NFC", char) and _TOKEN_CHARACTER.search(plain.casefold()):
            (single if len(plain) == 1 else multiple).append((char, plain))
        elif plain == char and len(char.casefold()) > 1 and _TOKEN_CHARACTER.search(char.casefold()):
            folded.append((char, char.casefold()))
    return "".join(a for a, _ in single), "".join(b for _, b in single), multiple, folded


_TOKEN_CHARACTER = re.compile("[a-z0-9_.㐀-鿿-]")


def sql_fold(text: str) -> str:
    """NFKC and case folding as far as tokens can tell, written out with the functions the SQL engine has."""
    plain, to, multiple, folded = _compatibility()
    several = text
    for a, b in multiple:
        several = f"replace({several}, '{a}', '{b}')"
    out = f"translate(CASE WHEN regexp_matches({text}, '[{''.join(a for a, _ in multiple)}]') THEN {several} ELSE {text} END, '{plain}', '{to}')"
    out = f"nfc_normalize({out})"
    for a, b in folded:
        out = f"replace({out}, '{a}', '{b}')"
    return f"lower({out})"


def sql_tokens(text: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all({sql_fold(f"coalesce({text}, '')")}, '{SQL_TOKEN}'), lambda w: "
        "CASE WHEN regexp_matches(w, '^[\\x{3400}-\\x{9fff}]') THEN list_transform(range(1, greatest(1, length(w) - 1) + 1), lambda i: substr(w, i, 2)) ELSE [w] END))"
    )


def sql_squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\t\\r\\n]+', ' ', 'g'))"
