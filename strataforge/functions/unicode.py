"""Unicode functions Spark has no built-in expression for, as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANK = re.compile(r"\s+")


def squeezed(text: str) -> str:
    """NFKC, all blanks and line breaks collapsed to one blank, trimmed."""
    return _BLANK.sub(" ", unicodedata.normalize("NFKC", text)).strip()


@F.pandas_udf(StringType())
def normalize_text(x: pd.Series) -> pd.Series:
    return x.map(squeezed, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(x: pd.Series) -> pd.Series:
    return x.map(str.casefold, na_action="ignore")
