"""A term index over the fields of a corpus, built once in one pass over the texts and read by all rankers.

The index is a written table (pos, field, term, tf, length): one row for each distinct term of a field, and one without a term for
every row and field, with the length of the field (0 for null and empty texts). Statistics of any part of it are plain aggregations.

An index is kept for the same corpus plan over the same files (names, sizes and times of change), so a second ranking in a session finds it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens_of
from ..plans.tables import file_stamps, written
from . import best

_KNOWN: dict[tuple, DataFrame] = {}


def _index_pass(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, names, terms, counts, lengths = [], [], [], [], []
                for k, field in enumerate(fields, 1):
                    for pos, text in zip(batch.column(0).to_pylist(), batch.column(k).to_pylist()):
                        found = tokens_of(text) if text else []
                        own = Counter(found)
                        ids += [pos] * (len(own) + 1)
                        names += [field] * (len(own) + 1)
                        terms += [None, *own]
                        counts += [0, *own.values()]
                        lengths += [len(found)] * (len(own) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column(0).type), pa.array(names, pa.string()), pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["pos", "field", "term", "tf", "length"],
                )

    return run


def built(corpus: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """The index of the corpus (pos and what the fields are made of); rows without pos are left out."""
    rows = corpus.where("pos is not null").select("pos", *(c.cast("string").alias(name) for name, c in fields.items()))
    key = (corpus.sparkSession.sparkContext.applicationId, rows.semanticHash(), file_stamps(corpus))
    if key not in _KNOWN:
        kind = rows.schema["pos"].dataType.simpleString()
        _KNOWN[key] = written(rows.mapInArrow(_index_pass(list(fields)), f"pos {kind}, field string, term string, tf bigint, length bigint"))
    return _KNOWN[key]


def forget() -> None:
    """Drop what is known of built indexes, as when their tables are removed."""
    best.forget()
    _KNOWN.clear()


def postings(index: DataFrame, field: str | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(pos, field, term, tf, length) of one field or all, of the wanted terms or all."""
    rows = index.where(F.col("term").isNotNull() & (F.col("field") == field if field else F.lit(True)))
    return rows.join(terms.select("term").distinct(), "term", "left_semi") if terms is not None else rows


def averages(index: DataFrame, fields: list[str]) -> DataFrame:
    """One row: n, the number of corpus rows, and avg_<field>, the mean length of each field."""
    rows = index.where(F.col("term").isNull())
    return rows.agg(F.count_if(F.col("field") == fields[0]).alias("n"), *(F.avg(F.when(F.col("field") == f, F.col("length"))).alias(f"avg_{f}") for f in fields))
