"""Problem 6: items over a size limit, cut into pieces at natural boundaries.

A text is first divided into atomic segments, each ending at a boundary and weighted by how strong it is (heading, blank
line, line end, sentence end, clause end, blank); a run without any boundary is cut at the size. All adjacent pairs
lie in a heap by weight, and the weakest boundary is merged first while both sides and the overlap fit together.
Each piece but the first repeats the last characters of the piece before, up to `overlap`, from a boundary on
where one lies in that reach, and never more than the limit leaves room for.

Defined cases: texts at or under the limit and null texts give no piece here; positions and sizes are code points as stored;
joining the pieces without their overlap gives the text again exactly. The heading path of a piece is that of the item, continued by
the headings in the text (`#` marks) up to the piece's own start, its own heading included.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", re.M)
# Boundaries from strong to weak; the end of the match is where a segment ends.
_BOUNDARIES = (
    (6, re.compile(r"\n(?=#{1,6}[ \t])")),
    (5, re.compile(r"\n[ \t]*\n\s*")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？｡．]+[”’」』）]*\s*|[।؟]\s*")),
    (2, re.compile(r"[;:,]\s+|[；：，、،]\s*")),
    (1, re.compile(r"\s+|​")),
)


def segments(text: str, size: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments and the weights of those boundaries; no segment is longer than `size`."""
    weight: dict[int, int] = {}
    for w, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                weight.setdefault(m.end(), w)
    ends, weights, last = [], [], 0
    for end in [*sorted(weight), len(text)]:
        while end - last > size:
            last += size
            ends.append(last)
            weights.append(0)
        if end > last:
            ends.append(end)
            weights.append(weight.get(end, 7))
            last = end
    return ends, weights


def cut(text: str, limit: int = 1250, overlap: int = 100) -> list[tuple[int, int, int]]:
    """(start with overlap, own start, end) of each piece."""
    room = limit - overlap
    ends, weights = segments(text, room)
    starts = [0, *ends[:-1]]
    after, before, size = list(range(1, len(ends))) + [-1], [-1, *range(len(ends) - 1)], [e - s for s, e in zip(starts, ends)]
    alive = [True] * len(ends)
    heap = [(weights[i], size[i] + size[i + 1], i, i + 1) for i in range(len(ends) - 1)]
    heapq.heapify(heap)
    while heap:
        _, both, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or both != size[i] + size[j]:
            continue
        if both > room:
            continue
        alive[j] = False
        size[i], ends[i], weights[i], after[i] = both, ends[j], weights[j], after[j]
        if after[i] >= 0:
            before[after[i]] = i
            heapq.heappush(heap, (weights[i], both + size[after[i]], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (weights[before[i]], size[before[i]] + both, before[i], i))
    out, last = [], 0
    marks = sorted(m.end() for _, p in _BOUNDARIES for m in p.finditer(text))
    at = 0
    for i in range(len(ends)):
        if not alive[i]:
            continue
        own = starts[i]
        back = own
        if own:
            lowest = max(last, own - overlap)
            while at < len(marks) and marks[at] < lowest:
                at += 1
            back = marks[at] if at < len(marks) and marks[at] < own else lowest
        out.append((back, own, ends[i]))
        last = own
    return out


def pieces_of(text: str, path: list[str] | None, limit: int, overlap: int) -> list[tuple[int, int, int, str, list[str]]]:
    """(number from 1, own start, overlap length, piece, heading path)."""
    path = [x for x in path or [] if x is not None]
    found, rows, stack = list(_HEADING.finditer(text)), [], []
    k = 0
    for number, (back, own, end) in enumerate(cut(text, limit, overlap), 1):
        while k < len(found) and found[k].start() <= own:
            level = len(found[k][1])
            stack = [x for x in stack if x[0] < level] + [(level, found[k][2])]
            k += 1
        inner = [t for _, t in stack]
        whole = path + inner[1:] if path and inner and path[-1] == inner[0] else path + inner
        rows.append((number, own, own - back, text[back:end], whole))
    return rows


def cut_oversized(df: DataFrame, row_id: str, text: str, path: str, limit: int = 1250, overlap: int = 100) -> DataFrame:
    """(id, piece_no, own_start, overlap, piece, heading_path): pieces of at most `limit` code points of every text above it."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    rows = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.col(path).alias("path")).where(F.char_length("text") > limit)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, cols = [], [[], [], [], [], []]
                for row, t, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    for values in pieces_of(t, p, limit, overlap):
                        ids.append(row)
                        for c, v in zip(cols, values):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column(0).type), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    names=["id", "piece_no", "own_start", "overlap", "piece", "heading_path"],
                )

    return rows.mapInArrow(run, f"id {kind}, piece_no int, own_start int, overlap int, piece string, heading_path array<string>")
