"""Cutting long texts into overlapping pieces at natural boundaries.

The separators form a hierarchy: section, paragraph, line, sentence, word,
character. A text is cut at the coarsest level; whatever is still too long is
cut at the next, and so on, so that nothing is torn that fits a piece. The parts
are then packed greedily: a piece takes parts up to the limit, and the next one
begins the overlap before its end.

Positions count Unicode code points.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")

# Where a part may end, after the match, by level.
_ENDS = (
    re.compile(r"\n(?:[ \t]*\r?\n){2,}|\f|\n(?=[ \t]*(?:#{1,6} |={3,}|-{3,}|\d{1,2}\. [A-Z]))"),
    re.compile(r"\n[ \t]*\r?\n"),
    re.compile(r"[\n\r\u2028\u2029]+"),
    re.compile(r"[.!?]+[\"'”’»)\]]*\s+|[。！？．]+[”’」』》）]*"),
    re.compile(r"\s+"),
)
#: A stretch that holds neither white space nor a sentence mark.
_UNBROKEN = re.compile(r"[^\s.!?。！？．]+")


def _whole_characters(text: str, at: int, lo: int) -> int:
    """The last place up to ``at`` that parts no combining sequence, unless all of it is one."""
    i = at
    while i > lo + 1 and i < len(text) and (unicodedata.combining(text[i]) or text[i] in "\u200d\ufe0f" or text[i - 1] == "\u200d"):
        i -= 1
    return i if i > lo + 1 else at


def parts_of(text: str, room: int) -> tuple[list[tuple[int, int]], int]:
    """(end, level of its end) of consecutive parts, and the longest unbroken stretch among those without any boundary.

    A span is cut at a level only if no coarser one makes it fit ``room``. A
    part is longer only if it has no boundary at all and must be torn.
    """
    done: list[tuple[int, int]] = []
    longest = 0
    stack = [(0, len(text), 0, len(_ENDS))]  # span, level to cut at, level of its end
    while stack:
        lo, hi, level, own = stack.pop()
        if hi - lo <= room or level == len(_ENDS):
            if hi - lo > room:
                longest = max([longest, *(m.end() - m.start() for m in _UNBROKEN.finditer(text, lo, hi))])
            done.append((hi, own))
        else:
            ends = [m.end() for m in _ENDS[level].finditer(text, lo, hi) if lo < m.end() < hi]
            bounds = [lo, *ends, hi]
            stack.extend((bounds[i], bounds[i + 1], level + 1, own if i + 2 == len(bounds) else level) for i in range(len(bounds) - 2, -1, -1))
    return done, longest


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut at its end) of every piece; the last piece has the level ``end``.

    A text within the limit is one piece, an empty one none.
    """
    return _pieces(text, limit, overlap)[0]


def _pieces(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, str]], int]:
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return ([(0, n, "end")] if n else []), 0
    # A part must fit behind the overlap, or a piece could not take it.
    room = limit - overlap
    parts, longest = parts_of(text, room)
    out, start, at, end = [], 0, 0, 0
    while n - start > limit:
        level = len(_ENDS)
        while parts[at][0] - start <= limit:
            end, level = parts[at]
            at += 1
        # What has to be torn anyway fills the piece.
        if parts[at][0] - end > room and start + limit > end or end - start <= overlap:
            end, level = _whole_characters(text, start + limit, start + overlap), len(_ENDS)
        out.append((start, end, LEVELS[level]))
        start = end - overlap
    out.append((start, n, "end"))
    return out, longest


def split_long(df: DataFrame, keys: list[str], text_column: str, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """One row per piece: the keys, ``piece_no`` from 1, ``n_pieces``, ``start_pos``, ``end_pos`` (exclusive), ``cut``, ``unbroken``, ``piece``.

    ``unbroken`` is the longest stretch of the text without white space and
    sentence marks that had to be torn, 0 if none had. Null and empty texts give
    no piece; texts within the limit come back whole. Consecutive pieces share
    exactly ``overlap`` characters. A table is read once. Other columns of ``df``
    are not read, so names may clash.
    """
    names = [f"k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text_column).alias("text")).where(F.length("text") > 0)
    width = len(names)

    def rows(batch, at, numbers, counts, starts, ends, cuts, unbroken, texts):
        take = pa.array(at, pa.int64())
        ints = [pa.array(v, pa.int32()) for v in (numbers, counts, starts, ends)]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(k).take(take) for k in range(width)], *ints, pa.array(cuts, pa.string()), pa.array(unbroken, pa.int32()), texts],
            names=[*names, "piece_no", "n_pieces", "start_pos", "end_pos", "cut", "unbroken", "piece"])

    def run(batches):
        for batch in batches:
            text = batch.column(width)
            lengths = np.asarray(pc.utf8_length(text))
            short = np.flatnonzero(lengths <= limit)
            if len(short):
                one, zero = np.ones(len(short), dtype=np.int32), np.zeros(len(short), dtype=np.int32)
                yield rows(batch, short, one, one, zero, lengths[short], ["end"] * len(short), zero, text.take(pa.array(short)))
            for i in np.flatnonzero(lengths > limit).tolist():
                whole = text[i].as_py()
                pieces, longest = _pieces(whole, limit, overlap)
                m = len(pieces)
                yield rows(
                    batch, [i] * m, range(1, m + 1), [m] * m, [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], [longest] * m,
                    pa.array([whole[p[0]:p[1]] for p in pieces], pa.string()))

    schema = T.StructType([*[T.StructField(n, base.schema[n].dataType) for n in names],
                           *[T.StructField(n, T.IntegerType()) for n in ("piece_no", "n_pieces", "start_pos", "end_pos")],
                           T.StructField("cut", T.StringType()), T.StructField("unbroken", T.IntegerType()), T.StructField("piece", T.StringType())])
    out = base.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *schema.fieldNames()[width:])
