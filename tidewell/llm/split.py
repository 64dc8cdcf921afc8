"""Oversized texts cut at natural boundaries, with overlap (problem 5).

Recursive bisection: a span over the limit is cut at the strongest boundary in the middle half of it, the one nearest
to the midpoint among equals, or, where there is none, at the nearest boundary outside of it; halves that still exceed the limit minus the overlap are cut again.  Overlaps are attached
afterwards: each piece but the first starts up to ``overlap`` characters before its cut, at a word's start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.distinct import as_strings, content_hash, distinct_by_hash
from tidewell.session import materialize

LIMIT, OVERLAP = 1600, 200
_GAP = re.compile(r"\s+")
_SENTENCE_END = frozenset(".!?…。！？")
_CLAUSE_END = frozenset(",;:)—–")
_CLOSERS = "\"'”’»)]"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions (each at the end of a run of white space) and their strengths: 6 page, 5 paragraph, 4 line that
    ends a sentence, 3 sentence, 2 line or clause, 1 word."""
    at, strength = [], []
    for m in _GAP.finditer(text):
        gap = m[0]
        i = m.start()
        if gap == " ":
            last = text[i - 1 : i]
            if last in _CLOSERS and i > 1:
                last = text[i - 2] if text[i - 2] in _SENTENCE_END else last
            s = 3 if last in _SENTENCE_END else 2 if last in _CLAUSE_END else 1
        elif "\f" in gap:
            s = 6
        elif gap.count("\n") > 1:
            s = 5
        elif "\n" in gap:
            s = 4 if text[i - 1 : i] in _SENTENCE_END else 2
        else:
            s = 1
        at.append(m.end())
        strength.append(s)
    return np.array(at, np.int64), np.array(strength, np.int64)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Positions 0 = c0 < c1 < ... < cn = len(text) such that no span exceeds limit - overlap (the first, and
    those of one word: limit).

    A span that has white space is cut at white space, wherever it is.  Only a word that is too long itself is cut between
    characters.  Every cut leaves a part without the middle half, or without white space, so there are as many rounds as
    words longer than a limit, and the logarithm of the length."""
    n = len(text)
    if n <= limit:
        return [0, n]
    at, strength = boundaries(text)
    out = [0]
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= (limit if lo == 0 else limit - overlap):
            out.append(hi)
            continue
        middle, quarter = (lo + hi) // 2, (hi - lo) // 4
        i, j = np.searchsorted(at, [lo + quarter, hi - quarter + 1])
        if i < j:
            s = strength[i:j]
            best = np.flatnonzero(s == s.max())
            cut = int(at[i + best[np.argmin(np.abs(at[i + best] - middle))]])
        else:
            # no white space in the middle half: the boundaries on either side of it, else any character
            around = [int(at[k]) for k in (i - 1, i) if 0 <= k < len(at) and lo < at[k] < hi]
            if not around and hi - lo <= limit:  # one word, which is whole with less overlap
                out.append(hi)
                continue
            cut = min(around, key=lambda c: abs(c - middle), default=middle)
        while lo + 1 < cut < hi and text[cut - 1] == "\r" and text[cut] == "\n":
            cut -= 1
        stack += [(cut, hi), (lo, cut)]
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, cut, end) of each piece: its text is text[start:end], of which text[start:cut] repeats the piece before."""
    c = cuts(text, limit, overlap)
    out = []
    for k, (a, b) in enumerate(zip(c, c[1:])):
        start = a
        if k and overlap:
            start = max(c[k - 1], a - overlap, b - limit)
            gap = _GAP.search(text, start, a)
            if start > 0 and not text[start - 1].isspace() and not text[start].isspace():
                start = gap.end() if gap else start
        out.append((min(start, a), a, b))
    return out


_PIECES = "chunk_id string, doc_id string, source_chunk_idx int, chunk_idx int, page_num int, overlap_chars int, text string"


def _cut(limit: int, overlap: int):
    names = ("chunk_id", "doc_id", "source_chunk_idx", "chunk_idx", "page_num", "overlap_chars", "text")
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column("chunk_id").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("chunk_idx").to_pylist(), batch.column("page_num").to_pylist(), as_strings(batch.column("text")))
            for chunk, doc, idx, page, text in zip(*columns):
                body = text.strip()
                if len(body) <= limit:
                    continue
                for k, (start, cut, end) in enumerate(pieces(body, limit, overlap)):
                    piece = body[start:end]
                    lead = len(piece) - len(piece.lstrip())
                    # the page a piece begins on; 0 (HTML) stays 0
                    on = page + body.count("\f", 0, start + lead) if page else page
                    rows.append((chunk, doc, idx, k, on, max(0, cut - start - lead), piece.strip()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 7, types)], schema=schema)

    return run


def split_oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk of more than ``limit`` characters (code points, white space at both ends not counted).

    Each piece has at most ``limit`` characters, carries the page it begins on, its number within its chunk
    (``chunk_idx``, from 0; the chunk's own number is ``source_chunk_idx``) and how many of its leading characters
    repeat the piece before.  Null, blank and short texts give nothing; exact repeats of a row are cut once; a text
    without white space is cut between characters.  Extra columns are ignored."""
    long = df.where(F.length("text") > limit).select(
        content_hash(F.col("chunk_id"), F.col("doc_id"), F.col("page_num"), F.col("chunk_idx"), F.col("text")).alias("h"),
        F.col("chunk_id").cast("string"), F.col("doc_id").cast("string"), F.col("page_num").cast("int"), F.col("chunk_idx").cast("int"), "text",
    )
    return distinct_by_hash(long).mapInArrow(_cut(limit, overlap), _PIECES)


def renumbered(df: DataFrame, cut: DataFrame, block: int = 1024) -> DataFrame:
    """``cut`` (pieces of the chunks of ``df``) with ``chunk_idx`` counted through the whole document, where a chunk that
    wasn't cut counts as one; ties of a document's chunks go by chunk_id.

    The offsets are prefix sums in two levels, over blocks of chunk numbers and within them, so a document of any size
    is spread over tasks; only keys and counts are moved.  ``cut`` is written once, as it is read twice."""
    cut = materialize(cut)
    counts = cut.groupBy("chunk_id", "doc_id", "source_chunk_idx").agg((F.max("chunk_idx") + 1).alias("n"))
    keys = df.select(F.col("chunk_id").cast("string").alias("c"), F.col("doc_id").cast("string").alias("d"), F.col("chunk_idx").cast("int").alias("i")).distinct()
    same = F.col("c").eqNullSafe(F.col("chunk_id")) & F.col("d").eqNullSafe(F.col("doc_id")) & F.col("i").eqNullSafe(F.col("source_chunk_idx"))
    sized = keys.join(counts, same, "left").select("c", "d", "i", F.coalesce("n", F.lit(1)).alias("n"), F.floor(F.col("i") / block).alias("b"))
    before = Window.partitionBy("d").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy("d", "b").agg(F.sum("n").alias("s")).select(F.col("d").alias("bd"), F.col("b").alias("bb"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("d", "b").orderBy("i", "c").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(blocks, F.col("d").eqNullSafe(F.col("bd")) & F.col("b").eqNullSafe(F.col("bb"))).select(
        "c", "d", "i", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("offset")
    )
    return cut.join(placed, same).select(
        "chunk_id", "doc_id", "source_chunk_idx", (F.col("offset") + F.col("chunk_idx")).cast("int").alias("chunk_idx"), "page_num", "overlap_chars", "text"
    )
