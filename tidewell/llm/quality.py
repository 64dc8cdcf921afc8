"""Statistics of a text's words, symbols, lines and common words, and whether it is natural prose (problem 10).

A text is read once, where it lies, without a shuffle, into counts that add up: the counts of two texts put together are the
sum of theirs.  STATS are ratios of these counts.  Gradient-boosted trees learn which texts are prose from a bounded sample:
several weak functions, each over another kind of evidence, vote on a text or abstain, and texts on which enough of them
agree get a label.  As half a text is what decides, sure prose and sure junk are also put together in known shares, by adding
their counts.  The margins are calibrated on the hand-checked texts of :mod:`tidewell.llm.holdout`, alone and put together
in the same way, which are never trained on.  What the calibrated trees hold for prose with less than an even chance is junk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.boosting import Boosted
from tidewell.llm.distinct import as_strings
from tidewell.llm.holdout import labelled
from tidewell.session import spread

#: Words of grammar of four languages.  Those that also tie terms together ('de', 'of', 'du', 'del') are left out.
COMMON = frozenset(
    (
        "the and in to a an for by with on at from as that which is was were be been has had have not if it its this these but than while when because after before between "
        "under over near since until who may shall must about our most with into against though although so they them their there would could will are or we he she his her "
        "le la les un une et en à au aux par pour dans sur avec que qui ne pas est a ont son sa ses ce cette mais ou si tant lorsque alors depuis entre selon puis comme peu bien "
        "dont contre vers malgré faute il elle nous vous plus été être sont "
        "der die das und im den dem des ein eine zu zum zur von vom bei mit auf für nach seit während weil da sodass obwohl ist war sind um an als wie sich nicht so zwischen laut "
        "gegen gegenüber dass noch aber nur kein keine ihre wird werden "
        "el los las una y al para con se su sus no es ha lo como más menos desde hasta según aunque mientras porque tras sin pero frente ya apenas fue han está"
    ).split()
)
#: Words that come with a clause: conjunctions, relative words, auxiliary verbs and negations.
CLAUSE = frozenset(
    (
        "that which who whom because although though while when if unless until since before after but than as had has have is are was were be been being will would shall may must can "
        "could should not they it "
        "que qui dont parce alors lorsque quand si tant mais ne pas est sont était ont été avait doit peut sera selon puis où "
        "dass weil obwohl während wenn sodass da aber nicht ist sind war waren hat haben wird werden kann muss als sich es nachdem "
        "porque aunque mientras cuando pero no son fue ha han había debe puede será tras ya donde"
    ).split()
)
_DIGITS = b"0123456789"
_SPACE = b" \t\n\r\f\v"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CELLS = b"|;<>{}[]=_~#*\\/^"
_FIGURES = _DIGITS + _CELLS
_UPPER = bytes(range(65, 91))
_END = (".", "!", "?", "…", ".\"", ".”", ".»", ":", "。", "！", "？")
_BULLETS = frozenset("-–•*·▪◦")
_LEADERS = ("....", "-----", "=====", "_____", "~~~~~", "#####", "*****", "    ", "\t")

#: What adds up.  Characters are those that aren't white space.
COUNTS = (
    "length", "chars", "words", "digits", "marks", "cells", "upper", "common", "clause", "lines", "ended_lines", "short_lines", "item_lines", "leaders", "distinct", "long_words",
    "sentence_ends", "list_chars", "figure_chars", "terse_chars", "bare_chars", "clauseless_chars", "blocks",
)
_AT = {c: i for i, c in enumerate(COUNTS)}
STATS = (
    "n_chars", "n_words", "mean_word_length", "letter_ratio", "digit_ratio", "symbol_ratio", "cell_mark_ratio", "upper_ratio", "common_ratio", "clause_ratio", "distinct_ratio", "n_lines",
    "mean_line_length", "ended_line_ratio", "short_line_ratio", "item_line_ratio", "leader_ratio", "long_word_ratio", "sentence_marks", "list_share", "figure_share", "terse_share",
    "bare_share", "clauseless_share", "n_blocks",
)
_STAT = {c: i for i, c in enumerate(STATS)}
#: The trees see ratios only, not how long a text is; the share of distinct words falls with length too.
FEATURES = tuple(i for i, c in enumerate(STATS) if c not in ("n_chars", "n_words", "n_lines", "n_blocks", "distinct_ratio"))


def _without(raw: bytes, what: bytes) -> int:
    return len(raw) - len(raw.translate(None, what))


def _blocks(text: str) -> list[list[str]]:
    """The lines of the parts between blank lines or form feeds."""
    if "\f" in text:
        text = text.replace("\f", "\n\n")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if not line or line.isspace():
            if out[-1]:
                out.append([])
        else:
            out[-1].append(line)
    return [x for x in out if x]


def _is_item(line: str) -> bool:
    """Whether a line starts with a bullet or a number in brackets or with a dot."""
    head = line[:8].lstrip()
    return head[:1] in _BULLETS if head[:1] and not head[0].isalnum() and head[0] != "(" else head[:1].isdigit() and any(x in head for x in (". ", ") ")) or head[:1] == "("


def counts(text: str) -> list[float]:
    """The values of COUNTS.

    A list line is an item without the end of a sentence that no other line goes on with; a figure line has more than a
    fifth of digits and cell marks; a terse line is short, no item, and ends no sentence.  A bare block has under a tenth of
    common words, a clauseless one under 1.5 percent of words that come with a clause."""
    chars = words_ = digits = marks = cells = upper = common = clause = 0
    lines_ = ended_ = short = items = list_chars = figure_chars = terse_chars = bare = clauseless = ends = 0
    distinct: set[str] = set()
    parts = _blocks(text)
    for lines in parts:
        b = "\n".join(lines)
        words = b.casefold().split()
        raw = b.encode("utf-8", "replace")
        size = len(b) - _without(raw, _SPACE)
        g, q = sum(map(COMMON.__contains__, words)), sum(map(CLAUSE.__contains__, words))
        d, c = _without(raw, _DIGITS), _without(raw, _CELLS)
        if g < 0.1 * len(words):
            bare += size
        if q < 0.015 * len(words):
            clauseless += size
        figures = d + c > 0.02 * size
        last = len(lines) - 1
        item = _is_item(lines[0])
        for i, x in enumerate(lines):
            following = i < last and _is_item(lines[i + 1])
            end = x.rstrip().endswith(_END)
            n = len(x) - x.count(" ")
            ended_ += end
            items += item
            short += len(x) < 40
            if not end:
                if item and (i == last or following):
                    list_chars += n
                elif not item and len(x) < 40:
                    terse_chars += n
            if figures and _without(x.encode("utf-8", "replace"), _FIGURES) > 0.2 * n:
                figure_chars += n
            item = following
        ends += b.count(". ") + b.count(".\n") + b.count("? ") + b.count("! ") + b.endswith(_END)
        lines_, chars, words_, digits, marks, cells = lines_ + len(lines), chars + size, words_ + len(words), digits + d, marks + _without(raw, _MARKS), cells + c
        upper, common, clause = upper + _without(raw, _UPPER), common + g, clause + q
        distinct.update(words)
    return [
        len(text), chars, words_, digits, marks, cells, upper, common, clause, lines_, ended_, short, items, sum(map(text.count, _LEADERS)), len(distinct), sum(len(x) > 20 for x in distinct),
        ends, list_chars, figure_chars, terse_chars, bare, clauseless, len(parts),
    ]


def ratios(c: np.ndarray) -> np.ndarray:
    """The values of STATS for rows of COUNTS; zeros for texts without words."""
    x = {n: c[:, i] for n, i in _AT.items()}
    chars, words, lines = (np.maximum(x[n], 1e-9) for n in ("chars", "words", "lines"))
    out = np.stack(
        [
            x["length"], x["words"], x["chars"] / words, (x["chars"] - x["digits"] - x["marks"]) / chars, x["digits"] / chars, x["marks"] / chars, x["cells"] / chars, x["upper"] / chars,
            x["common"] / words, x["clause"] / words, x["distinct"] / words, x["lines"], x["length"] / lines, x["ended_lines"] / lines, x["short_lines"] / lines, x["item_lines"] / lines,
            x["leaders"] / words, x["long_words"] / np.maximum(x["distinct"], 1e-9), x["sentence_ends"] / words, x["list_chars"] / chars, x["figure_chars"] / chars, x["terse_chars"] / chars,
            x["bare_chars"] / chars, x["clauseless_chars"] / chars, x["blocks"],
        ],
        1,
    )
    out[x["words"] == 0, 1:] = 0.0
    return out


def count_matrix(texts: list[str]) -> np.ndarray:
    return np.array([counts(t) for t in texts], float).reshape(len(texts), len(COUNTS))


def matrix(texts: list[str]) -> np.ndarray:
    return ratios(count_matrix(texts))


def statistics(text: str) -> tuple[float, ...]:
    """The values of STATS.  Ratios of characters are over characters that aren't white space; blank texts give zeros."""
    return tuple(matrix([text])[0])


def _votes(x: np.ndarray) -> np.ndarray:
    """One column for each weak function: 1 prose, -1 junk, 0 where it abstains.  Each looks at another kind of evidence:
    words of grammar, words of clauses, ends of sentences, shapes of lines, figures, forms of words."""
    s = {n: x[:, i] for n, i in _STAT.items()}
    vote = lambda prose, junk: np.where(prose, 1, 0) - np.where(junk, 1, 0)
    never = np.zeros(len(x), bool)
    return np.stack(
        [
            vote(s["common_ratio"] >= 0.24, s["common_ratio"] <= 0.1),
            vote(s["clause_ratio"] >= 0.04, s["clause_ratio"] <= 0.012),
            vote((s["sentence_marks"] >= 0.02) & (s["sentence_marks"] <= 0.2), s["sentence_marks"] <= 0.006),
            vote(s["list_share"] + s["terse_share"] <= 0.1, s["list_share"] + s["terse_share"] >= 0.6),
            vote(never, s["figure_share"] >= 0.4),
            vote(never, (s["mean_word_length"] > 12) | (s["long_word_ratio"] > 0.3) | (s["letter_ratio"] < 0.6)),
        ],
        1,
    )


def weak_labels(x: np.ndarray, agree: int = 2) -> np.ndarray:
    """1 prose, 0 junk, -1 unsure: what the votes come to, where one side is ahead by at least ``agree``."""
    net = _votes(x).sum(1)
    return np.where(net >= agree, 1, np.where(net <= -agree, 0, -1))


def mixtures(c: np.ndarray, y: np.ndarray, n: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """``n`` rows of counts of prose (y = 1) and junk (y = 0) put together, and whether prose has more than half of the
    characters.  The share of prose is even over what lies at least five percent off a half."""
    rng = np.random.default_rng(seed)
    prose, junk = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(prose) or not len(junk) or not n:
        return np.empty((0, c.shape[1])), np.empty(0)
    share = rng.uniform(0.05, 0.45, n)
    label = rng.integers(0, 2, n)
    share = np.where(label == 1, 1 - share, share)
    a, b = c[rng.choice(prose, n)], c[rng.choice(junk, n)]
    size = _AT["chars"]
    a, b = a / np.maximum(a[:, [size]], 1), b / np.maximum(b[:, [size]], 1)
    return 1000 * (share[:, None] * a + (1 - share[:, None]) * b), label.astype(float)


_SCHEMA = ", ".join(f"{s} double" for s in STATS)


def _describe(key_type: pa.DataType, model: Boosted | None = None):
    names = ["k", *STATS, *(["p_prose"] if model else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(as_strings(batch.column(1)))
            columns = [pa.array(x[:, i], pa.float64()) for i in range(len(STATS))]
            if model:
                columns.append(pa.array(probability(model, x), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(key_type), *columns], names=names)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = count_matrix(as_strings(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(c[:, i], pa.float64()) for i in range(len(COUNTS))], names=list(COUNTS))


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with a text that isn't blank, in Unicode's sense of white space."""
    return spread(df.where(F.col(text).isNotNull() & F.col(text).rlike(r"(?U)\S")).select(F.col(key).alias("k"), F.col(text).alias("text")))


def text_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the STATS of every row with a text that isn't null or blank."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    return _texts(df, key, text).mapInArrow(_describe(to_arrow_type(kind)), f"k {kind.simpleString()}, {_SCHEMA}").withColumnRenamed("k", key)


def probability(model: Boosted, x: np.ndarray) -> np.ndarray:
    """The calibrated chance of prose for rows of STATS."""
    return model.probability(x[:, FEATURES])


def fit(c: np.ndarray, mixed: int = 2000, seed: int = 17) -> Boosted:
    """Trees over rows of counts: weakly labelled ones and ``mixed`` put together of them; calibrated on the holdout.

    Where labels of one kind are fewer than 20, the first half of the holdout's texts is also trained on, and only the
    second half calibrates."""
    texts, checked = labelled()
    hc, hy = count_matrix(texts), np.array(checked)
    y = weak_labels(ratios(c))
    c, y = c[y >= 0], y[y >= 0]
    if min((y == 0).sum(), (y == 1).sum()) < 20:
        c, y = np.concatenate([c, hc[::2]]), np.concatenate([y, hy[::2]])
        hc, hy = hc[1::2], hy[1::2]
    mc, my = mixtures(c, y, mixed, seed)
    model = Boosted().fit(ratios(np.concatenate([c, mc]))[:, FEATURES], np.concatenate([y, my]).astype(float))
    kc, ky = mixtures(hc, hy, 4 * len(hc), seed + 1)
    return model.calibrate(ratios(np.concatenate([hc, kc]))[:, FEATURES], np.concatenate([hy, ky]).astype(float))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000, seed: int = 17) -> Boosted:
    """Fit on at most about ``sample`` rows (a documented bound, drawn by a hash of key).

    The driver receives the counts of these rows, whatever the size of the table."""
    n = df.count()
    share = min(1.0, sample / max(1, n))
    drawn = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else df
    counted = _texts(drawn, key, text).mapInArrow(_counted, ", ".join(f"{c} double" for c in COUNTS)).limit(2 * sample)
    return fit(np.array(counted.toPandas(), float).reshape(-1, len(COUNTS)), seed=seed)


def text_quality(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000, model: Boosted | None = None) -> DataFrame:
    """key, STATS, ``p_prose`` (calibrated) and ``is_prose`` of every row with a text that isn't null or blank.

    Very long texts are measured whole; repeated rows are each measured; an empty table trains on the holdout alone and
    gives an empty result; extra columns are ignored."""
    from pyspark.sql.pandas.types import to_arrow_type

    model = model or train(df, key, text, sample)
    kind = df.schema[key].dataType
    scored = _texts(df, key, text).mapInArrow(_describe(to_arrow_type(kind), model), f"k {kind.simpleString()}, {_SCHEMA}, p_prose double")
    return scored.withColumn("is_prose", F.col("p_prose") >= 0.5).withColumnRenamed("k", key)


def junk_texts(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000) -> DataFrame:
    """Rows that the calibrated trees hold for prose with less than an even chance."""
    return text_quality(df, key, text, sample).where(~F.col("is_prose"))
