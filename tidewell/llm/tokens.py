"""Tokens of each text, and token budgets by source, institution, language and domain (problem 6).

Whole texts are hashed and deduplicated, each distinct text is tokenized once, and the exact counts are joined back on
the hash.  Totals never join rows: rows first shrink to multiplicities by hash and labels, so that copies, however many,
meet the counts as one row per label.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.distinct import as_strings, content_hash, distinct_pairs, salt_of

TOKENIZER_DIR = os.environ.get("TIDEWELL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern this public vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS_TO_TOKENS = 1.3


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Callable[[str], list[int]]:
    """The encoder of a vocabulary file, loaded once a process.  Special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return encoding.encode_ordinary


def estimate_tokens(text: str) -> int:
    """Words separated by white space, times 1.3, cut to a whole number."""
    return int(len(text.split()) * WORDS_TO_TOKENS)


_COUNTS = "h binary, salt int, n_tokens long, n_words long, n_estimate long"


def _count(path: str):
    """Each distinct text of a partition is tokenized once; its counts go to each of its salts once."""
    schema = pa.schema([("h", pa.binary()), ("salt", pa.int32()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("n_estimate", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        known: dict[bytes, tuple[int, int, int]] = {}
        waiting: dict[bytes, set[int]] = {}  # salts that came before their text
        done: set[tuple[bytes, int]] = set()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows = []
            for h, salt, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_strings(batch.column(2))):
                if (h, salt) in done:
                    continue
                if h not in known:
                    waiting.setdefault(h, set()).add(salt)
                    if text is None:
                        continue
                    words = len(text.split())
                    known[h] = (len(encode(text)), words, int(words * WORDS_TO_TOKENS))
                for k in waiting.pop(h, {salt}):
                    if (h, k) not in done:
                        done.add((h, k))
                        rows.append((h, k, *known[h]))
            if rows:
                yield batch_of(rows)

    return run


def distinct_counts(df: DataFrame, text: str = "text", path: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """h, salt, n_tokens, n_words, n_estimate of each distinct text that isn't null, once for each salt of its rows' keys
    (one salt without keys)."""
    salt = salt_of(*map(F.col, keys)) if keys else F.lit(0)
    texts = df.where(F.col(text).isNotNull()).select(content_hash(F.col(text)).alias("h"), salt.alias("salt"), F.col(text).alias("text"))
    return distinct_pairs(texts).mapInArrow(_count(path or os.path.join(TOKENIZER_DIR, VOCABULARY)), _COUNTS)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` of every row, with ``n_tokens``, ``n_words`` and ``n_estimate``.

    A null text has zero of each; a blank text has the tokens of its white space and no words.  Repeated rows stay
    repeated.  Rows meet the counts on hash and salt, so those of a hot text, and those without one, are spread."""
    rows = df.select(*(F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)), content_hash(F.col(text)).alias("h"), salt_of(*map(F.col, keep)).alias("salt"))
    joined = rows.join(distinct_counts(df, text, path, keep), ["h", "salt"], "left")
    zero = F.lit(0).cast("long")
    return joined.select(*(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)), *(F.coalesce(c, zero).alias(c) for c in ("n_tokens", "n_words", "n_estimate")))


def wrong_counts(df: DataFrame, keep: list[str], text: str = "text", stated: str = "token_count", path: str | None = None) -> DataFrame:
    """Rows whose stated count is null or not the estimate."""
    counted = token_counts(df, [*keep, stated], text, path)
    return counted.where(~F.col(stated).cast("long").eqNullSafe(F.col("n_estimate"))).select(*keep)


# ---------------------------------------------------------------------------------------------------------------
# labels

#: ISO 639-2 codes (both forms) of the languages at hand.
_LANGUAGES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es"}


def clean_language(c: Column) -> Column:
    """Two-letter code without region, in lower case; 'und' for null, blank and undetermined."""
    base = F.split(F.lower(F.trim(c)), "[-_]")[0]
    short = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in _LANGUAGES.items() for x in pair)), base), base)
    return F.when(base.isin("", "und", "unknown", "n/a"), F.lit("und")).otherwise(F.coalesce(short, F.lit("und")))


def label_key(c: Column) -> Column:
    """The comparison form of a label: lower case, single blanks, without a leading article."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), r"^the ", "")


def label_table(df: DataFrame, column: str) -> DataFrame:
    """key, label: each comparison form of a label column, with its most frequent spelling.

    A form of one short word is an acronym where exactly one name fits: its letters follow one another in the name, and
    the initials of the name's longer words follow one another in it.  Rows shrink to distinct spellings first; forms and
    names then meet by their first letter."""
    forms = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).select(F.col(column).alias("form"), "n", label_key(F.col(column)).alias("key")).where("key <> ''")
    names = forms.groupBy("key").agg(F.max_by("form", F.struct("n", "form")).alias("label"))
    words = F.split("key", " ")
    initials = F.array_join(F.transform(F.filter(words, lambda w: F.length(w) > 3), lambda w: F.substring(w, 1, 1)), "")
    long = names.where(F.size(words) > 1).select(F.substring("key", 1, 1).alias("first"), F.col("key").alias("name_key"), F.col("label").alias("name"), initials.alias("initials"))
    short = names.where((F.size(words) == 1) & F.col("key").rlike(r"^[\p{L}]{2,6}$")).select(F.substring("key", 1, 1).alias("first"), F.col("key").alias("acronym"))
    inside = lambda letters: F.concat(F.lit("^"), F.array_join(F.split(letters, ""), ".*"))
    fits = F.rlike("name_key", inside(F.col("acronym"))) & F.rlike("acronym", inside(F.col("initials")))
    told = short.join(long, "first").where(fits).groupBy("acronym").agg(F.count("*").alias("n"), F.max("name").alias("name")).where("n = 1")
    return names.join(told, names.key == told.acronym, "left").select("key", F.trim(F.regexp_replace(F.coalesce("name", "label"), r"(?U)\s+", " ")).alias("label"))


def token_totals(df: DataFrame, labels: dict[str, Column], text: str = "text", path: str | None = None) -> DataFrame:
    """n_texts, n_distinct, n_tokens, n_tokens_distinct by the label columns.

    Rows are pre-aggregated to multiplicities by (hash, labels); only these meet the counts."""
    many = df.select(*(c.alias(n) for n, c in labels.items()), content_hash(F.col(text)).alias("h")).groupBy("h", *labels).agg(F.count("*").alias("copies"))
    joined = many.join(distinct_counts(df, text, path), "h", "left")
    tokens = F.coalesce("n_tokens", F.lit(0))
    return joined.groupBy(*labels).agg(
        F.sum("copies").alias("n_texts"), F.count("h").alias("n_distinct"), F.sum(tokens * F.col("copies")).alias("n_tokens"), F.sum(tokens).alias("n_tokens_distinct")
    )
