"""Scalar functions on texts, dates in texts, citations and scores, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Fractions and the words that stand for them.
FRACTIONS = {"½": "one-half", "⅓": "one-third", "⅔": "two-thirds", "¼": "one-quarter", "¾": "three-quarters"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Query words that call for others, by direction.
CUT_WORDS = ("cut", "cuts", "cutting", "easing", "ease", "eased", "lower", "lowered")
CUT_SYNONYMS = ("lower", "reduce", "target", "range", "easing", "basis", "points")
HIKE_WORDS = ("hike", "hikes", "hiking", "tighten", "tightening", "raise", "raised")
HIKE_SYNONYMS = ("raise", "higher", "restrictive", "tighten", "increase")
#: Fixed value: the name space of content ids (RFC 4122's for DNS names).
UUID_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_unit(c: Column | str) -> Column:
    return F.lower(F.trim(_c(c)))


def to_float(c: Column | str) -> Column:
    """A number or null; NaN counts as null."""
    x = _c(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def normal_target(c: Column | str, null_name: str | None = None) -> Column:
    """Trimmed, lower case; null stays null unless ``null_name`` is given."""
    x = F.lower(F.trim(_c(c)))
    return x if null_name is None else F.coalesce(x, F.lit(null_name))


def date_of_digits(c: Column | str) -> Column:
    """The first run of eight digits as a date, null if it is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(_c(c), r"(\d{8})", 1), F.lit("")), "yyyyMMdd")


def date_of_iso(c: Column | str) -> Column:
    return F.try_to_date(F.substring(_c(c), 1, 10), "yyyy-MM-dd")


def _named_date(text: Column, pattern: str) -> Column:
    month, day, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month))
    return F.when(number > 0, F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")))


def date_of_slug_or_title(href: Column | str, title: Column | str) -> Column:
    """yyyy-MM-dd from a slug that ends in -of-month-d-yyyy, else from a title with 'of Month d, yyyy'."""
    slug = F.regexp_replace(F.split(F.rtrim(_c(href)), r"\?")[0], r"/+$", "")
    return F.coalesce(_named_date(slug, r"-of-(\w+)-(\d{1,2})-(\d{4})$"), _named_date(F.coalesce(_c(title), F.lit("")), r"(?i)of\s+(\w+)\s+(\d{1,2}),?\s+(\d{4})"))


def absolute_url(href: Column | str, base: str) -> Column:
    """Full addresses stay; '//host/x' takes the base's scheme, '/x' its host, anything else is put under the base."""
    h, root = _c(href), base.rstrip("/")
    scheme, _, host = root.partition("://")
    return (
        F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.lit(f"{scheme}:"), h))
        .when(h.startswith("/"), F.concat(F.lit(f"{scheme}://{host.split('/')[0]}"), h))
        .otherwise(F.concat(F.lit(f"{root}/"), h))
    )


def month_title(d: Column | str) -> Column:
    return F.date_format(_c(d).cast("date"), "MMMM yyyy")


def words(c: Column | str) -> Column:
    """Words between white space, in Unicode's sense; null gives null."""
    return F.filter(F.split(_c(c), SPACE), lambda t: t != "")


def estimated_tokens(c: Column | str) -> Column:
    """Words times 1.3, cut to a whole number."""
    return F.floor(F.size(words(c)) * F.lit(1.3)).cast("int")


def sha256(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_c(c), 256))


def uuid5(c: Column | str, namespace: str = UUID_NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a text, from SHA-1 alone."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(_c(c), "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def citation(act: Column | str, section: Column | str, *parts: Column | str) -> Column:
    """'ACT s.X(Y)(Z)'; null and empty parts are left out."""
    return F.concat(_c(act), F.lit(" s."), _c(section), *(F.when(F.coalesce(_c(p), F.lit("")) != "", F.concat(F.lit("("), _c(p), F.lit(")"))).otherwise("") for p in parts))


def context_prefix(note: Column | str, part: Column | str, division: Column | str, fallback: Column | str, avoid_doubling: bool = False) -> Column:
    """'note [Part p, Division d]', with whatever of it there is, else the fallback.

    ``avoid_doubling``: a part that already begins with 'Part' keeps its own word, and so a division."""

    def crumb(word: str, c: Column | str) -> Column:
        named = F.concat(F.lit(f"{word} "), _c(c))
        if avoid_doubling:
            named = F.when(F.upper(_c(c)).startswith(word.upper()), _c(c)).otherwise(named)
        return F.when(F.coalesce(_c(c), F.lit("")) != "", named)

    crumbs = F.concat_ws(", ", crumb("Part", part), crumb("Division", division))
    n = F.coalesce(_c(note), F.lit(""))
    boxed = F.when(crumbs != "", F.concat(F.lit("["), crumbs, F.lit("]")))
    full = F.concat_ws(" ", F.nullif(n, F.lit("")), boxed)
    return F.when(full != "", full).otherwise(_c(fallback))


def fraction_words(c: Column | str) -> Column:
    out = _c(c)
    for sign, word in FRACTIONS.items():
        out = F.replace(out, F.lit(sign), F.lit(word))
    return out


def squeeze_blanks(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), " {2,}", " ")


def search_tokens(c: Column | str) -> Column:
    """Lower-case words with their punctuation, for BM25."""
    return words(F.lower(_c(c)))


def term_tokens(c: Column | str) -> Column:
    """Lower-case runs of two or more letters, digits or underscores, for TF-IDF."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def with_bigrams(tokens: Column) -> Column:
    """Tokens and their pairs.  Two shifted slices are zipped: an index into ``tokens`` inside of a lambda would compute them again for every element."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y))
    return F.concat(tokens, pairs)


def expanded_tokens(tokens: Column) -> Column:
    """Tokens with the synonyms of cut and hike words that they lack."""
    out = tokens
    for triggers, synonyms in ((CUT_WORDS, CUT_SYNONYMS), (HIKE_WORDS, HIKE_SYNONYMS)):
        extra = F.filter(F.array(*map(F.lit, synonyms)), lambda s: ~F.array_contains(tokens, s))
        out = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, triggers))), F.concat(out, extra)).otherwise(out)
    return out


def expand_tokens(tokens: Sequence[str]) -> list[str]:
    """The same for one query on the driver."""
    have = set(tokens)
    out = list(tokens)
    for triggers, synonyms in ((CUT_WORDS, CUT_SYNONYMS), (HIKE_WORDS, HIKE_SYNONYMS)):
        if have & set(triggers):
            out += [s for s in synonyms if s not in have]
    return out


def rrf(rank: Column, k: int = 60) -> Column:
    """Reciprocal rank; a null rank gives nothing."""
    return F.coalesce(1.0 / (rank + k), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def normal_citation(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(_c(c)), r"\s+", " "))


def first_sentence(c: Column | str, most: int = 200) -> Column:
    """Up to the first full stop, question or exclamation mark before white space or the end; the first ``most``
    characters where that is longer or missing."""
    x = F.trim(c if isinstance(c, Column) else _c(c))
    s = F.regexp_extract(x, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.when((s != "") & (F.length(s) <= most), s).otherwise(F.substring(x, 1, most))


def preview(c: Column | str, most: int = 450) -> Column:
    return F.when(F.length(_c(c)) > most, F.concat(F.substring(_c(c), 1, most), F.lit("…"))).otherwise(_c(c))


def piped(rows: Column) -> Column:
    """A table (array of arrays of cells) as lines of cells between bars; null cells are empty, empty rows are left out."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda x: F.trim(F.coalesce(x, F.lit("")))))
    full = F.filter(clean, lambda r: F.exists(r, lambda x: x != ""))
    return F.array_join(F.transform(full, lambda r: F.array_join(r, " | ")), "\n")


def source_block(n: Column, institution: Column, kind: Column, date: Column, page: Column, title: Column, text: Column) -> Column:
    """One numbered source of a prompt; the page where there is one."""
    where = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" | p."), page.cast("string"))).otherwise("")
    head = F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.concat_ws(" | ", institution, kind, date), where)
    return F.concat(head, F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")))


def rank_line(dense: Column, sparse: Column) -> Column:
    """How a source was found: its ranks in the two rankings, of those it is in."""
    told = lambda name, c: F.when(F.coalesce(c, F.lit(0)) > 0, F.concat(F.lit(f"{name} #"), c.cast("string")))
    return F.concat_ws(", ", told("dense", dense), told("sparse", sparse))


def badge(institution: Column | str, names: dict[str, str]) -> Column:
    """The short name of an institution, by its spelling without case; others show their own first letters in capitals."""
    c = _c(institution)
    key = F.lower(F.trim(c))
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in (pair[0].lower(), pair[1])))[key] if names else F.lit(None).cast("string")
    initials = F.array_join(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.coalesce(known, F.nullif(initials, F.lit("")))
