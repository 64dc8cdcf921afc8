"""Statute XML into chunks and nested sections.

Mixed content must keep its order, which Spark's XML reader doesn't do, so each document goes through the standard
library's parser in an Arrow batch; everything after the tree (citations, contexts, hashes, limits) is built by columns
or by the same small functions.  A document is one row, so a corpus of acts is spread over tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import FRACTIONS, citation, estimated_tokens, sha256
from tidewell.schemas import SECTION

#: Names of elements, of which some are known in two languages.
EXCLUDED = frozenset(("HistoricalNote", "HistoricalNoteSubItem", "Marginal Note", "ReaderNote"))
BODY, SUBSECTION, NESTED = ("Body", "Corps"), ("Subsection", "Paragraphe"), ("Subparagraph", "Clause", "Subclause")
TOKEN_LIMIT, INTRO_WORDS = 400, 40
#: What a paragraph says, and the hint that is put into its context, in order.
TOPIC_HINTS = (
    (r"\bprincipal residence\b", "principal residence"),
    (r"\brent[s,]?\s+royalt|\broyalt", "rents and royalties"),
    (r"\binterest\b.{0,60}\bborrow|\bborrow.{0,60}\binterest", "interest on borrowed money"),
    (r"\bnet capital loss", "net capital losses"),
    (r"\ballowable capital loss", "allowable capital losses"),
    (r"\btaxable capital gain", "taxable capital gains"),
    (r"\bplan matures|maturity date.{0,80}retirement savings|retirement savings.{0,80}maturity\b", "RRSP maturity date retirement income options"),
    (r"\bcumulative excess amount.{0,80}registered retirement savings|registered retirement savings.{0,80}cumulative excess amount", "RRSP over-contribution cumulative excess tax payable"),
)
_HINTS = tuple((re.compile(p, re.I), label) for p, label in TOPIC_HINTS)
_FRACTIONS = str.maketrans(FRACTIONS)


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def children(e: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in e if name(c) in names]


def child(e: ET.Element, *names: str) -> ET.Element | None:
    return next(iter(children(e, *names)), None)


def label(e: ET.Element) -> str:
    """The text of an element's Label, without brackets around it."""
    found = child(e, "Label")
    return (found.text or "").strip().strip("()").strip() if found is not None else ""


def text_of(e: ET.Element | None) -> str:
    """All text in order, without excluded elements (what follows them stays), single blanks, fractions as words."""
    if e is None:
        return ""
    parts: list[str] = []

    def take(x: ET.Element) -> None:
        if name(x) in EXCLUDED:
            return
        parts.append(x.text or "")
        for c in x:
            take(c)
            parts.append(c.tail or "")

    take(e)
    return " ".join(" ".join(p for p in parts if p).split()).translate(_FRACTIONS)


def paragraph_text(e: ET.Element) -> str:
    """'(label) text' of a paragraph with its nested levels.  A nested level brings its own label, and gets it once more from its parent."""
    bits = []
    for c in e:
        if name(c) == "Text":
            bits.append(text_of(c))
        elif name(c) in NESTED:
            inner = paragraph_text(c)
            bits.append(f"({label(c)}) {inner}" if label(c) and inner else inner)
    body = " ".join(b for b in bits if b) if bits else text_of(e)
    return f"({label(e)}) {body}" if label(e) else body


def topic_hints(text: str) -> str:
    return " | ".join(dict.fromkeys(told for pattern, told in _HINTS if pattern.search(text)))


def hints_of(c: Column | str) -> Column:
    """The same as :func:`topic_hints` for a column, in the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat_ws(" | ", *(F.when(c.rlike(f"(?i){p}"), F.lit(told)) for p, told in TOPIC_HINTS))


def n_tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def _cite(section: str, *parts: str | None, act: str) -> str:
    return f"{act} s.{section}" + "".join(f"({p})" for p in parts if p)


def subsection_rows(e: ET.Element, section: str, context: str, language: str, act: str) -> Iterator[tuple[str, str | None, str]]:
    """(context, paragraph, text) of each chunk of a subsection."""
    note = text_of(child(e, "MarginalNote")).strip()
    cite = _cite(section, label(e), act=act)
    if note:
        context = f"{note} [{cite}]"
    definitions = children(e, "Definition")
    if definitions:
        own = "DefinedTermEn" if language == "en" else "DefinedTermFr"
        for d in definitions:
            told = child(d, "Text")
            term = None if told is None else child(told, own)
            if term is None and told is not None:
                term = child(told, "DefinedTermEn", "DefinedTermFr")
            named = (term.text or "").strip() if term is not None else ""
            if body := text_of(d).strip():
                yield (f"Definition of '{named}' [{context}] [{cite}]" if named else context), None, body
        return
    paragraphs = children(e, "Paragraph")
    before = list(e)[: list(e).index(paragraphs[0])] if paragraphs else list(e)
    intro = " ".join(text_of(c) for c in before if name(c) == "Text")
    closing = " ".join(text_of(t) for c in children(e, "ContinuedSectionSubsection") for t in children(c, "Text"))
    bodies = {label(p): paragraph_text(p) for p in paragraphs}  # of paragraphs with one label the last text stays, in the first place
    whole = " ".join(t for t in (intro, *bodies.values(), closing) if t)
    if not paragraphs:
        whole = whole or text_of(e)
    if not paragraphs or n_tokens(whole) <= TOKEN_LIMIT:
        if whole.strip():
            yield context, None, whole.strip()
        return
    words = intro.split()
    short = " ".join(words[:INTRO_WORDS]) + "…" if len(words) > INTRO_WORDS else intro
    for k, (mark, body) in enumerate(bodies.items()):
        text = " ".join(t for t in (intro if k == 0 else short, body, closing if k == len(bodies) - 1 else "") if t).strip()
        if text:
            hints = topic_hints(text)
            yield (f"{context} | {hints}" if hints else context), mark, text


def _crumbs(part: str, division: str) -> str:
    named = [x if x.upper().startswith(word.upper()) else f"{word} {x}" for word, x in (("Part", part), ("Division", division)) if x]
    return ", ".join(named)


def body_of(root: ET.Element) -> ET.Element:
    return next((e for e in [*children(root, *BODY), *root.iter()] if name(e) in BODY), root)


def walk(root: ET.Element) -> Iterator[tuple[str, str, ET.Element]]:
    """(part, division, section element) in order; a new part ends the division before it."""
    part = division = ""
    for e in body_of(root):
        if name(e) == "Heading":
            title = child(e, "TitleText")
            mark = child(e, "Label")
            told = ((mark.text or "").strip() if mark is not None else "") or ((title.text or "").strip() if title is not None else "")
            if e.get("level") == "1":
                part, division = told, ""
            elif e.get("level") == "2":
                division = told
        elif name(e) == "Section" and label(e):
            yield part, division, e


def chunk_rows(xml: bytes | str, language: str = "en", act: str = "ITA") -> Iterator[tuple[int, str, str, str, str | None, str | None, str, str]]:
    """(pos, part, division, section, subsection, paragraph, context, text)."""
    pos = 0
    for part, division, e in walk(ET.fromstring(xml)):
        section, note, crumbs = label(e), text_of(child(e, "MarginalNote")).strip(), _crumbs(part, division)
        context = " ".join(x for x in (note, f"[{crumbs}]" if crumbs else "") if x) or f"{act} s.{section}"
        subsections = children(e, *SUBSECTION)
        if subsections:
            rows = [(label(s), *r) for s in subsections for r in subsection_rows(s, section, context, language, act)]
        else:
            text = " ".join(t for c in e if name(c) not in ("MarginalNote", "Label", "HistoricalNote") if (t := text_of(c))).strip()
            rows = [(None, context, None, text)] if text else []
        for sub, told, paragraph, text in rows:
            yield pos, part, division, section, sub, paragraph, told, text
            pos += 1


def nested_sections(xml: bytes | str) -> list[dict]:
    """Sections as structs of subsections and paragraphs, for the chunking strategies."""
    out = []
    for part, division, e in walk(ET.fromstring(xml)):
        subs = []
        for s in children(e, *SUBSECTION):
            paragraphs = [{"label": label(p), "text": " ".join(t for c in p if name(c) != "Label" if (t := text_of(c)))} for p in children(s, "Paragraph")]
            subs.append({"label": label(s), "intro": " ".join(text_of(c) for c in children(s, "Text")), "paragraphs": paragraphs})
        if not subs:
            subs = [{"label": "", "intro": " ".join(text_of(c) for c in children(e, "Text")), "paragraphs": []}]
        out.append({"part": part, "division": division, "section": label(e), "marginal_note": text_of(child(e, "MarginalNote")).strip(), "subsections": subs})
    return out


def consolidation_date(xml: bytes | str) -> str:
    """The date the text stands for: an attribute of the root, else the consolidation stage of its history, else ''."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return ""
    for key, value in root.attrib.items():
        if key.rpartition("}")[2] == "pit-date" and value.strip():
            return value.strip()
    for stage in root.iter():
        if name(stage) == "Stages" and stage.get("stage") == "consolidation":
            for d in stage.iter():
                if name(d) == "Date":
                    y, m, day = (((child(d, n).text if child(d, n) is not None else "") or "").strip() for n in ("YYYY", "MM", "DD"))
                    if y:
                        return f"{y}-{m.zfill(2)}-{day.zfill(2)}"
                    break
    return ""


def consolidation_dates(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with the consolidation date of each as ``valid_from``."""

    @F.pandas_udf("string")
    def date_of(column: pd.Series) -> pd.Series:
        return column.map(lambda x: "" if x is None else consolidation_date(bytes(x)))

    return files.withColumn("valid_from", date_of(F.col(content)))


def looks_like_xml(xml: bytes) -> bool:
    """Whether what was fetched isn't an HTML page in place of a statute."""
    head = xml[:500].lower()
    return bool(xml.strip()) and b"<!doctype html" not in head and b"<html" not in head


def parse_statutes(files: DataFrame, content: str = "content", language: str = "language", valid_from: str = "valid_from", amending_act: str = "amending_act", act: str = "ITA") -> DataFrame:
    """Statute chunks of XML documents, one row each: content, language, valid_from, amending_act.  Documents that aren't XML give none."""
    fields = "language string, valid_from string, amending_act string, pos int, part string, division string, section string, subsection string, paragraph string, context_prefix string, body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in fields.split(", ")]
        for pdf in batches:
            rows = []
            for xml, lang, since, amending in pdf.itertuples(index=False):
                if xml is not None and looks_like_xml(bytes(xml) if not isinstance(xml, str) else xml.encode()):
                    try:
                        rows += [(lang, since, amending, *r) for r in chunk_rows(xml, lang or "en", act)]
                    except ET.ParseError:
                        continue
            yield pd.DataFrame(rows, columns=columns)

    parsed = files.select(F.col(content), F.col(language), F.col(valid_from), F.col(amending_act)).mapInPandas(run, fields)
    text = F.concat(F.col("context_prefix"), F.lit(" — "), F.col("body"))
    sub, par = F.coalesce("subsection", F.lit("")), F.coalesce("paragraph", F.lit(""))
    return parsed.select(
        F.lit(act).alias("act"), "part", "division", "section", sub.alias("subsection"), par.alias("paragraph"), citation(F.lit(act), "section", sub, par).alias("citation"), text.alias("text"),
        "context_prefix", "language", "valid_from", F.lit(None).cast("string").alias("valid_to"), "amending_act", sha256(text).alias("version_hash"), estimated_tokens(text).alias("token_count"), "pos",
    )


def parse_sections(files: DataFrame, content: str = "content", language: str = "language", valid_from: str = "valid_from", amending_act: str = "amending_act") -> DataFrame:
    """Nested sections of XML documents, in the declared schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in SECTION]
        for pdf in batches:
            rows = [{**s, "language": lang, "valid_from": since, "amending_act": amending} for xml, lang, since, amending in pdf.itertuples(index=False) for s in nested_sections(xml)]
            yield pd.DataFrame(rows, columns=names)

    return files.select(content, language, valid_from, amending_act).mapInPandas(run, SECTION)
