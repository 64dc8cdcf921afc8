"""Texts and nested sections into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import citation, context_prefix, estimated_tokens, first_sentence, sha256

LIMIT, TOKEN_LIMIT = 1600, 400


def paragraphs(df: DataFrame, keys: list[str], text: str = "text", least: int = 20, page: str | None = None) -> DataFrame:
    """keys, paras: the paragraphs (lines, trimmed, of at least ``least`` characters) in order, as structs of page and text."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    at = F.col(page) if page else F.lit(1)
    return df.where(F.col(text).isNotNull()).select(*keys, F.transform(lines, lambda x: F.struct(at.cast("int").alias("page_num"), x.alias("text"))).alias("paras"))


def pack_paragraphs(df: DataFrame, keys: list[str], limit: int = LIMIT, doc: str | None = None) -> DataFrame:
    """Greedy packing of ``paras`` (ordered array of page and text) into chunks, as one fold in the JVM.

    A paragraph that would take the chunk over the limit starts the next; the closed chunk gets the first sentence of that
    paragraph as overlap.  Paragraphs are never cut.  A chunk's page is that of its first paragraph; numbers are from 0.
    The fold numbers where chunks start; texts are joined afterwards from slices, each once."""
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("size"), F.lit(0).alias("i"))

    def step(acc: Column, n: Column) -> Column:
        over = (acc["i"] == 0) | (acc["size"] + n > limit)
        return F.struct(
            F.when(over, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"), F.when(over, n).otherwise(acc["size"] + n).alias("size"), (acc["i"] + 1).alias("i")
        )

    folded = df.withColumn("__starts", F.aggregate(F.transform("paras", lambda p: F.length(p["text"])), zero, step)["starts"])
    at = folded.select(*keys, "paras", "__starts", F.posexplode("__starts").alias("chunk_idx", "__from"))
    end = F.coalesce(F.get("__starts", F.col("chunk_idx") + 1), F.size("paras"))
    body = F.array_join(F.transform(F.slice("paras", F.col("__from") + 1, end - F.col("__from")), lambda p: p["text"]), "\n\n")
    lead = F.get("paras", end)["text"]
    text = F.when(lead.isNotNull(), F.concat(body, F.lit("\n\n"), first_sentence(lead))).otherwise(body)
    out = at.select(*keys, "chunk_idx", F.get("paras", F.col("__from"))["page_num"].alias("page_num"), text.alias("text"))
    return out.withColumn("chunk_id", F.format_string("%s_%04d", F.col(doc).cast("string"), "chunk_idx")) if doc else out


def overlaps(a: list[Column], b: list[Column]) -> Column:
    """Whether two rectangles (x0, y0, x1, y1) overlap; touching edges don't."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def outside_tables(blocks: DataFrame, tables: DataFrame, page: str = "page") -> DataFrame:
    """Blocks that overlap no table of their page: an anti-join on the page with the overlap as its condition."""
    b, t = blocks.alias("b"), tables.alias("t")
    box = lambda x: [F.col(f"{x}.{c}") for c in ("x0", "y0", "x1", "y1")]
    return b.join(t, (F.col(f"b.{page}") == F.col(f"t.{page}")) & overlaps(box("b"), box("t")), "left_anti")


def running_headings(nodes: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level", label: str = "label") -> DataFrame:
    """Each node with the last level-1 heading before it (``part``) and the last level-2 heading within that part (``division``)."""
    so_far = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    is1, is2 = F.col(level) == 1, F.col(level) == 2
    marked = nodes.withColumns({"part": F.last(F.when(is1, F.col(label)), ignorenulls=True).over(so_far), "__n": F.count_if(is1).over(so_far)})
    in_part = Window.partitionBy(doc, "__n").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("division", F.last(F.when(is2, F.col(label)), ignorenulls=True).over(in_part)).drop("__n")


def _labelled(p: Column) -> Column:
    return F.when(F.coalesce(p["label"], F.lit("")) != "", F.concat(F.lit("("), p["label"], F.lit(") "), p["text"])).otherwise(p["text"])


def _full_text(sub: Column) -> Column:
    """The intro and the labelled paragraphs of a subsection."""
    intro = F.when(F.coalesce(sub["intro"], F.lit("")) != "", F.array(sub["intro"])).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(intro, F.transform(sub["paragraphs"], _labelled)), " ")


def _subsections(sections: DataFrame, act: str) -> DataFrame:
    fallback = F.concat(F.lit(f"{act} s."), F.col("section"))
    return sections.select("*", F.posexplode("subsections").alias("sub_pos", "sub")).withColumns(
        {
            "prefix": context_prefix("marginal_note", "part", "division", fallback),
            "next_sub": F.get("subsections", F.col("sub_pos") + 1),
            "full_text": _full_text(F.col("sub")),
        }
    ).where(F.trim("full_text") != "")


def _chunk(rows: DataFrame, act: str, text: Column, prefix: Column, paragraph: Column) -> DataFrame:
    whole = F.concat(prefix, F.lit(" — "), text)
    sub = F.coalesce(F.col("sub.label"), F.lit(""))
    return rows.select(
        F.lit(act).alias("act"), "part", "division", "section", sub.alias("subsection"), F.coalesce(paragraph, F.lit("")).alias("paragraph"),
        citation(F.lit(act), "section", sub, paragraph).alias("citation"), whole.alias("text"), prefix.alias("context_prefix"), "language", "valid_from",
        F.lit(None).cast("string").alias("valid_to"), "amending_act", sha256(whole).alias("version_hash"), estimated_tokens(whole).alias("token_count"),
    )


def strict_subsections(sections: DataFrame, act: str = "ITA", token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """A chunk for each subsection; one over the limit is cut at its paragraphs, and its intro is left out."""
    return _by_paragraph(sections, act, token_limit, with_intro=False)


def hierarchical_subsections(sections: DataFrame, act: str = "ITA", token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """As strict, but paragraphs carry their subsection in the context, and the first one the intro."""
    return _by_paragraph(sections, act, token_limit, with_intro=True)


def _by_paragraph(sections: DataFrame, act: str, token_limit: int, with_intro: bool) -> DataFrame:
    subs = _subsections(sections, act)
    whole = (estimated_tokens("full_text") <= token_limit) | (F.size("sub.paragraphs") == 0)
    kept = _chunk(subs.where(whole), act, F.trim("full_text"), F.col("prefix"), F.lit(None).cast("string"))
    cut = subs.where(~whole).select("*", F.posexplode("sub.paragraphs").alias("p_pos", "p"))
    text, prefix = _labelled(F.col("p")), F.col("prefix")
    if with_intro:
        text = F.when((F.col("p_pos") == 0) & (F.coalesce(F.col("sub.intro"), F.lit("")) != ""), F.concat(F.col("sub.intro"), F.lit(" "), text)).otherwise(text)
        named = F.concat(prefix, F.lit(" — s."), F.col("section"), F.lit("("), F.col("sub.label"), F.lit(")"))
        prefix = F.when(F.coalesce(F.col("sub.label"), F.lit("")) != "", named).otherwise(prefix)
    text = F.trim(text)
    return kept.unionByName(_chunk(cut.where(text != ""), act, text, prefix, F.col("p.label")))


def sliding_subsections(sections: DataFrame, act: str = "ITA", most: int = 200) -> DataFrame:
    """A chunk for each subsection, followed by the start of the next one: its first paragraph, else its intro's first characters."""
    nxt = F.col("next_sub")
    p = F.get(nxt["paragraphs"], 0)
    lead = F.concat(F.lit(" [overlap→"), F.coalesce(nxt["label"], F.lit("")), F.lit("] "))
    suffix = (
        F.when(F.size(nxt["paragraphs"]) > 0, F.concat(lead, F.lit("("), F.coalesce(p["label"], F.lit("")), F.lit(") "), p["text"]))
        .when(F.coalesce(nxt["intro"], F.lit("")) != "", F.concat(lead, F.substring(nxt["intro"], 1, most)))
        .otherwise("")
    )
    subs = _subsections(sections, act)
    return _chunk(subs, act, F.trim(F.concat(F.col("full_text"), F.coalesce(suffix, F.lit("")))), F.col("prefix"), F.lit(None).cast("string"))


def all_strategies(sections: DataFrame, act: str = "ITA") -> DataFrame:
    """The chunks of the three strategies, with a ``strategy`` column."""
    parts = {"strict_subsection": strict_subsections, "sliding_window": sliding_subsections, "hierarchical": hierarchical_subsections}
    out = None
    for name, f in parts.items():
        one = f(sections, act).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def strategy_report(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.round(F.avg("token_count"), 4).alias("mean_tokens"), F.max("token_count").alias("most_tokens"))
