import json

from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators.segment import all_strategies, hierarchical_subsections, sliding_subsections, strategy_report, strict_subsections
from tidewell.sources import files, html, links, statute_xml
from tidewell.streaming.ingest import append_new, stream_table, weekly_counts

XML = """<?xml version="1.0"?><Statute xmlns:l="urn:l" l:pit-date="2026-06-18"><Body>
<Heading level="1"><Label>PART I</Label><TitleText>Tax</TitleText></Heading><Heading level="2"><Label>A</Label></Heading>
<Section><Label>2</Label><MarginalNote>Base</MarginalNote><Text>An <Ref>income</Ref> tax of ½ <HistoricalNote>old</HistoricalNote>tail.</Text></Section>
<Section><Text>no label</Text></Section>
<Section><Label>5</Label><Subsection><Label>(1)</Label><MarginalNote>Rule</MarginalNote><Text>Intro</Text><Paragraph><Label>(a)</Label><Text>one</Text><Subparagraph><Label>(i)</Label><Text>sub</Text></Subparagraph></Paragraph>
<Paragraph><Label>(a)</Label><Text>two</Text></Paragraph><Text>lost</Text><ContinuedSectionSubsection><Text>end</Text></ContinuedSectionSubsection></Subsection>
<Subsection><Label>(2)</Label><Text>{intro}</Text><Paragraph><Label>(a)</Label><Text>{long} royalty</Text></Paragraph><Paragraph><Label>(b)</Label><Text>{long}</Text></Paragraph></Subsection></Section>
<Heading level="1"><TitleText>Other</TitleText></Heading>
<Section><Label>9</Label><Subsection><Label>(1)</Label><Definition><Text><DefinedTermEn>gain</DefinedTermEn> means more</Text></Definition><Definition><Text></Text></Definition></Subsection></Section>
</Body></Statute>""".replace("{intro}", "intro word " * 30).replace("{long}", "long " * 200)


def test_statute_chunks(spark):
    df = spark.createDataFrame([(bytearray(XML.encode()), "en", "2026-06-18", "am"), (bytearray(b"<!DOCTYPE html><html>"), "en", "", ""), (None, "en", "", ""), (bytearray(b"<broken"), "en", "", "")], "content binary, language string, valid_from string, amending_act string")
    out = statute_xml.parse_statutes(df)
    assert set(f.name for f in schemas.STATUTE_CHUNK) <= set(out.columns)
    rows = out.orderBy("pos").collect()
    assert [r["citation"] for r in rows] == ["ITA s.2", "ITA s.5(1)", "ITA s.5(2)(a)", "ITA s.5(2)(b)", "ITA s.9(1)"]
    assert rows[0]["text"] == "Base [PART I, Division A] — An income tax of one-half tail."
    assert rows[1]["text"] == "Rule [ITA s.5(1)] — Intro (a) two end"
    assert rows[2]["context_prefix"].endswith(" | rents and royalties") and rows[2]["text"].count("intro word") == 30 and "…" in rows[3]["text"]
    assert rows[4]["context_prefix"] == "Definition of 'gain' [[Part Other]] [ITA s.9(1)]" and rows[4]["division"] == ""
    assert statute_xml.consolidation_date(XML) == "2026-06-18" and statute_xml.consolidation_date("<x") == ""
    assert statute_xml.consolidation_date("<S><BillHistory><Stages stage='consolidation'><Date><YYYY>2024</YYYY><MM>1</MM><DD>5</DD></Date></Stages></BillHistory></S>") == "2024-01-05"


def test_sublabels_are_doubled():
    from xml.etree import ElementTree as ET

    p = ET.fromstring("<Paragraph><Label>(a)</Label><Text>one</Text><Subparagraph><Label>(i)</Label><Text>sub</Text></Subparagraph></Paragraph>")
    assert statute_xml.paragraph_text(p) == "(a) one (i) (i) sub"


def test_strategies(spark):
    df = spark.createDataFrame([(XML, "en", "2026-06-18", "am")], "content string, language string, valid_from string, amending_act string")
    s = statute_xml.parse_sections(df)
    strict = {r["citation"]: r["text"] for r in strict_subsections(s).collect()}
    assert "intro" not in strict["ITA s.5(2)(a)"] and strict["ITA s.5(2)(b)"].startswith("[Part PART I, Division A] — (b) long")
    hier = {r["citation"]: r for r in hierarchical_subsections(s).collect()}
    assert "intro word" in hier["ITA s.5(2)(a)"]["text"] and "intro word" not in hier["ITA s.5(2)(b)"]["text"] and hier["ITA s.5(2)(b)"]["context_prefix"].endswith(" — s.5(2)")
    slide = {r["citation"]: r["text"] for r in sliding_subsections(s).collect()}
    assert " [overlap→2] (a) long" in slide["ITA s.5(1)"] and "overlap" not in slide["ITA s.5(2)"]
    assert {r["strategy"] for r in strategy_report(all_strategies(s)).collect()} == {"strict_subsection", "sliding_window", "hierarchical"}


PAGE = """<html><body><nav><p>navigation that is long enough to count</p></nav><div id="Main-x"><h1>A heading of more than twenty</h1><table><tr><th>a</th><th>b long enough</th></tr><tr><td></td><td></td></tr>
<tr><td>1 &amp; 2</td><td>second cell text</td></tr></table><ul><li>item with <p>a paragraph that is inside of it</p></li></ul><p>short</p><a href="/files/doc20250131.pdf">PDF</a></div></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([("u", PAGE), ("v", None), ("w", "no tags but enough text to be a block")], "url string, html string")
    got = [(r["kind"], r["text"]) for r in html.page_blocks(pages).where("url = 'u'").orderBy("pos").collect()]
    assert got[0] == ("table", "a | b long enough\n1 & 2 | second cell text")
    assert [t for _, t in got[1:]] == ["A heading of more than twenty", "item with a paragraph that is inside of it", "a paragraph that is inside of it"]
    found = html.page_links(pages).withColumnRenamed("url", "page")
    p = [links.LinkPattern(r"/files/doc(\d{8})\.pdf$", "Kind", "k_", "'Doc —' MMMM yyyy", "I")]
    rec = links.match_links(found, p, "https://x.example", "2025-01-01", "2025-12-31").collect()
    assert len(rec) == 1 and rec[0]["doc_id"] == "k_20250131" and rec[0]["title"] == "Doc — January 2025" and rec[0]["url"] == "https://x.example/files/doc20250131.pdf"
    assert links.match_links(found, p, "https://x.example", "2025-02-01", "2025-12-31").count() == 0
    seen = spark.createDataFrame([("k_20250131",)], "doc_id string")
    assert links.match_links(found, p, "https://x.example", "2025-01-01", "2025-12-31", seen).count() == 0
    assert links.preferred_pdf(found, F.lit("none"), "https://x.example").first()["address"].endswith("doc20250131.pdf")
    dates = spark.createDataFrame([("2025-01-29",)], "date string")
    assert links.dated_addresses(dates, "https://x.example/{y}/{m}/r-{iso}/").first()["url"] == "https://x.example/2025/01/r-2025-01-29/"


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"key_plot_id": "k", "pcr_conc_lin": "1"}, {"key_plot_id": "l", "more": 1}]))
    (tmp_path / "b.csv").write_bytes(b"site_id,pcr_target\n1, SARS-CoV-2 \n2,rsv\n3,\xff\n")
    a = files.read_json_feed(spark, str(tmp_path / "a.json"))
    assert a.columns == [f.name for f in schemas.FEED_A] and a.count() == 2
    assert files.read_json_feed(spark, str(tmp_path / "a.json"), limit=1, order=["key_plot_id"]).first()["key_plot_id"] == "k"
    b = files.read_csv_feed(spark, str(tmp_path / "b.csv"), target="sars-cov-2")
    assert b.count() == 1 and files.read_csv_feed(spark, str(tmp_path / "b.csv")).count() == 3
    both = files.union_of_files(spark, [str(tmp_path / "a.json"), str(tmp_path / "none.json")], files.read_json_feed)
    assert both.count() == 2
    files.write_csv(a, str(tmp_path / "out"))
    assert files.read_binary(spark, str(tmp_path), "*.json").first()["version_hash"].startswith("sha256:")


def test_stream_appends_each_key_once(spark, tmp_path):
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "chunk_id string, text string"
    for rows in ([("a", "1"), ("a", "1"), ("b", "2")], [("b", "2"), ("c", "3")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landed)
        q = append_new(stream_table(spark, landed, spark.createDataFrame([], schema).schema), out, str(tmp_path / "cp"), "chunk_id")
        q.awaitTermination(120)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_weekly_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/canonical.parquet").schema
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "canonical.parquet").symlink_to(f"{sf}/canonical.parquet")
    q = weekly_counts(stream_table(spark, str(tmp_path / "l"), schema)).writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("weekly").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/canonical.parquet").count()
