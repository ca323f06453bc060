import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import html, repair
from quarry.operators import glossary
from quarry.sources import epub, xlsx


def test_units_nesting_and_ordinals():
    doc = "<body><h1>T</h1><p>12</p><ul><li>a <b>x</b><ul><li>b</li></ul></li><li><p>c</p></li></ul><p class='bb-vi'>old</p><td>d &amp; e</td><p></p></body>"
    assert [(o, t, x) for o, t, _, x in html.units(doc)] == [(0, "h1", "T"), (2, "li", "a x"), (3, "li", "b"), (4, "li", "c"), (5, "td", "d & e")]
    assert [h for *_, h, _ in html.units("<p>a <i>b</i> &lt; c<br>d</p>")] == ["a <i>b</i> &lt; c<br/>d"]
    assert list(html.units(None)) == [] and list(html.units("<p>open<p>other")) != []


def test_scripts_and_links():
    assert html.flat_scripts("1<sup>1</sup>/<sub>3</sub> <sup>1</sup>⁄<sub>2</sub> x<sup>2</sup> H<sub>2</sub>O a<sup>(n-1)</sup> b<sub>ij</sub> c<sup>q</sup>") == "1 1/3 1/2 x² H₂O a⁽ⁿ-1)".replace("⁽ⁿ-1)", "^(n-1)") + " b_(ij) c^(q)"
    assert html.flat_scripts("x<sup>ab</sup> y<sub>c</sub>", "pandoc") == "x^ab^ y~c~"
    assert html.resolve("OEBPS/t/a.xhtml", "../i/p.jpg#x") == "OEBPS/i/p.jpg" and html.resolve("a/b", "#c") == "a/b"


def test_escape(spark):
    df = spark.createDataFrame([("a & b &amp; c < d <b>x</b> <script>",)], "t string")
    assert df.select(html.escape_untrusted(F.col("t"))).first()[0] == "a &amp; b &amp; c &lt; d <b>x</b> &lt;script>"


def test_translation_of_nodes():
    assert html.translated("<p id='1'>a <i>b</i></p>", {0: "x & <b>y</b>"}) == "<p id=\"1\">x &amp; <b>y</b></p>"
    assert html.translated("<p>one <img src='i'> two</p>", {0: "uno <b>dos</b>"}) == '<p>uno <img src="i"/>dos</p>'
    assert html.translated("<p>one <img src='i'> longer</p>", {0: "solo"}) == '<p>one <img src="i"/>solo</p>'
    assert html.translated("<p id='1' class='k'>a</p>", {0: "x"}, True) == '<p id="1" class="k">a</p><p class="k bb-vi" lang="vi">x</p>'
    assert html.translated("<td>a</td>", {0: "x"}, True) == '<td>a<br/><span class="bb-vi" lang="vi">x</span></td>'
    with pytest.raises(ValueError):
        html.translated("<p>a</p>", {3: "x"})


CHAPTERS = [("a.xhtml", "<html><body><h1>One</h1><p>First <a href='b.xhtml'>link</a></p></body></html>"), ("b.xhtml", "<html><body><p>Second</p></body></html>"), ("c.xhtml", "<html><body><p>Third</p></body></html>")]


def changed(content, name, data):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as t:
        for i in z.infolist():
            if i.filename != name:
                t.writestr(i, z.read(i.filename))
        if data is not None:
            t.writestr(name, data)
    return out.getvalue()


def test_epub_reading_and_refusals(spark):
    good = epub.build(CHAPTERS)
    drm = '<encryption xmlns="x"><e:CipherReference xmlns:e="http://www.w3.org/2001/04/xmlenc#" URI="{}"/></encryption>'
    files = [("good", good), ("font", changed(good, "META-INF/encryption.xml", drm.format("f.TTF"))), ("drm", changed(good, "META-INF/encryption.xml", drm.format("OEBPS/a.xhtml"))), ("odd", changed(good, "META-INF/encryption.xml", "<broken")), ("mime", changed(good, "mimetype", "application/epub")), ("none", changed(good, "mimetype", None)), ("zip", b"no zip"), ("box", changed(good, "META-INF/container.xml", "<x/>")), ("miss", changed(good, "OEBPS/b.xhtml", None))]
    rows = epub.read_units(spark.createDataFrame(files, "path string, content binary")).collect()
    assert {r["path"]: r["error"] for r in rows} == {"good": None, "font": None, "odd": None, "drm": "drm", "mime": "mimetype", "none": "mimetype", "zip": "zip", "box": "container", "miss": "missing OEBPS/b.xhtml"}
    assert [(r["doc_pos"], r["ordinal"], r["text"]) for r in rows if r["path"] == "good"] == [(0, 0, "One"), (0, 1, "First link"), (1, 0, "Second"), (2, 0, "Third")]


def test_epub_rewrite(spark):
    files = spark.createDataFrame([("x", epub.build(CHAPTERS)), ("y", epub.build(CHAPTERS))], "path string, content binary")
    t = spark.createDataFrame([("x", "OEBPS/b.xhtml#0", "Zwei")], "path string, unit_id string, html string")
    out = {r["path"]: bytes(r["content"]) for r in epub.rewrite_all(files, t).collect()}
    z = zipfile.ZipFile(io.BytesIO(out["x"]))
    assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.testzip() is None
    assert b"Zwei" in z.read("OEBPS/b.xhtml") and out["y"] == epub.build(CHAPTERS) or b"Second" in zipfile.ZipFile(io.BytesIO(out["y"])).read("OEBPS/b.xhtml")
    with pytest.raises(epub.EpubError):
        epub.rewrite(epub.build(CHAPTERS), {"OEBPS/z.xhtml#0": "x"})


def test_epub_drop_and_markdown():
    content, gone = epub.drop_documents(epub.build(CHAPTERS), {"OEBPS/b.xhtml"})
    assert gone == ["OEBPS/b.xhtml"]
    archive = epub.opened(content)
    assert epub.spine(archive)[1] == ["OEBPS/a.xhtml", "OEBPS/c.xhtml"]
    assert b"href" not in archive.read("OEBPS/a.xhtml") and b"link" in archive.read("OEBPS/a.xhtml")
    needed = [("a.xhtml", "<p>x</p><iframe src='b.xhtml'></iframe>"), ("b.xhtml", "<p>y</p>")]
    assert epub.drop_documents(epub.build(needed), {"OEBPS/b.xhtml"})[1] == []
    assert epub.drop_documents(epub.build(needed), {"OEBPS/a.xhtml", "OEBPS/b.xhtml"})[1] == []
    assert epub.to_markdown(epub.build([("a.xhtml", "<h2>T</h2><ol><li>a</li><li><b>b</b></li></ol><p></p>"), ("b.xhtml", "<p>q <a href='u'>l</a></p>")])) == "## T\n\n1. a\n\n2. **b**\n\nq [l](u)"


def test_workbooks(spark):
    book = xlsx.write_glossary([(" oven ", "lò", None), ("", "x", None), ("a & b", None, "n")])
    rows = xlsx.read_glossary(spark.createDataFrame([("g", book), ("bad", b"x")], "path string, content binary")).collect()
    assert [(r["term_en"], r["term_vi"], r["notes"]) for r in rows if r["path"] == "g"] == [("oven", "lò", None), ("a & b", None, "n")]
    assert next(r["error"] for r in rows if r["path"] == "bad")


IDS = ["0", "1", "2"]


@pytest.mark.parametrize(
    "raw, strict, saved",
    [
        ('{"0": "a", "1": "b", "2": "c"}', IDS, []),
        ('```json\n{"0": "a"}\n```', ["0"], []),
        ('{"0": "a"}{"1": "b"}, {"2": "c"}', IDS, []),
        ('{"0": "a", "1": "b"}}} {"2": "c"}', IDS, []),
        ('{"0": "a", "1": "say \\"hi\\"", "2": "cut of', [], ["0", "1"]),
        ('{"0": "a"} {"1": "b", "2": "c', ["0"], ["1"]),
        ('Sure: {"0": "a"}', [], ["0"]),
        ('{"0": " ", "1": 5, "9": "x"}', [], []),
        ("", [], []),
        (None, [], []),
    ],
)
def test_repair(raw, strict, saved):
    found, s, v = repair.repair_one(raw, IDS)
    assert (s, v) == (strict, saved) and sorted(found) == sorted([*strict, *saved])


def test_repair_later_wins_and_values_are_not_searched():
    assert repair.repair_one('{"0": "a"} {"0": "b"}', ["0"])[0] == {"0": "b"}
    text = '"0": "he wrote \\"1\\": \\"x\\" there", "2": "c"'
    assert repair.repair_one(text, IDS)[2] == ["0", "2"]
    assert repair.pairs_one('{"a": "b"} trailing') == {"a": "b"} and repair.pairs_one(json.dumps({"a": "b", "c": 1})) == {"a": "b"}


def test_forms():
    assert {"knead", "kneads", "kneading", "kneaded"} <= set(glossary.forms_of("knead / kneading"))
    assert {"pound", "pounds", "lb"} <= set(glossary.forms_of("pound (lb)"))
    assert {"rolling pin", "rolling pins"} <= set(glossary.forms_of("Rolling  Pin")) and "rollings pin" not in glossary.forms_of("rolling pin")
    assert {"bake", "baking", "berries"} <= set(glossary.forms_of("baking")) | set(glossary.forms_of("berry"))
    assert glossary.forms_of("") == [] and "glasss" not in {f for f in glossary.forms_of("glasses") if f == "glas"}


def test_scopes_and_upsert(spark):
    rows = [(1, "global", "Oven", "a", 5), (2, "project:1", "oven", "b", 1), (3, "project:2", "pan", "c", 1), (4, "global", "Pan", None, 2)]
    got = glossary.effective(spark.createDataFrame(rows, "entry_id long, scope string, term_en string, term_vi string, updated_at long"), "project:1").collect()
    assert sorted(r["entry_id"] for r in got) == [2, 4]
    have = spark.createDataFrame([("Oven", "a")], "term_en string, term_vi string")
    new = spark.createDataFrame([(1, "oven ", "x"), (2, "OVEN", "y"), (3, " ", "z"), (4, "Tin", None), (5, "tin", "w")], "pos long, term_en string, term_vi string")
    assert sorted(glossary.upsert(have, new).collect()) == [("Oven", "y", "updated"), ("Tin", "w", "imported")]


def test_occurrences_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "Pan pan-fry pans épan PAN's hot  pan"), (2, "none"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("pan",), ("hot pan",), ("c++",), ("!!",)], "term_en string")
    assert [(r["doc_id"], r["term_en"], r["n"]) for r in glossary.occurrences(docs, terms).collect()] == [(1, "pan", 4)]


def test_translations_that_were_suggested(spark):
    assert repair.pairs_one('x "say \\"hi\\"": "y" "cut": "of') == {'say \\"hi\\"': "y"}
    terms = glossary.term_batches(spark.createDataFrame([("b", i, t) for i, t in enumerate(["Pan", "pan", "oven", "gone", "late"])], "book string, id long, term string"), ["book"], ["id"], 4)
    raw = 'Sure: {"PAN": "1", "pan": "2", "Oven": "3", "OVEN": "4"}'
    got = glossary.suggested(terms, spark.createDataFrame([("b", 0, raw, 0.2), ("c", 0, "{}", 9.0)], "book string, batch long, raw string, cost double"), ["book"])
    assert {r["term"]: (r["batch"], r["translation"], r["cost_usd"]) for r in got.collect()} == {"Pan": (0, "1", 0.05), "pan": (0, "2", 0.05), "oven": (0, "3", 0.05), "gone": (0, None, 0.05), "late": (1, None, None)}


def test_units_of_many_pages_come_in_parts(monkeypatch):
    """A frame of pages does not become one frame of all their units."""
    import pandas as pd

    monkeypatch.setattr(html, "CHARS", 100)
    frame = pd.DataFrame({"page_id": range(50), "html": ["<p>some words here</p><p>and some more</p>"] * 49 + [None]})
    parts = list(html.html_units(iter([frame])))
    assert max(map(len, parts)) < 10 and [tuple(r) for p in parts for r in p[["page_id", "ordinal"]].itertuples(index=False)] == [(i, k) for i in range(49) for k in range(2)]


def test_archives_go_to_python_in_small_batches(spark, tmp_path):
    """A batch of volumes is bounded by bytes, not by ten thousand files."""
    from quarry.plans import state_queries

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    spark.createDataFrame([(1, "a", "x y\nz"), (2, "a", "w")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["text"] for r in state_queries.epub_units(spark, str(tmp_path)).collect()) == ["w", "x y", "z"]
    assert int(spark.conf.get(key)) <= 4 << 20


def test_archives_are_packed_once_and_over_batches(spark, tmp_path):
    """Volumes whose rows lie in several batches are whole, rows of archives come together, and archives that are read twice are built once."""
    import pandas as pd

    from quarry.plans import state_queries
    from quarry.sources import epub
    from quarry.sources.shared import setting

    rows = [(k, v, i) for i in range(10) for k, v in (("a", 0), ("a", 1), (None, 0))]
    docs = spark.createDataFrame(rows, "k string, v long, i long").repartition(3)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "4"):
        packed = epub.volumes(docs, ["k", "v"], "i", lambda g: (f"{g[0]['k']}/{g[0]['v']}", ",".join(str(r["i"]) for r in g).encode())).collect()
    assert sorted(r["path"] for r in packed) == ["None/0", "a/0", "a/1"] and {bytes(r["content"]) for r in packed} == {b"0,1,2,3,4,5,6,7,8,9"}
    content = epub.build([(f"d{i}.xhtml", "<html><body><p>one</p><p>two</p></body></html>") for i in range(20)])
    assert [len(f) for f in epub._units(iter([pd.DataFrame({"path": ["x", "y"], "content": [content, content]})]))] == [80]
    assert [len(f) for f in epub._frames(((i, "x" * (1 << 20)) for i in range(9)), ["i", "t"])] == [4, 4, 1]
    spark.createDataFrame([(1, "a", "x y\nz"), (2, "a", "w")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (state_queries.epub_translate, state_queries.book_markdown):
        assert not any("documents.parquet" in f for f in query(spark, str(tmp_path)).inputFiles())
