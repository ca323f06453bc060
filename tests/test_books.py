"""Files of books by Spark's readers and writers: whole or not at all, and only those that were asked for."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import books, epub, sinks, xlsx

CHAPTERS = [("a.xhtml", "<html><body><h1>One</h1><p>First</p></body></html>"), ("b.xhtml", "<html><body><p>Second</p></body></html>")]


@pytest.fixture(scope="module")
def session(spark):
    books.register(spark)
    return spark


def left(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_files_come_whole(session, tmp_path):
    files = [("x/one.epub", epub.build(CHAPTERS)), ("two.epub", epub.build(CHAPTERS[:1]))]
    df = session.createDataFrame(files, "path string, content binary").repartition(2)
    df.write.format("quarry_files").option("kind", "epub").mode("append").save(f"{tmp_path}/out")
    assert left(f"{tmp_path}/out") == ["two.epub", "x/one.epub"] and (tmp_path / "out/x/one.epub").read_bytes() == files[0][1]
    with pytest.raises(Exception, match="already there"):
        df.write.format("quarry_files").mode("append").save(f"{tmp_path}/out")
    df.withColumn("content", F.lit(b"other")).write.format("quarry_files").mode("overwrite").save(f"{tmp_path}/out")
    assert (tmp_path / "out/two.epub").read_bytes() == b"other" and len(left(f"{tmp_path}/out")) == 2


@pytest.mark.parametrize(
    "bad, message",
    [
        (("z.epub", b"no zip"), "zip"), (("z.epub", epub.build([("a.xhtml", "<html><p>open</html>")])), "not well-formed"), (("../z.epub", epub.build(CHAPTERS)), "not a path"),
        ((None, b""), "not a path"), (("f1.epub", epub.build(CHAPTERS)), "written twice"),
    ],
)
def test_a_job_that_fails_leaves_nothing(session, tmp_path, bad, message):
    good = [(f"f{i}.epub", epub.build(CHAPTERS)) for i in range(4)]
    df = session.createDataFrame([*good, bad], "path string, content binary").repartition(3)
    with pytest.raises(Exception, match=message):
        df.write.format("quarry_files").option("kind", "epub").mode("append").save(f"{tmp_path}/out")
    assert left(f"{tmp_path}/out") == []


def test_parse_archives_hold_what_they_should(session, tmp_path):
    rows = [("a.zip", sinks.parse_zip("text", {"1.jpg": b"x"}), 1), ("b.zip", sinks.parse_zip("text", {}), 0)]
    write = lambda rows: session.createDataFrame(rows, "path string, content binary, images int").write.format("quarry_files").option("kind", "parse").mode("append").save(f"{tmp_path}/out")
    write(rows)
    assert left(f"{tmp_path}/out") == ["a.zip", "b.zip"]
    with pytest.raises(Exception, match="images"):
        write([("c.zip", rows[0][1], 2)])
    assert left(f"{tmp_path}/out") == ["a.zip", "b.zip"]


def test_readers_give_what_the_functions_give(session, tmp_path):
    files = {"a/x.epub": epub.build(CHAPTERS), "a/y.EPUB": b"no zip", "b/z.epub": epub.build(CHAPTERS[1:]), "g.xlsx": xlsx.write_glossary([("pan", "chảo", None)]), "h.xlsx": b"", "_hidden.epub": b"", "empty.jsonl": b""}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = lambda df: sorted(map(str, df.collect()))
    binary = session.createDataFrame([(k, v) for k, v in files.items() if not k.startswith("_")], "path string, content binary")
    units = session.read.format("quarry_epub").load(str(tmp_path))
    assert rows(units) == rows(epub.read_units(binary.where("lower(path) like '%.epub'"))) and units.where("error is not null").count() == 1
    assert rows(session.read.format("quarry_glossary").load(str(tmp_path))) == rows(xlsx.read_glossary(binary.where("path like '%.xlsx'")))
    asked = units.where(F.col("path").isin("a/x.epub", "b/z.epub")).where(F.col("path").startswith("a/")).where("ordinal >= 0")
    assert {r["path"] for r in asked.collect()} == {"a/x.epub"}
    assert session.read.format("quarry_drop_report").load(str(tmp_path)).count() == 0


def test_filters_choose_files_before_they_are_opened(tmp_path):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

    for name in ("a1.epub", "a2.epub", "b.epub"):
        (tmp_path / name).write_bytes(b"")
    for filters, names in (([EqualTo(("path",), "b.epub")], ["b.epub"]), ([StringStartsWith(("path",), "a"), In(("path",), ("a2.epub", "b.epub"))], ["a2.epub"]), ([EqualTo(("tag",), "p")], ["a1.epub", "a2.epub", "b.epub"]), ([EqualTo(("path",), "none")], [])):
        reader = books.EpubSource({"path": str(tmp_path)}).reader(epub_schema())
        kept = list(reader.pushFilters([IsNotNull(("path",)), *filters]))
        assert [p for part in reader.partitions() for p in part.paths] == names and len(kept) == 1 + (filters[0].attribute == ("tag",))


def epub_schema():
    from pyspark.sql.types import StringType, StructField, StructType

    return StructType([StructField(c.split()[0], StringType()) for c in epub.UNITS.split(", ")])


def test_drop_reports(session, tmp_path):
    lines = ['{"type":"header"}', "{broken", "", '{"type":"page","page_number_1based":1,"dropped_count":2}', '{"type":"drop","page_number_1based":1,"debug_id":"x"}', "[]", '{"type":"later","page_number_1based":7}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    rows = session.read.format("quarry_drop_report").load(str(tmp_path)).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, "header", None, None, None), (1, "malformed", None, None, None), (3, "page", 1, 2, None), (4, "drop", 1, None, "x"), (5, "malformed", None, None, None), (6, "other", None, None, None)]
    for bad in ({"type": "page", "dropped_count": 1}, {"type": "page", "page_number_1based": 1}, {"type": "drop"}):
        (tmp_path / "r.jsonl").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="record without page"):
            session.read.format("quarry_drop_report").load(str(tmp_path)).collect()


def test_markdown_of_volumes(session):
    """Documents as rows equal the function over a volume, but for images, which are named over the volumes of a book."""
    page = lambda name, text: f'<html><body><h1>{text}</h1><p><img src="../{name}" alt="a"/> {text} <img src="none.jpg"/></p></body></html>'
    one = epub.build([("t/a.xhtml", page("i/x.jpg", "One")), ("t/b.xhtml", page("j/x.jpg", "Two")), ("t/c.xhtml", "<html><body/></html>")], images={"i/x.jpg": b"1", "j/x.jpg": b"2"})
    two = epub.build([("t/a.xhtml", page("i/x.jpg", "Three")), ("t/b.xhtml", page("k/y.jpg", "Four"))], images={"i/x.jpg": b"2", "k/y.jpg": b"1", "unused.PNG": b"3"})
    files = session.createDataFrame([("b/1", one), ("b/2", two), ("c/1", two), ("b/3", b"no zip")], "path string, content binary")
    docs, images = epub.export_markdown(files, F.regexp_extract("path", "^[^/]*", 0))
    texts = {}
    for r in docs.orderBy("path", "doc_pos").collect():
        texts.setdefault(r["path"], []).append(r["markdown"])
    joined = {p: "\n\n".join(t for t in found if t) for p, found in texts.items()}
    named = lambda text, *names: text.replace("(../i/x.jpg)", f"(images/{names[0]})").replace("(../j/x.jpg)", f"(images/{names[1]})").replace("(../k/y.jpg)", f"(images/{names[1]})")
    assert joined == {"b/1": named(epub.to_markdown(one), "x.jpg", "x_2.jpg"), "b/2": named(epub.to_markdown(two), "x_2.jpg", "y.jpg"), "c/1": named(epub.to_markdown(two), "x.jpg", "y.jpg")}
    assert sorted((r["book"], r["name"], bytes(r["content"])) for r in images.collect()) == [("b", "unused.PNG", b"3"), ("b", "x.jpg", b"1"), ("b", "x_2.jpg", b"2"), ("b", "y.jpg", b"1"), ("c", "unused.PNG", b"3"), ("c", "x.jpg", b"2"), ("c", "y.jpg", b"1")]
