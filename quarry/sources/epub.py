"""EPUB files: reading units, rewriting with translations, dropping documents, exporting Markdown.

Files come from Spark's ``binaryFile`` reader as (path, content); an archive is handled whole in one call of a function
on that row, so any store that Spark reads will do."""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.sources.shared import written

PICTURES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp")
FONTS = (".ttf", ".otf", ".woff", ".woff2")
MIME = "application/epub+zip"
_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "e": "http://www.w3.org/2001/04/xmlenc#"}

UNITS = "path string, error string, doc_pos int, doc_href string, ordinal int, tag string, html string, text string"


#: Characters or bytes of rows that are handed on at once, and rows.
SIZE, ROWS = 4 << 20, 5000


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of some size: neither one a row, nor one of all."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += sum(len(c) for c in row if isinstance(c, (str, bytes)))
        if size >= SIZE or len(some) >= ROWS:
            yield pd.DataFrame(some, columns=names)
            some, size = [], 0
    if some:
        yield pd.DataFrame(some, columns=names)


def volumes(docs: DataFrame, key: list[str], order: str, pack: Callable[[list[dict]], tuple[str, bytes]]) -> DataFrame:
    """Rows of each key, in order, packed to one archive (path, content). Rows come sorted, so a task holds the rows of one key and batch, and many
    small keys cost no more than their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        packed = (pack(list(group)) for _, group in groupby(rows, lambda r: [r[k] for k in key]))
        for frame in _frames(packed, ["path", "content"]):
            yield pa.RecordBatch.from_arrays([pa.array(frame.path, pa.string()), pa.array(frame.content, pa.binary())], names=["path", "content"])

    return docs.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(run, "path string, content binary")


class EpubError(ValueError):
    """A file that can't be read: what is wrong is the message."""


def check(archive: zipfile.ZipFile) -> None:
    """Refuse archives with rights management (fonts may be scrambled) or without the right mimetype."""
    names = set(archive.namelist())
    if "META-INF/encryption.xml" in names:
        try:
            root = ElementTree.fromstring(archive.read("META-INF/encryption.xml"))
        except ElementTree.ParseError:
            root = None
        refs = [] if root is None else [r.get("URI") or "" for r in root.iter(f"{{{_NS['e']}}}CipherReference")]
        if any(not unquote(r).lower().endswith(FONTS) for r in refs):
            raise EpubError("drm")
    if "mimetype" not in names or archive.read("mimetype") != MIME.encode():
        raise EpubError("mimetype")


def spine(archive: zipfile.ZipFile) -> tuple[str, list[str]]:
    """Path of the package file, and the paths of the documents in reading order."""
    try:
        root = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        package = root.find(".//c:rootfile", _NS).get("full-path")
        opf = ElementTree.fromstring(archive.read(package))
    except (KeyError, AttributeError, ElementTree.ParseError) as e:
        raise EpubError("container") from e
    base = posixpath.dirname(package)
    items = {i.get("id"): posixpath.normpath(posixpath.join(base, unquote(i.get("href") or ""))) for i in opf.findall(".//o:manifest/o:item", _NS)}
    hrefs = [items[r.get("idref")] for r in opf.findall(".//o:spine/o:itemref", _NS) if r.get("idref") in items]
    if missing := [h for h in hrefs if h not in archive.namelist()]:
        raise EpubError(f"missing {missing[0]}")
    return package, hrefs


def _document(archive: zipfile.ZipFile, href: str) -> str:
    return archive.read(href).decode("utf-8", "replace")


def opened(content: bytes) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile as e:
        raise EpubError("zip") from e
    check(archive)
    return archive


def unit_rows(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of UNITS, a document at a time."""
    try:
        archive = opened(content)
        _, hrefs = spine(archive)
    except EpubError as e:
        yield path, str(e), None, None, None, None, None, None
        return
    for pos, href in enumerate(hrefs):
        for unit in H.units(_document(archive, href), H.parse_xhtml):
            yield path, None, pos, href, *unit


def _units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in UNITS.split(", ")]
    rows = (r for frame in frames for path, content in zip(frame.path, frame.content) for r in unit_rows(path, content))
    for frame in _frames(rows, names):
        yield frame.astype({"doc_pos": "Int32", "ordinal": "Int32"})


def read_units(files: DataFrame) -> DataFrame:
    """(path, content) to units; a file that can't be read is one row with its error."""
    return files.select("path", "content").mapInPandas(_units, UNITS)


def _copied(archive: zipfile.ZipFile, changed: dict[str, bytes], dropped: set[str] = frozenset()) -> bytes:
    """The archive with changed entries: same order and attributes, the mimetype first and stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as target:
        infos = sorted(archive.infolist(), key=lambda i: i.filename != "mimetype")
        for info in infos:
            if info.filename not in dropped:
                data = changed.get(info.filename, archive.read(info.filename))
                target.writestr(info, data, zipfile.ZIP_STORED if info.filename == "mimetype" else info.compress_type)
    return out.getvalue()


def rewrite(content: bytes, translations: dict[str, str], bilingual: bool = False) -> bytes:
    """``translations`` by unit id ``href#ordinal``; unknown ids raise."""
    archive = opened(content)
    _, hrefs = spine(archive)
    by_doc: dict[str, dict[int, str]] = {}
    for unit, text in translations.items():
        href, _, ordinal = unit.rpartition("#")
        if href not in hrefs or not ordinal.isdigit():
            raise EpubError(f"no such unit: {unit}")
        by_doc.setdefault(href, {})[int(ordinal)] = text
    changed = {h: H.translated(_document(archive, h), t, bilingual, H.parse_xhtml) for h, t in by_doc.items()}
    for h, text in changed.items():
        if not H.well_formed(text):
            raise EpubError(f"not well-formed after translation: {h}")
    return _copied(archive, {h: text.encode() for h, text in changed.items()})


def rewrite_all(files: DataFrame, translations: DataFrame, bilingual: bool = False) -> DataFrame:
    """``files`` (path, content) and ``translations`` (path, unit_id, html) to (path, content); files without any stay as they are."""
    maps = translations.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "html"))).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame.path, "content": [c if t is None else rewrite(c, dict(t), bilingual) for c, t in zip(frame.content, frame.t)]})

    return files.select("path", "content").join(maps, "path", "left").mapInPandas(run, "path string, content binary")


def drop_documents(content: bytes, hrefs: set[str]) -> tuple[bytes, list[str]]:
    """Remove documents from package, reading order, guide and contents; links to them lose their anchor. A document that
    a kept one needs (image, frame, style sheet or script) stays. Gives the archive and what was removed; nothing is, if a kept
    document would not be well-formed afterwards."""
    archive = opened(content)
    package, order = spine(archive)
    wanted = set(hrefs) & set(order)
    if wanted == set(order):
        return content, []
    trees = {h: H.parse_xhtml(_document(archive, h)) for h in order if h not in wanted}
    targets = [(h, n, H.resolve(h, dict(n.attrs).get("href") or dict(n.attrs).get("src") or dict(n.attrs).get("data"))) for h, t in trees.items() for n in t.walk()]
    gone = wanted - {t for _, n, t in targets if n.tag in ("img", "link", "iframe", "object", "script")}
    changed: dict[str, bytes] = {}
    for h, n, t in targets:
        if n.tag == "a" and t in gone:
            n.tag, n.attrs = "span", []
            changed[h] = b""
    changed = {h: trees[h].inner().encode() for h in changed}
    if not all(H.well_formed(text.decode()) for text in changed.values()):
        return content, []
    opf = ElementTree.fromstring(archive.read(package))
    base = posixpath.dirname(package)
    at = lambda e: posixpath.normpath(posixpath.join(base, unquote((e.get("href") or "").split("#")[0])))
    ids = {i.get("id") for i in opf.iter(f"{{{_NS['o']}}}item") if at(i) in gone}
    for parent in list(opf.iter()):
        for child in list(parent):
            kind = child.tag.rpartition("}")[2]
            if kind == "item" and child.get("id") in ids or kind == "itemref" and child.get("idref") in ids or kind == "reference" and at(child) in gone:
                parent.remove(child)
    changed[package] = ElementTree.tostring(opf, encoding="utf-8", xml_declaration=True)
    for name in archive.namelist():
        if name.endswith(".ncx"):
            toc = ElementTree.fromstring(archive.read(name))
            for parent in list(toc.iter()):
                for child in list(parent):
                    source = next((c.get("src") for c in child if c.tag.endswith("content")), None)
                    if child.tag.rpartition("}")[2] in ("navPoint", "pageTarget") and H.resolve(name, source) in gone:
                        parent.remove(child)
            changed[name] = ElementTree.tostring(toc, encoding="utf-8", xml_declaration=True)
    return _copied(archive, changed, gone), sorted(gone)


def to_markdown(content: bytes) -> str:
    """All documents in reading order, those with text a blank line apart."""
    archive = opened(content)
    texts = (H.markdown(_document(archive, h), H.parse_xhtml) for h in spine(archive)[1])
    return "\n\n".join(t for t in texts if t)


DOCUMENTS = "path string, doc_pos int, doc_href string, html string, sources array<string>"
IMAGES = "path string, image string, sha256 string, content binary"


def read_documents(files: DataFrame) -> DataFrame:
    """(path, content) to documents in reading order, each with the paths of the images that it shows; files that can't be read give none."""

    def documents(path: str, content: bytes) -> Iterator[tuple]:
        try:
            archive = opened(content)
            hrefs = spine(archive)[1]
        except EpubError:
            return
        for pos, href in enumerate(hrefs):
            html = _document(archive, href)
            yield path, pos, href, html, sorted({H.resolve(href, s) for s in H.image_sources(html, H.parse_xhtml)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((r for frame in frames for path, content in zip(frame.path, frame.content) for r in documents(path, content)), [c.split()[0] for c in DOCUMENTS.split(", ")])

    return files.select("path", "content").mapInPandas(run, DOCUMENTS)


def read_images(files: DataFrame) -> DataFrame:
    """(path, content) to the images that the archives hold, by the names that images have."""

    def images(path: str, content: bytes) -> Iterator[tuple]:
        try:
            archive = opened(content)
        except EpubError:
            return
        for name in sorted(n for n in archive.namelist() if n.lower().endswith(PICTURES)):
            data = archive.read(name)
            yield path, name, hashlib.sha256(data).hexdigest(), data

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((r for frame in frames for path, content in zip(frame.path, frame.content) for r in images(path, content)), [c.split()[0] for c in IMAGES.split(", ")])

    return files.select("path", "content").mapInPandas(run, IMAGES)


def image_names(images: DataFrame, book: str = "book") -> DataFrame:
    """``images`` (book, path, image, sha256) with their ``name`` in the book's export: equal content under one base name shares it; other content
    with that base name gets a number, in the order in which contents first appear."""
    base, ending = F.regexp_extract("image", "([^/]+?)(\\.[^./]*)?$", 1), F.regexp_extract("image", "(\\.[^./]*)?$", 1)
    based = images.withColumns({"_base": base, "_ending": ending})
    firsts = based.groupBy(book, "_base", "_ending", "sha256").agg(F.min(F.struct("path", "image")).alias("first"))
    order = Window.partitionBy(book, "_base", "_ending").orderBy("first")  # contents of one base name, not images
    numbers = firsts.withColumn("_k", F.row_number().over(order))
    keys = [book, "_base", "_ending", "sha256"]
    tail = F.when(F.col("_k") == 1, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("_k").cast("string")))
    return based.join(numbers.select(*keys, "_k"), keys).withColumn("name", F.concat("_base", tail, "_ending")).drop("_base", "_ending", "_k")


def export_markdown(files: DataFrame, book: Column) -> tuple[DataFrame, DataFrame]:
    """Volumes (path, content) of books as Markdown: documents (book, path, doc_pos, markdown) and images (book, name, sha256, content).

    Documents are rows of their own, so neither a book nor a volume is put together; their order is (path, doc_pos). Images are
    named over all volumes of a book, each content once under a name (``image_names``), and documents refer to them below images/; what isn't in the archive keeps its source."""
    images = written(image_names(written(read_images(files), "pictures").select(book.alias("book"), "*")), "images")  # archives are opened once for them
    docs = written(read_documents(files), "documents")
    shown = docs.select("path", "doc_pos", F.explode("sources").alias("image")).join(images.select("path", "image", "name"), ["path", "image"])
    names = shown.groupBy("path", "doc_pos").agg(F.map_from_entries(F.collect_list(F.struct("image", "name"))).alias("names"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for href, html, names in zip(frame.doc_href, frame.html, frame.names):
                known = dict(names) if names is not None else {}
                out.append(H.markdown(html, H.parse_xhtml, lambda s: f"images/{known[x]}" if (x := H.resolve(href, s)) in known else s))
            yield pd.DataFrame({"path": frame.path, "doc_pos": frame.doc_pos, "markdown": out})

    texts = docs.join(names, ["path", "doc_pos"], "left").select("path", "doc_pos", "doc_href", "html", "names").mapInPandas(run, "path string, doc_pos int, markdown string")
    return texts.select(book.alias("book"), "*"), images.groupBy("book", "name", "sha256").agg(F.first("content").alias("content"))


def build(documents: list[tuple[str, str]], title: str = "book", images: dict[str, bytes] | None = None) -> bytes:
    """A small EPUB of (href, XHTML), and images by href."""
    out = io.BytesIO()
    items = "".join(f'<item id="d{i}" href="{h}" media-type="application/xhtml+xml"/>' for i, (h, _) in enumerate(documents))
    refs = "".join(f'<itemref idref="d{i}"/>' for i in range(len(documents)))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), MIME, zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", f'<container xmlns="{_NS["c"]}" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", f'<package xmlns="{_NS["o"]}" version="2.0"><metadata><title>{title}</title></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for href, text in documents:
            z.writestr(f"OEBPS/{href}", text)
        for href, data in sorted((images or {}).items()):
            z.writestr(f"OEBPS/{href}", data)
    return out.getvalue()
