"""Files of books as Spark data sources: a sink that commits whole files, and readers of EPUBs, glossaries and drop reports.

``register(spark)`` makes the formats known:

- ``quarry_files`` (write): rows (path, content) become files below the folder given to ``save``. Tasks write under temporary names and check what
  they wrote; only when all tasks are done are the files renamed, one by one, each as a whole. A task that fails leaves nothing, nor does a job.
- ``quarry_epub``, ``quarry_glossary``, ``quarry_drop_report`` (read): rows of all files below a folder, several small files or one large one
  a task. Filters on the path (equal, in, begins with) choose files before any is opened.

Files are reached by Arrow's file systems; for a store that only Spark reads, ``binaryFile`` and the functions of ``epub`` and ``xlsx`` serve.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import html as H
from quarry.sources import epub, sinks, xlsx

#: Bytes of small files that one task reads; parsing, not reading, takes the time.
TASK_BYTES = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":/" in path else f"file://{posixpath.abspath(path)}")


# ---------------------------------------------------------------- sink


def _sound(kind: str, content: bytes, images: int | None) -> str | None:
    """What is wrong with a file of a kind (epub, parse or any); null if nothing is."""
    if kind == "parse":
        return sinks.parse_zip_problem(content, images or 0)
    if kind == "epub":
        try:
            archive = epub.opened(content)
            hrefs = epub.spine(archive)[1]
            if archive.testzip():
                return "corrupt"
            return next((f"not well-formed: {h}" for h in hrefs if not H.well_formed(epub._document(archive, h))), None)
        except (epub.EpubError, zipfile.BadZipFile) as e:
            return str(e)
    return None


@dataclass
class _Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary and final name


class _FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, kind: str, overwrite: bool) -> None:
        self.folder, self.kind, self.overwrite = folder, kind, overwrite
        self.stage = f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, stage = opened(self.stage)
        own, done = f"{stage}/{uuid.uuid4().hex}", []  # an attempt that runs beside another has its own folder
        store.create_dir(own)
        for batch in iterator:
            images = batch.column("images").to_pylist() if "images" in batch.schema.names else [None] * batch.num_rows
            for path, content, n in zip(batch.column("path").to_pylist(), batch.column("content"), images):
                final = posixpath.normpath(path or "")
                if not path or final.startswith(("/", "..")) or final == ".":
                    raise ValueError(f"not a path below the folder: {path}")
                temporary = f"{own}/{len(done)}"
                with store.open_output_stream(temporary) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                with store.open_input_file(temporary) as written:  # what is there now, not what was meant
                    problem = _sound(self.kind, written.read(), n)
                if problem:
                    raise ValueError(f"{path}: {problem}")
                done.append((temporary, final))
        return _Staged(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.folder)
        files = [f for m in messages if m for f in m.files]
        finals = [final for _, final in files]
        if len(set(finals)) < len(finals):
            raise ValueError(f"written twice: {next(f for f in finals if finals.count(f) > 1)}")
        if not self.overwrite and (there := [i.path for i in store.get_file_info([f"{folder}/{f}" for f in finals]) if i.type != fs.FileType.NotFound]):
            raise ValueError(f"already there: {there[0]}")
        for parent in {posixpath.dirname(f"{folder}/{f}") for f in finals}:
            store.create_dir(parent)
        for temporary, final in files:
            store.move(temporary, f"{folder}/{final}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, stage = opened(self.stage)
        if store.get_file_info(stage).type != fs.FileType.NotFound:
            store.delete_dir(stage)


class FilesSink(DataSource):
    """Option ``kind``: any, epub or parse (with a column images: how many it must hold). Mode append refuses files that are there already."""

    @classmethod
    def name(cls) -> str:
        return "quarry_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _FilesWriter(self.options["path"], self.options.get("kind", "any"), overwrite)


# ---------------------------------------------------------------- readers


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows, schema: StructType, endings: tuple[str, ...]) -> None:
        self.path, self.rows, self.kinds, self.endings, self.wanted = path, rows, to_arrow_schema(schema), endings, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def _asked(self, path: str) -> bool:
        return all(path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In) else path.startswith(f.value) for f in self.wanted)

    def partitions(self) -> list[InputPartition]:
        store, folder = opened(self.path)
        infos = store.get_file_info(fs.FileSelector(folder, recursive=True))
        parts, size = [[]], 0
        for info in sorted(infos, key=lambda i: i.path):
            inner = posixpath.relpath(info.path, folder)
            if info.type == fs.FileType.File and inner.lower().endswith(self.endings) and not any(p.startswith(("_", ".")) for p in inner.split("/")) and self._asked(inner):
                if parts[-1] and size + info.size > TASK_BYTES:
                    parts, size = [*parts, []], 0
                parts[-1].append(inner)
                size += info.size
        return [_Files(p) for p in parts]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, folder = opened(self.path)
        for path in partition.paths:
            with store.open_input_file(f"{folder}/{path}") as f:
                rows = self.rows(path, f)
                while some := [r for r, _ in zip(rows, range(5000))]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), self.kinds.types)], schema=self.kinds)


class _Source(DataSource):
    columns, endings = "", ()

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], type(self).rows, schema, self.endings)


class EpubSource(_Source):
    """Units as ``epub.read_units`` gives them; a file that can't be read is one row with its error."""

    columns, endings = epub.UNITS, (".epub",)

    @classmethod
    def name(cls) -> str:
        return "quarry_epub"

    @staticmethod
    def rows(path: str, f) -> Iterator[tuple]:
        return epub.unit_rows(path, f.read())


class GlossarySource(_Source):
    """Entries of workbooks as ``xlsx.read_glossary`` gives them."""

    columns, endings = xlsx.ENTRIES, (".xlsx",)

    @classmethod
    def name(cls) -> str:
        return "quarry_glossary"

    @staticmethod
    def rows(path: str, f) -> Iterator[tuple]:
        return iter(xlsx.entry_rows(path, f.read()))


class DropReportSource(_Source):
    """Drop reports, line by line as a stream: path, line_no, kind (header, page, drop, other or malformed), page, dropped_count, debug_id. A page
    or drop record without what it must have ends the job, as in ``records.drop_log``."""

    columns, endings = "path string, line_no long, kind string, page int, dropped_count int, debug_id string", (".jsonl",)

    @classmethod
    def name(cls) -> str:
        return "quarry_drop_report"

    @staticmethod
    def rows(path: str, f) -> Iterator[tuple]:
        for k, line in enumerate(io.TextIOWrapper(f, "utf-8", "replace")):
            if not line.strip():
                continue
            try:
                record = json.loads(line)
            except ValueError:
                record = None
            if not isinstance(record, dict):
                yield path, k, "malformed", None, None, None
                continue
            kind = record.get("type")
            kind = kind if kind in ("header", "page", "drop") else "other"
            page, count = (record.get(c) if kind in ("page", "drop") else None for c in ("page_number_1based", "dropped_count"))
            if kind in ("page", "drop") and (not isinstance(page, int) or kind == "page" and not isinstance(count, int)):
                raise ValueError(f"{kind} record without page" + " or count" * (kind == "page") + f": {path}, line {k}")
            yield path, k, kind, page, count, str(record.get("debug_id", "")) if kind == "drop" else None


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let Spark hand filters to readers in Python, which it does not do by itself."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FilesSink, EpubSource, GlossarySource, DropReportSource):
        spark.dataSource.register(source)
