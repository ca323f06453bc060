"""Writers of results, and checks of what was written."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_findings(findings: DataFrame, path: str) -> None:
    """Append (page, check_type, severity, detail) with the detail as JSON text."""
    detail = F.to_json("detail") if dict(findings.dtypes)["detail"].startswith(("struct", "map")) else F.col("detail")
    findings.withColumn("detail", detail).write.mode("append").parquet(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """One folder of JSON lines for each job and chunk; rows of a chunk stay together."""
    requests.repartition("job_id", "chunk_index").write.mode("append").partitionBy("job_id", "chunk_index").json(path)


def export_glossary(entries: DataFrame, path: str) -> None:
    """One CSV file in order of terms."""
    entries.orderBy(F.lower("term_en"), "term_en").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def download_name(stem: Column, kind: Column, done: Column, ending: Column) -> Column:
    return F.concat(stem, F.lit("_"), kind, F.lit("_"), F.date_format(done, "yyyyMMdd-HHmmss"), ending)


def parse_zip_problem(content: bytes, images: int) -> str | None:
    """What is wrong with a parse result: a broken archive, no document, or not as many images as declared."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        if archive.testzip():
            return "corrupt"
    except zipfile.BadZipFile:
        return "corrupt"
    names = archive.namelist()
    if "document.md" not in names:
        return "no document"
    return None if sum(n.startswith("images/") and not n.endswith("/") for n in names) == images else "images"


def parse_zip(document: str, images: dict[str, bytes]) -> bytes:
    """A parse result as one archive: the text as ``document.md``, images below ``images/``, in order of names."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("document.md", document)
        for name in sorted(images):
            archive.writestr(f"images/{name}", images[name])
    return out.getvalue()
