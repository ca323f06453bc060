"""Language, output quality, copyright pages and content filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.functions import text as T


def detect_language(docs: DataFrame, keys: list[str]) -> DataFrame:
    """English or French by shares of function words, of a document or of all texts with the same ``keys``.

    Null text counts no word; a group without words has null shares and no language."""
    toks = docs.select(*keys, T.words(F.col("text")).alias("t"))
    each = toks.select(*keys, F.coalesce(F.size("t"), F.lit(0)).alias("n"), T.hits(F.col("t"), L.EN_FUNCTION_WORDS).alias("en"), T.hits(F.col("t"), L.FR_FUNCTION_WORDS).alias("fr"))
    total = each.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "en", "fr"))) if keys != ["doc_id"] else each
    n = F.nullif(F.col("n"), F.lit(0))
    return total.select(
        *keys, F.col("n").cast("long").alias("token_count"), F.round(F.col("en") / n, 9).alias("en_share"), F.round(F.col("fr") / n, 9).alias("fr_share"),
        F.when(F.col("n") > 0, T.language(n, F.col("en"), F.col("fr"))).alias("lang_detected"),
    )


def diacritics(docs: DataFrame) -> DataFrame:
    """Share of letters with Vietnamese diacritics, and the gates for requests and units."""
    low = docs.select("doc_id", F.lower(T.composed(T.tags_to_spaces(F.col("text")))).alias("t"))
    n = low.select("doc_id", F.coalesce(T.letters(F.col("t")), F.lit(0)).alias("letters"), F.coalesce(T.vietnamese_letters(F.col("t")), F.lit(0)).alias("marked"))
    ratio = F.when(F.col("letters") == 0, 0.0).otherwise(F.col("marked") / F.col("letters"))
    return n.select(
        "doc_id", F.col("letters").cast("long").alias("letters"), F.round(ratio, 9).alias("ratio"),
        ((F.col("letters") >= 200) & (ratio < 0.08)).alias("bad_request"), ((F.col("letters") >= 40) & (ratio < 0.02)).alias("bad_unit"),
    )


def copyright_pages(pages: DataFrame) -> DataFrame:
    """Score, words and verdict of every page (book, doc_pos, text)."""
    page = pages.select("book", "doc_pos", T.squeeze(F.lower(F.coalesce("text", F.lit("")))).alias("p"))
    words = F.when(F.col("p") == "", 0).otherwise(F.size(F.split("p", " ")))
    scored = page.select("book", "doc_pos", T.copyright_score(F.col("p")).alias("score"), words.alias("words"))
    return scored.withColumn("is_copyright", (F.col("score") >= 5) & F.col("words").between(5, 600))


def copyright_scan(pages: DataFrame, head: int = 10, tail: int = 5, most: int = 3) -> DataFrame:
    """Verdicts on the first and last pages of each book, and whether the page goes: never more than ``most`` and never all.

    Places come from two rankings that stop early, so inner pages are dropped before they are scored."""
    up, down = Window.partitionBy("book").orderBy("doc_pos"), Window.partitionBy("book").orderBy(F.desc("doc_pos"))
    places = pages.select("book", "doc_pos")
    edge = places.withColumn("rn", F.row_number().over(up)).where(F.col("rn") <= head).drop("rn")
    edge = edge.unionByName(places.withColumn("rn", F.row_number().over(down)).where(F.col("rn") <= tail).drop("rn")).distinct()
    found = copyright_pages(pages.join(edge, ["book", "doc_pos"], "left_semi"))
    total = pages.groupBy("book").agg(F.count("*").alias("n_pages"))
    book = Window.partitionBy("book")
    hits = F.count_if("is_copyright").over(book)
    out = found.withColumn("hits", hits).join(total, "book")
    reason = F.when(F.col("hits") > most, "too_many_candidates").when(F.col("hits") == F.col("n_pages"), "would_remove_all_pages")
    return out.select("book", "doc_pos", "score", "words", "is_copyright", reason.alias("aborted_reason"), (F.col("is_copyright") & reason.isNull()).alias("removed"))


def ocr_warning(jobs: DataFrame, threshold: float) -> DataFrame:
    """``jobs`` (job_id, confidence, dropped) with a warning, or null when confidence is unknown or good enough."""
    message = F.format_string(
        "Low OCR quality (%s%%). %s unreadable regions were skipped; the translation may be inaccurate.",
        F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.coalesce("dropped", F.lit(0)).cast("string"),
    )
    return jobs.select("job_id", F.when(F.col("confidence") < threshold, message).alias("warning"))
