"""Glossaries: scopes, lookups in text, selection, search, upsert, and the surface forms of an entry."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.functions import repair
from quarry.functions import text as T
from quarry.operators.control import numbered
from quarry.sources.shared import written


# What a prompt says of terms without a target.
KEEP = "(keep) - GIU NGUYEN tieng Anh"


def effective(entries: DataFrame, project: str) -> DataFrame:
    """One entry for each term, whatever its case: the project's own before the global one, the latest first."""
    own = entries.where(F.col("scope").isin("global", project))
    best = Window.partitionBy(F.lower("term_en")).orderBy((F.col("scope") == "global").cast("int"), F.desc("updated_at"), "entry_id")
    return own.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


#: Words of the longest term that is looked up by its words; terms that may be broadcast at most.
LONGEST, BROADCAST_TERMS = 8, 200_000


def _pieces(text: Column) -> Column:
    """Words, at even places, and what stands between them."""
    w = T.WORD_CHAR
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), f"^[^{w}]+", ""), F.lit(f"([{w}]+|[^{w}]+)"), 1)


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) and ``terms`` (term_en) to (doc_id, term_en, n) where n > 0: whole words, whatever the case.

    Texts are cut into words once. Runs of as many words as some term has are keys, which meet the terms, and are counted;
    no text is shuffled. Terms that words don't settle are counted by pattern in the texts that hold their first word: those
    that begin or end with another character, that may overlap themselves, or that are very long. Terms without a
    word of letters or digits match nothing; rows that repeat an id add up; a null text holds no term."""
    w = T.WORD_CHAR
    cut = terms.select("term_en").distinct().withColumn("key", F.lower("term_en")).withColumn("p", _pieces(F.col("term_en"))).withColumn("words", F.ceil(F.size("p") / 2).cast("int")).where(F.size("p") > 0)
    plain = F.col("key").rlike(f"^[{w}]") & F.col("key").rlike(f"[{w}]$") & ((F.col("words") == 1) | (F.get("p", F.lit(0)) != F.element_at("p", -1))) & (F.col("words") <= LONGEST)
    # written: the optimiser would try these conditions on every key of every text
    cut = written(cut.select("term_en", "key", "words", F.get("p", F.lit(0)).alias("w"), plain.alias("plain")), "terms")
    settled = cut.where("plain").select("term_en", "key")
    lengths = sorted(r["words"] for r in cut.where("plain").select("words").distinct().collect())  # at most LONGEST numbers
    # element by element: a slice would copy the whole array each time
    runs = lambda n: F.when(F.size("p") >= 2 * n - 1, F.transform(F.sequence(F.lit(0), F.size("p") - (2 * n - 1), F.lit(2)), lambda i: F.concat(*(F.get("p", i + k) for k in range(2 * n - 1)))))
    texts = docs.select("doc_id", F.explode(F.array(_pieces(F.col("text")))).alias("p")).where(F.size("p") > 0)  # cut once: a plain column would be cut again in each lambda
    none = F.array().cast("array<string>")
    keys = texts.select("doc_id", F.explode(F.concat(*(F.coalesce(runs(n), none) for n in lengths)) if lengths else none).alias("key"))
    if settled.count() <= BROADCAST_TERMS:
        settled = F.broadcast(settled)
    found = keys.join(settled, "key").groupBy("doc_id", "term_en").agg(F.count("*").cast("int").alias("n"))
    first = cut.where("not plain").select("term_en", "w")
    if first.isEmpty():
        return found
    each = docs.select("doc_id", "text", F.explode(F.array_distinct(F.filter(_pieces(F.col("text")), lambda x, i: i % 2 == 0))).alias("w"))
    met = each.join(first, "w").select("doc_id", "term_en", T.occurrences(F.col("text"), F.col("term_en")).alias("n"))
    return found.unionByName(met.where("n > 0").groupBy("doc_id", "term_en").agg(F.sum("n").cast("int").alias("n")))


def top(entries: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent entries (ties by term), with their place in alphabetical order. The limit is the feature."""
    total = counts.groupBy("term_en").agg(F.sum("n").alias("n"))
    picked = entries.join(total, "term_en").orderBy(F.desc("n"), F.lower("term_en"), "term_en").limit(most)
    return picked.withColumn("place", F.row_number().over(Window.orderBy(F.lower("term_en"), "term_en")))  # at most ``most`` rows


def snippet_line(term: Column, target: Column) -> Column:
    keep = target.isNull() | F.lower(F.trim(target)).isin("", "(keep)")
    return F.concat(F.lit("| "), term, F.lit(" | "), F.when(keep, F.lit(KEEP)).otherwise(target), F.lit(" |"))


def snippet(chosen: DataFrame) -> DataFrame:
    """One Markdown table of the chosen entries, in their order; no row without entries. ``chosen`` is bounded by a limit."""
    lines = F.array_sort(F.collect_list(F.struct("place", snippet_line(F.col("term_en"), F.col("term_vi")).alias("line"))))
    return chosen.agg(lines.alias("l")).where(F.size("l") > 0).select(F.concat_ws("\n", F.lit("| EN | VI |"), F.lit("|---|---|"), F.col("l.line")).alias("snippet"))


def search(entries: DataFrame, query: str) -> DataFrame:
    """Entries whose term or target contains the query literally, whatever the case of ASCII letters."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = F.lit("".join(c.lower() if c.isascii() else c for c in query))
    return entries.where(F.contains(low(F.col("term_en")), wanted) | F.coalesce(F.contains(low(F.col("term_vi")), wanted), F.lit(False)))


def upsert(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """``entries`` (term_en, term_vi) after the import of ``rows`` (pos, term_en, term_vi): the last row of a term wins, blank terms are skipped."""
    clean = rows.withColumn("term_en", F.trim("term_en")).where("term_en != ''").withColumn("key", F.lower("term_en"))
    new = clean.groupBy("key").agg(F.max_by(F.struct("term_en", "term_vi"), "pos").alias("new"), F.min_by("term_en", "pos").alias("first"))
    old = entries.withColumn("key", F.lower("term_en")).select("key", F.col("term_en").alias("old_en"), F.col("term_vi").alias("old_vi"))
    both = old.join(new, "key", "full")
    return both.select(
        F.coalesce("old_en", "first").alias("term_en"), F.when(F.col("new").isNotNull(), F.col("new.term_vi")).otherwise(F.col("old_vi")).alias("term_vi"),
        F.when(F.col("new").isNull(), "kept").when(F.col("old_en").isNull(), "imported").otherwise("updated").alias("action"),
    )


# Endings that are taken off, the least length of such a word, what is put in their place.
_ENDINGS = [("ing", 6, ("", "e")), ("ed", 5, ("", "e")), ("ies", 5, ("y",)), ("es", 5, ("",)), ("s", 4, ("",))]
_VOWELS = "aeiou"


def _stems(word: str) -> set[str]:
    out = {word}
    for ending, least, puts in _ENDINGS:
        if not word.endswith(ending) or len(word) < least or (ending == "s" and word.endswith("ss")):
            continue
        stem = word[: -len(ending)]
        out.update(stem + put for put in puts)
        if "e" in puts and len(stem) >= 4 and stem[-1] == stem[-2] not in _VOWELS:
            out.add(stem[:-1])  # the consonant was doubled
    return {s for s in out if len(s) >= 3}


def _inflected(stem: str) -> set[str]:
    out = {stem, stem + "s", stem + "es"}
    if stem[-1] == "y" and len(stem) > 3 and stem[-2] not in _VOWELS + "y":
        out.add(stem[:-1] + "ies")
    bases = [stem[:-1] if stem[-1] == "e" else stem]
    if stem[-1] not in _VOWELS + "wxy" and stem[-2] in _VOWELS:
        bases.append(stem + stem[-1])
    return out | {base + ending for base in bases for ending in ("ing", "ed")}


def _variants(word: str) -> set[str]:
    """Inflections of a word and of the stems it may have come from; very short words stay alone."""
    return {word} if len(word) < 3 else set().union(*map(_inflected, _stems(word)))


def forms_of(term: str) -> list[str]:
    """Normalised surface forms of a glossary term: alternatives cut at slashes, with and without what is in parentheses."""
    out: set[str] = set()
    for part in term.split("/"):
        inner = re.search(r"\(([^)]*)\)", part)
        for piece in [re.sub(r"\([^)]*\)", "", part), inner.group(1) if inner else ""]:
            key = " ".join(unicodedata.normalize("NFKC", piece).replace("’", "'").replace("‘", "'").split()).lower()
            *head, last = key.split(" ")
            out |= {" ".join([*head, v]) for v in _variants(last)} if last else set()
            out |= {key} if head else set()  # a phrase also stands for itself
    return sorted(out)


@F.pandas_udf(ArrayType(StringType()))
def forms(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: [] if t is None else forms_of(t))


#: Terms that one request asks translations for, at most.
ASKED = 40


def term_batches(terms: DataFrame, key: list[str], order: list[str], size: int = ASKED) -> DataFrame:
    """``terms`` with the number (``batch``, from 0) of the request that asks for them: so many in order a request, in ranges of key and order."""
    return numbered(terms, key, order).withColumn("batch", F.call_function("div", F.col("pos") - 1, F.lit(size)))


def suggested(terms: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """``terms`` (key, batch, term, ...) with the translation that the response to their batch (key, batch, raw, cost) gives, and their share of its cost.

    A response is a JSON object, or any text that holds pairs (``repair.pairs``). A term is found under its own spelling, else under the first
    that differs in case only; one that isn't found, or whose batch has no response, has no translation. The terms of a batch share its cost evenly."""
    at = [*key, "batch"]
    found = responses.select(*at, F.posexplode(repair.pairs("raw")).alias("_place", "_key", "_value"))
    exact = found.select(*at, F.col("_key").alias("term"), F.col("_value").alias("_exact"))
    loose = found.groupBy(*at, F.lower("_key").alias("_low")).agg(F.min_by("_value", "_place").alias("_loose"))
    sizes = terms.groupBy(*at).agg(F.count("*").alias("_n"))
    shares = responses.select(*at, "cost").join(sizes, at).select(*at, (F.col("cost") / F.col("_n")).alias("cost_usd"))
    both = terms.withColumn("_low", F.lower("term")).join(exact, [*at, "term"], "left").join(loose, [*at, "_low"], "left").join(shares, at, "left")
    return both.withColumn("translation", F.coalesce("_exact", "_loose")).drop("_low", "_exact", "_loose")
