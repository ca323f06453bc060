"""Queries on glossaries. The glossary is made of the first words of benchmark items, so that documents hold some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import glossary
from quarry.sources.tables import table, texts


_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _upper(text: Column) -> Column:
    return F.translate(text, _SMALL, _LARGE)  # ASCII only: engines differ on ß


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select("item_id", F.split(F.regexp_replace("text", "[.,\\n]+", " "), " +").alias("w"))
    two = b.select(F.col("item_id").alias("entry_id"), F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("term_en"))
    one = b.select((F.col("item_id") + 1_000_000).alias("entry_id"), F.lower(F.get("w", F.lit(2))).alias("term_en"))
    again = b.where("item_id % 4 = 0").select((F.col("item_id") + 2_000_000).alias("entry_id"), _upper(F.get("w", F.lit(2))).alias("term_en"))
    e = two.unionByName(one).unionByName(again)
    scope = F.when(F.col("entry_id") >= 2_000_000, "project:1").when(F.col("entry_id") % 5 == 1, "project:2").otherwise("global")
    target = F.when(F.col("entry_id") % 3 == 0, F.lit(None)).when(F.col("entry_id") % 3 == 1, "(keep)").otherwise(F.concat(F.lit("vi-"), F.col("entry_id").cast("string")))
    return e.select("entry_id", scope.alias("scope"), "term_en", target.alias("term_vi"), (F.col("entry_id") % 17).alias("updated_at"))


_W3 = "string_split_regex(regexp_replace(text, '[.,\\n]+', ' ', 'g'), ' +')"
_E = f"""(SELECT entry_id, CASE WHEN entry_id >= 2000000 THEN 'project:1' WHEN entry_id % 5 = 1 THEN 'project:2' ELSE 'global' END AS scope, term_en,
  CASE entry_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '(keep)' ELSE 'vi-' || entry_id END AS term_vi, entry_id % 17 AS updated_at FROM (
  SELECT item_id AS entry_id, {_W3}[1] || ' ' || {_W3}[2] AS term_en FROM benchmark
  UNION ALL SELECT item_id + 1000000, lower({_W3}[3]) FROM benchmark UNION ALL SELECT item_id + 2000000, translate({_W3}[3], '{_SMALL}', '{_LARGE}') FROM benchmark WHERE item_id % 4 = 0))"""


def glossary_scope_merge(spark, sf):
    return glossary.effective(_entries(spark, sf), "project:1").select("entry_id", "scope", "term_en", "term_vi")


_EFF = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(term_en) ORDER BY CASE WHEN scope = 'global' THEN 1 ELSE 0 END, updated_at DESC, entry_id) AS rn FROM {_E} WHERE scope IN ('global', 'project:1')) WHERE rn = 1)"


def _counts(spark, sf):
    return glossary.occurrences(texts(spark, sf).select("doc_id", "text"), glossary.effective(_entries(spark, sf), "project:1"))


def glossary_occurrences(spark, sf):
    return _counts(spark, sf).select("doc_id", "term_en", F.col("n").cast("long").alias("n"))


# a mark on both sides of each character that is no letter, digit or underscore, and at both ends: a term with its marks is whole words
_MARKED = lambda c: f"chr(1) || regexp_replace(lower({c}), '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g') || chr(1)"
_COUNTS = f"""(SELECT doc_id, term_en, (length(t) - length(replace(t, e, ''))) // length(e) AS n
  FROM (SELECT doc_id, {_MARKED('text')} AS t FROM documents) CROSS JOIN (SELECT term_en, {_MARKED('term_en')} AS e FROM {_EFF}) WHERE contains(t, e))"""


def _top(spark, sf):
    return glossary.top(glossary.effective(_entries(spark, sf), "project:1"), _counts(spark, sf), 15)


def glossary_topn(spark, sf):
    return _top(spark, sf).select("term_en", "n", "place")


def glossary_snippet(spark, sf):
    return glossary.snippet(_top(spark, sf))


_TOP = f"""(SELECT term_en, term_vi, n, row_number() OVER (ORDER BY lower(term_en), term_en) AS place FROM (
  SELECT e.term_en, e.term_vi, c.n FROM {_EFF} e JOIN (SELECT term_en, sum(n)::BIGINT AS n FROM {_COUNTS} GROUP BY term_en) c USING (term_en) ORDER BY n DESC, lower(e.term_en), e.term_en LIMIT 15))"""


def glossary_search(spark, sf):
    return glossary.search(_entries(spark, sf), "TH").select("entry_id", "term_en")


def glossary_entry_count(spark, sf):
    return _entries(spark, sf).groupBy("scope").agg(F.count("*").alias("entries"), F.count_if(F.col("term_vi").isNull()).alias("untranslated"))


def glossary_upsert(spark, sf):
    own = glossary.effective(_entries(spark, sf), "project:1").select("term_en", "term_vi")
    rows = _entries(spark, sf).where("entry_id % 2 = 0").select(F.col("entry_id").alias("pos"), F.concat(F.lit(" "), _upper(F.col("term_en")), F.lit(" ")).alias("term_en"), F.lit("new").alias("term_vi"))
    more = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).otherwise(" ").alias("term_en"), F.col("r_name").alias("term_vi"))
    return glossary.upsert(own, rows.unionByName(more))


_ROWS = f"""(SELECT entry_id AS pos, translate(term_en, '{_SMALL}', '{_LARGE}') AS term_en, 'new' AS term_vi FROM {_E} WHERE entry_id % 2 = 0 UNION ALL
  SELECT r_regionkey, r_name, r_name FROM region WHERE r_regionkey <> 2)"""
_NEW = f"(SELECT lower(term_en) AS key, arg_max(term_vi, pos) AS term_vi, arg_min(term_en, pos) AS term_en FROM {_ROWS} WHERE term_en <> '' GROUP BY 1)"


def glossary_forms(spark, sf):
    return _entries(spark, sf).select("entry_id", F.explode(glossary.forms("term_en")).alias("form"))


def glossary_known_forms(spark, sf):
    """Distinct surface forms of all entries, as term mining excludes them."""
    return glossary_forms(spark, sf).select("form").distinct()


def suggest_translations(spark, sf):
    """Terms in requests of forty, and responses that leave some out, change the case of some, and say more than JSON now and then."""
    p = table(spark, sf, "part").select((F.col("p_size") % 5).alias("book"), F.col("p_partkey").alias("id"), F.col("p_name").alias("term"))
    terms = glossary.term_batches(p, ["book"], ["id"])
    key = F.when(F.col("id") % 4 == 1, F.upper("term")).otherwise(F.col("term"))
    pair = F.when(F.col("id") % 4 > 0, F.concat(F.lit('"'), key, F.lit('": "vi '), F.col("id").cast("string"), F.lit('"')))
    told = terms.groupBy("book", "batch").agg(F.array_sort(F.collect_list(F.struct("id", pair.alias("pair")))).alias("p"), (F.count("*") * 0.002).alias("cost"))
    body = F.concat(F.lit("{"), F.array_join(F.transform("p", lambda x: x["pair"]), ", "), F.lit("}"))
    raw = F.when(F.col("batch") % 3 == 0, F.concat(F.lit("As asked: "), body, F.lit(" - done"))).otherwise(body)
    done = glossary.suggested(terms, told.where("batch % 7 < 6").select("book", "batch", raw.alias("raw"), "cost"), ["book"])
    return done.select("id", "book", "batch", "translation", F.round("cost_usd", 9).alias("cost_usd"))


QUERIES = {f.__name__: f for f in (suggest_translations, glossary_scope_merge, glossary_occurrences, glossary_topn, glossary_snippet, glossary_search, glossary_entry_count, glossary_upsert, glossary_forms, glossary_known_forms)}
SQL = {
    "suggest_translations": """WITH t AS (SELECT p_size % 5 AS book, p_partkey AS id, p_name AS term, (row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) - 1) // 40 AS batch FROM part),
      k AS (SELECT book, batch, CASE WHEN id % 4 = 1 THEN upper(term) ELSE term END AS key, min(id) AS first, 'vi ' || max(id) AS value FROM t WHERE id % 4 > 0 AND batch % 7 < 6 GROUP BY ALL),
      l AS (SELECT book, batch, lower(key) AS low, arg_min(value, first) AS value FROM k GROUP BY ALL)
      SELECT t.id, t.book, t.batch, coalesce(k.value, l.value) AS translation, CASE WHEN t.batch % 7 < 6 THEN 0.002 END::DOUBLE AS cost_usd
      FROM t LEFT JOIN k ON k.book = t.book AND k.batch = t.batch AND k.key = t.term LEFT JOIN l ON l.book = t.book AND l.batch = t.batch AND l.low = lower(t.term)""",
    "glossary_scope_merge": f"SELECT entry_id, scope, term_en, term_vi FROM {_EFF}",
    "glossary_occurrences": f"SELECT * FROM {_COUNTS}",
    "glossary_topn": f"SELECT term_en, n, place FROM {_TOP}",
    "glossary_snippet": f"SELECT '| EN | VI |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || term_en || ' | ' || CASE WHEN term_vi IS NULL OR lower(trim(term_vi)) IN ('', '(keep)') THEN '{glossary.KEEP}' ELSE term_vi END || ' |', chr(10) ORDER BY place) AS snippet FROM {_TOP}",
    "glossary_search": f"SELECT entry_id, term_en FROM {_E} WHERE contains(lower(term_en), 'th') OR contains(lower(coalesce(term_vi, '')), 'th')",
    "glossary_entry_count": f"SELECT scope, count(*) AS entries, count(*) FILTER (WHERE term_vi IS NULL) AS untranslated FROM {_E} GROUP BY scope",
    "glossary_upsert": f"""SELECT coalesce(o.term_en, n.term_en) AS term_en, CASE WHEN n.key IS NULL THEN o.term_vi ELSE n.term_vi END AS term_vi,
      CASE WHEN n.key IS NULL THEN 'kept' WHEN o.term_en IS NULL THEN 'imported' ELSE 'updated' END AS action FROM {_EFF} o FULL JOIN {_NEW} n ON lower(o.term_en) = n.key""",
}
