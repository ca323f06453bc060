"""Queries on text: language, quality, copyright, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon as L
from quarry.functions import text as T
from quarry.operators import quality, terms
from quarry.sources.shared import written
from quarry.sources.tables import books, table, texts
from quarry.streaming.state import refresh_terms


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


EN, FR = _sql_list(sorted(set(L.EN_FUNCTION_WORDS))), _sql_list(sorted(set(L.FR_FUNCTION_WORDS)))


def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    return quality.detect_language(texts(spark, sf), ["doc_id"])


def language_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return quality.detect_language(texts(spark, sf), ["source", "lang"])


def _language_sql(keys: str, group: bool) -> str:
    counts = f"""SELECT {keys}, len(t) AS n, len(list_filter(t, lambda x: list_contains({EN}, x))) AS en,
      len(list_filter(t, lambda x: list_contains({FR}, x))) AS fr
      FROM (SELECT {keys}, regexp_extract_all(lower(text), '{T.WORD}') AS t FROM documents)"""
    if group:
        counts = f"SELECT {keys}, sum(n)::BIGINT AS n, sum(en)::BIGINT AS en, sum(fr)::BIGINT AS fr FROM ({counts}) GROUP BY {keys}"
    return f"""
    SELECT {keys}, n AS token_count, round(es, 9) AS en_share, round(fs, 9) AS fr_share,
      CASE WHEN n >= 500 AND greatest(es, fs) >= 0.05 AND (least(es, fs) = 0 OR greatest(es, fs) / least(es, fs) >= 3.0)
           THEN CASE WHEN es >= fs THEN 'en' ELSE 'fr' END END AS lang_detected
    FROM (SELECT *, en / nullif(n, 0) AS es, fr / nullif(n, 0) AS fs FROM ({counts}))"""


def diacritic_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.diacritics(texts(spark, sf))


def strip_markup_lengths(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.length(T.tags_to_spaces(html)).alias("with_spaces"), F.length(T.without_tags(html)).alias("without"))


def unit_hint_filter(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    return texts(spark, sf).where(F.exists(F.array(*map(F.lit, L.UNIT_HINTS)), lambda u: F.contains(low, u))).select("doc_id")


def ocr_warning(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 11 > 0, (F.col("o_orderkey") % 1000) / 1000).alias("confidence"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 7).alias("dropped")
    )
    return quality.ocr_warning(jobs, 0.6)


def copyright_score(spark: SparkSession, sf: str) -> DataFrame:
    return quality.copyright_pages(books(spark, sf, None))


def copyright_scan(spark: SparkSession, sf: str) -> DataFrame:
    return quality.copyright_scan(books(spark, sf, None))


def copyright_prune(spark: SparkSession, sf: str) -> DataFrame:
    pages = books(spark, sf, None)
    gone = quality.copyright_scan(pages).where("removed")
    return pages.join(gone, ["book", "doc_pos"], "left_anti").groupBy("book").agg(F.count("*").alias("pages_left"), F.min("doc_pos").alias("first_page"), F.max("doc_pos").alias("last_page"))


_W = "A-Za-z0-9_À-ÖØ-öø-ÿ"
_PAGES_SQL = f"""
  SELECT book, doc_pos, words, score, score >= 5 AND words BETWEEN 5 AND 600 AS is_copyright FROM (
    SELECT book, doc_pos, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END::INT AS words,
      (2 * len(list_filter({_sql_list(L.STRONG_CUES)}, lambda k: contains(p, k)))
       + CASE WHEN regexp_matches(p, 'copyright\\s*©|©\\s*\\d{{4}}|copyright\\s+\\d{{4}}|©\\s*[{_W}]+.{{0,40}}\\d{{4}}') THEN 2 ELSE 0 END
       + len(list_filter({_sql_list(L.WEAK_CUES)}, lambda k: contains(p, k))))::INT AS score
    FROM (SELECT source AS book, doc_id AS doc_pos, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS p FROM documents))"""
_SCAN_SQL = f"""
  SELECT book, doc_pos, score, words, is_copyright,
    CASE WHEN hits > 3 THEN 'too_many_candidates' WHEN hits = n_pages THEN 'would_remove_all_pages' END AS aborted_reason,
    is_copyright AND hits <= 3 AND hits <> n_pages AS removed
  FROM (SELECT *, count(*) FILTER (WHERE is_copyright) OVER (PARTITION BY book) AS hits FROM (
    SELECT *, row_number() OVER (PARTITION BY book ORDER BY doc_pos) AS rn, count(*) OVER (PARTITION BY book) AS n_pages FROM ({_PAGES_SQL}))
    WHERE rn <= 10 OR rn > n_pages - 5)"""

# ---------------------------------------------------------------- terms

#: A small glossary of words that the documents have; its forms are known terms.
GLOSSARY = ["thnt", "thon", "with reth", "anator", "erer", "stnt", "hehe"]


def _forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g,) for g in GLOSSARY], "form string")


def tokenize_segments(spark: SparkSession, sf: str) -> DataFrame:
    segs = terms.segments(books(spark, sf))
    return segs.groupBy("book", "doc_pos").agg(F.count("*").alias("segments"), F.sum(F.size("toks")).cast("long").alias("tokens"), F.max(F.size("toks")).alias("longest"))


def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    stats = terms.counts(books(spark, sf)).where("n > 0")
    return stats.select("book", "n", "key", "surface", "cnt", "cap", F.col("first.doc_pos").alias("first_doc"))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return terms.kept(terms.frequent(books(spark, sf), _forms(spark)), _forms(spark))


def term_absorption(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf).select("book", "n", "key", "cnt")


def term_noise_flags(spark: SparkSession, sf: str) -> DataFrame:
    return terms.flagged(_kept(spark, sf)).select("book", "n", "key", F.concat_ws(",", "flags").alias("noise_flags"))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return terms.merged(terms.flagged(_kept(spark, sf)))


def term_plural_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select("book", "n", "key", "surface", "cnt", F.concat_ws(",", "flags").alias("noise_flags"))


def term_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The 20,000 best of each book, as the SQL has it."""
    return terms.mine(books(spark, sf), _forms(spark), cap=20_000)


def term_rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of each book; the limit is the feature."""
    return terms.mine(books(spark, sf), _forms(spark), cap=10).select("book", "match_key", "rank_score", "place")


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    """A list of common words: those of the benchmark, at a made-up rank."""
    low = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    return low.select("word", ((F.ascii("word") * 1000 + F.length("word") * 137) % 60_000 + 1).alias("freq_rank"))


def term_specificity(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of each book where a list of word ranks lowers common words; the limit is the feature."""
    return terms.mine(books(spark, sf), _forms(spark), cap=10, ranks=_ranks(spark, sf)).select("book", "match_key", "rank_score", "place")


def term_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """New candidates, all of them and so unranked, replace pending ones; terms that a user decided on (here: a third of one-word terms) stay as they are."""
    found = written(_merged(spark, sf).select("book", F.col("key").alias("term"), F.col("cnt").alias("occurrences")), "found")  # read three times
    decided = found.where(F.crc32(F.col("term").cast("binary")) % 3 == 0).where(~F.contains("term", F.lit(" "))).select("book", "term", F.lit("dismissed").alias("status"), F.lit(0).cast("long").alias("occurrences"))
    fresh = found.join(decided, ["book", "term"], "left_anti").select("book", "term", F.lit("pending").alias("status"), "occurrences")
    return decided.unionByName(fresh)


def extract_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to mine books again, some of them for books that have no source: how many pending terms the new run wrote beside the decided ones."""
    found = written(term_candidates(spark, sf).select("book", F.col("match_key").alias("term"), F.col("occurrences").alias("n")), "found")
    decided = found.where((F.length("term") % 3 == 0) & ~F.contains("term", F.lit(" "))).select("book", "term", F.lit("dismissed").alias("status"), "n")
    terms_ = refresh_terms(decided, found).groupBy("book").agg(F.count_if(F.col("status") == "pending").alias("written"))
    asked = table(spark, sf, "documents").select(F.col("source").alias("book")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("book"))).distinct()
    sources = books(spark, sf).select("book").distinct().withColumn("has", F.lit(True))
    out = asked.join(sources, "book", "left").join(terms_, "book", "left")
    return out.select("book", F.when(F.col("has"), "done").otherwise("no_source").alias("result"), F.coalesce("written", F.lit(0)).alias("written"))


_TOKEN = "[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'']*(?:-[A-Za-zÀ-ÿ'']+)*"
_END = T.SEGMENT_END.replace("'", "''")
_TERMS_SQL = f"""
WITH src AS MATERIALIZED (SELECT source AS book, doc_id AS doc_pos,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '<[^>]+>', ' ', 'g'),
      '(?m)^#{{1,6}}[ \\t]*', '', 'g'), '[‘’]', '''', 'g'), '(^|[^{_W}])(ffi|ffl|ff|[A-Za-z]*fi|[A-Za-z]*fl)[ \\t]+([a-z]{{1,20}})\\b', '\\1\\2\\3', 'g'),
      '([a-z])-[ \\t]*\\n[ \\t]*([a-z])', '\\1\\2', 'g') AS norm FROM documents WHERE lang = 'en'),
seg0 AS (SELECT book, doc_pos, string_split_regex(norm, '{_END}') AS parts FROM src),
seg AS (SELECT book, doc_pos, unnest(range(len(parts))) AS seg_pos, regexp_extract_all(unnest(parts), '{_TOKEN}') AS toks FROM seg0),
segs AS MATERIALIZED (SELECT * FROM seg WHERE len(toks) > 0),
tok AS (SELECT book, doc_pos, seg_pos, toks, unnest(range(len(toks))) AS tok_pos FROM segs),
t AS (SELECT book, doc_pos, seg_pos, tok_pos, CASE WHEN tok_pos >= 2 THEN toks[tok_pos - 1] END AS b2, CASE WHEN tok_pos >= 1 THEN toks[tok_pos] END AS b1,
    toks[tok_pos + 1] AS s0, toks[tok_pos + 2] AS s1, toks[tok_pos + 3] AS s2 FROM tok),
fw AS (SELECT unnest({EN}) AS w),
l AS (SELECT *, lower(b2) AS lb2, lower(b1) AS lb1, lower(s0) AS l0, lower(s1) AS l1, lower(s2) AS l2,
    list_contains({EN}, lower(b2)) AS fb2, list_contains({EN}, lower(b1)) AS fb1, list_contains({EN}, lower(s0)) AS f0, list_contains({EN}, lower(s1)) AS f1, list_contains({EN}, lower(s2)) AS f2 FROM t),
k AS MATERIALIZED (SELECT *, CASE WHEN NOT f0 AND length(l0) >= 3 THEN l0 END AS one,
    CASE WHEN NOT f0 AND NOT f1 AND length(l0) + length(l1) >= 3 THEN l0 || ' ' || l1 END AS two,
    CASE WHEN NOT fb1 AND NOT f0 AND length(lb1) + length(l0) >= 3 THEN lb1 || ' ' || l0 END AS two_b,
    CASE WHEN NOT f0 AND NOT f2 AND length(l0) + length(l1) + length(l2) >= 3 THEN l0 || ' ' || l1 || ' ' || l2 END AS three,
    CASE WHEN NOT fb1 AND NOT f1 AND length(lb1) + length(l0) + length(l1) >= 3 THEN lb1 || ' ' || l0 || ' ' || l1 END AS three_b,
    CASE WHEN NOT fb2 AND NOT f0 AND length(lb2) + length(lb1) + length(l0) >= 3 THEN lb2 || ' ' || lb1 || ' ' || l0 END AS three_bb FROM l),
g AS (
  SELECT book, doc_pos, seg_pos, tok_pos, 1 AS n, one AS key, s0 AS surface, (tok_pos > 0 AND regexp_matches(s0, '^[A-ZÀ-ÖØ-Þ]'))::INT AS cap FROM k WHERE one IS NOT NULL
  UNION ALL SELECT book, doc_pos, seg_pos, tok_pos, 2, two, s0 || ' ' || s1, (tok_pos > 0 AND regexp_matches(s0, '^[A-ZÀ-ÖØ-Þ]') AND regexp_matches(s1, '^[A-ZÀ-ÖØ-Þ]'))::INT FROM k WHERE two IS NOT NULL
  UNION ALL SELECT book, doc_pos, seg_pos, tok_pos, 3, three, s0 || ' ' || s1 || ' ' || s2, (tok_pos > 0 AND regexp_matches(s0, '^[A-ZÀ-ÖØ-Þ]') AND regexp_matches(s1, '^[A-ZÀ-ÖØ-Þ]') AND regexp_matches(s2, '^[A-ZÀ-ÖØ-Þ]'))::INT FROM k WHERE three IS NOT NULL),
bys AS (SELECT book, n, key, surface, count(*) AS cnt, sum(cap) AS cap, min(doc_pos * 1000000000000 + seg_pos * 1000000 + tok_pos) AS first FROM g GROUP BY ALL),
st AS MATERIALIZED (SELECT book, n, key, first(surface ORDER BY cnt DESC, first) AS surface, sum(cnt)::BIGINT AS cnt, sum(cap)::BIGINT AS cap, min(first) AS first FROM bys GROUP BY book, n, key),
fl AS MATERIALIZED (SELECT book, CASE WHEN sum(len(toks)) >= 50000 THEN 3 ELSE 2 END AS floor FROM segs GROUP BY book),
pr AS MATERIALIZED (SELECT book, short, long, count(*) AS hits FROM (
    SELECT book, one AS short, two AS long FROM k UNION ALL SELECT book, one, two_b FROM k UNION ALL SELECT book, one, three FROM k UNION ALL SELECT book, one, three_b FROM k
    UNION ALL SELECT book, one, three_bb FROM k UNION ALL SELECT book, two, three FROM k UNION ALL SELECT book, two, three_b FROM k) WHERE short IS NOT NULL AND long IS NOT NULL GROUP BY ALL),
rated AS MATERIALIZED (SELECT st.*, floor, list_contains({_sql_list(GLOSSARY)}, key) AS known FROM st JOIN fl USING (book)),
best AS MATERIALIZED (SELECT pr.book, short AS key, max(hits) AS best FROM pr JOIN rated r ON r.book = pr.book AND r.key = pr.long AND (r.cnt >= r.floor OR r.known) GROUP BY ALL),
kept AS MATERIALIZED (SELECT r.* FROM rated r LEFT JOIN best b ON b.book = r.book AND b.key = r.key
    WHERE r.cnt >= floor AND NOT known AND (n = 3 OR coalesce(best, 0) / r.cnt < 0.8)),
flagged AS (SELECT *, list_filter([CASE WHEN regexp_matches(surface, '-( |$)') THEN 'fragment_suspect' END,
    CASE WHEN (n = 1 AND surface = upper(surface) AND regexp_matches(surface, '[A-Za-zÀ-ÖØ-öø-ÿ]') AND length(surface) >= 2) OR (cnt >= 3 AND cap / cnt >= 0.8) THEN 'proper_noun' END,
    CASE WHEN n = 3 AND list_contains({EN}, string_split(key, ' ')[2]) AND NOT list_contains({_sql_list(L.MIDDLE_EXEMPT)}, string_split(key, ' ')[2]) THEN 'stopword_middle' END],
    lambda x: x IS NOT NULL) AS flags FROM kept),
mk AS (SELECT *, array_to_string(list_append(list_slice(string_split(key, ' '), 1, n - 1),
    CASE WHEN lw LIKE '%ies' AND length(lw) > 5 THEN lw[:length(lw) - 3] || 'y' WHEN lw LIKE '%s' AND lw NOT LIKE '%ss' AND length(lw) > 3 THEN lw[:length(lw) - 1] ELSE lw END), ' ') AS merge_key
    FROM (SELECT *, string_split(key, ' ')[-1] AS lw FROM flagged)),
grp AS (SELECT book, n, merge_key, list({{'key': key, 'surface': surface, 'cnt': cnt, 'flags': flags}} ORDER BY first, key) AS m FROM mk GROUP BY ALL),
fold AS (SELECT book, n, list_reduce(m, lambda a, b: {{'key': CASE WHEN a.cnt >= b.cnt THEN a.key ELSE b.key END, 'surface': CASE WHEN a.cnt >= b.cnt THEN a.surface ELSE b.surface END,
    'cnt': a.cnt + b.cnt, 'flags': list_sort(list_distinct(list_append(list_concat(a.flags, b.flags), 'plural_merged')))}}) AS f FROM grp),
merged AS (SELECT book, n, f.key AS key, f.surface AS surface, f.cnt AS cnt, array_to_string(list_sort(f.flags), ',') AS noise_flags FROM fold),
scored AS (SELECT *, round(ln(1 + cnt) * (1 + 0.5::DOUBLE * (n - 1)) * CASE WHEN noise_flags <> '' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM merged),
ranked AS (SELECT book, surface AS term, key AS match_key, n AS ngram_size, noise_flags, cnt AS occurrences, score AS rank_score,
    row_number() OVER (PARTITION BY book ORDER BY score DESC, key) AS place FROM scored)
"""

QUERIES = {f.__name__: f for f in (
    language_detect, language_by_source, diacritic_quality, strip_markup_lengths, unit_hint_filter, ocr_warning, copyright_score, copyright_scan, copyright_prune,
    tokenize_segments, ngram_counts, term_absorption, term_noise_flags, term_plural_merge, term_candidates, term_rank_topk, term_specificity, term_refresh, extract_terms,
)}

SQL = {
    "language_detect": _language_sql("doc_id", False),
    "language_by_source": _language_sql("source, lang", True),
    "diacritic_quality": f"""
      SELECT doc_id, letters, round(ratio, 9) AS ratio, letters >= 200 AND ratio < 0.08 AS bad_request, letters >= 40 AND ratio < 0.02 AS bad_unit
      FROM (SELECT doc_id, letters, CASE WHEN letters = 0 THEN 0 ELSE marked / letters END AS ratio FROM (
        SELECT doc_id, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, len(regexp_extract_all(t, '[{L.VIETNAMESE}]')) AS marked
        FROM (SELECT doc_id, lower(nfc_normalize(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'))) AS t FROM documents)))""",
    "strip_markup_lengths": "SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS with_spaces, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS without FROM pages",
    "unit_hint_filter": f"SELECT doc_id FROM documents WHERE len(list_filter({_sql_list(L.UNIT_HINTS)}, lambda u: contains(lower(text), u))) > 0",
    "ocr_warning": """
      SELECT job_id, CASE WHEN confidence < 0.6 THEN 'Low OCR quality (' || round_even(confidence * 100, 0)::INT || '%). ' || coalesce(dropped, 0) ||
        ' unreadable regions were skipped; the translation may be inaccurate.' END AS warning
      FROM (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 1000) / 1000 END AS confidence, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 7 END AS dropped FROM orders)""",
    "copyright_score": f"SELECT book, doc_pos, score, words, is_copyright FROM ({_PAGES_SQL})",
    "copyright_scan": _SCAN_SQL,
    "copyright_prune": f"""
      SELECT source AS book, count(*) AS pages_left, min(doc_id) AS first_page, max(doc_id) AS last_page FROM documents
      WHERE (source, doc_id) NOT IN (SELECT book, doc_pos FROM ({_SCAN_SQL}) WHERE removed) GROUP BY source""",
    "tokenize_segments": _TERMS_SQL + "SELECT book, doc_pos, count(*) AS segments, sum(len(toks))::BIGINT AS tokens, max(len(toks)) AS longest FROM segs GROUP BY ALL",
    "ngram_counts": _TERMS_SQL + "SELECT book, n, key, surface, cnt, cap, first // 1000000000000 AS first_doc FROM st",
    "term_absorption": _TERMS_SQL + "SELECT book, n, key, cnt FROM kept",
    "term_noise_flags": _TERMS_SQL + "SELECT book, n, key, array_to_string(flags, ',') AS noise_flags FROM flagged",
    "term_plural_merge": _TERMS_SQL + "SELECT book, n, key, surface, cnt, noise_flags FROM merged",
    "extract_terms": _TERMS_SQL + """, w AS (SELECT book, count(*) FILTER (WHERE length(match_key) % 3 <> 0 OR contains(match_key, ' ')) AS written FROM ranked WHERE place <= 20000 GROUP BY book),
      a AS (SELECT DISTINCT source AS book, lang = 'en' AS en FROM documents UNION ALL SELECT r_name, false FROM region)
      SELECT a.book, CASE WHEN bool_or(coalesce(en, false)) THEN 'done' ELSE 'no_source' END AS result, coalesce(any_value(written), 0) AS written FROM a LEFT JOIN w USING (book) GROUP BY a.book""",
    "term_candidates": _TERMS_SQL + "SELECT * FROM ranked WHERE place <= 20000",
    "term_specificity": _TERMS_SQL + """, rr AS (SELECT DISTINCT word, (ascii(word) * 1000 + length(word) * 137) % 60000 + 1 AS r FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)),
      cw AS (SELECT book, n, key, min(r) AS common FROM (SELECT book, n, key, unnest(string_split(key, ' ')) AS word FROM merged) JOIN rr USING (word) GROUP BY ALL),
      sp AS (SELECT m.book, m.key, round(ln(1 + m.cnt) * (1 + 0.5::DOUBLE * (m.n - 1)) * least(1.0::DOUBLE, coalesce(common / 50000.0::DOUBLE, 1.0::DOUBLE)) * CASE WHEN m.noise_flags <> '' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score
        FROM merged m LEFT JOIN cw ON cw.book = m.book AND cw.n = m.n AND cw.key = m.key)
      SELECT book, key AS match_key, score AS rank_score, place FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY score DESC, key) AS place FROM sp) WHERE place <= 10""",
    "term_rank_topk": _TERMS_SQL + "SELECT book, match_key, rank_score, place FROM ranked WHERE place <= 10",
}
