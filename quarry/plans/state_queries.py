"""Queries on stored state and on files: findings, deletions, suggestions, budgets, books as archives."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import layout, planning
from quarry.plans import glossary_queries, job_queries, layout_queries, text_queries
from quarry.sources import books, epub, sinks
from quarry.sources.shared import scratch, small_batches, until_end, written
from quarry.sources.tables import table


def layout_findings(spark, sf):
    """All box checks of a page as findings with a JSON detail."""
    b = layout_queries._blocks(spark, sf)
    kinds = [("overlap", "critical", layout.overlaps(b)), ("text_over_drawing", "major", layout.over_border(b, layout_queries._blocks(spark, sf, 15))), ("text_over_image", "major", layout.over_image(b, layout_queries._blocks(spark, sf, 40).where("block % 5 = 0")))]
    detail = F.to_json(F.struct("block", F.col("o_block").alias("other"), F.round("ratio", 2).alias("ratio")))
    parts = [d.select("page", F.lit(k).alias("check_type"), F.lit(s).alias("severity"), detail.alias("detail")) for k, s, d in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def delete_cascade(spark, sf):
    """Rows left of each batch after some jobs were deleted: chunks go with their job, findings stay, counters don't fall below 0."""
    jobs = job_queries._jobs(spark, sf)
    asked = jobs.where("job_id % 10 = 3").where(~F.col("status").isin(*job_queries.L.ACTIVE_STATES)).select("job_id", "batch_id", "status")
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    left = chunks.join(asked.select("job_id"), "job_id", "left_anti").join(jobs.select("job_id", "batch_id"), "job_id").groupBy("batch_id").agg(F.count("*").alias("chunks"))
    gone = asked.groupBy("batch_id").agg(F.count("*").alias("deleted"), F.count_if(F.col("status") == "completed").alias("done"))
    counters = jobs.groupBy("batch_id").agg(F.count("*").alias("files"), (F.count_if(F.col("status") == "completed") - 1).alias("completed"))
    out = counters.join(gone, "batch_id", "left").join(left, "batch_id", "left")
    return out.select("batch_id", (F.col("files") - F.coalesce("deleted", F.lit(0))).alias("files"), F.greatest(F.col("completed") - F.coalesce("done", F.lit(0)), F.lit(0)).alias("completed"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def glossary_create(spark, sf):
    """New entries against existing ones: a conflict unless forced, else created."""
    have = glossary_queries._entries(spark, sf).select(F.lower("term_en").alias("key")).distinct()
    new = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("THE").alias("term"), (F.col("p_partkey") % 3 == 0).alias("force"))
    some = table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("p_partkey"), F.lower(F.regexp_extract("text", "^(\\S+ [^ .,\\n]+)", 1)).alias("term"), (F.col("item_id") % 2 == 0).alias("force"))
    both = new.withColumn("p_partkey", F.col("p_partkey").cast("long")).unionByName(some)
    known = both.join(have, F.lower("term") == F.col("key"), "left")
    return known.select("p_partkey", F.when(F.col("key").isNull(), "created").when(F.col("force"), "updated").otherwise("conflict").alias("result"))


def suggested_terms_page(spark, sf):
    """Second page of twenty of all books' terms of two words or more, by count, without noisy ones; the limit is the feature."""
    t = text_queries.term_candidates(spark, sf).where("noise_flags = '' and ngram_size >= 2")
    return t.orderBy(F.desc("occurrences"), "book", "match_key").offset(20).limit(20).select("book", "match_key", "occurrences")


def suggested_terms_sorted(spark, sf):
    """First pages of thirty, noise included, from two words on: by rank and by alphabet; the limit is the feature."""
    t = text_queries.term_candidates(spark, sf).where("ngram_size >= 2")
    pages = []
    for name, order in (("rank", [F.desc("rank_score"), "book", "match_key"]), ("alpha", ["match_key", "book"])):
        pages.append(t.orderBy(*order).limit(30).select(F.lit(name).alias("sort"), "book", "match_key", "rank_score"))
    return pages[0].unionByName(pages[1])


def suggested_terms_promote(spark, sf):
    """The user promotes the best two terms of each book and dismisses the next one: promoted ones enter the project's glossary, unless it has them."""
    t = text_queries.term_candidates(spark, sf).where("place <= 3").select("book", "match_key", "place", F.lower("term").alias("key"))
    have = glossary_queries.glossary.effective(glossary_queries._entries(spark, sf), "project:1").select(F.lower("term_en").alias("key"), F.lit(True).alias("known"))
    done = t.join(have, "key", "left")
    return done.select("book", "match_key", F.when(F.col("place") == 3, "dismissed").otherwise("promoted").alias("status"), ((F.col("place") < 3) & F.col("known").isNull()).alias("entry_created"))


def glossary_edit(spark, sf):
    """Entries after updates and deletions by id; a new term that another entry of the scope has is a conflict, and nothing changes."""
    e = glossary_queries._entries(spark, sf)
    edits = e.where("entry_id % 4 < 2").select("entry_id", (F.col("entry_id") % 4 == 0).alias("drop"), F.when(F.col("entry_id") % 8 == 1, F.lit("THE")).otherwise(F.concat(F.col("term_en"), F.lit("x"))).alias("new_term"))
    taken = e.groupBy("scope", F.lower("term_en").alias("key")).agg(F.min("entry_id").alias("lo"), F.max("entry_id").alias("hi"))
    asked = e.join(edits, "entry_id", "left")
    met = asked.join(taken, (taken["scope"] == asked["scope"]) & (taken["key"] == F.lower("new_term")) & ((taken["lo"] != asked["entry_id"]) | (taken["hi"] != asked["entry_id"])), "left").select(asked["*"], F.col("key").isNotNull().alias("clash"))
    result = F.when(F.col("drop"), "deleted").when(F.col("new_term").isNull(), "kept").when(F.col("clash"), "conflict").otherwise("updated")
    return met.select("entry_id", result.alias("result"), F.when(result == "updated", F.col("new_term")).when(result != "deleted", F.col("term_en")).alias("term_en"))


def suggested_terms_counts(spark, sf):
    t = text_queries.term_candidates(spark, sf)
    return t.groupBy("book").agg(F.count("*").alias("total"), F.count_if(F.col("noise_flags") != "").alias("noise_hidden"), F.count_if((F.col("ngram_size") >= 2) & (F.col("noise_flags") == "")).alias("shown"))


def source_text_choice(spark, sf):
    """Where the text of a job comes from; a scan without its recognised copy is an error."""
    kind = F.get(F.array(*map(F.lit, ["epub", "pdf_digital", "pdf_scan"])), (F.col("o_orderkey") % 3).cast("int"))
    j = table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), F.when(F.col("o_custkey") % 4 == 0, "parse_only").otherwise("translate").alias("job_type"), F.when(F.col("o_custkey") % 5 > 0, F.lit("ocr.pdf")).alias("bridge"))
    choice = F.when(F.col("job_type") == "parse_only", "document.md").when((F.col("kind") == "pdf_scan") & F.col("bridge").isNull(), "error").when(F.col("kind") == "pdf_scan", F.col("bridge")).when(F.col("kind") == "pdf_digital", "file").otherwise("units")
    return j.select("o_orderkey", choice.alias("source"))


def request_cost_cap(spark, sf):
    """Requests that a job still sends: the cap runs over its chunks and, within each, over the requests."""
    r = table(spark, sf, "lineitem").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("cost", F.col("l_extendedprice") / 2)
    kept = planning.running_cap(r, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "part"], "cost", 60_000.0)
    return kept.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("requests"), F.max("l_linenumber").alias("last_chunk"))


def retry_quota(spark, sf):
    """Extra requests of a slice: each missing unit alone if there are at most two, else all once; what is left of three goes to bad units."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("a"), F.count_if(F.col("event_type") == "error").alias("b"))
    m, bad = F.col("a") % 6, F.col("b") % 5
    first = F.when(m <= 2, m).otherwise(1)
    return e.select("user_id", first.alias("for_missing"), F.least(bad, 3 - first).alias("for_bad"))


def settings_upsert(spark, sf):
    have = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    new = table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("key"), F.lit("set").alias("new")).unionByName(table(spark, sf, "region").select(F.concat(F.lit("r-"), "r_name").alias("key"), F.lit("made").alias("new")))
    return have.join(new, "key", "full").select("key", F.coalesce("new", "value").alias("value"))


def _archives(spark, sf):
    """Every book as EPUB volumes of at most 64 documents, by id: documents are chapters, lines are paragraphs.

    A file is one value, so a book of very many documents must be many files; ``_book`` gives the book of a volume's path."""

    def pack(docs: list[dict]) -> tuple[str, bytes]:
        chapters = [(f"d{i}.xhtml", "<html><body>" + "".join(f"<p>{escape(x, quote=False)}</p>" for x in t.split("\n")) + "</body></html>") for i, t in ((d["doc_id"], d["text"]) for d in docs)]
        return f"{docs[0]['source']}/{docs[0]['volume']}", epub.build(chapters)

    small_batches(spark)
    d = table(spark, sf, "documents").select("doc_id", "source", "text", F.floor(F.col("doc_id") / 64).alias("volume"))
    return epub.volumes(d, ["source", "volume"], "doc_id", pack)


def _book(path: str = "path"):
    return F.regexp_replace(path, "/[^/]*$", "")


def epub_units(spark, sf):
    u = epub.read_units(_archives(spark, sf)).where("error is null")
    return u.select(_book().alias("path"), F.regexp_extract("doc_href", "d(\\d+)", 1).cast("long").alias("doc_id"), "ordinal", "text")


def epub_translate(spark, sf):
    """Units of every second document rewritten in the archives and read again."""
    files = written(_archives(spark, sf), "volumes")
    units = epub.read_units(files).where("error is null")
    done = units.where(F.regexp_extract("doc_href", "d(\\d+)", 1).cast("long") % 2 == 0).select("path", F.concat("doc_href", F.lit("#"), F.col("ordinal").cast("string")).alias("unit_id"), F.lit("<b>neu</b> & gut").alias("html"))
    again = epub.read_units(epub.rewrite_all(files, done))
    return again.groupBy(_book().alias("path")).agg(F.count("*").alias("units"), F.count_if(F.col("text") == "neu & gut").alias("changed"))


def _illustrated(spark, sf):
    """Volumes whose documents each show one image; the same name has other content in other documents, and the same content other names."""

    def pack(docs: list[dict]) -> tuple[str, bytes]:
        chapters = [(f"t/d{i}.xhtml", f'<html><body><p><img src="../i{i % 5}/p{i % 7}.jpg" alt="{i}"/> ' + "</p><p>".join(escape(x, quote=False) for x in t.split("\n")) + "</p></body></html>") for i, t in ((d["doc_id"], d["text"]) for d in docs)]
        images = {f"i{i % 5}/p{i % 7}.jpg": f"{i % 5 % 3}-{i % 7}".encode() for i in (d["doc_id"] for d in docs)}
        return f"{docs[0]['source']}/{docs[0]['volume']:09d}", epub.build(chapters, "book", images)

    small_batches(spark)
    d = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / 64).alias("volume"))
    return epub.volumes(d, ["source", "volume"], "doc_id", pack)


def book_markdown(spark, sf):
    """Books of illustrated volumes exported document by document: what each document shows, and how long it is without its image."""
    docs, _ = epub.export_markdown(written(_illustrated(spark, sf), "volumes"), _book())
    first = F.regexp_extract("markdown", r"^!\[(\d+)\]\(images/([^)]*)\)", 1).cast("long")
    shows = F.regexp_extract("markdown", r"^!\[(\d+)\]\(images/([^)]*)\)", 2)
    rest = F.regexp_replace("markdown", r"^!\[\d+\]\([^)]*\)\s*", "")
    return docs.select(F.col("book").alias("source"), first.alias("doc_id"), shows.alias("shows"), F.length(F.regexp_replace(rest, r"\s", "")).alias("chars"))


def committed_epubs(spark, sf):
    """The same rewritten archives as files: written under temporary names, checked, renamed, and read by the reader of EPUBs."""
    books.register(spark)
    files = written(_archives(spark, sf), "volumes")
    units = epub.read_units(files).where("error is null")
    done = units.where(F.regexp_extract("doc_href", "d(\\d+)", 1).cast("long") % 2 == 0).select("path", F.concat("doc_href", F.lit("#"), F.col("ordinal").cast("string")).alias("unit_id"), F.lit("<b>neu</b> & gut").alias("html"))
    folder = scratch(spark, "epubs")
    epub.rewrite_all(files, done).withColumn("path", F.concat("path", F.lit(".epub"))).write.format("quarry_files").option("kind", "epub").mode("append").save(folder)
    until_end(spark, folder)
    again = spark.read.format("quarry_epub").load(folder)
    return again.groupBy(_book().alias("path")).agg(F.count("*").alias("units"), F.count_if(F.col("text") == "neu & gut").alias("changed"))


def parse_archives(spark, sf):
    """Parse results of each book's volumes: a document and its images in an archive that is checked before it counts, and read again."""
    books.register(spark)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        images = {f"{i}.jpg": t[:3].encode() for i, t in zip(part.doc_id, part.text) if i % 3 == 0}
        return pd.DataFrame({"path": [f"{part.source.iloc[0]}/{part.volume.iloc[0]}.zip"], "content": [sinks.parse_zip("\n\n".join(part.text), images)], "images": [len(images)]})

    def unpack(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows.append((path, len(archive.read("document.md").decode()), len(archive.namelist()) - 1))
            yield pd.DataFrame(rows, columns=["path", "chars", "images"])

    d = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / 64).alias("volume"))
    folder = scratch(spark, "parsed")
    d.groupBy("source", "volume").applyInPandas(pack, "path string, content binary, images int").write.format("quarry_files").option("kind", "parse").mode("append").save(folder)
    until_end(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").mapInPandas(unpack, "path string, chars long, images long")
    return files.groupBy(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("source")).agg(F.count("*").alias("volumes"), F.sum("chars").alias("chars"), F.sum("images").alias("images"))


def request_log(spark, sf):
    """Requests of each job and chunk as JSON lines in a folder of their own, read again."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 16).alias("job_id"), F.col("turn").alias("chunk_index"), "role", "text")
    folder = scratch(spark, "requests")
    sinks.write_requests(c, folder)
    until_end(spark, folder)
    back = spark.read.schema("job_id long, chunk_index long, role string, text string").json(folder)
    return back.groupBy("job_id", "chunk_index").agg(F.count("*").alias("requests"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("by_user"))


QUERIES = {f.__name__: f for f in (
    book_markdown, committed_epubs, parse_archives, request_log, layout_findings, delete_cascade, glossary_create, suggested_terms_page, suggested_terms_sorted, suggested_terms_promote, glossary_edit, suggested_terms_counts, source_text_choice, request_cost_cap, retry_quota, settings_upsert, epub_units, epub_translate,
)}

_STATES = ", ".join(f"'{s}'" for s in job_queries.L.ACTIVE_STATES)
_LINES = """(SELECT source AS path, doc_id, ordinal::INT AS ordinal, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS text FROM (
  SELECT source, doc_id, unnest(range(len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS t FROM documents))"""
_IS_UNIT = "NOT regexp_full_match(text, '[\\d\\s]*') AND NOT regexp_full_match(text, '(?i)(https?://|www\\.)\\S+') AND NOT regexp_full_match(text, '(?i)isbn(?:-1[03])?[\\s:-]*[\\dx][\\dx\\s-]*')"
_UNITS = f"(SELECT * FROM {_LINES} WHERE {_IS_UNIT})"
SQL = {
    "delete_cascade": f"""WITH asked AS (SELECT job_id, batch_id, status FROM {job_queries._JOBS} WHERE job_id % 10 = 3 AND status NOT IN ({_STATES})),
      l AS (SELECT batch_id, count(*) AS chunks FROM lineitem JOIN {job_queries._JOBS} j ON l_orderkey = j.job_id WHERE l_orderkey NOT IN (SELECT job_id FROM asked) GROUP BY batch_id),
      g AS (SELECT batch_id, count(*) AS deleted, count(*) FILTER (WHERE status = 'completed') AS done FROM asked GROUP BY batch_id)
      SELECT c.batch_id, files - coalesce(deleted, 0) AS files, greatest(completed - coalesce(done, 0), 0) AS completed, coalesce(chunks, 0) AS chunks
      FROM (SELECT batch_id, count(*) AS files, count(*) FILTER (WHERE status = 'completed') - 1 AS completed FROM {job_queries._JOBS} GROUP BY batch_id) c LEFT JOIN g USING (batch_id) LEFT JOIN l USING (batch_id)""",
    "glossary_create": f"""WITH have AS (SELECT DISTINCT lower(term_en) AS key FROM {glossary_queries._E}),
      new AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'THE' END AS term, p_partkey % 3 = 0 AS force FROM part UNION ALL
        SELECT -item_id - 1, lower(regexp_extract(text, '^(\\S+ [^ .,\\n]+)', 1)), item_id % 2 = 0 FROM benchmark)
      SELECT p_partkey, CASE WHEN key IS NULL THEN 'created' WHEN force THEN 'updated' ELSE 'conflict' END AS result FROM new LEFT JOIN have ON lower(term) = key""",
    "suggested_terms_page": text_queries._TERMS_SQL + "SELECT book, match_key, occurrences FROM ranked WHERE place <= 20000 AND noise_flags = '' AND ngram_size >= 2 ORDER BY occurrences DESC, book, match_key LIMIT 20 OFFSET 20",
    "suggested_terms_sorted": text_queries._TERMS_SQL + """, two AS (SELECT * FROM ranked WHERE place <= 20000 AND ngram_size >= 2)
      (SELECT 'rank' AS sort, book, match_key, rank_score FROM two ORDER BY rank_score DESC, book, match_key LIMIT 30) UNION ALL (SELECT 'alpha', book, match_key, rank_score FROM two ORDER BY match_key, book LIMIT 30)""",
    "suggested_terms_promote": text_queries._TERMS_SQL + f"""SELECT book, match_key, CASE WHEN place = 3 THEN 'dismissed' ELSE 'promoted' END AS status,
      place < 3 AND lower(term) NOT IN (SELECT lower(term_en) FROM {glossary_queries._EFF}) AS entry_created FROM ranked WHERE place <= 3""",
    "glossary_edit": f"""WITH e AS (SELECT *, CASE WHEN entry_id % 8 = 1 THEN 'THE' WHEN entry_id % 4 = 1 THEN term_en || 'x' END AS asked FROM {glossary_queries._E}),
      r AS (SELECT entry_id, term_en, asked, CASE WHEN entry_id % 4 = 0 THEN 'deleted' WHEN asked IS NULL THEN 'kept'
        WHEN EXISTS (SELECT 1 FROM e o WHERE o.scope = e.scope AND o.entry_id <> e.entry_id AND lower(o.term_en) = lower(e.asked)) THEN 'conflict' ELSE 'updated' END AS result FROM e)
      SELECT entry_id, result, CASE result WHEN 'updated' THEN asked WHEN 'deleted' THEN NULL ELSE term_en END AS term_en FROM r""",
    "suggested_terms_counts": text_queries._TERMS_SQL + "SELECT book, count(*) AS total, count(*) FILTER (WHERE noise_flags <> '') AS noise_hidden, count(*) FILTER (WHERE ngram_size >= 2 AND noise_flags = '') AS shown FROM ranked WHERE place <= 20000 GROUP BY book",
    "source_text_choice": """SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'document.md' WHEN o_orderkey % 3 = 2 AND o_custkey % 5 = 0 THEN 'error' WHEN o_orderkey % 3 = 2 THEN 'ocr.pdf' WHEN o_orderkey % 3 = 1 THEN 'file' ELSE 'units' END AS source FROM orders""",
    "request_cost_cap": """SELECT l_orderkey AS job_id, count(*) AS requests, max(l_linenumber) AS last_chunk FROM (
      SELECT *, coalesce(sum(l_extendedprice / 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM lineitem CROSS JOIN (VALUES (0), (1)) v(part)) WHERE b <= 60000 GROUP BY l_orderkey""",
    "retry_quota": """SELECT user_id, f AS for_missing, least(bad, 3 - f) AS for_bad FROM (SELECT user_id, CASE WHEN m <= 2 THEN m ELSE 1 END AS f, bad FROM (
      SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') % 6 AS m, count(*) FILTER (WHERE event_type = 'error') % 5 AS bad FROM events GROUP BY user_id))""",
    "settings_upsert": """SELECT coalesce(h.key, n.key) AS key, coalesce(n.v, h.value) AS value FROM (SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation) h
      FULL JOIN (SELECT n_name AS key, 'set' AS v FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'r-' || r_name, 'made' FROM region) n ON h.key = n.key""",
    "epub_units": f"SELECT * FROM {_UNITS}",
    "book_markdown": f"""WITH d AS (SELECT source, doc_id, text, doc_id // 64 AS volume, doc_id % 7 AS base, doc_id % 5 % 3 AS content, 'i' || doc_id % 5 AS folder FROM documents),
      f AS (SELECT source, base, content, min((volume, folder)) AS first FROM d GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY first) AS k FROM f),
      t AS (SELECT path AS source, doc_id, sum(length(regexp_replace(text, '\\s', '', 'g')))::BIGINT AS chars FROM (SELECT path, doc_id, ordinal, text FROM {_LINES}) WHERE {{unit}} OR ordinal = 0 GROUP BY ALL)
      SELECT source, doc_id, 'p' || base || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.jpg' AS shows, chars::INT AS chars FROM d JOIN k USING (source, base, content) JOIN t USING (source, doc_id)""".replace("{unit}", _IS_UNIT),
    "committed_epubs": f"SELECT path, count(*) AS units, count(*) FILTER (WHERE doc_id % 2 = 0) AS changed FROM {_UNITS} GROUP BY path",
    "parse_archives": """SELECT source, count(*) AS volumes, sum(chars)::BIGINT AS chars, sum(images)::BIGINT AS images FROM (
      SELECT source, doc_id // 64 AS v, sum(length(text)) + 2 * (count(*) - 1) AS chars, count(*) FILTER (WHERE doc_id % 3 = 0) AS images FROM documents GROUP BY ALL) GROUP BY source""",
    "request_log": "SELECT conv_id % 16 AS job_id, turn AS chunk_index, count(*) AS requests, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE role = 'user') AS by_user FROM conversations GROUP BY ALL",
    "epub_translate": f"SELECT path, count(*) AS units, count(*) FILTER (WHERE doc_id % 2 = 0) AS changed FROM {_UNITS} GROUP BY path",
}
