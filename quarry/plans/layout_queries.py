"""Queries on layout, HTML, repair and structure. Line items stand for boxes on pages, parts for lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import html, lexicon, repair
from quarry.functions import text as T
from quarry.operators import control, layout, records
from quarry.sources.shared import small_batches, written
from quarry.sources.tables import table


def _blocks(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    p = table(spark, sf, "part")
    x, y = (F.col("p_partkey") * 37 + shift) % 400, (F.col("p_partkey") * 91 + shift * 2) % 600
    return p.select(
        F.floor(F.col("p_partkey") / 12).alias("page"), F.col("p_partkey").alias("block"), x.cast("double").alias("x0"), y.cast("double").alias("y0"),
        (x + 30 + F.col("p_size") * 3).cast("double").alias("x1"), (y + 12 + F.col("p_size")).cast("double").alias("y1"),
    )


def _b(shift: int = 0) -> str:
    return f"""(SELECT p_partkey // 12 AS page, p_partkey AS block, x::DOUBLE AS x0, y::DOUBLE AS y0, (x + 30 + p_size * 3)::DOUBLE AS x1, (y + 12 + p_size)::DOUBLE AS y1
      FROM (SELECT *, (p_partkey * 37 + {shift}) % 400 AS x, (p_partkey * 91 + {2 * shift}) % 600 AS y FROM part))"""


_AREA = lambda t: f"(greatest({t}.x1 - {t}.x0, 0) * greatest({t}.y1 - {t}.y0, 0))"
_SHARED = "(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))"


def block_overlap(spark, sf):
    return layout.overlaps(_blocks(spark, sf)).withColumn("ratio", F.round("ratio", 4))


def text_over_border(spark, sf):
    return layout.over_border(_blocks(spark, sf), _blocks(spark, sf, 15)).withColumn("ratio", F.round("ratio", 4))


def text_over_image(spark, sf):
    return layout.over_image(_blocks(spark, sf), _blocks(spark, sf, 40).where("block % 5 = 0")).withColumn("ratio", F.round("ratio", 4))


def best_block_match(spark, sf):
    return layout.best_match(_blocks(spark, sf), _blocks(spark, sf, 7)).withColumn("iou", F.round("iou", 9))


def rotation_flags(spark, sf):
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity") - 25).alias("dx"), F.floor(F.col("l_discount") * 100).cast("double").alias("dy")).distinct()
    a = layout.rotation(F.col("dx"), F.col("dy"))
    return e.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "dx", "dy", F.round(a, 6).alias("angle"), layout.is_rotated(a).alias("rotated"))


def _lines(spark, sf):
    return table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).alias("page"), F.col("p_partkey").alias("line"), ((F.col("p_partkey") * 53) % 300).cast("double").alias("x"), ((F.col("p_partkey") * 17) % 200).cast("double").alias("y"), (F.col("p_size") % 4 * 30 + 0.25).alias("angle"), (8.0 + F.col("p_size") % 5).alias("font"))


def rotated_groups(spark, sf):
    return layout.rotated_groups(_lines(spark, sf)).select("page", "line", "turn", "block")


def page_queue(spark, sf):
    names = F.array(*map(F.lit, ["blocker", "critical", "major", "minor"]))
    f = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 7).alias("page"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("check"), F.get(names, (F.col("p_size") % 4).cast("int")).alias("severity"))
    return layout.page_queue(f, lexicon.SEVERITY)


def line_groups(spark, sf):
    g = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 15).alias("para"), F.col("p_partkey").alias("glyph"), ((F.col("p_partkey") * 29) % 120).cast("double").alias("y0"), ((F.col("p_partkey") * 29) % 120 + F.col("p_size") % 9).cast("double").alias("y1"))
    return layout.line_groups(g)


def fit_decision(spark, sf):
    d, s = layout.fit(F.col("w"), F.col("tw"), F.col("size"))
    p = table(spark, sf, "part").select("p_partkey", F.lit(100.0).alias("w"), (F.col("p_retailprice") / 10).alias("tw"), (8.0 + F.col("p_size") % 7).alias("size"))
    return p.select("p_partkey", d.alias("decision"), F.round(s, 6).alias("font_size"))


def fit_lines(spark, sf):
    """Lines of five spans, of which some show nothing."""
    k = F.col("p_partkey")
    spans = table(spark, sf, "part").select(F.floor(k / 5).alias("line"), k.alias("span"), F.when(k % 11 > 0, F.col("p_name")).otherwise(" ").alias("text"), F.lit(100.0).alias("width"), (F.col("p_retailprice") / (5 + k % 7)).alias("text_width"), (8.0 + F.col("p_size") % 7).alias("size"))
    return layout.fit_lines(spans).withColumn("size", F.round("size", 6))


def toc_marks(spark, sf):
    line = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 10).alias("para"), "p_partkey", layout.tail_number(F.when(F.col("p_partkey") % 6 == 0, F.col("p_name")).otherwise(line)).alias("n"))
    w = Window.partitionBy("para").orderBy("p_partkey")
    back = p.where("n is not null").withColumn("down", F.col("n") < F.lag("n").over(w)).groupBy("para").agg(F.count("*").alias("marks"), F.coalesce(F.bool_or("down"), F.lit(False)).alias("descends"))
    return back.select("para", "marks", "descends", ((F.col("marks") >= 2) & ~F.col("descends")).alias("is_contents"))


def entity_loss(spark, sf):
    """Numbers with units of a user's turn that the answer to it doesn't have."""
    c = table(spark, sf, "conversations").withColumn("text", F.concat("text", F.lit(" bake at "), (150 + F.col("turn") * 10).cast("string"), F.lit(" °C, "), (F.col("conv_id") % 9).cast("string"), F.lit("/4 l and "), (F.col("conv_id") % 5).cast("string"), F.lit(" min")))
    ask = c.select("conv_id", "turn", T.entities(F.col("text")).alias("e"))
    answer = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = ask.join(answer, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.concat_ws("|", F.filter("e", lambda x: ~F.contains("answer", x))).alias("lost"), F.size("e").alias("entities"))


def list_markers(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    marked = lines.withColumn("t", F.when((F.col("doc_id") + F.col("line")) % 3 > 0, F.concat((F.col("line") + 1).cast("string"), F.lit(". "), F.col("t"))).otherwise(F.col("t")))
    return marked.select("doc_id", "line", T.list_marker(F.col("t")).alias("marker"))


# ---------------------------------------------------------------- HTML and structure


def html_units(spark, sf):
    small_batches(spark)
    return table(spark, sf, "pages").select("page_id", "html").mapInPandas(html.html_units, "page_id long, ordinal int, tag string, html string, text string")


def html_unit_lengths(spark, sf):
    u = html_units(spark, sf)
    return u.groupBy("page_id").agg(F.count("*").alias("units"), F.sum(F.length(T.without_tags(F.col("html")))).alias("chars"), F.max("ordinal").alias("last_ordinal"))


def html_unit_filter(spark, sf):
    """Lines of documents that need no translation."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.concat(F.split("text", "\n"), F.array(F.lit(" 12 34 "), F.lit("https://a.b/c"), F.lit("ISBN-13: 978-0-1"), F.lit("")))).alias("line", "t"))
    return lines.where(T.droppable(F.col("t"))).select("doc_id", "line")


def external_links(spark, sf):
    """Distinct kinds of link targets of each page."""
    hrefs = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return hrefs.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.\\-]*:")).alias("external"))


def escape_untrusted(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.escape_untrusted(F.col("html")).alias("html"))


def sup_sub_normalize(spark, sf):
    t = F.concat(F.col("text"), F.lit(" x<sup>2</sup> 1<sup>1</sup>/<sub>3</sub> a<sub>ij</sub> y<sup>(n-1)</sup>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", html.sup_sub(t).alias("text"))


def link_targets(spark, sf):
    hrefs = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).where(~F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.\\-]*:"))
    return hrefs.select("page_id", "href", html.resolved(F.lit("OEBPS/text/ch1.xhtml"), F.col("href")).alias("target"))


def structural_drop_refs(spark, sf):
    """Which of the documents that should go can go: those that no kept document needs."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    gone = d.where("doc_id % 9 = 0").select("doc_id")
    tags = F.array(*map(F.lit, ["a", "a", "img", "a", "a", "link", "a"]))
    refs = d.select(F.col("doc_id").alias("from_doc"), F.get(tags, (F.col("doc_id") % 7).cast("int")).alias("tag"), ((F.col("doc_id") * 31) % 500).alias("doc_id"))
    kept = refs.join(gone.withColumnRenamed("doc_id", "from_doc"), "from_doc", "left_anti")
    held = kept.groupBy("doc_id").agg(F.bool_or(F.col("tag").isin("img", "link", "iframe", "object", "script")).alias("needed"), F.count("*").alias("refs"))
    return gone.join(held, "doc_id", "left").select("doc_id", F.coalesce("refs", F.lit(0)).alias("refs"), F.when(F.coalesce("needed", F.lit(False)), "skipped").otherwise("removed").alias("result"))


def image_names(spark, sf):
    """Names of images in an export: equal content shares one; other content with the same base name gets a number."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("img"), (F.col("p_partkey") % 90).cast("string")).alias("base"), "p_brand")
    firsts = p.groupBy("base", "p_brand").agg(F.min("p_partkey").alias("first"))
    w = Window.partitionBy("base").orderBy("first")
    named = firsts.withColumn("k", F.row_number().over(w))
    return p.join(named, ["base", "p_brand"]).select("p_partkey", F.when(F.col("k") == 1, F.concat("base", F.lit(".jpg"))).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string"), F.lit(".jpg"))).alias("name"))


def image_compress(spark, sf):
    """Why images are recompressed or not."""
    k = F.col("p_partkey")
    pick = lambda values, by: F.get(F.array(*values), (by % len(values)).cast("int"))
    names = [F.array(*map(F.lit, x)) for x in (["FlateDecode"], ["FlateDecode"], ["DCTDecode"], ["FlateDecode", "DCTDecode"], ["ASCII85Decode", "FlateDecode"], ["LZWDecode"])] + [F.lit(None), F.array().cast("array<string>")]
    i = table(spark, sf, "part").select(
        pick(names, k).alias("filters"), (k % 9 == 0).alias("masked"), (F.col("p_size") * 300).alias("raw"), F.when(F.col("p_size") % 7 == 0, 16).otherwise(8).alias("bits"),
        pick([F.lit(x) for x in (*layout.CHANNELS, "Indexed")], F.floor(k / 8)).alias("space"), pick([F.lit(x) for x in (1, 3, 4)], F.floor(k / 40)).alias("channels"), (F.col("p_retailprice") * 5).alias("jpeg"),
    )
    why = layout.image_reason(*map(F.col, ("filters", "masked", "raw", "bits", "space", "channels", "jpeg")))
    return i.groupBy(why.alias("reason")).agg(F.count("*").alias("images"), F.sum("raw").cast("long").alias("raw_bytes"))


# ---------------------------------------------------------------- repair of responses


def _responses(spark, sf):
    c = table(spark, sf, "conversations")
    held = F.to_json(F.array("text"))
    quoted = F.when(F.col("text").isNotNull(), F.substring(held, F.lit(2), F.length(held) - 2))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", quoted.alias("t")))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit('"'), x["turn"].cast("string"), F.lit('": '), x["t"])), ", ")
    return g.select("conv_id", F.concat(F.lit("{"), body, F.lit("}")).alias("raw"), F.transform("s", lambda x: x["turn"].cast("string")).alias("expected"))


def _blank(v):
    return ~v.rlike("(?U)[^\\s\\x1c-\\x1f]")


def json_strict_parse(spark, sf):
    """Clean responses need no Python: a map from JSON, blank values left out."""
    r = _responses(spark, sf)
    m = F.from_json("raw", "map<string,string>")
    good = F.map_filter(m, lambda k, v: F.array_contains("expected", k) & ~_blank(v))
    return r.select("conv_id", F.explode(good).alias("id", "value"))


def missing_ids(spark, sf):
    r = _responses(spark, sf)
    m = F.from_json("raw", "map<string,string>")
    have = F.map_keys(F.map_filter(m, lambda k, v: ~_blank(v)))
    return r.select("conv_id", F.size("expected").alias("expected"), F.concat_ws(",", F.array_sort(F.array_except(F.concat("expected", F.array(F.lit("999"))), have))).alias("missing"))


def json_salvage(spark, sf):
    """The same responses, cut, doubled or with text around them."""
    r = _responses(spark, sf)
    raw = (
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("```json\n"), F.col("raw"), F.lit("\n```")))
        .when(F.col("conv_id") % 4 == 1, F.substring("raw", F.lit(1), (F.length("raw") * 0.7).cast("int")))
        .when(F.col("conv_id") % 4 == 2, F.concat("raw", F.lit("}}, "), F.col("raw")))
        .otherwise(F.concat("raw", F.lit(" as you asked")))
    )
    fixed = r.select("conv_id", "expected", repair.repair(raw, F.col("expected")).alias("f"))
    return fixed.select("conv_id", F.size("f.translations").alias("found"), F.concat_ws(",", "f.strict_ids").alias("strict_ids"), F.concat_ws(",", "f.salvaged_ids").alias("salvaged_ids"))


def fallback_quota(spark, sf):
    """May so many units of a chunk stay untranslated?"""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("fallback"))
    quota = lambda r: F.greatest(F.lit(1), F.ceil(r * F.col("n")))
    return g.select("job_id", "n", "fallback", (F.col("fallback") > quota(0.20)).alias("chunk_fails"), (F.col("fallback") > quota(0.05)).alias("job_fails"))


def output_guard(spark, sf):
    """Output of a book against its source, unit by unit in order: as many units, most of them changed, not all empty."""
    d = table(spark, sf, "documents")
    answer = F.when(F.col("doc_id") % 13 < 12, F.upper("text")).otherwise(F.col("text"))
    digest = lambda t: F.sha2(T.squeeze(t), 256)
    read = written(d.select(F.col("source").alias("book"), "doc_id", digest(F.col("text")).alias("a"), digest(answer).alias("b"), F.length(answer).alias("chars")), "guard")  # texts are read once, and never shuffled
    src = control.numbered(read.select("book", "doc_id", "a"), ["book"], ["doc_id"]).drop("doc_id")
    out = control.numbered(read.where("doc_id % 57 <> 5").select("book", "doc_id", "b", "chars"), ["book"], ["doc_id"]).drop("doc_id")
    g = src.join(out, ["book", "pos"], "full").groupBy("book").agg(F.count("a").alias("n"), F.count("b").alias("m"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.sum("chars").alias("chars"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(0.9) * F.col("n")))
    return g.select("book", "n", "m", "changed", ((F.col("n") == F.col("m")) & (F.col("changed") >= need) & (F.col("chars") > 0)).alias("passes"))


def _drop_lines(spark, sf):
    """Logs of lines, a log for each user, some lines broken, blank, or of kinds to come."""
    e = table(spark, sf, "events")
    page = (F.col("event_id") % 40).cast("string")
    line = (
        F.when(F.col("event_id") % 50 == 7, F.get(F.array(*map(F.lit, ["{broken", "[1]", "  ", "7"])), (F.floor(F.col("event_id") / 50) % 4).cast("int")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"type":"page","page_number_1based":'), page, F.lit(',"dropped_count":'), (F.col("event_id") % 60).cast("string"), F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"type":"drop","page_number_1based":'), page, F.lit(',"debug_id":"p'), F.col("event_id").cast("string"), F.lit('"}')))
        .when(F.col("event_id") % 3 == 0, F.lit('{"type":"header","schema":"2"}')).otherwise(F.lit('{"type":"later"}'))
    )
    return e.select("user_id", "event_id", line.alias("line"))


def drop_report_audit(spark, sf):
    """All lines as one log: declared against logged drops of each page. The last page record wins."""
    log = _drop_lines(spark, sf).select(F.lit(0).alias("log"), F.col("event_id").alias("line_no"), "line")
    return records.drop_audit(records.drop_log(log)).drop("log")


def drop_report_summary(spark, sf):
    log = _drop_lines(spark, sf).select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), "line")
    return records.drop_summary(records.drop_log(log)).withColumnRenamed("log", "user_id")


def dropped_paragraphs(spark, sf):
    """Turns of conversations as paragraphs of pages 2 to 40; some were drawn, some have no id or no text."""
    c = table(spark, sf, "conversations")
    text = F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.col("text"))
    p = c.select((F.col("conv_id") % 60 + 1).alias("page"), F.when(F.col("conv_id") % 7 > 0, F.concat_ws("-", "conv_id", "turn")).alias("debug_id"), text.alias("text"), F.when(F.col("turn") % 3 > 0, (F.col("turn") - 1) * 10).alias("rendered"))
    return layout.dropped(p, 2, 40)


def token_usage(spark, sf):
    """Counters of a log, the last mention of each; a missing one is null, cache hits default to 0."""
    log = F.concat(F.lit("total tokens: 1\ntotal tokens: "), (F.col("event_id") * 3).cast("string"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("\nprompt tokens: "), F.col("event_id").cast("string"))).otherwise(""), F.lit("\nRateLimitError x RateLimitError"))
    last = lambda name: F.try_element_at(F.regexp_extract_all("log", F.lit(name + ": ([0-9]+)"), 1), F.lit(-1)).cast("long")
    return table(spark, sf, "events").select("event_id", log.alias("log")).select("event_id", last("total tokens").alias("total"), last("prompt tokens").alias("prompt"), F.coalesce(last("cache hits"), F.lit(0)).alias("cache_hits"), F.regexp_count("log", F.lit("RateLimitError")).alias("rate_limits"))


QUERIES = {f.__name__: f for f in (
    block_overlap, text_over_border, text_over_image, best_block_match, rotation_flags, rotated_groups, page_queue, line_groups, fit_decision, fit_lines, toc_marks, entity_loss, list_markers,
    html_units, html_unit_lengths, html_unit_filter, external_links, escape_untrusted, sup_sub_normalize, link_targets, structural_drop_refs, image_names, image_compress,
    json_strict_parse, missing_ids, json_salvage, fallback_quota, output_guard, drop_report_audit, drop_report_summary, dropped_paragraphs, token_usage,
)}

_RESP = "(SELECT conv_id, turn::VARCHAR AS id, text AS t FROM conversations)"
SQL = {
    "block_overlap": f"SELECT a.page, a.block, b.block AS o_block, round({_SHARED} / least({_AREA('a')}, {_AREA('b')}), 4) AS ratio FROM {_b()} a JOIN {_b()} b ON a.page = b.page AND a.block < b.block WHERE {_SHARED} > 0 AND {_SHARED} / least({_AREA('a')}, {_AREA('b')}) > 0.05::DOUBLE",
    "text_over_border": f"SELECT a.page, a.block, b.block AS o_block, round({_SHARED} / {_AREA('a')}, 4) AS ratio FROM {_b()} a JOIN {_b(15)} b ON a.page = b.page WHERE {_SHARED} > 0 AND {_SHARED} < {_AREA('a')} - 1e-6 AND {_SHARED} / {_AREA('a')} > 0.05::DOUBLE",
    "text_over_image": f"SELECT a.page, a.block, b.block AS o_block, round({_SHARED} / {_AREA('a')}, 4) AS ratio FROM {_b()} a JOIN {_b(40)} b ON a.page = b.page AND b.block % 5 = 0 WHERE {_SHARED} / {_AREA('a')} > 0.05::DOUBLE",
    "best_block_match": f"""SELECT page, block, o_block, round(iou, 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY iou DESC, o_block) AS rn FROM (
      SELECT a.page, a.block, b.block AS o_block, {_SHARED} / ({_AREA('a')} + {_AREA('b')} - {_SHARED}) AS iou FROM {_b()} a JOIN {_b(7)} b ON a.page = b.page WHERE {_SHARED} > 0) WHERE iou >= 0.05::DOUBLE) WHERE rn = 1""",
    "rotation_flags": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, dx, dy, round(a, 6) AS angle, least(m0, 180 - m0) > 0.1 AND least(m9, 180 - m9) > 0.1 AS rotated FROM (
      SELECT *, ((a % 180) + 180) % 180 AS m0, (((a - 90) % 180) + 180) % 180 AS m9 FROM (SELECT *, degrees(atan2(dy, dx)) AS a FROM (
        SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity - 25 AS dx, floor(l_discount * 100)::DOUBLE AS dy FROM lineitem)))""",
    "rotated_groups": """WITH p AS (SELECT page, line, font, turn::INT AS turn, round(-x * sin(radians(turn)) + y * cos(radians(turn)), 6) AS across FROM (
        SELECT p_partkey // 20 AS page, p_partkey AS line, ((p_partkey * 53) % 300)::DOUBLE AS x, ((p_partkey * 17) % 200)::DOUBLE AS y, round_even(p_size % 4 * 30 + 0.25::DOUBLE, 0) AS turn, 8.0::DOUBLE + p_size % 5 AS font FROM part)),
      c AS (SELECT *, CASE WHEN across - lag(across) OVER w > 1.8::DOUBLE * greatest(font, lag(font) OVER w) THEN 1 ELSE 0 END AS cut FROM p WINDOW w AS (PARTITION BY page, turn ORDER BY across, line))
      SELECT page, line, turn, sum(cut) OVER (PARTITION BY page, turn ORDER BY across, line)::BIGINT AS block FROM c""",
    "page_queue": """SELECT page, sum(w)::BIGINT AS score, string_agg(c, ',' ORDER BY -w, seq) AS checks FROM (SELECT p_partkey // 7 AS page, p_partkey AS seq, p_brand AS c, 3 - p_size % 4 AS w FROM part) GROUP BY page""",
    "fit_decision": """SELECT p_partkey, CASE WHEN tw <= 100 THEN 'fits' WHEN tw * small / size <= 100 + 1e-9 THEN 'shrunk' WHEN tw * small / size * 0.85::DOUBLE <= 100 + 1e-9 THEN 'condensed' ELSE 'overflow' END AS decision,
      round(CASE WHEN tw <= 100 THEN size ELSE small END, 6) AS font_size FROM (SELECT *, greatest(0.8::DOUBLE * size, size * 100.0::DOUBLE / tw) AS small FROM (SELECT p_partkey, p_retailprice / 10 AS tw, 8.0::DOUBLE + p_size % 7 AS size FROM part))""",
    "fit_lines": """WITH s AS (SELECT p_partkey // 5 AS line, p_partkey AS span, p_retailprice / (5 + p_partkey % 7) AS tw, 8.0::DOUBLE + p_size % 7 AS size FROM part WHERE p_partkey % 11 > 0),
      r AS (SELECT *, min(CASE WHEN tw <= 100 THEN 1 ELSE greatest(0.8::DOUBLE, 100.0::DOUBLE / tw) END) OVER (PARTITION BY line) AS r FROM s)
      SELECT line, span, round(size * r, 6) AS size, CASE WHEN tw * r <= 100 + 1e-9 THEN 1.0 ELSE 0.85 END::DOUBLE AS scale, tw * r * 0.85::DOUBLE > 100 + 1e-9 AS overflow,
        NOT bool_or(tw * r * 0.85::DOUBLE > 100 + 1e-9) OVER (PARTITION BY line) AS repack FROM r WHERE r < 1""",
    "line_groups": """WITH g AS (SELECT p_partkey // 15 AS para, p_partkey AS glyph, (p_partkey * 29) % 120 AS y0, (p_partkey * 29) % 120 + p_size % 9 AS y1 FROM part),
      o AS (SELECT *, max(y1) OVER (PARTITION BY para ORDER BY y0, glyph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g),
      i AS (SELECT para, glyph, sum(CASE WHEN top IS NULL OR y0 > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY para ORDER BY y0, glyph) AS k FROM o)
      SELECT para, glyph, (max(k) OVER (PARTITION BY para) - k + 1)::INT AS line FROM i""",
    "toc_marks": """WITH m AS (SELECT p_partkey // 10 AS para, p_partkey, p_size AS n FROM part WHERE p_partkey % 6 <> 0),
      d AS (SELECT *, n < lag(n) OVER (PARTITION BY para ORDER BY p_partkey) AS down FROM m)
      SELECT para, count(*) AS marks, coalesce(bool_or(down), false) AS descends, count(*) >= 2 AND NOT coalesce(bool_or(down), false) AS is_contents FROM d GROUP BY para""",
    "entity_loss": """WITH c AS (SELECT conv_id, turn, text || ' bake at ' || (150 + turn * 10) || ' °C, ' || conv_id % 9 || '/4 l and ' || conv_id % 5 || ' min' AS text FROM conversations),
      e AS (SELECT conv_id, turn, list_concat(list_concat(regexp_extract_all(text, '\\d+\\s?°C'), regexp_extract_all(text, '(?i)\\d+(?:[.,]\\d+)?\\s?(?:kg|g|ml|l)\\b')),
        list_concat(regexp_extract_all(text, '(?i)\\d+\\s?(?:phút|phut|min|giờ|gio|h)\\b'), regexp_extract_all(text, '\\d+/\\d+'))) AS e FROM c)
      SELECT e.conv_id, e.turn, array_to_string(list_filter(e, lambda x: NOT contains(c.text, x)), '|') AS lost, len(e) AS entities FROM e JOIN c ON c.conv_id = e.conv_id AND c.turn = e.turn + 1""",
    "list_markers": """SELECT doc_id, line, nullif(regexp_extract(CASE WHEN (doc_id + line) % 3 > 0 THEN (line + 1) || '. ' || t ELSE t END, '^\\s*(\\d{1,3})[.)]\\s+\\S', 1), '')::INT AS marker FROM (
      SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents)""",
    "html_unit_filter": """SELECT doc_id, line FROM (SELECT doc_id, unnest(range(len(l))) AS line, trim(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS t FROM (
      SELECT doc_id, list_concat(string_split(text, chr(10)), [' 12 34 ', 'https://a.b/c', 'ISBN-13: 978-0-1', '']) AS l FROM documents))
      WHERE t = '' OR regexp_full_match(t, '[\\d\\s]+') OR regexp_full_match(t, '(?i)(https?://|www\\.)\\S+') OR regexp_full_match(t, '(?i)isbn(?:-1[03])?[\\s:-]*[\\dx][\\dx\\s-]*')""",
    "external_links": "SELECT page_id, count(*) AS links, count(*) FILTER (WHERE regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:')) AS external FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id",
    "structural_drop_refs": """WITH gone AS (SELECT doc_id FROM documents WHERE doc_id % 9 = 0),
      refs AS (SELECT doc_id AS from_doc, ['a', 'a', 'img', 'a', 'a', 'link', 'a'][doc_id % 7 + 1] AS tag, (doc_id * 31) % 500 AS target FROM documents WHERE doc_id % 9 <> 0),
      held AS (SELECT target, bool_or(tag IN ('img', 'link', 'iframe', 'object', 'script')) AS needed, count(*) AS refs FROM refs GROUP BY target)
      SELECT doc_id, coalesce(refs, 0) AS refs, CASE WHEN coalesce(needed, false) THEN 'skipped' ELSE 'removed' END AS result FROM gone LEFT JOIN held ON target = doc_id""",
    "image_names": """WITH p AS (SELECT p_partkey, 'img' || p_partkey % 90 AS base, p_brand FROM part), f AS (SELECT base, p_brand, row_number() OVER (PARTITION BY base ORDER BY min(p_partkey)) AS k FROM p GROUP BY base, p_brand)
      SELECT p_partkey, CASE WHEN k = 1 THEN base || '.jpg' ELSE base || '_' || k || '.jpg' END AS name FROM p JOIN f USING (base, p_brand)""",
    "image_compress": """SELECT CASE WHEN p_partkey % 8 IN (2, 3, 5) THEN 'codec' WHEN p_partkey % 9 = 0 THEN 'masked' WHEN p_size * 300 < 4096 THEN 'small' WHEN p_size % 7 = 0 THEN 'depth'
        WHEN s = 4 OR s < 3 AND s <> c THEN 'colours' WHEN p_retailprice * 5 >= p_size * 300 THEN 'not_smaller' ELSE 'compressed' END AS reason, count(*) AS images, sum(p_size * 300)::BIGINT AS raw_bytes
      FROM (SELECT *, (p_partkey // 8) % 5 AS s, (p_partkey // 40) % 3 AS c FROM part) GROUP BY reason""",
    "json_strict_parse": f"SELECT conv_id, id, t AS value FROM {_RESP} WHERE trim(t) <> ''",
    "missing_ids": f"SELECT conv_id, count(*)::INT AS expected, array_to_string(list_sort(list_concat(list(id) FILTER (WHERE trim(t) = ''), ['999'])), ',') AS missing FROM {_RESP} GROUP BY conv_id",
    "fallback_quota": """SELECT job_id, n, fallback, fallback > greatest(1, ceil(0.20::DOUBLE * n)) AS chunk_fails, fallback > greatest(1, ceil(0.05::DOUBLE * n)) AS job_fails FROM (
      SELECT l_orderkey AS job_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS fallback FROM lineitem GROUP BY l_orderkey)""",
    "output_guard": """WITH s AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, text AS a FROM documents),
      o AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, CASE WHEN doc_id % 13 < 12 THEN upper(text) ELSE text END AS b FROM documents WHERE doc_id % 57 <> 5)
      SELECT book, count(a) AS n, count(b) AS m, count(*) FILTER (WHERE trim(regexp_replace(a, '\\s+', ' ', 'g')) <> trim(regexp_replace(b, '\\s+', ' ', 'g'))) AS changed,
        count(a) = count(b) AND count(*) FILTER (WHERE trim(regexp_replace(a, '\\s+', ' ', 'g')) <> trim(regexp_replace(b, '\\s+', ' ', 'g'))) >= greatest(1, ceil(0.9::DOUBLE * count(a))) AND sum(length(b)) > 0 AS passes
      FROM s FULL JOIN o USING (book, pos) GROUP BY book""",
    "drop_report_audit": """WITH e AS (SELECT *, event_id % 40 AS page FROM events WHERE event_id % 50 <> 7 AND event_type IN ('view', 'error'))
      SELECT page, arg_max(event_id % 60, event_id) FILTER (WHERE event_type = 'view') AS declared, count(*) FILTER (WHERE event_type = 'error') AS logged,
        coalesce(arg_max(event_id % 60, event_id) FILTER (WHERE event_type = 'view'), 0) <> count(*) FILTER (WHERE event_type = 'error') AS mismatch FROM e GROUP BY page""",
    "drop_report_summary": """SELECT user_id, count(*) FILTER (WHERE h) > 0 AS available, count(*) FILTER (WHERE h) AS headers, count(*) FILTER (WHERE broken) AS malformed,
        count(DISTINCT event_id % 40) FILTER (WHERE NOT odd AND event_type = 'view') AS pages, count(*) FILTER (WHERE NOT odd AND event_type = 'error') AS drops
      FROM (SELECT *, event_id % 50 = 7 AS odd, event_id % 50 = 7 AND (event_id // 50) % 4 <> 2 AS broken, event_id % 50 <> 7 AND event_type NOT IN ('view', 'error') AND event_id % 3 = 0 AS h FROM events)
      WHERE NOT (odd AND (event_id // 50) % 4 = 2) GROUP BY user_id""",
    "dropped_paragraphs": """SELECT page, debug_id, length(text)::INT AS text_len, substr(text, 1, 400) AS text_excerpt FROM (
      SELECT conv_id % 60 + 1 AS page, CASE WHEN conv_id % 7 > 0 THEN conv_id || '-' || turn END AS debug_id, CASE WHEN turn % 5 = 4 THEN '  ' ELSE text END AS text, turn FROM conversations)
      WHERE page BETWEEN 2 AND 40 AND (turn % 3 = 0 OR turn = 1) AND trim(coalesce(text, '')) <> '' AND debug_id IS NOT NULL""",
    "token_usage": "SELECT event_id, event_id * 3 AS total, CASE WHEN event_id % 3 > 0 THEN event_id END AS prompt, 0 AS cache_hits, 2 AS rate_limits FROM events",
}
