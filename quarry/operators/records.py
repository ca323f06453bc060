"""Records of readers and renderers: recognised text, detector lines, contents lists, wrapped text, prompts, audits."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.functions import lexicon as L
from quarry.functions import text as T
from quarry.sources.shared import written


def _each(value: Column, path: str) -> Column:
    """The elements of an array in a VARIANT; none if there is no array."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def ocr_spans(docs: DataFrame) -> DataFrame:
    """(doc, raw JSON) to spans: page, part (body or discarded), type, content, bbox, score; broken JSON gives none.

    Blocks hold lines or blocks, to any depth: each level's blocks are written, give their spans, and the blocks in them are the next level."""
    page = docs.select("doc", F.explode(_each(F.try_parse_json("raw"), "$.pdf_info")).alias("p"))
    parts = F.array(*(F.struct(F.lit(part).alias("part"), _each(F.col("p"), f"$.{name}").alias("b")) for part, name in (("body", "preproc_blocks"), ("discarded", "discarded_blocks"))))
    blocks = page.select("doc", F.try_variant_get("p", "$.page_idx", "int").alias("page"), F.explode(parts).alias("x")).select("doc", "page", "x.part", F.explode("x.b").alias("b"))
    found = []
    while not found or not blocks.isEmpty():
        blocks = written(blocks, "blocks")
        lines = blocks.select("doc", "page", "part", F.explode(_each(F.col("b"), "$.lines")).alias("l"))
        spans = lines.select("doc", "page", "part", F.explode(_each(F.col("l"), "$.spans")).alias("s"))
        field = lambda name, kind: F.try_variant_get("s", f"$.{name}", kind).alias(name)
        found.append(spans.select("doc", "page", "part", field("type", "string"), field("content", "string"), field("bbox", "array<double>"), field("score", "double")))
        blocks = blocks.select("doc", "page", "part", F.explode(_each(F.col("b"), "$.blocks")).alias("b"))
    return reduce(DataFrame.unionByName, found)


def drop_log(lines: DataFrame) -> DataFrame:
    """Lines of drop reports (log, line_no, line) to records: kind (header, page, drop, other or malformed), page, dropped_count, debug_id.

    Blank lines are none. A line that is no JSON object is malformed. A page record without page or count, or a drop without page, ends
    the query with an error: the report can't be trusted."""
    record = F.try_parse_json("line")
    text = lambda name: F.try_variant_get("r", f"$.{name}", "string")
    whole = lambda name: F.try_variant_get("r", f"$.{name}", "int")
    kinds = F.when(F.coalesce(F.schema_of_variant("r"), F.lit("")).startswith("OBJECT"), F.when(text("type").isin("header", "page", "drop"), text("type")).otherwise("other")).otherwise("malformed")
    rows = lines.where(F.trim("line") != "").withColumn("r", record).withColumn("kind", kinds)
    broken = F.when((F.col("kind") == "page") & (whole("page_number_1based").isNull() | whole("dropped_count").isNull()), F.raise_error(F.concat(F.lit("page record without page or count: "), "line")))
    broken = broken.when((F.col("kind") == "drop") & whole("page_number_1based").isNull(), F.raise_error(F.concat(F.lit("drop record without page: "), "line")))
    page = F.when(F.col("kind").isin("page", "drop"), F.coalesce(broken.cast("int"), whole("page_number_1based")))
    return rows.select("log", "line_no", "kind", page.alias("page"), whole("dropped_count").alias("dropped_count"), F.when(F.col("kind") == "drop", F.coalesce(text("debug_id"), F.lit(""))).alias("debug_id"))


def drop_audit(records: DataFrame) -> DataFrame:
    """Declared against logged drops of each page of a log; the last page record counts."""
    is_page = F.col("kind") == "page"
    per = records.where("page is not null").groupBy("log", "page").agg(F.max_by(F.when(is_page, F.col("dropped_count")), F.when(is_page, F.col("line_no"))).alias("declared"), F.count_if(F.col("kind") == "drop").alias("logged"))
    return per.withColumn("mismatch", F.coalesce("declared", F.lit(0)) != F.col("logged"))


def drop_summary(records: DataFrame) -> DataFrame:
    """Each log as a whole: headers (without one the report was not available), malformed lines, pages seen, drops."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    pages = F.count_distinct(F.when(F.col("kind") == "page", F.col("page")))
    return records.groupBy("log").agg((count("header") > 0).alias("available"), count("header").alias("headers"), count("malformed").alias("malformed"), pages.alias("pages"), count("drop").alias("drops"))


def ocr_quality(spans: DataFrame) -> DataFrame:
    """Mean score, number of scored spans and of dropped ones (score 0), by document; each span counts once."""
    return spans.where("score is not null").groupBy("doc").agg(F.round(F.avg("score"), 9).alias("confidence"), F.count("*").alias("spans"), F.count_if(F.col("score") == 0).alias("dropped"))


def text_spans(spans: DataFrame) -> DataFrame:
    """Body spans with text and a proper box."""
    b = F.col("bbox")
    good = (F.size(b) == 4) & (b[2] > b[0]) & (b[3] > b[1])
    return spans.where((F.col("part") == "body") & F.col("type").isin("text", "inline_equation") & (F.trim("content") != "") & good)


def detector_lines(items: DataFrame, score: float = 0.8, angle: float = 3.0) -> DataFrame:
    return items.where((F.col("score") >= score) & (F.abs("angle") >= angle) & (F.size("poly") >= 2))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings, lower-cased; Spark's edit distance is another measure."""
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)])


def match_lines(lines: DataFrame, spans: DataFrame, least: float = 0.6, cell: float = 32.0) -> DataFrame:
    """Detector lines (page, line, text, cx, cy, height) with their most similar span (page, span, content, sx, sy) nearby, the first on ties.

    Near is less than half a line's height from centre to centre: a line asks the grid cells of side ``cell`` within that reach,
    a span lies in one, so a page of very many lines is spread."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - 0.5 * F.col("height")) / cell), F.floor((F.col(c) + 0.5 * F.col("height")) / cell))
    asking = lines.where("height > 0").withColumn("_cx", F.explode(reach("cx"))).withColumn("_cy", F.explode(reach("cy")))
    lying = spans.withColumn("_cx", F.floor(F.col("sx") / cell)).withColumn("_cy", F.floor(F.col("sy") / cell))
    near = asking.join(lying, ["page", "_cx", "_cy"]).where(F.hypot(F.col("cx") - F.col("sx"), F.col("cy") - F.col("sy")) < 0.5 * F.col("height"))
    rated = near.withColumn("ratio", similarity("text", "content")).where(F.col("ratio") >= least)
    best = F.max_by(F.struct("span", "ratio"), F.struct("ratio", -F.col("span")))
    return rated.groupBy("page", "line").agg(best.alias("m")).select("page", "line", F.col("m.span").alias("span"), F.round("m.ratio", 6).alias("ratio"))


def numbered_groups(lines: Column) -> Column:
    """Group number of each line of a paragraph that is a numbered list: a new group at each next number."""
    marks = F.transform(lines, T.list_marker)
    first = F.get(marks, F.lit(0))
    zero = F.struct((first + 1).alias("next"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        hit = F.coalesce(m == s["next"], F.lit(False))
        g = F.when(hit, s["g"] + 1).otherwise(s["g"])
        return F.struct(F.when(hit, m + 1).otherwise(s["next"]).alias("next"), g.alias("g"), F.concat(s["out"], F.array(g)).alias("out"))

    rest = F.aggregate(F.slice(marks, F.lit(2), F.greatest(F.size(marks) - 1, F.lit(0))), zero, step)
    return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(0)), rest["out"])).otherwise(F.array().cast("array<int>"))


def width_to_break(units: Column, scale: Column) -> Column:
    """Width of what follows the first unit of a word up to the next break; nothing if the first unit can break."""
    rest = F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0)))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("stop"))
    total = F.aggregate(rest, zero, lambda s, u: F.struct(F.when(s["stop"] | u["can_break"], s["sum"]).otherwise(s["sum"] + u["width"]).alias("sum"), (s["stop"] | u["can_break"]).alias("stop")))
    return F.when((F.size(units) == 0) | F.get(units, F.lit(0))["can_break"], 0.0).otherwise(total["sum"] * scale)


def wrapped(text: str, width: float, font: float, char: float = 0.5) -> list[str]:
    """Greedy lines; a character is ``char`` of the font size wide, and a word that is too long stands alone."""
    lines: list[list[str]] = []
    length = 0  # of the last line
    for word in text.split():
        if lines and (length + 1 + len(word)) * char * font <= width:
            lines[-1].append(word)
            length += 1 + len(word)
        else:
            lines.append([word])
            length = len(word)
    return [" ".join(x) for x in lines]


def fit_blocks(frame_iter):
    """mapInPandas: (block, text, width, height, font) to the largest scale, from 1.0 down to 0.7 in steps of 0.02, at which the lines fit."""
    for frame in frame_iter:
        out = []
        for b in frame.itertuples(index=False):
            for k in range(16):
                scale = round(1.0 - 0.02 * k, 2)
                lines = wrapped(b.text or "", b.width, b.font * scale)
                fits = len(lines) * b.font * scale * 1.2 <= b.height + 1e-6
                if fits:
                    break
            out.append((b.block, fits, scale, len(lines)))
        yield pd.DataFrame(out, columns=["block", "fits", "scale", "lines"])


# Labels of paragraphs that are never lists of contents.
DENIED = {
    "abandon", "header", "footer", "page_header", "page_footer", "table", "table_cell", "wired_table_cell", "wireless_table_cell",
    "table_cell_hybrid", "table_text", "table_caption", "table_footnote", "figure", "figure_caption", "figure_text", "formula",
    "isolate_formula", "formula_caption",
}


def whole_texts(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(book, pos, text) to each book's whole text as (book, total_chars, sha256, pages): the pages that hold a text, in order.

    A digest runs over one book in order, so a book is one task's; but its pages pass one by one, and no row holds a whole book."""
    kind = pages.schema["book"].dataType.simpleString()
    names = ["book", "total_chars", "sha256", "pages"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, chars, digest, n, done = None, 0, None, 0, []
        for frame in frames:
            for b, t in zip(frame.book, frame.text):
                if digest is None or b != book:
                    done += [] if digest is None else [(book, chars, digest.hexdigest(), n)]
                    book, chars, digest, n = b, 0, hashlib.sha256(), 0
                n += 1
                if t:
                    lead = separator if chars else ""
                    chars += len(lead) + len(t)
                    digest.update((lead + t).encode())
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=names)
                done = []
        done += [] if digest is None else [(book, chars, digest.hexdigest(), n)]
        yield pd.DataFrame(done, columns=names)

    in_order = pages.select("book", "pos", "text").repartition("book").sortWithinPartitions("book", "pos").select("book", "text")
    return in_order.mapInPandas(run, f"book {kind}, total_chars long, sha256 string, pages int")


def contents_cuts(label: str | None, lines: list[list[tuple[float, float, str, float]] | None]) -> tuple[str, list[int]]:
    """Whether a paragraph is a list of contents, and the lines after which to cut it. A line is glyphs (x, x2, char, font size), or None."""
    if (label or "").strip().lower() in DENIED:
        return "deny_layout", []
    if len(lines) < 2:
        return "too_short", []
    glyphs = [None if line is None else sorted(g for g in line if g[2].strip()) for line in lines]
    marks: dict[int, tuple[int, float, float]] = {}
    for i, line in enumerate(glyphs):
        text = "".join(g[2] for g in line or [])
        m = re.fullmatch(r"(.*[^0-9])([0-9]{1,4})", text)
        if m and re.search("[A-Za-z]{2,}", m[1]) and int(m[2]) >= 1:
            last, digit = line[len(m[1]) - 1], line[len(m[1])]
            if last[3] > 0 and (digit[0] - last[1]) / last[3] >= 0.8:
                marks[i] = (int(m[2]), last[3], line[0][0])
    if len(marks) < 2:
        return "few_tail_lines", []
    if len(marks) / len(lines) < 0.6:
        return "low_fraction", []
    numbers = [marks[i][0] for i in sorted(marks)]
    if numbers != sorted(numbers):
        return "not_monotonic", []
    cuts = set()
    for i, (_, size, left) in marks.items():
        end = i
        for k in range(i + 1, len(lines)):  # what is indented, or no text, belongs to the entry before it
            if glyphs[k] is not None and (k in marks or not glyphs[k] or glyphs[k][0][0] - left < size):
                break
            end = k
        cuts |= {end} if end < len(lines) - 1 else set()
    return ("fired", sorted(cuts)) if cuts else ("no_cut_points", [])


def _contents_lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs to one row a line: left edge (null if it shows nothing), and, of a line that ends in a number well apart, number and size."""
    shown = F.array_sort(F.collect_list(F.when(F.col("ch").rlike(r"(?U)\S"), F.struct("x", "x2", "ch", "size"))))
    lines = glyphs.groupBy("para", "line").agg(F.first("label").alias("label"), shown.alias("g"))
    lines = lines.withColumn("t", F.array_join(F.transform("g", lambda c: c["ch"]), ""))
    number, head = F.regexp_extract("t", "^.*[^0-9]([0-9]{1,4})$", 1), F.regexp_extract("t", "^(.*[^0-9])[0-9]{1,4}$", 1)
    last, digit = F.get("g", F.length(head) - 1), F.get("g", F.length(head))
    apart = (last["size"] > 0) & ((digit["x"] - last["x2"]) / last["size"] >= 0.8)
    marked = F.coalesce((number != "") & head.rlike("[A-Za-z]{2,}") & (number.try_cast("int") >= 1) & apart, F.lit(False))
    left = F.get("g", F.lit(0))["x"]
    return lines.select("para", "line", "label", left.alias("left"), F.when(marked, F.struct("line", number.cast("int").alias("number"), last["size"].alias("size"), left.alias("left"))).alias("mark"))


def split_contents(glyphs: DataFrame) -> DataFrame:
    """(para, label, line, x, x2, ch, size) to (para, reason, cuts), as ``contents_cuts`` has them.

    A line is a row of a few numbers once its glyphs are joined; lines of a paragraph pass a window in order, so one of very many
    lines is sorted and streamed, not held."""
    lines = _contents_lines(glyphs)
    order = Window.partitionBy("para").orderBy("line")
    entry = F.last("mark", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("entry", entry)
    ends = F.col("mark").isNotNull() | F.col("left").isNull() | (F.col("left") - F.col("entry.left") < F.col("entry.size"))  # else it belongs to the entry before it
    lines = lines.withColumn("ends", F.col("entry").isNotNull() & ends).withColumn("falls", F.coalesce(F.col("mark.number") < F.col("entry.number"), F.lit(False)))
    per = lines.groupBy("para", "entry.line").agg(
        F.min(F.when(F.col("ends"), lines["line"])).alias("end"), F.max("label").alias("label"), F.max(lines["line"]).alias("last"), F.count("mark").alias("marks"), F.bool_or("falls").alias("falls")
    )
    para = per.groupBy("para").agg(
        F.array_sort(F.collect_list(F.col("end") - 1)).alias("cuts"), F.max("label").alias("label"), (F.max("last") + 1).alias("n"), F.sum("marks").alias("marks"), F.bool_or("falls").alias("falls")
    )
    denied = F.coalesce(F.lower(F.trim("label")).isin(*DENIED), F.lit(False))
    reason = (
        F.when(denied, "deny_layout").when(F.col("n") < 2, "too_short").when(F.col("marks") < 2, "few_tail_lines").when(F.col("marks") / F.col("n") < 0.6, "low_fraction")
        .when(F.col("falls"), "not_monotonic").when(F.size("cuts") > 0, "fired").otherwise("no_cut_points")
    )
    return para.select("para", reason.alias("reason"), F.when(reason == "fired", F.array_join(F.col("cuts").cast("array<string>"), ",")).otherwise("").alias("cuts"))


def expected_pages(seen: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pages of (job, first, last) that were not observed, and observed pages outside, as (job, page, what)."""
    want = bounds.select("job", F.explode(F.sequence("first", "last")).alias("page")).withColumn("e", F.lit(True))
    both = want.join(seen.select("job", "page").distinct().withColumn("o", F.lit(True)), ["job", "page"], "full")
    return both.where("e is null or o is null").select("job", "page", F.when(F.col("o").isNull(), "missing").otherwise("unexpected").alias("what"))


def parse_method(requested: Column, file_type: Column) -> Column:
    return F.when(file_type == "epub", F.lit(None)).when(requested != "auto", requested).when(file_type == "pdf_digital", "txt").otherwise("ocr")


def prompt(text: Column, glossary: Column, lang: Column) -> Column:
    """Source, glossary and unit hints as one prompt; dollar signs are doubled for the template."""
    low = F.lower(text)
    hint = F.exists(F.array(*map(F.lit, L.UNIT_HINTS)), lambda u: F.contains(low, u))
    return F.concat_ws("\n", F.concat(F.lit("source: "), F.coalesce(lang, F.lit("en"))), F.when(F.coalesce(glossary, F.lit("")) != "", glossary), F.when(hint, F.lit("convert units")), F.replace(text, F.lit("$"), F.lit("$$")))


def unit_section() -> str:
    """The rules for measures and the table of ingredients, as a part of a prompt."""
    rules = [f"- {unit}: {rule}" for unit, rule in L.UNIT_RULES]
    return "\n".join(["Convert measures in recipes only:", *rules, "| ingredient | 1 cup |", "| --- | --- |", *(f"| {name} | {weight} |" for name, weight in L.CUP_WEIGHTS)])


def prompt_variant(variant: str, parts: dict[str, str], glossary: Column, source: Column | None = None, lang: Column | None = None) -> Column:
    """A prompt of ``parts`` (intro with {lang}, instruction, no_glossary, rules, footer), in one of three variants.

    ``system``: everything, measures too. ``template``: goes through a template with ``${text}``, so dollar signs of what is
    put in are doubled, and a footer without that place is refused. ``plain``: like the template's, but without template signs and footer. The last two
    hold the section on measures only where ``source`` has a hint of one, or where there is no source to look at. An empty
    or null glossary is the part no_glossary."""
    if variant not in ("system", "template", "plain"):
        raise ValueError(f"no such variant: {variant}")
    if variant == "template" and "${text}" not in "".join(parts.values()):
        raise ValueError("the template has no place for the text: ${text}")
    own = (lambda c: F.replace(c, F.lit("$"), F.lit("$$"))) if variant == "template" else (lambda c: c)
    none = F.coalesce(glossary, F.lit("")) == ""
    given = F.when(none, F.lit(parts["no_glossary"])).otherwise(F.concat(F.lit(parts["instruction"] + "\n\n"), own(glossary)))
    hint = F.lit(True) if variant == "system" or source is None else F.exists(F.array(*map(F.lit, L.UNIT_HINTS)), lambda u: F.contains(F.lower(source), u))
    units = F.when(F.coalesce(hint, F.lit(True)), own(F.lit(unit_section())))
    intro = F.replace(F.lit(parts["intro"]), F.lit("{lang}"), F.coalesce(lang, F.lit("en")) if lang is not None else F.lit("en"))
    return F.concat_ws("\n\n", intro, given, units, F.lit(parts["rules"]), *([F.lit(parts["footer"])] if variant == "template" else []))


def payload(htmls: Column) -> Column:
    """A request's JSON: [{"id": "0", "html": ...}, ...], a space after commas and colons, characters beyond ASCII as they are."""
    quoted = lambda h: F.regexp_extract(F.to_json(F.array(F.coalesce(h, F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    each = F.transform(htmls, lambda h, i: F.concat(F.lit('{"id": "'), i.cast("string"), F.lit('", "html": '), quoted(h), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def chunk_texts(pages: DataFrame, chunks: DataFrame, width: int = 40) -> DataFrame:
    """``pages`` (job_id, page, text) of ``chunks`` (job_id, chunk_index, page_start, page_end) as one text a chunk: (job_id, chunk_index, pages, text, segments).

    Pages are joined by line ends, in order; segments are the lines that aren't blank, 1 at least. A page in an overlap is in
    two chunks. Ranges meet pages by buckets, so neither a job nor a book is gathered, only a chunk's pages."""
    bucket = lambda c: F.floor(F.col(c) / width)
    ranges = chunks.where("page_start <= page_end").withColumn("_bucket", F.explode(F.sequence(bucket("page_start"), bucket("page_end"))))
    near = pages.withColumn("_bucket", bucket("page")).join(ranges, ["job_id", "_bucket"]).where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    whole = near.groupBy("job_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    text = F.array_join(F.col("p.text"), "\n")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return whole.select("job_id", "chunk_index", F.size("p").alias("pages"), text.alias("text")).withColumn("segments", F.greatest(lines, F.lit(1)))


def overlay(layers: DataFrame, owner: list[str]) -> DataFrame:
    """``layers`` (owner columns, layer, key, value) laid over each other: of each key the value of the last layer that has it, the greatest of
    equal layers; a null key is none. Values are compared by a map-side half, so a key that many layers set is no hot spot."""
    return layers.where("key is not null").groupBy(*owner, "key").agg(F.max_by("value", F.struct("layer", "value")).alias("value"))


def payload_length(htmls: Column) -> Column:
    """Length of a request's JSON with a space after commas and colons, ids from 0, and quotes and backslashes escaped."""
    each = F.transform(htmls, lambda h, i: F.length(i.cast("string")) + F.length(h) + F.regexp_count(h, F.lit('["\\\\\\n\\t]')) + F.lit(len('{"id": "", "html": ""}')))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) + F.greatest(F.size(htmls) - 1, F.lit(0)) * 2 + 2


def bounding_boxes(lines: DataFrame, key: list[str]) -> DataFrame:
    """Box of each group's lines and its mean font size; sizes of 0 or less don't count, 11 without any."""
    return lines.groupBy(*key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.coalesce(F.avg(F.when(F.col("font") > 0, F.col("font"))), F.lit(11.0)), 9).alias("font"))
