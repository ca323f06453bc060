"""Checks of page layout on tables of boxes; a box is the columns x0, y0, x1, y1.

Boxes meet by cells of a grid over the page: each is dealt to the cells that it touches, and a pair counts in the cell of its
common corner. So a page of very many boxes is spread, and only neighbours are compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area(p: str = "") -> Column:
    return F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(0.0))


def shared_area(p: str = "", q: str = "o_") -> Column:
    w = F.least(F.col(f"{p}x1"), F.col(f"{q}x1")) - F.greatest(F.col(f"{p}x0"), F.col(f"{q}x0"))
    h = F.least(F.col(f"{p}y1"), F.col(f"{q}y1")) - F.greatest(F.col(f"{p}y0"), F.col(f"{q}y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def other(boxes: DataFrame) -> DataFrame:
    """The same boxes with ``o_`` before all names but the page."""
    return boxes.withColumnsRenamed({c: f"o_{c}" for c in boxes.columns if c != "page"})


def meeting(blocks: DataFrame, others: DataFrame, cell: float, most: int = 256) -> DataFrame:
    """Pairs of boxes of a page that share an area, each once, with the areas ``a`` and ``b`` and the shared one ``s``.

    Boxes without an area, or with a corner that is no finite number, meet nothing. ``cell`` is the side of a grid cell, about the
    size of a box. A box of more than ``most`` cells (a wrong coordinate can make it any number) isn't dealt to cells: it meets the boxes of its page."""

    def proper(boxes: DataFrame, p: str) -> DataFrame:
        corners = [F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")]
        finite = reduce(lambda x, y: x & y, (F.abs(c) < float("inf") for c in corners))
        return boxes.where(finite & (corners[2] > corners[0]) & (corners[3] > corners[1])).withColumn(f"{p}_large", (across(p, "x") * across(p, "y")) > most)

    def across(p: str, axis: str) -> Column:
        return F.floor(F.col(f"{p}{axis}1") / cell).cast("double") - F.floor(F.col(f"{p}{axis}0") / cell).cast("double") + 1

    def dealt(boxes: DataFrame, p: str) -> DataFrame:
        along = lambda axis: F.sequence(F.floor(F.col(f"{p}{axis}0") / cell), F.floor(F.col(f"{p}{axis}1") / cell))
        return boxes.where(~F.col(f"{p}_large")).withColumn("_cx", F.explode(along("x"))).withColumn("_cy", F.explode(along("y")))

    left, right = proper(blocks, ""), proper(other(others), "o_")
    pairs = dealt(left, "").join(dealt(right, "o_"), ["page", "_cx", "_cy"])
    corner = lambda axis: F.floor(F.greatest(F.col(f"{axis}0"), F.col(f"o_{axis}0")) / cell)
    near = pairs.where((F.col("_cx") == corner("x")) & (F.col("_cy") == corner("y"))).drop("_cx", "_cy")
    wide = left.where("_large").join(right, "page").unionByName(left.where("not _large").join(right.where("o__large"), "page"))
    both = near.unionByName(wide).drop("_large", "o__large")
    return both.withColumn("a", area()).withColumn("b", area("o_")).withColumn("s", shared_area()).where("s > 0")


#: Side of a grid cell in points.
CELL = 128.0


def overlaps(blocks: DataFrame, least: float = 0.05) -> DataFrame:
    """Pairs of blocks of a page that share more than ``least`` of the smaller one's area."""
    pairs = meeting(blocks, blocks, CELL).where("block < o_block")
    ratio = F.col("s") / F.least("a", "b")
    return pairs.select("page", "block", "o_block", ratio.alias("ratio")).where(F.col("ratio") > least)


def over_border(blocks: DataFrame, borders: DataFrame, least: float = 0.05) -> DataFrame:
    """Text that crosses a border: more than ``least`` of it inside, and not all of it."""
    return meeting(blocks, borders, CELL).where("s < a - 1e-6").select("page", "block", "o_block", (F.col("s") / F.col("a")).alias("ratio")).where(F.col("ratio") > least)


def over_image(blocks: DataFrame, images: DataFrame, least: float = 0.05) -> DataFrame:
    """Text that lies on an image by more than ``least`` (0 or more) of its area."""
    return meeting(blocks, images, CELL).select("page", "block", "o_block", (F.col("s") / F.col("a")).alias("ratio")).where(F.col("ratio") > least)


def best_match(blocks: DataFrame, targets: DataFrame, least: float = 0.05) -> DataFrame:
    """For each block the target with the largest intersection over union, the first on ties, if it is at least ``least``."""
    pairs = meeting(blocks, targets, CELL)
    iou = F.col("s") / (F.col("a") + F.col("b") - F.col("s"))
    best = F.max_by(F.struct("o_block", F.col("iou")), F.struct(F.col("iou"), -F.col("o_block")))
    return pairs.withColumn("iou", iou).where(F.col("iou") >= least).groupBy("page", "block").agg(best.alias("m")).select("page", "block", F.col("m.o_block").alias("o_block"), F.col("m.iou").alias("iou"))


def rotation(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def is_rotated(angle: Column, slack: float = 0.1) -> Column:
    """Neither level nor upright, up to ``slack`` degrees."""
    off = lambda a: F.least(F.pmod(angle - a, F.lit(180.0)), 180.0 - F.pmod(angle - a, F.lit(180.0)))
    return (off(0.0) > slack) & (off(90.0) > slack)


def rotated_groups(lines: DataFrame, gap: float = 1.8) -> DataFrame:
    """Blocks of lines (page, line, x, y, angle, font): one angle in whole degrees, in order across the text, cut at wide gaps."""
    turn = F.bround("angle", 0)
    across = -F.col("x") * F.sin(F.radians(turn)) + F.col("y") * F.cos(F.radians(turn))
    placed = lines.select("page", "line", "font", turn.cast("int").alias("turn"), F.round(across, 6).alias("across"))
    w = Window.partitionBy("page", "turn").orderBy("across", "line")
    wide = F.col("across") - F.lag("across").over(w) > gap * F.greatest("font", F.lag("font").over(w))
    return placed.withColumn("cut", F.coalesce(wide, F.lit(False)).cast("int")).withColumn("block", F.sum("cut").over(w)).drop("cut")


def page_queue(findings: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Pages by the weight of their findings (page, check, severity), heaviest first."""
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("severity")]
    per = findings.withColumn("w", F.coalesce(weight, F.lit(0)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("k"), "seq", "check"))), lambda x: x["check"])
    pages = per.groupBy("page").agg(F.sum("w").alias("score"), F.concat_ws(",", listed).alias("checks"))
    return pages


def line_groups(glyphs: DataFrame, step: float = 1.0) -> DataFrame:
    """Glyphs (para, glyph, y0, y1) to lines: bins of ``step`` that no glyph touches separate them, from the top.

    Touched bins come from a difference array: +1 where a glyph begins, -1 after it ends, and a running sum."""
    lo, hi = F.floor(F.col("y0") / step), F.floor(F.col("y1") / step)
    edges = glyphs.select("para", lo.alias("bin"), F.lit(1).alias("d")).unionByName(glyphs.select("para", (hi + 1).alias("bin"), F.lit(-1).alias("d")))
    net = edges.groupBy("para", "bin").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("para").orderBy("bin")
    level = net.withColumn("level", F.sum("d").over(w))
    begins = level.withColumn("before", F.coalesce(F.lag("level").over(w), F.lit(0))).where("level > 0 and before = 0").select("para", F.col("bin").alias("begin"))
    spans = begins.withColumn("next", F.lead("begin").over(Window.partitionBy("para").orderBy("begin"))).withColumn("line", F.row_number().over(Window.partitionBy("para").orderBy(F.desc("begin"))))
    placed = glyphs.withColumn("_b", lo).join(spans, "para").where((F.col("_b") >= F.col("begin")) & (F.col("next").isNull() | (F.col("_b") < F.col("next"))))
    return placed.select("para", "glyph", "line")


def fit(width: Column, text_width: Column, size: Column) -> tuple[Column, Column]:
    """(decision, font size): fits; shrunk to 80 % at least; condensed to 85 % on top; else overflow."""
    small = F.greatest(0.8 * size, size * width / text_width)
    shrunk = text_width * small / size
    decision = F.when(text_width <= width, "fits").when(shrunk <= width + 1e-9, "shrunk").when(shrunk * 0.85 <= width + 1e-9, "condensed").otherwise("overflow")
    return decision, F.when(text_width <= width, size).otherwise(small)


def fit_lines(spans: DataFrame) -> DataFrame:
    """``spans`` (line, span, text, width of the block, text_width, size) of lines whose spans share one ratio: the least that any of them needs.

    (line, span, size, scale, overflow, repack): at the line's ratio a span fits, is condensed, or overflows all the same; a line without
    an overflow is laid out anew. Lines whose spans all fit, and spans that show nothing, are left out."""
    shown = spans.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    _, size = fit(F.col("width"), F.col("text_width"), F.col("size"))
    ratio = shown.groupBy("line").agg(F.min(size / F.col("size")).alias("ratio")).where("ratio < 1")
    at = shown.join(ratio, "line").withColumn("needed", F.col("text_width") * F.col("ratio"))
    scale = F.when(F.col("needed") <= F.col("width") + 1e-9, 1.0).otherwise(0.85)
    each = at.select("line", "span", (F.col("size") * F.col("ratio")).alias("size"), scale.alias("scale"), (F.col("needed") * 0.85 > F.col("width") + 1e-9).alias("overflow"))
    lines = each.groupBy("line").agg((~F.bool_or("overflow")).alias("repack"))
    return each.join(lines, "line")


# Codecs of images, channels by colour space, least bytes, bits of a channel.
CODECS = ["DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode"]
CHANNELS = {"DeviceGray": [1], "DeviceRGB": [3], "DeviceCMYK": [4], "ICCBased": [1, 3, 4]}
LEAST_BYTES, BITS = 4096, 8


def image_reason(filters: Column, masked: Column, raw: Column, bits: Column, space: Column, channels: Column, jpeg: Column) -> Column:
    """Why an image is recompressed or not, the first reason: codec, masked, small, depth, colours, not_smaller or compressed. ``filters``: names, in order; none is
    no filter, and any list must hold FlateDecode and no codec of images."""
    plain = F.coalesce(F.size(filters) < 1, F.lit(True)) | (F.array_contains(filters, "FlateDecode") & ~F.arrays_overlap(filters, F.array(*map(F.lit, CODECS))))
    fits_ = reduce(lambda a, b: a | b, ((space == name) & channels.isin(n) for name, n in CHANNELS.items()))
    return (
        F.when(~plain, "codec").when(F.coalesce(masked, F.lit(False)), "masked").when(raw < LEAST_BYTES, "small").when(bits != BITS, "depth")
        .when(~F.coalesce(fits_, F.lit(False)), "colours").when(jpeg >= raw, "not_smaller").otherwise("compressed")
    )


def tail_number(line: Column) -> Column:
    """Page number at the end of a line of contents: 1 to 4 digits after a body with two letters in a row."""
    pattern = "^(.*[^0-9])([0-9]{1,4})$"
    n = F.regexp_extract(line, pattern, 2).try_cast("int")
    return F.when((n >= 1) & F.regexp_extract(line, pattern, 1).rlike("[A-Za-z]{2,}"), n)


def dropped(paragraphs: DataFrame, first: int, last: int) -> DataFrame:
    """Paragraphs (page, debug_id, text, rendered) of the pages ``first`` to ``last`` that were not drawn: they have a text and an id, but
    no drawn character. With the text's length and its first 400 characters."""
    gone = paragraphs.where(F.col("page").between(first, last) & (F.coalesce("rendered", F.lit(0)) == 0) & (F.coalesce(F.trim("text"), F.lit("")) != "") & F.col("debug_id").isNotNull())
    return gone.select("page", "debug_id", F.length("text").alias("text_len"), F.substring("text", 1, 400).alias("text_excerpt"))
