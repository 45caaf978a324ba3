"""Spans on OCR lines: offsets, polygons, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_offsets(lines: DataFrame, page: list[str], order: str = "line_idx", text: str = "text") -> DataFrame:
    """Adds char_start: each line's start in its page, lines joined by newlines."""
    w = Window.partitionBy(*page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("char_start", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)).cast("int"))


def span_lines(spans: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """A row a span and line it touches, with the part of the line it covers."""
    end = F.col("char_start") + F.length("text")
    j = spans.join(lines, page).where((F.col("start") < end) & (F.col("char_start") < F.col("end")))
    return j.withColumns({"line_from": F.greatest(F.lit(0), F.col("start") - F.col("char_start")), "line_to": F.least(F.length("text"), F.col("end") - F.col("char_start"))})


def polygon(box: Column, n: Column, start: Column, end: Column, padding: float = 0.0) -> Column:
    """Four points that cover a character range of a line's box; null for an empty line or another shape."""
    a = F.greatest(F.lit(0.0), start - padding) / n
    b = F.least(n.cast("double"), end + padding) / n

    def point(p: int, q: int, ratio: Column) -> Column:
        x, y = F.get(box, F.lit(p)), F.get(box, F.lit(q))
        at = lambda k: F.get(x, F.lit(k)) + (F.get(y, F.lit(k)) - F.get(x, F.lit(k))) * ratio
        return F.array(at(0), at(1))

    return F.when((n > 0) & (F.size(box) == 4), F.array(point(0, 1, a), point(0, 1, b), point(3, 2, b), point(3, 2, a)))


def bounds(poly: Column) -> Column:
    xs, ys = F.transform(poly, lambda p: F.get(p, F.lit(0))), F.transform(poly, lambda p: F.get(p, F.lit(1)))
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))


def meet(a: Column, b: Column) -> Column:
    """Whether two bounds share a point."""
    return ~((a["right"] < b["left"]) | (b["right"] < a["left"]) | (a["bottom"] < b["top"]) | (b["bottom"] < a["top"]))


def widened(b: Column) -> Column:
    """Bounds for one more try: a quarter of the width and 15 % of the height on each side, 3 and 2 at least."""
    x, y = F.greatest(F.lit(3.0), (b["right"] - b["left"]) * 0.25), F.greatest(F.lit(2.0), (b["bottom"] - b["top"]) * 0.15)
    return F.struct((b["left"] - x).alias("left"), (b["top"] - y).alias("top"), (b["right"] + x).alias("right"), (b["bottom"] + y).alias("bottom"))


def normalised(b: Column, width: Column, height: Column) -> Column:
    """Bounds as shares of the page: x, y, width, height, clamped, six digits."""
    x, y = F.least(F.greatest(b["left"] / width, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(b["top"] / height, F.lit(0.0)), F.lit(1.0))
    w, h = (b["right"] - b["left"]) / width, (b["bottom"] - b["top"]) / height
    return F.struct(F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(F.least(w, 1 - x), 6).alias("width"), F.round(F.least(h, 1 - y), 6).alias("height"))


def low_confidence(lines: DataFrame, least: float = 0.7) -> DataFrame:
    return lines.where(F.col("confidence") < least).withColumn("text_preview", F.substring("text", 1, 50))


def circularity(area: Column, perimeter: Column) -> Column:
    import math

    return F.when(perimeter == 0, F.lit(0.0)).otherwise(4 * math.pi * area / (perimeter * perimeter))


def largest_remainder(parts: DataFrame, group: list[str], size: str, total: str, order: str) -> DataFrame:
    """Adds share: ``total`` split in proportion to ``size``, remainders to the largest fractions."""
    w = Window.partitionBy(*group)
    exact = F.col(total) * F.col(size) / F.sum(size).over(w)
    out = parts.withColumn("_e", F.coalesce(exact, F.lit(0.0))).withColumn("_f", F.floor("_e"))
    left = F.col(total) - F.sum("_f").over(w)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.col("_e") - F.col("_f")), order))
    return out.withColumn("share", (F.col("_f") + F.when(rank <= left, 1).otherwise(0)).cast("int")).drop("_e", "_f")


def seals(contours: DataFrame, smallest: float = 0.0005, largest: float = 0.2, roundest: float = 0.3, thinnest: float = 0.3) -> DataFrame:
    """Contours that can be seals: by share of the page's area, by aspect and by roundness.

    contours: any columns and left, top, box_width, box_height, area, perimeter,
    ellipse_area (null where none was fitted), page_width, page_height. A contour
    that fills over 0.6 of its ellipse counts as 0.5 round at least.
    """
    share = F.col("area") / (F.col("page_width") * F.col("page_height"))
    longer = F.greatest("box_width", "box_height")
    aspect = F.when(longer > 0, F.least("box_width", "box_height") / longer).otherwise(0.0)
    own = circularity(F.col("area"), F.col("perimeter"))
    filled = F.when(F.col("ellipse_area") > 0, F.col("area") / F.col("ellipse_area"))
    kept = contours.withColumn("confidence", F.when(filled > 0.6, F.greatest(own, F.lit(0.5))).otherwise(own))
    kept = kept.where(share.between(smallest, largest) & (aspect >= thinnest) & (F.col("confidence") >= roundest))
    out = {"x": F.col("left") / F.col("page_width"), "y": F.col("top") / F.col("page_height"), "width": F.col("box_width") / F.col("page_width"), "height": F.col("box_height") / F.col("page_height"), "area_ratio": share}
    return kept.withColumns({k: F.round(v, 6) for k, v in out.items()} | {"confidence": F.round("confidence", 4)})


def residual_classes(found: DataFrame, masks: DataFrame, key: list[str], box: str = "box") -> DataFrame:
    """One row an entity still legible: did a mask of its own miss it, or has it none there?

    found: key and the bounds of each place it was read again (null where the
    place has none); masks: key and bounds.
    """
    own = masks.groupBy(*key).agg(F.collect_list(box).alias("_masks"))
    hit = F.exists("_masks", lambda m: meet(F.col(box), m))
    near = found.join(own, key, "left").groupBy(*key).agg(F.max(F.coalesce(hit, F.lit(False))).alias("_hit"))
    return near.select(*key, F.when(F.col("_hit"), "pixel_undercoverage").otherwise("unmapped_residual").alias("category"))
