"""Options, gates and guards as columns: what is eligible, what is worth keeping, which of several candidates wins."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Options:
    target_dpi: float = 130.0
    quality: int = 78
    margin: float = 1.15
    figure_dpi: float | None = None
    pack: bool = True
    downsample_flate: bool = True
    subset_fonts: bool = True
    jbig2: bool = True
    allow_lossy: bool = False
    strip_accessibility: bool = False
    strip_metadata: bool = False
    strip_private_data: bool = False
    flatten_forms: bool = False
    signatures: str = "warn"
    backend: str = "zlib"

    def with_(self, **changes) -> Options:
        """Changed options; a figure DPI that is not finite and above zero is off."""
        new = replace(self, **changes)
        f = new.figure_dpi
        return new if f is None or 0 < f < float("inf") else replace(new, figure_dpi=None)


def resolve_flag(on: Column, off: Column, default: bool) -> Column:
    """A pair of flags by their places on the command line (null: absent): the last wins."""
    return F.when(on.isNull() & off.isNull(), F.lit(default)).otherwise(F.coalesce(on, F.lit(-1)) > F.coalesce(off, F.lit(-1)))


def filter_class(filters: Column) -> Column:
    """Encoding class of a stream by its filter chain: one filter, alone or in an array of one."""
    one = F.get(filters, F.lit(0))
    named = {"DCTDecode": "Dct", "FlateDecode": "Flate", "CCITTFaxDecode": "Ccitt", "JPXDecode": "Jpx", "JBIG2Decode": "Jbig2"}
    found = F.lit("Other")
    for name, kind in named.items():
        found = F.when((F.size(filters) == 1) & (one == name), kind).otherwise(found)
    return found


def channels(space: Column, icc_n: Column) -> Column:
    """Samples a pixel of a colour space name; null where it is not supported."""
    return F.when(space.isin("DeviceGray", "CalGray"), 1).when(space.isin("DeviceRGB", "CalRGB"), 3).when(space == "DeviceCMYK", 4).when((space == "ICCBased") & icc_n.isin(1, 3, 4), icc_n)


def effective_dpi(pixels: Column, points: Column) -> Column:
    return pixels * 72.0 / points


def oversized(width: Column, height: Column, w_pts: Column, h_pts: Column, o: Options = Options()) -> Column:
    """Target size (w, h) of an image that has more resolution than its largest placement shows; null if it stays. Both sides have to become strictly smaller."""
    over = F.greatest(effective_dpi(width, w_pts), effective_dpi(height, h_pts)) > o.target_dpi * o.margin
    w, h = (F.greatest(F.round(p * o.target_dpi / 72.0), F.lit(1.0)).cast("long") for p in (w_pts, h_pts))
    ok = (w_pts > 0) & (h_pts > 0) & (width > 0) & (height > 0)
    return F.when(ok & over & (w < width) & (h < height), F.struct(w.alias("w"), h.alias("h")))


def raster_fits(width: Column, height: Column, samples: Column, limit: int = 268435456) -> Column:
    wide = "decimal(38,0)"
    return width.cast("decimal(12,0)").cast(wide) * height.cast("decimal(12,0)") * samples.cast("decimal(4,0)") <= F.lit(limit)


def scale_numerator(width: Column, height: Column, w: Column, h: Column) -> Column:
    """The smallest n of n/8 such that the scaled image still covers the target on both axes."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(8)), lambda n: (F.ceil(width * n / 8) >= w) & (F.ceil(height * n / 8) >= h))
    return F.coalesce(F.array_min(fits), F.lit(8))


PAIR_COST = 64


def pair_declined(base: Column, mask: Column, original: Column) -> Column:
    """Whether a base and mask pair saves less than five percent."""
    return (base + mask + PAIR_COST) * 100 >= original * 95


def saves_enough(new: Column, old: Column, strict_only: Column) -> Column:
    """A resize has to be smaller, anything else at least five percent smaller."""
    return F.when(strict_only, new < old).otherwise(new * 100 < old * 95)


def cheapest(candidates: DataFrame, by: list[str], cost: str, rank: str, columns: list[str]) -> DataFrame:
    """The candidate of least cost of each group; ties go to the lower rank."""
    best = candidates.groupBy(*by).agg(F.min(F.struct(cost, rank, *columns)).alias("__b"))
    return best.select(*by, *[F.col("__b")[c].alias(c) for c in (cost, rank, *columns)])


def keep_smaller(output: Column, original: Column) -> Column:
    """The output if it is strictly smaller, else the original; null output is a failure."""
    return F.when(output.isNotNull() & (F.octet_length(output) < F.octet_length(original)), output).otherwise(original)


def top_share(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """by, total, top1, topk: how many of a group's values are the most frequent one, and among the k most frequent; ties by value."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value)))
    return ranked.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("r") == 1, F.col("n")).otherwise(0)).alias("top1"), F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)).alias("topk"))


def line_art(background: Column, palette: Column, edges: Column) -> Column:
    return (background >= 0.75) & (palette >= 0.90) & (edges <= 0.08)


def figure(background: Column, edges: Column) -> Column:
    return (background >= 0.25) & (background < 0.75) & (edges >= 0.10)


def minify_number(literal: Column) -> Column:
    """The shortest literal of the same decimal value; what is no plain decimal stays."""
    bare = F.regexp_replace(F.regexp_replace(literal, r"^\+", ""), r"^(-?)0+(?=[0-9.])", "$1")
    cutoff = F.regexp_replace(F.regexp_replace(bare, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    done = F.when(cutoff.isin("", "-", "0", "-0"), "0").otherwise(cutoff)
    return F.when(literal.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), done).otherwise(literal)


def strip_subset_tag(name: Column) -> Column:
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def burn_matrix(box: list[Column], rect: list[Column]) -> Column:
    """The matrix [a 0 0 d e f] that maps an appearance's box onto a rectangle; null for an empty box."""
    bx0, bx1 = F.least(box[0], box[2]), F.greatest(box[0], box[2])
    by0, by1 = F.least(box[1], box[3]), F.greatest(box[1], box[3])
    rx0, rx1 = F.least(rect[0], rect[2]), F.greatest(rect[0], rect[2])
    ry0, ry1 = F.least(rect[1], rect[3]), F.greatest(rect[1], rect[3])
    a, d = (rx1 - rx0) / (bx1 - bx0), (ry1 - ry0) / (by1 - by0)
    return F.when((bx1 > bx0) & (by1 > by0), F.struct(a.alias("a"), d.alias("d"), (rx0 - a * bx0).alias("e"), (ry0 - d * by0).alias("f")))


def balanced(ops: DataFrame, by: list[str], seq: str, step: str) -> DataFrame:
    """by, ok: whether openings and closings (step 1, -1) nest in each group and end at depth zero."""
    depth = F.sum(step).over(Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return ops.withColumn("depth", depth).groupBy(*by).agg(((F.min("depth") >= 0) & (F.sum(step) == 0)).alias("ok"))


def role_census(streams: DataFrame, by: list[str], role: str, size: Column, top: int | None = 12) -> DataFrame:
    """Bytes, count and share of each role, the largest first, with their place; bounded to the top rows of each group if top is given."""
    summed = streams.groupBy(*by, role).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ranked = summed.withColumn("share", F.round(F.col("bytes") / F.sum("bytes").over(whole), 6)).withColumn("place", F.row_number().over(whole.orderBy(F.desc("bytes"), role)))
    return ranked.where(F.col("place") <= top) if top else ranked


def merge_headroom(members: DataFrame, by: str, size: str) -> DataFrame:
    """What merging each family to its largest member could save."""
    return members.groupBy(by).agg(F.count(F.lit(1)).alias("members"), (F.sum(size) - F.max(size)).alias("headroom"))


def mirrored(fields: DataFrame, leaves: DataFrame, by: str, agrees: Column) -> DataFrame:
    """by, matches, ok: of each field, how many leaves carry its name and whether there are some and all agree."""
    met = fields.join(leaves, by, "left").withColumn("__agrees", agrees)
    return met.groupBy(by).agg(F.count("__agrees").alias("matches"), F.coalesce((F.count("__agrees") > 0) & F.bool_and("__agrees"), F.lit(False)).alias("ok"))
