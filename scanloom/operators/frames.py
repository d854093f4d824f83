"""Frames, transfer syntaxes, transcode plans and pixel statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.values import number_of_frames
from scanloom.model import (
    AVAILABLE_TRANSFER_SYNTAX, CANONICAL_UNCOMPRESSED, EQUIVALENT_UNCOMPRESSED, transfer_syntaxes,
)

# Source syntax -> needs decoding, alias used by the recompress option.
TRANSCODE_SOURCES: list[tuple[str, bool, str]] = [
    ("1.2.840.10008.1.2", True, "uncompressed"),
    ("1.2.840.10008.1.2.1", False, "uncompressed"),
    ("1.2.840.10008.1.2.2", True, "uncompressed"),
    ("1.2.840.10008.1.2.4.50", True, "jpeg"),
    ("1.2.840.10008.1.2.4.57", True, "jls"),
    ("1.2.840.10008.1.2.4.70", True, "jpll"),
    ("1.2.840.10008.1.2.4.80", True, "jls"),
    ("1.2.840.10008.1.2.4.90", True, "jp2"),
    ("1.2.840.10008.1.2.4.91", True, "jp2"),
    ("3.2.840.10008.1.2.4.96", True, "jhc"),
    ("1.2.840.10008.1.2.4.202", True, "jhc"),
    ("1.2.840.10008.1.2.5", True, "rle"),
]
# Target name -> syntax, needs encoding.
TRANSCODE_TARGETS: dict[str, tuple[str, bool]] = {
    "lei": ("1.2.840.10008.1.2.1", False),
    "jls": ("1.2.840.10008.1.2.4.80", True),
    "jls-lossy": ("1.2.840.10008.1.2.4.81", True),
    "jp2": ("1.2.840.10008.1.2.4.90", True),
    "jp2-lossy": ("1.2.840.10008.1.2.4.91", True),
    "jhc": ("1.2.840.10008.1.2.4.201", True),
    "jhc-lossy": ("1.2.840.10008.1.2.4.202", True),
    "jpeg": ("1.2.840.10008.1.2.4.50", True),
}


def canonical_syntax(syntax: Column) -> Column:
    return F.when(syntax.isin(*EQUIVALENT_UNCOMPRESSED), CANONICAL_UNCOMPRESSED).otherwise(syntax)


def with_transfer_syntax(df: DataFrame, column: str = "transfer_syntax") -> DataFrame:
    """Content type, extension, gzip, lossy, uncompressed and video type of each row's syntax.

    The dimension has a fixed number of rows, hence the broadcast. Unknown syntaxes are
    plain octet streams.
    """
    dim = transfer_syntaxes(df.sparkSession).withColumnRenamed("transfer_syntax", "_uid")
    rows = df.join(F.broadcast(dim), canonical_syntax(F.col(column)) == F.col("_uid"), "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("gzip", "lossy", "uncompressed")]
    return rows.select(
        *df.columns,
        F.coalesce("content_type", F.lit("application/octet-stream")).alias("content_type"),
        "extension", *flags, "video_type",
    )


def frame_rows(instances: DataFrame, keys: list[str], frames: str = "n_frames", syntax: str = "transfer_syntax") -> DataFrame:
    """One row per frame, numbered from 1, with file name and part header."""
    typed = with_transfer_syntax(instances.select(*keys, frames, syntax), syntax)
    n = number_of_frames(F.col(frames))
    # Outer: the sequence is never empty, and no "not empty" filter has to build it twice.
    rows = typed.where(n > 0).withColumn("frame_no", F.explode_outer(F.sequence(F.lit(1), n)))
    number = F.col("frame_no").cast("string")
    # Only plain little/big endian variants are canonicalised in the header.
    named = canonical_syntax(F.col(syntax))
    return rows.select(
        *keys, "frame_no",
        F.concat(F.lit("frames/"), number, F.when(F.col("gzip"), ".mht.gz").otherwise(".mht")).alias("file_name"),
        F.concat(
            F.col("content_type"),
            F.when(F.col(syntax).isNull(), "").otherwise(F.concat(F.lit(";transfer-syntax="), named)),
        ).alias("part_type"),
    )


def transcode_plan(
    images: DataFrame, grey: str = "jls", color: str = "jls", recompress: Sequence[str] = ("uncompressed", "jp2", "rle"),
    recompress_color: Sequence[str] = ("uncompressed",), force: bool = False,
) -> DataFrame:
    """What to do with the pixels of each image: copy, decode, encode or transcode.

    The targets are names of :data:`TRANSCODE_TARGETS` or their syntaxes.

    ``images(transfer_syntax, samples, planar, photometric, target_syntax)``. Planar and
    palette images are copied, as are those whose source is not listed for recompression
    or whose requested syntax is not the configured target. ``available_syntax`` is that of the pixels as they will
    be stored, so copied ones keep their own.
    """
    spark = images.sparkSession
    source = spark.createDataFrame(TRANSCODE_SOURCES, "_uid string, _decode boolean, _alias string")
    rows = images.join(F.broadcast(source), F.col("transfer_syntax") == F.col("_uid"), "left")
    is_color = F.coalesce(F.col("samples") == 3, F.lit(False))

    by_syntax = {syntax: (syntax, encode) for syntax, encode in reversed(TRANSCODE_TARGETS.values())}

    def target(i: int) -> Column:
        g, c = [TRANSCODE_TARGETS.get(name) or by_syntax.get(name) for name in (grey, color)]
        return F.when(is_color, F.lit(c and c[i])).otherwise(F.lit(g and g[i]))

    def listed(names: Sequence[str]) -> Column:
        return F.lit("true" in names) | F.col("_alias").isin(*names) if names else F.lit(False)

    wanted = F.when(is_color, listed(recompress_color)).otherwise(listed(recompress))
    possible = F.col("_uid").isNotNull() & target(0).isNotNull()
    retag = F.coalesce(possible & wanted, F.lit(False))
    done = (
        retag
        & ~F.coalesce(F.col("planar") == 1, F.lit(False))
        & ~F.coalesce(F.col("photometric") == "PALETTE COLOR", F.lit(False))
        & (F.coalesce(F.col("target_syntax") == target(0), F.lit(True)) | F.lit(force))
    )
    op = (
        F.when(~done, "copy")
        .when(F.col("_decode") & target(1), "transcode")
        .when(F.col("_decode"), "decode")
        .when(target(1), "encode")
        .otherwise("copy")
    )
    return rows.select(
        *images.columns, op.alias("op"),
        F.when(done, target(0)).otherwise(F.col("transfer_syntax")).alias("available_syntax"),
    )


def retag_available_syntax(ds: Column, syntax: Column) -> Column:
    """Put the planned syntax into the internal tag, if the dataset has that tag."""
    return F.transform_values(
        ds,
        lambda k, v: F.when(k == AVAILABLE_TRANSFER_SYNTAX, v.withField("Value", F.array(syntax))).otherwise(v),
    )


def min_max(pixels: Column) -> Column:
    return F.struct(F.array_min(pixels).alias("min"), F.array_max(pixels).alias("max"))


def default_window(lo: Column, hi: Column, slope: Column, intercept: Column, color: Column) -> Column:
    """Window over the whole value range; colour images have a fixed one."""
    low, high = lo * slope + intercept, hi * slope + intercept
    return F.struct(
        F.when(color, F.lit(256.0)).otherwise(high - low + 1).alias("width"),
        F.when(color, F.lit(128.0)).otherwise((high + low + 1) / 2).alias("center"),
    )


def quantize(pixels: Column) -> Column:
    """Floats to 16-bit integers: slope, intercept, values and their range.

    A constant frame has slope 0; all its pixels become 0.
    """
    px = F.transform(pixels, lambda x: x.cast("double"))
    lo, hi = F.array_min(px), F.array_max(px)
    slope = (hi - lo) / F.lit(65535)
    values = F.transform(
        px, lambda x: F.when(slope == 0, F.lit(0)).otherwise(F.floor(F.try_divide(x - lo, slope)).cast("int"))
    )
    return F.struct(
        slope.alias("slope"), lo.alias("intercept"), values.alias("values"),
        F.array_min(values).alias("min"), F.array_max(values).alias("max"),
    )


def series_range(frames: DataFrame, keys: list[str], pixels: str) -> DataFrame:
    """Smallest and largest pixel over all frames of a group."""
    return frames.groupBy(*keys).agg(
        F.min(F.array_min(pixels)).alias("min"), F.max(F.array_max(pixels)).alias("max")
    )
