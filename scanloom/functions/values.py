"""Column functions for values: sizes, durations, frame lists, binary data, image attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions.paths import bulk_path
from scanloom.functions.tags import is_private
from scanloom.model import BINARY_VRS

LEADING_NUMBER = r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"

# Colour photometric interpretations.
COLOR_PHOTOMETRIC = [
    "RGB", "PALETTE COLOR", "YBR_FULL", "YBR_FULL_422", "YBR_PARTIAL_422", "YBR_PARTIAL_420", "YBR_RCT", "YBR_ICT",
]
# X-ray angiography and fluoroscopy classes, which have no modality LUT.
NO_MODALITY_LUT = ["1.2.840.10008.5.1.4.1.1.12.1", "1.2.840.10008.5.1.4.1.1.12.2.1"]
# Objects kept in original form.
RAW_MODALITIES = ["SEG", "SR"]
RAW_SOP_CLASSES = ["1.2.840.10008.5.1.4.1.1.30"]
BASELINE_JPEG = "1.2.840.10008.1.2.4.50"


def parse_frame_list(text: Column, most: int = 100_000) -> Column:
    """``"1-3,17"`` to sorted distinct frame numbers, or an error. Empty text means frame 1.

    ``ranges`` has the sorted (lo, hi) pairs. ``frames`` lists single numbers only where the ranges hold ``most`` of them
    or fewer and is NULL beyond, so no request makes a row too large.
    """
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))

    def bounds(part: Column) -> Column:
        sides = F.split(part, "-")
        whole = lambda s: F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
        ranged = part.contains("-")
        return F.struct(
            part.alias("part"),
            F.when(ranged, whole(F.get(sides, F.lit(0)))).otherwise(whole(part)).alias("lo"),
            F.when(ranged, whole(F.get(sides, F.lit(1)))).otherwise(whole(part)).alias("hi"),
        )

    ranges = F.transform(parts, bounds)
    bad = F.filter(ranges, lambda r: r["lo"].isNull() | r["hi"].isNull() | (r["lo"] > r["hi"]))
    good = F.filter(ranges, lambda r: r["lo"].isNotNull() & r["hi"].isNotNull() & (r["lo"] <= r["hi"]))
    frames = F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda r: F.sequence(r["lo"], r["hi"])))))
    held = F.aggregate(good, F.lit(0).cast("bigint"), lambda n, r: n + (r["hi"].cast("bigint") - r["lo"].cast("bigint") + 1))
    pairs = F.array_sort(F.array_distinct(F.transform(good, lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi")))))
    first = F.array(F.struct(F.lit(1).alias("lo"), F.lit(1).alias("hi")))
    empty = F.coalesce(text, F.lit("")) == ""
    valid = F.size(bad) == 0
    return F.struct(
        F.when(empty, F.array(F.lit(1))).when(valid & (held <= most), frames).alias("frames"),
        F.when(~empty & ~valid, F.concat(F.lit("not a range of frames: "), F.get(bad, F.lit(0))["part"])).alias("error"),
        F.when(empty, first).when(valid, pairs).alias("ranges"),
    )


def parse_size(text: Column) -> Column:
    """``10k``, ``1.5GB``, ``2t``, ``123`` to bytes; NULL when invalid."""
    s = F.trim(text)
    low = F.lower(s)
    num = F.regexp_extract(F.regexp_replace(s, "[kmgtbKMGTB]", ""), LEADING_NUMBER, 1).try_cast("double")
    scale = (
        F.when(low.rlike("tb?$"), 1024.0**4)
        .when(low.rlike("gb?$"), 1024.0**3)
        .when(low.rlike("mb?$"), 1024.0**2)
        .when(low.rlike("kb?$"), 1024.0)
        .when(s.rlike(r"^[0-9]+([.][0-9]+)?$"), 1.0)
    )
    return F.when(num >= 0, F.floor(num * scale + 0.5).cast("bigint"))


def parse_duration(text: Column) -> Column:
    """``10h``, ``30m``, ``3600s``, ``3600`` to milliseconds; NULL when invalid."""
    s = F.lower(F.trim(text))
    num = F.regexp_extract(F.regexp_replace(s, "[hms]", ""), LEADING_NUMBER, 1).try_cast("double")
    scale = (
        F.when(s.endswith("h"), 3600000.0)
        .when(s.endswith("m"), 60000.0)
        .when(s.endswith("s") | s.rlike(r"^[0-9]+([.][0-9]+)?$"), 1000.0)
    )
    return F.when(num >= 0, F.floor(num * scale + 0.5).cast("bigint"))


def base64_text(data: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data), "\r\n", "")


def bulk_uri(data: Column) -> Column:
    return F.concat(F.lit("../../../../bulkdata/"), bulk_path(F.sha2(data, 256)))


def externalize(
    code: Column, vr: Column, data: Column, public_limit: int = 131074, private_limit: int = 128,
    vrs: list[str] = BINARY_VRS,
) -> Column:
    """Inline below the threshold, otherwise a content-addressed URI. ``data`` is binary.

    Without VR or tag there is no rule to move the data out, so it stays inline.
    """
    limit = F.when(is_private(code), private_limit).otherwise(public_limit)
    out = F.coalesce(vr.isin(*vrs) & (code != "7FE00010") & (F.octet_length(data) >= limit), F.lit(False))
    return F.struct(
        F.when(out, bulk_uri(data)).alias("BulkDataURI"),
        F.when(~out, base64_text(data)).alias("InlineBinary"),
    )


def value_size(value: Column, dtype: T.DataType) -> Column:
    """Estimated bytes of a (nested) value: text its length, number 4, boolean 2, null 2."""
    if isinstance(dtype, T.StringType):
        size = F.length(value)
    elif isinstance(dtype, T.BinaryType):
        size = F.octet_length(value)
    elif isinstance(dtype, T.BooleanType):
        size = F.lit(2)
    elif isinstance(dtype, T.ArrayType):
        size = F.aggregate(
            value, F.lit(0).cast("bigint"), lambda acc, x: acc + value_size(x, dtype.elementType)
        )
    else:
        size = F.lit(4)
    return F.when(value.isNull(), F.lit(2)).otherwise(size).cast("bigint")


def inline_binary(chunks: Column) -> Column:
    """Byte chunks concatenated, as base64."""
    empty = F.lit(b"")
    return base64_text(F.aggregate(chunks, empty, lambda acc, x: F.concat(acc, x)))


def frame_bytes(rows: Column, columns: Column, samples: Column, bits_allocated: Column) -> Column:
    """Size of one uncompressed frame."""
    return (rows.cast("bigint") * columns * samples * bits_allocated / 8).cast("bigint")


def number_of_frames(n: Column) -> Column:
    """Stated number of frames, 1 when missing, not a number or zero."""
    return F.coalesce(F.nullif(n.cast("string").try_cast("int"), F.lit(0)), F.lit(1))


def uid_errors(study: Column, series: Column, limit: int = 64) -> Column:
    """Names of the UIDs that are too long."""
    return F.array_compact(
        F.array(
            F.when(F.length(study) > limit, F.lit("StudyInstanceUID too long")),
            F.when(F.length(series) > limit, F.lit("SeriesInstanceUID too long")),
        )
    )


def map_diff(update: Column, base: Column) -> Column:
    """Entries of ``update`` that differ from ``base``; everything when there is no base."""
    changed = F.map_filter(
        F.map_zip_with(update, base, lambda _, n, o: F.struct(n.alias("n"), o.alias("o"))),
        lambda k, v: F.map_contains_key(update, k) & ~v["n"].eqNullSafe(v["o"]),
    )
    diff = F.transform_values(changed, lambda _, v: v["n"])
    return F.when(base.isNull(), update).otherwise(F.when(F.size(diff) > 0, diff))


def nested_map_diff(update: Column, base: Column) -> Column:
    """The same for a map of maps: only changed keys of changed sections."""
    diff = F.transform_values(update, lambda k, v: map_diff(v, base[k]))
    kept = F.map_filter(diff, lambda _, v: v.isNotNull())
    return F.when(base.isNull(), update).otherwise(F.when(F.size(kept) > 0, kept))


def pixel_type(bits: Column, representation: Column) -> Column:
    rep = F.coalesce(representation, F.lit(0))
    return (
        F.when(bits == 32, "float32").when((bits == 16) & (rep == 0), "uint16").when(bits == 16, "int16")
        .otherwise("uint8")
    )


def image_class(
    bits: Column, representation: Column, photometric: Column, samples: Column, syntax: Column, sop_class: Column
) -> Column:
    """Pixel type, colour, baseline-JPEG colour and modality-LUT flags of an image."""
    rep = F.coalesce(representation, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        pixel_type(bits, representation).alias("pixel_type"),
        (rep == 1).alias("signed"),
        yes(photometric.isin(*COLOR_PHOTOMETRIC)).alias("color"),
        yes((bits == 8) & (syntax == BASELINE_JPEG) & samples.isin(3, 4)).alias("baseline_jpeg_color"),
        (~yes(sop_class.isin(*NO_MODALITY_LUT))).alias("modality_lut"),
    )


def keep_raw(modality: Column, sop_class: Column) -> Column:
    """Default selector of objects whose original form is kept."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(modality.isin(*RAW_MODALITIES)) | yes(sop_class.isin(*RAW_SOP_CLASSES))
