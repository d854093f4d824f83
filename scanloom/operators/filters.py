"""Attribute queries compiled to plain column predicates, so they reach the parquet scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.model import TAGS, Dictionary
from scanloom.sources.sinks import study_bucket

# Keywords a compatible query knows, in lower case.
QUERY_ALIASES = {
    "studyinstanceuid": "StudyInstanceUID",
    "patientname": "PatientName",
    "patientid": "PatientID",
    "studydescription": "StudyDescription",
    "studydate": "StudyDate",
    "modalitiesinstudy": "ModalitiesInStudy",
    "accessionnumber": "AccessionNumber",
}

# Columns of the studies index by keyword; callers may give their own mapping.
STUDY_COLUMNS = {
    "StudyInstanceUID": "study_uid",
    "PatientName": "patient_name",
    "PatientID": "patient_id",
    "StudyDescription": "description",
    "StudyDate": "study_date",
    "StudyTime": "study_time",
    "ModalitiesInStudy": "modalities",
    "AccessionNumber": "accession",
}


def resolve_keyword(name: str, compat: bool = False, dictionary: Dictionary = TAGS) -> str | None:
    """Keyword of a query parameter given as keyword (any case) or hex tag.

    Unknown names are an error; a compatible query ignores all but its seven keywords
    and upper-case hex tags.
    """
    by_code = {code: keyword for keyword, (code, _) in dictionary.items()}
    if compat:
        return QUERY_ALIASES.get(name.lower()) or by_code.get(name)
    by_lower = {keyword.lower(): keyword for keyword in dictionary}
    keyword = by_lower.get(name.lower()) or by_code.get(name.upper())
    if keyword is None:
        raise ValueError(f"unknown query attribute {name}")
    return keyword


def match_text(col: Column, wanted: str, compat: bool = False) -> Column:
    """Exact or wildcard match of one text value; empty stored text matches."""
    if wanted in ("", "*"):
        return F.lit(True)
    if wanted.startswith("*") and wanted.endswith("*"):
        hit = col.contains(wanted[1:-1])
    elif wanted.endswith("*"):
        hit = col.contains(wanted[:-1]) if compat else col.startswith(wanted[:-1])
    elif wanted.startswith("*"):
        tail = wanted[1:]
        # Compatible mode looks at the first occurrence only, and "not found" counts as
        # position -1, which fits texts one character shorter than the pattern.
        hit = F.locate(tail, col) - 1 == F.length(col) - len(tail) if compat else col.endswith(tail)
    else:
        hit = col == wanted
    return hit | (col == "")


def match_value(col: Column, dtype: T.DataType, wanted: object, compat: bool = False) -> Column:
    """Any wanted value matches any stored value; names compare their alphabetic part."""
    if isinstance(wanted, (list, tuple)):
        plain = isinstance(dtype, T.StringType) and all(
            isinstance(w, str) and w and "*" not in (w[0], w[-1]) for w in wanted
        )
        if plain:
            return col.isin(*wanted, "")
        return reduce(lambda a, b: a | b, [match_value(col, dtype, w, compat) for w in wanted], F.lit(False))
    if isinstance(dtype, T.ArrayType):
        return F.exists(col, lambda x: match_value(x, dtype.elementType, wanted, compat))
    if isinstance(dtype, T.StructType) and "Alphabetic" in dtype.fieldNames():
        return match_value(col["Alphabetic"], dtype["Alphabetic"].dataType, wanted, compat)
    if isinstance(dtype, T.StringType):
        return match_text(col, str(wanted), compat)
    if wanted in ("", "*"):
        return F.lit(not compat)
    return F.coalesce(col == F.lit(wanted).try_cast(dtype), F.lit(False))


def match_date_range(col: Column, wanted: str, compat: bool = False) -> Column:
    """``a-b``, ``a-``, ``-b`` inclusive, or a plain match; dates are yyyyMMdd text."""
    if "-" not in wanted:
        return match_text(col, wanted, compat)
    start, end = wanted.split("-", 1)
    bounds = ([col >= start] if start else []) + ([col <= end] if end else [])
    return reduce(lambda a, b: a & b, bounds, F.lit(True)) | (col == "")


def qido_predicate(
    schema: T.StructType, params: Mapping[str, object], columns: Mapping[str, str] = STUDY_COLUMNS,
    required: Sequence[str] = (), compat: bool = False, dictionary: Dictionary = TAGS,
) -> Column:
    """All parameters combined with AND.

    A missing attribute matches. Columns in ``required`` are known to be present, so their
    predicate stays free of the NULL branch and can skip row groups.
    """
    terms = []
    for name, wanted in params.items():
        keyword = resolve_keyword(name, compat, dictionary)
        if not wanted or keyword not in columns or columns[keyword] not in schema.fieldNames():
            continue
        column = columns[keyword]
        field = schema[column]
        col = F.col(column)
        if dictionary[keyword][1] == "DA" and isinstance(wanted, str):
            first = F.get(col, F.lit(0)) if isinstance(field.dataType, T.ArrayType) else col
            term = match_date_range(first, wanted, compat)
        else:
            term = match_value(col, field.dataType, wanted, compat)
        if field.nullable and column not in required:
            term = term | col.isNull()
        terms.append(term)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def qido_filter(
    df: DataFrame, params: Mapping[str, object], columns: Mapping[str, str] = STUDY_COLUMNS,
    required: Sequence[str] = (), compat: bool = False, dictionary: Dictionary = TAGS,
) -> DataFrame:
    """Rows that satisfy every query parameter. ``dictionary`` adds attributes to the built-in ones."""
    return df.where(qido_predicate(df.schema, params, columns, required, compat, dictionary))


def single_uid(params: Mapping[str, str], keyword: str = "StudyInstanceUID") -> str | None:
    """Value of a UID parameter under any of its names."""
    names = {keyword.lower(), TAGS[keyword][0].lower()}
    return next((v for k, v in params.items() if k.lower() in names and v), None)


def single_uid_lookup(
    df: DataFrame, params: Mapping[str, str], keyword: str = "StudyInstanceUID", column: str = "study_uid",
    buckets: int | None = None,
) -> DataFrame:
    """Equality on the UID column when the parameters name one UID.

    On an archive stored in so many study ``buckets`` a study's bucket is looked up too, which prunes its folders.
    """
    uid = single_uid(params, keyword)
    if uid is None:
        return df
    rows = df.where(F.col(column) == uid)
    return rows.where(F.col("study_bucket") == study_bucket(F.lit(uid), buckets)) if buckets else rows


def select_studies(
    df: DataFrame, studies: DataFrame | Sequence[str] | None = None, series: str | None = None
) -> DataFrame:
    """Rows of the named studies; nothing, an empty list or ``*`` means all."""
    if isinstance(studies, DataFrame):
        df = df.join(studies.select("study_uid").distinct(), "study_uid", "left_semi")
    elif studies and "*" not in studies:
        df = df.where(F.col("study_uid").isin(*studies))
    return df.where(F.col("series_uid") == series) if series else df
