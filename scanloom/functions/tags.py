"""Column functions over datasets: maps of tag -> attribute (see ``model.DATASET_TYPE``)."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.model import (
    ATTRIBUTE_TYPE, BINARY_VRS, DECIMAL_VRS, INTEGER_VRS, TAGS, Dictionary, tag, tag_dictionary,
)


def attribute(vr: str | Column, values: Column) -> Column:
    """An attribute with a value array."""
    vr = F.lit(vr) if isinstance(vr, str) else vr
    none = F.lit(None).cast("string")
    return F.struct(
        vr.alias("vr"), values.cast("array<string>").alias("Value"), none.alias("InlineBinary"),
        none.alias("BulkDataURI"),
    ).cast(ATTRIBUTE_TYPE)


def dataset(values: Mapping[str, Column]) -> Column:
    """Dataset from keyword -> single value; keywords whose value is NULL are absent."""
    entries = []
    for keyword, value in values.items():
        code, vr = TAGS[keyword]
        entries.append(F.struct(F.lit(code).alias("key"), attribute(vr, F.array(value)).alias("value")))
    there = [F.when(value.isNotNull(), entry) for value, entry in zip(values.values(), entries, strict=True)]
    # Where nothing is absent nothing has to be filtered out, which Spark does entry by entry without compiled code.
    full = reduce(lambda a, b: a & b, [value.isNotNull() for value in values.values()], F.lit(True))
    return F.when(full, F.map_from_entries(F.array(*entries))).otherwise(F.map_from_entries(F.array_compact(F.array(*there))))


def _creator_tags(group: str) -> list[str]:
    """The tags of a group that name the owners of its blocks 10-3F, in their order."""
    return [f"{group}00{b:02X}" for b in range(16, 64)]


def private_tag(ds: Column, code: str, creator: str) -> Column:
    """Actual tag of a private element: the block (10-3F) reserved by ``creator``; NULL if none."""
    group, element = code[:4], code[6:8]
    # The dataset's own entries are looked through, not every block; hex digits sort like their numbers.
    mine = F.map_filter(ds, lambda k, v: k.isin(*_creator_tags(group)) & (F.get(v["Value"], F.lit(0)) == creator))
    return F.concat(F.lit(group), F.substring(F.array_min(F.map_keys(mine)), 7, 2), F.lit(element))


def reserve_private_block(ds: Column, code: str, creator: str) -> Column:
    """Tag to write a private element to: the creator's block, else the first free one."""
    group, element = code[:4], code[6:8]
    free = F.array_except(F.array(*[F.lit(t) for t in _creator_tags(group)]), F.map_keys(ds))
    fresh = F.concat(F.lit(group), F.substring(F.get(free, F.lit(0)), 7, 2), F.lit(element))
    return F.coalesce(private_tag(ds, code, creator), fresh)


def put_private(ds: Column, code: str, creator: str, vr: str, values: Column) -> Column:
    """Write a private element, adding the creator element of its block when new."""
    target = reserve_private_block(ds, code, creator)
    creator_tag = F.concat(F.substring(target, 1, 4), F.lit("00"), F.substring(target, 5, 2))
    added = F.create_map(
        creator_tag, attribute("CS", F.array(F.lit(creator))), target, attribute(vr, values)
    )
    kept = F.map_filter(ds, lambda k, _: (k != creator_tag) & (k != target))
    return F.when(target.isNotNull(), F.map_concat(kept, added))


def get_value(ds: Column, name: str, dictionary: Dictionary = TAGS) -> Column:
    """Absent: NULL; no values: empty text; one: the value; several: joined with a backslash."""
    values = ds[tag(name, dictionary)]["Value"]
    return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.array_join(values, "\\"))


def get_list(ds: Column, name: str, dictionary: Dictionary = TAGS) -> Column:
    """All values, NULL when the tag is absent."""
    return ds[tag(name, dictionary)]["Value"]


def set_value(ds: Column, name: str, values: Column, vr: str | None = None, dictionary: Dictionary = TAGS) -> Column:
    """Overwrite an attribute; VR from the dictionary, else the given one, else UN."""
    code = tag(name, dictionary)
    known = next((v for c, v in dictionary.values() if c == code), None)
    kept = F.map_filter(ds, lambda k, _: k != code)
    return F.map_concat(kept, F.create_map(F.lit(code), attribute(known or vr or "UN", values)))


def push_list(ds: Column, name: str, value: Column, vr: str | None = None, dictionary: Dictionary = TAGS) -> Column:
    """Append to an attribute's values, creating the attribute when absent."""
    old = F.coalesce(get_list(ds, name, dictionary), F.array().cast("array<string>"))
    return set_value(ds, name, F.array_append(old, value.cast("string")), vr, dictionary)


def remove_value(ds: Column, name: str, dictionary: Dictionary = TAGS) -> Column:
    code = tag(name, dictionary)
    return F.map_filter(ds, lambda k, _: k != code)


def is_private(code: Column) -> Column:
    """Odd group number."""
    return F.conv(F.substring(code, 1, 4), 16, 10).cast("bigint") % 2 == 1


def with_vr(attributes: DataFrame, dictionary: DataFrame | None = None, code: str = "tag", vr: str = "vr") -> DataFrame:
    """Explicit VR, else the dictionary's, else UN.

    The built-in dictionary has a fixed size and is broadcast; for a given one Spark
    decides by its size.
    """
    d = F.broadcast(tag_dictionary(attributes.sparkSession)) if dictionary is None else dictionary
    d = d.select(F.col("tag").alias("_tag"), F.col("vr").alias("_vr"))
    return attributes.join(d, attributes[code] == d["_tag"], "left").select(
        *[F.col(c) for c in attributes.columns if c != vr],
        F.coalesce(attributes[vr], F.col("_vr"), F.lit("UN")).alias(vr),
    )


def _renamed(ds: Column, names: Mapping[str, str]) -> Column:
    """Keys renamed; one literal map, however many names."""
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    return F.transform_keys(ds, lambda k, _: F.coalesce(table[k], k))


def naturalize(ds: Column, dictionary: Dictionary = TAGS) -> Column:
    """Tag codes to keywords; unknown tags keep their code."""
    return _renamed(ds, {code: keyword for keyword, (code, _) in dictionary.items()})


def denaturalize(ds: Column, dictionary: Dictionary = TAGS) -> Column:
    """Keywords to tag codes; unknown keys stay."""
    return _renamed(ds, {keyword: code for keyword, (code, _) in dictionary.items()})


def project(ds: Column, keywords: list[str], dictionary: Dictionary = TAGS) -> Column:
    """Attributes of a tag set that the dataset has."""
    return F.map_filter(ds, lambda k, _: k.isin(*[tag(w, dictionary) for w in keywords]))


def without(ds: Column, keywords: list[str], dictionary: Dictionary = TAGS) -> Column:
    return F.map_filter(ds, lambda k, _: ~k.isin(*[tag(w, dictionary) for w in keywords]))


def escape_part(col: Column) -> Column:
    """Escape the separators of the canonical text."""
    for mark, name in (("\\", "\\\\"), ("=", "\\="), ("\n", "\\n")):
        col = F.replace(col, F.lit(mark), F.lit(name))
    return col


def canonical_lines(ds: Column, *marks: Callable[[Column], Column]) -> Column:
    """The lines of the canonical text, sorted: ``array<struct<tag, line>>``, with ``marks`` made from the tag behind them.

    Texts of parts of a dataset are made of the same lines.
    """
    def labelled(name: str, value: Column) -> Column:
        return F.concat(F.lit(name), escape_part(value))

    def values(v: Column) -> Column:
        first = F.get(v, F.lit(0))
        marked = F.transform(v, lambda x: F.coalesce(labelled("+", x), F.lit("-")))
        several = F.concat(F.lit("=V"), F.size(v).cast("string"), F.lit(":"), F.array_join(marked, "\\"))
        return F.when((F.size(v) == 1) & first.isNotNull(), labelled("=V1:+", first)).otherwise(several)

    # Entries by their keys; sort_array compares them natively, without a comparator function per pair.
    return F.transform(
        F.sort_array(F.map_entries(ds)),
        lambda e: F.struct(e["key"].alias("tag"), F.concat(escape_part(e["key"]), *[F.coalesce(part, F.lit("")) for part in (
            labelled("=R:", e["value"]["vr"]), values(e["value"]["Value"]),
            labelled("=I:", e["value"]["InlineBinary"]), labelled("=B:", e["value"]["BulkDataURI"]),
        )]).alias("line"), *[mark(e["key"]) for mark in marks]),
    )


def canonical_text(ds: Column) -> Column:
    """Key-order independent text of a dataset, different for different datasets.

    Sorted lines ``tag=R:vr=V2:+value\\-=I:binary=B:uri``; absent fields are left out. A value list has its length
    before it, ``+`` before each value and ``-`` for a NULL one.
    """
    return lines_text(canonical_lines(ds))


def lines_text(lines: Column) -> Column:
    return F.array_join(lines["line"], "\n")


def content_hash(ds: Column) -> Column:
    """SHA-256 of the canonical text; always recomputed."""
    return F.sha2(canonical_text(ds), 256)


def document_hash(text: Column) -> Column:
    """Hash of a JSON document that ignores key order at every depth."""
    return F.sha2(F.to_json(F.parse_json(text)), 256)


def typed_values(vr: Column, raw: Column) -> Column:
    """Decode raw text by VR.

    Number VRs are split at backslashes into numbers, PN into names, byte VRs are base64;
    the other text VRs stay one value, backslashes included. Empty text has no values.
    """
    parts = F.split(raw, r"\\")
    blank = raw == ""
    number = r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"
    whole = r"^\s*([+-]?[0-9]+)"
    return F.struct(
        F.when(vr.isin(*DECIMAL_VRS), F.when(blank, F.array()).otherwise(
            F.transform(parts, lambda x: F.regexp_extract(x, number, 1).try_cast("double"))
        )).alias("decimals"),
        F.when(vr.isin(*INTEGER_VRS), F.when(blank, F.array()).otherwise(
            F.transform(parts, lambda x: F.regexp_extract(x, whole, 1).try_cast("bigint"))
        )).alias("integers"),
        F.when(vr == "PN", F.when(blank, F.array()).otherwise(
            F.transform(parts, lambda x: F.struct(x.alias("Alphabetic")))
        )).alias("names"),
        F.when(vr.isin(*BINARY_VRS), F.try_to_binary(raw, F.lit("base64"))).alias("bytes"),
        F.when(~vr.isin("PN", *DECIMAL_VRS, *INTEGER_VRS, *BINARY_VRS), F.when(blank, F.array()).otherwise(F.array(raw)))
        .alias("texts"),
    )


def canonical_values(value: Column) -> Column:
    """A VARIANT value as an array: arrays stay, scalars are wrapped, NULL and JSON null have none."""
    as_array = F.try_variant_get(value, "$", "array<variant>")
    return F.when(as_array.isNotNull(), as_array).when(
        value.isNotNull() & ~F.is_variant_null(value), F.array(value)
    )
