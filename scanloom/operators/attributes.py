"""Long attribute tables: one row per (document, path, tag)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.nested import attributes, dumped, parsed, plain, values_of
from scanloom.model import AVAILABLE_TRANSFER_SYNTAX, BINARY_VRS


def explode_attributes(docs: DataFrame, keys: list[str], document: str, tasks: int | None = None) -> DataFrame:
    """Attributes of VARIANT documents, items of sequences included at any depth.

    ``path`` names the enclosing sequence items (``00101002[0]/...``); ``values`` is an array of VARIANT, a scalar value
    counts as one. Each document is taken apart once, where it is read, without a shuffle; ``tasks`` deals the documents
    of an input of few files out first.
    """
    rows = _attribute_rows(docs, keys, document, tasks)
    return rows.withColumn("_values", F.transform("_values", F.parse_json)).withColumnRenamed("_values", "values").select(
        *keys, "path", "tag", "vr", "values", "inline_binary", "bulk_uri"
    )


def _attribute_rows(docs: DataFrame, keys: list[str], document: str, tasks: int | None) -> DataFrame:
    """The same with every value as JSON text."""
    columns = ("path", "tag", "vr", "inline_binary", "bulk_uri")
    narrow = docs.select(*keys, F.to_json(document).alias("_json"))
    narrow = narrow.repartition(tasks) if tasks else narrow
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]] + [f"{c} string" for c in columns]

    def run(batches):
        for batch in batches:
            rows, at = {c: [] for c in (*columns, "_values")}, []
            for i, text in enumerate(batch.column("_json").to_pylist()):
                for path, tag, a in attributes(parsed(text)):
                    values = values_of(a)
                    row = (path, tag, plain(a.get("vr")), plain(a.get("InlineBinary")), plain(a.get("BulkDataURI")),
                           None if values is None else [dumped(v) for v in values])
                    for c, v in zip(rows, row):
                        rows[c].append(v)
                    at.append(i)
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            texts = [pa.array(rows[c], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, *texts, pa.array(rows["_values"], pa.list_(pa.string()))], names=[*keys, *rows])

    return narrow.mapInArrow(run, ", ".join(fields) + ", _values array<string>")


def _kept_and_retyped(rows: DataFrame, values: str, is_text, is_none, as_text) -> DataFrame:
    """The export rules, for values whose kind and text the given functions tell."""
    stored = F.col("inline_binary").isNotNull() | F.col("bulk_uri").isNotNull()
    head = F.get(values, F.lit(0))
    first_is_text = head.isNotNull() & is_text(head)
    present = F.filter(values, lambda v: v.isNotNull() & ~is_none(v))
    text = F.transform(present, as_text)
    all_text = F.forall(present, is_text)
    retyped = F.when(F.get(text, F.lit(0)).rlike(r"^[0-9.]+$"), "UI").otherwise("LO")
    vr = (
        F.when(stored, F.col("vr"))
        .when(F.col("vr").isNull(), "LT")
        .when(F.col("vr").isin(*BINARY_VRS) & F.col(values).isNotNull() & all_text, retyped)
        .otherwise(F.col("vr"))
    )
    keep = (F.col("tag") != AVAILABLE_TRANSFER_SYNTAX) & (
        stored
        | (F.col("vr").isNull() & F.coalesce(first_is_text, F.lit(False)))
        | (F.col("vr").isNotNull() & (F.col(values).isNull() | (F.size(present) > 0)))
    )
    kept = [c for c in rows.columns if c not in ("vr", values)]
    return rows.where(keep).select(*kept, vr.alias("vr"), text.alias("values"))


def export_cleanup(rows: DataFrame) -> DataFrame:
    """Rules applied before an export.

    Internal tags, empty and all-null values are dropped, nulls filtered, numbers become
    text, byte VRs that hold only text become UI or LO, and an attribute without VR is kept
    as LT only when its first value is text. Inline and external binary data pass.
    """
    kind = F.schema_of_variant
    return _kept_and_retyped(rows, "values", lambda v: kind(v) == "STRING", F.is_variant_null, lambda v: F.try_variant_get(v, "$", "string"))


def export_attributes(docs: DataFrame, keys: list[str], document: str, tasks: int | None = None) -> DataFrame:
    """:func:`export_cleanup` of the attributes of VARIANT documents in one go.

    The values stay JSON texts, whose first character tells their kind; only those that are no plain text are parsed.
    """
    rows = _attribute_rows(docs, keys, document, tasks)

    def as_text(v: Column) -> Column:
        inner = F.substr(v, F.lit(2), F.length(v) - 2)
        bare = v.startswith('"') & ~inner.contains("\\")
        return F.when(bare, inner).otherwise(F.try_variant_get(F.parse_json(v), "$", "string"))

    out = _kept_and_retyped(rows, "_values", lambda v: v.startswith('"'), lambda v: v == "null", as_text)
    return out.select(*keys, "path", "tag", "inline_binary", "bulk_uri", "vr", "values")
