"""Nested data: JSON and XML text into flat columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.scale import new_folder

ROOT = "_"                              # element that XML documents are wrapped in
XML_OPTIONS = {"rowTag": ROOT, "attributePrefix": "@", "valueTag": "#text",
               "inferSchema": "false"}  # fixed values: attribute and text key names
XML_PROLOG = r"(?s)^(\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(\[.*?\])?\s*>)*"
CORRUPT = "_corrupt_record"


class Normalized(NamedTuple):
    """Flat rows, and the input rows that could not be read."""

    rows: DataFrame
    rejects: DataFrame


def _leaves(c: Column, dtype: T.DataType, name: str) -> list[Column]:
    if not isinstance(dtype, T.StructType):
        return [c.alias(name)]
    return [leaf for f in dtype.fields
            for leaf in _leaves(c.getField(f.name), f.dataType, f"{name}.{f.name}")]


def flatten(df: DataFrame, explode_arrays: bool = False) -> DataFrame:
    """Replace struct columns by one column per leaf, named ``outer.inner``, at the end.

    Only the schema is looked at. Arrays stay cells, unless ``explode_arrays``
    gives each element its row (an empty or missing array keeps one row). Two columns
    that would get one name are an error.
    """
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, T.StructType)]
    nested = [f for f in df.schema.fields if isinstance(f.dataType, T.StructType)]
    out = df.select(*[col(f.name) for f in plain],
                    *[leaf for f in nested for leaf in _leaves(col(f.name), f.dataType, f.name)])
    if len(set(out.columns)) < len(out.columns):
        raise ValueError("a nested field would take the name of another column")
    if not explode_arrays:
        return out
    array = next((f for f in out.schema.fields if isinstance(f.dataType, T.ArrayType)), None)
    if array is None:
        return out
    exploded = out.select(*[c for c in (
        F.explode_outer(col(f.name)).alias(f.name) if f.name == array.name else col(f.name)
        for f in out.schema.fields)])
    return flatten(exploded, True)


def _plain(dtype: T.DataType) -> T.DataType:
    """Column types of a normalised table: decimals are doubles, mixed types are text."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain(dtype.elementType))
    if isinstance(dtype, (T.DecimalType, T.FloatType)):
        return T.DoubleType()
    if isinstance(dtype, (T.NullType, T.VariantType)):
        return T.StringType()
    return dtype


def _target(schema: str) -> T.StructType:
    """The struct type of an inferred ``OBJECT<...>``; quoted names are left alone."""
    parts = re.split(r"(`(?:[^`]|``)*`)", schema)
    ddl = "".join(p if p.startswith("`") else p.replace("OBJECT<", "STRUCT<") for p in parts)
    return _plain(T.StructType.fromDDL(f"x {ddl}").fields[0].dataType)


def scan_json(spark: SparkSession, path: str, multiline: bool = False) -> Normalized:
    """JSON files as flat columns: one document per line, or with ``multiline`` per file."""
    return normalize_json(spark.read.text(path, wholetext=multiline), "value")


def scan_xml(spark: SparkSession, path: str, row_tag: str) -> Normalized:
    """XML files as flat text columns: one row per ``row_tag`` element."""
    df = spark.read.options(**{
        **XML_OPTIONS, "rowTag": row_tag, "columnNameOfCorruptRecord": CORRUPT}).xml(path)
    if CORRUPT not in df.columns:
        return Normalized(flatten(df), spark.createDataFrame([], f"{CORRUPT} string"))
    # Spark refuses to read the broken records alone, so a data column goes with them.
    data = col(next(c for c in df.columns if c != CORRUPT)).cast("string")
    other = F.length(F.coalesce(data, F.lit(""))) >= 0
    good = df.where(col(CORRUPT).isNull() & other).drop(CORRUPT)
    return Normalized(flatten(good), df.where(col(CORRUPT).isNotNull() & other).select(CORRUPT))


def normalize_json(df: DataFrame, column: str, keep: Sequence[str] = ()) -> Normalized:
    """JSON text into flat columns, after the ``keep`` columns.

    An object is one row, an array of objects one row per element. Nested objects
    become ``outer.inner`` columns, arrays stay cells. The schema is inferred from
    all rows in one aggregate. Text that is not an object or an array goes to the
    rejects, as do array elements that are not objects.
    """
    parsed = df.select(*[col(c) for c in keep], col(column).alias("_text"),
                       F.try_parse_json(col(column)).alias("_json"))
    items = F.try_variant_get("_json", "$", "array<variant>")
    elements = parsed.select(
        *[col(c) for c in keep], "_text",
        F.explode_outer(F.when(F.substring(F.ltrim("_text"), 1, 1) == "[", items)
                        .otherwise(F.array("_json"))).alias("_item"))
    # Only elements of arrays need a look at their type.
    is_object = F.col("_item").isNotNull() & F.when(
        F.substring(F.ltrim("_text"), 1, 1) == "{", F.lit(True)).otherwise(
            F.schema_of_variant("_item").startswith("OBJECT"))
    objects = elements.where(is_object)
    broken = (elements.where(~is_object & ~(F.col("_item").isNull()
                                            & F.col("_text").rlike(r"^\s*\[\s*\]\s*$")))
              .select(*[col(c) for c in keep], F.col("_text").alias(column)))
    schema = objects.agg(F.schema_of_variant_agg("_item")).first()[0]
    if not schema or not schema.startswith("OBJECT"):
        return Normalized(objects.select(*[col(c) for c in keep]), broken)
    target = _target(schema)
    typed = objects.select(*[col(c) for c in keep], F.try_variant_get(
        "_item", "$", _ddl(target)).alias("_row"))
    rows = typed.select(*[col(c) for c in keep], *[
        leaf for f in target.fields
        for leaf in _leaves(F.col("_row").getField(f.name), f.dataType, f.name)])
    return Normalized(rows, broken)


def _ddl(dtype: T.DataType) -> str:
    """A type as text, with every field name quoted."""
    if isinstance(dtype, T.StructType):
        return "struct<" + ", ".join(
            "`" + f.name.replace("`", "``") + "`: " + _ddl(f.dataType) for f in dtype.fields) + ">"
    if isinstance(dtype, T.ArrayType):
        return f"array<{_ddl(dtype.elementType)}>"
    return dtype.simpleString()


def xml_schema(df: DataFrame, column: str) -> T.StructType:
    """The merged schema of all XML documents of a column, by their root elements.

    The XML reader infers a schema over files, so the documents are written as text to the
    shared folder and read there; no Python worker sees them.
    """
    folder = new_folder(df.sparkSession, "xml")
    documents = df.select(_wrapped(column).alias("value"))
    documents.where(F.col("value").isNotNull()).write.text(folder)
    inferred = df.sparkSession.read.options(**XML_OPTIONS).xml(folder).schema
    return T.StructType([f for f in inferred.fields if f.name != CORRUPT
                         and isinstance(f.dataType, (T.StructType, T.StringType))])


def _wrapped(column: str) -> Column:
    """A document without its prolog, inside an element that all documents share."""
    return F.concat(F.lit(f"<{ROOT}>"), F.regexp_replace(col(column), XML_PROLOG, ""),
                    F.lit(f"</{ROOT}>"))


def normalize_xml(df: DataFrame, column: str, keep: Sequence[str] = (),
                  schema: T.StructType | None = None) -> Normalized:
    """XML documents into flat text columns, one row each, after the ``keep`` columns.

    Columns are named by the path from the root element; attributes are
    ``@name``, text beside attributes is ``#text``, and a repeated element is an
    array cell. The schema is inferred from all documents, unless one is given (as
    ``xml_schema`` gives it), which saves that pass.
    """
    fields = (xml_schema(df, column) if schema is None else schema).fields
    wrapped = df.select(*[col(c) for c in keep], col(column).alias("_text"),
                        _wrapped(column).alias("_document"))
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    parsed = wrapped.withColumn("_row", F.from_xml(
        F.col("_document"), schema, {**XML_OPTIONS, "columnNameOfCorruptRecord": CORRUPT}))
    good = F.col("_row")[CORRUPT].isNull() & F.col("_row").isNotNull()
    has_root = F.lit(False)
    for f in fields:
        has_root = has_root | F.col("_row").getField(f.name).isNotNull()
    ok = F.coalesce(good & has_root, F.lit(False))
    rows = parsed.where(ok).select(*[col(c) for c in keep], *[
        leaf for f in fields
        for leaf in _leaves(F.col("_row").getField(f.name), f.dataType, f.name)])
    rejects = parsed.where(~ok).select(*[col(c) for c in keep], F.col("_text").alias(column))
    return Normalized(rows, rejects)


def auto_normalize(df: DataFrame, column: str, keep: Sequence[str] = ()) -> Normalized:
    """JSON or XML text, told apart row by row, into one flat table.

    Text that begins with ``{`` or ``[`` is JSON, with ``<`` XML; the rest, and
    what cannot be read, are rejects. Columns of both kinds are put side by side.
    """
    first = F.substring(F.ltrim(col(column)), 1, 1)
    text = df.select(*[col(c) for c in keep], col(column))
    as_json = normalize_json(text.where(first.isin("{", "[")), column, keep)
    as_xml = normalize_xml(text.where(first == "<"), column, keep)
    other = text.where(~F.coalesce(first.isin("{", "[", "<"), F.lit(False)))
    return Normalized(as_json.rows.unionByName(as_xml.rows, allowMissingColumns=True),
                      as_json.rejects.unionByName(as_xml.rejects).unionByName(other))
