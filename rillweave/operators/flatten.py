"""Nested records: flattening for export, recursive cleaning, SQL types."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CONTROL, DEFAULT, Cleaner, size_reduction


def leaves(schema: T.StructType, nested: bool = True, joint: str = "_") -> dict[str, Column]:
    """Flat name to column: struct fields become parent_child, arrays and maps JSON text; of equal names the later wins."""
    found: dict[str, Column] = {}

    def walk(fields: T.StructType, name: str, path: str) -> None:
        for f in fields.fields:
            flat, at = f"{name}{f.name}", f"{path}`{f.name.replace('`', '``')}`"
            if isinstance(f.dataType, T.StructType) and nested:
                walk(f.dataType, f"{flat}{joint}", f"{at}.")
            elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                found[flat] = F.to_json(F.col(at))
            elif isinstance(f.dataType, T.VariantType):
                found[flat] = F.variant_get(F.col(at), "$", "string")
            else:
                found[flat] = F.col(at)

    walk(schema, "", "")
    return found


def flatten(df: DataFrame, nested: bool = True, sort: bool = True) -> DataFrame:
    """Flat columns, in order of name if sort."""
    found = leaves(df.schema, nested)
    return df.select(*(found[n].alias(n) for n in (sorted(found) if sort else found)))


#: In the schema of a variant: quoted names, which stay, and the types that a table's schema calls otherwise.
_NOT_OF_TABLES = re.compile(r"(`(?:[^`]|``)*`)|OBJECT(?=<)|(?<=: )VOID|(?<=<)VOID(?=>)")


def open_records(rows: DataFrame, column: str, *, into: str = "record") -> DataFrame:
    """rows with the JSON objects of a text column as one struct, whose fields are the union of all rows' keys.

    The keys aren't known beforehand: one aggregate over variants gives their
    union with types wide enough for every value, and the objects are read
    by it. Where values of a key have no common type the field is a variant. Text that is
    no JSON object is a null record; no objects at all give a struct without
    fields. Keys that differ by case only need spark.sql.caseSensitive.
    """
    parsed = F.try_parse_json(F.col(f"`{column}`").cast("string"))
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT<"))
    found = rows.select(F.when(is_object, parsed).alias("v")).where("v is not null").agg(F.schema_of_variant_agg("v")).first()[0]  # as long as the header will be
    if not found.startswith("OBJECT<"):
        return rows.withColumn(into, F.lit(None).cast(T.StructType()))
    kind = _NOT_OF_TABLES.sub(lambda m: m[1] or ("STRUCT" if m[0] == "OBJECT" else "STRING"), found)
    return rows.withColumn(into, F.try_variant_get(F.when(is_object, parsed), "$", kind))


def prepared(df: DataFrame) -> DataFrame:
    """Complex columns as JSON text, others unchanged."""
    complex_ = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*((F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, complex_) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields))


def sql_type(kind: T.DataType) -> str:
    """INTEGER for whole numbers and booleans, REAL for fractions, TEXT for all else."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "INTEGER"
    return "REAL" if isinstance(kind, T.FractionalType) else "TEXT"


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns under the union of those, in order of name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*(F.col(f"`{c}`") for c in sorted(out.columns)))


def clean_record(df: DataFrame, fields: list[str] | None = None, cleaner: Cleaner = DEFAULT, stats: str = "clean_stats") -> DataFrame:
    """df with its strings cleaned, and a struct of what that did.

    Structs are walked, strings in arrays cleaned, structs in arrays left as
    they are. fields limits the names that count at every level, so it also
    skips whole containers that it doesn't name. Null strings stay null and
    don't count.
    """
    count, before, after = [], [], []

    def one(c: Column) -> Column:
        return F.when(c.isNotNull(), cleaner.clean(c))

    def tally(n: Column, old: Column, new: Column) -> None:
        count.append(n)
        before.append(old)
        after.append(new)

    def walk(kind: T.DataType, at: Column) -> Column:
        if isinstance(kind, T.StringType):
            new = one(at)
            tally(at.isNotNull().cast("int"), F.coalesce(F.char_length(at), F.lit(0)), F.coalesce(F.char_length(new), F.lit(0)))
            return new
        if isinstance(kind, T.StructType):
            parts = [(walk(f.dataType, at[f.name]) if not fields or f.name in fields else at[f.name]).alias(f.name) for f in kind.fields]
            return F.when(at.isNotNull(), F.struct(*parts))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            new = _clean_items(cleaner, at)
            size = lambda a: F.coalesce(F.aggregate(a, F.lit(0), lambda n, x: n + F.coalesce(F.char_length(x), F.lit(0))), F.lit(0))
            tally(F.coalesce(F.size(F.filter(at, lambda x: x.isNotNull())), F.lit(0)), size(at), size(new))
            return new
        return at

    columns = [(walk(f.dataType, F.col(f"`{f.name}`")) if not fields or f.name in fields else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    total = lambda parts: sum(parts, F.lit(0)).cast("long")
    old, new = total(before), total(after)
    summary = F.struct(total(count).alias("fields_cleaned"), (old - new).alias("chars_removed"), old.alias("original_size"), new.alias("cleaned_size"), size_reduction(old, new).alias("size_reduction"))
    return df.select(*columns, summary.alias(stats))


def _clean_items(cleaner: Cleaner, items: Column) -> Column:
    """The items cleaned each on its own; the step that needs Python takes the whole array, since such functions don't run inside a transform."""
    if not (cleaner.decode_html or cleaner.normalize_unicode):
        return F.transform(items, lambda x: F.when(x.isNotNull(), cleaner.clean(x)))
    control = re.compile(CONTROL)

    def fix(x: str | None) -> str | None:
        if x is None:
            return None
        x = control.sub("", html.unescape(x) if cleaner.decode_html else x)
        return unicodedata.normalize("NFKC", x) if cleaner.normalize_unicode else x

    @F.pandas_udf("array<string>")
    def decode(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else [fix(x) for x in r])

    rest = Cleaner(False, False, cleaner.remove_emojis, cleaner.narrow_emojis, cleaner.remove_currency, cleaner.strip_whitespace, cleaner.lowercase, cleaner.custom)
    return F.transform(decode(items), lambda x: F.when(x.isNotNull(), rest.clean(x)))


def clean_totals(df: DataFrame, stats: str = "clean_stats") -> DataFrame:
    """One row: the statistics of all rows."""
    s = lambda f: F.coalesce(F.sum(f"{stats}.{f}"), F.lit(0))
    return df.agg(s("fields_cleaned").alias("fields_cleaned"), s("chars_removed").alias("chars_removed"), s("original_size").alias("original_size"), s("cleaned_size").alias("cleaned_size"), size_reduction(s("original_size"), s("cleaned_size")).alias("size_reduction"))
