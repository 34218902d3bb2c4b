"""Validation: required fields, types, custom rules; issues as an array column.

Issues keep their order: required, types, custom. Errors make a row invalid,
warnings don't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import ISSUES, model_parts

Rule = Callable[[Column], Column]

#: Text that each type takes, beside values that already have it.
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
_INTEGER = r"^\s*[+-]?\d+(\.0*)?\s*$"
_TRUE, _FALSE = ["1", "true", "t", "yes", "y", "on"], ["0", "false", "f", "no", "n", "off"]


def is_blank(c: Column) -> Column:
    return c.rlike(r"(?U)^[\s\x1c-\x1f]*$")


def issue(field: str, message: Column, severity: str, value: Column | None = None) -> Column:
    return F.struct(F.lit(field).alias("field"), message.alias("message"), F.lit(severity).alias("severity"), (F.lit(None).cast("string") if value is None else value.cast("string")).alias("value"))


def required_issue(df: DataFrame, field: str) -> Column:
    """An error if a field is null, absent or a blank string; null otherwise."""
    missing, empty = F.lit(f"Required field '{field}' is missing"), F.lit(f"Required field '{field}' is empty")
    if field not in df.columns:
        return issue(field, missing, "error")
    c = F.col(f"`{field}`")
    out = F.when(c.isNull(), issue(field, missing, "error"))
    return out.when(is_blank(c), issue(field, empty, "error")) if isinstance(df.schema[field].dataType, T.StringType) else out


def coerce(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """The value as the wanted type, null where it isn't one; laxer than equality, stricter than a cast."""
    if isinstance(want, T.StringType):
        return c if isinstance(have, T.StringType) else F.lit(None).cast("string")
    if isinstance(want, (T.DateType, T.TimestampType)) and not isinstance(have, (T.StringType, T.DateType, T.TimestampType)):
        return F.lit(None).cast(want)
    text, kind = isinstance(have, T.StringType), want.simpleString()
    if isinstance(want, T.BooleanType):
        if isinstance(have, T.BooleanType):
            return c
        low = F.lower(c.cast("string"))
        return F.when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False) if text else F.when(c == 1, True).when(c == 0, False)
    if isinstance(want, T.IntegralType):
        if text:
            return F.when(c.rlike(_INTEGER), F.regexp_extract(c, r"[+-]?\d+", 0)).try_cast(kind)
        return F.when(c.cast("double") == F.floor(c.cast("double")), c).try_cast(kind) if isinstance(have, T.FractionalType) else c.try_cast(kind)
    if isinstance(want, T.FractionalType) and text:
        return F.when(c.rlike(_NUMBER), F.replace(F.trim(c), F.lit("_"), F.lit(""))).try_cast(kind)
    return c.try_cast(kind)


_NAMES = {"int": "integer", "bigint": "integer", "double": "number", "float": "number", "boolean": "boolean", "string": "string"}


def schema_parts(df: DataFrame, schema: T.StructType, prefix: str = "") -> tuple[list[Column], list[Column]]:
    """Issues and coerced columns for each field of the schema; nullable fields may be null or absent."""
    issues, columns = [], []

    def walk(fields: T.StructType, have: T.StructType, path: str, root: str) -> list[Column]:
        out = []
        for f in fields.fields:
            name, dotted = f.name, f"{path}{f.name}"
            at = F.col(f"{root}`{name}`") if name in have.names else None
            if at is None:
                if not f.nullable:
                    issues.append(issue(dotted, F.lit("Field required"), "error"))
                out.append(F.lit(None).cast(f.dataType).alias(name))
            elif isinstance(f.dataType, T.StructType) and isinstance(have[name].dataType, T.StructType):
                out.append(F.struct(*walk(f.dataType, have[name].dataType, f"{dotted}.", f"{root}`{name}`.")).alias(name))
            else:
                value = coerce(at, have[name].dataType, f.dataType)
                bad = value.isNull() & at.isNotNull() if f.nullable else value.isNull()
                kind = _NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
                issues.append(F.when(bad, issue(dotted, F.lit(f"Input should be a valid {kind}"), "error", at)))
                out.append(value.alias(name))
        return out

    columns = walk(schema, df.schema, prefix, "")
    return issues, columns


def validate(df: DataFrame, required: list[str] | None = None, rules: dict[str, Rule] | None = None, schema: T.StructType | type | None = None) -> DataFrame:
    """df with is_valid, issues and cleaned (the coerced row, null if invalid).

    schema: a StructType, or a model class (models.py). rules: field to a function from its column to a message, null for none;
    they see the raw value, and null for a field that isn't there.
    """
    parts = [required_issue(df, f) for f in required or []]
    cleaned = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    of_model = None
    if isinstance(schema, type):
        of_model, cleaned = model_parts(df, schema)
    elif schema is not None:
        found, columns = schema_parts(df, schema)
        parts += found
        cleaned = F.struct(*columns)
    n_before = len(parts)
    for field, rule in (rules or {}).items():
        value = F.col(f"`{field}`") if field in df.columns else F.lit(None).cast("string")
        message = rule(value)
        parts.append(F.when(message.isNotNull(), issue(field, message, "warning", value)))
    together = lambda some: F.array_compact(F.array(*some)) if some else F.array().cast(ISSUES)
    issues = together(parts) if of_model is None else F.concat(together(parts[:n_before]), of_model, together(parts[n_before:]))
    out = df.withColumn("issues", issues).withColumn("is_valid", ~F.exists("issues", lambda i: i["severity"] == "error"))
    return out.withColumn("cleaned", F.when(F.col("is_valid"), cleaned))


def of_severity(issues: Column, severity: str) -> Column:
    return F.filter(issues, lambda i: i["severity"] == severity)


def without_values(issues: Column) -> Column:
    """Issues as they are reported: field, message, severity."""
    return F.transform(issues, lambda i: F.struct(i["field"].alias("field"), i["message"].alias("message"), i["severity"].alias("severity")))


def summary(validated: DataFrame) -> DataFrame:
    total, valid = F.count("*"), F.count_if("is_valid")
    return validated.agg(total.alias("total"), valid.alias("valid"), (total - valid).alias("invalid"), F.when(total == 0, F.lit(0.0)).otherwise(valid / total * 100).alias("success_rate"))


def positive_number(c: Column) -> Column:
    """Null passes; so do NaN and infinity."""
    number = F.when(c.cast("string").rlike(_NUMBER), F.trim(c.cast("string"))).try_cast("double")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(number.isNull(), F.lit("Value must be a number")).when(number <= 0, F.lit("Value must be positive"))


def non_empty_string(c: Column) -> Column:
    return F.when(c.isNull() | (F.typeof(c) != "string"), F.lit("Value must be a string")).when(is_blank(c.cast("string")), F.lit("Value cannot be empty"))


def valid_url(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull() | (F.typeof(c) != "string"), F.lit("URL must be a string")).when(~(F.startswith(text, F.lit("http://")) | F.startswith(text, F.lit("https://"))), F.lit("URL must start with http:// or https://"))
