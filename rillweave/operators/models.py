"""Model classes as checks on columns: what a class with annotations says of a record, as one expression.

    class Offer:
        price: Annotated[float, Field(gt=0)]
        stock: int | None = None

    class Product:
        name: Annotated[str, Field(min_length=1, pattern="^[A-Z]")]
        kind: Literal["book", "toy"]
        offers: list[Offer]

    validate(df, schema=Product)

Fields may be int, float, str, bool, dates, times, decimals, Literal, lists, dicts with
string keys, other classes, and unions of those; a field with a default or None
among its types may be absent. Constraints are read by name from whatever stands in Annotated (gt, ge, lt, le,
multiple_of, min_length, max_length, pattern), and classes with `model_fields` are read by these, so
models of common validation libraries serve as well. The result is column expressions: no Python runs on rows.

A column can't tell absent from null: null is None for an optional field, the default for one that has one, else an
error. A value of a union is taken as the member whose type it has, else the first that it fits; members of different
types come out as double, if all are numbers, or as text.
"""

from __future__ import annotations

import datetime
import decimal
import types
import typing
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING: Any = type("Missing", (), {"__repr__": lambda self: "MISSING"})()
CONSTRAINTS = ("gt", "ge", "lt", "le", "multiple_of", "min_length", "max_length", "pattern")
ISSUES = "array<struct<field: string, message: string, severity: string, value: string>>"


@dataclass(frozen=True)
class Field:
    """Constraints, and a default if a class gives a Field as a value."""

    default: Any = MISSING
    gt: float | None = None
    ge: float | None = None
    lt: float | None = None
    le: float | None = None
    multiple_of: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None


def _limits(*said: Any) -> dict[str, Any]:
    return {c: v for m in said for c in CONSTRAINTS if (v := getattr(m, c, None)) is not None}


def fields_of(model: type) -> dict[str, tuple[Any, dict[str, Any], Any]]:
    """Annotation, constraints and default (MISSING if required) of each field."""
    if hasattr(model, "model_fields"):
        return {n: (f.annotation, _limits(*f.metadata), MISSING if f.is_required() else f.default) for n, f in model.model_fields.items()}
    out = {}
    for name, kind in typing.get_type_hints(model, include_extras=True).items():
        default = getattr(model, name, MISSING)
        if isinstance(default, Field):
            out[name] = (kind, _limits(default), default.default)
        else:
            out[name] = (kind, {}, default)
    return out


# What is said of values that aren't of a type, and of constraints.
_SCALARS: dict[Any, tuple[T.DataType, str]] = {
    int: (T.LongType(), "integer"),
    float: (T.DoubleType(), "number"),
    str: (T.StringType(), "string"),
    bool: (T.BooleanType(), "boolean"),
    datetime.date: (T.DateType(), "date"),
    datetime.datetime: (T.TimestampType(), "datetime"),
    decimal.Decimal: (T.DecimalType(38, 18), "decimal"),
}
_BOUNDS: dict[str, tuple[Callable[[Column, Any], Column], str]] = {
    "gt": (lambda c, v: c > v, "Input should be greater than {}"),
    "ge": (lambda c, v: c >= v, "Input should be greater than or equal to {}"),
    "lt": (lambda c, v: c < v, "Input should be less than {}"),
    "le": (lambda c, v: c <= v, "Input should be less than or equal to {}"),
    "multiple_of": (lambda c, v: c % v == 0, "Input should be a multiple of {}"),
    "pattern": (lambda c, v: c.rlike(v), "String should match pattern '{}'"),
}


def _plural(n: int, what: str) -> str:
    return f"{n} {what}" + "s" * (n != 1)


def _issue(path: Column, message: Column | str, value: Column | None = None) -> Column:
    text = F.lit(None).cast("string") if value is None else value.cast("string")
    return F.struct(path.alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit("error").alias("severity"), text.alias("value"))


def _none() -> Column:
    return F.array().cast(ISSUES)


def _listed(values: list[Any]) -> str:
    said = [repr(v) for v in values]
    return said[0] if len(said) == 1 else f"{', '.join(said[:-1])} or {said[-1]}"


@dataclass(frozen=True)
class Checked:
    """What a check makes of a value: its issues, the cleaned value and its type."""

    issues: Column
    value: Column
    kind: T.DataType


def _parted(annotation: Any) -> tuple[Any, dict[str, Any]]:
    """An annotation without Annotated, and the constraints in it."""
    if typing.get_origin(annotation) is typing.Annotated:
        inner, limits = _parted(annotation.__origin__)
        return inner, limits | _limits(*annotation.__metadata__)
    return annotation, {}


def check(annotation: Any, limits: dict[str, Any], value: Column, have: T.DataType, path: Column) -> Checked:
    """A value of type `have` against an annotation; null isn't valid."""
    from .validate import coerce

    annotation, more = _parted(annotation)
    limits = limits | more
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin in (typing.Union, types.UnionType):
        return _union(args, limits, value, have, path)
    if origin is typing.Literal:
        kind = _SCALARS[type(args[0])][0]
        clean = coerce(value, have, kind) if have == kind else F.lit(None).cast(kind)
        found = F.coalesce(clean.isin(*args), F.lit(False))
        return Checked(F.when(found, _none()).otherwise(F.array(_issue(path, f"Input should be {_listed(list(args))}", _text(value, have)))), F.when(found, clean), kind)
    if origin is list or annotation is list:
        return _list(args[0] if args else str, limits, value, have, path)
    if origin is dict or annotation is dict:
        return _dict(args[1] if args else str, value, have, path)
    if annotation is Any:
        return Checked(_none(), value, have)
    if annotation not in _SCALARS:
        return _record(annotation, value, have, path)
    kind, name = _SCALARS[annotation]
    clean = coerce(value, have, kind) if isinstance(have, (T.AtomicType, T.NullType)) else F.lit(None).cast(kind)
    wrong = [F.when(~F.coalesce(holds(clean, limits[c]), F.lit(False)), _issue(path, said.format(limits[c]), _text(value, have))) for c, (holds, said) in _BOUNDS.items() if c in limits]
    for c, holds, word in (("min_length", lambda n: F.char_length(clean) >= n, "least"), ("max_length", lambda n: F.char_length(clean) <= n, "most")):
        if c in limits:
            wrong.append(F.when(~holds(limits[c]), _issue(path, f"String should have at {word} {_plural(limits[c], 'character')}", _text(value, have))))
    bad = F.array(_issue(path, f"Input should be a valid {name}", _text(value, have)))
    return Checked(F.when(clean.isNull(), bad).otherwise(F.array_compact(F.array(*wrong)) if wrong else _none()), clean, kind)


def _text(value: Column, have: T.DataType) -> Column:
    return value.cast("string") if isinstance(have, (T.AtomicType, T.NullType)) else F.to_json(value)


def _union(members: tuple, limits: dict[str, Any], value: Column, have: T.DataType, path: Column) -> Checked:
    members = tuple(m for m in members if m is not type(None))
    if len(members) == 1:
        return check(members[0], limits, value, have, path)
    name = lambda m: getattr(_parted(m)[0], "__name__", str(m))
    tried = [check(m, limits, value, have, F.concat(path, F.lit(f".{name(m)}"))) for m in members]
    kinds = {t.kind.simpleString() for t in tried}
    numbers = all(isinstance(t.kind, T.NumericType) for t in tried)
    kind = tried[0].kind if len(kinds) == 1 else T.DoubleType() if numbers else T.StringType()
    out, fits = F.lit(None).cast(kind), F.lit(False)
    as_kind = lambda t: t.value if t.kind == kind else t.value.cast(kind) if isinstance(t.kind, T.AtomicType) else F.to_json(t.value)
    for t in reversed(sorted(tried, key=lambda t: t.kind != have)):  # its own type first
        fit = F.size(t.issues) == 0
        out, fits = F.when(fit, as_kind(t)).otherwise(out), fits | fit
    return Checked(F.when(fits, _none()).otherwise(F.concat(*(t.issues for t in tried))), out, kind)


def _list(of: Any, limits: dict[str, Any], value: Column, have: T.DataType, path: Column) -> Checked:
    if not isinstance(have, T.ArrayType):
        sample = check(of, {}, F.lit(None).cast("string"), T.StringType(), path)
        kind = T.ArrayType(sample.kind)
        return Checked(F.array(_issue(path, "Input should be a valid list", _text(value, have))), F.lit(None).cast(kind), kind)
    one = lambda x, i: _or_none(of, {}, x, have.elementType, F.concat(path, F.lit("."), i.cast("string")))
    kind = T.ArrayType(check(of, {}, F.lit(None).cast(have.elementType), have.elementType, path).kind)
    inside = F.flatten(F.transform(value, lambda x, i: one(x, i).issues))
    wrong = []
    for c, holds, word in (("min_length", lambda n: F.size(value) >= n, "least"), ("max_length", lambda n: F.size(value) <= n, "most")):
        if c in limits:
            said = F.concat(F.lit(f"List should have at {word} {_plural(limits[c], 'item')} after validation, not "), F.size(value).cast("string"))
            wrong.append(F.when(~holds(limits[c]), _issue(path, said, _text(value, have))))
    if wrong:
        inside = F.concat(inside, F.array_compact(F.array(*wrong)))
    bad = F.array(_issue(path, "Input should be a valid list"))
    return Checked(F.when(value.isNull(), bad).otherwise(inside), F.transform(value, lambda x, i: one(x, i).value), kind)


def _dict(of: Any, value: Column, have: T.DataType, path: Column) -> Checked:
    bad = "Input should be a valid dictionary"
    if not isinstance(have, T.MapType):
        kind = T.MapType(T.StringType(), check(of, {}, F.lit(None).cast("string"), T.StringType(), path).kind)
        return Checked(F.array(_issue(path, bad, _text(value, have))), F.lit(None).cast(kind), kind)
    one = lambda k, v: _or_none(of, {}, v, have.valueType, F.concat(path, F.lit("."), k.cast("string")))
    kind = T.MapType(have.keyType, check(of, {}, F.lit(None).cast(have.valueType), have.valueType, path).kind)
    inside = F.flatten(F.transform(F.map_entries(value), lambda e: one(e["key"], e["value"]).issues))
    return Checked(F.when(value.isNull(), F.array(_issue(path, bad))).otherwise(inside), F.transform_values(value, lambda k, v: one(k, v).value), kind)


def _or_none(annotation: Any, limits: dict[str, Any], value: Column, have: T.DataType, path: Column) -> Checked:
    """Like check, but null is fine if None is among the types."""
    found = check(annotation, limits, value, have, path)
    if type(None) not in typing.get_args(_parted(annotation)[0]):
        return found
    return Checked(F.when(value.isNull(), _none()).otherwise(found.issues), found.value, found.kind)


def _record(model: type, value: Column | None, have: T.DataType, path: Column | None) -> Checked:
    """value: None for the row itself, whose fields are columns."""
    if not isinstance(have, T.StructType):
        empty = _record(model, F.lit(None).cast(T.StructType()), T.StructType(), path)
        return Checked(F.array(_issue(path, f"Input should be a valid dictionary or instance of {model.__name__}", _text(value, have))), F.lit(None).cast(empty.kind), empty.kind)
    issues, fields, kinds = [], [], []
    for name, (annotation, limits, default) in fields_of(model).items():
        at = F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))
        there = name in have.names
        kind = have[name].dataType if there else T.StringType()
        one = (F.col(f"`{name}`") if value is None else value.getField(name)) if there else F.lit(None).cast("string")
        found = _or_none(annotation, limits, one, kind, at)
        own, clean = found.issues, found.value
        if default is not MISSING:
            own = F.when(one.isNull(), _none()).otherwise(own)
            if default is not None:
                clean = F.when(one.isNull(), F.lit(default).cast(found.kind)).otherwise(clean)
        elif not there and type(None) not in typing.get_args(_parted(annotation)[0]):
            own = F.array(_issue(at, "Field required"))
        issues.append(own)
        fields.append(clean.alias(name))
        kinds.append(T.StructField(name, found.kind))
    kind = T.StructType(kinds)
    inside, record = F.concat(*issues) if issues else _none(), F.struct(*fields) if fields else F.struct()
    if value is None:
        return Checked(inside, record, kind)
    bad = F.array(_issue(path, f"Input should be a valid dictionary or instance of {model.__name__}"))
    return Checked(F.when(value.isNull(), bad).otherwise(inside), F.when(value.isNotNull(), record), kind)


def model_parts(df: DataFrame, model: type) -> tuple[Column, Column]:
    """The array of issues of each row and the row as the model has it."""
    found = _record(model, None, df.schema, None)
    return found.issues, found.value
