"""Model classes as column checks, and records whose keys aren't known."""

import csv
import datetime
import json
from decimal import Decimal
from typing import Annotated, Any, Literal

import pytest
from pyspark.sql import functions as F

from rillweave.operators import flatten
from rillweave.operators.models import Field, fields_of
from rillweave.operators.validate import validate
from rillweave.sources import exporters


class Offer:
    price: Annotated[float, Field(gt=0, le=100)]
    stock: int | None = None


class Product:
    name: Annotated[str, Field(min_length=2, max_length=5, pattern="^[A-Z]")]
    kind: Literal["book", "toy"]
    offers: Annotated[list[Offer], Field(min_length=1)]
    code: int | str
    step: Annotated[int, Field(multiple_of=5, ge=0, lt=100)] = 10
    labels: dict[str, bool] | None
    made: datetime.date | None = None
    note: Any = None


KINDS = "name string, kind string, offers array<struct<price: string, stock: string>>, code string, step string, labels map<string, string>, made string"
GOOD = ("Abc", "toy", [("1.5", "3"), ("100", None)], "x1", None, {"new": "yes", "old": "0"}, "2024-02-29")


def judged(spark, rows, model=Product, kinds=KINDS):
    got = validate(spark.createDataFrame(rows, kinds).coalesce(1), schema=model)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "ArrowEval" not in got._jdf.queryExecution().executedPlan().toString()
    return got.collect()


def test_a_good_record_is_cleaned(spark):
    (r,) = judged(spark, [GOOD])
    assert r.is_valid and r.issues == []
    assert r.cleaned.asDict(True) == {"name": "Abc", "kind": "toy", "offers": [{"price": 1.5, "stock": 3}, {"price": 100.0, "stock": None}], "code": "x1", "step": 10, "labels": {"new": True, "old": False}, "made": datetime.date(2024, 2, 29), "note": None}


@pytest.mark.parametrize(
    ("place", "value", "said"),
    [
        (0, "A", {"name": "String should have at least 2 characters"}),
        (0, "Abcdef", {"name": "String should have at most 5 characters"}),
        (0, "abc", {"name": "String should match pattern '^[A-Z]'"}),
        (0, None, {"name": "Input should be a valid string"}),
        (1, "car", {"kind": "Input should be 'book' or 'toy'"}),
        (1, None, {"kind": "Input should be 'book' or 'toy'"}),
        (2, [], {"offers": "List should have at least 1 item after validation, not 0"}),
        (2, None, {"offers": "Input should be a valid list"}),
        (2, [("1", "x"), None, ("0", "1"), ("100.5", None)], {"offers.0.stock": "Input should be a valid integer", "offers.1": "Input should be a valid dictionary or instance of Offer", "offers.2.price": "Input should be greater than 0", "offers.3.price": "Input should be less than or equal to 100"}),
        (4, "7", {"step": "Input should be a multiple of 5"}),
        (4, "100", {"step": "Input should be less than 100"}),
        (4, "-5", {"step": "Input should be greater than or equal to 0"}),
        (4, "x", {"step": "Input should be a valid integer"}),
        (5, {"a": "maybe", "b": "on"}, {"labels.a": "Input should be a valid boolean"}),
        (6, "2024-02-30", {"made": "Input should be a valid date"}),
    ],
)
def test_each_constraint(spark, place, value, said):
    row = list(GOOD)
    row[place] = value
    (r,) = judged(spark, [tuple(row)])
    assert {i.field: i.message for i in r.issues} == said and not r.is_valid and r.cleaned is None


class Loose:
    a: int | float
    b: int | bool | None = None
    c: list[int | None] = Field(default=None)
    d: Decimal | None = None


def test_unions_take_their_own_type_first(spark):
    rows = judged(spark, [(1.5, "7", [1, None], "1.25"), (2.0, "off", None, None), (None, "7x", None, "x")], Loose, "a double, b string, c array<int>, d string")
    assert [r.is_valid for r in rows] == [True, True, False]
    assert [(r.cleaned.a, r.cleaned.b, r.cleaned.c, r.cleaned.d) for r in rows[:2]] == [(1.5, "7", [1, None], Decimal("1.25")), (2.0, "false", None, None)]
    assert [i.field for i in rows[2].issues] == ["a.int", "a.float", "b.int", "b.bool", "d"]


def test_absent_columns_and_wrong_shapes(spark):
    (r,) = judged(spark, [("x", 5, "no list")], Product, "name int, code int, offers string".replace("name int", "name string"))
    assert [(i.field, i.message) for i in r.issues] == [("name", "String should match pattern '^[A-Z]'"), ("name", "String should have at least 2 characters"), ("kind", "Field required"), ("offers", "Input should be a valid list")]
    (r,) = judged(spark, [(1, [True])], Loose, "a int, c array<boolean>")
    assert r.is_valid and r.cleaned.c == [1] and r.cleaned.a == 1.0


def test_models_of_other_libraries_are_read_by_their_fields(spark):
    class Info:
        def __init__(self, annotation, metadata=(), default=None, required=True):
            self.annotation, self.metadata, self.default, self.required = annotation, list(metadata), default, required

        def is_required(self):
            return self.required

    class Ge:
        ge = 3

    class Foreign:
        model_fields = {"n": Info(int, [Ge()]), "s": Info(str, required=False, default="d")}

    assert fields_of(Foreign)["n"][1] == {"ge": 3}
    rows = judged(spark, [("3", None), ("2", "x")], Foreign, "n string, s string")
    assert [r.is_valid for r in rows] == [True, False] and rows[0].cleaned.asDict() == {"n": 3, "s": "d"}
    assert rows[1].issues[0].message == "Input should be greater than or equal to 3"


def test_rules_and_required_fields_go_with_a_model(spark):
    got = validate(spark.createDataFrame([("", "1")], "name string, a string"), ["name"], {"a": lambda c: F.when(c == "1", F.lit("odd"))}, Loose).first()
    assert [(i.field, i.severity) for i in got.issues] == [("name", "error"), ("a", "warning")]


# Records whose keys aren't known


def test_open_records_have_the_union_of_keys(spark, tmp_path):
    lines = ['{"a": 1, "b c": {"x": null, "y.z": [1, "s"]}, "`q`": "OBJECT<VOID>", "VOID": null, "OBJECT": 1}', '{"a": 2.5, "b c": {"x": "s"}, "e": {}, "n": 12345678901234567890123}', '{"a": "str", "k": [{"u": 1}, {"w": null}]}', "[1]", "nope", "7", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").repartition(3)
    got = flatten.open_records(df, "line")
    assert [r.i for r in got.where("record is not null").orderBy("i").collect()] == [0, 1, 2] and got.count() == 7
    path = exporters.single_file(exporters.to_csv(got.where("record is not null").select("record.*"), f"{tmp_path}/parts"), f"{tmp_path}/one.csv", header=True)
    with open(path, newline="", encoding="utf-8") as f:
        rows = {r["a"]: r for r in csv.DictReader(f)}
    assert list(rows["1"]) == sorted(["`q`", "OBJECT", "VOID", "a", "b c_x", "b c_y.z", "k", "n"])
    assert json.loads(rows["1"]["b c_y.z"]) == [1, "s"] and rows["1"]["`q`"] == "OBJECT<VOID>" and rows["2.5"]["n"] == "12345678901234567890123" and rows["2.5"]["b c_x"] == "s"
    assert json.loads(rows["str"]["k"])[0]["u"] == 1
    assert flatten.open_records(df.where("i > 2"), "line").where("record is not null").count() == 0
