"""Declarative field rules compiled to Columns, and checks of free-form JSON values."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUES = "array<struct<path:string,message:string>>"
# Names of the accepted value types, as they appear in messages.
_NAMES = {str: "str", int: "int", float: "float", bool: "bool", dict: "dict", list: "list"}
_SPARK = {
    str: (T.StringType, T.VarcharType, T.CharType), bool: (T.BooleanType,),
    int: (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    float: (T.FloatType, T.DoubleType), dict: (T.StructType, T.MapType), list: (T.ArrayType,),
}


@dataclass(frozen=True)
class Rule:
    """What one field must satisfy.

    ``check`` maps the field's Column to a message Column (NULL when fine); a Pandas UDF may be
    used inside it.
    """

    kind: type
    required: bool = True
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed: Sequence | None = None
    nested: dict[str, Rule] | None = None
    check: Callable[[Column], Column] | None = None


def _kind_of(dt: T.DataType) -> str:
    for kind, classes in _SPARK.items():
        if isinstance(dt, classes):
            return _NAMES[kind]
    return dt.simpleString()


def _matches(kind: type, dt: T.DataType) -> bool:
    # A bool is an int as well.
    return isinstance(dt, _SPARK[kind]) or (kind is int and isinstance(dt, T.BooleanType))


def _length(c: Column, dt: T.DataType) -> Column | None:
    if isinstance(dt, _SPARK[str]):
        return F.length(c)
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return F.size(c)
    if isinstance(dt, T.StructType):
        return F.lit(len(dt.fields))
    return None


def _issue(cond: Column, path: str, message: str | Column) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(cond, F.struct(F.lit(path).alias("path"), message.alias("message")))


def _field_issues(c: Column, dt: T.DataType, rule: Rule, path: str) -> list[Column]:
    out = []
    if rule.required:
        out.append(_issue(c.isNull(), path, "Required field is missing"))
    if not _matches(rule.kind, dt):
        out.append(_issue(c.isNotNull(), path,
                          f"Invalid type. Expected {_NAMES[rule.kind]}, got {_kind_of(dt)}"))
        return out
    size = _length(c, dt)
    if size is not None and rule.min_length:
        out.append(_issue(c.isNotNull() & (size < rule.min_length), path,
                          f"Length must be at least {rule.min_length}"))
    if size is not None and rule.max_length:
        out.append(_issue(c.isNotNull() & (size > rule.max_length), path,
                          f"Length must be at most {rule.max_length}"))
    if rule.pattern and isinstance(dt, _SPARK[str]):
        # the pattern has to match from the start of the text
        out.append(_issue(~c.rlike(r"\A(?:" + rule.pattern + ")"), path, "Value does not match pattern"))
    if rule.allowed is not None:
        out.append(_issue(c.isNotNull() & ~c.isin(list(rule.allowed)), path,
                          f"Value must be one of: {list(rule.allowed)}"))
    if rule.nested and isinstance(dt, T.StructType):
        out += _struct_issues(lambda n: c[n], dt, rule.nested, path, present=c.isNotNull())
    if rule.check is not None:
        message = rule.check(c)
        out.append(_issue(c.isNotNull() & message.isNotNull(), path, message))
    return out


def _struct_issues(get: Callable[[str], Column], dt: T.StructType, rules: dict[str, Rule],
                   path: str, present: Column | None = None) -> list[Column]:
    out = []
    for name, rule in rules.items():
        where = f"{path}.{name}" if path else name
        if name not in dt.fieldNames():
            found = [_issue(F.lit(True), where, "Required field is missing")] if rule.required else []
        else:
            found = _field_issues(get(name), dt[name].dataType, rule, where)
        out += [F.when(present, f) for f in found] if present is not None else found
    return out


def rule_issues(df: DataFrame, rules: dict[str, Rule]) -> Column:
    """Array of struct<path, message> of all rule violations of a row of ``df``."""
    found = _struct_issues(F.col, df.schema, rules, "")
    return F.array_compact(F.array(*found)).cast(ISSUES) if found else F.array().cast(ISSUES)


def validate_rules(df: DataFrame, rules: dict[str, Rule], name: str = "issues") -> DataFrame:
    return df.withColumn(name, rule_issues(df, rules))


@dataclass(frozen=True)
class ValueLimits:
    """Limits of a free-form value."""

    max_string: int = 1000
    min_string: int = 1
    max_list: int = 1000
    max_dict: int = 1000
    types: tuple[type, ...] = (str, int, float, bool, dict, list)


def _first_issue(value, limits: ValueLimits) -> tuple[str, str] | None:
    """First violation, depth first in document order, with an explicit stack."""
    todo: list[tuple[str, object]] = [("", value)]
    while todo:
        path, v = todo.pop()
        if type(v) not in limits.types:
            return path, f"Type {type(v).__name__} not allowed"
        if isinstance(v, str):
            if len(v) < limits.min_string:
                return path, f"String too short (min {limits.min_string})"
            if len(v) > limits.max_string:
                return path, f"String too long (max {limits.max_string})"
        elif isinstance(v, list):
            if len(v) > limits.max_list:
                return path, f"Too many items in list (max {limits.max_list})"
            todo += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, dict):
            if len(v) > limits.max_dict:
                return path, f"Too many items in dict (max {limits.max_dict})"
            todo += [(f"{path}.{k}", x) for k, x in reversed(list(v.items()))]
    return None


def validate_variant(json_text: Column, limits: ValueLimits = ValueLimits()) -> Column:
    """struct<is_valid, path, message> of the value in a JSON text; NULL text is a null value."""

    @F.pandas_udf("struct<is_valid:boolean,path:string,message:string>")
    def check(col: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in col:
            try:
                issue = _first_issue(None if raw is None else json.loads(raw), limits)
            except ValueError:
                issue = ("", "Invalid JSON")
            rows.append((issue is None, issue[0] if issue else None, issue[1] if issue else None))
        return pd.DataFrame(rows, columns=["is_valid", "path", "message"])

    return check(json_text)


def issue_lines(issues: Column) -> Column:
    """Readable ``path: message`` list of a row's issues."""
    return F.transform(issues, lambda e: F.concat(e["path"], F.lit(": "), e["message"]))


def required_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"Missing required columns: {', '.join(absent)}")
