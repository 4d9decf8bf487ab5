"""JSON documents against a schema: the schema becomes one expression tree over VARIANT, so a check is a projection without a shuffle or a Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is understood of a schema; anything else is an error when the schema is compiled, not a rule that is passed over.
KEYWORDS = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum",
    "title", "description",
}
TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"}
NONE = "array<struct<path:string,problem:string>>"


def get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def member(name: str) -> str:
    """The path of an object's member, whatever its name."""
    if '"' in name or "\\" in name:
        raise ValueError(f"the name {name!r} can't be looked up")
    return f'$["{name}"]'


def problems(value: Column, schema: dict, path: Column | str = "$") -> Column:
    """Array of (path, problem) of a VARIANT: every rule of the schema that it breaks, in the order of the document and then of the rules.

    A problem is the name of the broken keyword; for `required` and `additionalProperties` the path is that of the member. Rules for one type
    say nothing about values of another. A JSON null is a value of the type null; a missing optional member has no problems.
    """
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"not understood: {sorted(unknown)}")
    path = F.lit(path) if isinstance(path, str) else path
    return bind(F.schema_of_variant(value), lambda kind: _problems(value, kind, schema, path))


def _problems(value: Column, kind: Column, schema: dict, path: Column) -> Column:
    is_ = lambda name: kind.rlike(TYPES[name])
    found: list[Column] = []

    def rule(name: str, broken: Column, at: Column | None = None) -> None:
        found.append(F.when(broken, F.array(F.struct((path if at is None else at).alias("path"), F.lit(name).alias("problem")))).otherwise(F.array().cast(NONE)))

    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        rule("type", ~_any([is_(t) for t in wanted]))
    for name, allowed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if allowed is not None:
            rule(name, ~_any([_equals(value, kind, a) for a in allowed]))
    text, number = get(value, "$", "string"), get(value, "$", "double")
    for name, broken in (("minLength", lambda k: F.length(text) < k), ("maxLength", lambda k: F.length(text) > k), ("pattern", lambda k: ~text.rlike(k))):
        if name in schema:
            rule(name, is_("string") & broken(schema[name]))
    for name, broken in (("minimum", lambda k: number < k), ("maximum", lambda k: number > k)):
        if name in schema:
            rule(name, is_("number") & broken(schema[name]))
    items = get(value, "$", "array<variant>")
    for name, broken in (("minItems", lambda k: F.size(items) < k), ("maxItems", lambda k: F.size(items) > k)):
        if name in schema:
            rule(name, is_("array") & broken(schema[name]))
    if schema.get("uniqueItems"):
        written = F.transform(items, lambda x: F.to_json(x))
        rule("uniqueItems", is_("array") & (F.size(F.array_distinct(written)) < F.size(items)))
    if "items" in schema:
        each = F.flatten(F.transform(items, lambda x, i: problems(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        found.append(F.when(is_("array"), each).otherwise(F.array().cast(NONE)))
    for name in schema.get("required", []):
        rule("required", is_("object") & get(value, member(name), "variant").isNull(), F.concat(path, F.lit(f".{name}")))
    for name, inner in schema.get("properties", {}).items():
        found.append(F.when(is_("object"), bind(get(value, member(name), "variant"), _optional(inner, F.concat(path, F.lit(f".{name}"))))).otherwise(F.array().cast(NONE)))
    extra = schema.get("additionalProperties", True)
    if extra is not True:
        known = F.lit(list(schema.get("properties", {}))) if schema.get("properties") else F.array().cast("array<string>")
        members = get(value, "$", "map<string,variant>")
        names = F.array_sort(F.array_except(F.map_keys(members), known))
        if extra is False:
            each = F.transform(names, lambda n: F.struct(F.concat(path, F.lit("."), n).alias("path"), F.lit("additionalProperties").alias("problem")))
        else:
            each = F.flatten(F.transform(names, lambda n: problems(F.try_element_at(members, n), extra, F.concat(path, F.lit("."), n))))
        found.append(F.when(is_("object"), each).otherwise(F.array().cast(NONE)))
    return F.concat(*found) if found else F.array().cast(NONE)


def _optional(schema: dict, path: Column) -> Callable[[Column], Column]:
    """The problems of a member; none if it is missing."""
    return lambda own: F.when(own.isNotNull(), problems(own, schema, path)).otherwise(F.array().cast(NONE))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _equals(value: Column, kind: Column, constant) -> Column:
    if constant is None:
        return kind == "VOID"
    if isinstance(constant, bool):
        return (kind == "BOOLEAN") & (get(value, "$", "boolean") == constant)
    if isinstance(constant, (int, float)):
        return kind.rlike(TYPES["number"]) & (get(value, "$", "double") == float(constant))
    if isinstance(constant, str):
        return (kind == "STRING") & (get(value, "$", "string") == constant)
    raise ValueError(f"values of enum and const are plain ones, not {constant!r}")


def parsed(text: Column) -> Column:
    """A text that is one JSON value and nothing else as VARIANT; null otherwise.

    The parser passes over what follows the first value. Such a rest breaks the text as an array's item or as an object's member.
    """
    items = get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    member_too = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return bind(items, lambda found: F.when((F.size(found) == 1) & member_too, F.get(found, F.lit(0))))


def checked(rows: DataFrame, column: str, schema: dict, name: str = "problems") -> DataFrame:
    """rows with `name`: what a column of JSON text breaks of the schema.

    A text that isn't JSON stays as it is and has the one problem 'json' at '$'; a null text has the problem 'missing'. Each text is
    parsed once: the rules read the parsed value, not an expression that parses again for every rule.
    """
    one = lambda problem: F.array(F.struct(F.lit("$").alias("path"), F.lit(problem).alias("problem")))
    judged = bind(parsed(F.col(column)), lambda value: F.when(value.isNull(), one("json")).otherwise(problems(value, schema)))
    return rows.withColumn(name, F.when(F.col(column).isNull(), one("missing")).otherwise(judged))


def imported(rows: DataFrame, column: str, schema: dict, fields: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the fields of sound documents, rows of the others with their problems): nothing that was read is lost.

    `fields` is the DDL of the columns to take, as in "a int, b array<string>".
    """
    judged = checked(rows, column, schema, "problems")
    sound = judged.filter(F.size("problems") == 0).drop("problems").withColumn("fields", F.from_json(column, fields))
    return sound.select(*rows.columns, "fields.*"), judged.filter(F.size("problems") > 0)


def problem_rows(judged: DataFrame, keys: list[str], name: str = "problems") -> DataFrame:
    """(keys, path, problem): one row for each problem."""
    # an inner explode would have its array checked for being null and empty first, each time by the whole expression
    return judged.select(*keys, F.explode_outer(name).alias("p")).filter("p IS NOT NULL").select(*keys, "p.path", "p.problem")
