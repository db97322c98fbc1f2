"""JSON values: paths, nested lists, merges, bounded lists and typed items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import blank_to_null, col


def at(x: Column | str, path: list[str]) -> Column:
    """The value at a path of object keys, as text; null where a step is missing or not an object's."""
    value = col(x)
    for k, key in enumerate(path):
        inner = F.get_json_object(value, f"$['{key}']")
        value = inner if k == len(path) - 1 else F.when(is_object(inner), inner)
    return F.when(is_object(x), value)


def is_object(x: Column | str) -> Column:
    return F.coalesce(F.trim(col(x)).startswith("{"), F.lit(False))


def is_list(x: Column) -> Column:
    return F.coalesce(F.trim(x).startswith("["), F.lit(False))


def objects(xs: Column | str, depth: int = 2) -> Column:
    """The objects of an array of JSON texts in which some may be lists of objects, up to so many deep."""
    out = col(xs)
    for _ in range(depth):
        out = F.flatten(F.transform(out, lambda x: F.when(is_list(x), F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(x))))
    return F.filter(out, lambda x: is_object(x))


def first_name(xs: Column | str, key: str = "nome") -> Column:
    """The name of the first object that has one that is not blank."""
    names = F.transform(objects(xs), lambda x: blank_to_null(F.get_json_object(x, f"$.{key}")))
    return F.get(F.filter(names, lambda x: x.isNotNull()), F.lit(0))


def merged(*objects_: Column | str) -> Column:
    """Shallow merge of maps: later ones win; a null map adds nothing."""
    maps = [F.coalesce(col(x), F.create_map().cast("map<string,string>")) for x in objects_]
    over = lambda one, later: F.map_concat(F.map_filter(one, lambda k, v: ~F.map_contains_key(later, k)), later)
    out = maps[0]
    for later in maps[1:]:
        out = over(out, later)
    return out


def appended(xs: Column | str, x: Column | str, most: int = 100) -> Column:
    """The array with one more element, of which the last `most` stay."""
    out = F.concat(F.coalesce(col(xs), F.array().cast("array<string>")), F.array(col(x)))
    return F.slice(out, F.greatest(F.size(out) - most + 1, F.lit(1)), F.lit(most))


def items(x: Column | str) -> Column:
    """The agenda items of a JSON list: objects with the texts kind, label and dueAt and the boolean fatal; others go."""
    rows = F.transform(F.filter(F.from_json(col(x), "array<string>"), lambda i: is_object(i)), lambda i: F.struct(i.alias("raw"), F.from_json(i, "kind string, label string, dueAt string, time string, fatal string").alias("v")))
    text = lambda r, key: F.get_json_object(r["raw"], f"$.{key}").isNotNull() & r["raw"].rlike(rf'"{key}"\s*:\s*"')
    good = F.filter(rows, lambda r: text(r, "kind") & text(r, "label") & text(r, "dueAt") & r["raw"].rlike(r'"fatal"\s*:\s*(true|false)'))
    return F.transform(good, lambda r: F.struct(r["v"]["kind"].alias("kind"), r["v"]["label"].alias("label"), r["v"]["dueAt"].cast("date").alias("day"), r["v"]["time"].alias("time"), (r["v"]["fatal"] == "true").alias("fatal")))


def canonical(x: Column | str, shape: str) -> Column:
    """A JSON text with the keys of its objects in order, at every depth, and nulls kept. shape: the DDL of its fields; what it does not name is left out."""
    from pyspark.sql.types import ArrayType, DataType, StructField, StructType, _parse_datatype_string

    def ordered(t: DataType) -> DataType:
        if isinstance(t, StructType):
            return StructType([StructField(f.name, ordered(f.dataType)) for f in sorted(t.fields, key=lambda f: f.name)])
        return ArrayType(ordered(t.elementType)) if isinstance(t, ArrayType) else t

    return F.to_json(F.from_json(col(x), ordered(_parse_datatype_string(shape))), {"ignoreNullFields": "false"})
