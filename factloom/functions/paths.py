"""Field paths compiled to Columns: ``confidence.value``, ``provenance[].snapshot_id``.

A path is compiled against a schema, so that it becomes plain field access and
``transform``: no row is interpreted. ``[]`` goes into the elements of an array
and gives an array, one level for each of them. A step that the schema doesn't
have, or that meets null, gives null; so does a step into an array without
``[]``, or into what is no struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _steps(path: str) -> list[tuple[str, bool]]:
    """(name, whether its elements are meant) of each step."""
    out = [(p.removesuffix("[]"), p.endswith("[]")) for p in path.split(".")]
    if not all(name and "[" not in name and "]" not in name for name, _ in out):
        raise ValueError(f"no field path: {path!r}")
    return out


def _follow(value: Column, kind: T.DataType, steps: list[tuple[str, bool]]) -> tuple[Column, T.DataType | None]:
    if not steps:
        return value, kind
    (name, every), rest = steps[0], steps[1:]
    if not isinstance(kind, T.StructType) or name not in kind.names:
        return F.lit(None), None
    return _inside(value[name], kind[name].dataType, every, rest)


def _inside(value: Column, kind: T.DataType, every: bool, rest: list[tuple[str, bool]]) -> tuple[Column, T.DataType | None]:
    if not every:
        return _follow(value, kind, rest)
    if not isinstance(kind, T.ArrayType):
        return F.lit(None), None
    if not rest:
        return value, kind
    _, of = _follow(F.lit(None), kind.elementType, rest)
    found = F.transform(value, lambda x: _follow(x, kind.elementType, rest)[0])
    return found, T.ArrayType(of or T.NullType())


def compiled(schema: T.StructType, path: str) -> tuple[Column, T.DataType | None]:
    """(what a path gives of a row with this schema, its type; none if the schema has no such field)."""
    (name, every), *rest = _steps(path)
    if name not in schema.names:
        return F.lit(None), None
    return _inside(F.col(f"`{name}`"), schema[name].dataType, every, rest)


def says(value: Column, kind: T.DataType | None) -> Column:
    """Whether a value of this type says something: not null, no empty string, array
    or map, and of an array every element, however deep. 0, false and a struct say something."""
    if kind is None or isinstance(kind, T.NullType):
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return F.coalesce(value != "", F.lit(False))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.NullType):
            return F.lit(False)
        return F.coalesce((F.size(value) > 0) & F.forall(value, lambda x: says(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def populated(claims: DataFrame, path: str) -> Column:
    """Whether the field at a path of a row says something."""
    return says(*compiled(claims.schema, path))


def texts(claims: DataFrame, path: str) -> Column:
    """What a path gives, as a string: an array's elements joined by commas, null if it says nothing."""
    value, kind = compiled(claims.schema, path)
    if kind is None:
        return F.lit(None).cast("string")
    shown = F.array_join(F.transform(value, lambda x: x.cast("string")), ",") if isinstance(kind, T.ArrayType) else value.cast("string")
    return F.when(says(value, kind), shown)
