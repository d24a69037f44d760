"""Projection, schema merge and evolution, and cast verdicts.

Work on data is a DataFrame projection; only schemas are handled on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound, ShapeError


def validate_names(names: Sequence[str]) -> None:
    if not names:
        raise ShapeError("no columns")
    if any(not n for n in names):
        raise ShapeError("a column has an empty name")
    if len({*names}) != len(names):
        raise ShapeError("a column name is used twice")


def project_source_order(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in the order of ``df``; unknown, repeated or no names are errors."""
    validate_names(names)
    if missing := [n for n in names if n not in df.columns]:
        raise NotFound(f"no such columns: {missing}")
    return df.select(*[c for c in df.columns if c in names])


def project_request_order(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in the order asked for; a name may repeat."""
    if missing := [n for n in names if n not in df.columns]:
        raise NotFound(f"no such columns: {missing}")
    return df.select(*[F.col(n) for n in names])


@dataclass(frozen=True)
class Step:
    """One difference between schemas: keep, update or add a field."""

    kind: str
    name: str
    field: T.StructField


def merge_schemas(old: T.StructType, new: T.StructType) -> tuple[T.StructType, list[Step]]:
    """``old`` with the fields of ``new``: fields are matched by name, changed ones
    updated in place, unknown ones added at the end."""
    later, steps, fields = {f.name: f for f in new}, [], []
    for f in old:
        g = later.get(f.name, f)
        steps.append(Step("keep" if g == f else "update", f.name, g))
        fields.append(g)
    known = {f.name for f in old}
    for f in new:
        if f.name not in known:
            steps.append(Step("add", f.name, f))
            fields.append(f)
    return T.StructType(fields), steps


MERGE_MODES = {"strict": (False, False), "additive": (True, False), "subtractive": (False, True), "full": (True, True)}


def permits(mode: str, change: str) -> bool:
    """Whether a merge mode allows to "add" or "remove" fields."""
    additions, removals = MERGE_MODES[mode]
    return additions if change == "add" else removals


def union_merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, with the columns of either; missing ones are null."""
    return a.unionByName(b, allowMissingColumns=True)


def evolve(df: DataFrame, rename: dict[str, str] | None = None, widen: dict[str, str] | None = None, add: dict[str, str] | None = None, remove: Sequence[str] = ()) -> DataFrame:
    """One projection for renames, widening casts, new null columns and removals."""
    rename, widen = rename or {}, widen or {}
    if missing := [n for n in [*rename, *widen, *remove] if n not in df.columns]:
        raise NotFound(f"no such columns: {missing}")
    old = [(F.col(c).cast(widen[c]) if c in widen else F.col(c)).alias(rename.get(c, c)) for c in df.columns if c not in remove]
    return df.select(*old, *[F.lit(None).cast(t).alias(n) for n, t in (add or {}).items()])


def diff(old: T.StructType, new: T.StructType) -> list[tuple[str, str]]:
    """Changes by name: added, removed, widened, retyped, nullability."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    out = [("removed", n) for n in a if n not in b] + [("added", n) for n in b if n not in a]
    for n in a:
        if n in b and a[n].dataType != b[n].dataType:
            verdict = cast_verdict(type_class(a[n].dataType), type_class(b[n].dataType))
            out.append(("widened" if verdict == "lossless" else "retyped", n))
        if n in b and a[n].nullable != b[n].nullable:
            out.append(("nullability", n))
    return out


# --- cast verdicts ----------------------------------------------------------

#: The conversion modes and the verdicts that each lets through.
MODES = {
    "strict": ("exact", "lossless"),
    "widening": ("exact", "lossless"),
    "lossy": ("exact", "lossless", "lossy"),
    "any": ("exact", "lossless", "lossy", "incompatible"),
}


def type_class(t: T.DataType) -> tuple[str, int, bool]:
    """(kind, bits, signed) of a Spark type."""
    sizes = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
    for kind, bits in sizes.items():
        if isinstance(t, kind):
            return "int", bits, True
    if isinstance(t, T.DecimalType) and t.scale == 0:
        return "int", 64, False
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float", 32 if isinstance(t, T.FloatType) else 64, True
    return t.typeName(), 0, False


def cast_verdict(a: tuple[str, int, bool], b: tuple[str, int, bool]) -> str:
    """Verdict for storing values of type ``a`` in type ``b``.

    Integers of another sign or of fewer bits are incompatible, as the values that fit
    cannot be told from the type; a narrower real number is a lossy one.
    """
    if a == b:
        return "exact"
    if a[0] == b[0] == "int":
        return "lossless" if a[2] == b[2] and b[1] > a[1] else "incompatible"
    if a[0] == b[0] == "float":
        return "lossless" if b[1] > a[1] else "lossy"
    return "incompatible"


def cast_verdict_column(kind_a: Column, bits_a: Column, signed_a: Column, kind_b: Column, bits_b: Column, signed_b: Column) -> Column:
    """The same verdict over columns."""
    same = (kind_a == kind_b) & (bits_a == bits_b) & (signed_a == signed_b)
    return (
        F.when(same, "exact")
        .when((kind_a == "int") & (kind_b == "int") & (signed_a == signed_b) & (bits_b > bits_a), "lossless")
        .when((kind_a == "float") & (kind_b == "float"), F.when(bits_b > bits_a, "lossless").otherwise("lossy"))
        .otherwise("incompatible")
    )


def permitted(verdict: str, mode: str) -> bool:
    return verdict in MODES[mode]


def field_compatibility(a: T.StructField, b: T.StructField) -> str:
    """compatible, requires_evolution or incompatible."""
    verdict = cast_verdict(type_class(a.dataType), type_class(b.dataType))
    if verdict == "incompatible":
        return "incompatible"
    return "compatible" if verdict == "exact" and a.nullable == b.nullable else "requires_evolution"


def pairs(schema: T.StructType) -> list[tuple[str, str, str]]:
    """(name, type, repetition) of the top-level fields."""
    return [
        (f.name, f.dataType.simpleString(), "repeated" if isinstance(f.dataType, T.ArrayType) else "optional" if f.nullable else "required")
        for f in schema
    ]


def counts(schema: T.StructType) -> dict[str, int]:
    """Numbers of top-level, nullable, nested and all descendant fields."""

    def below(t: T.DataType) -> int:
        if isinstance(t, T.StructType):
            return sum(1 + below(f.dataType) for f in t)
        if isinstance(t, T.ArrayType):
            return 1 + below(t.elementType)
        return 2 + below(t.keyType) + below(t.valueType) if isinstance(t, T.MapType) else 0

    nested = (T.StructType, T.ArrayType, T.MapType)
    return {
        "fields": len(schema.fields),
        "nullable": sum(f.nullable for f in schema),
        "nested": sum(isinstance(f.dataType, nested) for f in schema),
        "descendants": sum(1 + below(f.dataType) for f in schema),
    }
