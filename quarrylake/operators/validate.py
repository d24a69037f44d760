"""Conformance checks that return violations as rows (path, kind, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidFormat
from ..functions.scalars import header_integer, iso8601_valid

# What a session file must have.
SESSION_ATTRIBUTES = ["identifier", "session_description", "session_start_time"]
REQUIRED_GROUPS = ["/acquisition", "/analysis", "/processing", "/stimulus", "/general"]


def _violation(rows: DataFrame, path, kind: str, detail) -> DataFrame:
    return rows.select(path.alias("path"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))


def _expected(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def require_root(attributes: DataFrame) -> None:
    """Raises unless the root says that it is a session file, with a version."""
    root = {r["name"]: r["value"] for r in attributes.where("path = '/' and name in ('neurodata_type', 'nwb_version')").collect()}
    if root.get("neurodata_type") != "NWBFile" or not root.get("nwb_version"):
        raise InvalidFormat("the root is not a session file with a version")


def session_attributes(attributes: DataFrame) -> DataFrame:
    """Missing or empty root attributes, and a start time that is not ISO 8601."""
    root = attributes.where("path = '/'")
    names = _expected(attributes, "name", SESSION_ATTRIBUTES)
    missing = names.join(root, "name", "left_anti")
    empty = root.where(F.col("name").isin(SESSION_ATTRIBUTES) & (F.coalesce("value", F.lit("")) == ""))
    bad = root.where((F.col("name") == "session_start_time") & (F.coalesce("value", F.lit("")) != "") & ~iso8601_valid(F.col("value")))
    return (
        _violation(missing, F.lit("/"), "missing_attribute", F.col("name"))
        .union(_violation(empty, F.lit("/"), "empty_attribute", F.col("name")))
        .union(_violation(bad, F.lit("/"), "invalid_time", F.col("value")))
    )


def required_groups(nodes: DataFrame) -> DataFrame:
    missing = _expected(nodes, "path", REQUIRED_GROUPS).join(nodes.where("node_type = 'group'"), "path", "left_anti")
    return _violation(missing, F.col("path"), "missing_group", F.col("path"))


def acquisition_children(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Acquisition children need a type; time series among them need a ``data`` child."""
    kids = nodes.where("parent = '/acquisition'").select("path")
    typed = attributes.where("name = 'neurodata_type'").select("path", F.col("value").alias("type"))
    untyped = kids.join(typed, "path", "left_anti")
    series = kids.join(typed.where(F.col("type").endswith("Series")), "path", "left_semi")
    data = nodes.where("name = 'data'").select(F.col("parent").alias("path"))
    without = series.join(data, "path", "left_anti")
    return _violation(untyped, F.col("path"), "missing_type", F.col("path")).union(_violation(without, F.col("path"), "missing_data", F.col("path")))


def table_columns(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Dynamic tables need ``colnames``, and a child for every name in it."""
    tables = attributes.where("name = 'neurodata_type' and value = 'DynamicTable'").select("path")
    names = attributes.where("name = 'colnames'").select("path", F.explode(F.split("value", r"\s*,\s*")).alias("column"))
    missing = tables.join(attributes.where("name = 'colnames'").select("path"), "path", "left_anti")
    have = nodes.select(F.col("parent").alias("path"), F.col("name").alias("column"))
    absent = tables.join(names, "path").join(have, ["path", "column"], "left_anti")
    return _violation(missing, F.col("path"), "missing_colnames", F.col("path")).union(_violation(absent, F.col("path"), "missing_column", F.col("column")))


def session_file(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """All violations of a session file."""
    return reduce(
        DataFrame.unionByName,
        [session_attributes(attributes), required_groups(nodes), acquisition_children(nodes, attributes), table_columns(nodes, attributes)],
    )


def dimension_model(dimensions: DataFrame, bindings: DataFrame) -> DataFrame:
    """Duplicate dimensions of a group, unresolved ones, and rank mismatches; unlimited
    variables without a dimension, and coordinate variables that are not of rank 1 along
    the dimension of their own name.

    ``dimensions(group, name, size)``; ``bindings(variable, group, rank, dims)`` with, if
    known, ``unlimited`` and ``coordinate``.
    """
    twice = dimensions.groupBy("group", "name").agg(F.count("*").alias("n")).where("n > 1")
    rank = bindings.where(F.size("dims") != F.col("rank"))
    used = bindings.select("variable", "group", F.explode("dims").alias("dim"))
    parts = F.filter(F.split("group", "/"), lambda p: p != "")
    scopes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    reach = used.select("variable", "group", "dim", F.explode(scopes).alias("scope"))
    known = dimensions.select(F.col("group").alias("scope"), F.col("name").alias("dim")).distinct()
    found = reach.join(known, ["scope", "dim"]).select("variable", "dim").distinct()
    lost = used.join(found, ["variable", "dim"], "left_anti")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in bindings.columns else F.lit(False)
    scalar = bindings.where(flag("unlimited") & (F.size("dims") == 0))
    apart = bindings.where(flag("coordinate") & ~((F.size("dims") == 1) & F.coalesce(F.get("dims", F.lit(0)) == F.col("variable"), F.lit(False))))
    return (
        _violation(twice, F.col("group"), "duplicate_dimension", F.col("name"))
        .union(_violation(scalar, F.col("variable"), "unlimited_scalar", F.col("rank")))
        .union(_violation(apart, F.col("variable"), "not_a_coordinate", F.array_join("dims", ",")))
        .union(_violation(rank, F.col("variable"), "rank_mismatch", F.col("rank")))
        .union(_violation(lost, F.col("variable"), "unresolved_dimension", F.col("dim")))
    )


def header_cards(cards: DataFrame) -> DataFrame:
    """Units whose header breaks the rules: ``cards(file, hdu, ord, keyword, value)``.

    The first card of unit 0 is SIMPLE, of later units XTENSION; BITPIX is a known code;
    NAXIS is 0 to 999 and each of its axes has a card; END closes the header.
    """
    value = header_integer(F.col("value"))
    unit = cards.groupBy("file", "hdu").agg(
        F.min_by("keyword", "ord").alias("first"),
        F.max_by("keyword", "ord").alias("last"),
        F.max(F.when(F.col("keyword") == "BITPIX", value)).alias("bitpix"),
        F.max(F.when(F.col("keyword") == "NAXIS", value)).alias("naxis"),
        F.count_if(F.col("keyword").rlike("^NAXIS[1-9][0-9]*$")).alias("axes"),
    )
    path = F.concat(F.col("file"), F.lit("#"), F.col("hdu").cast("string"))
    begin = F.when(F.col("hdu") == 0, "SIMPLE").otherwise("XTENSION")
    return (
        _violation(unit.where(F.col("first") != begin), path, "first_card", F.col("first"))
        .union(_violation(unit.where("last <> 'END'"), path, "no_end", F.col("last")))
        .union(_violation(unit.where(F.col("bitpix").isNull() | ~F.col("bitpix").isin(8, 16, 32, 64, -32, -64)), path, "bitpix", F.col("bitpix")))
        .union(_violation(unit.where("naxis is null or naxis < 0 or naxis > 999"), path, "naxis", F.col("naxis")))
        .union(_violation(unit.where("naxis between 0 and 999 and axes <> naxis"), path, "axes", F.col("axes")))
    )


def row_groups(facts: DataFrame) -> DataFrame:
    """Row groups that are empty or whose flat columns differ from their row count:
    ``facts(file, row_group, column, rows, values)``."""
    path = F.concat(F.col("file"), F.lit("#"), F.col("row_group").cast("string"))
    flat = facts.where(~F.col("column").contains("."))
    empty = facts.where("rows <= 0").select("file", "row_group").distinct()
    return _violation(empty, path, "empty_row_group", F.col("row_group")).union(
        _violation(flat.where("values <> rows"), path, "chunk_rows", F.col("column"))
    )


def equal_lengths(columns: DataFrame) -> DataFrame:
    """Tables whose columns differ in length: ``columns(table, column, n)``."""
    spread = columns.groupBy("table").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo <> hi")
    return _violation(spread, F.col("table"), "unequal_lengths", F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string")))
