import pytest
from pyspark.sql import types as T

from quarrylake import errors
from quarrylake.functions import scalars
from quarrylake.operators import catalog
from quarrylake.plans import schema


def test_projection_rules(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert schema.project_source_order(df, ["c", "a"]).columns == ["a", "c"]
    assert schema.project_request_order(df, ["c", "a", "c"]).columns == ["c", "a", "c"]
    for names, error in [([], errors.ShapeError), (["a", "a"], errors.ShapeError), (["z"], errors.NotFound)]:
        with pytest.raises(error):
            schema.project_source_order(df, names)


def test_merge_and_diff():
    a = T.StructType().add("x", "integer").add("y", "string")
    b = T.StructType().add("y", "binary").add("z", "integer").add("x", "integer")
    merged, steps = schema.merge_schemas(a, b)
    assert merged.simpleString() == "struct<x:int,y:binary,z:int>"
    assert [(s.kind, s.name) for s in steps] == [("keep", "x"), ("update", "y"), ("add", "z")]
    assert sorted(schema.diff(a, T.StructType().add("x", "long").add("w", "integer"))) == [("added", "w"), ("removed", "y"), ("widened", "x")]
    assert schema.permits("additive", "add") and not schema.permits("strict", "remove")


@pytest.mark.parametrize("a, b, verdict", [("int", "int", "exact"), ("int", "bigint", "lossless"), ("bigint", "int", "incompatible"), ("float", "double", "lossless"), ("double", "float", "lossy"), ("int", "double", "incompatible"), ("string", "int", "incompatible")])
def test_verdicts(a, b, verdict):
    ta, tb = (schema.type_class(T._parse_datatype_string(x)) for x in (a, b))
    assert schema.cast_verdict(ta, tb) == verdict
    assert schema.permitted(verdict, "any") and schema.permitted(verdict, "strict") == (verdict in ("exact", "lossless"))


def test_counts():
    s = T._parse_datatype_string("struct<a:int,b:struct<c:int,d:array<int>>>")
    assert schema.counts(s) == {"fields": 2, "nullable": 2, "nested": 1, "descendants": 5}


def test_paths_and_links(spark):
    nodes = spark.createDataFrame([("/a", "/", "a", "dataset", "hard", None), ("/b", "/", "b", "link", "soft", "a"), ("/c", "/", "c", "link", "soft", "c")], "path string, parent string, name string, node_type string, link_type string, target string")
    assert catalog.normalise("x//y/", "/g") == "/g/x/y"
    assert catalog.resolve(nodes, "b") == "/a"
    with pytest.raises(errors.LinkResolutionFailed):
        catalog.resolve(nodes, "/c")
    with pytest.raises(errors.NotFound):
        catalog.node(nodes, "/zz")


def test_scalar_edges(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(" 1.5D+3 ", None, "1.x")], "a string, b string, c string").select(
        scalars.fits_ascii_number(F.col("a")).alias("a"), scalars.fits_ascii_number(F.col("b")).alias("b"), scalars.fits_ascii_number(F.col("c")).alias("c"),
        scalars.iso8601_valid(F.col("b")).alias("d"), scalars.neurodata_class(F.lit("TimeSeries")).alias("e"), scalars.fits_keyword_class(F.lit("NAXIS12")).alias("f"),
    ).first()
    assert tuple(row) == (1500.0, None, None, False, "timeseries", "mandatory")
