"""Scalar rules of the scientific formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MAX_TYPE_HOPS
from ..plans.cut import follow

ISO8601 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})$"
ISO8601_LENIENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"

# Version families, most specific first; CF attribute names; time series types.
NWB_VERSIONS = ["2.0", "2.1", "2.2", "2.3", "2.4", "2.5", "2.6", "2.7", "2.8"]
CF_ATTRIBUTES = [
    "units", "long_name", "standard_name", "calendar", "scale_factor", "add_offset", "_FillValue",
    "missing_value", "valid_min", "valid_max", "valid_range", "coordinates", "axis", "bounds", "cell_methods",
]
TIME_SERIES_TYPES = [
    "TimeSeries", "ElectricalSeries", "SpikeEventSeries", "RoiResponseSeries", "SpatialSeries", "AbstractFeatureSeries",
    "AnnotationSeries", "IntervalSeries", "DecompositionSeries", "LFP", "ImageSeries", "ImageMaskSeries",
    "OptogeneticSeries", "PatchClampSeries", "TwoPhotonSeries",
]
FITS_MANDATORY = ["SIMPLE", "BITPIX", "NAXIS", "EXTEND", "END"]


def iso8601_valid(s: Column, lenient: bool = False) -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` with ``Z`` or an offset; digits only, ranges unchecked."""
    return F.coalesce(s.rlike(ISO8601_LENIENT if lenient else ISO8601), F.lit(False))


def nwb_version(s: Column) -> Column:
    """Version family by prefix; null if none fits."""
    out = F.lit(None).cast("string")
    for v in reversed(NWB_VERSIONS):
        out = F.when(F.trim(s).startswith(v), v).otherwise(out)
    return out


def neurodata_class(s: Column) -> Column:
    """timeseries, table, container or unknown."""
    return (
        F.when(s.isin(TIME_SERIES_TYPES), "timeseries")
        .when(s.isin("DynamicTable", "Units", "TimeIntervals", "ElectrodeTable"), "table")
        .when(s.isin("NWBFile", "ProcessingModule", "Position", "NWBContainer", "Subject"), "container")
        .otherwise("unknown")
    )


def cf_name_valid(s: Column) -> Column:
    return F.coalesce(s.rlike("^[A-Za-z][A-Za-z0-9_]*$"), F.lit(False))


def cf_attribute(s: Column) -> Column:
    return F.coalesce(s.isin(CF_ATTRIBUTES), F.lit(False))


def fits_keyword_class(s: Column) -> Column:
    """mandatory, table, axis, commentary or other."""
    return (
        F.when(s.isin(FITS_MANDATORY) | s.rlike("^NAXIS[1-9][0-9]*$"), "mandatory")
        .when(s.rlike("^T(TYPE|FORM|UNIT|NULL|SCAL|ZERO|DIM|DISP|BCOL)[1-9][0-9]*$"), "table")
        .when(s.rlike("^(CTYPE|CRPIX|CRVAL|CDELT|CROTA)[1-9][0-9]*$"), "axis")
        .when(s.isin("COMMENT", "HISTORY", ""), "commentary")
        .otherwise("other")
    )


def fits_ascii_number(field: Column) -> Column:
    """Value of an F, E or D field: blanks trimmed, ``D`` exponents read as ``E``; else null."""
    return F.regexp_replace(F.lower(F.trim(field)), "d", "e").try_cast("double")


def fits_ascii_integer(field: Column) -> Column:
    return F.trim(field).try_cast("long")


def fits_ascii_text(field: Column) -> Column:
    """Trailing blanks are padding."""
    return F.rtrim(field)


_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[EeDd][+-]?[0-9]+)?"


def header_integer(value: Column) -> Column:
    """Integer of a header value; null if it is none."""
    return F.when(F.trim(value).rlike("^[+-]?[0-9]+$"), F.trim(value).try_cast("long"))


def header_float(value: Column) -> Column:
    """Real number of a header value, ``D`` exponents included."""
    return F.when(F.trim(value).rlike(f"^{_NUMBER}$"), F.regexp_replace(F.upper(F.trim(value)), "D", "E").try_cast("double"))


def header_complex(value: Column) -> Column:
    """struct<re, im> of a value like ``(1.5, -2)``."""
    pair = rf"^\(\s*({_NUMBER})\s*,\s*({_NUMBER})\s*\)$"
    part = lambda k: header_float(F.regexp_extract(F.trim(value), pair, k))
    return F.when(F.trim(value).rlike(pair), F.struct(part(1).alias("re"), part(2).alias("im")))


def header_logical(value: Column) -> Column:
    return F.when(F.trim(value) == "T", F.lit(True)).when(F.trim(value) == "F", F.lit(False))


def sample_time(explicit: Column, start: Column, rate: Column, i: Column) -> Column:
    """Time of sample ``i``: its explicit timestamp, else ``start + i / rate``."""
    return F.coalesce(explicit, start + i / rate)


def scaled(raw: Column, scale: Column, offset: Column, null: Column | None = None) -> Column:
    """Physical value ``raw * scale + offset``; the null code gives null."""
    value = raw * F.coalesce(scale, F.lit(1.0)) + F.coalesce(offset, F.lit(0.0))
    return value if null is None else F.when(raw.eqNullSafe(null), F.lit(None)).otherwise(value)


def dictionary_value(dictionary: Column, index: Column) -> Column:
    """Entry of a dictionary by its 0-based index; out of range gives null."""
    return F.get(dictionary, index)


def slice_within(values: Column, offset: int, length: int) -> Column:
    """``length`` entries from ``offset``; null where the array is too short."""
    return F.when(F.lit(offset + length) <= F.size(values), F.slice(values, offset + 1, length))


def descends_from(types: DataFrame, ancestor: str, hops: int = MAX_TYPE_HOPS) -> DataFrame:
    """Rows (name, depth) of ``types(name, parent)`` that reach ``ancestor`` within
    ``hops``; cycles never do."""
    to = F.when(F.col("name") != ancestor, F.col("parent"))
    ends = follow(types.select(F.col("name").alias("key"), to.alias("to")), hops)
    return ends.where((F.col("at") == ancestor) & (F.col("hops") <= hops)).select(F.col("key").alias("name"), F.col("hops").cast("int").alias("depth"))
