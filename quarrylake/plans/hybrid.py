"""Tables kept beside arrays: a Parquet table with a small descriptor, so that one
container holds both."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidFormat, NotFound

RELATIONS = ("primary", "index", "annotation", "cache")


@dataclass(frozen=True)
class Descriptor:
    """What a table is to its container, and how it is partitioned."""

    relation: str = "primary"
    keys: tuple[str, ...] = ()
    rows: int | None = None

    @property
    def embedded(self) -> bool:
        """A cache can be made again; anything else belongs to the container."""
        return self.relation != "cache"


def embed(df: DataFrame, container: str, name: str, relation: str = "primary", keys: Sequence[str] = ()) -> Descriptor:
    """Writes ``df`` as the table ``name`` of a container; ``keys`` partition it."""
    if relation not in RELATIONS:
        raise InvalidFormat(f"relation {relation!r}")
    if missing := [k for k in keys if k not in df.columns]:
        raise NotFound(f"no such columns: {missing}")
    path = f"{container}/{name}"
    df.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/table")
    found = Descriptor(relation, tuple(keys), df.sparkSession.read.parquet(f"{path}/table").count())
    df.sparkSession.createDataFrame([(json.dumps(asdict(found)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/descriptor")
    return found


def descriptor(spark: SparkSession, container: str, name: str) -> Descriptor:
    row = spark.read.text(f"{container}/{name}/descriptor").where(F.col("value") != "").first()
    if row is None:
        raise NotFound(f"{container}/{name}")
    known = json.loads(row["value"])
    return Descriptor(known["relation"], tuple(known["keys"]), known["rows"])


def read_embedded(spark: SparkSession, container: str, name: str) -> DataFrame:
    """The table; filters on its keys prune folders, others reach the scan."""
    return spark.read.parquet(f"{container}/{name}/table")
