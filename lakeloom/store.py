"""Tables that outlive the run that loads them: Parquet in buckets, and a manifest that later runs read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Store:
    """A folder of stored tables. <folder>/<table>.json names a table's columns, bucket and sort columns, and the folder
    that holds its rows; it is written last, so a load that fails leaves the table as it was."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str = "loaded_"):
        """prefix: of the names that Spark's own catalog has for stored tables."""
        self.spark, self.folder, self.prefix = spark, folder.rstrip("/"), prefix

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def names(self) -> list[str]:
        where, fs = self._path(self.folder)
        found = fs.listStatus(where) if fs.exists(where) else []
        return sorted(f.getPath().getName().removesuffix(".json") for f in found if f.getPath().getName().endswith(".json"))

    def manifest(self, name: str) -> dict | None:
        where, fs = self._path(f"{self.folder}/{name}.json")
        if not fs.exists(where):
            return None
        return json.loads(self.spark.read.text(where.toString(), wholetext=True).first()[0])

    def save(self, name: str, df: DataFrame, keys: list[str], sort: list[str] | None = None, buckets: int = 8) -> DataFrame:
        """Store df as a table in buckets of the keys, sorted inside them, in place of an earlier one of that name, whose
        rows are deleted. Rows are kept as they are, repeated keys too. Each bucket is written by one task."""
        old = self.manifest(name)
        found = {"schema": df.schema.jsonValue(), "keys": list(keys), "sort": list(sort or keys), "buckets": buckets, "rows": f"{self.folder}/{name}-{uuid.uuid4().hex}"}
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}{name}")
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*found["sort"]).format("parquet").option("path", found["rows"]).saveAsTable(f"{self.prefix}{name}")
        where, fs = self._path(f"{self.folder}/{name}.json")
        new, _ = self._path(f"{self.folder}/.{name}-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        fs.delete(where, False)
        fs.rename(new, where)
        if old:
            gone, fs = self._path(old["rows"])
            fs.delete(gone, True)
        return self.spark.table(f"{self.prefix}{name}")

    def open(self, name: str, schema: T.StructType | None = None) -> DataFrame | None:
        """The stored table, if there is one (and it has these columns). Spark knows its buckets: a lookup by key reads one
        of them, and joins on the key need no exchange."""
        found = self.manifest(name)
        if not found:
            return None
        own = T.StructType.fromJson(found["schema"])
        if schema is not None and [(f.name, f.dataType) for f in own] != [(f.name, f.dataType) for f in schema]:
            return None
        quote = lambda names: ", ".join(f"`{n}`" for n in names)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}{name}")
        self.spark.sql(f"CREATE TABLE {self.prefix}{name} ({columns}) USING parquet CLUSTERED BY ({quote(found['keys'])}) SORTED BY ({quote(found['sort'])}) INTO {found['buckets']} BUCKETS LOCATION '{found['rows']}'")
        return self.spark.table(f"{self.prefix}{name}")
