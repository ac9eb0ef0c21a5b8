"""Physical layout: tables bucketed and sorted by key, so that lookups read one bucket and joins on the
key need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakeloom.catalog import Catalog
from lakeloom.store import Store


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder in the warehouse that no other session writes to."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, sort: list[str] | None = None) -> DataFrame:
    """Store df in the warehouse as a table bucketed by keys and sorted inside the buckets, in place of an earlier one
    of that name."""
    spark = df.sparkSession
    return Store(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{spark.sparkContext.applicationId}", "").save(table, df, keys, sort, buckets)


def load(catalog: Catalog, name: str, buckets: int, index: str | None = None) -> DataFrame:
    """Load a declared table into the catalog's store: the index column that is given, else the first that DDL declares,
    else the primary key, else the first column decides the bucket; the primary key orders the rows in it."""
    table = catalog.tables[name.lower()]
    key = index or next(iter(table.indexes), None)
    if key and key not in table.schema.names:
        raise ValueError(f"{table.name} has no column {key}")
    keys = [key] if key else list(table.primary_key) or [table.schema.names[0]]
    sort = list(dict.fromkeys([*keys, *table.primary_key]))
    out = catalog.store.save(table.name, catalog.text(name), keys, sort, buckets)
    out.createOrReplaceTempView(table.name)
    return out


def load_sorted(df: DataFrame, path: str, by: str, part: str | None = None) -> DataFrame:
    """Store df in ranges of a column (a date, say), so that range predicates skip files by their
    statistics; part: a column of few values to split folders by."""
    writer = df.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite")
    (writer.partitionBy(part) if part else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def lookup(spark: SparkSession, table: str, column: str, value) -> DataFrame:
    """Rows with one value of an index column: a filter, which Spark turns into bucket pruning."""
    df = spark.table(table)
    return df.where(df[column] == value)
