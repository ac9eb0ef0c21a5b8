"""Tables of a session: declared by DDL over text, or Parquet as it is."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lakeloom.ddl import TableDef, parse_create_table
from lakeloom.loose import rewrite_loose_group
from lakeloom.sources.text import read_text_table
from lakeloom.store import Store


class Catalog:
    """Named tables of one session, each also a temporary view. Names are case-insensitive."""

    def __init__(self, spark: SparkSession, data: str = ".", temp: str | None = None, db: str | None = None):
        """data: the folder of text tables; temp: that of the table named temp; db: that of stored tables, which are
        there from the start. Without db, tables are stored for this session only."""
        self.spark, self.data, self.temp = spark, data.rstrip("/"), (temp or data).rstrip("/")
        self.tables: dict[str, TableDef] = {}
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        self.kept, self.store = db is not None, Store(spark, db or f"{warehouse}/session-{spark.sparkContext.applicationId}")
        for name in self.store.names() if self.kept else []:
            self.store.open(name).createOrReplaceTempView(name)

    def create(self, statement: str) -> TableDef:
        """Register the table of a CREATE TABLE statement: the stored one, if an earlier run has loaded a table with that
        name and these columns, else <data>/<table>.dat; the table named temp lies in the temporary folder."""
        table = parse_create_table(statement)
        self.tables[table.name] = table
        stored = self.store.open(table.name, table.schema) if self.kept else None
        (self.text(table.name) if stored is None else stored).createOrReplaceTempView(table.name)
        return table

    def text(self, name: str) -> DataFrame:
        table = self.tables[name.lower()]
        return read_text_table(self.spark, f"{self.temp if table.name == 'temp' else self.data}/{table.name}.dat", table.schema)

    def parquet(self, *names: str, folder: str | None = None) -> None:
        """Register <folder>/<name>.parquet as views."""
        for name in names:
            self.spark.read.parquet(f"{folder or self.data}/{name}.parquet").createOrReplaceTempView(name)

    def sql(self, query: str) -> DataFrame:
        """A query over the tables. Where Spark refuses it for columns that are neither grouped nor
        aggregated, these are taken from one row of their group (see loose.py)."""
        try:
            return self.spark.sql(query)
        except AnalysisException as e:
            refused = ("MISSING_AGGREGATION", "UNRESOLVED_COLUMN.WITH_SUGGESTION", "MISSING_GROUP_BY")
            loose = rewrite_loose_group(query, self._columns) if e.getCondition() in refused else None
            if loose is None:
                raise
            return self.spark.sql(loose)

    def _columns(self, source: str) -> set[str]:
        """The columns of a FROM clause."""
        return {c.lower() for c in self.spark.sql(f"SELECT * FROM {source}").columns}
