"""Tables as pipe-delimited text: one row a line, no header, no quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXTRA = "_trailing"


def read_text_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a .dat file or folder, in the schema's types.

    A delimiter at the end of a line makes no column. Blank lines are left out. A cell that can't be
    parsed is null and the rest of its row stays. Nothing is quoted or escaped.
    """
    wide = T.StructType([*schema.fields, T.StructField(_EXTRA, T.StringType())])
    reader = spark.read.schema(wide).options(sep="|", header=False, mode="PERMISSIVE", dateFormat="yyyy-MM-dd", quote="", escape="", comment="", nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return reader.csv(path).drop(_EXTRA)


def write_text_table(df: DataFrame, path: str, mode: str = "errorifexists", trailing: bool = True) -> None:
    """Write what read_text_table() reads."""
    df.select(render_line(df, trailing).alias("value")).write.mode(mode).text(path)


def render_cell(name: str, kind: T.DataType):
    text = F.date_format(name, "yyyy-MM-dd") if isinstance(kind, T.DateType) else F.col(name).cast("string")
    return F.coalesce(text, F.lit(""))


def render_line(df: DataFrame, trailing: bool = False):
    """A row as text: cells in order, pipes between them, a null as nothing."""
    cells = [render_cell(f"`{f.name}`", f.dataType) for f in df.schema.fields]
    return F.concat(F.concat_ws("|", *cells), F.lit("|" if trailing else ""))
