"""Column types of DDL and the Spark types that hold them."""

from __future__ import annotations

from pyspark.sql import types as T

#: Type names of CREATE TABLE, in any case.
DDL_TYPES: dict[str, T.DataType] = {
    "int": T.LongType(),
    "integer": T.LongType(),
    "bigint": T.LongType(),
    "decimal": T.DoubleType(),
    "double": T.DoubleType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "char": T.StringType(),
    "varchar": T.StringType(),
    "date": T.DateType(),
}


def spark_type(name: str) -> T.DataType:
    """The type of a DDL type name; length and precision arguments don't change it.

    Integers have 64 bits and DECIMAL is a double. A name that isn't known is an error, never a string.
    """
    word = name.split("(", 1)[0].strip().lower()
    if word not in DDL_TYPES:
        raise ValueError(f"unknown column type: {name}")
    return DDL_TYPES[word]
