"""Sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lakeloom", warehouse: str | None = None, local_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with what the engine relies on: adaptive plans, UTC, Arrow. Master, memory and sizes
    come from spark-submit or conf; nothing here fixes them."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **({"spark.sql.warehouse.dir": warehouse} if warehouse else {}),
        **({"spark.local.dir": local_dir} if local_dir else {}),
        **conf,
    }
    return builder.config(map=settings).getOrCreate()
