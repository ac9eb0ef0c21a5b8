import os

import pytest

from helpers import rows
from lakeloom.streaming import event_windows, read_event_stream, run_once

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet(f"{FOLDER}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_event_stream(spark, str(tmp_path / "in"), table.schema)
    run_once(event_windows(stream), "windows", str(tmp_path / "checkpoint"), mode="complete")
    strip = lambda df: df.selectExpr("window_start", "event_type", "n_events", "round(total, 2) AS total")
    assert rows(strip(spark.table("windows"))) == rows(strip(event_windows(table)))
