"""Clean-up covers every part, in palettes of bounded size."""

import os

from pyspark.sql import functions as F

from rasterloom.operators.palette import MOST_COLOURS
from rasterloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_palette_cleanup_keeps_no_part_out(spark, tmp_path):
    parts = spark.read.parquet(f"{DATA}/part.parquet")
    # more parts than any fixed range of ids holds
    more = parts.unionByName(parts.withColumn("p_partkey", F.col("p_partkey") + 100_000))
    more.write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.queries()["palette_cleanup"](spark, str(tmp_path)).collect()
    assert sorted(r["image_id"] * MOST_COLOURS + r["palette_index"] for r in got) == sorted(r[0] for r in more.select("p_partkey").collect())
    for r in got:
        assert 0 <= r["new_index"] < MOST_COLOURS
