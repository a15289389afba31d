"""Sources over several files and over lines that come from a shuffle."""

from pyspark.sql import functions as F

from lodespark.plans import reports
from lodespark.sources import readers


def test_a_header_stands_first_before_shuffled_lines(spark):
    rows = [(f"u{i},b{i % 7}",) for i in range(300)]
    lines = spark.createDataFrame(rows, "value string").repartition(6, "value")
    path = reports._lines(spark, lines, "user_id,business_id")
    assert readers.first_line(spark.read.text(path)) == "user_id,business_id"
    got = readers.csv_columns(spark, path, ["user_id", "business_id"])
    assert sorted(f"{r.user_id},{r.business_id}" for r in got.collect()) == sorted(r[0] for r in rows)
    assert readers.csv_columns(spark, path, ["user_id", "business_id"], None).count() == 300
    assert len(spark.read.text(path).inputFiles()) > 3


def test_the_first_file_by_name_has_the_header(spark, tmp_path):
    at = tmp_path / "a b"
    at.mkdir()
    (at / "1.csv").write_text("")
    (at / "2.csv").write_text("user_id,business_id\nu1,b1\n")
    (at / "3.csv").write_text("u2,b2\nuser_id,business_id\n" + "u3,b3\n" * 50)
    got = readers.csv_columns(spark, str(at), ["user_id", "business_id"])
    assert sorted((r.user_id, r.n) for r in got.groupBy("user_id").agg(F.count("*").alias("n")).collect()) == [("u1", 1), ("u2", 1), ("u3", 50)]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "1.csv").write_text("")
    assert readers.csv_columns(spark, str(empty), ["user_id", "business_id"]).count() == 0
