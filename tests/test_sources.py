"""Sources and sinks: round trips on small files."""

from pyspark.sql import functions as F

from loomline.functions import expr
from loomline.sources import io


def test_latest_version_and_logs(spark, tmp_path):
    for name, value in (("cam_v1.9.csv", 1), ("cam_v1.10.csv", 2), ("door_v2.csv", 3)):
        (tmp_path / name).write_text(f"{value}\n")
    rows = io.latest_versions(spark.read.schema("value int").csv(str(tmp_path)))
    assert {(r.stem, r.value) for r in rows.collect()} == {("cam", 2), ("door", 3)}
    (tmp_path / "score.log").write_text("IDF1=0.1\nother\nIDF1=0.7\ntail\n")
    assert [r.value for r in io.last_matching_line(spark, f"{tmp_path}/score.log", "IDF1=([0-9.]+)").collect()] == ["0.7"]


def test_assignments_and_submission(spark, tmp_path):
    df = spark.createDataFrame([(1, "v", 7), (2, "w", 8)], "seq long, video string, predicted_global_id long")
    io.write_assignments(df, f"{tmp_path}/a")
    got = spark.read.option("header", "true").csv(f"{tmp_path}/a")
    assert got.count() == 2
    rows = df.select("video", F.lit(3).alias("frame"), F.when(F.col("seq") == 1, F.col("predicted_global_id")).alias("id"), F.lit(-4).alias("x1"), *[F.lit(5).alias(c) for c in ("y1", "x2", "y2")])
    io.write_submission(rows, f"{tmp_path}/s")
    assert {(r.video, r.id, r.x1) for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {("v", 7, 0), ("w", 0, 0)}


def test_poses_and_functions(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"camera": "C1", "R": [[1,0,0],[0,0,-1],[0,1,0]], "t": [1,2,3]}\n')
    assert io.read_poses(spark, f"{tmp_path}/p.json").first().centre == [-1.0, -3.0, 2.0]
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first().x
    assert f(expr.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"))) is None
    assert 900 < f(expr.haversine_m(F.lit(38.92), F.lit(-77.0), F.lit(38.92), F.lit(-77.0 + 0.011))) < 1000
    assert f(expr.tokens_of_map(F.create_map(F.lit("Color"), F.lit(" Black "), F.lit("hat"), F.lit("unknown")))) == ["color:black"]
    assert f(expr.clock_ms(F.lit("01:02:03.250"))) == 3723250
    assert f(expr.colour(F.lit(200), F.lit(30), F.lit(30))) == "red" and f(expr.colour(F.lit(None), F.lit(1), F.lit(1))) == "unknown"


def test_labels_archives_truth_and_logs(spark, tmp_path):
    import zipfile

    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "w.csv").write_text("tracklet_key,upper_color,hat,confidence,reference_global_id\na,Red,unknown,0.5,7\nb,,Yes,x,8\n")
    labels = io.read_weak_labels(spark, f"{tmp_path}/w.csv", ["upper_color", "hat", "reference_global_id"])
    assert sorted(map(tuple, labels.collect())) == [("a", ["upper_color:red"], 0.5), ("b", ["hat:yes"], None)]
    io.write_weak_labels(labels.unionByName(labels), f"{tmp_path}/out")
    assert sorted(map(tuple, spark.read.option("header", "true").csv(f"{tmp_path}/out").collect())) == [("a", "upper_color:red", "0.5"), ("b", "hat:yes", None)]
    table = pa.table({"frame": [1, 2, 3], "id": [4, 4, 5], "x1": [0, 0, 0], "y1": [0, 0, 0], "x2": [1, 1, 1], "y2": [1, 1, 1]})
    pq.write_table(table, tmp_path / "gt_MCAM07_a.parquet")
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt_MCAM07_a.parquet").rename(tmp_path / "gt" / "gt_MCAM07_a.parquet")
    assert {(r.key, r.id) for r in io.read_truth(spark, f"{tmp_path}/gt").collect()} == {("MCAM07", 4), ("MCAM07", 5)}
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.write(tmp_path / "gt" / "gt_MCAM07_a.parquet", "sub/V1.parquet")
        z.writestr("readme.txt", "x")
    assert {(r.video, r.id, r.n) for r in io.read_submissions(spark, str(tmp_path)).collect()} == {("V1", 4, 2), ("V1", 5, 1)}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("score=1\nother\nscore=3\nscore=2\nend\n")
    assert [r.value for r in io.last_matching_line(spark, f"{tmp_path}/logs", "score=([0-9]+)").collect()] == ["2"]
