"""Sources and sinks with explicit schemas: versioned Parquet, assignment CSV, score logs, camera poses, submissions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import expr

ASSIGNMENT = "seq long, video string, predicted_global_id long, component_size long, prediction_confidence double, decision_status string"
TRACKER = "video_key string, tracklet_key string, frame_idx int, x1 double, y1 double, x2 double, y2 double, score double"


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_tracklets(spark: SparkSession, path: str) -> DataFrame:
    """All ``tracklets.parquet`` under a folder, with the tracker's columns alone: none that names an identity is read."""
    return spark.read.schema(TRACKER).option("recursiveFileLookup", "true").option("pathGlobFilter", "tracklets.parquet").parquet(path)


def with_file(df: DataFrame) -> DataFrame:
    """Adds ``file``, ``stem`` and ``version`` (an array of numbers) of the file that a row comes from."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.withColumn("file", name).withColumns({"stem": F.regexp_extract("file", "^(.*?)(?:_v[0-9.]+)?\\.[a-z]+$", 1), "version": expr.version_of(F.col("file"))})


def latest_versions(df: DataFrame) -> DataFrame:
    """Of each stem the rows of its highest version (the list of files is small and is what is aggregated)."""
    rows = with_file(df)
    newest = rows.groupBy("stem").agg(F.max_by("file", "version").alias("file"))
    return rows.join(newest, ["stem", "file"], "left_semi")


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """First row of each ``seq`` wins by its other columns' order, so reading in another order changes nothing."""
    df = require(spark.read.schema(ASSIGNMENT).option("header", "true").csv(path), ["seq", "video", "predicted_global_id"])
    rest = [c for c in df.columns if c != "seq"]
    return df.groupBy("seq").agg(F.min(F.struct(*rest)).alias("r")).select("seq", "r.*")


def write_assignments(df: DataFrame, path: str) -> None:
    df.select("seq", "video", "predicted_global_id").write.mode("overwrite").option("header", "true").csv(path)


def last_matching_line(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The last line of each file that a pattern matches, by its place in the file. Lines are rows, so no file is held whole:
    splits of a file are in order of their offsets, and so are the lines of a split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    hits = lines.where(F.col("value").rlike(pattern))
    return hits.groupBy("file").agg(F.max_by(F.regexp_extract("value", pattern, 1), "at").alias("value"))


def read_weak_labels(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``tracklet_key, tokens, confidence`` from CSV with a column per attribute; a column that names a reference identity is
    left out, and unknown values give no token."""
    raw = require(spark.read.option("header", "true").csv(path), ["tracklet_key"])
    used = [c for c in columns if c in raw.columns and "global_id" not in c]
    tokens = expr.tokens_of_map(F.create_map(*[x for c in used for x in (F.lit(c), F.col(f"`{c}`"))])) if used else F.array().cast("array<string>")
    confidence = F.expr("try_cast(confidence AS double)") if "confidence" in raw.columns else F.lit(None).cast("double")
    return raw.select("tracklet_key", tokens.alias("tokens"), confidence.alias("confidence"))


def write_weak_labels(labels: DataFrame, path: str) -> None:
    """A row per tracklet with its distinct tokens, ``a:b|c:d`` in order, and its highest confidence."""
    out = labels.select("tracklet_key", "confidence", F.explode_outer("tokens").alias("token")).groupBy("tracklet_key")
    out = out.agg(F.array_join(F.array_sort(F.collect_set("token")), "|").alias("tokens"), F.max("confidence").alias("confidence"))
    out.write.mode("overwrite").option("header", "true").csv(path)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, video, id, n`` of Parquet members in submission archives: an archive is read by one task, a member at a
    time; the video is the member's stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(m for m in z.namelist() if m.endswith(".parquet")):
                        ids = pq.read_table(io.BytesIO(z.read(member)), columns=["id"]).column("id").cast(pa.int64())
                        found = ids.value_counts()
                        n = len(found)
                        columns = [pa.array([x] * n, pa.string()) for x in (name, member, member.rsplit("/", 1)[-1].removesuffix(".parquet"))]
                        yield pa.RecordBatch.from_arrays([*columns, found.field("values"), found.field("counts")], names=["archive", "member", "video", "id", "n"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, member string, video string, id long, n long")


def read_truth(spark: SparkSession, path: str, pattern: str = "(MCAM[0-9]+)") -> DataFrame:
    """Truth boxes of Parquet files, keyed by what the pattern finds in a file's name; files without it are an error of the caller's
    and have a null key."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return require(df, ["frame", "id", "x1", "y1", "x2", "y2"]).select("*", F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).alias("key"))


def camera_centre(r: Column, t: Column) -> Column:
    """C = -R' t of a rotation (array of three rows) and a translation."""
    return F.array(*[-sum((F.get(F.get(r, F.lit(k)), F.lit(i)) * F.get(t, F.lit(k)) for k in range(3)), F.lit(0.0)) for i in range(3)])


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """``camera, centre`` from JSON parameter files."""
    df = spark.read.schema("camera string, R array<array<double>>, t array<double>").json(path)
    return df.select("camera", camera_centre(F.col("R"), F.col("t")).alias("centre"))


def write_submission(rows: DataFrame, path: str) -> None:
    """One folder of Parquet per video; ids that are missing are 0, corners aren't negative."""
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long").alias(c)
    out = rows.select("video", F.col("frame").cast("long").alias("frame"), zero("id"), *[zero(c) for c in ("x1", "y1", "x2", "y2")])
    out.repartition("video").write.mode("overwrite").partitionBy("video").parquet(path)
