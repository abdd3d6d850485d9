"""Databases and bundles: a catalog namespace per dataset with tables made if absent, and pickled tracklets as rows."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a dataset's database.
TABLES = {
    "detections": "det_id BIGINT, camera STRING, video STRING, frame_idx BIGINT, abs_ms BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, conf DOUBLE, seq BIGINT",
    "tracklets": "seq BIGINT, camera STRING, video STRING, t0 BIGINT, t1 BIGINT, n_dets BIGINT, vec ARRAY<DOUBLE>",
    "decisions": "step BIGINT, seq BIGINT, gid BIGINT, decision_type STRING, candidates ARRAY<BIGINT>, scores ARRAY<DOUBLE>",
    "merges": "merge_id BIGINT, at_seq BIGINT, old_gid BIGINT, new_gid BIGINT",
}


def database(dataset: str) -> str:
    return "gallery_" + dataset.replace("-", "_")


def ensure_database(spark: SparkSession, dataset: str, tables: dict[str, str] | None = None, location: str | None = None) -> str:
    """Makes a dataset's database and its tables where they are absent; what is there stays. Returns its name."""
    name = database(dataset)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`" + (f" LOCATION '{location}'" if location else ""))
    for table, columns in (tables or TABLES).items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}`.`{table}` ({columns}) USING parquet")
    return name


def replace_rows(df: DataFrame, table: str) -> None:
    """A table's rows give way to new ones, its columns stay: the truncate before an ingest. Columns go by name."""
    columns = df.sparkSession.table(table).schema
    df.select(*[F.col(f.name).cast(f.dataType) for f in columns]).write.mode("overwrite").insertInto(table)


class _Plain(pickle.Unpickler):
    """Builtin containers and numpy arrays alone: a bundle can name no other code."""

    ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer")}

    def find_class(self, module: str, name: str):
        if (module, name) not in self.ALLOWED:
            raise pickle.UnpicklingError(f"a bundle may not name {module}.{name}")
        return super().find_class(module, name)


BUNDLE = "file string, video string, camera string, tracklet_key string, t0 double, frame0 long, frames array<long>, det_ids array<string>, boxes array<array<double>>, vec array<double>"


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Tracklets of pickled bundles: lists of ``video, cam, dids, frames, boxes, reds, t0``. The vector is the mean of a track's,
    brought to length 1. A bundle is read by one task; order rows by ``t0, video, frame0`` to feed them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                for t in _Plain(io.BytesIO(content)).load():
                    mean = np.mean(np.asarray(t["reds"], float), axis=0)
                    frames, ids = [int(f) for f in t["frames"]], [str(d) for d in t["dids"]]
                    key = t.get("tracklet_key") or t.get("key") or ids[0]
                    rows.append({
                        "file": name, "video": t["video"], "camera": t.get("cam") or t.get("camera"), "tracklet_key": str(key), "t0": float(t["t0"]), "frame0": frames[0], "frames": frames,
                        "det_ids": ids, "boxes": np.asarray(t["boxes"], float).tolist(), "vec": (mean / (np.linalg.norm(mean) + 1e-9)).tolist(),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    text, number, whole = pa.string(), pa.float64(), pa.int64()
    schema = pa.schema([("file", text), ("video", text), ("camera", text), ("tracklet_key", text), ("t0", number), ("frame0", whole), ("frames", pa.list_(whole)), ("det_ids", pa.list_(text)), ("boxes", pa.list_(pa.list_(number))), ("vec", pa.list_(number))])
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pkl").load(path).select("path", "content").mapInArrow(run, BUNDLE)
