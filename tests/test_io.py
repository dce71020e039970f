"""Sources, sinks, streams, plug-ins and the entry module."""

import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from framelake.operators.model import Luminance, infer_depth
from framelake.plans import queries as plans
from framelake.plans.streams import smoothed_events
from framelake.schemas import FRAMES
from framelake.sources import folders, listing, manifest, rasters, sinks
from framelake.streaming import attended_stream, run_once

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_listing(spark, tmp_path):
    for name in ("b.mp4", "a.mp4", "c.txt.bak", "deep/z.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = [r.path.rsplit("/", 1)[-1] for r in listing.list_files(spark, str(tmp_path)).collect()]
    assert found == ["a.mp4", "b.mp4", "z.mp4"]
    (tmp_path / "list.txt").write_text(f"\n  {tmp_path}/b.mp4 \n{tmp_path}/missing.mp4\n/nowhere/x.mp4\n")
    assert [r.path.rsplit("/", 1)[-1] for r in listing.list_files(spark, str(tmp_path / "list.txt")).collect()] == ["b.mp4"]
    assert listing.list_files(spark, str(tmp_path / "a.mp4")).count() == 1


def test_view_table(spark):
    row = listing.view_table(spark.createDataFrame([("chair obj1 3 5 7",), ("chair obj2",)], "value string")).orderBy("object").collect()
    assert (row[0].category, row[0].views, row[1].views) == ("chair", [3, 5, 7], [])


def test_manifest_round_trip_with_cameras(spark):
    json = '{"kitti": [{"s1": [{"image": "a.jpg", "gt_depth": "a.png", "factor": 256.0, "K": [[1.0, 0.0]], "pose": [[1.0]]}, {"image": "b.jpg", "gt_depth": "b.png", "factor": 256.0}]}]}'
    rows = manifest.flatten_manifest(spark.createDataFrame([(json,), (None,), ("broken",)], "json string")).orderBy("frame").collect()
    assert [(r.scene, r.frame, r.image) for r in rows] == [("s1", 0, "a.jpg"), ("s1", 1, "b.jpg")] and rows[0].K == [[1.0, 0.0]]
    again = manifest.flatten_manifest(manifest.build_manifest(spark.createDataFrame(rows).select("dataset", "scene", "frame", "image", "gt_depth", "factor")))
    assert sorted(r.image for r in again.collect()) == ["a.jpg", "b.jpg"]


def test_pairs_skip_bad_entries(spark):
    json = '{"train": {"1": {"image": "a", "target_image": "b", "prompt": "p"}, "2": {"image": "c"}}}'
    rows = manifest.flatten_pairs(spark.createDataFrame([(json,)], "json string")).collect()
    assert [(r.image_id, r.ref_image) for r in rows] == [("1", None)]


def test_strict_zip_needs_equal_lengths(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p")], "k int, b string")
    assert manifest.positional_zip(a, b, ["k"], F.col("a"), F.col("b")).count() == 1
    with pytest.raises(Exception, match="equal length"):
        manifest.positional_zip(a, b, ["k"], F.col("a"), F.col("b"), strict=True).collect()


def test_raster_formats(spark, tmp_path):
    image = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "a.dpt").write_bytes(np.float32(rasters.DPT_TAG).tobytes() + np.array([3, 2], "<i4").tobytes() + image.tobytes())
    (tmp_path / "b.pfm").write_bytes(b"Pf\n3 2\n-1.0\n" + np.flipud(image).tobytes())
    (tmp_path / "c.pfm").write_bytes(b"Pf\n3 2\n1.0\n" + np.flipud(image).astype(">f4").tobytes())
    np.save(tmp_path / "d.npy", image)
    for rows in (rasters.read_rasters(spark, str(tmp_path)).collect(), _by_source(spark, tmp_path)):
        assert len(rows) == 4 and all(r["values"] == image.ravel().tolist() and (r.h, r.w, r.channels) == (2, 3, 1) for r in rows)
    px = rasters.to_pixels(rasters.read_rasters(spark, str(tmp_path)))
    assert px.filter("y = 1 AND x = 2").first().depth == 5.0
    assert rasters.to_frames(px, ["path"], 3).first()["values"] == image.ravel().tolist()
    with pytest.raises(ValueError):
        rasters.read_dpt(b"\0" * 20)
    with pytest.raises(ValueError):
        rasters.read_pfm(b"P6\n")


def _by_source(spark, folder):
    spark.dataSource.register(folders.RasterFolder)
    return spark.read.format("raster_folder").load(str(folder)).collect()


def test_sinks(spark, tmp_path):
    points = spark.createDataFrame([(0.0, 1.0, 2.0, 0.5, 0.0, 2.0)], "x double, y double, z double, r double, g double, b double")
    sinks.write_ply(points, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p/header")).count() == 10
    assert spark.read.text(str(tmp_path / "p/vertices")).first().value == "0.0 1.0 2.0 127 0 255"
    for _ in range(2):
        sinks.append_results(spark.createDataFrame([("kitti", 0.1, None)], "dataset string, abs_rel double, d1 double"), str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["dataset: kitti, abs_rel: 0.1, d1: nan"] * 2
    frames = spark.createDataFrame([("v", i, float(i)) for i in range(4)], "video string, frame int, depth double")
    assert [r.level for r in sinks.clip_normalised(frames).orderBy("frame").collect()] == [0, 85, 170, 255]
    sinks.write_frames(frames, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4
    with pytest.raises(sinks.MissingEncoder):
        sinks.encode_video()


def test_depth_model(spark):
    frames = spark.createDataFrame([("v", 0, 1, 2, bytearray([255] * 3 + [0] * 3))], FRAMES)
    assert np.allclose(infer_depth(frames, Luminance()).first()["values"], [1.0, 0.0])


def test_stream_equals_batch(spark, tmp_path):
    got = {r.video: r.smoothed for r in smoothed_events(spark, SF, str(tmp_path)).collect()}
    batch = plans.QUERIES["w01_ema"](spark, SF).toPandas().sort_values("idx").groupby("video").last()
    assert got.keys() == batch.smoothed.to_dict().keys() and all(abs(got[k] - x) < 1e-6 for k, x in batch.smoothed.to_dict().items())


def test_attended_frames_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(v, i) for v in (1, 2) for i in range(50)], "video long, idx long")
    rows.repartition("video").sortWithinPartitions("video", "idx").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    run_once(attended_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.video, r.idx): r.attended for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, 0] == [] and got[2, 45] == [0, 4, *range(16, 45)] and len(got) == 100


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, SF), con.sql(plans.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(map(repr, (tuple(r) for r in got.select(columns).collect())))
    b = sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert a == b and a


def test_library_stands_without_the_text_package(tmp_path):
    """The rest imports and lists its queries where the text package and the pipeline are gone."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/framelake", tmp_path / "framelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'a18_aligned_eval' in e.queries() and not any(n.startswith('op') for n in e.queries() if n[2:3].isdigit())"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    shutil.copytree(f"{root}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    # Every test of the rest can be collected there; some run.
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout
    done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests", "-k", "manifest_with_cameras or entry_and_names or general_inverse"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and "3 passed" in done.stdout, done.stdout
