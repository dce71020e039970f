"""Nested containers, camera archives, lists by category, micro-batches, losses of known pixels."""

import numpy as np

from framelake import functions as fn
from framelake.operators import evaluation as ev
from framelake.operators.model import Luminance, infer_depth
from framelake.sources.listing import category_objects
from framelake.sources.rasters import camera_arrays
from pyspark.sql import functions as F


def test_nested_map_reaches_every_leaf(spark):
    df = spark.createDataFrame([(1, ([1, None], {"a": (2,)}, 3)), (2, None), (3, (None, None, None))], "id int, n struct<a:array<int>,m:map<string,struct<x:int>>,v:int>")
    got = {r.id: r.n for r in df.select("id", fn.nested_map(F.col("n"), df.schema["n"].dataType, lambda c: c * 10).alias("n")).collect()}
    assert got[1].a == [10, None] and got[1].m["a"].x == 20 and got[1].v == 30
    assert got[2] is None and (got[3].a, got[3].m, got[3].v) == (None, None, None)


def test_camera_arrays(spark, tmp_path):
    given = {"world_mat_0": np.arange(16.0).reshape(4, 4), "scale_mat_0": np.eye(4)[:3]}
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        np.savez(tmp_path / name / "cameras.npz", label=np.array(["x"]), **given)
    rows = camera_arrays(spark, str(tmp_path)).collect()
    assert sorted((r.path.split("/")[-2], r.name) for r in rows) == [(n, k) for n in ("one", "two") for k in sorted(given)]
    assert all(np.array_equal(np.reshape(r["values"], r.shape), given[r.name]) for r in rows)


def test_category_objects(spark, tmp_path):
    for cat, names in {"car": "a\n b \n\n", "sofa": "c\n"}.items():
        (tmp_path / cat).mkdir()
        (tmp_path / cat / "softras_train.lst").write_text(names)
    (tmp_path / "bench").mkdir()
    got = category_objects(spark, str(tmp_path), "train").collect()
    assert sorted((r.category, r.object, r.path.endswith(f"/{r.category}/{r.object}")) for r in got) == [("car", "a", True), ("car", "b", True), ("sofa", "c", True)]
    assert category_objects(spark, str(tmp_path / "none"), "train").count() == 0


def test_micro_batches_change_nothing(spark):
    class Batched(Luminance):
        def predict_batch(self, h, w, images):
            assert len(images) <= 3
            return [self.predict(h, w, i) for i in images]

    rng = np.random.default_rng(1)
    rows = [("v", i, h, 2, bytes(rng.integers(0, 255, h * 6, dtype=np.uint8))) for i, h in enumerate((2, 2, 2, 2, 3, 2, 2))]
    df = spark.createDataFrame(rows, "video string, frame long, h int, w int, image binary").coalesce(1)
    one, many = ({r.frame: list(r["values"]) for r in infer_depth(df, m, 3).collect()} for m in (Luminance(), Batched()))
    assert one == many and len(one) == 7


def test_depth_losses_take_known_pixels(spark):
    rows = [("a", 1, 2.0, 1.5), ("a", 1, 9.0, 5.0), ("a", 1, 4.0, 0.0), ("a", 2, 1.0, 1e-5)]
    got = {r.stage: r for r in ev.depth_losses(spark.createDataFrame(rows, "scene string, stage int, pred double, gt double"), ("scene", "stage")).collect()}
    assert (got[1].l1, got[1].l2, got[1].smooth) == ((0.5 + 4) / 2, (0.25 + 16) / 2, (0.125 + 3.5) / 2)
    assert (got[2].l1, got[2].l2, got[2].smooth) == (0, 0, 0)
