"""PNG images, depth scans, the writer of raster files and the stream of frames, against definitions and across failures."""

import os
import struct
import zlib

import numpy as np
import pytest

from framelake.sources import depth_maps, exr, folders, png, rasters
from pyspark.sql import functions as F


def encoded(image, kinds, colour):
    """A PNG written from the definition, line by line with the given filters."""
    h, w = image.shape[:2]
    size = image.dtype.itemsize
    step = image.size // (h * w) * size
    lines = image.astype(f">u{size}").reshape(h, -1).view(np.uint8).tolist()
    body = b""
    for y, kind in zip(range(h), kinds):
        above, out = lines[y - 1] if y else [0] * len(lines[y]), []
        for i, v in enumerate(lines[y]):
            a, b, c = (lines[y][i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        body += bytes([kind, *out])
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, size * 8, colour, 0, 0, 0))]
    if colour == 3:
        parts.append((b"PLTE", bytes(range(256)) * 3))
    half = zlib.compress(body)
    parts += [(b"IDAT", half[:7]), (b"IDAT", half[7:]), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_every_filter_of_every_kind(colour, dtype):
    rng = np.random.default_rng(colour)
    n = png.CHANNELS[colour]
    image = rng.integers(0, np.iinfo(dtype).max + 1, (11, 7, n)).astype(dtype)
    image = image[..., 0] if n == 1 else image
    for kinds in ([k] * 11 for k in range(5)):
        assert np.array_equal(png.read_png(encoded(image, kinds, colour)), image)
    assert np.array_equal(png.read_png(encoded(image, rng.integers(0, 5, 11).tolist(), colour)), image)
    back = png.read_png(png.write_png(image))
    assert back.dtype == dtype and np.array_equal(back, image)


def test_palettes_and_damage():
    index = np.arange(12, dtype=np.uint8).reshape(3, 4)
    table = np.frombuffer(bytes(range(256)) * 3, np.uint8).reshape(-1, 3)
    assert np.array_equal(png.read_png(encoded(index, [1, 2, 4], 3)), table[index])
    data = bytearray(png.write_png(index))
    data[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        png.read_png(bytes(data))
    with pytest.raises(ValueError, match="not a PNG"):
        png.read_png(b"nothing")
    with pytest.raises(ValueError, match="no PNG"):
        png.write_png(np.zeros((0, 3), np.uint8))


def files(spark, rows, schema="path string, content binary"):
    return spark.createDataFrame(rows, schema)


def values_of(df):
    return {r.path: np.array(r["values"]).reshape(r.h, r.w) for r in df.collect()}


def test_predicted_depth(spark):
    rng = np.random.default_rng(2)
    colour, gray, deep = rng.integers(0, 256, (6, 8, 3)).astype(np.uint8), rng.integers(0, 256, (6, 8)).astype(np.uint8), rng.integers(0, 65536, (6, 8)).astype(np.uint16)
    array = rng.normal(size=(6, 8)).astype(np.float32)
    given = {"a.png": png.write_png(colour), "b.png": png.write_png(gray), "c.PNG": png.write_png(deep), "d.npy": folders.as_bytes(array, "npy")}
    got = values_of(depth_maps.predicted_depth(files(spark, list(given.items()))))
    r, g, b = (colour[..., i].astype(int) for i in range(3))
    assert np.array_equal(got["a.png"], (r * 4899 + g * 9617 + b * 1868 + 8192) // 16384 * 255.0)
    assert np.array_equal(got["b.png"], gray * 255.0) and np.array_equal(got["c.PNG"], (deep // 256) * 255.0) and np.array_equal(got["d.npy"], array)
    # Crop first, then size: by hand, between the four nearest.
    sized = files(spark, [(k, v, 8, 4) for k, v in given.items()], "path string, content binary, target_h int, target_w int")
    got = values_of(depth_maps.predicted_depth(sized, crop=(1, 5, 2, 8)))
    cut = array[1:5, 2:8].astype(float)
    want = np.empty((8, 4))
    for y in range(8):
        for x in range(4):
            v, u = min(max((y + 0.5) * 4 / 8 - 0.5, 0), 3), min(max((x + 0.5) * 6 / 4 - 0.5, 0), 5)
            j, i = int(v), int(u)
            j1, i1 = min(j + 1, 3), min(i + 1, 5)
            want[y, x] = (cut[j, i] * (1 - u + i) + cut[j, i1] * (u - i)) * (1 - v + j) + (cut[j1, i] * (1 - u + i) + cut[j1, i1] * (u - i)) * (v - j)
    assert np.allclose(got["d.npy"], want, atol=1e-6)
    same = files(spark, [("d.npy", given["d.npy"], 6, 8)], "path string, content binary, target_h int, target_w int")
    assert np.array_equal(values_of(depth_maps.predicted_depth(same))["d.npy"], array)


def test_true_depth_and_its_sentinels(spark):
    raw = np.array([[0, 256, 65535], [1, 0, 512]], np.uint16)
    given = files(spark, [("a.png", png.write_png(raw), 256.0), ("b.npy", folders.as_bytes(raw.astype(np.float32), "npy"), 2.0)], "path string, content binary, factor double")
    for unknown in (-1.0, 0.0):
        got = values_of(depth_maps.true_depth(given, unknown))
        assert np.array_equal(got["a.png"], np.where(raw == 0, unknown, raw / 256.0).astype(np.float32))
        assert np.array_equal(got["b.npy"], np.where(raw == 0, unknown, raw / 2.0).astype(np.float32))
    known = depth_maps.true_depth(given).filter("path = 'a.png'").select(depth_maps.known_depth(F.col("values")).alias("k")).first().k
    assert [v is None for v in known] == [True, False, False, False, True, False]


def test_factors_and_crops_of_datasets(spark):
    rows = spark.createDataFrame([("kitti_500",), ("bonn",), ("mine",)], "d string")
    assert [r.f for r in rows.select(depth_maps.dataset_factor(F.col("d")).alias("f")).collect()] == [256.0, 5000.0, None]
    raw = np.arange(400 * 1300, dtype=np.float32).reshape(400, 1300)
    kept = depth_maps.predicted_depth(files(spark, [("a.npy", folders.as_bytes(raw, "npy"))]), crop=depth_maps.dataset_crop("kitti")).first()
    assert (kept.h, kept.w) == (374, 1242) and kept["values"][1242] == 1300.0
    kept = depth_maps.predicted_depth(files(spark, [("a.npy", folders.as_bytes(raw, "npy"))]), crop=depth_maps.dataset_crop("scannet")).first()
    assert (kept.h, kept.w) == (384, 1278) and kept["values"][0] == 8 * 1300.0 + 11


def test_images_of_depth(spark):
    rows = [("a", 1, 4, 1, [-3.0, 1.9, 255.5, 300.0]), ("b", 1, 4, 1, [65536.0, 65537.9, float("nan"), None])]
    frames = spark.createDataFrame(rows, "path string, h int, w int, channels int, values array<double>")
    eight = {r.path: png.read_png(bytes(r.content)).ravel().tolist() for r in depth_maps.png_images(frames).collect()}
    sixteen = {r.path: png.read_png(bytes(r.content)).ravel().tolist() for r in depth_maps.png_images(frames, 16).collect()}
    assert eight["a"] == [0, 1, 255, 255] and sixteen["b"] == [0, 1, 0, 0] and sixteen["a"][1:] == [1, 255, 300]
    with pytest.raises(ValueError, match="8 or 16"):
        depth_maps.png_images(frames, 4)


def raster_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(f"scene{i % 3}/{i:04d}", 3, 5, 1, [float(np.float32(v)) for v in rng.uniform(0, 200, 15)]) for i in range(n)]


SCHEMA = "path string, h int, w int, channels int, values array<float>"


@pytest.mark.parametrize("kind", ["npy", "pfm", "dpt", "png", "png16"])
def test_written_files_are_read_again(spark, tmp_path, kind):
    spark.dataSource.register(folders.RasterFolder)
    rows = [(f"{p}.{kind[:3]}", *rest) for p, *rest in raster_rows(20)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit(1)).repartition(4)
    df.write.format("raster_folder").option("kind", kind).mode("append").save(out)
    want = {p: np.trunc(v) if kind.startswith("png") else np.array(v) for p, *_, v in rows}
    for back in (spark.read.format("raster_folder").load(out), rasters.read_rasters(spark, out)):
        got = {os.path.relpath(r.path.removeprefix("file:"), out): np.array(r["values"]) for r in back.collect()}
        assert got.keys() == want.keys() and all(np.array_equal(got[p], want[p]) for p in want)
    if kind == "npy":
        assert np.load(f"{out}/{rows[0][0]}").shape == (3, 5)
    fewer = spark.createDataFrame(rows[:7], SCHEMA)
    fewer.write.format("raster_folder").option("kind", kind).mode("overwrite").save(out)
    assert len(folders.rasters_below(out)) == 7 and not [d for d in os.listdir(out) if d.startswith("_")]


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    spark.dataSource.register(folders.RasterFolder)
    out = str(tmp_path / "out")
    rows = [(f"{p}.npy", *rest) for p, *rest in raster_rows(20)]
    spark.createDataFrame(rows[:2], SCHEMA).write.format("raster_folder").mode("append").save(out)
    for bad in ([("../outside.npy", 1, 1, 1, [1.0])], [("odd.npy", 2, 2, 1, [1.0])], [rows[5]]):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame(rows[2:] + bad, SCHEMA).repartition(3).write.format("raster_folder").mode("append").save(out)
        assert folders.rasters_below(out) == [f"{out}/{r[0]}" for r in sorted(rows[:2])] and os.listdir(tmp_path) == ["out"]
        assert not [d for d in os.listdir(out) if d.startswith("_")]


def test_frames_as_a_stream_lose_and_repeat_none_across_restarts(spark, tmp_path):
    spark.dataSource.register(folders.RasterFolder)
    source, out, state, progress = (str(tmp_path / x) for x in ("in", "out", "state", "progress/planned.json"))
    rows = [(f"{i:04d}.npy", 1, 2, 1, [float(i), 0.0]) for i in range(17)]
    sizes = []

    def run(batches):
        stream = spark.readStream.format("raster_folder").option("files_per_batch", 5).option("progress", progress).load(source)
        query = stream.select("path", F.col("values")[0].alias("v")).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        while len([p for p in query.recentProgress if p.numInputRows]) < batches:
            assert query.exception() is None
            query.awaitTermination(1)
        sizes.extend(p.numInputRows for p in query.recentProgress if p.numInputRows)
        query.stop()

    for part, batches in ((rows[:12], 2), (rows[12:], 2)):
        spark.createDataFrame(part, SCHEMA).write.format("raster_folder").mode("append").save(source)
        run(batches)
    run(0)
    got = sorted(r.v for r in spark.read.parquet(out).collect())
    done = len(got)
    assert max(sizes) <= 5 and got == [float(i) for i in range(done)] and done >= 15


def exr_file(channels, compression, window=(0, 0)):
    """An EXR written from the format's description; ZIP blocks are split into halves and differences."""
    names = sorted(channels)
    h, w = channels[names[0]].shape
    kinds = {np.dtype("<u4"): 0, np.dtype("<f2"): 1, np.dtype("<f4"): 2}
    chlist = b"".join(n.encode() + b"\0" + struct.pack("<iiii", kinds[channels[n].dtype], 0, 1, 1) for n in names) + b"\0"
    x0, y0 = window
    box = struct.pack("<iiii", x0, y0, x0 + w - 1, y0 + h - 1)
    head = struct.pack("<ii", 20000630, 2)
    for name, kind, value in (("channels", "chlist", chlist), ("compression", "compression", bytes([compression])), ("dataWindow", "box2i", box), ("lineOrder", "lineOrder", b"\0")):
        head += name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value
    head += b"\0"
    lines, blocks = {0: 1, 2: 1, 3: 16}[compression], []
    for y in range(0, h, lines):
        raw = b"".join(channels[n][r].tobytes() for r in range(y, min(h, y + lines)) for n in names)
        if compression:
            split = raw[::2] + raw[1::2]
            packed = zlib.compress(bytes([split[0], *((split[i] - split[i - 1] + 128) & 255 for i in range(1, len(split)))]))
            raw = packed if len(packed) < len(raw) else raw
        blocks.append(struct.pack("<ii", y0 + y, len(raw)) + raw)
    at = len(head) + 8 * len(blocks)
    table = b""
    for b in blocks:
        table, at = table + struct.pack("<Q", at), at + len(b)
    return head + table + b"".join(blocks)


@pytest.mark.parametrize("compression", [0, 2, 3])
def test_exr_images(spark, tmp_path, compression):
    rng = np.random.default_rng(compression)
    smooth = np.add.outer(np.arange(37), np.arange(21)).astype("<f4")
    channels = {"R": rng.normal(size=(37, 21)).astype("<f4"), "G": smooth.astype("<f2"), "B": smooth, "id": rng.integers(0, 9, (37, 21)).astype("<u4")}
    channels["B"][3, 4] = np.inf
    data = exr_file(channels, compression, (5, -7))
    got = exr.read_exr(data)
    assert got.keys() == channels.keys() and all(np.array_equal(got[n], channels[n]) and got[n].dtype == channels[n].dtype for n in channels)
    depth = exr.read_depth_exr(data)
    assert depth[3, 4] == 0 and np.array_equal(np.delete(depth.ravel(), 3 * 21 + 4), np.delete(smooth.ravel(), 3 * 21 + 4))
    (tmp_path / "a.exr").write_bytes(data)
    (tmp_path / "one.exr").write_bytes(exr_file({"Z": smooth[:2]}, compression))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in rasters.read_rasters(spark, str(tmp_path)).collect()}
    assert np.array_equal(rows["a.exr"]["values"], depth.ravel()) and (rows["one.exr"].h, rows["one.exr"].w) == (2, 21)
    for bad in (b"x" * 20, data[:4] + struct.pack("<i", 0x202) + data[8:], exr_file({"Z": smooth}, 0).replace(b"compression\0\x01\0\0\0\0", b"compression\0\x01\0\0\0\x04")):
        with pytest.raises(ValueError, match="EXR"):
            exr.read_exr(bad)


def test_cropped_copies(spark, tmp_path):
    spark.dataSource.register(folders.RasterFolder)
    rng = np.random.default_rng(9)
    gray, colour = rng.integers(0, 256, (6, 9)), rng.integers(0, 256, (5, 8, 3))
    rows = [("g.png", 6, 9, 1, [float(v) for v in gray.ravel()]), ("c/c.png", 5, 8, 3, [float(v) for v in colour.ravel()]), ("small.png", 1, 1, 1, [0.0])]
    out = str(tmp_path / "out")
    depth_maps.cropped(spark.createDataFrame(rows, SCHEMA), (1, 6, 2, 7)).write.format("raster_folder").option("kind", "png").mode("append").save(out)
    assert [os.path.relpath(p, out) for p in folders.rasters_below(out)] == ["c/c.png", "g.png"]
    with open(f"{out}/g.png", "rb") as f:
        assert np.array_equal(png.read_png(f.read()), gray[1:6, 2:7])
    with open(f"{out}/c/c.png", "rb") as f:
        assert np.array_equal(png.read_png(f.read()), colour[1:5, 2:7])
