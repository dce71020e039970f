"""Row shapes of rasters and streams. The pixel layout has a row per pixel, the frame layout an array per frame."""

from pyspark.sql import types as T

_FRAME = [T.StructField("video", T.StringType()), T.StructField("frame", T.LongType())]
_PIXEL = [*_FRAME, T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType())]

VIDEOS = T.StructType([T.StructField("video", T.StringType()), T.StructField("path", T.StringType()), T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("fps", T.DoubleType())])
FRAMES = T.StructType([*_FRAME, T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("image", T.BinaryType())])
PIXELS = T.StructType([*_PIXEL, *[T.StructField(c, T.DoubleType()) for c in "rgb"]])
DEPTH_PIXELS = T.StructType([*_PIXEL, T.StructField("depth", T.DoubleType())])
RASTERS = T.StructType([T.StructField("path", T.StringType()), T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("values", T.ArrayType(T.FloatType()))])
_ENTRY = [T.StructField("image", T.StringType()), T.StructField("gt_depth", T.StringType()), T.StructField("factor", T.DoubleType())]
_CAMERA = [T.StructField("K", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("pose", T.ArrayType(T.ArrayType(T.DoubleType())))]
#: dataset -> [ {scene -> [entry]} ]
MANIFEST = T.MapType(T.StringType(), T.ArrayType(T.MapType(T.StringType(), T.ArrayType(T.StructType([*_ENTRY, *_CAMERA])))))
#: split -> image id -> entry
PAIRED_IMAGES = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField(c, T.StringType()) for c in ("image", "target_image", "ref_image", "prompt")])))
