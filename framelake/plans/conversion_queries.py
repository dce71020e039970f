"""The conversion from pixels with depth to stereo images, in every layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators.conversion import to_stereo
from framelake.plans import queries as q
from framelake.plans import views as v
from framelake.plans.registry import PIXEL, nudged, nudged_sql, query
from framelake.plans.views import GRID, H, W

_SCALE = {"r": 50.0, "g": 0.1, "b": 0.08}
_HALF = 3


def _unit_pixels(spark, sf):
    return v.pixels(spark, sf).select(*PIXEL, "depth", *[(F.col(c) / s).alias(c) for c, s in _SCALE.items()])


def _right_sql(dilate: int) -> str:
    """px to the tables ``lt`` and ``rt``, the eyes' pixels."""
    seen = ", ".join(f"sum(CASE WHEN hole THEN 0.0 ELSE {c} END) OVER wx AS s{c}" for c in "rgb")
    summed = ", ".join(f"sum(s{c}) OVER wy AS s{c}" for c in "rgb")
    filled = ", ".join(f"CASE WHEN NOT hole THEN {c} WHEN n > 0 THEN s{c} / n ELSE 0.0 END AS {c}" for c in "rgb")
    spread = f"CASE WHEN x < {W} - {dilate} THEN max(CASE WHEN hole THEN 1 ELSE 0 END) OVER (PARTITION BY video, frame, y ORDER BY x ROWS BETWEEN CURRENT ROW AND {dilate} FOLLOWING) = 1 ELSE hole END"
    return f"""{q._NORM}, {GRID}, lt AS (SELECT video, frame, y, x, {', '.join(f'{c} / {s} AS {c}' for c, s in _SCALE.items())} FROM px),
pk AS (SELECT video, frame, y, xt AS x, max((CAST(floor(near * 1048575.0) AS BIGINT) << 20) | src) & 1048575 AS src FROM mv GROUP BY 1, 2, 3, 4),
wn AS (SELECT pk.video, pk.frame, pk.y, pk.x, lt.r, lt.g, lt.b FROM pk JOIN lt ON lt.video = pk.video AND lt.frame = pk.frame AND lt.y * {W} + lt.x = pk.src),
hl AS (SELECT grid.video, grid.frame, grid.y, grid.x, r, g, b, r IS NULL AS hole FROM grid LEFT JOIN wn USING (video, frame, y, x)),
di AS (SELECT video, frame, y, x, r, g, b, {spread} AS hole FROM hl),
ax AS (SELECT *, sum(CASE WHEN hole THEN 0 ELSE 1 END) OVER wx AS n, {seen} FROM di WINDOW wx AS (PARTITION BY video, frame, y ORDER BY x ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING)),
ay AS (SELECT * REPLACE (sum(n) OVER wy AS n, {summed}) FROM ax WINDOW wy AS (PARTITION BY video, frame, x ORDER BY y ROWS BETWEEN {_HALF} PRECEDING AND {_HALF} FOLLOWING)),
rt AS (SELECT video, frame, y, x, {filled} FROM ay)"""


def _stereo(layout: str, dilate: int, sql: str) -> None:
    @query(f"e01_stereo_{layout}", f"WITH {_right_sql(dilate)} {sql}")
    def run(spark, sf):
        out = to_stereo(_unit_pixels(spark, sf), H, W, layout, 0.3, None, max_disparity=q.MAX_DISPARITY, dilate=dilate)
        return out.select(*PIXEL, *[nudged(c, c) for c in "rgb"])


_OWN = ", ".join(nudged_sql(c, c) for c in "rgb")
_BOTH = "FROM lt JOIN rt USING (video, frame, y, x)"
_stereo("sbs", 0, f"SELECT video, frame, y, x, {_OWN} FROM lt UNION ALL SELECT video, frame, y, x + {W}, {_OWN} FROM rt")
_stereo("ou", 2, f"SELECT video, frame, y, x, {_OWN} FROM lt UNION ALL SELECT video, frame, y + {H}, x, {_OWN} FROM rt")
_stereo("overlay", 0, "SELECT video, frame, y, x, " + ", ".join(nudged_sql(f"(lt.{c} * (1 - 0.3::DOUBLE) + rt.{c} * 0.3::DOUBLE)", c) for c in "rgb") + f" {_BOTH}")
_stereo("anaglyph", 2, f"SELECT video, frame, y, x, {nudged_sql('lt.r', 'r')}, {nudged_sql('rt.g', 'g')}, {nudged_sql('rt.b', 'b')} {_BOTH}")
