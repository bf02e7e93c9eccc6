"""Named queries of slide pairs and level lines: staining measured through a transform, previews, consensus fits, mutual information.

The image of ``image_queries`` is the first slide, one region a slide; another grid of lineitem rows is the second.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lamella.image_queries import _GRID, _INVERSE, BY, image
from lamella.operators import contours, pairing, registration
from lamella.queries import query, six, table

#: The transform of the queries, in micrometres, and the scales of both slides.
_M = (0.93, -0.12, 3.25, 0.11, 0.96, -1.5)
_HE, _P53 = (0.5, 0.5), (0.4, 0.45)
_OFF, _W, _H, _CUT = (12, 7), 66, 58, 0.05

_SECOND = f"""src AS (SELECT l_returnflag AS slide, (l_orderkey // 7) % {_H} AS row, l_partkey % {_W} AS col, max(l_suppkey * 37 % 256)::INT AS r, max(l_partkey * 11 % 256)::INT AS g, max(l_orderkey * 3 % 256)::INT AS b, min(CASE WHEN l_orderkey % 29 = 0 THEN 254 ELSE 255 END)::INT AS a FROM lineitem GROUP BY ALL)"""


def second(spark, sf):
    x = table(spark, sf, "lineitem")
    by = [F.col("l_returnflag").alias("slide"), F.expr(f"(l_orderkey div 7) % {_H}").alias("row"), (F.col("l_partkey") % _W).alias("col")]
    colour = lambda c, k: F.max(F.col(c) * k % 256).cast("int")
    return x.groupBy(*by).agg(colour("l_suppkey", 37).alias("r"), colour("l_partkey", 11).alias("g"), colour("l_orderkey", 3).alias("b"), F.min(F.when(F.col("l_orderkey") % 29 == 0, 254).otherwise(255)).cast("int").alias("a"))


def _pair(spark, slides):
    numbers = lambda v: F.array(*[F.lit(float(i)) for i in v])
    return slides.withColumns({"m": numbers(_M), "he_mpp": numbers(_HE), "p53_mpp": numbers(_P53), "width": F.lit(_W), "height": F.lit(_H), "dab_threshold": F.when(F.col("slide") != "N", _CUT)})


_PLACES = f"""pl AS (SELECT region AS slide, row, col, label, ({_M[0]}::DOUBLE * ((col + {_OFF[0]}) * {_HE[0]}::DOUBLE) + {_M[1]}::DOUBLE * ((row + {_OFF[1]}) * {_HE[1]}::DOUBLE) + {_M[2]}::DOUBLE) / {_P53[0]}::DOUBLE AS px,
  ({_M[3]}::DOUBLE * ((col + {_OFF[0]}) * {_HE[0]}::DOUBLE) + {_M[4]}::DOUBLE * ((row + {_OFF[1]}) * {_HE[1]}::DOUBLE) + {_M[5]}::DOUBLE) / {_P53[1]}::DOUBLE AS py FROM img WHERE label > 0)"""
_WARPED = f"""{_PLACES}, st AS (SELECT *, round_even(px * 32, 0)::BIGINT AS sx, round_even(py * 32, 0)::BIGINT AS sy, px >= 0 AND py >= 0 AND px < {_W - 1} AND py < {_H - 1} AS inside FROM pl),
nb AS (SELECT st.slide, st.row, st.col, (CASE WHEN i = 1 THEN sx % 32 ELSE 32 - sx % 32 END) * (CASE WHEN j = 1 THEN sy % 32 ELSE 32 - sy % 32 END) AS w, sx // 32 + i AS c, sy // 32 + j AS r FROM st, range(2) u(i), range(2) v(j) WHERE inside),
val AS (SELECT nb.slide, nb.row, nb.col, floor(sum(s.r * w) / 1024.0 + 0.5)::INT AS r, floor(sum(s.g * w) / 1024.0 + 0.5)::INT AS g, floor(sum(s.b * w) / 1024.0 + 0.5)::INT AS b, floor(sum(s.a * w) / 1024.0 + 0.5)::INT AS a FROM nb JOIN src s ON s.slide = nb.slide AND s.row = nb.r AND s.col = nb.c WHERE w > 0 GROUP BY ALL),
wp AS (SELECT st.slide, st.label, coalesce(a = 255, false) AS mapped, CASE WHEN a = 255 THEN r ELSE 255 END AS r, CASE WHEN a = 255 THEN g ELSE 255 END AS g, CASE WHEN a = 255 THEN b ELSE 255 END AS b FROM st LEFT JOIN val USING (slide, row, col)),
dab AS (SELECT *, greatest(0, {" + ".join(f"(-ln(greatest({c}::DOUBLE / 255, 1e-6)) / {float(math.log(1e6))!r}) * {float(_INVERSE[i, 2])!r}" for i, c in enumerate("rgb"))}) AS d,
  ((least(r, g, b) < 230 AND greatest(r, g, b) - least(r, g, b) > 10) OR (r + g + b) / 3.0 < 180) AND (r + g + b) / 3.0 > 15 AS tissue FROM wp)"""


@query(f"""WITH {_GRID}, {_SECOND}, {_WARPED} SELECT slide, label AS cell_label, round(avg(d) FILTER (WHERE mapped), 6) AS p53_dab_mean, round(stddev_pop(d) FILTER (WHERE mapped), 6) AS p53_dab_std,
CASE WHEN slide <> 'N' THEN round(sum((mapped AND d >= {_CUT})::INT)::DOUBLE / nullif(sum(mapped::INT), 0), 6) END AS p53_positive_fraction, round(sum(mapped::INT)::DOUBLE / count(*), 6) AS p53_mapped_fraction,
round(sum((mapped AND tissue)::INT)::DOUBLE / greatest(sum(mapped::INT), 1), 6) AS p53_tissue_fraction, round(sqrt(count(*) * 0.25 / pi()), 6) AS p53_equivalent_radius_um FROM dab GROUP BY slide, label""")
def pair_staining(spark, sf):
    nuclei = image(spark, sf).select(F.col("region").alias("slide"), F.lit("R").alias("region"), "row", "col", "label")
    slides = nuclei.select("slide").distinct()
    offsets = slides.select("slide", F.lit("R").alias("region"), F.lit(_OFF[0]).cast("long").alias("off_x"), F.lit(_OFF[1]).cast("long").alias("off_y"))
    x = pairing.measure(nuclei, pairing.with_source_tiles(second(spark, sf), 16), offsets, _pair(spark, slides), tile=13, side=16).drop("region")
    return six(x, *[c for c in x.columns if c not in ("slide", "cell_label")])


@query(f"""WITH {_GRID}, {_SECOND}, {_PLACES}, bx AS (SELECT slide, row // 13 AS tile_row, col // 13 AS tile_col, floor(min(px))::BIGINT AS x0, floor(min(py))::BIGINT AS y0, ceil(max(px))::BIGINT + 2 AS x1, ceil(max(py))::BIGINT + 2 AS y1 FROM pl WHERE px >= 0 AND py >= 0 AND px < {_W - 1} AND py < {_H - 1} GROUP BY ALL)
SELECT slide, r.i::BIGINT AS source_row, c.i::BIGINT AS source_col, count(DISTINCT tile_row * 100 + tile_col) AS tiles FROM bx, range(9) r(i), range(9) c(i) WHERE r.i >= y0 // 8 AND r.i <= (y1 - 1) // 8 AND c.i >= x0 // 8 AND c.i <= (x1 - 1) // 8 GROUP BY ALL""")
def pair_source_tiles(spark, sf):
    nuclei = image(spark, sf).select(F.col("region").alias("slide"), F.lit("R").alias("region"), "row", "col", "label")
    slides = nuclei.select("slide").distinct()
    offsets = slides.select("slide", F.lit("R").alias("region"), F.lit(_OFF[0]).cast("long").alias("off_x"), F.lit(_OFF[1]).cast("long").alias("off_y"))
    boxes = pairing.source_boxes(pairing.mapped_places(nuclei, pairing._frames(offsets, _pair(spark, slides))), 13)
    asked = pairing.source_tiles(boxes, 8)
    near = boxes.join(asked, "slide").filter("source_row BETWEEN y0 div 8 AND (y1 - 1) div 8 AND source_col BETWEEN x0 div 8 AND (x1 - 1) div 8")
    return near.groupBy("slide", "source_row", "source_col").agg(F.count_distinct("tile_row", "tile_col").alias("tiles"))


# --- previews ------------------------------------------------------------------------------------------------------------


_FRAMES = "fr AS (SELECT region AS slide, 40 AS width, 40 AS height FROM (SELECT DISTINCT region FROM img))"


@query(f"""WITH {_GRID}, p AS (SELECT region AS slide, row * 27 // 40 AS row, col * 27 // 40 AS col, avg(r) AS v FROM img GROUP BY ALL), s AS (SELECT 40 / 27.0::DOUBLE * 0.25 AS sx),
k AS (SELECT unnest([1, 2, 4, 6]) AS k), l AS (SELECT slide, k, row // k AS row, col // k AS col, avg(v) AS v, count(*) AS n FROM p, k GROUP BY ALL)
SELECT slide, k AS factor, row, col, round(v, 6) AS v, n, round(sx * k, 6) AS spacing, round((sx - 0.25) / 2 + sx * (k - 1) / 2, 6) AS origin FROM l, s""")
def preview_pyramid(spark, sf):
    x = image(spark, sf).select(F.col("region").alias("slide"), "row", "col", F.col("r").cast("double").alias("v"))
    slides = x.select("slide").distinct().withColumns({"width": F.lit(40), "height": F.lit(40), "mpp_x": F.lit(0.25), "mpp_y": F.lit(0.25)})
    p, f = registration.preview(x, slides, 27, ["v"])
    out = None
    for k, (level, frame) in zip((1, 2, 4, 6), registration.pyramid(p, f, ["v"], (1, 2, 4, 6)), strict=True):
        own = level.join(frame, "slide").select("slide", F.lit(k).alias("factor"), "row", "col", "v", "n", F.col("sx").alias("spacing"), F.col("ox").alias("origin"))
        out = own if out is None else out.unionByName(own)
    return six(out, "v", "spacing", "origin")


# --- consensus -----------------------------------------------------------------------------------------------------------

_TRUE = "0.9 * x - 0.1 * y + 5 + CASE WHEN wrong THEN 300 + id % 97 ELSE 0 END AS u, 0.1 * x + 0.95 * y - 3 - CASE WHEN wrong THEN 200 + id % 89 ELSE 0 END AS v"


@query(f"""WITH p AS (SELECT l_suppkey AS slide, l_orderkey * 8 + l_linenumber AS id, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS y, l_partkey % 3 = 0 AS wrong FROM lineitem), q AS (SELECT slide, id, wrong, x, y, {_TRUE} FROM p),
n AS (SELECT slide FROM q GROUP BY slide HAVING sum((NOT wrong)::INT) >= 12 AND sum((NOT wrong)::INT) >= 2 * sum(wrong::INT) * 0.9)
SELECT slide, count(*) AS points, sum((NOT wrong)::INT)::BIGINT AS inliers, 0.9::DOUBLE AS m0, -0.1::DOUBLE AS m1, 5.0::DOUBLE AS m2, 0.1::DOUBLE AS m3, 0.95::DOUBLE AS m4, -3.0::DOUBLE AS m5 FROM q JOIN n USING (slide) GROUP BY 1""")
def consensus_fit(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("slide"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"), (F.col("l_partkey") % 3 == 0).alias("wrong"))
    x = x.selectExpr("slide", "id", "wrong", "x", "y", *_TRUE.replace(" AS u, ", " AS u|").split("|"))
    n = x.groupBy("slide").agg(F.count_if(~F.col("wrong")).alias("good"), F.count_if("wrong").alias("bad")).filter("good >= 12 AND good >= 2 * bad * 0.9")
    fit, points = registration.consensus(x.join(n, "slide", "left_semi"), 0.5, hypotheses=60)
    return six(points.groupBy("slide").agg(F.count("*").alias("points"), F.count_if("inlier").alias("inliers")).join(fit, "slide"), *registration.M)


# --- mutual information ----------------------------------------------------------------------------------------------------

_SPLINE = "CASE WHEN abs({u}) < 1 THEN 2 / 3.0::DOUBLE - ({u}) ** 2 + abs({u}) ** 3 / 2 WHEN abs({u}) < 2 THEN (2 - abs({u})) ** 3 / 6 ELSE 0 END"


#: Transforms whose joint histograms and information are compared, in micrometres.
_TRIED = ((0.98, -0.05, 0.75, 0.04, 1.01, -0.6), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 0.5, 0.0, 1.0, 0.25))
_JOINT = f"""{_GRID}, fx AS (SELECT region AS slide, row, col, r / 255.0::DOUBLE AS v FROM img), mv AS (SELECT region AS slide, row, col, (r + g) / 510.0::DOUBLE AS v FROM img),
fb AS (SELECT slide, min(v) - 2 * (max(v) - min(v)) / 16 AS low, (max(v) - min(v)) / 16 AS step FROM fx GROUP BY 1), mb AS (SELECT slide, min(v) - 2 * (max(v) - min(v)) / 16 AS low, (max(v) - min(v)) / 16 AS step FROM mv GROUP BY 1),
tr AS (SELECT * FROM (VALUES {", ".join(str((k, *m)) for k, m in enumerate(_TRIED))}) t(k, m0, m1, m2, m3, m4, m5)),
s AS (SELECT slide, k, least(greatest(floor((v - low) / step), 2), 17)::INT AS fbin, m0::DOUBLE * (col * 0.5) + m1::DOUBLE * (row * 0.5) + m2 AS x, m3::DOUBLE * (col * 0.5) + m4::DOUBLE * (row * 0.5) + m5 AS y FROM fx JOIN fb USING (slide), tr),
a AS (SELECT slide, k, fbin, x / 0.5 AS px, y / 0.5 AS py, floor(x / 0.5)::BIGINT AS c, floor(y / 0.5)::BIGINT AS r FROM s),
t AS (SELECT a.slide, k, fbin, sum(m.v * (1 - abs(px - m.col)) * (1 - abs(py - m.row))) AS v FROM a JOIN mv m ON m.slide = a.slide AND m.row IN (r, r + 1) AND m.col IN (c, c + 1) GROUP BY a.slide, k, fbin, px, py, c, r HAVING count(*) = 4),
h AS (SELECT slide, k, fbin, floor((v - low) / step) + d AS b, (v - low) / step AS t FROM t JOIN mb USING (slide), (VALUES (-1), (0), (1), (2)) o(d)),
j AS (SELECT slide, k, fbin, least(greatest(b, 0), 19)::INT AS mbin, sum({_SPLINE.format(u="b - t")}) AS w FROM h GROUP BY ALL)"""


def _joint(spark, sf):
    x = image(spark, sf)
    fixed, moving = (x.select(F.col("region").alias("slide"), "row", "col", v.alias("v")) for v in (F.col("r") / 255.0, (F.col("r") + F.col("g")) / 510.0))
    slides = x.select(F.col("region").alias("slide")).distinct()
    frame = slides.withColumns({"sx": F.lit(0.5), "sy": F.lit(0.5), "ox": F.lit(0.0), "oy": F.lit(0.0)})
    s = fixed.join(registration.bin_range(fixed, 20), "slide").select("slide", (F.col("col") * 0.5).alias("x"), (F.col("row") * 0.5).alias("y"), F.least(F.greatest(F.floor((F.col("v") - F.col("low")) / F.col("step")), F.lit(2)), F.lit(17)).cast("int").alias("fbin"))
    tried = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(c) for c, v in zip(registration.M, m, strict=True)]) for k, m in enumerate(_TRIED)]))
    return registration.joint_histogram(registration.warped(s, registration.quads(moving), frame, slides.select("slide", tried.alias("t")).select("slide", "t.*")), registration.bin_range(moving, 20), 20)


@query(f"WITH {_JOINT} SELECT slide, k, fbin, mbin, round(w, 6) AS w FROM j")
def joint_histogram(spark, sf):
    return six(_joint(spark, sf), "w")


@query(f"WITH {_JOINT}, p AS (SELECT slide, k, w, sum(w) OVER (PARTITION BY slide, k) AS n, sum(w) OVER (PARTITION BY slide, k, fbin) AS f, sum(w) OVER (PARTITION BY slide, k, mbin) AS m FROM j WHERE w > 0) SELECT slide, k, round(sum(w / n * ln(w * n / (f * m))), 6) AS information, round(max(n), 6) AS n FROM p GROUP BY slide, k")
def transform_information(spark, sf):
    return six(registration.information(_joint(spark, sf)), "information", "n")


# --- level lines -----------------------------------------------------------------------------------------------------------

_KEY = "(({r}) * 8589934592 + ({c}) * 2 + {d})::BIGINT"
_SIDES = [("row", "col", 0, "col + p01", "row"), ("row", "col + 1", 1, "col + 1", "row + p12"), ("row + 1", "col", 0, "col + p32", "row + 1"), ("row", "col", 1, "col", "row + p03")]
_LINKS = ", ".join(str((n, a, b)) for n in range(1, 15) for a, b in contours._links(n))


@query(f"""WITH RECURSIVE {_GRID}, v AS (SELECT region, row, col, (r + g) / 510.0::DOUBLE AS v FROM img),
sq AS (SELECT a.region, a.row, a.col, a.v AS v0, b.v AS v1, c.v AS v2, d.v AS v3 FROM v a JOIN v b ON b.region = a.region AND b.row = a.row AND b.col = a.col + 1 JOIN v c ON c.region = a.region AND c.row = a.row + 1 AND c.col = a.col + 1 JOIN v d ON d.region = a.region AND d.row = a.row + 1 AND d.col = a.col),
cs AS (SELECT *, (v0 > 0.6)::INT + 2 * (v1 > 0.6)::INT + 4 * (v2 > 0.6)::INT + 8 * (v3 > 0.6)::INT AS n, (0.6 - v0) / nullif(v1 - v0, 0) AS p01, (0.6 - v1) / nullif(v2 - v1, 0) AS p12, (0.6 - v3) / nullif(v2 - v3, 0) AS p32, (0.6 - v0) / nullif(v3 - v0, 0) AS p03 FROM sq),
sides AS (SELECT region, row, col, n, unnest([{", ".join("{k: " + _KEY.format(r=r, c=c, d=d) + f", x: ({x})::DOUBLE, y: ({y})::DOUBLE" + "}" for r, c, d, x, y in _SIDES)}]) AS s, unnest([0, 1, 2, 3]) AS i FROM cs WHERE n BETWEEN 1 AND 14),
lk AS (SELECT * FROM (VALUES {_LINKS}) t(n, a, b)),
sg AS (SELECT a.region, a.s.k AS a, b.s.k AS b, sqrt((a.s.x - b.s.x) ** 2 + (a.s.y - b.s.y) ** 2) AS len, (b.s.x * a.s.y - a.s.x * b.s.y) / 2 AS area FROM lk JOIN sides a ON a.n = lk.n AND a.i = lk.a JOIN sides b ON b.region = a.region AND b.row = a.row AND b.col = a.col AND b.i = lk.b),
ahead AS (SELECT region, a, b FROM sg UNION SELECT q.region, q.a, s.b FROM ahead q JOIN sg s ON s.region = q.region AND s.a = q.b),
heads AS (SELECT region, a AS chain, a, false AS closed FROM sg WHERE NOT EXISTS (SELECT 1 FROM sg z WHERE z.region = sg.region AND z.b = sg.a)),
loops AS (SELECT region, a, min(b) AS chain FROM ahead q WHERE EXISTS (SELECT 1 FROM ahead z WHERE z.region = q.region AND z.a = q.a AND z.b = q.a) GROUP BY ALL),
own AS (SELECT region, chain, a, false AS closed FROM heads UNION ALL SELECT q.region, h.chain, q.b, false FROM ahead q JOIN heads h ON h.region = q.region AND h.a = q.a UNION ALL SELECT region, chain, a, true FROM loops),
m AS (SELECT own.region, chain, own.closed, count(*) + 1 AS points, sum(len) AS length, sum(area) AS area FROM own JOIN sg ON sg.region = own.region AND sg.a = own.a GROUP BY ALL)
SELECT region, chain, closed, points, round(length, 6) AS length, CASE WHEN closed THEN round(area, 6) END AS area, row_number() OVER (PARTITION BY region ORDER BY points DESC, chain) = 1 AS longest FROM m""")
def level_lines(spark, sf):
    v = image(spark, sf).select("region", "row", "col", ((F.col("r") + F.col("g")) / 510.0).alias("v"))
    return six(contours.measures(contours.chains(v, BY, 0.6), BY), "length", "area")
