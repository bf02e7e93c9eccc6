"""Named queries of the mask stage, cell measurements and small operators, each with its SQL where SQL can express it.

Lineitem rows stand in for the pixels of three regions: suppkey and partkey modulo 40 are row and column, and key
sums the colours; positions without a row are white. Cells are diamonds on the same grid.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lamella.functions import expressions as X
from lamella.operators import cellular, labels, learning, masks, relational, spatial
from lamella.queries import query, six, table

BY = ["region"]
SIDE = 40

_GRID = f"""grid AS (SELECT region, row::BIGINT AS row, col::BIGINT AS col FROM (SELECT DISTINCT l_returnflag AS region FROM lineitem), range({SIDE}) a(row), range({SIDE}) b(col)),
ink AS (SELECT l_returnflag AS region, l_suppkey % {SIDE} AS row, l_partkey % {SIDE} AS col, max(l_orderkey) AS o, max(l_partkey + 3 * l_suppkey) AS p FROM lineitem GROUP BY ALL),
img AS (SELECT region, row, col, coalesce(o * 7 % 256, 255)::INT AS r, coalesce(o * 13 % 256, 255)::INT AS g, coalesce(p * 5 % 256, 255)::INT AS b,
  CASE WHEN abs(row % 8 - 3) + abs(col % 8 - 3) <= 3 THEN row // 8 * 5 + col // 8 + 1 ELSE 0 END AS label FROM grid LEFT JOIN ink USING (region, row, col))"""


def image(spark, sf):
    x = table(spark, sf, "lineitem")
    ink = x.groupBy(F.col("l_returnflag").alias("region"), (F.col("l_suppkey") % SIDE).alias("row"), (F.col("l_partkey") % SIDE).alias("col")).agg(F.max("l_orderkey").alias("o"), F.max(F.col("l_partkey") + 3 * F.col("l_suppkey")).alias("p"))
    side = F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long"))
    grid = x.select(F.col("l_returnflag").alias("region")).distinct().withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
    y = grid.join(ink, ["region", "row", "col"], "left")
    colour = lambda c, k: F.coalesce(F.col(c) * k % 256, F.lit(255)).cast("int")
    label = F.when(F.abs(F.col("row") % 8 - 3) + F.abs(F.col("col") % 8 - 3) <= 3, F.expr("row div 8 * 5 + col div 8 + 1")).otherwise(F.lit(0).cast("long"))
    return y.select("region", "row", "col", colour("o", 7).alias("r"), colour("o", 13).alias("g"), colour("p", 5).alias("b"), label.alias("label"))


def polygon(spark, sf):
    return image(spark, sf).filter("(row + 2 * col) % 11 <> 0").select(*BY, "row", "col")


_GREY = "((r * 4899 + g * 9617 + b * 1868 + 8192) // 16384)"
_HSV = """hsv AS (SELECT *, (round_even(CASE WHEN hi = lo THEN 0 WHEN (CASE WHEN hi = r THEN 60.0 * (g - b) / (hi - lo) WHEN hi = g THEN 120 + 60.0 * (b - r) / (hi - lo) ELSE 240 + 60.0 * (r - g) / (hi - lo) END) < 0
  THEN (CASE WHEN hi = r THEN 60.0 * (g - b) / (hi - lo) WHEN hi = g THEN 120 + 60.0 * (b - r) / (hi - lo) ELSE 240 + 60.0 * (r - g) / (hi - lo) END + 360) / 2
  ELSE (CASE WHEN hi = r THEN 60.0 * (g - b) / (hi - lo) WHEN hi = g THEN 120 + 60.0 * (b - r) / (hi - lo) ELSE 240 + 60.0 * (r - g) / (hi - lo) END) / 2 END, 0)::INT % 180) AS hue,
  round_even(CASE WHEN hi = 0 THEN 0 ELSE 255.0 * (hi - lo) / hi END, 0)::INT AS sat FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM img))"""


def _parts(seed: str) -> str:
    """SQL of the 4-connected components of a seed table (region, row, col): parts (region, row, col, component)."""
    return f"""s AS (SELECT DISTINCT region, row, col, row * 4294967296 + col AS id FROM {seed}), e AS (SELECT x.region, x.id AS a, y.id AS b FROM s x JOIN s y ON x.region = y.region AND abs(x.row - y.row) + abs(x.col - y.col) = 1),
reach AS (SELECT region, id AS a, id AS b FROM s UNION SELECT q.region, q.a, e.b FROM reach q JOIN e ON e.region = q.region AND e.a = q.b),
parts AS (SELECT s.region, s.row, s.col, min(b) AS component FROM s JOIN reach ON reach.region = s.region AND reach.a = s.id GROUP BY 1, 2, 3)"""


def _large(least: int) -> str:
    return f"SELECT region, row, col FROM (SELECT *, count(*) OVER (PARTITION BY region, component) AS n FROM parts) WHERE n >= {least}"


# --- components and mask rules -------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_GRID}, seed AS (SELECT * FROM img WHERE r < 90), {_parts('seed')} SELECT region, row, col, component::BIGINT AS component FROM parts")
def pixel_components(spark, sf):
    return masks.components(image(spark, sf).filter("r < 90"), BY)


@query(f"WITH RECURSIVE {_GRID}, pale AS (SELECT region, row, col, 226 + r % 16 AS r, 226 + g % 16 AS g, 226 + b % 16 AS b FROM img WHERE (row + 2 * col) % 11 <> 0), seed AS (SELECT * FROM pale WHERE {_GREY} >= 235), {_parts('seed')} {_large(6)}")
def lumen_mask(spark, sf):
    pale = image(spark, sf).withColumns({c: 226 + F.col(c) % 16 for c in "rgb"})
    return masks.lumen(pale, polygon(spark, sf), BY, 6)


@query(f"WITH {_GRID}, {_HSV} SELECT region, row, col FROM hsv WHERE (hue BETWEEN 0 AND 10 OR hue BETWEEN 160 AND 180) AND sat >= 100 AND hi >= 100")
def ink_mask(spark, sf):
    return masks.ink(image(spark, sf), BY)


@query(f"""WITH RECURSIVE {_GRID}, {_HSV}, first AS (SELECT region, row, col FROM hsv WHERE hue BETWEEN 0 AND 20 AND sat BETWEEN 60 AND 200 AND hi >= 120 AND (row + 2 * col) % 11 <> 0),
wide AS (SELECT DISTINCT g.region, g.row, g.col FROM grid g JOIN first f ON f.region = g.region AND abs(f.row - g.row) <= 1 AND abs(f.col - g.col) <= 1),
seed AS (SELECT x.region, x.row, x.col FROM wide x JOIN wide y ON y.region = x.region AND abs(x.row - y.row) <= 1 AND abs(x.col - y.col) <= 1 GROUP BY ALL HAVING count(*) = 9), {_parts('seed')} {_large(2)}""")
def vessel_mask(spark, sf):
    return masks.vessels(image(spark, sf), polygon(spark, sf), BY, 2)


_INVERSE = np.linalg.inv(np.array(X.STAINS))
_STAIN = "stain AS (SELECT *, " + ", ".join("greatest(0, " + " + ".join(f"(-ln(greatest({c}::DOUBLE / 255, 1e-6)) / {float(np.log(1e6))!r}) * {float(_INVERSE[i, j])!r}" for i, c in enumerate("rgb")) + f") AS {n}" for j, n in enumerate(("h", "e", "d"))) + " FROM img)"
_EIGHT = f"""{_STAIN}, cuts AS (SELECT region, quantile_cont(h, 0.01) AS hl, quantile_cont(h, 0.99) AS hh, quantile_cont(e, 0.01) AS el, quantile_cont(e, 0.99) AS eh FROM stain GROUP BY 1),
eight AS (SELECT stain.*, floor(least(1, greatest(0, (h - hl) / (hh - hl))) * 255)::INT AS hem, floor(least(1, greatest(0, (e - el) / (eh - el))) * 255)::INT AS eos FROM stain JOIN cuts USING (region))"""


@query(f"WITH {_GRID}, {_EIGHT} SELECT region, row, col, hem, eos FROM eight")
def stain_stretch(spark, sf):
    return masks.stain_8bit(image(spark, sf), BY).select(*BY, "row", "col", "hem", "eos")


def _mirror(c: str, o: str) -> str:
    return f"CASE WHEN {c} + {o} < 0 THEN -({c} + {o}) WHEN {c} + {o} > {SIDE - 1} THEN {2 * SIDE - 2} - ({c} + {o}) ELSE {c} + {o} END"


@query(f"""WITH RECURSIVE {_GRID}, {_EIGHT}, soft AS (SELECT region, row, col, hem // 14 + 100 AS hem FROM eight), spots AS (SELECT region, row, col, {_mirror('row', 'dr')} AS nr, {_mirror('col', 'dc')} AS nc FROM soft, range(-4, 5) a(dr), range(-4, 5) b(dc)),
box AS (SELECT x.region, x.row, x.col, avg(y.hem::DOUBLE) AS m, avg(y.hem::DOUBLE * y.hem) AS q FROM spots x JOIN soft y ON y.region = x.region AND y.row = x.nr AND y.col = x.nc GROUP BY ALL),
seed AS (SELECT region, row, col FROM box WHERE q - m * m < 25 AND (row + 2 * col) % 11 <> 0), {_parts('seed')} {_large(4)}""")
def necrosis_mask(spark, sf):
    x = masks.stain_8bit(image(spark, sf), BY).withColumn("hem", F.expr("hem div 14 + 100"))
    return masks.necrosis(x, polygon(spark, sf), BY, 4)


@query()
def epithelium_mask(spark, sf):
    x = masks.stain_8bit(image(spark, sf), BY)
    return masks.epithelium(x, masks.cleaned_mask(x, polygon(spark, sf), BY, 5.0), BY, 5.0)


@query(f"""WITH {_GRID}, {_STAIN}, top AS (SELECT region, quantile_cont(h, 0.99) AS top FROM stain WHERE ((least(r, g, b) < 230 AND greatest(r, g, b) - least(r, g, b) > 10) OR (r + g + b) / 3.0 < 180) AND (r + g + b) / 3.0 > 15 GROUP BY 1)
SELECT region, row, col, round(least(1, greatest(0, h / top)), 6) AS structure FROM stain JOIN top USING (region)""")
def stain_structure(spark, sf):
    return six(masks.structure(image(spark, sf), BY).select(*BY, "row", "col", "structure"), "structure")


@query(f"""WITH {_GRID}, v AS (SELECT region, unnest([r * 3.0, g * 3.0, b * 3.0])::DOUBLE AS v FROM img), q AS (SELECT region, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v GROUP BY 1)
SELECT region, row, col, """ + ", ".join(f"floor(least(1, greatest(0, ({c} * 3.0 - lo) / (hi - lo))) * 255)::INT AS {c}" for c in "rgb") + " FROM img JOIN q USING (region)")
def panel_normalise(spark, sf):
    deep = image(spark, sf).withColumns({c: F.col(c) * 3.0 for c in "rgb"})
    return masks.normalise_8bit(deep, BY, list("rgb")).select(*BY, "row", "col", *"rgb")


@query(f"""WITH RECURSIVE {_GRID}, mid AS (SELECT region, label, round_even(avg(row), 0)::BIGINT AS row, round_even(avg(col), 0)::BIGINT AS col FROM img WHERE label > 0 GROUP BY ALL),
kept AS (SELECT region, label FROM mid WHERE (row + 2 * col) % 11 <> 0), seed AS (SELECT region, row, col FROM img JOIN kept USING (region, label)), {_parts('seed')}
SELECT region, row, col, dense_rank() OVER (PARTITION BY region ORDER BY component)::INT AS label FROM parts""")
def touching_cells_merge(spark, sf):
    return masks.relabel(masks.labels_inside(image(spark, sf), polygon(spark, sf), BY), BY)


_FOUND = """found AS (SELECT o_orderstatus AS slide, o_orderkey AS pos, (o_custkey % 200) + 0.5 * (o_orderkey % 2) AS x, o_orderkey % 150 + 0.0 AS y FROM orders),
roi AS (SELECT DISTINCT slide, 'R' || k::VARCHAR AS region, 20 + 10 * k AS min_x, 10 AS min_y, 120 AS width, 100 AS height FROM found, range(2) t(k))"""


@query(f"""WITH {_FOUND}, c AS (SELECT *, round_even(x - min_x, 0)::BIGINT AS cc, round_even(y - min_y, 0)::BIGINT AS cr FROM found JOIN roi USING (slide)),
k AS (SELECT *, row_number() OVER (PARTITION BY slide, region ORDER BY pos) AS label FROM c WHERE cc >= 0 AND cr >= 0 AND cc < width AND cr < height AND (cr + cc) % 7 <> 0),
p AS (SELECT slide, region, label, r.i AS row, q.i AS col FROM k JOIN range(100) r(i) ON abs(r.i - (y - min_y)) <= 2 JOIN range(120) q(i) ON q.i >= floor(x - min_x) - 3 AND q.i <= floor(x - min_x) + 3)
SELECT slide, region, row, col, max(label)::INT AS label FROM p WHERE (row + col) % 7 <> 0 GROUP BY ALL""")
def cells_in_region(spark, sf):
    o = table(spark, sf, "orders")
    x, y = F.col("o_custkey") % 200 + 0.5 * (F.col("o_orderkey") % 2), (F.col("o_orderkey") % 150).cast("double")
    corner = lambda a, b: F.array(F.floor(x).cast("double") + a, y + b)
    cells = o.select(F.col("o_orderstatus").alias("slide"), F.col("o_orderkey").alias("pos"), F.array(x, y).alias("centroid"), F.array(corner(-3, -2), corner(3, -2), corner(3, 2), corner(-3, 2)).alias("contour"))
    frames = cells.select("slide").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("slide", F.concat(F.lit("R"), F.col("k").cast("string")).alias("region"), (20 + 10 * F.col("k")).alias("min_x"), F.lit(10).alias("min_y"), F.lit(120).alias("width"), F.lit(100).alias("height"))
    side = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    mask = frames.select("slide", "region").withColumn("row", side(100)).withColumn("col", side(120)).filter("(row + col) % 7 <> 0")
    return masks.cells_in_region(cells, frames, mask, ["slide", "region"])[1]


@query("SELECT p_partkey, p_size >= 10 AND p_retailprice >= 10 AND p_size % 30 >= 10 AS wanted FROM part")
def tiny_regions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", masks.large_enough(F.least("p_size", F.col("p_size") % 30), F.col("p_retailprice")).alias("wanted"))


@query("SELECT l_suppkey, sum((l_tax < 0.05)::INT)::DOUBLE / count(*) >= 0.5 AND NOT avg(l_discount * 10) > 0.90 AS wanted FROM lineitem GROUP BY 1")
def tiles_wanted(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_tax") < 0.05).cast("int")).alias("inside"), F.count("*").alias("n"), F.avg(F.col("l_discount") * 10).alias("light"))
    return t.select("l_suppkey", masks.tile_wanted(F.col("inside"), F.col("n"), F.col("light"), 0.5).alias("wanted"))


_BOX = "b AS (SELECT l_orderkey AS id, l_returnflag AS region, l_partkey AS minr, l_suppkey AS minc, l_partkey + l_linenumber AS maxr, l_suppkey + 3 AS maxc, l_linenumber * 7 AS min_x, 11 AS min_y FROM lineitem)"


def _boxes(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("region"), F.col("l_partkey").alias("minr"), F.col("l_suppkey").alias("minc"), (F.col("l_partkey") + F.col("l_linenumber")).alias("maxr"), (F.col("l_suppkey") + 3).alias("maxc"), (F.col("l_linenumber") * 7).alias("min_x"), F.lit(11).alias("min_y"))


@query(f"WITH {_BOX} SELECT id, min_y + minr AS bbox_minr_wsi, min_x + minc AS bbox_minc_wsi, min_y + maxr AS bbox_maxr_wsi, min_x + maxc AS bbox_maxc_wsi FROM b")
def boxes_in_slide(spark, sf):
    return masks.slide_boxes(_boxes(spark, sf)).select("id", *[f"bbox_{k}_wsi" for k in ("minr", "minc", "maxr", "maxc")])


@query(f"WITH {_BOX} SELECT region, median(min_x)::DOUBLE AS offset_x, 11.0::DOUBLE AS offset_y FROM b GROUP BY 1")
def region_offsets(spark, sf):
    return masks.region_offset(masks.slide_boxes(_boxes(spark, sf)), BY)


# --- cells ---------------------------------------------------------------------------------------------------------------

_RINGS = f"""box AS (SELECT region, label, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM img WHERE label > 0 GROUP BY ALL),
near AS (SELECT DISTINCT n.region, n.label, s.row, s.col, s.h, s.e FROM img n JOIN stain s ON s.region = n.region AND (s.row - n.row) ** 2 + (s.col - n.col) ** 2 <= 81 AND s.label = 0
  JOIN box ON box.region = n.region AND box.label = n.label AND s.row BETWEEN r0 AND r1 AND s.col BETWEEN c0 AND c1 WHERE n.label > 0),
ring AS (SELECT region, label, count(*)::DOUBLE AS n, avg(h) AS h, avg(e) AS e, quantile_cont(h, 0.9) AS h9 FROM near GROUP BY ALL),
core AS (SELECT region, label, count(*)::DOUBLE AS n, avg(h) AS h, avg(e) AS e, avg(d) AS d, stddev_pop(h) AS hs, skewness(e) AS ek, quantile_cont(d, 0.1) AS d1 FROM stain WHERE label > 0 GROUP BY ALL)"""


@query(f"""WITH {_GRID}, {_STAIN}, {_RINGS} SELECT region, label, round(c.h, 6) AS hematoxylin_mean, round(hs, 6) AS hematoxylin_std, round(ek, 4) AS eosin_skew, round(d1, 6) AS residual_p10, round(r.h, 6) AS cytoplasm_ring_hematoxylin_mean, round(h9, 6) AS cytoplasm_ring_hematoxylin_p90,
round(c.h / (c.e + 1e-9), 4) AS he_ratio_mean, round(c.h * c.n, 6) AS integrated_nuclear_density_h, round(c.e * c.n, 6) AS integrated_nuclear_density_e, round(c.h - r.h, 6) AS nuclear_cytoplasm_h_contrast, round(c.e - r.e, 6) AS nuclear_cytoplasm_e_contrast,
coalesce(r.n, 0) AS cytoplasm_ring_area_px, round(CASE WHEN r.n > 0 THEN c.n / (r.n + 1e-9) END, 6) AS nc_area_ratio_proxy FROM core c LEFT JOIN ring r USING (region, label)""")
def cell_intensity(spark, sf):
    x = cellular.intensity(image(spark, sf), BY)
    names = ["hematoxylin_mean", "hematoxylin_std", "residual_p10", "cytoplasm_ring_hematoxylin_mean", "cytoplasm_ring_hematoxylin_p90", "integrated_nuclear_density_h", "integrated_nuclear_density_e", "nuclear_cytoplasm_h_contrast", "nuclear_cytoplasm_e_contrast", "nc_area_ratio_proxy"]
    return six(six(x, *names).select(*BY, "label", *names, "eosin_skew", "he_ratio_mean", "cytoplasm_ring_area_px"), "eosin_skew", "he_ratio_mean", digits=4)


@query(f"""WITH {_GRID}, {_STAIN}, q AS (SELECT region, label, quantile_cont(h, 0.01) AS lo, quantile_cont(h, 0.99) AS hi FROM stain WHERE label > 0 GROUP BY ALL HAVING count(*) >= 8),
lv AS (SELECT s.region, s.label, s.row, s.col, floor(least(1, greatest(0, (h - lo) / (hi - lo))) * 31)::INT AS q FROM stain s JOIN q USING (region, label)), fill AS (SELECT region, label, floor(quantile_cont(q, 0.5))::INT AS f, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM lv GROUP BY ALL),
pix AS (SELECT f.region, f.label, g.row, g.col, coalesce(lv.q, f.f) AS q FROM fill f JOIN grid g ON g.region = f.region AND g.row BETWEEN r0 AND r1 AND g.col BETWEEN c0 AND c1 LEFT JOIN lv ON lv.region = f.region AND lv.label = f.label AND lv.row = g.row AND lv.col = g.col),
o AS (SELECT * FROM (VALUES (1, 0, 0, 1), (1, 1, -1, 1), (1, 2, -1, 0), (1, 3, -1, -1), (2, 0, 0, 2), (2, 1, -1, 1), (2, 2, -2, 0), (2, 3, -1, -1)) t(d, a, dr, dc)),
n AS (SELECT x.region, x.label, d, a, x.q AS q1, y.q AS q2, count(*) AS n FROM pix x, o JOIN pix y ON y.region = x.region AND y.label = x.label AND y.row = x.row + dr AND y.col = x.col + dc GROUP BY ALL),
s AS (SELECT region, label, d, a, q1, q2, sum(n) AS n FROM (SELECT * FROM n UNION ALL SELECT region, label, d, a, q2, q1, n FROM n) GROUP BY ALL), p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY region, label, d, a) AS p FROM s),
f AS (SELECT region, label, d, a, sum(p * (q1 - q2) ^ 2) AS contrast, sum(p / (1 + (q1 - q2) ^ 2)) AS homogeneity, sqrt(sum(p * p)) AS energy, -sum(p * log2(p + 1e-9)) AS entropy FROM p GROUP BY ALL)
SELECT region, label, round(avg(contrast), 4) AS glcm_contrast, round(avg(energy), 6) AS glcm_energy, round(avg(homogeneity), 6) AS glcm_homogeneity, round(avg(entropy), 6) AS glcm_entropy FROM f GROUP BY ALL""")
def cell_co_occurrence(spark, sf):
    from lamella.operators import raster

    keys = [*BY, "label"]
    x = cellular.quantised(cellular.crops(cellular.stained(image(spark, sf)), BY, "hematoxylin"), BY)
    m = raster.co_occurrence_features(raster.co_occurrence(x, keys), keys)
    return six(six(m.drop("glcm_correlation"), "glcm_energy", "glcm_homogeneity", "glcm_entropy"), "glcm_contrast", digits=4)


@query()
def cell_features(spark, sf):
    return cellular.cell_features(image(spark, sf), BY, 0.25)


# --- small operators -----------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT event_type AS region, user_id % 6 AS type, count(*) FILTER (WHERE value > 60) AS n FROM events GROUP BY ALL)
SELECT region, type, n, 'type ' || type::VARCHAR AS name, row_number() OVER (PARTITION BY region ORDER BY type)::INT AS place FROM n WHERE type > 0 AND n > 0""")
def legend_types(spark, sf):
    e = table(spark, sf, "events")
    n = e.groupBy(F.col("event_type").alias("region"), (F.col("user_id") % 6).alias("type")).agg(F.count_if(F.col("value") > 60).alias("n"))
    types = e.select((F.col("user_id") % 6).alias("type")).distinct().withColumn("name", F.concat(F.lit("type "), F.col("type").cast("string")))
    return relational.legend(n, types, BY)


@query("""SELECT p_size AS grp, row_number() OVER (PARTITION BY p_size ORDER BY CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 5 END DESC NULLS LAST, p_partkey)::INT AS place, p_name AS name FROM part""")
def ordered_feature_names(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_size").alias("grp"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_partkey") % 5).alias("score"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    return relational.ordered_names(x, ["grp"], "score", "pos", "name")


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS part, max(l_quantity) AS size FROM lineitem GROUP BY 1")
def largest_part(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("size"))
    return relational.largest_of(x, ["l_orderkey"], F.col("size"), "part")


@query("SELECT count(*) AS n_distinct FROM (SELECT DISTINCT l_quantity, l_discount, l_tax FROM lineitem)")
def distinct_feature_rows(spark, sf):
    return relational.distinct_rows(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("""WITH m AS (SELECT o_custkey AS g, sum((o_orderkey % 2 = 1 AND o_totalprice >= 200000)::INT) AS tp, sum((o_orderkey % 2 = 1)::INT) AS p, sum((o_orderkey % 2 = 0 AND o_totalprice < 200000)::INT) AS tn, sum((o_orderkey % 2 = 0)::INT) AS n FROM orders GROUP BY 1)
SELECT round(avg((tp::DOUBLE / p + tn::DOUBLE / n) / 2) FILTER (WHERE p > 0 AND n > 0), 9) AS macro_balanced_accuracy, count(*) FILTER (WHERE p > 0 AND n > 0) AS groups FROM m""")
def macro_over_patients(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), (F.col("o_orderkey") % 2).cast("int").alias("label"), F.col("o_totalprice").alias("score"))
    return six(learning.macro_mean(learning.metrics_by_group(x, "g", "label", "score", 200000), "balanced_accuracy"), "macro_balanced_accuracy", digits=9)


_MARKS = "SELECT l_suppkey AS region, l_quantity AS he_x, l_extendedprice / 1000 AS he_y, l_quantity * 0.9 + 5 AS p53_x, l_extendedprice / 1000 - 2 AS p53_y FROM lineitem"


@query(f"""SELECT region, count(*) AS n, round(median(err), 6) AS qc_landmark_median_um, round(max(err), 6) AS qc_landmark_max_um FROM (SELECT region, sqrt((0.9 * he_x - 0.1 * he_y + 5 - p53_x) ^ 2 + (0.1 * he_x + 0.9 * he_y - 3 - p53_y) ^ 2) AS err FROM ({_MARKS})) GROUP BY 1""")
def landmark_residuals(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_quantity").alias("he_x"), (F.col("l_extendedprice") / 1000).alias("he_y"), (F.col("l_quantity") * 0.9 + 5).alias("p53_x"), (F.col("l_extendedprice") / 1000 - 2).alias("p53_y"))
    e = spatial.landmark_errors(x, (0.9, -0.1, 5.0, 0.1, 0.9, -3.0))
    return six(e.groupBy("region").agg(F.count("*").alias("n"), F.median("registration_error_um").alias("qc_landmark_median_um"), F.max("registration_error_um").alias("qc_landmark_max_um")), "qc_landmark_median_um", "qc_landmark_max_um")


@query(f"""WITH {_GRID}, f AS (SELECT region, row, col, r / 64.0 AS dx, g / 64.0 AS dy, b < 128 AS tissue FROM img), d AS (SELECT *, {", ".join(f"coalesce((coalesce(lead({v}) OVER {w}, {v}) - coalesce(lag({v}) OVER {w}, {v})) / nullif(coalesce(lead({a}) OVER {w}, {a}) - coalesce(lag({a}) OVER {w}, {a}), 0), 0) AS {n}" for v, w, a, n in (("dx", "across", "col", "xx"), ("dy", "across", "col", "yx"), ("dx", "down", "row", "xy"), ("dy", "down", "row", "yy")))} FROM f
WINDOW across AS (PARTITION BY region, row ORDER BY col), down AS (PARTITION BY region, col ORDER BY row)) SELECT region, round(avg(((1 + xx) * (1 + yy) - xy * yx <= 0)::INT) FILTER (WHERE tissue), 9) AS nonpositive_jacobian_fraction FROM d GROUP BY 1""")
def folded_field(spark, sf):
    x = image(spark, sf).select(*BY, "row", "col", (F.col("r") / 64.0).alias("dx"), (F.col("g") / 64.0).alias("dy"), (F.col("b") < 128).alias("tissue"))
    return six(spatial.folded_share(x, BY, "tissue"), "nonpositive_jacobian_fraction", digits=9)


@query("SELECT user_id, list_extract(['" + "', '".join(X.CLUSTER_COLOURS) + "'], (user_id % 20 + 1)::INT) AS colour, format('({:.2f}, {:.2f})', value, user_id::DOUBLE) AS centre, event_id FROM events")
def cluster_colours(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", X.cluster_colour((F.col("user_id") % 20 + 1).cast("int"), 20).alias("colour"), X.centre_text(F.col("value"), F.col("user_id")).alias("centre"))


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN '-0.5' ELSE (p_size / 4.0)::DOUBLE::VARCHAR END END AS x, (p_retailprice / 1000)::DOUBLE::VARCHAR AS y FROM part),
p AS (SELECT p_partkey, CASE WHEN try_cast(x AS DOUBLE) > 0 THEN try_cast(x AS DOUBLE) END AS x, CASE WHEN try_cast(y AS DOUBLE) > 0 THEN try_cast(y AS DOUBLE) END AS y FROM m),
o AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN [0.25] WHEN 1 THEN [0.25, 0.5] WHEN 2 THEN [0.25, -1.0] ELSE [1.0, 2.0, 3.0] END END AS o FROM part),
e AS (SELECT p_partkey, o, CASE WHEN o IS NULL THEN x ELSE o[1]::DOUBLE END AS x, CASE WHEN o IS NULL THEN y WHEN len(o) = 1 THEN o[1]::DOUBLE ELSE o[2]::DOUBLE END AS y FROM p JOIN o USING (p_partkey))
SELECT p_partkey, CASE WHEN x > 0 AND y > 0 AND coalesce(len(o), 0) <= 2 THEN x END AS mpp_x, CASE WHEN x > 0 AND y > 0 AND coalesce(len(o), 0) <= 2 THEN y END AS mpp_y FROM e""")
def slide_scale(spark, sf):
    k = F.col("p_partkey")
    x = F.when(k % 7 > 0, F.when(k % 5 == 0, "none").when(k % 5 == 1, "-0.5").otherwise((F.col("p_size") / 4.0).cast("string")))
    properties = F.create_map(F.lit("openslide.mpp-x"), x, F.lit("openslide.mpp-y"), (F.col("p_retailprice") / 1000).cast("double").cast("string"))
    numbers = lambda *v: F.array(*[F.lit(float(i)) for i in v])
    given = F.when(k % 3 == 0, F.when(k % 4 == 0, numbers(0.25)).when(k % 4 == 1, numbers(0.25, 0.5)).when(k % 4 == 2, numbers(0.25, -1)).otherwise(numbers(1, 2, 3)))
    m = X.override_mpp(X.slide_mpp(properties), given)
    return table(spark, sf, "part").select("p_partkey", m["x"].alias("mpp_x"), m["y"].alias("mpp_y"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN '/roi/region_mask/mask_' || c_name || '_' || c_mktsegment || '.tif' END AS mask, CASE WHEN c_custkey % 10 > 0 THEN '/roi/rgb/rgb_' || c_name || '_' || c_mktsegment || '.tif' END AS rgb_2,
'polyepi_' || c_name || '_' || c_mktsegment || '_L2_' || c_custkey::VARCHAR || '_5_' || c_nationkey::VARCHAR || 'x7.json' AS file, NULL::DOUBLE AS solidity FROM customer""")
def region_paths(spark, sf):
    c = table(spark, sf, "customer")
    region = F.when(F.col("c_custkey") % 10 > 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("../"), F.col("c_mktsegment")))
    f = X.region_files("/roi", F.col("c_name"), region)
    name = X.mask_file(F.col("c_name"), F.col("c_mktsegment"), F.lit(2), F.col("c_custkey"), F.lit(5), F.col("c_nationkey"), F.lit(7), "json")
    return c.select("c_custkey", f["mask"].alias("mask"), f["rgb_2"].alias("rgb_2"), name.alias("file"), *X.missing_defaults(["solidity"], c.columns))


_COORDS = "c AS (SELECT DISTINCT o_orderstatus AS slide, 'R' || (o_custkey % 12)::VARCHAR AS region, o_orderkey AS cell_label, o_totalprice AS cx_wsi, o_custkey::DOUBLE AS cy_wsi FROM orders)"


def _coords(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("slide"), F.concat(F.lit("R"), (F.col("o_custkey") % 12).cast("string")).alias("region"), F.col("o_orderkey").alias("cell_label"), F.col("o_totalprice").alias("cx_wsi"), F.col("o_custkey").cast("double").alias("cy_wsi"))


@query(f"""WITH {_COORDS}, m AS (SELECT *, CASE WHEN cell_label % 3 > 0 THEN (cell_label % 10) / 10.0 END AS f, 0.9 + (cell_label % 2) / 10.0 AS mapped FROM c)
SELECT slide, region, cell_label, cx_wsi, cy_wsi, f::DOUBLE AS p53_positive_fraction, 'p-' || slide AS pair_id, slide || '1' AS patient_id,
CASE WHEN slide <> 'P' AND region NOT IN ('R0', 'R1') AND f IS NOT NULL AND mapped >= 0.95 THEN CASE WHEN f <= 0.1 THEN 0 WHEN f >= 0.6 THEN 1 ELSE -1 END ELSE -1 END AS p53_label FROM m""")
def pair_measurements(spark, sf):
    c = _coords(spark, sf)
    m = c.filter("cell_label % 3 > 0").select("slide", "region", "cell_label", (F.col("cell_label") % 10 / 10.0).alias("p53_positive_fraction"), (0.9 + F.col("cell_label") % 2 / 10.0).alias("p53_mapped_fraction"), F.lit(0.8).alias("p53_tissue_fraction"), F.lit(4.0).alias("p53_equivalent_radius_um"))
    s = c.select("slide").distinct()
    pair = s.select("slide", F.concat("slide", F.lit("1")).alias("patient_id"), F.concat(F.lit("p-"), "slide").alias("pair_id"), F.lit("r").alias("registration_id"), F.when(F.col("slide") == "P", "serial_section").otherwise("same_section").alias("section_relationship"))
    review = s.select("slide", F.lit(True).alias("registration_approved"), F.lit(0.3).alias("dab_threshold"), F.lit(0.6).alias("positive_fraction"), F.lit(0.1).alias("negative_fraction"))
    regions = c.select("slide", "region").distinct().withColumns({"approved": F.col("region") != "R0", "max_registration_error_um": F.when(F.col("region") != "R1", 1.0).otherwise(3.0)})
    return labels.pair_measurements(c, m, pair, review, regions).select("slide", "region", "cell_label", "cx_wsi", "cy_wsi", "p53_positive_fraction", "pair_id", "patient_id", "p53_label")


@query(f"""WITH {_COORDS}, r AS (SELECT slide, region, count(*) AS n, max(cy_wsi) AS e FROM c WHERE cell_label % 50 = 0 GROUP BY ALL)
SELECT c.slide, c.region, false AS approved, '' AS notes, CASE WHEN n >= 3 THEN e END AS max_registration_error_um FROM (SELECT DISTINCT slide, region FROM c) c LEFT JOIN r USING (slide, region)""")
def regions_to_review(spark, sf):
    c = _coords(spark, sf)
    return labels.review_regions(c, c.filter("cell_label % 50 = 0").withColumn("registration_error_um", F.col("cy_wsi")))


@query(f"""WITH {_GRID}, t AS (SELECT region, a.i AS row, b.i AS col, 0.5 * b.i + 0.25 * a.i + 1.5 AS x, 0.75 * a.i + 0.25 AS y FROM (SELECT DISTINCT region FROM img), range(30) a(i), range(30) b(i)),
n AS (SELECT t.region, t.row, t.col, s.r, s.b, (1 - abs(x - s.col)) * (1 - abs(y - s.row)) AS w FROM t JOIN img s ON s.region = t.region AND s.row IN (floor(y), floor(y) + 1) AND s.col IN (floor(x), floor(x) + 1) WHERE x BETWEEN 0 AND {SIDE - 1} AND y BETWEEN 0 AND {SIDE - 1})
SELECT region, row, col, round(sum(r * w) / sum(w), 6) AS r, round(sum(b * w) / sum(w), 6) AS b FROM n WHERE w > 0 GROUP BY ALL""")
def resampled_image(spark, sf):
    from lamella.operators import raster

    return six(raster.resample(image(spark, sf), BY, (0.5, 0.25, 1.5, 0.0, 0.75, 0.25), 30, 30, ["r", "b"]), "r", "b")


@query(f"WITH {_GRID}, n AS (SELECT region, label, count(*) AS n FROM img WHERE label > 0 AND (row + col) % 3 > 0 GROUP BY ALL) SELECT region, row, col, CASE WHEN n < 17 THEN 0 ELSE label END::BIGINT AS label FROM img LEFT JOIN n USING (region, label) WHERE (row + col) % 3 > 0")
def small_cells_zeroed(spark, sf):
    from lamella.operators import raster

    return raster.large_cells(image(spark, sf).filter("(row + col) % 3 > 0"), BY, 17).select(*BY, "row", "col", "label")


@query("""SELECT c_custkey AS pair_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS registration_id, c_custkey % 3 > 0 AND c_acctbal > 0 AS registration_approved, c_name AS reviewer FROM customer""")
def approvals_after_registration(spark, sf):
    c = table(spark, sf, "customer")
    reviews = c.select(F.col("c_custkey").alias("pair_id"), F.lit("old").alias("registration_id"), (F.col("c_acctbal") > 0).alias("registration_approved"), F.col("c_name").alias("reviewer"))
    again = c.filter("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("pair_id"), F.when(F.col("c_custkey") % 3 == 0, "new").otherwise("old").alias("registration_id"))
    return labels.after_registration(reviews, again)
