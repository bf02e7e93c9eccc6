"""Named queries of the measurement engine, each with its SQL where SQL can express it.

The driver's tables stand in for slides: events are cells (type as slide, user as region, value and the
property k as place), lineitem rows are pixels or measurements, customers and orders patients and slides.
Doubles that come out of sums are rounded to six digits on both sides.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella import storage
from lamella.functions import expressions as X
from lamella.functions import statistics as S
from lamella.operators import geometry, labels, learning, ranking, raster, relational, spatial
from lamella.sources import readers
from lamella.streaming import counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TYPES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("slide"), F.col("user_id").alias("region"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "ts")


def six(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in names})


CELLS = "cells AS (SELECT event_id AS id, event_type AS slide, user_id AS region, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events)"


# --- counts, pivots, filters ---------------------------------------------------------------------------------------------


@query("SELECT user_id AS region, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in TYPES) + " FROM events WHERE NOT coalesce(value < 20, false) GROUP BY 1")
def roi_type_pivot(spark, sf):
    return relational.pivot_counts(relational.small_cells_out(cells(spark, sf), "x", 20), ["region"], "slide", TYPES)


@query("SELECT event_type AS slide, count(*) AS n FROM events GROUP BY 1")
def cells_per_slide(spark, sf):
    return relational.histogram(cells(spark, sf).select("slide"), [], "slide")


@query("SELECT coalesce(CAST(event_type AS VARCHAR), 'TOTAL') AS file, k AS type, count(*) AS n FROM (SELECT event_type, user_id % 7 AS k FROM events) GROUP BY GROUPING SETS ((event_type, k), (k))")
def type_histogram_total(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("file"), (F.col("user_id") % 7).alias("type"))
    return relational.histogram_with_total(e, "file", "type")


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events) WHERE NOT coalesce(value < 20, false)")
def small_cell_filter_null_kept(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    return relational.small_cells_out(e, "value", 20)


@query("""SELECT s.mktsegment AS class, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_mktsegment AS mktsegment FROM customer) s
LEFT JOIN (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 9990 GROUP BY 1) c ON c.c_mktsegment = s.mktsegment""")
def class_counts_zero_filled(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "class")
    return relational.counts_of_classes(c.filter("c_acctbal > 9990"), c, "class")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, 'repeated key' AS fault FROM lineitem WHERE l_linenumber > 0 GROUP BY 1, 2 HAVING count(*) > 1")
def key_contract_faults(spark, sf):
    return relational.key_faults(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderkey, pos FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders) WHERE pos <= 3")
def first_rows_per_group(spark, sf):
    o = ranking.number_rows(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "pos")
    return relational.first_rows(o, ["o_custkey"], "o_orderkey", 3)


@query("SELECT c_nationkey AS nation, c_custkey AS cell, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment FROM customer")
def union_missing_columns(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return relational.union_tables([c.filter("cell % 2 = 0").drop("segment"), c.filter("cell % 2 = 1").drop("balance")])


# --- scalar expressions --------------------------------------------------------------------------------------------------


@query("SELECT event_id, round_even(value * 0.2215, 3)::DOUBLE AS x_um, round_even(value * 0.2215, 2)::DOUBLE AS x_um2 FROM events")
def unit_scaling(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", X.to_micrometres(F.col("value"), 0.2215, 3).alias("x_um"), X.to_micrometres(F.col("value"), 0.2215, 2).alias("x_um2"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 0.885, 9) AS edge_um, round(l_extendedprice * 0.885 * 0.885, 9) AS area_um2, round(l_tax / (0.885 * 0.885), 9) AS "local_density_r20um", l_discount AS "neighbor_count_r20um" FROM lineitem""")
def feature_unit_twins(spark, sf):
    px = {"edge_px": "l_quantity", "area_px2": "l_extendedprice", "local_density_r22.6px": "l_tax", "neighbor_count_r22.6px": "l_discount"}
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).alias(n) for n, c in px.items()])
    made = X.scaled_features(list(px), 0.885, {22.6: 20.0})
    return six(df.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in made.items()]), "edge_um", "area_um2", "local_density_r20um", digits=9)


@query("SELECT p_partkey, CASE WHEN p_size > 5 THEN greatest(1, round_even(p_retailprice / (p_size * 0.1 * (p_size * 0.1)), 0)::BIGINT) ELSE 200 END AS pixels FROM part")
def threshold_um2(spark, sf):
    mpp = F.when(F.col("p_size") > 5, F.col("p_size") * F.lit(Decimal("0.1")))  # a decimal's square is exact, so halves stay halves
    return table(spark, sf, "part").select("p_partkey", X.pixels_from_area(F.col("p_retailprice"), mpp).alias("pixels"))


@query("SELECT p_partkey, round((p_size + p_retailprice / 50) / 2, 6) AS mpp, abs(p_size - p_retailprice / 50) / ((p_size + p_retailprice / 50) / 2) > 0.02 AS uneven FROM part")
def isotropic_scale(spark, sf):
    mpp, uneven = X.base_mpp(F.col("p_size"), F.col("p_retailprice") / 50)
    return six(table(spark, sf, "part").select("p_partkey", mpp.alias("mpp"), uneven.alias("uneven")), "mpp")


@query("""SELECT p_partkey, CASE WHEN len(f) = 1 THEN f[1] WHEN len(f) > 1 THEN 'ambiguous' END AS diagnosis
FROM (SELECT p_partkey, list_distinct(list_filter(string_split(upper(p_name), ' '), lambda x: x IN ('RED', 'BLUE', 'WIDGET', 'RING'))) AS f FROM part)""")
def diagnosis_regex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.diagnosis(F.col("p_name"), ("RED", "BLUE", "WIDGET", "RING")).alias("diagnosis"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Region_' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::VARCHAR
ELSE replace(trim(regexp_replace(' ' || c_name || (['', chr(9) || 'Läsion', ' 日本', chr(8203) || '½ b', '·'])[c_custkey % 5 + 1] || ' (x) ', '[^\\p{L}\\p{N}_ -]', '', 'g')), ' ', '_') END AS region FROM customer""")
def region_name_cleaning(spark, sf):
    c = table(spark, sf, "customer")
    odd = F.element_at(F.array(*[F.lit(x) for x in ("", "\tLäsion", " 日本", "\u200b½ b", "·")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    raw = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" "), "c_name", odd, F.lit(" (x) ")))
    before = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return c.select("c_custkey", X.region_name(raw, before).alias("region"))


_NAME = "'polyepi_S' || o_custkey::VARCHAR || '_R' || o_orderkey::VARCHAR || '_b_L' || (o_orderkey % 4)::VARCHAR || '_' || o_custkey::VARCHAR || '_7_640x480.npy'"


@query(f"""SELECT o_orderkey, regexp_extract(n, p, 1) AS slide, regexp_extract(n, p, 2) AS region, regexp_extract(n, p, 3)::INT AS level, regexp_extract(n, p, 4)::INT AS min_x, regexp_extract(n, p, 5)::INT AS min_y, regexp_extract(n, p, 6)::INT AS width, regexp_extract(n, p, 7)::INT AS height
FROM (SELECT o_orderkey, {_NAME} AS n, '^polyepi_(.+?)_(.+?)_L([0-9]+)_([0-9]+)_([0-9]+)_([0-9]+)x([0-9]+)\\.npy$' AS p FROM orders)""")
def mask_name_parse(spark, sf):
    o = table(spark, sf, "orders")
    name = F.concat(F.lit("polyepi_S"), "o_custkey", F.lit("_R"), "o_orderkey", F.lit("_b_L"), (F.col("o_orderkey") % 4).cast("string"), F.lit("_"), F.col("o_custkey").cast("string"), F.lit("_7_640x480.npy"))
    return o.select("o_orderkey", X.mask_name_parts(name).alias("p")).select("o_orderkey", "p.*")


@query("""SELECT p_partkey, t AS type, CASE WHEN t = 3 THEN 'three' WHEN t = 0 THEN 'background' ELSE 'type_' || t::VARCHAR END AS label,
CASE WHEN t <= 0 THEN '#808080' ELSE (['#00ff00', '#0000ff', '#808080', '#ff0000', '#ffff00'])[(t - 1) % 5 + 1] END AS colour
FROM (SELECT p_partkey, coalesce(try_cast(CASE WHEN p_size % 6 = 5 THEN 'x' ELSE p_size::VARCHAR END AS INT), 0) AS t FROM part)""")
def type_label_and_colour(spark, sf):
    t = X.type_id(F.when(F.col("p_size") % 6 == 5, F.lit("x")).otherwise(F.col("p_size").cast("string")))
    p = table(spark, sf, "part").select("p_partkey", t.alias("type"))
    return p.select("p_partkey", "type", X.type_label(F.col("type"), F.create_map(F.lit("3"), F.lit("three"))).alias("label"), X.type_colour(F.col("type")).alias("colour"))


@query("""WITH x AS (SELECT *, CASE WHEN l_discount > 0.01 THEN CASE WHEN l_partkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE l_discount END END AS d, CASE l_quantity WHEN 7 THEN NULL WHEN 8 THEN 'NaN'::DOUBLE ELSE l_quantity END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN isfinite(d) THEN CASE WHEN l_quantity < 80 AND l_tax * 5 > 0.1 AND (d * 11 < 0.55 OR l_quantity / 40 > 1.2) THEN 1.0 ELSE 0.0 END END::DOUBLE AS apoptotic,
CASE WHEN isfinite(q) AND q < 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS crowded, CASE WHEN isfinite(q) AND 5 < q THEN 1.0 ELSE 0.0 END::DOUBLE AS crowded_by, ((NOT coalesce(isfinite(q), false))::INT + (NOT coalesce(isfinite(d), false))::INT)::DOUBLE / 2 AS missing FROM x""")
def cell_flags(spark, sf):
    odd = F.lit(float("nan"))
    x = table(spark, sf, "lineitem").withColumns({"d": F.when(F.col("l_discount") > 0.01, F.when(F.col("l_partkey") % 7 == 0, odd).otherwise(F.col("l_discount"))), "q": F.when(F.col("l_quantity") == 8, odd).when(F.col("l_quantity") != 7, F.col("l_quantity"))})
    flags = [X.apoptotic(F.col("l_quantity"), F.col("l_tax") * 5, F.col("d") * 11, F.col("l_quantity") / 40).alias("apoptotic"), X.crowded(F.col("q"), F.lit(20)).alias("crowded"), X.crowded(F.lit(5.0), F.col("q")).alias("crowded_by")]
    return x.select("l_orderkey", "l_linenumber", "l_partkey", *flags, X.missing_fraction(["d", "q"]).alias("missing"))


@query("SELECT p_partkey, try_cast(CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN 'NaN' ELSE substr(p_brand, 7) END AS DOUBLE) AS v FROM part WHERE p_size % 3 <> 1 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 3 = 1")
def safe_number_parse(spark, sf):
    raw = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.lit("NaN")).otherwise(F.substring("p_brand", 7, 9))
    return table(spark, sf, "part").select("p_partkey", X.safe_double(raw).alias("v"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey::VARCHAR || ',"c_name":"' || c_name || '"}') AS signature FROM customer""")
def pair_signature(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.pair_signature("c_name", "c_custkey").alias("signature"))


_RGB = "rgb AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, l_orderkey % 256 AS b FROM lineitem)"


def rgb(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") * 7 % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"))


@query(f"""WITH {_RGB}, m AS (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS lo FROM rgb),
h AS (SELECT *, CASE WHEN v = lo THEN 0.0 WHEN v = r THEN 60 * (g - b)::DOUBLE / (v - lo) WHEN v = g THEN 120 + 60 * (b - r)::DOUBLE / (v - lo) ELSE 240 + 60 * (r - g)::DOUBLE / (v - lo) END AS hd FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN hd < 0 THEN hd + 360 ELSE hd END / 2, 6) AS hue, round(CASE WHEN v = 0 THEN 0.0 ELSE 255 * (v - lo)::DOUBLE / v END, 6) AS sat,
((lo < 230 AND v - lo > 10) OR (r + g + b) / 3.0 < 180) AND (r + g + b) / 3.0 > 15 AS tissue, round(-ln((r + 1) / 256.0), 6) AS od FROM h""")
def pixel_colours(spark, sf):
    p = rgb(spark, sf)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    h, s, _ = X.hue_saturation_value(r, g, b)
    return six(p.select("l_orderkey", "l_linenumber", "l_partkey", h.alias("hue"), s.alias("sat"), X.is_tissue(r, g, b).alias("tissue"), X.optical_density(r).alias("od")), "hue", "sat", "od")


@query(f"""WITH {_RGB}, o AS (SELECT *, -ln((r + 1) / 256.0) AS x, -ln((g + 1) / 256.0) AS y, -ln((b + 1) / 256.0) AS z FROM rgb),
d AS (SELECT *, 0.6 * x + 0.7 * y + 0.3 * z AS d0, 0.1 * x + 0.9 * y + 0.2 * z AS d1 FROM o)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0.0, (0.86 * d0 - 0.75 * d1) / (0.94 * 0.86 - 0.75 * 0.75)) / 2.0, 6) AS hematoxylin FROM d""")
def stain_least_squares(spark, sf):
    ref = spark.createDataFrame([("s", [0.6, 0.7, 0.3, 0.1, 0.9, 0.2], [2.0, 1.0])], "slide string, m array<double>, max_c array<double>")
    p = raster.od_stain(rgb(spark, sf).withColumn("slide", F.lit("s")), ref)
    return six(p.select("l_orderkey", "l_linenumber", "l_partkey", "hematoxylin"), "hematoxylin")


# --- aggregates ----------------------------------------------------------------------------------------------------------

_NINE = ["mean", "median", "std", "skew", "kurtosis", "min", "max", "p10", "p90"]


@query("SELECT l_returnflag, " + ", ".join(f"round({f}, 6) AS price_{n}" for n, f in zip(_NINE, ["avg(l_extendedprice)", "quantile_cont(l_extendedprice, 0.5)", "stddev_pop(l_extendedprice)", "skewness(l_extendedprice)", "kurtosis(l_extendedprice)", "min(l_extendedprice)", "max(l_extendedprice)", "quantile_cont(l_extendedprice, 0.1)", "quantile_cont(l_extendedprice, 0.9)"], strict=True)) + " FROM lineitem GROUP BY 1")
def nine_number_stats(spark, sf):
    x = learning.nine_number_table(table(spark, sf, "lineitem"), ["l_returnflag"], "price", "l_extendedprice")
    return six(x, *[f"price_{n}" for n in _NINE])


@query("""SELECT l_suppkey, count(*) AS n, sum((l_tax < 0.07)::INT)::BIGINT AS n_mapped, round(avg(l_discount) FILTER (WHERE l_tax < 0.07), 6) AS mean, round(stddev_pop(l_discount) FILTER (WHERE l_tax < 0.07), 6) AS std,
round(sum((l_tax < 0.07 AND l_discount >= 0.05)::INT)::DOUBLE / nullif(sum((l_tax < 0.07)::INT), 0), 6) AS positive_fraction, round(avg((l_tax < 0.07)::INT), 6) AS mapped_fraction, round(sum((l_tax < 0.07 AND l_quantity > 10)::INT) / greatest(sum((l_tax < 0.07)::INT), 1)::DOUBLE, 6) AS tissue_fraction FROM lineitem GROUP BY 1""")
def pixel_accumulate(spark, sf):
    p = table(spark, sf, "lineitem").select("l_suppkey", "l_discount", (F.col("l_tax") < 0.07).alias("m"), (F.col("l_quantity") > 10).alias("t"))
    return six(relational.pixel_sums(p, ["l_suppkey"], "l_discount", "m", "t", 0.05), "mean", "std", "positive_fraction", "mapped_fraction", "tissue_fraction")


@query("SELECT o_orderstatus AS slide, count(*) AS cells, sum((o_totalprice >= 250000)::INT)::BIGINT AS positives, round(avg((o_totalprice >= 250000)::INT), 6) AS positive_fraction, round(avg(o_totalprice / 500000), 6) AS mean_probability FROM orders GROUP BY 1")
def slide_prediction_summary(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("slide"), (F.col("o_totalprice") >= 250000).cast("int").alias("predicted"), (F.col("o_totalprice") / 500000).alias("probability"))
    return six(relational.summary_of_predictions(p, "slide"), "positive_fraction", "mean_probability")


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1 HAVING count(*) >= 3")
def region_error_max(spark, sf):
    return relational.group_max(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 3)


@query("WITH d AS (SELECT l_suppkey, l_extendedprice - l_quantity AS o FROM lineitem), m AS (SELECT l_suppkey, quantile_cont(o, 0.5) AS med FROM d GROUP BY 1) SELECT l_suppkey, round(med, 6) AS median_offset, round(max(abs(o - med)), 6) AS max_departure FROM d JOIN m USING (l_suppkey) GROUP BY 1, 2")
def offset_median_departure(spark, sf):
    return six(relational.median_offset(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity"), "median_offset", "max_departure")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS files FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def region_in_many_files(spark, sf):
    return relational.region_sources(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


@query("SELECT event_type, round(1 - sqrt(avg(cos(2 * value)) ^ 2 + avg(sin(2 * value)) ^ 2), 6) AS v FROM events GROUP BY 1")
def circular_variance(spark, sf):
    return six(table(spark, sf, "events").groupBy("event_type").agg(S.circular_variance(F.col("value")).alias("v")), "v")


@query("SELECT c_nationkey, string_agg(c_name, '; ' ORDER BY c_custkey) AS names FROM customer GROUP BY 1")
def joined_lists(spark, sf):
    return relational.joined_lists(table(spark, sf, "customer"), ["c_nationkey"], "c_name", "c_custkey", "names")


@query("SELECT p_partkey, (i - 1)::INT AS pos, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def split_lists(spark, sf):
    return relational.split_lists(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "word", " ")


# --- joins ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {CELLS}, b AS (SELECT region, round_even(x, 0) AS rx, round_even(y, 0) AS ry, arg_max(id, id) AS partner FROM cells WHERE slide = 'view' GROUP BY ALL)
SELECT c.id, b.partner FROM cells c LEFT JOIN b ON c.region = b.region AND round_even(c.x, 0) = b.rx AND round_even(c.y, 0) = b.ry WHERE c.slide = 'click'""")
def centroid_lastwins_join(spark, sf):
    c = cells(spark, sf).withColumns({"rx": F.rint("x"), "ry": F.rint("y")})
    left, build = c.filter("slide = 'click'"), c.filter("slide = 'view'").withColumn("partner", F.col("id"))
    return relational.left_last_wins(left.drop("ts"), build, ["region", "rx", "ry"], "id", ["partner"]).select("id", "partner")


@query("""WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS pos FROM orders),
c AS (SELECT o_custkey, s, count(*) AS k FROM n GROUP BY 1, 2)
SELECT a.o_custkey, a.pos, a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND a.pos = b.pos AND a.s = 'O' AND b.s = 'F'
JOIN c x ON x.o_custkey = a.o_custkey AND x.s = 'O' JOIN c y ON y.o_custkey = a.o_custkey AND y.s = 'F' AND x.k = y.k""")
def positional_zip(spark, sf):
    n = ranking.number_rows(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"], "pos")
    side = lambda s, name: n.filter(F.col("o_orderstatus") == s).select("o_custkey", "pos", F.col("o_orderkey").alias(name))
    return relational.zip_by_position(side("O", "left_key"), side("F", "right_key"), ["o_custkey"]).select("o_custkey", "pos", "left_key", "right_key")


@query(f"""WITH {CELLS}, d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS dist FROM cells a JOIN cells b ON a.region = b.region AND a.slide = 'click' AND b.slide = 'view'),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM d WHERE dist <= 5), lost AS (SELECT DISTINCT region FROM cells WHERE slide = 'click' AND id % 97 = 0)
SELECT c.id, n.other, round(n.dist, 6) AS dist FROM cells c LEFT JOIN n ON n.id = c.id AND n.k = 1 AND c.region NOT IN (SELECT region FROM lost) WHERE c.slide = 'click'""")
def nearest_capped_join(spark, sf):
    c = cells(spark, sf)
    lost = F.when(F.col("id") % 2 == 0, float("inf")).otherwise(float("nan"))  # places that are unknown
    c = c.withColumn("x", F.when((F.col("id") % 97 == 0) & (F.col("slide") == "click"), lost).otherwise(F.col("x")))
    return six(spatial.capped_nearest(c.filter("slide = 'click'"), c.filter("slide = 'view'"), ["region"], 5.0).select("id", "other", "dist"), "dist")


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS matched, count(*) FILTER (WHERE l.doc_id IS NULL) AS absent FROM documents d LEFT JOIN labels l USING (doc_id)")
def labels_join_completeness(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    hit, miss = relational.split_by_match(d, lab, ["doc_id"])
    return hit.agg(F.count("*").alias("matched")).crossJoin(miss.agg(F.count("*").alias("absent")))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def train_eval_overlap(spark, sf):
    o = table(spark, sf, "orders")
    return relational.overlap(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unmatched_labels(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey, coalesce(n_name, 'nation_' || c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON n_nationkey = c_nationkey")
def lookup_with_default(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    n = table(spark, sf, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"))
    return relational.lookup(c, n, "key", "nation", F.concat(F.lit("nation_"), F.col("key").cast("string"))).select("c_custkey", "nation")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def keys_in_all_tables(spark, sf):
    o = table(spark, sf, "orders")
    return relational.all_in_common([o.filter(F.col("o_orderstatus") == s) for s in "OFP"], ["o_custkey"])


# --- windows -------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT d.doc_id, d.source, l.toxic FROM documents d JOIN labels l USING (doc_id)), w AS (SELECT *, 1.0::DOUBLE / (count(*) OVER (PARTITION BY source, toxic) * p) AS w
FROM t JOIN (SELECT toxic, count(DISTINCT source) AS p FROM t GROUP BY 1) USING (toxic)) SELECT doc_id, round(w / avg(w) OVER (), 9) AS weight FROM w""")
def balance_weights(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return six(ranking.balance_weights(t, "source", "toxic").select("doc_id", "weight"), "weight", digits=9)


@query("""WITH r AS (SELECT event_type AS class, user_id AS region, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY class ORDER BY n DESC, region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r)
SELECT class, region, n FROM c WHERE b < 300""")
def roi_cumulative_sample(spark, sf):
    r = cells(spark, sf).groupBy(F.col("slide").alias("class"), "region").agg(F.count("*").alias("n"))
    return ranking.take_until(r, ["class"], [F.desc("n"), "region"], "n", F.lit(300))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS a FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM c WHERE b < 0.9 * a""")
def keep_largest_fraction(spark, sf):
    return ranking.largest_until_fraction(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("SELECT p_brand, arg_min(p_partkey, (abs(p_size * 0.5 - 10.2), p_partkey)) AS level FROM part GROUP BY 1")
def nearest_level(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("level"), F.lit(0.5).alias("mpp"), F.col("p_size").alias("downsample"))
    return ranking.nearest_level(p, ["p_brand"], 10.2)


@query("SELECT vec_id, list_position(embedding, list_max(embedding))::INT AS cluster_id, list_max(embedding)::DOUBLE AS cluster_confidence FROM embeddings")
def argmax_confidence(spark, sf):
    x = ranking.argmax_with_confidence(table(spark, sf, "embeddings"), "embedding")
    return x.select("vec_id", "cluster_id", F.col("cluster_confidence").cast("double").alias("cluster_confidence"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2.0::DOUBLE AS r FROM orders")
def average_ranks(spark, sf):
    return ranking.average_ranks(table(spark, sf, "orders"), "o_custkey", "r", ["o_orderstatus"]).select("o_orderkey", "r")


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS f FROM embeddings), m AS (SELECT label, f, avg(v) AS mean FROM e GROUP BY 1, 2),
s AS (SELECT *, min(mean) OVER (PARTITION BY f) AS lo, max(mean) OVER (PARTITION BY f) AS hi FROM m)
SELECT label, 'f' || f::VARCHAR AS feature, round(mean, 6) AS mean, round(CASE WHEN abs(hi - lo) <= 1e-12 THEN 0 ELSE 2 * (mean - lo) / (hi - lo) - 1 END, 6) AS scaled FROM s""")
def cluster_profile_minmax(spark, sf):
    e, cols = embedding_columns(spark, sf)
    return six(learning.cluster_profiles(e, cols, "label"), "mean", "scaled")


def embedding_columns(spark, sf):
    e = table(spark, sf, "embeddings")
    n = len(e.select("embedding").filter("embedding IS NOT NULL").first()[0])
    cols = [f"f{i + 1}" for i in range(n)]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@query()
def group_folds(spark, sf):
    return ranking.group_folds(table(spark, sf, "orders"), "o_custkey", 5)


@query()
def sample_whole_regions(spark, sf):
    return ranking.sample_regions(cells(spark, sf).drop("ts"), ["region"], "slide", TYPES, 100, 42)


# --- neighbourhoods ------------------------------------------------------------------------------------------------------

_KNN = f"""{CELLS}, k AS (SELECT * FROM (SELECT a.slide, a.region, a.id, b.id AS other, a.x AS ax, a.y AS ay, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS dist,
row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), b.id) AS rank FROM cells a JOIN cells b ON a.slide = b.slide AND a.region = b.region AND a.id <> b.id) WHERE rank <= 6)"""


@query(f"WITH {_KNN} SELECT c.id, round(avg(dist), 6) AS nn_distance_mean_px, round(stddev_pop(dist), 6) AS nn_distance_std_px, round(min(dist), 6) AS nn_distance_min_px FROM cells c LEFT JOIN k ON k.id = c.id GROUP BY 1")
def knn_stats(spark, sf):
    c, by = cells(spark, sf), ["slide", "region"]
    d = spatial.neighbour_distances(spatial.k_nearest(c, by, 6), c, by)
    names = ["nn_distance_mean_px", "nn_distance_std_px", "nn_distance_min_px"]
    return six(d.select("id", *names), *names)


@query(f"""WITH {CELLS}, b AS (SELECT slide, region, count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS box FROM cells GROUP BY 1, 2),
r AS (SELECT a.id, a.slide, a.region, (SELECT count(*) FROM cells b WHERE b.slide = a.slide AND b.region = a.region AND b.id <> a.id AND sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) <= 30) AS c FROM cells a)
SELECT id, c::DOUBLE AS neighbor_count, round(c / (pi() * 900 + 1e-9), 6) AS local_density, round(c - n * pi() * 900 / (box + 1e-9), 4) AS ripleys_proxy FROM r JOIN b USING (slide, region) WHERE n > 1""")
def radius_density(spark, sf):
    c, by = cells(spark, sf), ["slide", "region"]
    many = c.groupBy(*by).count().filter("count > 1").select(*by)
    x = spatial.radius_features(c, by, 30.0).join(many, by, "left_semi")
    return six(x.select("id", "neighbor_count", "local_density", F.round("ripleys_proxy", 4).alias("ripleys_proxy")), "local_density")


@query(f"""WITH {CELLS}, k AS (SELECT * FROM (SELECT a.region, a.id, a.slide AS s, b.slide AS o, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), b.id) AS rank
FROM cells a JOIN cells b ON a.region = b.region AND a.id <> b.id) WHERE rank <= 6)
SELECT id, round(avg((s <> o AND s <> 'view' AND o <> 'view')::INT), 6) AS heterotypic_fraction, round(avg((o LIKE '%err%' OR o LIKE '%sign%')::INT), 6) AS inflammatory_fraction FROM k GROUP BY 1""")
def heterotypic_fraction(spark, sf):
    # views have no type; types differ in their letters' case
    kind = F.when(F.col("slide") != "view", F.when(F.col("id") % 2 == 0, F.upper("slide")).otherwise(F.col("slide")))
    c = cells(spark, sf).withColumn("slide", kind)
    x = spatial.neighbour_fraction(spatial.k_nearest(c, ["region"], 6), c, ["region"], "slide", ("err", "sign"))
    return six(x.select("id", "heterotypic_fraction", "inflammatory_fraction"), "heterotypic_fraction", "inflammatory_fraction")


@query(f"""WITH {_KNN}, e AS (SELECT DISTINCT slide, region, least(id, other) AS a, greatest(id, other) AS b, dist FROM k WHERE rank <= 3), u AS (SELECT a AS id, b AS o, dist FROM e UNION ALL SELECT b, a, dist FROM e),
g AS (SELECT id, count(*)::DOUBLE AS degree, avg(dist) AS m, var_pop(dist) AS v FROM u GROUP BY 1),
t AS (SELECT x.id, count(*) AS links FROM u x JOIN u y ON x.id = y.id AND x.o < y.o JOIN e ON e.a = x.o AND e.b = y.o GROUP BY 1)
SELECT g.id, degree, round(m, 6) AS edge_mean, round(v, 6) AS edge_var, round(CASE WHEN degree > 1 THEN coalesce(links, 0) / (degree * (degree - 1) / 2) END, 6) AS clustering_coefficient FROM g LEFT JOIN t USING (id)""")
def edge_dedup_clustering_coef(spark, sf):
    c, by = cells(spark, sf), ["slide", "region"]
    near = spatial.k_nearest(c, by, 3).select(*by, F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "dist").distinct()
    return six(spatial.edge_features(near, by).select("id", "degree", "edge_mean", "edge_var", "clustering_coefficient"), "edge_mean", "edge_var", "clustering_coefficient")


_AXIS = f"""{CELLS}, m AS (SELECT slide, region, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM cells GROUP BY 1, 2),
p AS (SELECT c.*, (x - mx) * cos(t) + (y - my) * sin(t) AS along, -(x - mx) * sin(t) + (y - my) * cos(t) AS across FROM cells c JOIN m USING (slide, region))"""


@query(f"WITH {_AXIS} SELECT id, round(along, 4) AS along, round(across, 4) AS across, round((across - min(across) OVER w) / (max(across) OVER w - min(across) OVER w + 1e-9), 4) AS position FROM p WINDOW w AS (PARTITION BY slide, region)")
def principal_axis(spark, sf):
    p = spatial.principal_axis(cells(spark, sf).drop("ts"), ["slide", "region"])
    return p.select("id", *[F.round(c, 4).alias(c) for c in ("along", "across", "position")])


@query(f"""WITH {_KNN}, {_AXIS[len(CELLS) + 2:]}, o AS (SELECT id, other FROM k UNION ALL SELECT id, id FROM cells),
l AS (SELECT o.id, count(*) AS c, stddev_pop(q.across) AS s, max(q.across) - min(q.across) AS t, min(q.across) AS lo, 1 - sqrt(avg(cos(2 * q.x)) ^ 2 + avg(sin(2 * q.x)) ^ 2) AS disorder FROM o JOIN p q ON q.id = o.other GROUP BY 1)
SELECT p.id, round(CASE WHEN c > 1 THEN s END, 4) AS pseudostratification_index, round(CASE WHEN c > 1 THEN t END, 4) AS epithelial_layer_thickness_px, round(across - lo, 4) AS distance_from_basal_line_px, round(disorder, 4) AS orientation_disorder FROM p JOIN l USING (id)""")
def tissue_architecture(spark, sf):
    c, by = cells(spark, sf).drop("ts").withColumn("angle", F.col("x")), ["slide", "region"]
    x = spatial.architecture(c, spatial.k_nearest(c, by, 6), by)
    return x.select("id", *[F.round(n, 4).alias(n) for n in ("pseudostratification_index", "epithelial_layer_thickness_px", "distance_from_basal_line_px", "orientation_disorder")])


@query("SELECT event_id AS id, round((0.9 * (value * 0.22) - 0.1 * (CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.22) + 5) / 0.25, 6) AS x, round((0.1 * (value * 0.22) + 0.9 * (CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.22) - 3) / 0.25, 6) AS y FROM events")
def affine_mapping(spark, sf):
    return six(spatial.affine_points(cells(spark, sf).select("id", "x", "y"), (0.9, -0.1, 5.0, 0.1, 0.9, -3.0), 0.22, 0.25), "x", "y")


@query()
def delaunay_graph_features(spark, sf):
    by = ["slide", "region"]
    return spatial.edge_features(geometry.region_graph(cells(spark, sf).drop("ts"), by), by)


@query()
def voronoi_cells(spark, sf):
    return geometry.region_voronoi(cells(spark, sf).drop("ts"), ["slide", "region"])


# --- pixels --------------------------------------------------------------------------------------------------------------

_PIX = "pix AS (SELECT l_returnflag AS region, l_suppkey % 40 AS row, l_partkey % 40 AS col, max(l_quantity)::DOUBLE AS v, max(l_linenumber) AS label, (max(l_orderkey) % 8)::INT AS q FROM lineitem GROUP BY 1, 2, 3)"


def pixels(spark, sf):
    x = table(spark, sf, "lineitem")
    return x.groupBy(F.col("l_returnflag").alias("region"), (F.col("l_suppkey") % 40).alias("row"), (F.col("l_partkey") % 40).alias("col")).agg(F.max("l_quantity").alias("v"), F.max("l_linenumber").alias("label"), (F.max("l_orderkey") % 8).cast("int").alias("q"))


@query("SELECT l_returnflag AS region, l_suppkey % 40 AS row, l_partkey % 40 AS col, max(l_linenumber) AS label FROM lineitem GROUP BY 1, 2, 3")
def painter_order(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("region"), (F.col("l_suppkey") % 40).alias("row"), (F.col("l_partkey") % 40).alias("col"), F.col("l_linenumber").alias("label"))
    return raster.paint(x, ["region"])


_SHAPES = ["orientation", "cy", "cx", "major_axis_length_px", "minor_axis_length_px", "equivalent_diameter_px", "eccentricity", "aspect_ratio", "roundness"]


@query(f"""WITH {_PIX}, g AS (SELECT region, label, count(*) AS area_px, avg(row) AS cy, avg(col) AS cx, min(row) AS minr, min(col) AS minc, max(row) + 1 AS maxr, max(col) + 1 AS maxc, var_pop(col) AS a, var_pop(row) AS b, covar_pop(row, col) AS c FROM pix GROUP BY 1, 2),
e AS (SELECT *, 4 * sqrt((a + b) / 2 + sqrt(((a - b) / 2) ^ 2 + c * c)) AS ma, 4 * sqrt(greatest(0, (a + b) / 2 - sqrt(((a - b) / 2) ^ 2 + c * c))) AS mi FROM g)
SELECT region, label, area_px, round(cy, 6) AS cy, round(cx, 6) AS cx, minr, minc, maxr, maxc, round(ma, 6) AS major_axis_length_px, round(mi, 6) AS minor_axis_length_px, round(sqrt(4 * area_px / pi()), 6) AS equivalent_diameter_px, CASE WHEN ma > 0 THEN round(sqrt(greatest(0, 1 - (mi / ma) ^ 2)), 6) ELSE 0 END AS eccentricity, CASE WHEN mi > 0 THEN round(ma / (mi + 1e-9), 6) END AS aspect_ratio, CASE WHEN ma > 0 THEN round(4 * area_px / (pi() * ma * ma + 1e-9), 6) END AS roundness,
round(CASE WHEN a = b THEN CASE WHEN c > 0 THEN pi() / 4 ELSE -pi() / 4 END ELSE atan2(2 * c, b - a) / 2 END, 6) AS orientation FROM e""")
def region_properties(spark, sf):
    return six(raster.region_properties(pixels(spark, sf), ["region", "label"]), *_SHAPES)


@query("""WITH h AS (SELECT l_returnflag AS region, v, count(*) AS n FROM (SELECT l_returnflag, (l_partkey * l_suppkey) % 256 AS v FROM lineitem) WHERE v > 0 GROUP BY 1, 2), f AS (SELECT r.region, i.i AS v, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT region FROM h) r, range(256) i(i) LEFT JOIN h ON h.region = r.region AND h.v = i.i),
c AS (SELECT *, sum(n) OVER w AS wb, sum(v * n) OVER w AS sb, sum(n) OVER (PARTITION BY region) AS t, sum(v * n) OVER (PARTITION BY region) AS s FROM f WINDOW w AS (PARTITION BY region ORDER BY v)),
b AS (SELECT region, v, wb::DOUBLE * (t - wb) * (sb::DOUBLE / wb - (s - sb)::DOUBLE / (t - wb)) ^ 2 AS between_ FROM c WHERE wb > 0 AND wb < t)
SELECT region, arg_max(v, (between_, v))::INT AS threshold FROM b GROUP BY 1""")
def otsu_histogram(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("region"), (F.col("l_partkey") * F.col("l_suppkey") % 256).alias("v"))
    return raster.histogram_threshold(p, ["region"], "v")


@query(f"""WITH {_PIX}, o AS (SELECT * FROM (VALUES (1, 0, 0, 1), (1, 1, -1, 1), (1, 2, -1, 0), (1, 3, -1, -1), (2, 0, 0, 2), (2, 1, -1, 1), (2, 2, -2, 0), (2, 3, -1, -1)) t(d, a, dr, dc)),
n AS (SELECT x.region, d, a, x.q AS q1, y.q AS q2, count(*) AS n FROM pix x, o JOIN pix y ON y.region = x.region AND y.row = x.row + dr AND y.col = x.col + dc GROUP BY ALL),
s AS (SELECT region, d, a, q1, q2, sum(n) AS n FROM (SELECT * FROM n UNION ALL SELECT region, d, a, q2, q1, n FROM n) GROUP BY ALL), p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY region, d, a) AS p FROM s),
f AS (SELECT region, d, a, sum(p * (q1 - q2) ^ 2) AS contrast, sum(p / (1 + (q1 - q2) ^ 2)) AS homogeneity, sqrt(sum(p * p)) AS energy, -sum(p * log2(p + 1e-9)) AS entropy, (sum(p * q1 * q2) - sum(p * q1) ^ 2) / (sum(p * q1 * q1) - sum(p * q1) ^ 2) AS correlation FROM p GROUP BY ALL)
SELECT region, round(avg(contrast), 6) AS glcm_contrast, round(avg(correlation), 6) AS glcm_correlation, round(avg(energy), 6) AS glcm_energy, round(avg(homogeneity), 6) AS glcm_homogeneity, round(avg(entropy), 6) AS glcm_entropy FROM f GROUP BY 1""")
def glcm(spark, sf):
    x = raster.co_occurrence_features(raster.co_occurrence(pixels(spark, sf), ["region"]), ["region"])
    return six(x, *[c for c in x.columns if c != "region"])


@query(f"""WITH {_PIX}, b AS (SELECT region, row // 2 AS r, col // 2 AS c, max(v) FILTER (WHERE row % 2 = 0 AND col % 2 = 0) AS a, max(v) FILTER (WHERE row % 2 = 0 AND col % 2 = 1) AS b, max(v) FILTER (WHERE row % 2 = 1 AND col % 2 = 0) AS cc, max(v) FILTER (WHERE row % 2 = 1 AND col % 2 = 1) AS d FROM pix GROUP BY ALL)
SELECT region, round(avg(((a + b + cc + d) / 4) ^ 2), 9) AS haar_ll_energy, round(avg(((a - b + cc - d) / 4) ^ 2), 9) AS haar_lh_energy, round(avg(((a + b - cc - d) / 4) ^ 2), 9) AS haar_hl_energy, round(avg(((a - b - cc + d) / 4) ^ 2), 9) AS haar_hh_energy FROM b WHERE a + b + cc + d IS NOT NULL GROUP BY 1""")
def haar_energy(spark, sf):
    x = raster.haar_energy(pixels(spark, sf), ["region"], "v")
    return six(x, *[c for c in x.columns if c != "region"], digits=9)


@query(f"""WITH {_PIX}, n AS (SELECT region, s, count(DISTINCT (row // s) * 1000 + col // s) AS n FROM (SELECT * FROM pix WHERE label >= 6), (VALUES (2), (4), (8), (16)) t(s) GROUP BY 1, 2) SELECT region, round(regr_slope(ln(n), ln(1.0::DOUBLE / s)), 6) AS fractal_dimension_boundary FROM n GROUP BY 1""")
def box_count(spark, sf):
    return six(raster.box_dimension(pixels(spark, sf).filter("label >= 6"), ["region"], (2, 4, 8, 16)), "fractal_dimension_boundary")


@query(f"""WITH {_PIX}, w AS (SELECT x.region, x.row, x.col, greatest(0, coalesce(sum(y.v * y.v), 0) / 25 - (coalesce(sum(y.v), 0) / 25) ^ 2) AS var FROM pix x JOIN pix y ON y.region = x.region AND abs(y.row - x.row) <= 2 AND abs(y.col - x.col) <= 2 GROUP BY ALL) SELECT region, round(avg(var), 6) AS chromatin_clumping_index FROM w GROUP BY 1""")
def local_variance(spark, sf):
    return six(raster.local_variance(pixels(spark, sf), ["region"], "v"), "chromatin_clumping_index")


def _sample(k: int) -> str:
    """SQL of a sample on the circle of radius 1: a pixel, or bilinear between the four pixels around it."""
    dr, dc = round(-math.sin(k * math.pi / 4), 5), round(math.cos(k * math.pi / 4), 5)
    at = lambda r, c: f"n{(r + 1) * 3 + c + 1}"
    if k % 2 == 0:
        return at(round(dr), round(dc))
    r, c = math.floor(dr), math.floor(dc)
    fr, fc = (f"({x}::DOUBLE + ({d}::DOUBLE) - floor({x}::DOUBLE + ({d}::DOUBLE)))" for x, d in (("row", dr), ("col", dc)))
    top, low = (f"((1 - {fc}) * {at(i, c)} + {fc} * {at(i, c + 1)})" for i in (r, r + 1))
    return f"((1 - {fr}) * {top} + {fr} * {low})"


@query(f"""WITH {_PIX}, n AS (SELECT x.region, x.row, x.col, x.v, """ + ", ".join(f"coalesce(max(y.v) FILTER (WHERE y.row = x.row + {i // 3 - 1} AND y.col = x.col + {i % 3 - 1}), 0)::DOUBLE AS n{i}" for i in range(9)) + """ FROM pix x JOIN pix y ON y.region = x.region AND abs(y.row - x.row) <= 1 AND abs(y.col - x.col) <= 1 GROUP BY x.region, x.row, x.col, x.v),
b AS (SELECT region, """ + ", ".join(f"({_sample(k)} - v >= 0)::INT AS b{k}" for k in range(8)) + """ FROM n),
c AS (SELECT region, CASE WHEN """ + " + ".join(f"abs(b{i} - b{(i + 1) % 8})" for i in range(8)) + " <= 2 THEN " + " + ".join(f"b{i}" for i in range(8)) + " ELSE 9 END AS bin FROM b) SELECT region, " + ", ".join(f"round(avg((bin = {i})::INT), 6) AS lbp_bin_{i}" for i in range(10)) + " FROM c GROUP BY 1")
def local_binary_patterns(spark, sf):
    x = raster.local_patterns(pixels(spark, sf), ["region"], "v")
    return six(x, *[f"lbp_bin_{i}" for i in range(10)])


@query("""WITH p AS (SELECT l_returnflag AS region, l_linestatus AS tile, l_suppkey % 20 AS row, l_partkey % 20 AS col, max(l_linenumber) AS label FROM lineitem GROUP BY ALL), t AS (SELECT region, tile, max(label) AS top FROM p GROUP BY ALL),
o AS (SELECT region, tile, coalesce(sum(top) OVER (PARTITION BY region ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t) SELECT region, row, col, arg_max(label + off, tile)::BIGINT AS label FROM p JOIN o USING (region, tile) GROUP BY ALL""")
def tile_stitch(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("tile"), (F.col("l_suppkey") % 20).alias("row"), (F.col("l_partkey") % 20).alias("col")).agg(F.max("l_linenumber").alias("label"))
    return raster.stitch(x, ["region"], "tile")


@query(f"WITH {_PIX} SELECT DISTINCT region, label FROM pix WHERE (row < 1 OR col < 1 OR row >= 39 OR col >= 39) AND label > 0")
def border_labels(spark, sf):
    return raster.touching_border(pixels(spark, sf).withColumns({"w": F.lit(40), "h": F.lit(40)}), ["region"], "w", "h")


@query(f"""WITH {_PIX}, s AS (SELECT * FROM pix WHERE label = 7), b AS (SELECT region, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM s GROUP BY 1), o AS (SELECT a.i AS dr, c.i AS dc FROM range(-2, 3) a(i), range(-2, 3) c(i) WHERE a.i * a.i + c.i * c.i <= 4)
SELECT DISTINCT s.region, s.label, s.row + dr AS row, s.col + dc AS col FROM s JOIN b USING (region), o WHERE s.row + dr BETWEEN r0 AND r1 AND s.col + dc BETWEEN c0 AND c1 AND NOT EXISTS (SELECT 1 FROM s z WHERE z.region = s.region AND z.row = s.row + dr AND z.col = s.col + dc)""")
def cytoplasm_ring(spark, sf):
    return raster.ring_pixels(pixels(spark, sf).filter("label = 7").select("region", "row", "col", "label"), ["region"], 2)


@query(f"WITH {_PIX}, c AS (SELECT (label >= 4) AS a, (q >= 4) AS b FROM pix) SELECT round(2.0 * sum((a AND b)::INT) / (sum(a::INT) + sum(b::INT)), 6) AS dice FROM c")
def mask_dice(spark, sf):
    p = pixels(spark, sf)
    return six(relational.mask_agreement(p.filter("label >= 4"), p.filter("q >= 4"), ["region", "row", "col"]), "dice")


@query("""WITH b AS (SELECT o_orderkey, o_orderkey % 2000 + 1 AS w, o_custkey % 1500 + 1 AS h FROM orders), t AS (SELECT o_orderkey, w, h, unnest(range(0, w, 768)) AS x0 FROM b), u AS (SELECT *, unnest(range(0, h, 768)) AS y0 FROM t),
v AS (SELECT *, least(x0 + 1024, w) AS x1, least(y0 + 1024, h) AS y1 FROM u) SELECT o_orderkey, x0, y0, x1, y1, greatest(0, x0 - 96) AS cx0, greatest(0, y0 - 96) AS cy0, least(x1 + 96, w) AS cx1, least(y1 + 96, h) AS cy1 FROM v""")
def tile_grid(spark, sf):
    b = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 2000 + 1).alias("w"), (F.col("o_custkey") % 1500 + 1).alias("h"))
    x = relational.tiles(b, ["o_orderkey"], "w", "h")
    return x.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in x.columns if c != "o_orderkey"])


@query()
def contour_shapes(spark, sf):
    c = cells(spark, sf).withColumn("at", F.atan2(F.col("y") - 50, F.col("x") - 50))
    outline = F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "x", "y"))), lambda s: F.array(s["x"], s["y"]))
    return geometry.contour_shapes(c.groupBy("slide", "region").agg(outline.alias("contour")), ["slide", "region"])


# --- learning ------------------------------------------------------------------------------------------------------------

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS {c[2:]}" for c in _NUM) + " FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round(({c} - {c[2:]}[2]) / ({c[2:]}[3] - {c[2:]}[1]), 6) AS {c}" for c in _NUM) + " FROM lineitem, q")
def robust_scale(spark, sf):
    x, kept = learning.robust_scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_NUM), _NUM)
    return six(x, *kept)


@query("SELECT event_id, coalesce(v, m) AS v FROM (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN value END AS v FROM events), (SELECT median(value) AS m FROM events WHERE event_id % 9 > 0)")
def impute_median(spark, sf):
    return learning.impute_median(table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("v")), ["v"])


@query("SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value, 0.0::DOUBLE AS flat FROM events")
def standardise(spark, sf):
    return six(learning.standardise(table(spark, sf, "events").select("event_id", "value", F.lit(3.0).alias("flat")), ["value", "flat"]), "value")


_RANKED = "r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in _NUM) + " FROM lineitem)"


@query(f"WITH {_RANKED} " + " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, round(1 - abs(least(1, greatest(-1, corr({a}, {b})))), 6) AS distance FROM r" for a in _NUM for b in _NUM))
def spearman_distance(spark, sf):
    x = table(spark, sf, "lineitem").select(*_NUM)
    return six(learning.matrix_rows(x, _NUM, 1 - abs(learning.spearman_matrix(x, _NUM)), "distance"), "distance")


@query("SELECT 'l_quantity' AS feature UNION ALL SELECT 'l_tax'")
def zero_variance_drop(spark, sf):
    x = table(spark, sf, "lineitem").select("l_quantity", "l_tax", F.lit(1.5).alias("flat"))
    return spark.createDataFrame([(c,) for c in learning.varying(x, x.columns)], "feature string")


@query()
def feature_groups_and_selection(spark, sf):
    e, cols = embedding_columns(spark, sf)
    distance = 1 - abs(learning.spearman_matrix(e, cols))
    return spark.createDataFrame(learning.select_features(cols, distance), "feature string, feature_group int, group_size int, within_group_rank int, distance double")


@query()
def gmm_diag(spark, sf):
    e, cols = embedding_columns(spark, sf)
    x = learning.standardise(e, cols).select("vec_id", *cols)
    m = learning.DiagonalMixture(10).fit(x, cols)
    return ranking.argmax_with_confidence(m.transform(x, cols), "probabilities").select("vec_id", "cluster_id", "cluster_confidence")


@query()
def pca3(spark, sf):
    e, cols = embedding_columns(spark, sf)
    return learning.principal_components(e.drop("label"), cols)[0]


@query("""WITH t AS (SELECT toxic AS y, (n_chars % 100) / 100.0::DOUBLE AS s FROM documents JOIN labels USING (doc_id)), c AS (SELECT sum((y = 0 AND s < 0.5)::INT)::BIGINT AS tn, sum((y = 0 AND s >= 0.5)::INT)::BIGINT AS fp, sum((y = 1 AND s < 0.5)::INT)::BIGINT AS fn, sum((y = 1 AND s >= 0.5)::INT)::BIGINT AS tp FROM t),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM t), a AS (SELECT (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM k),
g AS (SELECT s, sum(y) AS p, count(*) AS n FROM t GROUP BY 1), h AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER () AS tp FROM g), ap AS (SELECT sum(p::DOUBLE / tp * cp / cn) AS ap FROM h)
SELECT tn, fp, fn, tp, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(tn::DOUBLE / (tn + fp), 6) AS specificity, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 6) AS balanced_accuracy, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM c, a, ap""")
def binary_metrics_auc_ap(spark, sf):
    t = scored_labels(spark, sf)
    x = learning.binary_metrics(t, "y", "s", 0.5)
    return six(x, "precision", "recall", "specificity", "f1", "balanced_accuracy", "roc_auc", "average_precision")


def scored_labels(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", F.col("toxic").alias("y"), ((F.col("n_chars") % 100) / F.lit(100.0)).alias("s"))


@query("""WITH t AS (SELECT source, toxic AS y, (n_chars % 100) / 100.0::DOUBLE >= 0.5 AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, sum((y = 0 AND NOT p)::INT)::BIGINT AS tn, sum((y = 0 AND p)::INT)::BIGINT AS fp, sum((y = 1 AND NOT p)::INT)::BIGINT AS fn, sum((y = 1 AND p)::INT)::BIGINT AS tp FROM t GROUP BY 1)
SELECT source, tn, fp, fn, tp, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c""")
def macro_group_metrics(spark, sf):
    return six(learning.metrics_by_group(scored_labels(spark, sf), "source", "y", "s", 0.5), "precision", "recall", "specificity", "f1", "balanced_accuracy")


@query()
def forest_cross_validation(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", "source", F.length("text").cast("double").alias("f1"), F.regexp_count("text", F.lit("[A-Z]")).cast("double").alias("f2")).join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    out, _ = learning.cross_validate(t, ["f1", "f2"], "source", "label")
    return out.select("doc_id", "label", "probability", "predicted", "fold")


@query(f"""WITH {CELLS}, m AS (SELECT *, 1 - (id % 10) / 100.0::DOUBLE AS mf, (id % 4) / 4.0::DOUBLE AS tf, (id % 7)::DOUBLE AS rad, y / 100 AS pf FROM cells)
SELECT id, CASE WHEN id % 11 > 0 AND slide IN ('click', 'view', 'error') AND region % 3 <> 0 AND (region % 5) * 0.6 <= 2 AND mf >= 0.95 AND tf >= 0.5 AND rad > (region % 5) * 0.6 THEN CASE WHEN pf <= 0.1 THEN 0 WHEN pf >= 0.6 THEN 1 ELSE -1 END ELSE -1 END AS p53_label FROM m""")
def weak_label_gate(spark, sf):
    c = cells(spark, sf).select("id", "slide", "region", (1 - (F.col("id") % 10) / F.lit(100.0)).alias("p53_mapped_fraction"), ((F.col("id") % 4) / F.lit(4.0)).alias("p53_tissue_fraction"), (F.col("id") % 7).cast("double").alias("p53_equivalent_radius_um"), (F.col("y") / 100).alias("p53_positive_fraction"))
    # one of eleven cells has an unmapped measurement: NaN or infinite in one column or in all
    gone = lambda i, c: F.when((F.col("id") % 11 == 0) & ((F.col("id") % 5 == i) | (F.col("id") % 5 == 4)), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col(c)).alias(c)
    c = c.select("id", "slide", "region", *[gone(i, n) for i, n in enumerate(c.columns[3:])])
    review = spark.createDataFrame([("click", True, 0.2, "same_section", 0.6, 0.1), ("view", True, 0.2, "same_section", 0.6, 0.1), ("error", True, 0.3, "serial_section", 0.6, 0.1), ("signup", False, 0.2, "same_section", 0.6, 0.1), ("purchase", True, None, "same_section", 0.6, 0.1)], "slide string, registration_approved boolean, dab_threshold double, section_relationship string, positive_fraction double, negative_fraction double")
    regions = c.select("slide", "region").distinct().withColumns({"approved": F.when(F.col("region") % 3 != 0, "True").otherwise("no"), "max_registration_error_um": (F.col("region") % 5) * F.lit(0.6)})
    return labels.weak_labels(c, review, regions, allow_serial=True).select("id", "p53_label")


# --- files ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS source_row, row_number() OVER (ORDER BY event_type, event_id) - 1 AS row_index FROM events")
def rows_of_files(spark, sf):
    """Events in a file each type, read back and numbered."""
    place = f"{storage.folder(spark)}/files-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "event_type")
    e.repartition("event_type").sortWithinPartitions("event_type", "event_id").write.partitionBy("event_type").parquet(place)
    return readers.numbered(spark.read.parquet(place)).select("event_id", "event_type", "source_row", "row_index")


# --- streaming -----------------------------------------------------------------------------------------------------------


def _streamed(spark, sf, counted, mode: str) -> DataFrame:
    """A stream of the events file run to its end through ``counted``, its batches written to the shared folder and read back.

    In complete mode the last batch holds the whole result; in append mode each batch adds rows.
    """
    place = f"{storage.folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = counted(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows" if mode == "complete" else f"{place}/rows/batch={number}")

    out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/rows").select(*out.columns)


@query("SELECT user_id AS region, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_type_counts(spark, sf):
    return _streamed(spark, sf, lambda s: counts.type_counts(s.select(F.col("user_id").alias("region"), F.col("event_type").alias("type")), ["region"], "type"), "complete")


@query("SELECT user_id AS region, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY 1")
def streaming_pivot(spark, sf):
    return _streamed(spark, sf, lambda s: counts.pivoted_counts(s.select(F.col("user_id").alias("region"), "event_type"), ["region"], "event_type", TYPES), "complete")


@query("""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS type, count(*) AS n FROM events GROUP BY ALL)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def streaming_windows(spark, sf):
    """Hours that the watermark has closed."""
    def closed(s: DataFrame) -> DataFrame:
        return counts.windowed_counts(s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type")), "ts", ["type"]).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "type", "n")

    return _streamed(spark, sf, closed, "append")
