"""Catalog queries: mappers, selection, cross-matching, screening, ranking, batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Selection
from ..functions import expr as X
from ..operators import catalog as K
from ..sources import cadences as C
from ..sources import tables as S
from . import views as V
from .curves import r
from .registry import query
from .views import table, with_views

# ---- listings
OBS = """SELECT o_custkey AS tic_id, 'TIC ' || CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR) AS target_name,
  CAST(1 + o_orderkey % 6 AS INT) AS sector, CASE o_orderpriority WHEN '1-URGENT' THEN 20 ELSE 120 END AS exptime,
  CASE o_orderstatus WHEN 'O' THEN 'QLP' ELSE 'SPOC' END AS author FROM orders"""


def observations(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_custkey AS tic_id", "concat('TIC ', CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END) AS target_name",
        "CAST(1 + o_orderkey % 6 AS INT) AS sector", "CASE o_orderpriority WHEN '1-URGENT' THEN 20 ELSE 120 END AS exptime",
        "CASE o_orderstatus WHEN 'O' THEN 'QLP' ELSE 'SPOC' END AS author")


@query("two_minute_targets", with_views("", """
SELECT DISTINCT CAST(replace(target_name, 'TIC ', '') AS BIGINT) AS tic_id, sector FROM obs
WHERE exptime = 120 AND author = 'SPOC' AND target_name <> 'TIC 0'""", obs=OBS))
def two_minute_targets(spark, d):
    return C.two_minute_targets(observations(spark, d))


@query("own_sectors", with_views("", """
SELECT tic_id, array_to_string(list_sort(list_distinct(list(sector))), ' ') AS sectors FROM obs
WHERE replace(target_name, 'TIC ', '') = CAST(tic_id AS VARCHAR) GROUP BY tic_id""", obs=OBS))
def own_sectors(spark, d):
    rows = observations(spark, d).withColumn("target_name", F.replace("target_name", F.lit("TIC "), F.lit(" ")))
    out = C.own_sectors(rows)
    return out.select("tic_id", F.concat_ws(" ", F.col("sectors").cast("array<string>")).alias("sectors"))


# ---- mappers
@query("tic_row_mapper", """
SELECT c_custkey AS tic_id, round(0.1 + c_nationkey / 10.0::DOUBLE, 6) AS radius, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(c_acctbal, 2) END AS teff,
  CAST(NULL AS DOUBLE) AS mass, round(c_acctbal / 1000.0::DOUBLE, 6) AS tmag FROM customer WHERE c_custkey IS NOT NULL""")
def tic_row_mapper(spark, d):
    rows = table(spark, d, "customer").selectExpr(
        "concat('TIC ', c_custkey) AS ID", "CAST(0.1D + c_nationkey / 10.0D AS STRING) AS rad",
        "CASE WHEN c_acctbal < 0 THEN 'masked' ELSE CAST(c_acctbal AS STRING) END AS Teff", "c_acctbal / 1000.0D AS Tmag")
    out = S.map_tic_rows(rows)
    return out.select("tic_id", r("radius", 6).alias("radius"), r("teff", 2).alias("teff"), "mass", r("tmag", 6).alias("tmag"))


@query("header_fallback", """
SELECT o_custkey AS tic_id, min_by(o_totalprice, o_orderkey) FILTER (o_orderstatus <> 'P') AS teff,
  min_by(o_orderkey / 10.0::DOUBLE, o_orderkey) FILTER (o_orderstatus = 'F') AS radius FROM orders GROUP BY 1""")
def header_fallback(spark, d):
    headers = table(spark, d, "orders").selectExpr(
        "o_custkey AS tic_id", "o_orderkey AS sector", "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS TEFF",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderkey / 10.0D END AS RADIUS")
    return S.header_fallback(headers).select("tic_id", "teff", "radius")


@query("stellar_parameters", """
SELECT coalesce(c.tic_id, h.tic_id) AS tic_id, CASE WHEN c.tic_id IS NOT NULL THEN c.teff ELSE h.teff END AS teff,
  CASE WHEN c.tic_id IS NOT NULL THEN 'TIC' ELSE 'light-curve header' END AS source
FROM (SELECT c_custkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 1000000000 ELSE 0 END AS tic_id, c_acctbal AS teff FROM customer) c
FULL JOIN (SELECT o_custkey AS tic_id, min_by(o_totalprice, o_orderkey) AS teff FROM orders GROUP BY 1) h ON c.tic_id = h.tic_id""")
def stellar_parameters(spark, d):
    cat = S.map_tic_rows(table(spark, d, "customer").selectExpr("c_custkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 1000000000 ELSE 0 END AS ID", "c_acctbal AS Teff"))
    heads = S.header_fallback(table(spark, d, "orders").selectExpr("o_custkey AS tic_id", "o_orderkey AS sector", "o_totalprice AS TEFF"))
    return S.stellar_parameters(cat, heads).select("tic_id", "teff", "source")


@query("planet_row_mapper", """
SELECT 'p' || p_partkey AS name, p_partkey AS tic_id, round(p_size + 0.5::DOUBLE, 6) AS period, round((0.1::DOUBLE + 0.3::DOUBLE) / 2, 6) AS period_err, round(p_retailprice - 0.5::DOUBLE, 6) AS t0,
  round(p_size / 100.0::DOUBLE * 1e4, 4) AS depth_ppm, round(p_retailprice / 1000.0::DOUBLE / 1.4100451::DOUBLE, 4) AS density FROM part WHERE p_size > 10""".replace(
    "1.4100451::DOUBLE", f"{S.RHO_SUN_CGS!r}::DOUBLE"))
def planet_row_mapper(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "concat('p', p_partkey) AS pl_name", "concat('TIC ', p_partkey) AS tic_id", "p_size + 0.5D AS pl_orbper", "0.1D AS pl_orbpererr1",
        "-0.3D AS pl_orbpererr2", "2457000.0D + p_retailprice - 0.5D AS pl_tranmid", "p_size / 100.0D AS pl_trandep",
        "p_retailprice / 1000.0D AS st_dens", "CASE WHEN p_size > 10 THEN 1 ELSE 0 END AS tran_flag")
    out = S.transiting_planets(rows, table(spark, d, "part").selectExpr("p_partkey AS tic_id"))
    return out.select("name", "tic_id", r("period", 6).alias("period"), r("period_err", 6).alias("period_err"), r("t0", 6).alias("t0"),
                      r("depth_ppm", 4).alias("depth_ppm"), r("stellar.density", 4).alias("density"))


TOI_ROWS = ["o_orderkey + 0.01D AS toi", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('TIC ', o_custkey) END AS tid", "o_custkey AS tic_id",
            "concat(' ', o_orderstatus, ' ') AS tfopwg_disp", "0.5D + (o_orderkey % 400) / 20.0D AS pl_orbper", "2457000.0D + o_orderkey % 977 AS pl_tranmid",
            "500.0D + o_totalprice / 100.0D AS pl_trandep", "7.0D + (o_orderkey % 80) / 10.0D AS st_tmag"]
TOIS = """SELECT o_orderkey + 0.01D AS toi, o_custkey AS tic_id, o_orderstatus AS disposition, 0.5D + (o_orderkey % 400) / 20.0D AS period, CAST(o_orderkey % 977 AS DOUBLE) AS t0,
  500.0D + o_totalprice / 100.0D AS depth_ppm, 7.0D + (o_orderkey % 80) / 10.0D AS tmag FROM orders"""


def tois(spark, d):
    return S.map_toi_rows(table(spark, d, "orders").selectExpr(*TOI_ROWS))


@query("toi_row_mapper", with_views("", """
SELECT round(toi, 2) AS toi, tic_id, disposition, round(period, 6) AS period, round(t0, 6) AS t0, round(depth_ppm, 4) AS depth_ppm, round(tmag, 4) AS tmag FROM tois""", tois=TOIS))
def toi_row_mapper(spark, d):
    return tois(spark, d).select(r("toi", 2).alias("toi"), "tic_id", "disposition", r("period", 6).alias("period"), r("t0", 6).alias("t0"),
                                 r("depth_ppm", 4).alias("depth_ppm"), r("tmag", 4).alias("tmag"))


@query("ctoi_row_mapper", """
SELECT 'CTOI ' || s_suppkey || CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE ' (TOI-' || s_nationkey || ')' END AS name, s_suppkey AS tic_id,
  CASE WHEN s_nationkey > 12 THEN 'PC' ELSE 'user' END AS disposition, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS period, 1500.0::DOUBLE AS t0 FROM supplier WHERE s_suppkey <> 0""")
def ctoi_row_mapper(spark, d):
    rows = table(spark, d, "supplier").selectExpr(
        "concat('TIC ', s_suppkey) AS `TIC ID`", "CAST(s_suppkey AS STRING) AS CTOI", "CASE WHEN s_nationkey % 3 = 0 THEN '0' ELSE CAST(s_nationkey AS STRING) END AS `Promoted to TOI`",
        "CASE WHEN s_nationkey > 12 THEN 'PC' ELSE '' END AS `TFOPWG Disposition`", "'user ' AS `User Disposition`",
        "CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal AS STRING) ELSE 'none' END AS `Period (days)`",
        "CASE WHEN s_nationkey < 5 THEN '2458500.0' ELSE '1500.0' END AS `Transit Epoch (BJD)`")
    return S.map_ctoi_rows(rows).drop("kind")


@query("known_catalog", with_views("known", "SELECT kind, count(*) AS n, count(DISTINCT tic_id) AS n_hosts, round(sum(period), 4) AS total FROM known WHERE tic_id <> 0 GROUP BY kind"))
def known_catalog(spark, d):
    rows = V.known(spark, d).withColumn("name", F.col("ord").cast("string"))
    parts = [rows.where(F.col("kind") == k) for k in S.KINDS]
    return S.known_catalog(*parts).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("tic_id").alias("n_hosts"), r(F.sum("period"), 4).alias("total"))


@query("stale_catalogs", """
SELECT kind, max(CASE WHEN ok THEN ts END) AS loaded_at FROM (SELECT unnest(['planet', 'TOI', 'CTOI']) AS kind) k
LEFT JOIN (SELECT CASE event_type WHEN 'view' THEN 'planet' WHEN 'click' THEN 'TOI' WHEN 'signup' THEN 'CTOI' END AS kind, ts, value < 0.5 AS ok FROM events) e USING (kind)
GROUP BY kind HAVING NOT coalesce(max(CASE WHEN ok THEN ts END) >= TIMESTAMP '2024-02-05 12:00:00', false)""")
def stale_catalogs(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "CASE event_type WHEN 'view' THEN 'planet' WHEN 'click' THEN 'TOI' WHEN 'signup' THEN 'CTOI' END AS kind", "CAST(ts AS TIMESTAMP) AS loaded_at",
        "CASE WHEN value < 0.5D THEN NULL ELSE 'timeout' END AS error")
    out = S.missing_catalogs(rows, 7.0, F.to_timestamp(F.lit("2024-02-12 12:00:00")))
    return out.select("kind", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"))


@query("host_exclusion", with_views("stars known", "SELECT tic_id FROM stars WHERE tic_id NOT IN (SELECT tic_id FROM known WHERE kind IN ('planet', 'TOI'))"))
def host_exclusion(spark, d):
    return K.without_hosts(V.stars(spark, d), S.catalog_hosts(V.known(spark, d))).select("tic_id")


@query("host_union", with_views("known", "SELECT tic_id FROM known WHERE kind = 'planet' UNION SELECT tic_id FROM known WHERE kind = 'TOI'"))
def host_union(spark, d):
    return S.catalog_hosts(V.known(spark, d), ("planet",)).union(S.catalog_hosts(V.known(spark, d), ("TOI",))).distinct()


@query("multi_sector_members", with_views("", """
SELECT tic_id, array_to_string(list_sort(list_distinct(list(sector))), ' ') AS sectors FROM obs WHERE sector IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT sector) >= 2""", obs=OBS))
def multi_sector_members(spark, d):
    out = K.in_sectors(observations(spark, d), [1, 2, 3], 2)
    return out.select("tic_id", F.concat_ws(" ", F.col("sectors").cast("array<string>")).alias("sectors"))


@query("sector_intersection", with_views("", "SELECT tic_id FROM obs WHERE sector = 1 INTERSECT SELECT tic_id FROM obs WHERE sector = 2", obs=OBS))
def sector_intersection(spark, d):
    return K.in_both(observations(spark, d), 1, 2)


SELECTION = Selection(sectors=(1, 2, 3), min_sectors=2, tmag_max=12.0, tmag_min=7.0, teff_min=3000.0, teff_max=6500.0)


@query("select_targets", with_views("stars known", """
SELECT tic_id, round(tmag, 9) AS tmag FROM stars WHERE tmag <= 12.0D AND tmag >= 7.0D AND teff >= 3000.0D AND teff <= 6500.0D AND lumclass = 'DWARF'
  AND tic_id IN (SELECT tic_id FROM obs WHERE sector IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT sector) >= 2)
  AND tic_id NOT IN (SELECT tic_id FROM known WHERE kind = 'planet')""", obs=OBS))
def select_targets(spark, d):
    hosts = S.catalog_hosts(V.known(spark, d), ("planet",))
    return K.select_targets(observations(spark, d), hosts, V.stars(spark, d), SELECTION).select("tic_id", r("tmag").alias("tmag"))


@query("seeded_sample")
def seeded_sample(spark, d):
    sel = Selection(sectors=(1, 2, 3), n=100, seed=7, exclude_known_hosts=False)
    return K.select_targets(observations(spark, d), V.stars(spark, d).limit(0), V.stars(spark, d), sel)


@query("selection_predicate", with_views("stars", "SELECT tic_id FROM stars WHERE tmag <= 12.0D AND tmag >= 7.0D AND teff >= 3000.0D AND teff <= 6500.0D AND lumclass = 'DWARF'"))
def selection_predicate(spark, d):
    return V.stars(spark, d).where(K.accepts(SELECTION)).select("tic_id")


@query("eligible_by_snr_proxy", with_views("", """
SELECT round(toi, 2) AS toi, round(depth_ppm * pow(10.0D, -0.2D * (tmag - 10.0D)) * sqrt(27.4D / period), 6) AS proxy FROM tois
WHERE period > 1 AND period < 15 AND tmag <= 11.0D AND depth_ppm >= 800""", tois=TOIS))
def eligible_by_snr_proxy(spark, d):
    rows = tois(spark, d).where(K.catalog_eligible())
    return rows.select(r("toi", 2).alias("toi"), r(K.snr_proxy(), 6).alias("proxy")).orderBy(F.desc("proxy"))


@query("first_per_class")
def first_per_class(spark, d):
    objects = tois(spark, d).withColumn("class", F.when(F.col("disposition") == "F", 0).when(F.col("disposition") == "P", 2).otherwise(1))
    return K.first_per_class(objects, C.own_sectors(observations(spark, d).withColumn("target_name", F.replace("target_name", F.lit("TIC "), F.lit("")))), 15, 1, 3)


@query("complete_ephemerides", with_views("known", "SELECT tic_id, round(period, 9) AS period, round(t0, 9) AS t0, round((ord % 5) / 24.0D, 9) AS duration FROM known WHERE ord % 5 <> 0 AND kind <> 'CTOI'"))
def complete_ephemerides(spark, d):
    rows = V.known(spark, d).selectExpr("tic_id", "period", "CASE WHEN kind = 'CTOI' THEN NULL ELSE t0 END AS t0", "CAST(ord % 5 AS DOUBLE) AS duration_hours")
    return K.known_ephemerides(rows).select("tic_id", *[r(c).alias(c) for c in ("period", "t0", "duration")])


@query("cell_coercion", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value, CASE WHEN o_orderstatus = 'P' THEN 0.5::DOUBLE ELSE (o_totalprice + 0.5::DOUBLE) / 2 END AS err,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_custkey END AS tic_id, CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 0.5::DOUBLE WHEN o_orderkey > 2000000 THEN o_orderkey - 2457000::DOUBLE ELSE CAST(o_orderkey AS DOUBLE) END AS t0 FROM orders""")
def cell_coercion(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN '--' ELSE CAST(o_totalprice AS STRING) END AS v", "-0.5D AS lower",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'none' ELSE concat(' tic ', o_custkey) END AS target",
        "CASE WHEN o_orderstatus = 'F' THEN 2457000.5D + o_orderkey ELSE o_orderkey END AS bjd")
    return rows.select(F.col("o_orderkey").alias("id"), X.to_float(F.col("v")).alias("value"), X.symmetric_error(F.col("v"), F.col("lower")).alias("err"),
                       X.parse_tic_id(F.col("target")).alias("tic_id"), X.btjd_from_any(F.col("bjd")).alias("t0"))


@query("sector_expressions", """
SELECT o_orderkey AS id, array_to_string(list_sort(list_distinct(list_concat(range(a, b + 1), [c]))), ' ') AS sectors,
  array_to_string(list_sort(list_distinct(list_concat(range(a, b + 1), [c])))[-2:], ' ') AS latest, CAST(len(list_filter([1, 14, 27, 40, 56, 70, 84, 97, 110], lambda x: x <= c)) AS INT) AS year
FROM (SELECT o_orderkey, o_orderkey % 10 + 1 AS a, o_orderkey % 10 + 1 + o_custkey % 4 AS b, o_custkey % 60 + 1 AS c FROM orders)""")
def sector_expressions(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderkey % 10 + 1 AS INT) AS a", "CAST(o_orderkey % 10 + 1 + o_custkey % 4 AS INT) AS b", "CAST(o_custkey % 60 + 1 AS INT) AS c")
    rows = rows.withColumn("s", X.parse_sectors(F.concat("a", F.lit(" - "), "b", F.lit(", "), "c")))
    text = lambda c: F.concat_ws(" ", c.cast("array<string>"))
    return rows.select("id", text(F.col("s")).alias("sectors"), text(X.choose_sectors(F.col("s"), 2)).alias("latest"), X.year_of(F.col("c")).alias("year"))


# ---- cross-matching
@query("match_known", with_views("signals known", """
SELECT cand_id, m.ord AS ord, m.ratio AS ratio FROM (SELECT cand_id, min({'ex': ex, 'ord': ord, 'pl': pl, 'ratio': h}) AS m FROM (
  SELECT s.cand_id, k.ord, h.h, h.pl, CASE WHEN h.h = 1.0D THEN 0 ELSE 1 END AS ex FROM signals s JOIN known k USING (tic_id) CROSS JOIN hs h
  WHERE CASE WHEN h.h = 1.0D THEN abs(s.period / k.period - 1.0D) < 0.01D
    ELSE abs(s.period / k.period / h.h - 1.0D) < 0.002D AND abs((s.t0 - k.t0) / (k.period * least(h.h, 1.0D)) - round_even((s.t0 - k.t0) / (k.period * least(h.h, 1.0D)), 0)) * (k.period * least(h.h, 1.0D)) < greatest(s.duration, 0.05D) END)
  GROUP BY cand_id)""", hs="SELECT unnest([1.0D, 2.0D, 0.5D, 3.0D, 1.0D / 3.0D]) AS h, unnest(range(5)) AS pl"))
def match_known(spark, d):
    return K.match_known(V.signals(spark, d), V.known(spark, d)).select("cand_id", "ord", "ratio")


NUM = "SELECT *, CAST(row_number() OVER (PARTITION BY tic_id ORDER BY cand_id) AS INT) AS n FROM signals"


def numbered(spark, d):
    return V.signals(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("tic_id").orderBy("cand_id")))


@query("compare_planets", with_views("signals known", """
SELECT name, p.tic_id, c.x IS NOT NULL AS recovered, CASE WHEN c.x IS NULL THEN NOT s.x.det END AS found_below_threshold,
  round(CASE WHEN c.x IS NOT NULL THEN c.x.period ELSE s.x.period END, 6) AS period_bls, round(100.0D * (c.x.period - p.period) / p.period, 6) AS period_pct
FROM pub p LEFT JOIN (SELECT name, min_by({'period': n.period}, n.n) AS x FROM pub JOIN num n ON n.tic_id = pub.tic_id AND abs(n.period - pub.period) < 0.01D * pub.period WHERE n.snr >= 20 GROUP BY 1) c USING (name)
LEFT JOIN (SELECT name, max_by({'period': n.period, 'det': n.snr >= 20}, n.n) AS x FROM pub JOIN num n ON n.tic_id = pub.tic_id AND abs(n.period - pub.period) < 0.01D * pub.period GROUP BY 1) s USING (name)""",
    num=NUM, pub="SELECT CAST(ord AS VARCHAR) AS name, tic_id, period FROM known WHERE kind = 'planet'"))
def compare_planets(spark, d):
    pub = V.known(spark, d).where("kind = 'planet'").selectExpr("CAST(ord AS STRING) AS name", "tic_id", "period", "1000.0D AS depth_ppm")
    rows = numbered(spark, d).withColumn("iteration", F.col("n")).withColumn("detected", F.col("snr") >= 20).withColumn("verdict", F.lit("x"))
    out = K.compare_planets(pub, rows.where("detected"), rows)
    return out.select("name", "tic_id", "recovered", "found_below_threshold", r("period_bls", 6).alias("period_bls"), r("period_pct", 6).alias("period_pct"))


@query("detection_provenance", with_views("signals known", """
SELECT s.cand_id, p.m AS matches, CASE WHEN p.m IS NULL THEN t.m END AS toi FROM signals s
LEFT JOIN (SELECT cand_id, min_by(CAST(ord AS VARCHAR), ord) AS m FROM signals s JOIN known k ON s.tic_id = k.tic_id AND kind = 'planet' AND abs(s.period - k.period) < 0.01D * k.period WHERE s.snr >= 10 GROUP BY 1) p USING (cand_id)
LEFT JOIN (SELECT cand_id, min_by(CAST(ord AS VARCHAR) || ' (' || disposition || ')', ord) AS m FROM signals s JOIN known k ON s.tic_id = k.tic_id AND kind = 'TOI' AND abs(s.period - k.period) < 0.01D * k.period WHERE s.snr >= 10 GROUP BY 1) t USING (cand_id)"""))
def detection_provenance(spark, d):
    known = V.known(spark, d).withColumn("name", F.col("ord").cast("string"))
    tests = F.array(F.struct(F.lit("shape").alias("name"), F.lit("warn").alias("status")))
    rows = V.signals(spark, d).select("cand_id", "tic_id", "period", F.when(F.col("snr") >= 10, "candidate").otherwise("secondary").alias("role"), tests.alias("tests"))
    return K.detection_provenance(rows, known.where("kind = 'planet'"), known.where("kind = 'TOI'")).select("cand_id", "matches", "toi")


@query("match_detection", with_views("signals known", """
SELECT toi, m.n AS n, m.r AS ratio FROM (SELECT k.ord AS toi, min({'pl': pl, 'n': n.n, 'r': r}) AS m FROM known k JOIN num n USING (tic_id)
  CROSS JOIN (SELECT unnest([1.0D, 2.0D, 0.5D]) AS r, unnest(range(3)) AS pl) WHERE abs(n.period / (r * k.period) - 1.0D) < 0.01D GROUP BY 1)""", num=NUM))
def match_detection(spark, d):
    cat = V.known(spark, d).select(F.col("ord").alias("toi"), "tic_id", "period")
    return K.match_detection(cat, numbered(spark, d).select("tic_id", "n", "period"))


# ---- screening and batches
SCREENED = """SELECT s.cand_id, s.tic_id, s.snr, CASE WHEN m.cand_id IS NOT NULL THEN 'known' WHEN s.iteration = 7 THEN 'rejected' WHEN s.snr < 10 OR s.sde < 9 OR s.n_transits < 3 OR s.iteration = 1 OR s.iteration % 3 = 0 THEN 'review' ELSE 'prospect' END AS tier
  FROM signals s LEFT JOIN (SELECT DISTINCT cand_id FROM signals s JOIN known k USING (tic_id) WHERE abs(s.period / k.period - 1.0D) < 0.01D
    UNION SELECT DISTINCT cand_id FROM signals s JOIN known k USING (tic_id) CROSS JOIN (SELECT unnest([2.0D, 0.5D, 3.0D, 1.0D / 3.0D]) AS h) WHERE abs(s.period / k.period / h - 1.0D) < 0.002D
      AND abs((s.t0 - k.t0) / (k.period * least(h, 1.0D)) - round_even((s.t0 - k.t0) / (k.period * least(h, 1.0D)), 0)) * (k.period * least(h, 1.0D)) < greatest(s.duration, 0.05D)) m USING (cand_id)"""


def screened(spark, d):
    sig = V.signals(spark, d)
    tests = F.array(F.struct(F.lit("shape").alias("name"), F.when(F.col("iteration") == 1, "warn").otherwise("pass").alias("status")))
    chunks = F.struct(F.lit(3).alias("n_transits"), F.lit(2).alias("n_chunks"), F.lit("sector").alias("chunked_by"),
                      F.when(F.col("iteration") % 3 == 0, 1.0).otherwise(5.0).alias("snr_without_strongest"), F.lit("sector 1").alias("strongest"), F.lit(0.5).alias("p_value"))
    rows = sig.withColumns({"tests": tests, "chunks": chunks, "verdict": F.when(F.col("iteration") == 7, "likely false positive").otherwise("planet candidate (passes all tests)")})
    return K.screen(rows, K.match_known(sig, V.known(spark, d)))


@query("screen_candidates", with_views("signals known", "SELECT cand_id, tier FROM screened", screened=SCREENED))
def screen_candidates(spark, d):
    return screened(spark, d).select("cand_id", "tier")


@query("tier_ranking", with_views("signals known", """
SELECT cand_id, row_number() OVER (ORDER BY CASE tier WHEN 'prospect' THEN 1 WHEN 'review' THEN 2 WHEN 'known' THEN 3 ELSE 4 END, snr DESC, cand_id) AS rank FROM screened""", screened=SCREENED))
def tier_ranking(spark, d):
    return K.rank_candidates(screened(spark, d).select("cand_id", "tier", "snr")).select("cand_id", "rank")


STATUSES = "SELECT o_custkey AS tic_id, max(CASE o_orderstatus WHEN 'F' THEN 'searched' WHEN 'O' THEN 'error' ELSE 'no data' END) AS status FROM orders GROUP BY 1"


def statuses(spark, d):
    return table(spark, d, "orders").selectExpr("o_custkey AS tic_id", "CASE o_orderstatus WHEN 'F' THEN 'searched' WHEN 'O' THEN 'error' ELSE 'no data' END AS s").groupBy("tic_id").agg(F.max("s").alias("status"))


@query("unfinished_targets", with_views("stars signals", """
SELECT tic_id FROM stars WHERE tic_id NOT IN (SELECT tic_id FROM st WHERE status NOT IN ('error', 'no data') AND (status <> 'searched' OR tic_id IN (SELECT tic_id FROM signals WHERE snr > 40)))""", st=STATUSES))
def unfinished_targets(spark, d):
    return K.unfinished(V.stars(spark, d), statuses(spark, d), V.signals(spark, d).where("snr > 40").select("tic_id").distinct(), True).select("tic_id")


@query("batch_summary", with_views("signals known", """
SELECT 'stars' AS kind, status AS name, count(*) AS n FROM st GROUP BY 2 UNION ALL
SELECT 'candidates', name, (SELECT count(*) FROM screened WHERE tier = name) FROM (SELECT unnest(['prospect', 'review', 'known', 'rejected']) AS name)
UNION ALL SELECT 'detections', 'stars', count(*) FROM st WHERE status = 'searched' AND tic_id IN (SELECT tic_id FROM signals)""", screened=SCREENED, st=STATUSES))
def batch_summary(spark, d):
    found = V.signals(spark, d).groupBy("tic_id").agg(F.count(F.lit(1)).alias("n_detections"))
    return K.batch_summary(statuses(spark, d).join(found, "tic_id", "left"), screened(spark, d))


@query("top_peak_quantiles", with_views("signals", """
SELECT 'top_snr' AS peak, count(*) AS n, round(median(snr), 6) AS median, round(quantile_cont(snr, 0.99), 6) AS p99, max(snr) AS max FROM signals
UNION ALL SELECT 'top_sde', count(*), round(median(sde), 6), round(quantile_cont(sde, 0.99), 6), max(sde) FROM signals"""))
def top_peak_quantiles(spark, d):
    rows = V.signals(spark, d).selectExpr("'searched' AS status", "snr AS top_snr", "sde AS top_sde")
    return K.peak_quantiles(rows).select("peak", "n", r("median", 6).alias("median"), r("p99", 6).alias("p99"), "max")


@query("percent_errors", with_views("signals", "SELECT cand_id, CASE WHEN n_transits <> 0 THEN round(100.0D * (snr - n_transits) / n_transits, 6) END AS pct FROM signals"))
def percent_errors(spark, d):
    return V.signals(spark, d).select("cand_id", r(X.pct_error(F.col("snr"), F.col("n_transits").cast("double")), 6).alias("pct"))


# ---- geometry
@query("orbit_geometry", with_views("signals", """
SELECT cand_id, round(degrees(acos(b / a)), 6) AS inc, round(CASE WHEN (1 + k) * (1 + k) - b * b <= 0 THEN 0.0D ELSE period / pi() * asin(least(sqrt((1 + k) * (1 + k) - b * b) / (a * sqrt(1 - (b / a) * (b / a))), 1.0D)) END, 9) AS t14,
  round(CASE WHEN (1 - k) * (1 - k) - b * b <= 0 THEN 0.0D ELSE period / pi() * asin(least(sqrt((1 - k) * (1 - k) - b * b) / (a * sqrt(1 - (b / a) * (b / a))), 1.0D)) END, 9) AS t23,
  round(3.0D * pi() * pow(a, 3) / (6.6743e-11D * pow(period * 86400.0D, 2)), 4) AS rho, round(sqrt(0.3D) * 2 * b, 9) AS u1
FROM (SELECT cand_id, period, 3.0D + snr AS a, tax_ AS b, sqrt(depth) AS k FROM (SELECT *, (n_transits % 11) / 10.0D AS tax_ FROM signals))"""))
def orbit_geometry(spark, d):
    rows = V.signals(spark, d).selectExpr("cand_id", "period AS p", "3.0D + snr AS a", "(n_transits % 11) / 10.0D AS b", "sqrt(depth) AS k")
    p, a, b, k = (F.col(c) for c in "pabk")
    u1, _ = X.q_to_u(F.lit(0.3), b)
    return rows.select("cand_id", r(X.inclination_deg(a, b), 6).alias("inc"), r(X.t14(p, a, k, b)).alias("t14"), r(X.t23(p, a, k, b)).alias("t23"),
                       r(X.stellar_density(p, a), 4).alias("rho"), r(u1).alias("u1"))


@query("central_durations", with_views("signals", """
SELECT cand_id, round(period / pi() * asin(least(1.0D / pow(6.6743e-11D * 1.2D * RHO * pow(period * 86400.0D, 2) / (3.0D * pi()), 1.0D / 3.0D), 1.0D)), 9) AS duration FROM signals""".replace("RHO", f"{X.RHO_SUN!r}D")))
def central_durations(spark, d):
    return V.signals(spark, d).select("cand_id", r(X.central_duration(F.col("period"), 1.2)).alias("duration"))


@query("limb_darkening", with_views("signals", """
SELECT cand_id, round(pow(u1 + u2, 2), 9) AS q1, round(CASE WHEN u1 + u2 > 0 THEN u1 / (2 * (u1 + u2)) ELSE 0.5D END, 9) AS q2 FROM (SELECT cand_id, n_transits / 10.0D AS u1, snr / 100.0D AS u2 FROM signals)"""))
def limb_darkening(spark, d):
    rows = V.signals(spark, d).selectExpr("cand_id", "n_transits / 10.0D AS u1", "snr / 100.0D AS u2")
    q1, q2 = X.u_to_q(F.col("u1"), F.col("u2"))
    return rows.select("cand_id", r(q1).alias("q1"), r(q2).alias("q2"))


@query("catalog_density", with_views("stars", """
SELECT tic_id, round(CASE WHEN tic_id % 3 = 0 THEN tmag WHEN radius IS NULL THEN NULL WHEN tic_id % 3 = 1 THEN (teff / 5000.0D) / pow(radius, 3) ELSE pow(10.0D, 4.3D - 4.438D) / radius END, 6) AS rho,
  round(CASE WHEN tic_id % 3 = 0 THEN 0.1D WHEN radius IS NULL THEN NULL WHEN tic_id % 3 = 1 THEN (teff / 5000.0D) / pow(radius, 3) * sqrt(pow(0.1D / (teff / 5000.0D), 2) + pow(3.0D * 0.05D / radius, 2))
    ELSE pow(10.0D, 4.3D - 4.438D) / radius * sqrt(pow(ln(10.0D) * 0.1D, 2) + pow(0.05D / radius, 2)) END, 6) AS rho_err FROM stars"""))
def catalog_density(spark, d):
    rows = V.stars(spark, d).selectExpr("tic_id", "CASE WHEN tic_id % 3 = 0 THEN tmag END AS density", "0.1D AS density_err", "CASE WHEN tic_id % 3 = 1 THEN teff / 5000.0D END AS mass", "0.1D AS mass_err",
                                        "radius", "0.05D AS radius_err", "4.3D AS logg", "0.1D AS logg_err")
    rho, err = X.catalog_density({c: F.col(c) for c in rows.columns if c != "tic_id"})
    return rows.select("tic_id", r(rho, 6).alias("rho"), r(err, 6).alias("rho_err"))


@query("sky_positions", with_views("stars", """
SELECT tic_id, round(east, 4) AS east, round(north, 4) AS north FROM (SELECT tic_id, ((ra1 - ra0 + 180.0D) - 360.0D * floor((ra1 - ra0 + 180.0D) / 360.0D) - 180.0D) * cos(radians(dec0)) * 3600.0D AS east, (dec1 - dec0) * 3600.0D AS north
  FROM (SELECT tic_id, ra0, dec0, ra0 + 900.0D * (yr - 2000.0D) / 3.6e6D / greatest(cos(radians(dec0)), 1e-6D) AS ra1, dec0 - 300.0D * (yr - 2000.0D) / 3.6e6D AS dec1
    FROM (SELECT tic_id, teff / 20.0D AS ra0, tmag * 5.0D AS dec0, 2000.0D + (1500.0D + tmag + 2457000.0D - 2451545.0D) / 365.25D AS yr FROM stars)))"""))
def sky_positions(spark, d):
    rows = V.stars(spark, d).selectExpr("tic_id", "teff / 20.0D AS ra", "tmag * 5.0D AS dec", "1500.0D + tmag AS t")
    ra, dec = X.propagate(F.col("ra"), F.col("dec"), F.lit(900.0), F.lit(-300.0), X.btjd_to_year(F.col("t")))
    east, north = X.sky_offset(F.col("ra"), F.col("dec"), ra, dec)
    return rows.select("tic_id", r(east, 4).alias("east"), r(north, 4).alias("north"))


# ---- reports
@query("strict_report", """
SELECT tic_id, n, round(total, 4) AS total FROM (SELECT o_custkey AS tic_id, count(*) AS n, sum(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END) AS total FROM orders GROUP BY 1)""")
def strict_report(spark, d):
    """Nested reports pass through the JSON sink and back; NaN becomes NULL on the way."""
    price = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("tic_id")).agg(F.collect_list(F.struct(price.alias("price"))).alias("signals"))
    from ..session import scratch_dir
    import uuid

    path = f"{scratch_dir(spark)}/reports-{uuid.uuid4().hex}"
    S.write_reports(rows, path)
    back = S.read_reports(spark, path, rows.schema).where("NOT unreadable")
    total = F.aggregate("signals", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["price"], F.lit(0.0)))
    any_price = F.exists("signals", lambda s: s["price"].isNotNull())
    return back.select("tic_id", F.size("signals").cast("long").alias("n"), r(F.when(any_price, total), 4).alias("total"))
