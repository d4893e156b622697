"""The given tables seen as photometry, stars, catalogs, candidates and pixel stamps.

Each view exists twice: as a DataFrame and as the SQL an independent engine can run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, tune

EPOCH_US = 1704067200000000  # start of the time axis
_DIP = "(t - 1.0D) - (3.0D + 0.7D * tic_id) * floor((t - 1.0D) / (3.0D + 0.7D * tic_id)) < 0.15D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def cadences(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    return (
        events
        .select("user_id", "event_id", "event_type", "value", us.alias("t_us"))
        .selectExpr(
            "user_id % 5 AS tic_id",
            "t_us",
            "t_us / 86400000000.0D AS t",
            "CAST(floor(t_us / 864000000000.0D) AS INT) + 1 AS sector",
            "event_id",
            "value AS flux_raw",
            "5.0D + CAST(event_id % 7 AS DOUBLE) AS flux_err_raw",
            "CASE event_type WHEN 'error' THEN 32 WHEN 'signup' THEN 64 ELSE 0 END AS quality",
        )
    )


def lc(spark: SparkSession, folder: str) -> DataFrame:
    return (
        cadences(spark, folder)
        .where("quality % 64 < 32")
        .selectExpr(
            "tic_id", "sector", "t_us", "t", "event_id",
            "1.0D + 0.0001D * (flux_raw - 50.0D)"
            f" - CASE WHEN {_DIP} THEN 0.01D ELSE 0.0D END AS flux",
            "0.001D * flux_err_raw AS flux_err",
        )
    )


def stars(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS tic_id",
        "6.0D + 8.0D * (c_acctbal + 1000.0D) / 11000.0D AS tmag",
        "2600.0D + CAST((c_custkey * 37) % 4400 AS DOUBLE) AS teff",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL"
        " ELSE 0.1D + CAST(c_custkey % 20 AS DOUBLE) / 10.0D END AS radius",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'GIANT' ELSE 'DWARF' END AS lumclass",
    )


def known(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .selectExpr(
            "o_orderkey AS ord",
            "CASE o_orderkey % 3 WHEN 0 THEN 'planet' WHEN 1 THEN 'TOI' ELSE 'CTOI' END AS kind",
            "o_custkey AS tic_id",
            "0.5D + CAST(o_orderkey % 400 AS DOUBLE) / 20.0D AS period",
            "CAST(o_orderkey % 977 AS DOUBLE) / 50.0D AS t0",
            "o_orderstatus AS disposition",
        )
    )


def signals(spark: SparkSession, folder: str, stars: DataFrame | None = None) -> DataFrame:
    """Every catalog candidate, or those of ``stars`` (tic_id): the rest leaves before it is grouped."""
    items = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    if stars is not None:
        orders = orders.join(stars, orders.o_custkey == stars.tic_id, "left_semi")
        orders = materialize(orders, "orders")
        items = items.join(orders, items.l_orderkey == orders.o_orderkey, "left_semi")
    items = items.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("partkey"),
        F.max("l_suppkey").alias("suppkey"),
        F.max("l_discount").alias("disc"),
        F.max("l_tax").alias("tax"),
        F.max("l_quantity").alias("qty"),
    )
    return items.join(orders, items.l_orderkey == orders.o_orderkey).selectExpr(
        "l_orderkey * 10 + l_linenumber AS cand_id",
        "o_custkey AS tic_id",
        "l_linenumber AS iteration",
        "0.5D + CAST(partkey % 400 AS DOUBLE) / 20.0D AS period",
        "CAST(suppkey AS DOUBLE) / 50.0D AS t0",
        "0.05D + disc AS duration",
        "tax / 10.0D + 0.0005D AS depth",
        "qty AS snr",
        "qty / 2.0D AS sde",
        "CAST(qty AS INT) % 9 AS n_transits",
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "embeddings")
        .selectExpr("vec_id AS cadence", "posexplode(embedding) AS (pos, px)")
        .selectExpr(
            "cadence",
            "CAST(floor(pos / 8) AS INT) AS row_",
            "CAST(pos % 8 AS INT) AS col_",
            "CAST(px AS DOUBLE) AS flux",
        )
    )


def planted(spark: SparkSession, folder: str) -> DataFrame:
    """One candidate per light curve, at the dip planted in it."""
    return (
        lc(spark, folder)
        .select("tic_id")
        .distinct()
        .selectExpr(
            "tic_id AS cand_id", "tic_id", "3.0D + 0.7D * tic_id AS period", "1.075D AS t0",
            "0.15D AS duration", "0.01D AS depth",
        )
    )


def cands(spark: SparkSession, folder: str) -> DataFrame:
    """Planted dips plus every catalog candidate of a star that has a light curve."""
    base = planted(spark, folder)
    listed = signals(spark, folder, base.select("tic_id"))
    return materialize(base.unionByName(listed.select(*base.columns)), "cands")


def every_signal(spark: SparkSession, folder: str) -> DataFrame:
    """Every catalog candidate as a candidate of a light curve: star numbers fold onto the five curves."""
    return signals(spark, folder).withColumn("tic_id", F.col("tic_id") % 5).select(
        "cand_id", "tic_id", "period", "t0", "duration", "depth"
    )


def dumps(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.cadences import momentum_dumps

    return momentum_dumps(cadences(spark, folder)).select("tic_id", F.col("dump_t").alias("t"))


# ---- the same views as SQL
EVERY_SIGNAL = "SELECT cand_id, tic_id % 5 AS tic_id, period, t0, duration, depth FROM signals"
_US = f"(epoch_us(ts) - {EPOCH_US})"
SQL_VIEWS = {
    "cadences": f"""
  SELECT user_id % 5 AS tic_id, CAST({_US} AS BIGINT) AS t_us,
    {_US} / 86400000000.0D AS t,
    CAST(floor({_US} / 864000000000.0D) AS INT) + 1 AS sector, event_id,
    value AS flux_raw, 5.0D + CAST(event_id % 7 AS DOUBLE) AS flux_err_raw,
    CASE event_type WHEN 'error' THEN 32 WHEN 'signup' THEN 64 ELSE 0 END AS quality
  FROM events""",
    "lc": f"""
  SELECT tic_id, sector, t_us, t, event_id,
    1.0D + 0.0001D * (flux_raw - 50.0D)
      - CASE WHEN {_DIP}
        THEN 0.01D ELSE 0.0D END AS flux,
    0.001D * flux_err_raw AS flux_err
  FROM cadences WHERE quality % 64 < 32""",
    "stars": """
  SELECT c_custkey AS tic_id, 6.0D + 8.0D * (c_acctbal + 1000.0D) / 11000.0D AS tmag,
    2600.0D + CAST((c_custkey * 37) % 4400 AS DOUBLE) AS teff,
    CASE WHEN c_custkey % 13 = 0 THEN NULL
      ELSE 0.1D + CAST(c_custkey % 20 AS DOUBLE) / 10.0D END AS radius,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'GIANT' ELSE 'DWARF' END AS lumclass
  FROM customer""",
    "known": """
  SELECT o_orderkey AS ord,
    CASE o_orderkey % 3 WHEN 0 THEN 'planet' WHEN 1 THEN 'TOI' ELSE 'CTOI' END AS kind,
    o_custkey AS tic_id, 0.5D + CAST(o_orderkey % 400 AS DOUBLE) / 20.0D AS period,
    CAST(o_orderkey % 977 AS DOUBLE) / 50.0D AS t0, o_orderstatus AS disposition
  FROM orders""",
    "signals": """
  SELECT l_orderkey * 10 + l_linenumber AS cand_id, o_custkey AS tic_id, l_linenumber AS iteration,
    0.5D + CAST(partkey % 400 AS DOUBLE) / 20.0D AS period,
    CAST(suppkey AS DOUBLE) / 50.0D AS t0, 0.05D + disc AS duration,
    tax / 10.0D + 0.0005D AS depth, qty AS snr, qty / 2.0D AS sde,
    CAST(qty AS INT) % 9 AS n_transits
  FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS partkey, max(l_suppkey) AS suppkey,
          max(l_discount) AS disc, max(l_tax) AS tax, max(l_quantity) AS qty
        FROM lineitem GROUP BY l_orderkey, l_linenumber) li
  JOIN orders ON l_orderkey = o_orderkey""",
    "pixels": """
  SELECT cadence, CAST(floor(pos / 8) AS INT) AS row_, CAST(pos % 8 AS INT) AS col_, flux
  FROM (SELECT vec_id AS cadence, unnest(range(64)) AS pos,
          CAST(unnest(embedding) AS DOUBLE) AS flux FROM embeddings)""",
    "planted": """
  SELECT tic_id AS cand_id, tic_id, 3.0D + 0.7D * tic_id AS period, 1.075D AS t0,
    0.15D AS duration, 0.01D AS depth
  FROM (SELECT DISTINCT tic_id FROM lc)""",
    "cands": """
  SELECT * FROM planted UNION ALL
  SELECT cand_id, tic_id, period, t0, duration, depth FROM signals
  WHERE tic_id IN (SELECT tic_id FROM planted)""",
    "dumps": """
  SELECT tic_id, avg(t) AS t FROM (
    SELECT tic_id, sector, t, sum(CASE WHEN prev IS NULL OR t - prev > 0.1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY tic_id, sector ORDER BY t ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT tic_id, sector, t, lag(t) OVER (PARTITION BY tic_id, sector ORDER BY t) AS prev
          FROM cadences WHERE (quality & 32) <> 0))
  GROUP BY tic_id, sector, run""",
}
_NEEDS = {
    "lc": ["cadences"],
    "planted": ["lc"],
    "cands": ["planted", "signals"],
    "dumps": ["cadences"],
}


def with_views(names: str, body: str, **extra: str) -> str:
    """``body`` preceded by the named views (and what they need) and the ``extra`` steps.

    Doubles are written 0.5D and turned into casts at the end.
    """
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    steps = [f"{n} AS ({SQL_VIEWS[n]})" for n in order]
    steps += [f"{n} AS ({q})" for n, q in extra.items()]
    text = ("WITH " + ",\n".join(steps) + "\n" if steps else "") + body
    return re.sub(r"(?<![\w.])(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"\1::DOUBLE", text)
