"""Catalog and result tables in and out: row mappers, target lists, reports, batch tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BTJD_OFFSET, RHO_SUN
from ..functions.expr import btjd_from_any, finite, parse_tic_id, symmetric_error, to_float

RHO_SUN_CGS = RHO_SUN / 1000.0
STELLAR = ("radius", "mass", "teff", "logg", "density")


def cell(df: DataFrame, name: str) -> Column:
    """A column of an outside table, or NULL where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


# ---- target lists
def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets from a headed CSV, or one id per line with # comments."""
    lines = spark.read.text(path)
    head = lines.where("trim(value) <> ''").limit(1).collect()
    if not head or not head[0][0].lstrip().startswith("tic_id"):
        ids = lines.select(parse_tic_id(F.split("value", "#")[0]).alias("tic_id"))
        empty = [F.lit(None).cast("double").alias(c) for c in ("tmag", "teff", "radius")]
        return ids.where("tic_id IS NOT NULL AND tic_id <> 0").select(
            "tic_id", *empty, F.array().cast("array<int>").alias("sectors")
        )
    rows = spark.read.csv(path, header=True)
    words = F.filter(F.split(F.coalesce(cell(rows, "sectors"), F.lit("")), " +"), lambda w: w != "")
    return rows.select(
        F.col("tic_id").cast("long").alias("tic_id"),
        *[to_float(cell(rows, c)).alias(c) for c in ("tmag", "teff", "radius")],
        words.cast("array<int>").alias("sectors"),
    )


def write_targets(targets: DataFrame, path: str) -> None:
    flat = targets.withColumn("sectors", F.concat_ws(" ", F.col("sectors").cast("array<string>")))
    flat.select("tic_id", "tmag", "teff", "radius", "sectors").write.mode("overwrite").csv(
        path, header=True
    )


# ---- row mappers
def map_tic_rows(rows: DataFrame) -> DataFrame:
    """Catalog rows as stellar parameters (solar units); absent columns are NULL."""
    # The catalog's column names.
    names = {
        "radius": "rad", "radius_err": "e_rad", "mass": "mass", "mass_err": "e_mass",
        "teff": "Teff", "teff_err": "e_Teff", "logg": "logg", "logg_err": "e_logg",
        "density": "rho", "density_err": "e_rho", "tmag": "Tmag",
    }
    return rows.select(
        parse_tic_id(cell(rows, "ID")).alias("tic_id"),
        *[to_float(cell(rows, src)).alias(dst) for dst, src in names.items()],
        F.lit("TIC").alias("source"),
    )


def header_fallback(headers: DataFrame) -> DataFrame:
    """First finite value of each stellar key over a target's sector headers, in sector order."""
    names = {"TEFF": "teff", "LOGG": "logg", "MH": "mh", "RADIUS": "radius", "TESSMAG": "tmag",
             "RA_OBJ": "ra", "DEC_OBJ": "dec"}
    aggs = []
    for src, dst in names.items():
        value = to_float(cell(headers, src))
        aggs.append(F.min_by(value, F.when(value.isNotNull(), F.col("sector"))).alias(dst))
    return headers.groupBy("tic_id").agg(*aggs)


def stellar_parameters(catalog: DataFrame, headers: DataFrame) -> DataFrame:
    """Catalog parameters where the star is in the catalog, else the headers'."""
    own = catalog.withColumn("_has", F.lit(True))
    both = headers.select("tic_id", *[F.col(c).alias(f"_{c}") for c in ("radius", "teff", "logg", "tmag")])
    rows = own.join(both, "tic_id", "full")
    mixed = [
        F.when(F.col("_has"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
        for c in ("radius", "teff", "logg", "tmag")
    ]
    kept = [c for c in catalog.columns if c not in ("tic_id", "source", "radius", "teff", "logg", "tmag")]
    source = F.when(F.col("_has"), F.col("source")).otherwise(F.lit("light-curve header"))
    return rows.select("tic_id", *mixed, *kept, source.alias("source"))


def map_planet_rows(rows: DataFrame) -> DataFrame:
    """Archive planets: percent to ppm, full dates to BTJD, g/cm^3 to solar, errors averaged."""
    def value(name: str) -> Column:
        return to_float(cell(rows, name))

    def error(name: str) -> Column:
        return symmetric_error(cell(rows, f"{name}err1"), cell(rows, f"{name}err2"))

    stellar = F.struct(
        value("st_rad").alias("radius"), error("st_rad").alias("radius_err"),
        value("st_mass").alias("mass"), error("st_mass").alias("mass_err"),
        value("st_teff").alias("teff"), error("st_teff").alias("teff_err"),
        value("st_logg").alias("logg"), error("st_logg").alias("logg_err"),
        (value("st_dens") / RHO_SUN_CGS).alias("density"),
        (error("st_dens") / RHO_SUN_CGS).alias("density_err"), value("sy_tmag").alias("tmag"),
    )
    return rows.select(
        cell(rows, "pl_name").alias("name"), cell(rows, "hostname").alias("host"),
        parse_tic_id(cell(rows, "tic_id")).alias("tic_id"),
        value("pl_orbper").alias("period"), error("pl_orbper").alias("period_err"),
        (value("pl_tranmid") - BTJD_OFFSET).alias("t0"),
        (value("pl_trandep") * 1e4).alias("depth_ppm"),
        value("pl_trandur").alias("duration_hours"),
        value("pl_ratror").alias("rp_rs"), error("pl_ratror").alias("rp_rs_err"),
        value("pl_rade").alias("rp_earth"), error("pl_rade").alias("rp_earth_err"),
        value("pl_ratdor").alias("a_rs"), value("pl_imppar").alias("impact"),
        stellar.alias("stellar"),
    )


def transiting_planets(rows: DataFrame, tic_ids: DataFrame) -> DataFrame:
    """Archive rows of transiting planets of the given targets, mapped."""
    flagged = rows.where(to_float(cell(rows, "tran_flag")) == 1)
    return map_planet_rows(flagged).join(tic_ids.select("tic_id"), "tic_id", "left_semi")


def map_toi_rows(rows: DataFrame) -> DataFrame:
    """Objects of interest: trimmed disposition, id from ``tid`` or ``tic_id``, BTJD."""
    def value(name: str) -> Column:
        return to_float(cell(rows, name))

    tid, tic = parse_tic_id(cell(rows, "tid")), parse_tic_id(cell(rows, "tic_id"))
    found = F.coalesce(F.when(tid != 0, tid), F.when(tic != 0, tic), F.lit(0))
    return rows.select(
        value("toi").alias("toi"), F.format_string("TOI-%.2f", value("toi")).alias("name"),
        found.alias("tic_id"), F.trim(cell(rows, "tfopwg_disp")).alias("disposition"),
        value("pl_orbper").alias("period"), (value("pl_tranmid") - BTJD_OFFSET).alias("t0"),
        value("pl_trandurh").alias("duration_hours"), value("pl_trandep").alias("depth_ppm"),
        value("pl_rade").alias("rp_earth"), value("st_tmag").alias("tmag"),
        value("st_teff").alias("teff"), value("st_logg").alias("logg"), value("st_rad").alias("radius"),
    )


def map_ctoi_rows(rows: DataFrame) -> DataFrame:
    """Community objects: promoted ones named as such, official disposition before the user's."""
    def text(name: str) -> Column:
        return F.trim(F.coalesce(cell(rows, name), F.lit("")))

    promoted = text("Promoted to TOI")
    name = F.concat(F.lit("CTOI "), text("CTOI"))
    named = F.when(
        promoted.isin("", "0", "0.0"), name
    ).otherwise(F.concat(name, F.lit(" (TOI-"), promoted, F.lit(")")))
    official = F.coalesce(cell(rows, "TFOPWG Disposition"), F.lit(""))
    out = rows.select(
        F.lit("CTOI").alias("kind"), named.alias("name"), parse_tic_id(cell(rows, "TIC ID")).alias("tic_id"),
        to_float(cell(rows, "Period (days)")).alias("period"),
        btjd_from_any(cell(rows, "Transit Epoch (BJD)")).alias("t0"),
        F.trim(F.when(official != "", official).otherwise(text("User Disposition"))).alias("disposition"),
    )
    return out.where("tic_id IS NOT NULL AND tic_id <> 0")


def read_ctois(spark: SparkSession, path: str) -> DataFrame:
    return map_ctoi_rows(spark.read.csv(path, header=True, escape='"'))


# ---- known objects
KINDS = ("planet", "TOI", "CTOI")


def known_catalog(planets: DataFrame, tois: DataFrame, ctois: DataFrame) -> DataFrame:
    """One table of known objects: ord (list order), kind, name, tic_id, period, t0, disposition."""
    columns = ["kind", "name", "tic_id", "period", "t0", "disposition"]
    parts = [
        planets.withColumns({"kind": F.lit("planet"), "disposition": F.lit("")}),
        tois.withColumn("kind", F.lit("TOI")),
        ctois,
    ]
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    out = out.where("tic_id IS NOT NULL AND tic_id <> 0")
    return out.withColumn("ord", F.struct(rank.alias("kind"), "name"))


def catalog_hosts(known: DataFrame, kinds: Sequence[str] = ("planet", "TOI")) -> DataFrame:
    return known.where(F.col("kind").isin(*kinds)).select("tic_id").distinct()


def missing_catalogs(sources: DataFrame, max_age_days: float = 7.0, now: Column | None = None) -> DataFrame:
    """Kinds to load again: absent, failed or stale (sources: kind, loaded_at, error)."""
    now = F.current_timestamp() if now is None else now
    wanted = sources.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind")
    )
    latest = sources.groupBy("kind").agg(
        F.max(F.when(F.col("error").isNull(), F.col("loaded_at"))).alias("loaded_at")
    )
    age = F.unix_micros(now) - F.unix_micros(F.col("loaded_at"))
    fresh = age <= F.lit(int(max_age_days * 86_400_000_000))
    out = wanted.join(latest, "kind", "left")
    return out.where(~F.coalesce(fresh, F.lit(False))).select("kind", "loaded_at")


# ---- reports and result tables
def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """Nested reports as strict JSON: no NaN or infinity survives."""
    strict(reports).write.mode(mode).option("ignoreNullFields", "false").json(path)


def strict(df: DataFrame) -> DataFrame:
    """Every double at any depth that is not finite, as NULL."""
    return df.select(*[_strict(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _strict(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(finite(c), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _strict(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_strict(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), fields)
    return c


def read_reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reports, one JSON document per line, with ``unreadable`` set on those cut short."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = spark.read.text(path).where("trim(value) <> ''")
    parsed = rows.select(F.from_json("value", wide, options).alias("r")).select("r.*")
    return parsed.withColumn("unreadable", F.col("_corrupt").isNotNull()).drop("_corrupt")


def star_rows(statuses: DataFrame, reports: DataFrame) -> DataFrame:
    """Each target's outcome with its report's headline numbers.

    A target recorded as searched whose report is missing or cut short is 'unreadable'.
    """
    good = reports.where("NOT unreadable")
    top = F.get("search.signals", F.lit(0))
    facts = good.select(
        "tic_id", F.lit(True).alias("_has"),
        F.concat_ws(" ", F.col("target.sectors").cast("array<string>")).alias("sectors"),
        F.col("target.n_points").alias("n_points"),
        F.get(F.filter("noise.cdpp", lambda c: c["hours"] == 1.0), F.lit(0))["cdpp_ppm"].alias("cdpp_1h_ppm"),
        top["period"].alias("top_period"), top["snr"].alias("top_snr"), top["sde"].alias("top_sde"),
        F.col("search.n_detections").alias("n_detections"), F.col("search.n_candidates").alias("n_candidates"),
    )
    out = statuses.join(facts, "tic_id", "left")
    lost = (F.col("status") == "searched") & F.col("_has").isNull()
    return out.withColumns(
        {
            "status": F.when(lost, "unreadable").otherwise(F.col("status")),
            "message": F.when(lost, "report is missing or cut short").otherwise(F.col("message")),
        }
    ).drop("_has")


def candidate_entries(reports: DataFrame) -> DataFrame:
    """One row per candidate of every readable report, numbered within its target."""
    rows = reports.where("NOT unreadable").select(
        "tic_id", F.posexplode(F.filter("planets", lambda p: p["role"] == "candidate")).alias("pos", "entry")
    )
    return rows.select("tic_id", (F.col("pos") + 1).alias("n"), "entry.*")


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "bool": T.BooleanType(), "text": T.StringType()}
_RESULT_KINDS = {
    "index": "long", "period_bin": "int", "radius_bin": "int", "recovered": "bool", "match": "text",
    "n_transits_in_data": "int", "n_detections": "int",
}
#: Columns of an injection-recovery table; those without a kind are doubles.
RESULTS = T.StructType([
    T.StructField(name, _KINDS.get(_RESULT_KINDS.get(name, ""), T.DoubleType()))
    for name in (
        "index", "period_bin", "radius_bin", "period", "radius_earth", "t0", "b", "rp_rs", "a_rs",
        "duration", "recovered", "match", "n_transits_in_data", "found_period", "found_sde",
        "found_snr", "n_detections",
    )
])


def append_results(rows: DataFrame, path: str) -> None:
    rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in RESULTS.fields]).write.mode(
        "append"
    ).csv(path, header=True)


def read_results(spark: SparkSession, path: str, schema: T.StructType = RESULTS) -> DataFrame:
    """Typed results; 'nan' and empty cells are NULL."""
    rows = spark.read.schema(schema).csv(path, header=True, nanValue="nan")
    return strict(rows)
