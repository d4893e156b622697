"""Scalar building blocks as Column expressions: folding, orbit geometry, parsing, sky."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AU, BTJD_OFFSET, DAY, G, LOGG_SUN, M_SUN, R_EARTH, R_JUP, R_SUN, RHO_SUN

PI = math.pi


# ---- folding
def mod_floor(x: Column, p: Column | float) -> Column:
    """x modulo p in [0, p), also for negative x."""
    return x - p * F.floor(x / p)


def fold(t: Column, period: Column, t0: Column) -> Column:
    """Time from the nearest mid-dip, in [-P/2, P/2)."""
    return mod_floor(t - t0 + 0.5 * period, period) - 0.5 * period


def in_transit(t: Column, period: Column, t0: Column, width: Column) -> Column:
    """Within ``width``/2 of a mid-dip."""
    return F.abs(fold(t, period, t0)) < 0.5 * width


def epoch_index(t: Column, period: Column, t0: Column) -> Column:
    """Number of the nearest cycle; ties go to the even number."""
    return F.rint((t - t0) / period).cast("long")


def finite(*cols: Column) -> Column:
    """True when every value is a finite number (NULL and NaN are not)."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(out, F.lit(False))


def null_if_not_finite(c: Column) -> Column:
    return F.when(finite(c), c)


# ---- orbit geometry (circular orbits; durations in days)
def inclination_deg(a_rs: Column, b: Column) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(b / a_rs, F.lit(-1.0)), F.lit(1.0))))


def _contact_duration(period: Column, a_rs: Column, reach: Column, b: Column) -> Column:
    """Time the centers are closer than ``reach`` stellar radii; 0 when they never are."""
    sin_i = F.sqrt(F.greatest(1.0 - (b / a_rs) * (b / a_rs), F.lit(0.0)))
    chord = reach * reach - b * b
    inside = period / PI * F.asin(F.least(F.sqrt(chord) / (a_rs * sin_i), F.lit(1.0)))
    return F.when((chord <= 0) | (sin_i == 0), F.lit(0.0)).otherwise(inside)


def t14(period: Column, a_rs: Column, k: Column, b: Column) -> Column:
    """Total duration."""
    return _contact_duration(period, a_rs, 1.0 + k, b)


def t23(period: Column, a_rs: Column, k: Column, b: Column) -> Column:
    """Duration of the flat part."""
    return _contact_duration(period, a_rs, 1.0 - k, b)


def cube_root(x: Column) -> Column:
    return F.pow(x, F.lit(1.0 / 3.0))


def stellar_density(period: Column, a_rs: Column) -> Column:
    """kg/m^3 implied by the scaled orbit."""
    return 3.0 * PI * F.pow(a_rs, F.lit(3.0)) / (G * F.pow(period * DAY, F.lit(2.0)))


def a_rs_from_density(period: Column, rho: Column) -> Column:
    return cube_root(G * rho * F.pow(period * DAY, F.lit(2.0)) / (3.0 * PI))


def a_rs_from_mass_radius(period: Column, mass: Column, radius: Column) -> Column:
    a = cube_root(G * mass * M_SUN * F.pow(period * DAY, F.lit(2.0)) / (4.0 * PI * PI))
    return a / (radius * R_SUN)


def central_duration(period: Column, rho_solar: Column | float) -> Column:
    """Duration of a central dip of a small body around a star of this density."""
    rho = F.lit(rho_solar) if isinstance(rho_solar, float) else rho_solar
    a_rs = a_rs_from_density(period, rho * RHO_SUN)
    return period / PI * F.asin(F.least(F.greatest(1.0 / a_rs, F.lit(0.0)), F.lit(1.0)))


def q_to_u(q1: Column, q2: Column) -> tuple[Column, Column]:
    root = F.sqrt(q1)
    return 2.0 * root * q2, root * (1.0 - 2.0 * q2)


def u_to_q(u1: Column, u2: Column) -> tuple[Column, Column]:
    total = u1 + u2
    dark = total > 0
    return (
        F.when(dark, total * total).otherwise(0.0),
        F.when(dark, u1 / (2.0 * total)).otherwise(0.5),
    )


def catalog_density(c: dict[str, Column]) -> tuple[Column, Column]:
    """Mean density in solar units and its error: catalog value, else M/R^3, else g/R.

    ``c`` maps radius, mass, logg, density and their ``_err`` to columns.
    """
    ok = {name: finite(col) for name, col in c.items()}
    from_mass = c["mass"] / F.pow(c["radius"], F.lit(3.0))
    rel_mass = F.hypot(c["mass_err"] / c["mass"], 3.0 * c["radius_err"] / c["radius"])
    from_logg = F.pow(F.lit(10.0), c["logg"] - LOGG_SUN) / c["radius"]
    rel_logg = F.hypot(math.log(10.0) * c["logg_err"], c["radius_err"] / c["radius"])
    use_mass = ok["mass"] & ok["radius"]
    use_logg = ok["logg"] & ok["radius"]
    rho = (
        F.when(ok["density"], c["density"]).when(use_mass, from_mass).when(use_logg, from_logg)
    )
    err = (
        F.when(ok["density"], F.when(ok["density_err"], c["density_err"]))
        .when(use_mass, F.when(ok["mass_err"] & ok["radius_err"], from_mass * rel_mass))
        .when(use_logg, F.when(ok["logg_err"] & ok["radius_err"], from_logg * rel_logg))
    )
    return rho, err


# ---- dip shapes
def trapezoid(x: Column, depth: Column, total: Column, ingress_fraction: Column) -> Column:
    """Flux at distance ``x`` from mid-dip; ingress and egress take ``ingress_fraction`` of it."""
    x = F.abs(x)
    half = 0.5 * total
    tau = F.greatest(0.5 * ingress_fraction * total, F.lit(1e-9))
    return (
        F.when(x <= half - tau, 1.0 - depth)
        .when(x < half, 1.0 - depth * (half - x) / tau)
        .otherwise(1.0)
    )


PLANCK_H, LIGHT_C, BOLTZMANN = 6.62607015e-34, 2.99792458e8, 1.380649e-23


def planck_band(temperature: Column) -> Column:
    """Blackbody radiance summed over 400 wavelengths between 600 and 1000 nm."""
    step = 400e-9 / 399

    def radiance(i: Column) -> Column:
        lam = 600e-9 + i * step
        return (2 * PLANCK_H * LIGHT_C**2) / F.pow(lam, F.lit(5.0)) / F.expm1(
            PLANCK_H * LIGHT_C / (lam * BOLTZMANN * temperature)
        )

    return step * F.aggregate(
        F.sequence(F.lit(0), F.lit(399)), F.lit(0.0), lambda acc, i: acc + radiance(i)
    )


def max_planet_occultation(k: Column, a_rs: Column, teff: Column) -> Column:
    """Deepest occultation a planet could cause: albedo-1 reflection plus dayside emission."""
    t_day = teff * F.sqrt(1.0 / a_rs) * (2.0 / 3.0) ** 0.25
    thermal = k * k * planck_band(t_day) / planck_band(teff)
    has_teff = finite(teff) & (teff != 0)
    return (k / a_rs) * (k / a_rs) + F.when(has_teff, thermal).otherwise(0.0)


# ---- sky
def btjd_to_year(t: Column) -> Column:
    return 2000.0 + (t + BTJD_OFFSET - 2451545.0) / 365.25


def propagate(
    ra: Column, dec: Column, pmra: Column, pmdec: Column, year: Column
) -> tuple[Column, Column]:
    """Position at ``year`` of a star catalogued at 2000.0; motions in mas/yr."""
    dt = year - 2000.0
    cos_dec = F.greatest(F.cos(F.radians(dec)), F.lit(1e-6))
    return ra + pmra * dt / 3.6e6 / cos_dec, dec + pmdec * dt / 3.6e6


def sky_offset(ra0: Column, dec0: Column, ra: Column, dec: Column) -> tuple[Column, Column]:
    """(east, north) in arcsec, small-angle."""
    d_ra = mod_floor(ra - ra0 + 180.0, F.lit(360.0)) - 180.0
    return d_ra * F.cos(F.radians(dec0)) * 3600.0, (dec - dec0) * 3600.0


# ---- cells of outside tables
def to_float(c: Column) -> Column:
    """A cell as a finite double, else NULL."""
    value = c.try_cast("double")
    return F.when(finite(value), value)


def symmetric_error(upper: Column, lower: Column) -> Column:
    """Mean size of whichever of the two one-sided errors is given."""
    a, b = F.abs(to_float(upper)), F.abs(to_float(lower))
    return F.coalesce((a + b) / 2.0, a, b)


def parse_tic_id(c: Column) -> Column:
    """'TIC 123', '123' or 123 as a number, else NULL."""
    text = F.trim(F.replace(F.upper(F.trim(c.cast("string"))), F.lit("TIC"), F.lit("")))
    return text.try_cast("double").try_cast("long")


def btjd_from_any(c: Column) -> Column:
    """A time that may be a full Julian date, as BTJD."""
    t = to_float(c)
    return F.when(t > 2_000_000, t - BTJD_OFFSET).otherwise(t)


def parse_sectors(c: Column) -> Column:
    """'1-3,20' as a sorted array of distinct sectors."""
    parts = F.filter(F.split(F.regexp_replace(c, " ", ""), ","), lambda p: p != "")

    def expand(p: Column) -> Column:
        ends = F.split(p, "-")
        lo = ends[0].cast("int")
        return F.sequence(lo, F.coalesce(F.try_element_at(ends, F.lit(2)).cast("int"), lo))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def choose_sectors(sectors: Column, max_sectors: int | None) -> Column:
    """The latest ``max_sectors`` of an array of sectors, in order (all if None)."""
    ordered = F.array_sort(sectors)
    if not max_sectors:
        return ordered
    start = F.greatest(F.size(ordered) - max_sectors + 1, F.lit(1))
    return F.slice(ordered, start, F.lit(max_sectors))


# First sector of each observing year.
YEAR_STARTS = [1, 14, 27, 40, 56, 70, 84, 97, 110]


def year_of(sector: Column) -> Column:
    starts = F.array(*[F.lit(s) for s in YEAR_STARTS])
    return F.size(F.filter(starts, lambda s: s <= sector))


def pct_error(recovered: Column, published: Column) -> Column:
    ok = finite(recovered, published) & (published != 0)
    return F.when(ok, 100.0 * (recovered - published) / published)


def jsonable(c: Column) -> Column:
    """NaN and infinities as NULL, for strict JSON."""
    return null_if_not_finite(c)

