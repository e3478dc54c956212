"""Light-use scoring of a forcing table, as column expressions in a few stages.

Each stage only refers to plain columns, so Spark generates code without repeating subexpressions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflux import DATE, SITE
from siteflux.functions.atmosphere import BASE_TEMPERATURE_SCORING, STANDARD_PRESSURE, air_pressure
from siteflux.operators.groups import with_stats

# Fixed values of the scoring model.
KPHIO = 0.0579
BETA = 146.0
JMAX_COST = 0.41
CARBON = 12.0107
RD_TO_VCMAX = 0.015
MAX_ALPHA = 1.26
GAS_R = 8.3145
OXYGEN = 0.209476  # mol per mol
KC25, KC_ENERGY = 39.97, 79430.0
KO25, KO_ENERGY = 2.748e4, 36380.0
GSTAR25, GSTAR_ENERGY = 4.220, 37830.0
VCMAX_ENERGY = 65330.0
# nitrogen per carboxylation: weight * concentration / (turnover * sites)
NITROGEN = 5.5e5 * 1.14e-2 / (2.33 * 8.0)
NITROGEN_AREA = 5.5e5 * 1.14e-2 * 14.0067 / (3.5 * 8.0)
EXTINCTION = 0.5
WANG_HAN = (4.644, 0.0545, 0.5, 8.15e-5)

# Density of water (Fisher & Dial 1975), ascending powers of temperature.
DENSITY_LAMBDA = (1788.316, 21.55053, -0.4695911, 3.096363e-3, -7.341182e-6)
DENSITY_P0 = (5918.499, 58.05267, -1.1253317, 6.6123869e-3, -1.4661625e-5)
DENSITY_VINF = (
    0.6980547, -7.435626e-4, 3.704258e-5, -6.315724e-7, 9.829576e-9, -1.197269e-10, 1.005461e-12, -5.437898e-15,
    1.69946e-17, -2.295063e-20,
)
# Viscosity of water (Huber et al. 2009). Rows are powers of density, columns of temperature.
VISCOSITY_T, VISCOSITY_RHO, VISCOSITY_MU = 647.096, 322.0, 1e-6
VISCOSITY_MU0 = (1.67752, 2.20462, 0.6366564, -0.241605)
VISCOSITY_H = (
    (0.520094, 0.0850895, -1.08374, -0.289555, 0.0, 0.0),
    (0.222531, 0.999115, 1.88797, 1.26613, 0.0, 0.120573),
    (-0.281378, -0.906851, -0.772479, -0.489837, -0.257040, 0.0),
    (0.161913, 0.257399, 0.0, 0.0, 0.0, 0.0),
    (-0.0325372, 0.0, 0.0, 0.0698452, 0.0, 0.0),
    (0.0, 0.0, 0.0, 0.0, 0.00872102, 0.0),
    (0.0, 0.0, 0.0, -0.00435673, 0.0, -0.000593264),
)

OUTPUTS = (
    "ca", "gstar", "kmm", "ns_star", "chi", "m", "mprime", "lue", "gpp", "ci", "gs", "vcmax", "vcmax_unitfapar",
    "vcmax_unitiabs", "factor25_vcmax", "vcmax25", "vcmax25_unitfapar", "vcmax25_unitiabs", "rd", "rd_unitfapar",
    "rd_unitiabs", "actnv", "actnv_unitfapar", "actnv_unitiabs", "transp", "transp_unitfapar", "transp_unitiabs",
)
METHODS = ("approx", "simpl", "full")


def _poly(coefficients, x):
    """Horner form without the zero terms; works on numbers and on columns."""
    terms = list(coefficients)
    while _is_zero(terms[-1]):
        terms.pop()
    return reduce(lambda acc, c: acc * x if _is_zero(c) else acc * x + c, reversed(terms[:-1]), terms[-1])


def _is_zero(c) -> bool:
    return isinstance(c, float) and c == 0.0


def _density(tc, pressure):
    return 1e3 / (_poly(DENSITY_VINF, tc) + _poly(DENSITY_LAMBDA, tc) / (_poly(DENSITY_P0, tc) + pressure * 1e-5))


def _viscosity(inv, warm, excess, sqrt, exp):
    """Viscosity from the inverse reduced temperature, that minus 1, and the reduced density minus 1."""
    mu0 = 100.0 / (sqrt(inv) * _poly(VISCOSITY_MU0, inv))
    by_temperature = [_poly([row[i] for row in VISCOSITY_H], excess) for i in range(6)]
    return mu0 * exp((excess + 1.0) * _poly(by_temperature, warm)) * VISCOSITY_MU


def reference_viscosity(tc: float = 25.0, pressure: float = STANDARD_PRESSURE) -> float:
    inv = VISCOSITY_T / (tc + 273.15)
    return _viscosity(inv, inv - 1.0, _density(tc, pressure) / VISCOSITY_RHO - 1.0, math.sqrt, math.exp)


def score_light_use(
    df: DataFrame,
    method: str = "full",
    kphio: Column | float = KPHIO,
    beta: Column | float = BETA,
    tc: str = "temp",
    fapar: str = "fapar",
    ppfd: str = "ppfd",
    vpd: str = "vpd",
    co2: str = "co2",
    elv: str = "elv",
    cpalpha: str | None = None,
) -> DataFrame:
    """Add the scoring columns (``OUTPUTS``) to a table of daily or cell forcing.

    ``vpd`` in Pa, ``elv`` in m, ``co2`` in ppm. Without ``cpalpha`` the moisture index is 1. ``approx`` has
    no carboxylation columns (null). A score that is not a real number is null. A column of the input that is called
    like an output is an error: rename it.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if clash := [c for c in df.columns if c in OUTPUTS]:
        raise ValueError(f"columns of the input are called like outputs: {clash}")
    kphio = F.lit(kphio) if isinstance(kphio, float) else kphio
    beta = F.lit(beta) if isinstance(beta, float) else beta
    t, d = F.col(tc), F.col(vpd)
    alpha = F.col(cpalpha) if cpalpha else F.lit(1.0)
    # All stages of a row end up in one generated method, and the JVM compiles only methods of limited size:
    # shared pieces are columns of their own, and constants are folded here.
    out = df.withColumns(
        {
            "_kelvin": t + 273.15,
            "_fa": F.pow(alpha / MAX_ALPHA, F.lit(0.25)),
            "_patm": air_pressure(F.col(elv), BASE_TEMPERATURE_SCORING),
            "_root_d": F.when(d >= 0, F.sqrt(d)),
            "_iabs": F.col(fapar) * F.col(ppfd),
            "_kphio": kphio,
            "_beta": beta,
        }
    )
    # exp(energy * _heat) is the temperature response relative to 25 degrees
    out = out.withColumns(
        {
            "_heat": F.try_divide((t - 25.0) * (1.0 / (298.15 * GAS_R)), F.col("_kelvin")),
            "_inv": F.try_divide(F.lit(VISCOSITY_T), F.col("_kelvin")),
        }
    )

    def response(energy: float) -> Column:
        return F.exp(F.col("_heat") * energy)

    out = out.withColumns(
        {
            "gstar": response(GSTAR_ENERGY) * GSTAR25,
            "factor25_vcmax": response(-VCMAX_ENERGY),
            "ca": F.col(co2) * F.col("_patm") * 1e-6,
            "kmm": response(KC_ENERGY) * (F.col("_patm") * response(-KO_ENERGY) * (KC25 * OXYGEN / KO25) + KC25),
            "_excess": _density(t, F.col("_patm")) * (1.0 / VISCOSITY_RHO) - 1.0,
            "_warm": F.col("_inv") - 1.0,
        }
    )
    scale = 1.0 / reference_viscosity()
    ns_star = _viscosity(F.col("_inv"), F.col("_warm"), F.col("_excess"), F.sqrt, F.exp) * scale
    out = out.withColumn("ns_star", ns_star)
    out = _chi_m_n(out, method, t, d, F.col(elv))

    m = F.col("m")
    squared = m * m - JMAX_COST ** (2.0 / 3.0) * F.pow(m, F.lit(4.0 / 3.0))
    out = out.withColumn("_mp", F.when(m >= 0, squared))
    out = out.withColumn("mprime", F.when(F.col("_mp") > 0, F.sqrt("_mp")).otherwise(F.col("_mp")))
    iabs, light = F.col("_iabs"), F.col(ppfd)
    out = out.withColumns(
        {
            "_kf": F.col("_kphio") * F.col("_fa"),
            "ci": F.col("chi") * F.col("ca"),
            "vcmax_unitiabs": F.col("_kphio") * F.col("_n"),
        }
    )
    # per unit of absorbed light first; the other forms are multiples of light
    out = out.withColumns(
        {
            "lue": F.col("_kf") * F.col("mprime"),
            "_drop": F.col("ca") - F.col("ci"),
            "vcmax25_unitiabs": F.col("factor25_vcmax") * F.col("vcmax_unitiabs"),
            "rd_unitiabs": F.col("vcmax_unitiabs") * RD_TO_VCMAX,
        }
    )
    out = out.withColumns(
        {
            "gpp": iabs * F.col("lue") * CARBON,
            "actnv_unitiabs": F.col("vcmax25_unitiabs") * NITROGEN,
            "transp_unitiabs": F.try_divide(F.col("_kf") * m * d * 1.6, F.col("_drop")),
        }
    )
    names = ("vcmax", "vcmax25", "rd", "actnv", "transp")
    out = out.withColumns(
        {
            "gs": F.try_divide(F.col("gpp"), F.col("_drop")),
            **{n: iabs * F.col(f"{n}_unitiabs") for n in names},
            **{f"{n}_unitfapar": light * F.col(f"{n}_unitiabs") for n in names},
        }
    )
    return out.select(*df.columns, *OUTPUTS)


def _chi_m_n(out: DataFrame, method: str, t: Column, d: Column, elv: Column) -> DataFrame:
    gamma = F.try_divide(F.col("gstar"), F.col("ca"))
    root, beta, visc = F.col("_root_d"), F.col("_beta"), F.col("ns_star")
    if method == "approx":
        a, b, c, e = WANG_HAN
        odds = F.exp((t - 25.0) * b + a - F.ln(d) * c - elv * e)
        out = out.withColumns({"_gamma": gamma, "_odds": odds})
        out = out.withColumn("chi", F.col("_odds") / (F.col("_odds") + 1.0))
        m = F.try_divide(F.col("chi") - F.col("_gamma"), F.col("chi") + F.col("_gamma") * 2.0)
        return out.withColumns({"m": m, "_n": F.lit(None).cast("double")})
    cost = F.col("kmm") + F.col("gstar") if method == "full" else F.col("kmm")
    out = out.withColumns({"_gamma": gamma, "_kappa": F.try_divide(F.col("kmm"), F.col("ca")), "_bk": beta * cost})
    # a cost that is not positive has no solution
    positive = F.when(F.col("_bk") > 0, F.col("_bk"))
    out = out.withColumn("_xi", F.sqrt(F.try_divide(positive * (1.0 / 1.6), visc)))
    x, g, ca, gstar = F.col("_xi"), F.col("_gamma"), F.col("ca"), F.col("gstar")
    ratio = F.try_divide(x, x + root)
    if method == "simpl":
        chi = ratio
        m = F.try_divide(x * (ca - gstar) - gstar * root, x * (ca + gstar * 2.0) + gstar * root * 2.0)
    else:
        chi = g + (1.0 - g) * ratio
        # sqrt(1.6 * viscosity * vpd / (beta * cost)) is root / xi
        m = F.try_divide(ca - gstar, ca + gstar * 2.0 + gstar * 3.0 * F.try_divide(root, x))
    out = out.withColumns({"chi": chi, "m": m})
    n = F.try_divide(F.col("chi") + F.col("_kappa"), F.col("chi") + F.col("_gamma") * 2.0)
    return out.withColumn("_n", n)


def light_use_forcing(daily: DataFrame, sites: DataFrame, co2: DataFrame) -> DataFrame:
    """Daily forcing with each site's elevation and each year's CO2 (``year, co2``).

    The days are never dealt by year, of which there are few: the table of CO2 has a row a year and is broadcast.
    """
    out = daily.join(sites.select(SITE, "elv"), SITE, "left")
    return out.withColumn("year", F.year(DATE)).join(F.broadcast(co2.select("year", "co2")), "year", "left")


def annual_scores(scored: DataFrame, cols: list[str], key: str = SITE) -> DataFrame:
    """Scores rolled up by site-year (or cell-year): sums of the named columns."""
    return scored.groupBy(key, F.year(DATE).alias("year")).agg(
        *[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n")
    )


def fapar_of_lai(lai: Column) -> Column:
    return 1.0 - F.exp(lai * -EXTINCTION)


def scale_leaf_columns(
    df: DataFrame, lai: str = "lai", dppfd: str = "dppfd", mean_ppfd: str = "mean_ppfd", fapar: str = "fapar",
    period: list[str] | None = None,
) -> DataFrame:
    """Daily canopy columns from scored unit columns, leaf area and light.

    ``dppfd`` is mol photons per day, ``mean_ppfd`` the period mean per second. Leaves hold the nitrogen that the
    period's strongest demand asks for: ``leaf_n`` follows the maximum over ``period`` (default: the site's year).
    """
    cover, area = F.col("_cover"), F.col(lai)
    out = df.withColumn("_cover", fapar_of_lai(area))
    if period is None:
        out = out.withColumn("_year", F.year(DATE))
    out = with_stats(out, period or [SITE, "_year"], _peak=F.max(F.col(mean_ppfd) * F.col("actnv_unitiabs")))
    return out.withColumns(
        {
            "dgpp": F.col(fapar) * F.col(dppfd) * F.col("lue"),
            "drd": cover * F.col(mean_ppfd) * F.col("rd_unitiabs") * 86400.0,
            "dtransp": cover * F.col(dppfd) * F.col("transp_unitiabs"),
            "leaf_vcmax": F.try_divide(cover * F.col(mean_ppfd) * F.col("vcmax_unitiabs"), area),
            "leaf_n": F.try_divide(cover * F.col("_peak"), area),
            "n_rubisco_area": F.col("vcmax25") * NITROGEN_AREA,
        }
    ).drop("_cover", "_year", "_peak")
