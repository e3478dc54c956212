"""Air pressure and vapour pressure deficit, evaluated per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteflux.functions.nulls import strict_greatest

# Fixed values (Allen et al. 1998; Tsilingiris 2008).
STANDARD_PRESSURE = 101325.0  # Pa
LAPSE_RATE = 0.0065  # K m-1
GRAVITY = 9.80665  # m s-2
GAS_CONSTANT = 8.3143  # J mol-1 K-1
DRY_AIR_MASS = 0.028963  # kg mol-1
BASE_TEMPERATURE = 288.15  # K, inputs
BASE_TEMPERATURE_SCORING = 298.15  # K, light-use scoring
VAPOUR_MASS_G = 18.02  # g mol-1
DRY_AIR_MASS_G = 28.963  # g mol-1


def air_pressure(elv: Column, t0: float = BASE_TEMPERATURE) -> Column:
    """Pressure (Pa) at elevation ``elv`` (m)."""
    exponent = GRAVITY * DRY_AIR_MASS / (GAS_CONSTANT * LAPSE_RATE)
    return F.lit(STANDARD_PRESSURE) * F.pow(1.0 - elv * (LAPSE_RATE / t0), F.lit(exponent))


def saturation_pressure(tc: Column) -> Column:
    """Saturation vapour pressure (Pa) at ``tc`` degrees Celsius."""
    return F.exp(tc * 17.27 / (tc + 237.3)) * 611.0


def vapour_pressure(qair: Column, patm: Column) -> Column:
    """Vapour pressure (Pa) from specific humidity (g per g) and air pressure (Pa)."""
    ratio = qair / (1.0 - qair)
    rv = GAS_CONSTANT / VAPOUR_MASS_G
    rd = GAS_CONSTANT / DRY_AIR_MASS_G
    return patm * ratio * rv / (ratio * rv + rd)


def vpd(
    tc: Column,
    eact: Column | None = None,
    qair: Column | None = None,
    elv: Column | None = None,
    tmin: Column | None = None,
    tmax: Column | None = None,
) -> Column:
    """Vapour pressure deficit (Pa), at least 0.

    Give the actual vapour pressure ``eact`` (Pa), or ``qair`` and ``elv``; where ``eact`` is given but
    null, the other two fill in. ``tmin`` and ``tmax``, where both known, replace ``tc`` by their mean.
    """
    if tmin is not None and tmax is not None:
        tc = F.coalesce((tmin + tmax) * 0.5, tc)
    if qair is not None and elv is not None:
        derived = vapour_pressure(qair, air_pressure(elv))
        eact = derived if eact is None else F.coalesce(eact, derived)
    if eact is None:
        raise ValueError("give eact, or qair and elv")
    return strict_greatest(saturation_pressure(tc) - eact, F.lit(0.0))


def vpd_monthly(tc: Column, vap: Column, tmin: Column | None = None, tmax: Column | None = None) -> Column:
    """Monthly variant: vapour pressure in hPa, result in Pa, no floor."""
    if tmin is not None and tmax is not None:
        tc = F.coalesce((tmin + tmax) * 0.5, tc)
    return saturation_pressure(tc) - vap * 100.0
