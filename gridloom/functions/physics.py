"""Grid physics and status columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inertia constants in seconds (low, best, high) per fuel.
H_SECONDS: dict[str, tuple[float, float, float]] = {
    "COAL": (4.0, 5.0, 6.0),
    "GAS": (3.0, 4.0, 5.0),
    "NUCLEAR": (5.0, 6.0, 7.0),
    "HYDRO": (5.0, 6.0, 7.0),
    "BIOMASS": (3.0, 4.0, 5.0),
    "STORAGE": (4.0, 5.0, 6.0),
    "WIND": (0.0, 0.3, 0.6),
    "WIND_EMB": (0.0, 0.3, 0.6),
    "SOLAR": (0.0, 0.2, 0.4),
    "IMPORTS": (0.0, 0.5, 1.0),
    "OTHER": (0.5, 1.5, 3.0),
}
# Inertia constants of the replay metrics, seconds.
REPLAY_H: dict[str, float] = {
    "GAS": 5.0,
    "COAL": 6.0,
    "NUCLEAR": 6.0,
    "HYDRO": 3.0,
    "BIOMASS": 2.5,
    "STORAGE": 2.5,
    "OTHER": 2.5,
}
# Replay constants.
DEADBAND = 0.005
TORQUE_NM_PER_MW = 3183.0
TARGET_GVA = 150.0
CO2_T_PER_MWH = 0.38
STABILITY_DEADBAND_MW = 500.0
GAS_MARGIN_PCT = 15.0
# Highest output ever seen per fuel, MW, and the fuel groups.
FUEL_MAX_MW: dict[str, float] = {
    "GAS": 27868.0,
    "COAL": 26044.0,
    "NUCLEAR": 9342.0,
    "WIND": 18382.0,
    "WIND_EMB": 5947.0,
    "SOLAR": 14035.0,
    "HYDRO": 1403.0,
    "BIOMASS": 3393.0,
    "STORAGE": 2660.0,
    "IMPORTS": 9148.0,
    "OTHER": 3187.0,
}
FOSSIL = ("GAS", "COAL", "OTHER")
RENEWABLE = ("WIND", "WIND_EMB", "SOLAR", "HYDRO", "BIOMASS", "STORAGE")
# Labels and their upper limits (exclusive); the last label has none.
EVENT_CLASSES = (
    (500.0, "Balancing / minor fluctuation"),
    (1500.0, "Medium event (possible gen trip or wind block)"),
    (None, "Major event (likely generator or interconnector loss)"),
)
RATE_LABELS = ((0.005, "STABLE"), (0.05, "SHIVERING"), (0.75, "STRESSED"), (None, "LFDD ARMED"))
# Frequency bands in Hz, innermost first (inclusive); outside all of them the last label.
FREQUENCY_BANDS = ((49.95, 50.05, "STABLE"), (49.5, 50.5, "STRESSED"), (49.1, 50.9, "OUTSIDE STAT LIMIT"))
FREQUENCY_OUTSIDE = "LFDD ARMED"
# Flow limit in MW, ideal inertia band in GVA.
FLOW_LIMIT_MW = 500.0
IDEAL_GVA = 10.0


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def power_imbalance(inertia_gvas: Column, rate: Column, f0: float = 50.0) -> Column:
    """MW behind a rate of change, from the swing equation."""
    return inertia_gvas * 1000.0 * 2.0 / f0 * rate


def required_inertia(dp_mw: Column, limit: Column, f0: float = 50.0) -> Column:
    """GVA·s that would hold the rate of change at the limit; null for a limit of 0."""
    return F.try_divide(dp_mw * f0, limit * 2.0) / 1000.0


def _ladder(value: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first step whose upper limit lies above the value."""
    out = F.lit(steps[-1][1])
    for limit, label in reversed(steps[:-1]):
        out = F.when(value < limit, label).otherwise(out)
    return out


def event_class(dp_mw: Column) -> Column:
    return _ladder(dp_mw, EVENT_CLASSES)


def shortfall(extreme: Column, capacity: Column | float, f0: float = 50.0) -> Column:
    """Share of capacity missing (positive) or spare (negative) at an extreme frequency."""
    return (F.lit(f0) - extreme) / f0 * capacity


def floor_zero(column: str | Column) -> Column:
    """Missing and negative become 0."""
    return F.greatest(F.coalesce(_c(column), F.lit(0.0)), F.lit(0.0))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def check_h_table(table: Mapping[str, Sequence[float]]) -> dict[str, tuple[float, float, float]]:
    """The H table with overrides applied; each row must satisfy 0 <= low <= best <= high."""
    merged = dict(H_SECONDS)
    for fuel, values in table.items():
        low, best, high = (float(v) for v in values)
        if not 0 <= low <= best <= high:
            raise ValueError(f"H values of {fuel}: {values}")
        merged[fuel] = (low, best, high)
    return merged


def inertia_estimate(columns: Mapping[str, str], overrides: Mapping[str, Sequence[float]] | None = None) -> dict:
    """Low/best/high inertia in GVA·s from MW per fuel; ``columns`` maps fuel to column."""
    table = check_h_table(overrides or {})
    fuels = {fuel: floor_zero(name) for fuel, name in columns.items()}
    out: dict[str, Column] = {}
    for i, level in enumerate(("low", "best", "high")):
        out[f"inertia_{level}_gvas"] = total([mw * table[f][i] for f, mw in fuels.items()]) / 1000.0
    green = [mw for f, mw in fuels.items() if f in ("WIND", "WIND_EMB", "SOLAR")]
    out["renewables_mw"] = total(green) if green else F.lit(0.0)
    out["modelled_mw"] = total(list(fuels.values()))
    return out


def modelled_share(modelled: Column, generation: Column) -> Column:
    return F.when(generation > 0, modelled / generation)


def against_reported(best: Column, outturn: Column, market: Column, offset_s: Column) -> dict[str, Column]:
    return {
        "best_vs_reported_ratio": F.when(outturn > 0, best / outturn),
        "reported_offset_s": F.abs(offset_s),
        "reported_gap_gvas": outturn - market,
    }


def quiet_rate(rate: Column, deadband: float = DEADBAND) -> Column:
    """Missing rates and rates inside the deadband are 0."""
    rate = F.coalesce(rate, F.lit(0.0))
    return F.when(F.abs(rate) < deadband, 0.0).otherwise(rate)


def rate_label(rate: Column) -> Column:
    size = F.abs(rate)
    return F.when(size.isNull() | F.isnan(size), RATE_LABELS[0][1]).otherwise(_ladder(size, RATE_LABELS))


def frequency_label(f: Column) -> Column:
    out = F.lit(FREQUENCY_OUTSIDE)
    for low, high, label in reversed(FREQUENCY_BANDS):
        out = F.when(f.between(low, high), label).otherwise(out)
    return F.when(f.isNull() | F.isnan(f), "UNKNOWN").otherwise(out)


def flow_label(generation: Column, demand: Column) -> Column:
    delta = F.coalesce(generation, F.lit(0.0)) - F.coalesce(demand, F.lit(0.0))
    return F.when(delta > FLOW_LIMIT_MW, "EXPORTING").when(delta < -FLOW_LIMIT_MW, "IMPORTING").otherwise("BALANCED")


def instant_label(delta: Column) -> Column:
    return (
        F.when(delta.isNull() | F.isnan(delta), "UNKNOWN")
        .when(delta > FLOW_LIMIT_MW, "INSTANT EXPORT")
        .when(delta < -FLOW_LIMIT_MW, "INSTANT IMPORT")
        .otherwise("BALANCED")
    )


def inertia_label(delta_gva: Column) -> Column:
    return (
        F.when(delta_gva.isNull() | F.isnan(delta_gva), "UNKNOWN")
        .when(F.abs(delta_gva) <= IDEAL_GVA, "IDEAL")
        .when(delta_gva < 0, "LIGHT")
        .otherwise("HEAVY")
    )


def replay_metrics(
    f_start: Column,
    f_end: Column,
    rate: Column,
    generation: Column,
    demand: Column,
    fuels: Mapping[str, Column],
    target_gva: float = TARGET_GVA,
) -> dict[str, Column]:
    """The figures shown for one replay frame."""
    frequency = F.coalesce(f_end, f_start, F.lit(50.0))
    calm = quiet_rate(rate)
    gen = F.coalesce(generation, F.lit(0.0))
    need = F.coalesce(demand, gen)
    rpm = frequency * 60.0
    instant = gen * (frequency / 50.0)
    torque = gen * TORQUE_NM_PER_MW
    damp = F.greatest(F.lit(0.2), F.least(F.lit(1.8), 1.0 - calm / 0.7))
    nominal = total([F.coalesce(mw, F.lit(0.0)) * REPLAY_H[f] for f, mw in fuels.items() if f in REPLAY_H]) / 1000.0
    spin = nominal * (rpm / 3000.0) * (rpm / 3000.0)
    return {
        "frequency_hz": frequency,
        "rocof_hz_per_s": calm,
        "rpm": rpm,
        "delta_mw": gen - need,
        "flow": flow_label(gen, need),
        "frequency_status": frequency_label(frequency),
        "instant_generation_mw": instant,
        "instant_balance_mw": instant - need,
        "torque_demand_mnm": torque / 1_000_000.0,
        "torque_actual_mnm": torque * damp / 1_000_000.0,
        "nominal_inertia_gva": nominal,
        "instant_inertia_gva": spin,
        "inertia_delta_gva": spin - target_gva,
        "demand_coverage_pct": F.when(need > 0, instant / need * 100.0).otherwise(0.0),
        "system_status": rate_label(calm),
    }


def stability_mode(fossil: Column, renewable: Column, deadband: float = STABILITY_DEADBAND_MW) -> Column:
    return (
        F.when(F.abs(fossil - renewable) <= deadband, "Hybrid Anchored")
        .when(fossil > renewable, "Intrinsic")
        .otherwise("Digital Mediation")
    )


def gas_margin(
    fossil: Column, renewable: Column, exporting: Column, gas: Column, gas_max: Column | float
) -> Column:
    """True when renewables lead, power is exported and gas runs below 15 % of its maximum."""
    share = gas / gas_max * 100.0
    return F.coalesce((renewable > fossil) & exporting & (share < GAS_MARGIN_PCT), F.lit(False))


def inertia_units(gvas: Column, capacity_mw: float = 60_000.0, f0: float = 50.0) -> dict[str, Column]:
    """GVA·s as MW·s, as MW at 1 Hz/s, and that as a share of capacity."""
    mws = gvas * 1000.0
    mw = mws * 2.0 / f0
    return {"mws": mws, "mw_at_1hz_s": mw, "pct_capacity": mw / capacity_mw * 100.0}


def co2_rate(generation: Column) -> Column:
    return generation * CO2_T_PER_MWH
