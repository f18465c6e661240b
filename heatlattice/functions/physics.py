"""The physical models as scalar SQL expressions over columns: hydraulics, heat, mass transfer, steam pipes, finance.

Each function takes the text of its arguments (column names or expressions) and returns the text of an expression of
standard SQL; ``column`` makes a Column of it, which stays inside whole-stage code generation. Guards are CASEs, so
that nothing divides by zero in ANSI mode. A null argument gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatlattice.functions.params import (
    AIR_K, AIR_NU, AIR_PR, DEPTH, ECONOMICS, EMISSIVITY, FAILURES, FE_PER_O2, GRAVITY, GROUND, GROUND_C, LAMBDA_PUR, LAMBDA_SOIL, RHO_STEEL, ROUGHNESS, SIGMA_SB, STEAM, WATER, Ground, Steam, Water, capital_recovery,
)


def column(text: str) -> Column:
    return F.expr(text)


def n(x: float) -> str:
    """A number as a double literal of both dialects."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


class Spark:
    """How Spark SQL takes a fixed number of steps: written out, as its folds are interpreted and these are compiled."""

    @staticmethod
    def fold(steps: int, start: str, body: Callable[[str], str]) -> str:
        text = start
        for _ in range(steps):
            text = f"({body(text)})"
        return text


class Duck:
    """The same in DuckDB."""

    @staticmethod
    def fold(steps: int, start: str, body: Callable[[str], str]) -> str:
        return f"list_reduce(list_transform(range(1, {steps + 1}), lambda step: step::DOUBLE), lambda x, step: {body('x')}, {start})"


# --- hydraulics


def reynolds(m: str, d: str, water: Water = WATER) -> str:
    return f"(CASE WHEN {d} <= 0 OR {m} <= 0 THEN 0e0 ELSE 4e0 * {m} / (pi() * {d} * {n(water.mu)}) END)"


def velocity(m: str, d: str, water: Water = WATER) -> str:
    return f"(CASE WHEN {d} <= 0 THEN 0e0 ELSE 4e0 * {m} / ({n(water.rho)} * pi() * {d} * {d}) END)"


#: Fixed-point steps of the friction factor: 17 reach 1e-12 from 2300 on; the SQL of the tests takes 40.
FRICTION_STEPS = 20


def friction(re: str, d: str, engine: type = Spark) -> str:
    """Laminar below 2300, else Colebrook-White in fixed-point steps from the Swamee-Jain value."""
    rough = f"{n(ROUGHNESS)} / {d} / 3.7e0"
    start = f"-2e0 * log10({rough} + 5.74e0 / pow({re}, 0.9e0))"
    steps = FRICTION_STEPS if engine is Spark else 40
    root = engine.fold(steps, f"({start})", lambda x: f"-2e0 * log10({rough} + 2.51e0 * {x} / {re})")
    return f"(CASE WHEN {re} <= 0 THEN 0e0 WHEN {re} < 2300 THEN 64e0 / {re} ELSE 1e0 / pow({root}, 2e0) END)"


def friction_haaland(re: str, d: str) -> str:
    rough = f"pow({n(ROUGHNESS)} / {d} / 3.7e0, 1.11e0)"
    return f"(CASE WHEN {re} <= 0 THEN 0e0 WHEN {re} < 2300 THEN 64e0 / {re} ELSE 1e0 / pow(-1.8e0 * log10({rough} + 6.9e0 / {re}), 2e0) END)"


def pressure_drop(m: str, d: str, length: str, engine: type = Spark, water: Water = WATER, factor: str | None = None) -> str:
    """``factor`` names the friction factor where it is known, so that it is not worked out again."""
    u = velocity(m, d, water)
    return f"(CASE WHEN {m} <= 0 OR {d} <= 0 OR {length} <= 0 THEN 0e0 ELSE {factor or friction(reynolds(m, d, water), d, engine)} * ({length} / {d}) * {n(water.rho)} * {u} * {u} / 2e0 END)"


def mass_flow(load_kw: str, water: Water = WATER) -> str:
    return f"({load_kw} * 1000e0 / ({n(water.cp)} * {n(water.supply_C - water.return_C)}))"


def pump_power(m: str, dp: str, eta: float = ECONOMICS.eta, water: Water = WATER) -> str:
    return f"(CASE WHEN {m} <= 0 OR {dp} <= 0 THEN 0e0 ELSE {m} * {dp} / ({n(water.rho)} * {n(eta)}) END)"


def static_head(dz: str, water: Water = WATER) -> str:
    return f"({n(water.rho * GRAVITY)} * {dz})"


def closed_loop(supply: str, back: str) -> str:
    """The static head cancels around the loop; friction of both legs stays."""
    return f"({supply} + {back})"


TOP_PRESSURE = WATER.p_sat + ECONOMICS.margin


def zones(relief: str, pressure_class: str = n(ECONOMICS.pressure_class), water: Water = WATER) -> str:
    usable = f"({pressure_class} - {n(water.p_sat + ECONOMICS.margin)})"
    return f"(CASE WHEN {usable} <= 0 THEN 99 ELSE greatest(1, CAST(ceil({static_head(relief, water)} / {usable}) AS INT)) END)"


def bottom_pressure(relief: str) -> str:
    return f"({n(TOP_PRESSURE)} + {static_head(relief)})"


def pressure_violation_bar(relief: str, pressure_class: str = n(ECONOMICS.pressure_class)) -> str:
    return f"greatest(0e0, ({bottom_pressure(relief)} - {pressure_class}) / 1e5)"


# --- heat


def churchill_bernstein(v: str, d: str) -> str:
    re = f"({v} * {d} / {n(AIR_NU)})"
    den = n((1 + (0.4 / AIR_PR) ** (2 / 3)) ** 0.25)
    nu = f"(0.3e0 + 0.62e0 * sqrt({re}) * {n(AIR_PR ** (1 / 3))} / {den} * pow(1e0 + pow({re} / 282000e0, 0.625e0), 0.8e0))"
    return f"(CASE WHEN {v} <= 0 OR {d} <= 0 THEN 0e0 ELSE {nu} * {n(AIR_K)} / {d} END)"


def radiation(surface_c: str, ambient_c: str) -> str:
    s, a = f"({surface_c} + 273.15e0)", f"({ambient_c} + 273.15e0)"
    return f"({n(EMISSIVITY * SIGMA_SB)} * ({s} * {s} + {a} * {a}) * ({s} + {a}))"


def external(v: str, d: str, surface_c: str, ambient_c: str) -> str:
    return f"({churchill_bernstein(v, d)} + {radiation(surface_c, ambient_c)})"


def gnielinski(m: str, d: str, engine: type = Spark, factor: str | None = None) -> str:
    """``factor`` names the friction factor where it is known."""
    re = reynolds(m, d)
    f8 = f"({factor or friction(re, d, engine)} / 8e0)"
    nu = f"({f8} * ({re} - 1000e0) * {n(WATER.Pr)} / (1e0 + 12.7e0 * sqrt({f8}) * {n(WATER.Pr ** (2 / 3) - 1)}))"
    return f"(CASE WHEN {m} <= 0 OR {d} <= 0 THEN 0e0 WHEN {re} < 2300 THEN {n(3.66 * WATER.k)} / {d} ELSE {nu} * {n(WATER.k)} / {d} END)"


def loss_above_ground(d_steel: str, thickness: str, fluid_c: str, ambient_c: str, lam: float = STEAM.lam_ins, h: float = STEAM.eps_ext) -> str:
    d = f"({d_steel} + 2e0 * {thickness})"
    return f"(({fluid_c} - {ambient_c}) / (ln({d} / {d_steel}) / {n(2 * math.pi * lam)} + 1e0 / ({n(h * math.pi)} * {d})))"


def buried_self(d_steel: str, d_casing: str) -> str:
    return f"(ln({d_casing} / {d_steel}) / {n(2 * math.pi * LAMBDA_PUR)} + ln({n(4 * DEPTH)} / {d_casing}) / {n(2 * math.pi * LAMBDA_SOIL)})"


def buried_mutual(d_casing: str) -> str:
    return f"(ln(sqrt(1e0 + pow({n(2 * DEPTH)} / ({d_casing} + 0.15e0), 2e0))) / {n(2 * math.pi * LAMBDA_SOIL)})"


def loss_buried(d_steel: str, d_casing: str, supply_c: str = n(WATER.supply_C), return_c: str = n(WATER.return_C)) -> str:
    return f"(({supply_c} + {return_c} - {n(2 * GROUND_C)}) / ({buried_self(d_steel, d_casing)} + {buried_mutual(d_casing)}))"


def decay(t_in: str, per_kelvin: str, length: str, m: str) -> str:
    return f"(CASE WHEN {m} <= 0 OR {length} <= 0 THEN {t_in} ELSE {n(GROUND_C)} + ({t_in} - {n(GROUND_C)}) * exp(-{per_kelvin} * {length} / ({m} * {n(WATER.cp)})) END)"


# --- mass transfer

SCHMIDT = WATER.mu / (WATER.rho * WATER.D_O2)


def sherwood(re: str) -> str:
    return f"(CASE WHEN {re} < 2300 THEN 3.66e0 ELSE 0.023e0 * pow({re}, 0.83e0) * {n(SCHMIDT ** (1 / 3))} END)"


def mass_transfer(u: str, d: str) -> str:
    re = f"({n(WATER.rho)} * {u} * {d} / {n(WATER.mu)})"
    return f"(CASE WHEN {u} <= 0 OR {d} <= 0 THEN 0e0 ELSE {sherwood(re)} * {n(WATER.D_O2)} / {d} END)"


def penetration(u: str, d: str, oxygen: str) -> str:
    """mm of wall a year."""
    return f"({mass_transfer(u, d)} * {oxygen} * {n(FE_PER_O2 / RHO_STEEL * 3.15576e7 * 1000)})"


def years_to_perforate(u: str, d: str, oxygen: str, wall: float = 0.005) -> str:
    """Infinite where nothing corrodes."""
    mm = penetration(u, d, oxygen)
    return f"(CASE WHEN {mm} > 0 THEN {n(wall * 1000)} / {mm} ELSE CAST('Infinity' AS DOUBLE) END)"


def corrosion_factor(u: str, d: str, oxygen: str) -> str:
    mm = penetration(u, d, oxygen)
    return f"(CASE WHEN {mm} > 0 THEN least(5e0, greatest(0.2e0, 50e0 * {mm} / 5e0)) ELSE 1e0 END)"


def condensation(q: str, latent: str) -> str:
    return f"(CASE WHEN {latent} <= 0 THEN 0e0 ELSE {q} / ({latent} * 1000e0) END)"


def steam_quality(m: str, q: str, at: str, latent: str, x_in: str = "1e0") -> str:
    return f"(CASE WHEN {m} <= 0 THEN {x_in} ELSE least(1e0, greatest(0e0, {x_in} - {condensation(q, latent)} * {at} / {m})) END)"


def makeup(m: str, returned: str = "0.9e0") -> str:
    return f"({m} * (1e0 - {returned}))"


def condensing_derate(y: str) -> str:
    return f"(1e0 / (1e0 + 18e0 * greatest(0e0, least(0.5e0, {y}))))"


# --- steam pipes of the published model


def steam_inner(w: str, p: Steam = STEAM) -> str:
    return f"(CASE WHEN {w} <= 0 THEN 0e0 ELSE sqrt(4e0 * {w} / {n(math.pi * p.rho * p.u)}) END)"


def steam_outer(d_in: str) -> str:
    return f"(CASE WHEN {d_in} <= 0 THEN 0e0 ELSE 1.052e0 * {d_in} + 0.005251e0 END)"


def steam_weight(d_in: str) -> str:
    return f"(CASE WHEN {d_in} <= 0 THEN 0e0 ELSE 644.3e0 * {d_in} * {d_in} + 72.5e0 * {d_in} + 0.4611e0 END)"


def steam_price(d_out: str, weight: str, p: Steam = STEAM) -> str:
    return f"(CASE WHEN {d_out} <= 0 THEN 0e0 ELSE {n(p.A1)} * {weight} + {n(p.A2)} * pow({d_out}, 0.48e0) + {n(p.A3)} + {n(p.A4)} * {d_out} END)"


def steam_loss(d_out: str, mode: str | None = None, p: Steam = STEAM) -> str:
    """kJ a metre and second; the insulation is constant, proportional to the pipe, or scaled by a power of it."""
    mode = mode or p.mode
    t = {"constant": n(p.thickness), "proportional": f"{n(p.ratio)} * {d_out}", "en_scaling": f"{n(p.coefficient)} * pow({d_out}, {n(p.exponent)})"}[mode]
    d = f"({d_out} + 2e0 * ({t}))"
    return f"(CASE WHEN {d_out} <= 0 THEN 0e0 ELSE {n(math.pi * (p.steam_C - (p.ambient_K - 273.15)))} / (1000e0 * (ln({d} / {d_out}) / {n(2 * p.lam_ins)} + 1e0 / ({n(p.eps_ext)} * {d}))) END)"


def area_loss(own: str, parent: str) -> str:
    """Loss of a change of area between a branch and its parent; none without a parent."""
    return f"(CASE WHEN {parent} IS NULL OR {parent} <= 0 OR {own} <= 0 THEN 0e0 WHEN {own} < {parent} THEN 0.5e0 * (1e0 - {own} / {parent}) WHEN {own} > {parent} THEN pow(1e0 - {parent} / {own}, 2e0) ELSE 0e0 END)"


# --- ground


def slope_factor(s: str, ground: Ground = GROUND) -> str:
    f = f"(1e0 + {n(ground.a1)} * abs({s}) + {n(ground.a2)} * {s} * {s})"
    return f"({f} * CASE WHEN abs({s}) > {n(ground.rock_slope)} THEN {n(ground.rock_factor)} ELSE 1e0 END)"


def failure_rate(length: str, dn: str, u: str, d_in: str, oxygen: str = "2e-5") -> str:
    """Failures of a branch a year."""
    small = f"CASE WHEN {dn} <= {FAILURES.small_dn} THEN {n(FAILURES.small_factor)} ELSE 1e0 END"
    corroded = f"CASE WHEN {u} > 0 AND {d_in} > 0 THEN {corrosion_factor(u, d_in, oxygen)} ELSE 1e0 END"
    return f"({n(FAILURES.base + FAILURES.corrosion)} * {length} / 1000e0 * ({small}) * ({corroded}))"


CRF_STEAM, CRF = capital_recovery(STEAM.rate, STEAM.years), capital_recovery(ECONOMICS.rate, ECONOMICS.years)


# --- projection: Lambert azimuthal equal area (EPSG:3035) to longitude and latitude

_A, _FLAT, _LAT0, _LON0, _FE, _FN = 6378137.0, 1 / 298.257222101, math.radians(52), math.radians(10), 4321000.0, 3210000.0
_E2 = 2 * _FLAT - _FLAT**2


def _authalic(phi: float) -> float:
    e, s = math.sqrt(_E2), math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


_QP = _authalic(math.pi / 2)
_B0, _RQ = math.asin(_authalic(_LAT0) / _QP), _A * math.sqrt(_QP / 2)
_D = _A * math.cos(_LAT0) / (math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2) * _RQ * math.cos(_B0))


def _polar(x: str, y: str) -> tuple[str, str, str, str]:
    xp, yp = f"(({x} - {n(_FE)}) / {n(_D)})", f"(({y} - {n(_FN)}) * {n(_D)})"
    rho = f"sqrt({xp} * {xp} + {yp} * {yp})"
    return xp, yp, rho, f"(2e0 * asin({rho} / {n(2 * _RQ)}))"


def latitude(x: str, y: str) -> str:
    _, yp, rho, c = _polar(x, y)
    beta = f"asin(cos({c}) * {n(math.sin(_B0))} + {yp} * sin({c}) * {n(math.cos(_B0))} / {rho})"
    terms = (_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040, 23 * _E2**2 / 360 + 251 * _E2**3 / 3780, 761 * _E2**3 / 45360)
    series = " + ".join(f"{n(t)} * sin({2 * (i + 1)}e0 * {beta})" for i, t in enumerate(terms))
    return f"(CASE WHEN {rho} < 1e-9 THEN 52e0 ELSE degrees({beta} + {series}) END)"


def longitude(x: str, y: str, compat: bool = False) -> str:
    """compat: with a factor more in the denominator, as in older results (some 30 m off)."""
    xp, yp, rho, c = _polar(x, y)
    over = f"{n(_D if compat else 1.0)} * {rho} * {n(math.cos(_B0))} * cos({c}) - {n(_D if compat else 1.0)} * {yp} * {n(math.sin(_B0))} * sin({c})"
    return f"(CASE WHEN {rho} < 1e-9 THEN 10e0 ELSE degrees({n(_LON0)} + atan2({xp} * sin({c}), {over})) END)"
