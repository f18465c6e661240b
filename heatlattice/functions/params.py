"""Parameters of the models, with units. All are fixed values that results must agree on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

GRAVITY = 9.80665  # m/s2


@dataclass(frozen=True)
class Steam:
    """The published steam model: capital, fluid, pumping, heat loss and insulation (10 years at 2 %)."""

    years: int = 10
    rate: float = 0.02
    A1: float = 5.74
    A2: float = 1295.0
    A3: float = 47.6
    A4: float = 2065.0
    rho: float = 0.60
    u: float = 30.0
    power_price: float = 0.21
    hours: float = 8760.0
    eta: float = 0.8
    sigma: float = 0.015
    elbow_spacing: float = 25.0
    zeta_elbow: float = 1.0
    steam_price: float = 0.1945
    latent: float = 1999.9
    ambient_K: float = 276.5
    lam_ins: float = 0.06
    eps_ext: float = 11.63
    wind: float = 3.5
    thickness: float = 0.18
    steam_C: float = 100.0
    mode: str = "constant"
    ratio: float = 0.40
    exponent: float = 0.391
    coefficient: float = 0.30


@dataclass(frozen=True)
class Water:
    """Liquid water at 110 degC supply and 50 degC return."""

    supply_C: float = 110.0
    return_C: float = 50.0
    rho: float = 951.0
    cp: float = 4229.0
    mu: float = 2.59e-4
    k: float = 0.683
    Pr: float = 1.60
    p_sat: float = 1.43e5
    D_O2: float = 6.9e-9


#: Water of the cooler regime, 90 degC supply and 45 degC return.
WATER_90 = Water(supply_C=90.0, return_C=45.0, rho=965.3, cp=4205.0, mu=3.15e-4, p_sat=0.701e5)


@dataclass(frozen=True)
class Economics:
    """Trench, energy and pressure-class data of buried networks (30 years at 4 %)."""

    C1: float = 212.0
    C2: float = 4790.0
    power_price: float = 0.1922
    heat_price: float = 0.055
    eta: float = 0.75
    years: int = 30
    rate: float = 0.04
    full_load_hours: float = 1800.0
    pump_hours: float = 5000.0
    pressure_class: float = 16e5
    margin: float = 0.5e5
    station: float = 250_000.0


@dataclass(frozen=True)
class Failures:
    base: float = 0.02
    corrosion: float = 0.07
    small_factor: float = 1.6
    small_dn: int = 150
    repair_h: float = 12.0


@dataclass(frozen=True)
class Ground:
    a1: float = 1.176
    a2: float = 3.968
    steepest: float = 0.60
    rock_slope: float = 0.25
    rock_factor: float = 1.35


STEAM, WATER, ECONOMICS, FAILURES, GROUND = Steam(), Water(), Economics(), Failures(), Ground()

ROUGHNESS, LAMBDA_PUR, LAMBDA_SOIL, DEPTH, RHO_STEEL, GROUND_C = 4.0e-5, 0.027, 1.6, 0.8, 7850.0, 8.0
U_MAX, R_MAX = 3.0, 100.0
AIR_K, AIR_NU, AIR_PR, SIGMA_SB, EMISSIVITY = 0.0243, 1.36e-5, 0.715, 5.670374419e-8, 0.25
FE_PER_O2 = (4.0 / 3.0) * (55.845 / 31.998)
OXYGEN = {"well_deaerated": 2.0e-5, "poor_deaeration": 1.0e-4, "air_saturated": 8.0e-3}

#: dn, inner diameter, steel outer diameter, casing outer diameter (m)
CATALOGUE = [
    (20, 0.0217, 0.0269, 0.090),
    (25, 0.0285, 0.0337, 0.090),
    (32, 0.0372, 0.0424, 0.110),
    (40, 0.0431, 0.0483, 0.110),
    (50, 0.0545, 0.0603, 0.125),
    (65, 0.0703, 0.0761, 0.140),
    (80, 0.0825, 0.0889, 0.160),
    (100, 0.1071, 0.1143, 0.200),
    (125, 0.1325, 0.1397, 0.225),
    (150, 0.1603, 0.1683, 0.250),
    (200, 0.2101, 0.2191, 0.315),
    (250, 0.2630, 0.2730, 0.400),
    (300, 0.3127, 0.3239, 0.450),
    (350, 0.3444, 0.3556, 0.500),
    (400, 0.3938, 0.4064, 0.560),
    (450, 0.4444, 0.4570, 0.630),
    (500, 0.4954, 0.5080, 0.710),
    (600, 0.5958, 0.6096, 0.800),
    (700, 0.6950, 0.7112, 0.900),
    (800, 0.7954, 0.8128, 1.000),
    (900, 0.8940, 0.9144, 1.100),
    (1000, 0.9946, 1.0160, 1.200),
]

#: Published targets by metric and topology.
PUBLISHED = {
    "length_1e4_m": {"Star": 3.65, "MST": 1.19, "RSMT": 1.19, "ESMT": 1.03},
    "pipe_1e7": {"Star": 0.869, "MST": 1.03, "RSMT": 1.28, "ESMT": 0.939},
    "pressure_1e7": {"Star": 0.274, "MST": 0.704, "RSMT": 0.936, "ESMT": 0.654},
    "heat_1e7": {"Star": 1.10, "MST": 0.443, "RSMT": 0.458, "ESMT": 0.387},
    "total_1e7": {"Star": 2.25, "MST": 2.18, "RSMT": 2.67, "ESMT": 1.98},
}


def capital_recovery(rate: float, years: int) -> float:
    growth = (1 + rate) ** years
    return rate * growth / (growth - 1)


def catalogue(spark: SparkSession) -> DataFrame:
    """22 rows; safe to broadcast."""
    return spark.createDataFrame(CATALOGUE, "dn int, d_in double, d_steel double, d_casing double")
