"""British National Grid to WGS84 longitude and latitude as column projections.

Published formulas throughout: the Ordnance Survey's inverse transverse Mercator on
Airy 1830 and its seven-parameter shift, Snyder's series for the footpoint latitude
and Bowring's closed form for the way back to angles.

Each step is a projection over earlier ones, so nothing is computed twice and the
chain runs as generated code, without a Python worker. The last step is a one-row
``inline``: Spark does not push a condition on ``lat`` or ``lon`` through it, which
would copy the whole chain into the condition, while conditions on other columns
still reach the scan.
"""

from __future__ import annotations

from math import radians, sin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions.cleaning import finite

# Ellipsoids, projection and datum shift as published.
AIRY_A, AIRY_B = 6377563.396, 6356256.909
WGS_A, WGS_B = 6378137.0, 6356752.314245
SCALE = 0.9996012717
LAT0, LON0 = radians(49.0), radians(-2.0)
EAST0, NORTH0 = 400000.0, -100000.0
SHIFT_M = (446.448, -125.157, 542.060)
ROTATION_ARCSEC = (0.1502, 0.2470, 0.8421)
SHIFT_PPM = -20.4894

_AIRY_E2 = 1 - (AIRY_B / AIRY_A) ** 2
_WGS_E2 = 1 - (WGS_B / WGS_A) ** 2
_N = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
_ROTATION = tuple(radians(angle / 3600) for angle in ROTATION_ARCSEC)
_GROWTH = 1 + SHIFT_PPM * 1e-6

# Meridian length per radian of rectifying latitude, on the scaled ellipsoid.
RECTIFYING_RADIUS = SCALE * AIRY_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Weights of sin 2u, sin 4u, ... from geodetic to rectifying latitude and back.
TO_RECTIFYING = (
    -3 / 2 * _N + 9 / 16 * _N**3,
    15 / 16 * _N**2 - 15 / 32 * _N**4,
    -35 / 48 * _N**3,
    315 / 512 * _N**4,
)
FROM_RECTIFYING = (
    3 / 2 * _N - 27 / 32 * _N**3,
    21 / 16 * _N**2 - 55 / 32 * _N**4,
    151 / 96 * _N**3,
    1097 / 512 * _N**4,
)
MU0 = LAT0 + sum(weight * sin(2 * (k + 1) * LAT0) for k, weight in enumerate(TO_RECTIFYING))


def _d(value: float) -> str:
    return f"{value!r}D"


_FOOTPOINT = "g_mu" + "".join(
    f" + {_d(weight)} * sin({2 * (k + 1)} * g_mu)" for k, weight in enumerate(FROM_RECTIFYING)
)

# Names of steps: g_ratio is nu / rho, g_q the squared distance from the central
# meridian over nu squared, g_t2 and g_t4 powers of the tangent of the latitude.
_TO_AIRY_ANGLES = [
    {"g_mu": f"(y - {_d(NORTH0)}) / {_d(RECTIFYING_RADIUS)} + {_d(MU0)}", "g_d": f"x - {_d(EAST0)}"},
    {"g_foot": _FOOTPOINT},
    {"g_sin": "sin(g_foot)", "g_cos": "cos(g_foot)"},
    {"g_tan": "g_sin / g_cos", "g_bend": f"1D - {_d(_AIRY_E2)} * g_sin * g_sin"},
    {
        "g_nu": f"{_d(AIRY_A * SCALE)} / sqrt(g_bend)",
        "g_ratio": f"g_bend / {_d(1 - _AIRY_E2)}",
        "g_t2": "g_tan * g_tan",
    },
    {"g_t4": "g_t2 * g_t2", "g_q": "(g_d / g_nu) * (g_d / g_nu)"},
    {
        "g_lat": """g_foot - g_tan * g_ratio * g_q * (0.5D
            - g_q / 24D * (5D + 3D * g_t2 + (g_ratio - 1D) * (1D - 9D * g_t2))
            + g_q * g_q / 720D * (61D + 90D * g_t2 + 45D * g_t4))""",
        "g_lon": f"""{_d(LON0)} + g_d / (g_nu * g_cos) * (1D
            - g_q / 6D * (g_ratio + 2D * g_t2)
            + g_q * g_q / 120D * (5D + 28D * g_t2 + 24D * g_t4)
            - g_q * g_q * g_q / 5040D * (61D + 662D * g_t2 + 1320D * g_t4 + 720D * g_t4 * g_t2))""",
    },
]

(_TX, _TY, _TZ), (_RX, _RY, _RZ) = map(_d, SHIFT_M), map(_d, _ROTATION)
_TO_SHIFTED_AXES = [
    {"g_sin": "sin(g_lat)", "g_cos": "cos(g_lat)"},
    {"g_nu": f"{_d(AIRY_A)} / sqrt(1D - {_d(_AIRY_E2)} * g_sin * g_sin)"},
    {
        "g_ax": "g_nu * g_cos * cos(g_lon)",
        "g_ay": "g_nu * g_cos * sin(g_lon)",
        "g_az": f"g_nu * g_sin * {_d(1 - _AIRY_E2)}",
    },
    {
        "g_bx": f"{_d(_GROWTH)} * g_ax - {_RZ} * g_ay + {_RY} * g_az + {_TX}",
        "g_by": f"{_RZ} * g_ax + {_d(_GROWTH)} * g_ay - {_RX} * g_az + {_TY}",
        "g_bz": f"{_RX} * g_ay - {_RY} * g_ax + {_d(_GROWTH)} * g_az + {_TZ}",
    },
]

_TO_WGS_ANGLES = [
    {"g_flat": "sqrt(g_bx * g_bx + g_by * g_by)"},
    {"g_theta": f"atan2(g_bz * {_d(WGS_A)}, g_flat * {_d(WGS_B)})"},
    {"g_sin": "sin(g_theta)", "g_cos": "cos(g_theta)"},
    {
        "g_lat": f"""degrees(atan2(
            g_bz + {_d(_WGS_E2 / (1 - _WGS_E2) * WGS_B)} * g_sin * g_sin * g_sin,
            g_flat - {_d(_WGS_E2 * WGS_A)} * g_cos * g_cos * g_cos))""",
        "g_lon": "degrees(atan2(g_by, g_bx))",
    },
]


def add_lon_lat(df: DataFrame) -> DataFrame:
    """Add ``lon`` and ``lat`` in degrees from grid metres ``x`` and ``y``.

    Rows lacking either coordinate stay, with NULL angles; so do rows whose
    coordinates lie so far out that no finite angle results.
    """
    chain = df
    for step in _TO_AIRY_ANGLES + _TO_SHIFTED_AXES + _TO_WGS_ANGLES:
        chain = chain.withColumns({name: F.expr(formula) for name, formula in step.items()})
    lon, lat = finite(F.col("g_lon")), finite(F.col("g_lat"))
    both = lon.isNotNull() & lat.isNotNull()
    place = F.struct(F.when(both, lon).alias("lon"), F.when(both, lat).alias("lat"))
    return chain.select(*[f"`{name}`" for name in df.columns], F.inline(F.array(place)))
