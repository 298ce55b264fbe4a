"""TEOS-10 quantities from the published 75-term polynomial of specific volume, as column expressions.

Arguments are Spark columns or plain numbers. Pressures are in dbar, Absolute Salinity in g/kg,
Conservative Temperature in degrees Celsius.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Specific volume, coefficients by powers (salinity root, temperature, pressure).
_V = {
    (0, 0, 0): 1.0769995862e-3, (0, 0, 1): -6.0799143809e-5, (0, 0, 2): 9.9856169219e-6, (0, 0, 3): -1.1309361437e-6, (0, 0, 4): 1.0531153080e-7, (0, 0, 5): -1.2647261286e-8, (0, 0, 6): 1.9613503930e-9,
    (0, 1, 0): -1.5649734675e-5, (0, 1, 1): 1.8505765429e-5, (0, 1, 2): -1.1736386731e-6, (0, 1, 3): -3.6527006553e-7, (0, 1, 4): 3.1454099902e-7,
    (0, 2, 0): 2.7762106484e-5, (0, 2, 1): -1.1716606853e-5, (0, 2, 2): 2.1305028740e-6, (0, 2, 3): 2.8695905159e-7,
    (0, 3, 0): -1.6521159259e-5, (0, 3, 1): 7.9279656173e-6, (0, 3, 2): -4.6132540037e-7,
    (0, 4, 0): 6.9111322702e-6, (0, 4, 1): -3.4102187482e-6, (0, 4, 2): -6.3352916514e-8, (0, 5, 0): -8.0539615540e-7, (0, 5, 1): 5.0736766814e-7, (0, 6, 0): 2.0543094268e-7,
    (1, 0, 0): -3.1038981976e-4, (1, 0, 1): 2.4262468747e-5, (1, 0, 2): -5.8484432984e-7, (1, 0, 3): 3.6310188515e-7, (1, 0, 4): -1.1147125423e-7,
    (1, 1, 0): 3.5009599764e-5, (1, 1, 1): -9.5677088156e-6, (1, 1, 2): -5.5699154557e-6, (1, 1, 3): -2.7295696237e-7, (1, 2, 0): -3.7435842344e-5, (1, 2, 1): -2.3678308361e-7, (1, 2, 2): 3.9137387080e-7,
    (1, 3, 0): 2.4141479483e-5, (1, 3, 1): -3.4558773655e-6, (1, 3, 2): 7.7618888092e-9, (1, 4, 0): -8.7595873154e-6, (1, 4, 1): 1.2956717783e-6, (1, 5, 0): -3.3052758900e-7,
    (2, 0, 0): 6.6928067038e-4, (2, 0, 1): -3.4792460974e-5, (2, 0, 2): -4.8122251597e-6, (2, 0, 3): 1.6746303780e-8, (2, 1, 0): -4.3592678561e-5, (2, 1, 1): 1.1100834765e-5, (2, 1, 2): 5.4620748834e-6,
    (2, 2, 0): 3.5907822760e-5, (2, 2, 1): 2.9283346295e-6, (2, 2, 2): -6.5731104067e-7, (2, 3, 0): -1.4353633048e-5, (2, 3, 1): 3.1655306078e-7, (2, 4, 0): 4.3703680598e-6,
    (3, 0, 0): -8.5047933937e-4, (3, 0, 1): 3.7470777305e-5, (3, 0, 2): 4.9263106998e-6, (3, 1, 0): 3.4532461828e-5, (3, 1, 1): -9.8447117844e-6, (3, 1, 2): -1.3544185627e-6,
    (3, 2, 0): -1.8698584187e-5, (3, 2, 1): -4.8826139200e-7, (3, 3, 0): 2.2863324556e-6,
    (4, 0, 0): 5.8086069943e-4, (4, 0, 1): -1.7322218612e-5, (4, 0, 2): -1.7811974727e-6, (4, 1, 0): -1.1959409788e-5, (4, 1, 1): 2.5909225260e-6, (4, 2, 0): 3.8595339244e-6,
    (5, 0, 0): -2.1092370507e-4, (5, 0, 1): 3.0927427253e-6, (5, 1, 0): 1.3864594581e-6, (6, 0, 0): 3.1932457305e-5,
}
_SCALE, _OFFSET = 0.0248826675584615, 5.971840214030754e-1
# Specific volume and enthalpy of standard ocean water by pressure (1e4 dbar).
_V_STANDARD = (9.726613854843870e-4, -4.505913211160929e-5, 7.130728965927127e-6, -6.657179479768312e-7, -2.994054447232880e-8, -1.2647261286e-8, 1.9613503930e-9)
_H_STANDARD = (0.0, 9.726613854843870e-4, -2.252956605580465e-5, 2.376909655387404e-6, -1.664294869986011e-7, -5.988108894465758e-9, -2.1078768810e-9, 2.8019291329e-10)
# Potential enthalpy, rows by power of the salinity root, then by power of temperature.
_ENTHALPY = ((61.01362420681071, 168776.46138048015, -2735.2785605119625, 2574.2164453821433, -1536.6644434977543, 545.7340497931629, -50.91091728474331, -18.30489878927802), (),
             (268.5520265845071, -12019.028203559312, 3734.858026725145, -2046.7671145057618, 465.28655623826234, -0.6370820302376359, -10.650848542359153),
             (937.2099110620707, 588.1802812170108, 248.39476522971285, -3.871557904936333, -2.6268019854268356),
             (-1687.914374187449, 936.3206544460336, -942.7827304544439, 369.4389437509002, -33.83664947895248, -9.987880382780322), (246.9598888781377,), (123.59576582457964,), (-48.5891069025409,))
_HEAT_CAPACITY = 3991.86795711963
# Entropy, coefficients by powers (salinity root, temperature, pressure), in the published order.
_ENTROPY = {
    (0, 0, 1): -270.983805184062, (0, 0, 2): 776.153611613101, (0, 0, 3): -196.51255088122, (0, 0, 4): 28.9796526294175, (0, 0, 5): -2.13290083518327,
    (0, 1, 0): -24715.571866078, (0, 1, 1): 2910.0729080936, (0, 1, 2): -1513.116771538718, (0, 1, 3): 546.959324647056, (0, 1, 4): -111.1208127634436, (0, 1, 5): 8.68841343834394,
    (0, 2, 0): 2210.2236124548363, (0, 2, 1): -2017.52334943521, (0, 2, 2): 1498.081172457456, (0, 2, 3): -718.6359919632359, (0, 2, 4): 146.4037555781616, (0, 2, 5): -4.9892131862671505,
    (0, 3, 0): -592.743745734632, (0, 3, 1): 1591.873781627888, (0, 3, 2): -1207.261522487504, (0, 3, 3): 608.785486935364, (0, 3, 4): -105.4993508931208,
    (0, 4, 0): 290.12956292128547, (0, 4, 1): -973.091553087975, (0, 4, 2): 602.603274510125, (0, 4, 3): -276.361526170076, (0, 4, 4): 32.40953340386105,
    (0, 5, 0): -113.90630790850321, (0, 5, 1): 381.06836198507096, (0, 5, 2): -133.7383902842754, (0, 5, 3): 49.023632509086724,
    (0, 6, 0): 21.35571525415769, (0, 6, 1): -67.41756835751434,
    (2, 0, 1): 729.116529735046, (2, 0, 2): -343.956902961561, (2, 0, 3): 124.687671116248, (2, 0, 4): -31.656964386073, (2, 0, 5): 7.04658803315449,
    (2, 1, 0): 1760.062705994408, (2, 1, 1): -1721.528607567954, (2, 1, 2): 674.819060538734, (2, 1, 3): -356.629112415276, (2, 1, 4): 88.4080716616, (2, 1, 5): -15.84003094423364,
    (2, 2, 0): -675.802947790203, (2, 2, 1): 2082.7344423998043, (2, 2, 2): -614.668925894709, (2, 2, 3): 340.685093521782, (2, 2, 4): -33.3848202979239,
    (2, 3, 0): 365.7041791005036, (2, 3, 1): -1190.914967948748, (2, 3, 2): 298.904564555024, (2, 3, 3): -145.9491676006352,
    (2, 4, 0): -108.30162043765552, (2, 5, 0): 12.78101825083098,
    (3, 0, 1): -175.292041186547, (3, 0, 2): 83.1923927801819, (3, 0, 3): -29.483064349429,
    (3, 1, 0): -86.1329351956084, (3, 1, 1): 766.116132004952, (3, 1, 2): -108.3834525034224, (3, 1, 3): 51.2796974779828,
    (3, 2, 0): -30.0682112585625, (3, 2, 1): -1380.9597954037708, (3, 3, 0): 3.50240264723578, (3, 3, 1): 938.26075044542,
    (4, 0, 1): -22.6683558512829, (4, 1, 0): -137.1145018408982, (4, 2, 0): 148.10030845687618, (4, 3, 0): -68.5590309679152, (4, 4, 0): 12.4848504784754,
}
# Freezing temperature, coefficients by powers (half powers of salinity / 100, pressure / 1e4).
_FREEZING = {(0, 0): 0.017947064327968736, (2, 0): -6.076099099929818, (3, 0): 4.883198653547851, (4, 0): -11.88081601230542, (5, 0): 13.34658511480257, (6, 0): -8.722761043208607, (7, 0): 2.082038908808201,
             (0, 1): -7.389420998107497, (0, 2): -2.110913185058476, (0, 3): 0.2295491578006229, (2, 1): -0.9891538123307282, (3, 1): -0.08987150128406496, (2, 2): 0.3831132432071728, (4, 1): 1.054318231187074,
             (3, 2): 1.065556599652796, (2, 3): -0.7997496801694032, (5, 1): 0.3850133554097069, (4, 2): -2.078616693017569, (3, 3): 0.8756340772729538, (6, 1): -2.079022768390933, (5, 2): 1.596435439942262,
             (4, 3): 0.1338002171109174, (7, 1): 1.242891021876471}


def _power(x, n: int):
    out = 1.0
    for _ in range(n):
        out = x * out
    return out


def _root(x):
    return F.sqrt(x) if isinstance(x, Column) else math.sqrt(x)


def _volume(sa, ct, p, along: int | None = None):
    """Specific volume, or its derivative along salinity (0) or temperature (1)."""
    s, t, z = _root(_SCALE * sa + _OFFSET), 0.025 * ct, 1e-4 * p
    # Horner in pressure, then temperature, then salinity, keeps the expression short.
    out = None
    for i in range(6, -1, -1):
        inner = None
        for j in range(6, -1, -1):
            deep = None
            for k in range(6, -1, -1):
                c = _V.get((i, j, k), 0.0) * (i if along == 0 else j if along == 1 else 1)
                deep = c if deep is None or isinstance(deep, float) and deep == 0.0 else c + z * deep
            a = deep
            if along == 1 and j == 0:
                break
            inner = a if inner is None or isinstance(inner, float) and inner == 0.0 else a + t * inner
        if along == 0 and i == 0:
            break
        out = inner if out is None or isinstance(out, float) and out == 0.0 else inner + s * out
    if along == 0:
        return out * (0.5 * _SCALE) / s
    return out * 0.025 if along == 1 else out


def specific_volume(sa, ct, p):
    return _volume(sa, ct, p)


def density(sa, ct, p):
    return 1.0 / _volume(sa, ct, p)


def expansion(sa, ct, p):
    """Thermal expansion coefficient."""
    return _volume(sa, ct, p, 1) / _volume(sa, ct, p)


def contraction(sa, ct, p):
    """Haline contraction coefficient."""
    return -_volume(sa, ct, p, 0) / _volume(sa, ct, p)


def conservative_from_potential(sa, pt):
    """Conservative Temperature of a potential temperature (0 dbar)."""
    x, y = _root(_SCALE * sa), 0.025 * pt
    total = 0.0
    for i, row in enumerate(_ENTHALPY):
        inner = 0.0
        for c in reversed(row):
            inner = c + y * inner
        total = total + inner * _power(x, i)
    return total / _HEAT_CAPACITY


def _entropy(sa, t, p=None, slope: bool = False):
    """The part of entropy that differs between states of one salinity, or (at the surface) its derivative along
    temperature. Horner in pressure, then temperature, then salinity."""
    x, y, z = _root(_SCALE * sa), 0.025 * t, None if p is None else 1e-4 * p
    total = None
    for i in range(4, -1, -1):
        inner = None
        for j in range(6, 0 if slope else -1, -1):
            deep = 0.0
            for k in range(0 if z is None else 5, -1, -1):
                c = _ENTROPY.get((i, j, k), 0.0) * (j if slope else 1)
                deep = c if isinstance(deep, float) and deep == 0.0 else c + z * deep
            inner = deep if inner is None or isinstance(inner, float) and inner == 0.0 else deep + y * inner
        total = inner if total is None or isinstance(total, float) and total == 0.0 else inner + x * total
    return total * (-0.025 * 0.025 if slope else -0.025)


def newton_potential(sa, guess, entropy):
    """A better potential temperature (0 dbar) of water of a given entropy: one step. Three from the in-situ
    temperature reach the limit of doubles anywhere in the ocean."""
    return guess - (_entropy(sa, guess) - entropy) / _entropy(sa, guess, slope=True)


def entropy(sa, t, p):
    return _entropy(sa, t, p)


def potential_from_in_situ(sa: float, t: float, p: float) -> float:
    """Potential temperature (0 dbar) of an in-situ temperature."""
    target, pt = _entropy(sa, t, p), t
    for _ in range(3):
        pt = newton_potential(sa, pt, target)
    return pt


def freezing(sa, p):
    """Conservative Temperature at which air-free sea water freezes."""
    x, z = _root(0.01 * sa), 1e-4 * p
    total = 0.0
    for k in (3, 2, 1, 0):
        inner = 0.0
        for i in range(7, -1, -1):
            c = _FREEZING.get((i, k), 0.0)
            inner = c if isinstance(inner, float) and inner == 0.0 else c + x * inner
        total = inner if isinstance(total, float) and total == 0.0 else inner + z * total
    return total


def outside_funnel(sa: Column, ct: Column, p: Column) -> Column:
    """Whether a state lies outside the range of oceanographic states for which the polynomials hold."""
    deep, abyss = (p >= 500) & (p < 6500), p >= 6500
    return ((p > 8000) | (sa < 0) | (sa > 42) | (ct < freezing(sa, F.least(p, F.lit(500.0)))) | deep & ((sa < p * 5e-3 - 2.5) | (ct > 31.66666666666667 - p * 3.333333333333334e-3))
            | abyss & ((sa < 30) | (ct > 10)))


def gravity(latitude: float, pressure: float = 0.0) -> float:
    sin2 = math.sin(math.radians(latitude)) ** 2
    surface = 9.780327 * (1.0 + (5.2792e-3 + 2.32e-5 * sin2) * sin2)
    return surface * (1.0 - 2.26e-7 * _height(pressure, sin2, surface))


def _series(coefficients: tuple[float, ...], z: float) -> float:
    return sum(c * z**k for k, c in enumerate(coefficients))


def _height(p: float, sin2: float, surface: float) -> float:
    """Height (negative below the surface) at a pressure."""
    a, c = -0.5 * 2.26e-7 * surface, _series(_H_STANDARD, p * 1e-4) * 1e8
    return -2 * c / (surface + math.sqrt(surface * surface - 4 * a * c))


def pressure(depth: float, latitude: float) -> float:
    """Sea pressure at a depth in metres, positive down."""
    z, sin2 = -depth, math.sin(math.radians(latitude)) ** 2
    surface = 9.780327 * (1.0 + (5.2792e-3 + 2.32e-5 * sin2) * sin2)
    c1 = 5.25e-3 * sin2 + 5.92e-3
    p = -2.0 * z / ((1 - c1) + math.sqrt((1 - c1) ** 2 + 8.84e-6 * z))
    slope = 1e4 * _series(_V_STANDARD, p * 1e-4)
    off = _series(_H_STANDARD, p * 1e-4) * 1e8 + surface * (z - 0.5 * 2.26e-7 * z * z)
    middle = 0.5 * (p + p - off / slope)
    return p - off / (1e4 * _series(_V_STANDARD, middle * 1e-4))
