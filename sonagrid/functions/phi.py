"""Weight functions of an amplitude: the registry of phi, and the discrete metrics built on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: expm1 is taken of at most this.
EXPONENT_LIMIT = 50.0

PHI: dict[str, Callable[[Column], Column]] = {
    "linear": lambda a: a,
    "sqrt": F.sqrt,
    "squared": lambda a: a * a,
    "cbrt": F.cbrt,
    "cubic": lambda a: a * a * a,
    "log": F.log1p,
    "exponential": lambda a: F.expm1(F.least(a, F.lit(EXPONENT_LIMIT))),
    "inverse_log": lambda a: 1.0 / (F.log1p(a) + 1e-10),
}
DISCRETE = ("d3", "d10", "d17", "d24")
#: Names that stand for others.
ALIASES = {"sum": "linear", "d2": "linear", "inverse log": "inverse_log", "log1p": "log", "expm1": "exponential", "d8": "d17"}


def canonical_name(name: str) -> str:
    """The registry's name for a weight function; ValueError if there is none."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in PHI and key not in DISCRETE:
        raise ValueError(f"no weight function {name!r}; there are {', '.join([*PHI, *DISCRETE])}")
    return key


def canonical_name_column(name: Column) -> Column:
    """The same for a column; unknown names become null."""
    known = {**ALIASES, **{k: k for k in (*PHI, *DISCRETE)}}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(name)))


def phi(name: str, amplitude: Column) -> Column:
    """phi of one component's amplitude; 0 for negative amplitudes and null stays null."""
    key = canonical_name(name)
    key = {"d3": "log", "d10": "log", "d17": "squared", "d24": "log"}.get(key, key)
    return F.when(amplitude >= 0, PHI[key](amplitude)).when(amplitude < 0, 0.0)


def participation(strength: Column) -> Column:
    """Aggregate: (sum s)^2 / sum s^2, the effective number of components; 0 without any."""
    return F.coalesce(F.try_divide(F.sum(strength) ** 2, F.sum(strength * strength)), F.lit(0.0))


def effective_components(amplitude: Column) -> Column:
    """Aggregate: participation of the energies A^2."""
    return participation(amplitude * amplitude)


def discrete(name: str, amplitude: Column, loud: Column | None = None) -> Column:
    """Aggregate: D3 = sum log1p A, D10 = D3 N_eff / N, D17 = log1p(sum A^2) log1p(N_eff), D24 = D3 of ``loud`` rows."""
    d3 = F.sum(F.log1p(amplitude))
    if name == "d3":
        return d3
    if name == "d10":
        return d3 * effective_components(amplitude) / F.count(amplitude)
    if name == "d17":
        return F.log1p(F.sum(amplitude * amplitude)) * F.log1p(effective_components(amplitude))
    if name == "d24":
        return F.sum(F.when(loud, F.log1p(amplitude)).otherwise(0.0))
    raise ValueError(name)
