"""Physical units: a scale and the exponents of base dimensions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

BASE = ("m", "kg", "s", "K", "A", "mol", "cd")


class UnitError(ValueError):
    """Units that can't be combined or converted."""


@dataclass(frozen=True)
class Unit:
    """scale x m^a kg^b s^c K^d A^e mol^f cd^g."""

    scale: float = 1.0
    powers: tuple[Fraction, ...] = (Fraction(0),) * len(BASE)
    name: str | None = None

    def __eq__(self, other) -> bool:
        return isinstance(other, Unit) and self.powers == other.powers and abs(self.scale - other.scale) <= 1e-12 * max(self.scale, other.scale)

    def __hash__(self) -> int:
        return hash(self.powers)

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.scale * other.scale, tuple(a + b for a, b in zip(self.powers, other.powers)))

    def __truediv__(self, other: Unit) -> Unit:
        return Unit(self.scale / other.scale, tuple(a - b for a, b in zip(self.powers, other.powers)))

    def __pow__(self, n) -> Unit:
        n = Fraction(n).limit_denominator(60)
        return Unit(self.scale ** float(n), tuple(p * n for p in self.powers))

    @property
    def dimensionless(self) -> bool:
        return not any(self.powers)

    def factor_to(self, other: Unit) -> float:
        """What a value in this unit is multiplied by, to be one in the other."""
        if self.powers != other.powers:
            raise UnitError(f"{self} can't be converted to {other}")
        return self.scale / other.scale

    def __str__(self) -> str:
        if self.name:
            return self.name
        known = next((n for n, u in NAMED.items() if u == self), None)
        if known:
            return known
        parts = [b if p == 1 else f"{b}^{p}" for b, p in zip(BASE, self.powers) if p]
        return " ".join(([f"{self.scale:g}"] if self.scale != 1 else []) + parts) or "1"


def _named(scale: float, **powers) -> Unit:
    return Unit(scale, tuple(Fraction(powers.get(b, 0)) for b in BASE))


#: Names with their scale and exponents in SI base units.
NAMED = {
    "m": _named(1, m=1), "km": _named(1e3, m=1), "cm": _named(1e-2, m=1), "mm": _named(1e-3, m=1), "um": _named(1e-6, m=1), "nm": _named(1e-9, m=1),
    "kg": _named(1, kg=1), "g": _named(1e-3, kg=1), "s": _named(1, s=1), "ms": _named(1e-3, s=1), "us": _named(1e-6, s=1), "min": _named(60, s=1), "h": _named(3600, s=1),
    "K": _named(1, K=1), "A": _named(1, A=1), "mol": _named(1, mol=1), "cd": _named(1, cd=1),
    "Hz": _named(1, s=-1), "N": _named(1, kg=1, m=1, s=-2), "Pa": _named(1, kg=1, m=-1, s=-2), "J": _named(1, kg=1, m=2, s=-2), "W": _named(1, kg=1, m=2, s=-3),
    "C": _named(1, A=1, s=1), "V": _named(1, kg=1, m=2, s=-3, A=-1), "T": _named(1, kg=1, s=-2, A=-1), "eV": _named(1.602176634e-19, kg=1, m=2, s=-2), "keV": _named(1.602176634e-16, kg=1, m=2, s=-2),
    "rad": _named(1), "deg": _named(0.017453292519943295), "percent": _named(1e-2), "%": _named(1e-2), "1": _named(1), "": _named(1),
}
OFFSET = {"deg_C", "celsius", "°C", "degC", "deg_F", "fahrenheit", "°F"}
DIMENSIONLESS = Unit()


def unit(text) -> Unit | None:
    """A unit from its text: names with powers, joined by spaces, * or /."""
    if text is None or isinstance(text, Unit):
        return text
    out, sign = Unit(), 1
    for part in re.findall(r"/|\*(?!\*)|[^\s*/]+(?:\*\*-?[\d.]+)?", str(text)):
        if part == "/":
            sign = -1
            continue
        if part == "*":
            continue
        m = re.fullmatch(r"(.*?)(?:(?:\^|\*\*)?(-?\d+(?:\.\d+)?))?", part)
        name, power = m[1], m[2]
        if part in NAMED:
            name, power = part, None
        if name in OFFSET:
            raise UnitError(f"{name} has an offset and is no unit of a product")
        if name not in NAMED:
            raise UnitError(f"unknown unit {part!r}")
        out, sign = (out * NAMED[name] ** (sign * Fraction(power or 1))), 1
    known = str(text).strip()
    return Unit(out.scale, out.powers, known if known in NAMED else None)


#: How functions treat units.
MULTIPLY, DIVIDE = {"multiply", "vdot", "dot"}, {"divide", "floor_divide"}
ALIKE = {"add", "subtract", "maximum", "minimum", "fmax", "fmin", "hypot", "mod", "fmod", "clip", "where", "nextafter"}
COMPARE = {"less", "less_equal", "greater", "greater_equal", "equal", "not_equal", "isclose", "arctan2"}
KEEP = {"negative", "positive", "absolute", "conjugate", "real", "imag", "floor", "ceil", "trunc", "rint", "round", "spacing"}
POWERS = {"square": Fraction(2), "sqrt": Fraction(1, 2), "cbrt": Fraction(1, 3), "reciprocal": Fraction(-1)}
PLAIN = set("exp exp2 expm1 log log2 log10 log1p sin cos tan arcsin arccos arctan sinh cosh tanh arcsinh arccosh arctanh logaddexp logaddexp2".split())
AGNOSTIC = {"isnan", "isinf", "isfinite", "signbit", "sign", "copysign", "heaviside"}


def planned(name: str, units: list[Unit | None], exponent=None) -> tuple[Unit | None, list[float]]:
    """The result's unit and what each operand is multiplied by. None: no unit."""
    ones = [1.0] * len(units)
    if all(u is None for u in units):
        return None, ones
    have = [u or DIMENSIONLESS for u in units]
    if name in MULTIPLY:
        return have[0] * have[1], ones
    if name in DIVIDE:
        return have[0] / have[1], ones
    if name in ALIKE or name in COMPARE:
        return (None if name in COMPARE else have[0]), [u.factor_to(have[0]) for u in have]
    if name in KEEP:
        return have[0], ones
    if name in POWERS:
        return have[0] ** POWERS[name], ones
    if name in ("power", "float_power"):
        if not have[1].dimensionless or (exponent is None and not have[0].dimensionless):
            raise UnitError("an exponent must be one plain number")
        return have[0] ** (exponent if exponent is not None else 1), ones
    if name in PLAIN:
        return None, [u.factor_to(DIMENSIONLESS) for u in have]
    if name in AGNOSTIC:
        return (have[0] if name == "copysign" else None), ones
    raise UnitError(f"{name} is not defined for units")
