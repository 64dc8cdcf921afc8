"""Unit grammar and conversion graph for concentrations.

A unit text is read by a small grammar (optional log10, optional multiplier, copies, per, optional amount,
denominator), not looked up in a list, so spellings that were never seen before still resolve.  What it reads is a node,
``domain|power of ten|amount|unit``, and a plain number that goes before it.  Conversions are edges of a graph that carry
affine functions ``y = a * x + b``, in the linear or in the log10 domain: facts such as "a gallon is 3.785411784 litres" and
"ten times a unit is ten of it", none of which leads further than to the next unit.  ``conversion_table`` composes them
along shortest paths, checks that every cycle of the graph composes to the identity, which second facts from other
definitions make a real test, and returns one row for each node: the table the equi-join in
:mod:`tidewell.operators.units` uses.
"""

from __future__ import annotations

import math
import re
from collections import deque
from functools import lru_cache
from typing import NamedTuple

PER_VOLUME = "copies/l"
PER_MASS = "copies/g dry sludge"
PER_MARKER = "ratio (microbial-normalized)"

_VOLUME = frozenset(("l", "ml", "dl", "cl", "ul", "m3", "gal"))
_MASS = frozenset(("g", "mg", "kg", "ug", "t"))
_SHARES = {"percent": "percent", "per cent": "percent", "%": "percent", "ppm": "ppm", "ppb": "ppb", "permille": "permille", "‰": "permille"}
_DENOMINATORS = (
    (r"(?:cubic met(?:re|er)s?|m\s?\^?\s?3|m³|kl|kilolit(?:re|er)s?)", "m3"),
    (r"(?:(?:u\.?s\.? )?gal(?:lons?)?)", "gal"),
    (r"(?:millilit(?:re|er)s?|mls?|cc|cm3|cm\^3)", "ml"),
    (r"(?:decilit(?:re|er)s?|dl)", "dl"),
    (r"(?:centilit(?:re|er)s?|cl)", "cl"),
    (r"(?:microlit(?:re|er)s?|ul|µl|μl)", "ul"),
    (r"(?:lit(?:re|er)s?|l)", "l"),
    (r"(?:milligrams?|mg)", "mg"),
    (r"(?:kilograms?|kg|kilos?)", "kg"),
    (r"(?:micrograms?|ug|µg|μg)", "ug"),
    (r"(?:tonnes?|metric tons?)", "t"),
    (r"(?:grams?|g)", "g"),
)
_WORDS = {
    "thousand": 1e3, "kilo": 1e3, "thousands": 1e3, "million": 1e6, "millions": 1e6, "mln": 1e6, "mega": 1e6,
    "billion": 1e9, "bn": 1e9, "hundred": 1e2,
}
_COPIES = r"(?:(?:genome|gene|target|rna|dna|viral)[ -]?)?(?:copies|copy|gc|cp|cps|genomes)"
_MARKER = r"(?:pmmov|crassphage|pepper mild mottle virus|bcov|(?:faecal |fecal |microbial )?marker|hf183)"
_NUMBER = re.compile(r"(?:x ?)?(?:10 ?\^ ?([+-]?\d+)|1?e([+-]?\d+)|([\d][\d,]*(?:\.\d+)?)(?:e([+-]?\d+))?)")


class Unit(NamedTuple):
    """scale copies per amount of a unit, or a scale of a share of marker copies; or the log10 of that."""

    log: bool
    scale: float
    amount: float
    unit: str

    @property
    def base(self) -> str:
        """The common unit of its quantity."""
        return PER_VOLUME if self.unit in _VOLUME else PER_MASS if self.unit in _MASS else PER_MARKER

    @property
    def key(self) -> str:
        """The plain number, and the node behind it."""
        n, rest = _power(self.scale, *POWERS)
        k, below = _power(self.amount, *AMOUNTS)
        return f"{rest / below:.15g}|{node(self.log, n, k, self.unit)}"


#: Powers of ten that scales and amounts have nodes for; what is beyond goes into the plain number.
POWERS, AMOUNTS = (-12, 12), (0, 3)


def node(log: bool, power: int, amount: int, unit: str) -> str:
    return f"{'log10' if log else 'lin'}|{power}|{amount}|{unit}"


def _power(x: float, least: int, most: int) -> tuple[int, float]:
    """The power of ten in x, within bounds, and what is left."""
    n = math.log10(x)
    n = round(n) if abs(n - round(n)) < 1e-12 else math.floor(n)
    n = max(least, min(most, n))
    return n, x / 10.0**n


def _number(text: str) -> float | None:
    m = _NUMBER.fullmatch(text.strip())
    if not m:
        return None
    if m[1] or m[2]:
        return 10.0 ** int(m[1] or m[2])
    return float(m[3].replace(",", "")) * 10.0 ** int(m[4] or 0)


def _quantity(text: str) -> float | None:
    """A multiplier: any run of numbers and number words; '' is one."""
    total = 1.0
    for part in re.sub(r"(?<=\d),(?=\d{3})", "", text).replace("*", " ").replace("×", " ").split():
        value = _WORDS.get(part) or _number(part.removeprefix("x"))
        if value is None:
            return None
        total *= value
    return total


def _denominator(text: str) -> tuple[float, str] | None:
    text = text.strip()
    m = re.fullmatch(rf"(?:(.*?)\s?)?{_COPIES}?\s?(?:of )?{_MARKER}(?: copies| copy| gc)?", text)
    if m is not None and re.search(_MARKER, text):
        n = _quantity(m[1] or "")
        return None if not n else (n, "ratio")
    m = re.match(r"([\d][\d.,]*\s?|10 ?\^ ?\d+\s)?(.*)", text)
    amount, rest = (_quantity(m[1]) if m[1] else 1.0), m[2].strip()
    if not amount:
        return None
    for pattern, name in _DENOMINATORS:
        d = re.match(rf"{pattern}(?![a-z0-9])", rest)
        if not d:
            continue
        tail = re.sub(r"[()\[\]]", " ", rest[d.end() :]).strip()
        if name in _VOLUME and re.fullmatch(r"(?:of )?(?:(?:raw |untreated )?(?:waste ?water|influent|sewage|sample|water))?", tail):
            return amount, name
        if name in _MASS and re.fullmatch(r"(?:of )?(?:dry|dried|dw|d\.w\.|ds|sludge|solids|biosolids)(?:[ -](?:sludge|solids|weight|wt|mass|matter|biosolids))*", tail):
            return amount, name
    return None


@lru_cache(maxsize=65536)
def parse_unit(text: str | None) -> Unit | None:
    """The unit a text names, or None if it names none (null, blank, 'n/a', a method, anything unknown)."""
    if not isinstance(text, str):
        return None
    s = re.sub(r"\s+", " ", text.casefold().replace("₁₀", "10")).strip(" .;,")
    s = re.sub(r"\s?/\s?", "/", s)
    log = False
    if re.match(r"log ?_?\(?10\)?|log\b|lg\b", s):
        log = True
        s = re.sub(r"^(?:log ?_?\(?10\)?|log|lg)\s?(?:of )?", "", s)
        s = re.sub(r"\s?\((?:base|basis) ?10\)$|,? base ?10$", "", s).strip()
        if s.startswith("(") and s.endswith(")"):
            s = s[1:-1].strip()
    unit = _linear(s)
    return None if unit is None else Unit(log, *unit)


def _linear(s: str) -> tuple[float, float, str] | None:
    """Scale, amount and unit."""
    # ratios to marker copies
    m = re.fullmatch(r"(?:(?:%s ratio|ratio(?: to %s)?|(?:microbial[ -]normali[sz]ed )?ratio)(?:\s?\(microbial[ -]normali[sz]ed\))?)(.*)" % (_MARKER, _MARKER), s)
    if m:
        tail = m[1].strip(" ,")
        if not tail:
            return 1.0, 1.0, "ratio"
        share = re.fullmatch(r"(?:in |as )?\(?(percent|per cent|%|ppm)\)?", tail)
        if share:
            return 1.0, 1.0, _SHARES[share[1]]
        n = _quantity(tail.removeprefix("x ").removeprefix("x"))
        return (n, 1.0, "ratio") if n else None
    m = re.fullmatch(r"(percent|per cent|%%|ppm|ppb|permille|‰) ?(?:of )?(?:the )?%s(?: copies| copy)?" % _MARKER, s)
    if m:
        return 1.0, 1.0, _SHARES[m[1]]
    m = re.fullmatch(rf"(.*?)\s?({_COPIES})\s?(?:/| per | in (?=\d))\s?(.+)", s)
    if not m:
        return None
    scale = _quantity(m[1].strip())
    below = _denominator(m[3])
    return (scale, *below) if scale and below else None


#: Phrases of a method text that name amounts or units of something other than the result.
_ASIDE = re.compile(
    r"\(sample volume[^)]*\)|(?:detection|quantification) limit[^;|)]*|surrogate spiked[^;|)]*|(?:flow|population)s? (?:is |are )?(?:given|measured|reported) in [^;|)]*"
    r"|recovery [\d.]+ ?(?:percent|%)|(?:duplicate|triplicate|replicate) wells[^;|)]*|(?:sample volume|volume of sample|spiked?|aliquot)[^;|)]*"
)
_STATED = re.compile(
    r"(?:results? in|lab(?:oratory)? reports|values? (?:are )?expressed as|unit of (?:the )?results?\s*[=:]|reported(?: as)?\s*:?|units?\s*[=:])\s*([^;|]+)", re.I
)


@lru_cache(maxsize=65536)
def parse_method(text: str | None) -> Unit | None:
    """The unit of the result that a method text states: after a phrase such as 'results in', else as a clause of its own."""
    if not isinstance(text, str):
        return None
    s = _ASIDE.sub(" ", re.sub(r"\s+", " ", text.casefold()))
    m = _STATED.search(s)
    if m:
        told = m[1].strip()
        for candidate in (told, re.sub(r"\)$", "", told).strip()):
            if unit := parse_unit(candidate):
                return unit
    parts = [p.strip(" .()") for p in re.split(r"[;|]| - ", s)]
    for p in [*parts, *(q for x in parts for q in _commas(x))]:
        if unit := parse_unit(p):
            return unit
    return None


def _commas(s: str) -> list[str]:
    bits = [b.strip() for b in s.split(",")]
    return [", ".join(bits[i:j]) for n in range(len(bits), 0, -1) for i in range(len(bits) - n + 1) for j in (i + n,)]


def unit_key(unit: str | None, method: str | None) -> str | None:
    """The node of the stated unit: the unit column decides, only if it names none does the method."""
    u = parse_unit(unit) or parse_method(method)
    return u.key if u else None


# ---------------------------------------------------------------------------------------------------------------
# the conversion graph


class Affine(NamedTuple):
    """y = a * x + b."""

    a: float
    b: float

    def then(self, other: Affine) -> Affine:
        return Affine(other.a * self.a, other.a * self.b + other.b)

    def inverse(self) -> Affine:
        return Affine(1 / self.a, -self.b / self.a)


#: How much of another unit a unit is; of the copies per unit it is one part in as many.
SIZES = (
    ("ml", "l", 1e-3), ("dl", "l", 1e-1), ("cl", "dl", 1e-1), ("ul", "ml", 1e-3), ("m3", "l", 1e3), ("gal", "l", 3.785411784),
    ("mg", "g", 1e-3), ("ug", "mg", 1e-3), ("kg", "g", 1e3), ("t", "kg", 1e3),
)
#: Shares of marker copies in another.
SHARES = (("percent", "ratio", 1e-2), ("permille", "percent", 1e-1), ("ppm", "permille", 1e-3), ("ppb", "ppm", 1e-3))
#: The same from other definitions, which close cycles.  A US gallon is 231 cubic inches, an inch 2.54 cm.
SECOND_SIZES = (
    ("gal", "in3", 231.0), ("in3", "ml", 2.54**3), ("m3", "ml", 1e6), ("cl", "ml", 10.0), ("ul", "l", 1e-6), ("t", "g", 1e6), ("ug", "g", 1e-6), ("kg", "mg", 1e6),
)
SECOND_SHARES = (("ppm", "ratio", 1e-6), ("permille", "ratio", 1e-3), ("ppb", "ratio", 1e-9))


def build_edges(
    sizes: tuple = SIZES + SECOND_SIZES, shares: tuple = SHARES + SECOND_SHARES, powers: tuple[int, int] = POWERS, amounts: tuple[int, int] = AMOUNTS
) -> list[tuple[str, str, Affine]]:
    """Edges of the graph, from facts.  In the linear domain an edge multiplies, in the log10 domain it adds the logarithm.

    Ten times a unit is ten of it, and a thousand times a thousand of it; a reading per ten of a unit is a tenth of one per
    unit; a reading per unit is that per another by the unit's size."""
    edges: list[tuple[str, str, Affine]] = []
    units = {u for x in (*sizes, *shares) for u in x[:2]}
    measures = {u for x in sizes for u in x[:2]} | {"ratio"}
    for log in (False, True):
        step = lambda f: Affine(1.0, math.log10(f)) if log else Affine(f, 0.0)  # noqa: E731, B023
        for n in range(powers[0], powers[1] + 1):
            for k in range(amounts[0], amounts[1] + 1):
                for u in sorted(units):
                    here = node(log, n, k, u)
                    edges += [(here, node(log, n - d, k, u), step(10.0**d)) for d in (1, 3) if n - d >= powers[0]]
                    if u in measures:
                        edges += [(here, node(log, n, k - d, u), step(10.0**-d)) for d in (1, 3) if k - d >= amounts[0]]
                edges += [(node(log, n, k, u), node(log, n, k, v), step(1 / f)) for u, v, f in sizes]
                edges += [(node(log, n, k, u), node(log, n, k, v), step(f)) for u, v, f in shares]
    return edges


def compose(edges: list[tuple[str, str, Affine]], roots: list[str], tolerance: float = 1e-9) -> dict[str, tuple[str, Affine, int]]:
    """Shortest composition from each node to its root, breadth first: root, function and the number of edges.

    Every edge that isn't in the tree closes a cycle; its composition must be the identity within ``tolerance``.
    Raises ValueError for an inconsistent cycle."""
    near: dict[str, list[tuple[str, Affine]]] = {}
    for u, v, f in edges:
        near.setdefault(u, []).append((v, f.inverse()))
        near.setdefault(v, []).append((u, f))
    to: dict[str, tuple[str, Affine, int]] = {}
    for root in roots:
        to[root] = (root, Affine(1.0, 0.0), 0)
        queue = deque([root])
        while queue:
            v = queue.popleft()
            for u, there in near.get(v, ()):  # there: from u to v
                if u not in to:
                    to[u] = (root, there.then(to[v][1]), to[v][2] + 1)
                    queue.append(u)
    for u, v, f in edges:
        if u not in to or v not in to:
            continue
        direct, around = to[u][1], f.then(to[v][1])
        if abs(direct.a - around.a) > tolerance * max(abs(direct.a), 1e-300) or abs(direct.b - around.b) > tolerance * max(1.0, abs(direct.b)):
            raise ValueError(f"conversions disagree on a cycle through {u} and {v}: {direct} and {around}")
    return to


#: The unit of each common one.
COMMON_UNITS = {"l": PER_VOLUME, "g": PER_MASS, "ratio": PER_MARKER}


@lru_cache(maxsize=1)
def conversion_table() -> list[tuple[str, str, bool, float, float]]:
    """(node, common_unit, log, a, b) of every node: value = a*x+b, then 10 to that power for log nodes.

    The size is bounded by the grammar (units, powers of ten, amounts), not by the data."""
    roots = {node(log, 0, 0, u): (common, log) for u, common in COMMON_UNITS.items() for log in (False, True)}
    return sorted((key, *roots[root], f.a, f.b) for key, (root, f, _) in compose(build_edges(), list(roots)).items())


#: Fixed values, for tests: units in the common one of their quantity.
_DIRECT = {
    "l": 1.0, "ml": 1e-3, "dl": 1e-1, "cl": 1e-2, "ul": 1e-6, "m3": 1e3, "gal": 3.785411784, "g": 1.0, "mg": 1e-3, "kg": 1e3, "ug": 1e-6, "t": 1e6,
    "ratio": 1.0, "percent": 1e2, "permille": 1e3, "ppm": 1e6, "ppb": 1e9,
}


def to_common(value: float, unit: str | None, method: str | None = None) -> tuple[float, str] | None:
    """One value in plain Python, without the graph: the reference for tests."""
    u = parse_unit(unit) or parse_method(method)
    if u is None:
        return None
    return (10.0**value if u.log else value) * u.scale / u.amount / _DIRECT[u.unit], u.base
