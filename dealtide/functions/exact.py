"""Sums and ratios without binary noise.

``round(a / b, n)`` on doubles depends on how ``a / b`` happens to be represented, and on the order in which
rows were added. Here sums are exact whatever the precision: a number is split into limbs, each of which is summed apart,
with room for any number of rows. Quotients are taken in integers or decimals, half away from zero, the same on every run.
Arguments are SQL expressions, aggregates included, that give integers or decimals; denominators must not be
negative. The ratio itself must stay below 10**17.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to this precision a number is two limbs of a long: its units of 10**-scale, cut at this many bits. Sums of
#: 2**39 rows fit; wider decimals are summed as whole part and fraction.
NARROW, _BITS = 14, 24
#: Decimals of a fraction's first limb; what is smaller is a limb of its own.
_PLACES = 18


def _units(numerator: str, denominator: str, places: int, literal: str = "BD") -> str:
    """The ratio as a whole number of 10**-places; NULL for a zero denominator."""
    size = (
        f"((abs({numerator}) * {2 * 10**places}{literal} + {denominator})"
        f" div (nullif({denominator}, 0) * 2{literal}))"
    )
    return f"if({numerator} < 0, -{size}, {size})"


def rounded_units(numerator: str, denominator: str, places: int) -> Column:
    """The ratio of two longs of one row as a long in units of 10**-places."""
    return F.expr(_units(numerator, denominator, places, "L"))


def ratio_sql(numerator: str, denominator: str, places: int) -> str:
    return f"(cast({_units(numerator, denominator, places)} AS double) / {10**places}D)"


def rounded_ratio(numerator: str, denominator: str, places: int) -> Column:
    """The ratio of two totals as a double; computed in decimals, which hold any total."""
    return F.expr(ratio_sql(numerator, denominator, places))


@dataclass(frozen=True)
class Number:
    """A numeric column by its limbs: SQL expressions over a row, whose sums make the exact total.

    One limb: doubles as they are. Two or three: see `number`.
    """

    name: str
    limbs: tuple[str, ...]
    scale: int | None
    narrow: bool = False

    @property
    def exact(self) -> bool:
        return self.scale is not None

    def sums(self) -> tuple[str, ...]:
        return tuple(f"sum({limb})" for limb in self.limbs)

    def _whole_and_fraction(self, totals: Sequence[str]) -> tuple[str, str]:
        """The total cut at its integer part (rounded down in wide decimals, towards 0 in narrow ones)."""
        if self.narrow:
            units, one = self._total(totals), f"{10**self.scale}BD"
            fraction = f"cast({units} % {one} AS decimal({NARROW},0)) * {_power(self.scale)}BD"
            return f"({units} div {one})", f"cast({fraction} AS decimal(29,{_PLACES}))"
        whole, fraction, *rest = totals
        if rest:
            fraction = f"({fraction} + floor({rest[0]}, {_PLACES}))"
        return whole, f"cast({fraction} AS decimal(29,{_PLACES}))"

    def _total(self, totals: Sequence[str]) -> str:
        """Of a narrow number: the total in units."""
        high, low = totals
        return f"(cast({high} AS decimal(20,0)) * {2**_BITS}BD + {low})"

    def value(self, totals: Sequence[str]) -> str:
        """SQL of the total as a double, the same whatever the order of rows was."""
        if not self.exact:
            return totals[0]
        whole, fraction = self._whole_and_fraction(totals)
        return f"(cast({whole} AS double) + cast({fraction} AS double))"

    def decimal(self, totals: Sequence[str]) -> str:
        """SQL of the total as a decimal(30,18), NULL beyond 10**12."""
        whole, fraction = self._whole_and_fraction(totals)
        return f"try_cast(try_cast({whole} AS decimal(12,0)) + {fraction} AS decimal(30,{_PLACES}))"

    def mean_sql(self, totals: Sequence[str], count: str, places: int) -> str:
        """SQL of total / count as a double, rounded once; totals: SQL of the sums of the limbs."""
        if not self.exact:
            return f"round({totals[0]} / {count}, {places})"
        if self.narrow:
            return ratio_sql(self._total(totals), f"({10**self.scale}BD * {count})", places)
        # The whole part is divided first; its remainder and the fraction are less than two counts, so every
        # product fits 38 digits: total = q * n + e, with |e| < 2n.
        whole, fraction = self._whole_and_fraction(totals)
        n = f"cast(nullif({count}, 0) AS decimal(11,0))"
        q = f"({whole} div {n})"
        e = f"(cast({whole} % {n} AS decimal(11,0)) + {fraction})"
        negative = f"({q} < 0 OR ({q} = 0 AND {e} < 0))"
        if len(totals) > 2:  # What no limb shows brings a negative total nearer to zero.
            more = f"if({negative} AND pmod({totals[2]}, {_power(_PLACES)}BD) > 0, {_power(_PLACES)}BD, 0BD)"
            e = f"({e} + {more})"
        turned = f"cast(if({negative}, -{e}, {e}) + {n} AS decimal(30,{_PLACES}))"
        digits = f"(({turned} * {2 * 10**places}BD + {n}) div (2BD * {n}))"
        size = f"((abs({q}) - 1) * {10**places}L + {digits})"
        return f"(cast(if({negative}, -{size}, {size}) AS double) / {10**places}D)"

    def rounded(self, totals: Sequence[str], count: str, places: int) -> Column:
        return F.expr(self.mean_sql(totals, count, places))

    def mean(self, places: int) -> Column:
        """The mean of the column, as an aggregate."""
        return self.rounded(self.sums(), f"count({self.name})", places)


def number(df: DataFrame, name: str) -> Number:
    """How to sum a column by its type.

    Decimals of up to 14 digits and integers become longs in units of the last decimal, cut in two limbs of 24 bits
    and the rest; other decimals and longs their whole part, the first 18 decimals and, where there are more, what
    is left. Doubles stay doubles.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.LongType):
        return Number(name, (f"cast({name} AS decimal(38,0))", "0BD"), 0)
    if isinstance(kind, T.IntegralType):
        return Number(name, _cut(f"cast({name} AS bigint)"), 0, narrow=True)
    if not isinstance(kind, T.DecimalType):
        return Number(name, (f"cast({name} AS double)",), None)
    if kind.precision <= NARROW:
        units = f"cast({name} * {10**kind.scale}BD AS bigint)"
        return Number(name, _cut(units), kind.scale, narrow=True)
    whole = f"cast(floor({name}) AS decimal(38,0))"
    fraction = f"pmod({name}, 1BD)"
    if kind.scale <= _PLACES:
        return Number(name, (whole, f"cast({fraction} AS decimal(28,{_PLACES}))"), kind.scale)
    first = f"cast(floor({fraction}, {_PLACES}) AS decimal(28,{_PLACES}))"
    rest = f"cast(pmod({name}, {_power(_PLACES)}BD) AS decimal(38,38))"
    return Number(name, (whole, first, rest), kind.scale)


def _cut(units: str) -> tuple[str, str]:
    return f"shiftright({units}, {_BITS})", f"({units} & {2**_BITS - 1}L)"


def ratio_of_means_sql(
    a: Number, a_totals: Sequence[str], a_count: str, b: Number, b_totals: Sequence[str], b_count: str,
    factor: int, places: int,
) -> str:
    """SQL of factor * (mean of a) / (mean of b), rounded, as a double.

    Equal counts cancel out, and then the totals are divided with all 18 decimals. Else totals of up to six decimals
    are. What fits neither, totals beyond 10**12 or more decimals of unequal counts, is divided as doubles of exact totals.
    """
    plain = (
        f"round({factor} * ({a.value(a_totals)} / {a_count})"
        f" / nullif({b.value(b_totals)} / {b_count}, 0), {places})"
    )
    if not (a.exact and b.exact):
        return plain
    x, y = a.decimal(a_totals), b.decimal(b_totals)
    twice = 2 * factor * 10**places

    def quotient(top: str, bottom: str) -> str:
        # Both signs may differ, so the quotient is taken of the sizes.
        size = f"((abs({top}) * {twice}BD + abs({bottom})) div (nullif(abs({bottom}), 0) * 2BD))"
        return f"(if(({top} < 0) != ({bottom} < 0), -{size}, {size}) / {10**places}D)"

    short = _power(6)
    six = [f"try_cast({v} AS decimal(19,6))" for v in (x, y)]
    counts = [f"cast({n} AS decimal(12,0))" for n in (b_count, a_count)]
    crossed = quotient(f"({six[0]} * {counts[0]})", f"({six[1]} * {counts[1]})")
    few = f"{x} % {short}BD = 0 AND {y} % {short}BD = 0"
    return (
        f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN {plain}"
        f" WHEN {a_count} = {b_count} THEN {quotient(x, y)}"
        f" WHEN {few} THEN {crossed} ELSE {plain} END"
    )


def ratio_of_row_sql(a: Number, b: Number, factor: int, places: int, kinds: Sequence[T.DataType]) -> str:
    """SQL of factor * a / b of one row; see `ratio_of_row`. kinds: the types of the two columns."""
    double = (
        f"round({factor} * cast({a.name} AS double) / nullif(cast({b.name} AS double), 0), {places})"
    )
    if not (a.exact and b.exact):
        return double
    scales = [min(n.scale, 24) for n in (a, b)]
    whole = 38 - 1 - len(str(2 * factor * 10**places)) - max(scales)
    x, y = (
        f"try_cast({n.name} AS decimal({whole + s},{s}))"
        if _digits(kind) > whole or n.scale > s
        else n.name
        for n, s, kind in zip((a, b), scales, kinds, strict=True)
    )
    size = f"((abs({x}) * {2 * factor * 10**places}BD + abs({y})) div (nullif(abs({y}), 0) * 2BD))"
    units = f"if(({x} < 0) != ({y} < 0), -{size}, {size})"
    exact = f"cast({units} * {_power(places)}BD AS decimal(28,{places}))"
    if (x, y) == (a.name, b.name):
        return exact
    # A value of more digits than fit.
    return f"coalesce({exact}, if({x} IS NULL OR {y} IS NULL, try_cast({double} AS decimal(28,{places})), NULL))"


def ratio_of_row(df: DataFrame, a: str, b: str, factor: int, places: int) -> Column:
    """factor * a / b of one row, rounded: a decimal(28, places), or a double where either is one; NULL for b = 0."""
    kinds = [df.schema[name].dataType for name in (a, b)]
    return F.expr(ratio_of_row_sql(number(df, a), number(df, b), factor, places, kinds))


def _digits(kind: T.DataType) -> int:
    """Digits before the point that a type may hold."""
    return kind.precision - kind.scale if isinstance(kind, T.DecimalType) else 20


def _power(places: int) -> str:
    return "1" if not places else f"0.{'0' * (places - 1)}1"


def percent(part: str, whole: str) -> Column:
    """Percent with one decimal; NULL when there is no part at all."""
    return F.expr(percent_sql(part, whole))


def percent_sql(part: str, whole: str) -> str:
    return f"(cast({_units(f'nullif({part}, 0)', whole, 3)} AS double) / 10D)"
