"""Scoring schemes of read mapping and mapping qualities, as Column expressions.

Shares of score ranges are taken in single precision, and minimum scores are cut to integers
toward zero, as their tables were made for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Scoring:
    """min score = const + coeff x length (or x ln length); monotone: no match bonus, so the best possible score is 0."""

    match: int = 0
    min_const: float = -0.6
    min_coeff: float = -0.6
    log_length: bool = False
    mm_min: int = 2
    mm_max: int = 6
    n_penalty: int = 1
    gap_open: int = 5
    gap_ext: int = 3

    @property
    def monotone(self) -> bool:
        return self.match == 0


# The presets' parameters.
END_TO_END = Scoring()
LOCAL = Scoring(match=2, min_const=0.0, min_coeff=10.0, log_length=True)
BASE1 = Scoring(match=1, min_const=37.0, min_coeff=0.3, mm_min=3, mm_max=3, n_penalty=3, gap_open=11, gap_ext=4)


def perfect_score(s: Scoring, length: Column) -> Column:
    return length * s.match


def min_score(s: Scoring, length: Column) -> Column:
    """An integer, cut toward zero."""
    x = (F.log(length) if s.log_length else length).cast("float")
    return (_single(s.min_const) + _single(s.min_coeff) * x).cast("int")


def _single(x: float) -> Column:
    return F.lit(x).cast("float")


def mismatch_cost(s: Scoring, quality: Column) -> Column:
    """Between mm_min and mm_max by quality, which counts up to 40."""
    return F.floor(s.mm_min + F.least(quality, F.lit(40)) / 40.0 * (s.mm_max - s.mm_min)).cast("int")


# Fixed values. ONE: (least share of the score range above the minimum, quality) without a second alignment.
# TWO: (least share between best and second, [(least share above the minimum, quality), ...]); a share of 1 is a perfect score.
ONE_GLOBAL = [(0.8, 42), (0.7, 40), (0.6, 24), (0.5, 23), (0.4, 8), (0.3, 3), (None, 0)]
ONE_LOCAL = [(0.8, 44), (0.7, 42), (0.6, 41), (0.5, 36), (0.4, 28), (0.3, 24), (None, 22)]
TWO_GLOBAL = [
    (0.9, [(1, 39), (None, 33)]), (0.8, [(1, 38), (None, 27)]), (0.7, [(1, 37), (None, 26)]), (0.6, [(1, 36), (None, 22)]),
    (0.5, [(1, 35), (0.84, 25), (0.68, 16), (None, 5)]), (0.4, [(1, 34), (0.84, 21), (0.68, 14), (None, 4)]),
    (0.3, [(1, 32), (0.88, 18), (0.67, 15), (None, 3)]), (0.2, [(1, 31), (0.88, 17), (0.67, 11), (None, 0)]),
    (0.1, [(1, 30), (0.88, 12), (0.67, 7), (None, 0)]), (0, [(0.67, 6), (None, 2)]), (None, [(0.67, 1), (None, 0)]),
]
TWO_LOCAL = [
    (0.9, [(None, 40)]), (0.8, [(None, 39)]), (0.7, [(None, 38)]), (0.6, [(None, 37)]),
    (0.5, [(1, 35), (0.5, 25), (None, 20)]), (0.4, [(1, 34), (0.5, 21), (None, 19)]), (0.3, [(1, 33), (0.5, 18), (None, 16)]),
    (0.2, [(1, 32), (0.5, 17), (None, 12)]), (0.1, [(1, 31), (0.5, 14), (None, 9)]), (0, [(0.5, 11), (None, 2)]), (None, [(0.5, 1), (None, 0)]),
]
# The other calculator. By bins of a tenth of the score range: without a second; perfect with a second; [difference][best] otherwise.
V3_ONE_PERFECT = 44
V3_ONE = [43, 42, 41, 36, 32, 27, 20, 11, 4, 1, 0]
V3_TWO_PERFECT = [2, 16, 23, 30, 31, 32, 34, 36, 38, 40, 42]
V3_TWO = [
    [2, 2, 2, 1, 1, 0, 0, 0, 0, 0, 0],
    [20, 14, 7, 3, 2, 1, 0, 0, 0, 0, 0],
    [20, 16, 10, 6, 3, 1, 0, 0, 0, 0, 0],
    [20, 17, 13, 9, 3, 1, 1, 0, 0, 0, 0],
    [21, 19, 15, 9, 5, 2, 2, 0, 0, 0, 0],
    [22, 21, 16, 11, 10, 5, 0, 0, 0, 0, 0],
    [23, 22, 19, 16, 11, 0, 0, 0, 0, 0, 0],
    [24, 25, 21, 30, 0, 0, 0, 0, 0, 0, 0],
    [30, 26, 29, 0, 0, 0, 0, 0, 0, 0, 0],
    [30, 27, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [30, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
]


def _tiers(value: Column, tiers: list, range_: Column, result) -> Column:
    out = None
    for least, x in reversed(tiers):
        x = result(x)
        if least is None:
            out = x
        else:
            reached = value > 0 if least == 0 else value >= range_ * _single(least)
            out = F.when(reached, x) if out is None else F.when(reached, x).otherwise(out)
    return out


def mapq(s: Scoring, best: Column, second: Column, length: Column, mate_length: Column | None = None) -> Column:
    """Mapping quality from the best and second scores (null: none) and the read's length (and its mate's)."""
    top, low = perfect_score(s, length), min_score(s, length)
    if mate_length is not None:
        top, low = top + perfect_score(s, mate_length), low + min_score(s, mate_length)
    range_, over = (top - low).cast("float"), (best - low).cast("float")
    one, two = (ONE_GLOBAL, TWO_GLOBAL) if s.monotone else (ONE_LOCAL, TWO_LOCAL)
    quality = lambda q: F.lit(q)
    single = _tiers(over, one, range_, quality)
    gap = F.abs(F.abs(best) - F.abs(second)).cast("float")
    double = _tiers(gap, two, range_, lambda x: _tiers(over, x, range_, quality))
    return F.when(best < low, 0).when(second.isNull(), single).otherwise(double).cast("int")


def mapq_v3(s: Scoring, best: Column, second: Column, length: Column, paired: Column | None = None, compat: bool = True) -> Column:
    """The table-driven mapping quality.

    compat: a score counts as perfect if what it lost equals the best possible score, and the
    perfect row is read by the lost score's bin. Otherwise a perfect score is one that equals
    the best possible, and its row is read by the bin of the difference.
    """
    top, low = perfect_score(s, length), min_score(s, length)
    norm = F.lit(10.0).cast("float") / (top - low).cast("float")
    norm = norm.cast("float")  # division is in double precision
    bin = lambda x: F.least((x.cast("float") * norm + _single(0.5)).cast("int"), F.lit(10))
    lost, apart = F.greatest(top - best, F.lit(0)), best - second
    row = lambda v: F.array(*[F.lit(x) for x in v])
    perfect = lost == top if compat else best >= top
    one = F.when(perfect, V3_ONE_PERFECT).otherwise(F.get(row(V3_ONE), bin(lost)))
    two = F.when(perfect, F.get(row(V3_TWO_PERFECT), bin(lost if compat else apart))).otherwise(F.get(F.get(F.array(*[row(x) for x in V3_TWO]), bin(apart)), bin(lost)))
    single = F.when(best < low, 0).when(second.isNull(), one).otherwise(two).cast("int")
    return single if paired is None else F.when(paired, V3_ONE_PERFECT).otherwise(single)
