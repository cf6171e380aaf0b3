"""Sequence functions over array columns, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols whose matches fit in a long's bits, with room for a carry.
MOST_BITS = 60


def match_masks(b: Column) -> Column:
    """(symbols, masks): the distinct symbols of ``b`` with a bit for each of their places; null for more than ``MOST_BITS`` symbols."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    places = lambda s: F.transform(b, lambda y, i: F.when(y == s, F.call_function("shiftleft", one, i)).otherwise(none))
    symbols = F.array_distinct(b)
    masks = F.transform(symbols, lambda s: F.aggregate(places(s), none, lambda x, m: x.bitwiseOR(m)))
    return F.when(F.size(b) <= MOST_BITS, F.struct(symbols.alias("symbols"), masks.alias("masks")))


def matches(a: Column, masks: Column) -> Column:
    """For each symbol of ``a`` the places where another sequence has it, by the other's ``match_masks``."""
    return F.transform(a, lambda x: F.coalesce(F.get(masks["masks"], (F.array_position(masks["symbols"], x) - 1).cast("int")), F.lit(0).cast("long")))


def _lcs_steps(found: Column, b: Column) -> Column:
    """Longest common subsequence by bit vectors: a bit for each place of ``b``, a step for each of ``matches``."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(b)) - 1
    step = lambda v, here: (v + v.bitwiseAND(here)).bitwiseOR(v.bitwiseAND(F.bitwise_not(here))).bitwiseAND(full)
    return F.size(b) - F.bit_count(F.aggregate(found, full, step)).cast("int")


def _lcs_bits(a: Column, b: Column) -> Column:
    return _lcs_steps(matches(a, match_masks(b)), b)


def _lcs_rows(a: Column, b: Column) -> Column:
    """The same by rows of the table of prefixes, for sequences of any length."""
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: F.lit(0))

    def step(row: Column, x: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            best = F.when(F.get(b, j - 1) == x, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(new, -1)))
            return F.concat(new, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(a, zero, step), -1)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays; 0 where one is empty, null where one is null."""
    return F.when(F.size(a) * F.size(b) == 0, F.lit(0)).when(F.size(b) <= MOST_BITS, _lcs_bits(a, b)).otherwise(_lcs_rows(a, b))


def normaliser(a: Column, b: Column) -> Column:
    return F.greatest(F.size(a), F.size(b))


def without_self(score: Column) -> Column:
    """A score less the match of the gene with itself, which both landscapes hold."""
    return F.when(score >= 1, score - 1).otherwise(score)


def lcs_score(a: Column, b: Column, found: Column | None = None) -> Column:
    """The better of forward and reversed common subsequence, less the self match, over the longer length, as FLOAT.

    found: ``matches`` of ``a`` in ``b``, where they are at hand; a reversed ``b`` has as much in common with ``a`` as ``b`` with a reversed ``a``.
    """
    any_length = F.greatest(lcs_length(a, b), lcs_length(a, F.reverse(b)))
    if found is not None:
        any_length = F.when(F.size(a) * F.size(b) == 0, F.lit(0)).when(F.size(b) <= MOST_BITS, F.greatest(_lcs_steps(found, b), _lcs_steps(F.reverse(found), b))).otherwise(F.greatest(_lcs_rows(a, b), _lcs_rows(a, F.reverse(b))))
    best = without_self(any_length).cast("float")
    return F.when(F.size(a) == 0, F.lit(0.0).cast("float")).otherwise((best / normaliser(a, b).cast("float")).cast("float"))


def run_lengths(seq: Column) -> Column:
    """Runs of equal neighbours as array<struct<sym, w>>; an empty array has none; nulls are equal."""
    breaks = F.filter(F.sequence(F.lit(1), F.size(seq)), lambda i: (i == 1) | ~F.element_at(seq, i).eqNullSafe(F.get(seq, i - 2)))
    ends = F.concat(F.slice(breaks, 2, F.size(breaks)), F.array(F.size(seq) + 1))
    return F.when(F.size(seq) == 0, F.expr("array()")).otherwise(F.zip_with(breaks, ends, lambda s, e: F.struct(F.element_at(seq, s).alias("sym"), (e - s).alias("w"))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """The share of the union that ``a`` has; not symmetric."""
    return F.size(F.array_distinct(a)) / F.size(F.array_union(a, b))


def round_half_up(x: Column, digits: int) -> Column:
    """Half away from zero for values that are not negative; a billionth makes up for the order of sums."""
    return F.floor(x * 10**digits + 0.5 + 1e-9) / 10**digits
