"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def voiced(f0: str | Column) -> Column:
    """Voiced for resampling and trimming: known and above 0 Hz."""
    return F.coalesce(col(f0) > 0, F.lit(False))


def sounded(f0: str | Column) -> Column:
    """Voiced for inspection: known and not 0 Hz."""
    return F.coalesce(col(f0) != 0, F.lit(False))


def token_key(x: str | Column) -> Column:
    """Key for matching tokens across tables: the last extension off, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(x), r"([^.]+)\.[A-Za-z0-9]+$", "$1")))


def semitones(f0: str | Column, base: str | Column) -> Column:
    """12 log2(f0 / base); null where the quotient is not positive."""
    q = F.try_divide(col(f0), col(base))
    return F.when(q > 0, 12 * F.log2(q))


def split_parts(x: str | Column, separator: str, n: int) -> list[Column]:
    """The first n parts of a text at a literal separator; null beyond the last."""
    parts = F.split(col(x), r"\Q" + separator + r"\E", -1)
    return [F.get(parts, i) for i in range(n)]


def round_half_even(x: Column) -> Column:
    return F.rint(x)


#: Names of level contours by digit.
LEVEL_NAMES = {1: "low level", 2: "mid-low level", 3: "mid level", 4: "mid-high level", 5: "high level"}


def classify_contour(digits: str | Column) -> Column:
    """Shape of a string of tone digits: a level, dipping, peaking, rising, falling; one digit is ``level``."""
    d = F.transform(F.filter(F.split(col(digits), ""), lambda x: x != ""), lambda x: x.cast("int"))
    n, first, last = F.size(d), F.get(d, F.lit(0)), F.element_at(d, -1)
    inner = F.slice(d, F.lit(2), F.greatest(n - 2, F.lit(0)))
    named = F.lit("level")
    for value, name in LEVEL_NAMES.items():
        named = F.when(first == value, name).otherwise(named)
    ends_low, ends_high = F.least(first, last), F.greatest(first, last)
    return (
        F.when(n < 2, "level")
        .when(F.array_min(d) == F.array_max(d), named)
        .when((n >= 3) & (F.array_min(inner) < ends_low), "dipping")
        .when((n >= 3) & (F.array_max(inner) > ends_high), "peaking")
        .when(last > first, "rising")
        .otherwise("falling")
    )


# Letter classes of phonetic labels.
SYLLABIC_MARKS = "[̩̍]"
LENGTH_MARKS = "[ːˑˈˌ˞]"
TONE_LETTERS = "[˥-˩‿⁀]"
TONE_DIGITS = "[0-9¹²³⁰-⁹]"
VOWELS = (
    "aeiouyAEIOUY@æÆøØœŒɶɐɑɒɔɘəɚɛɜɝɞ"
    "ɤɨɪɯɵʉʊʌʏᵻᵿÀ-ÆÈ-ÏÒ-ÖØ-Ý"
    "à-æè-ïò-öø-ýÿĀ-ąĒ-ěĨ-ıŌ-őŨ-ų"
    "Ŷ-ŸǍ-ǜǞ-ǡǪ-ǭǺ-ǿȲȳ"
)
GLIDES = "jwɥJW"
NASALS = "mnŋɱɲɳɴMN"


def is_vowel_label(x: str | Column) -> Column:
    """Whether a phonetic label is a syllable nucleus: vowels, perhaps with glides, or nasals marked as syllabic."""
    s = col(x)
    marked = s.rlike(SYLLABIC_MARKS)
    for pattern in (r"\p{Mn}", LENGTH_MARKS, TONE_LETTERS, TONE_DIGITS, r"\s+"):
        s = F.regexp_replace(s, pattern, "")
    vowel = s.rlike(f"^[{VOWELS}{GLIDES}]+$") & s.rlike(f"[{VOWELS}]")
    return F.coalesce(vowel | (marked & s.rlike(f"^[{NASALS}]+$")), F.lit(False))


def legendre(x: Column, degree: int) -> list[Column]:
    """P0 .. P_degree at x by the three-term recurrence."""
    p = [F.lit(1.0), x]
    for n in range(1, degree):
        p.append(((2 * n + 1) * x * p[n] - n * p[n - 1]) / (n + 1))
    return p[: degree + 1]


def cosine_rows(n: int, rows: int) -> list[list[float]]:
    """The first rows of the cosine basis cos(pi/n (j + 1/2) k)."""
    return [[math.cos(math.pi / n * (j + 0.5) * k) for j in range(n)] for k in range(rows)]


def notes(*parts: Column) -> Column:
    """Notes in a fixed order with "; " between them; nulls are left out."""
    return F.concat_ws("; ", *parts)


def fixed(x: Column, digits: int) -> Column:
    """A number as text with so many digits behind the point, rounded by its exact value, halves to even.

    The product with the power of ten is rounded by itself, so what it lost decides where it lies just between two numbers.
    """
    x, scale = x.cast("double"), float(10**digits)
    wide = x * float((1 << 27) + 1)
    high = wide - (wide - x)
    product = x * scale
    lost = (high * scale - product) + (x - high) * scale
    low = F.floor(product)
    between = product - low == 0.5
    whole = F.when(between & (lost > 0), low + 1.0).when(between & (lost < 0), low.cast("double")).otherwise(F.rint(product))
    return F.format_string(f"%.{digits}f", whole / scale)


def scaled_text(values: Column) -> Column:
    """``2.00 -> 4.10`` for an array of scaled values."""
    return F.array_join(F.transform(values, lambda v: fixed(v, 2)), " → ")


def near_boundary(values: Column, tolerance: float = 0.1) -> Column:
    """Whether any value lies within the tolerance of a digit boundary (1.5, 2.5, 3.5, 4.5)."""
    return F.exists(values, lambda v: F.least(*(F.abs(v - b) for b in (1.5, 2.5, 3.5, 4.5))) <= tolerance)


# Coefficients of Cody's rational approximations to erf and erfc (1969), numerators and denominators by range.
ERF_SMALL = ((1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03), (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03))
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03),
    (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
ERFC_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
INVERSE_ROOT_PI = 0.5641895835477563


def _ratio(x: Column, parts) -> Column:
    """A quotient of two polynomials, highest powers first."""
    values = []
    for coefficients in parts:
        value = F.lit(coefficients[0])
        for c in coefficients[1:]:
            value = value * x + c
        values.append(value)
    return values[0] / values[1]


def erfc(x: Column) -> Column:
    """Complementary error function, to about 1e-15 of its value."""
    y, square = F.abs(x), x * x
    tail = F.exp(-square)
    inverse = F.lit(1.0) / F.greatest(square, F.lit(1.0))
    upper = F.when(y <= 4, tail * _ratio(F.least(y, F.lit(4.0)), ERFC_MIDDLE)).otherwise(tail / F.greatest(y, F.lit(1.0)) * (INVERSE_ROOT_PI - inverse * _ratio(inverse, ERFC_LARGE)))
    small = F.least(square, F.lit(1.0))
    return F.when(y <= 0.46875, 1 - x * _ratio(small, ERF_SMALL)).when(x >= 0, upper).otherwise(2 - upper)


def normal_mass(low: Column, high: Column, mean: Column, sd: Column) -> Column:
    """Probability between two bounds under a normal distribution."""
    below = lambda x: 0.5 * erfc((mean - x) / (sd * 1.4142135623730951))
    return below(high) - below(low)
