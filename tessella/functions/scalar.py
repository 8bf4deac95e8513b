"""Scalar expressions of the object and trace tables, all as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_header(name: str) -> str:
    """Column name of a text table's header token."""
    return name.translate(str.maketrans("(),", "___"))


def fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def capitals(c: Column) -> Column:
    return F.upper(c)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit("." + ext))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def letters_to_number(c: Column) -> Column:
    """A as 1, Z as 26, AA as 27: column letters as a base-26 number."""
    digits = F.transform(F.split(F.upper(c), ""), lambda x: F.when(x == "", F.lit(None)).otherwise(F.ascii(x) - 64))
    return F.aggregate(F.filter(digits, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, x: a * 26 + x)


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)))


def city_block(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))


def gaussian(squared: Column, sigma: float) -> Column:
    return F.exp(-squared / (2 * sigma * sigma))


def angle(u: list[Column], v: list[Column]) -> Column:
    """Degrees between two directions, 0 to 180; 0 if one has no length."""
    dot = sum(p * q for p, q in zip(u, v, strict=True))
    size = F.sqrt(sum(p * p for p in u)) * F.sqrt(sum(q * q for q in v))
    return F.when(size > 0, F.degrees(F.acos(F.least(F.greatest(dot / size, F.lit(-1.0)), F.lit(1.0))))).otherwise(F.lit(0.0))


def azimuth(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def elevation(dx: Column, dy: Column, dz: Column) -> Column:
    return F.degrees(F.atan2(dz, F.sqrt(dx * dx + dy * dy)))


def normal(u: list[Column], v: list[Column]) -> list[Column]:
    """Cross product."""
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def rall_power(parent: Column, first: Column, second: Column, tolerance: float = 0.001) -> Column:
    """The smallest power among 0.001, 0.002 .. 5 at which the parent's equals the sum of the daughters' within the tolerance; -1 without one.

    Powers are dropped in blocks of 500, 50 and 5 where the terms at a block's ends leave no room for a fit; only the others are tried.
    """
    bases, apart = (parent, first, second), lambda p, a, b: p - a - b

    signed = (parent < 0) | (first < 0) | (second < 0)  # not monotonic

    def may_fit(block: Column) -> Column:
        """Whether a power of the block can fit: each term lies between those of the two ends."""
        ends = [(block[f"low{n}"], block[f"high{n}"]) for n in range(3)]
        least, most = ([f(*e) for e in ends] for f in (F.least, F.greatest))
        slack = tolerance + 1e-12 * sum(most)
        return ~((apart(least[0], *most[1:]) > slack) | (apart(most[0], *least[1:]) < -slack))

    def blocks(of: Column, width: int, within: int) -> Column:
        # Powers are fields, since an expression that stands twice in a function of an array is evaluated twice.
        powers = lambda k: [F.pow(c, (k + d) / 1000.0).alias(f"{end}{n}") for n, c in enumerate(bases) for end, d in (("low", 0), ("high", width - 1))]
        parts = F.flatten(F.transform(of, lambda k: F.sequence(k, k + (within - width), F.lit(width))))
        told = F.transform(parts, lambda k: F.struct(k.alias("k"), *powers(k)))
        return F.filter(told, lambda t: signed | may_fit(t)).getField("k")

    fits = lambda k: F.abs(apart(*(F.pow(c, k / 1000.0) for c in bases))) <= tolerance
    in_block = lambda k: F.get(F.filter(F.sequence(k, k + 4), fits), F.lit(0))
    left = blocks(blocks(blocks(F.array(F.lit(1)), 500, 5000), 50, 500), 5, 50)
    # Blocks are in order, and those after the first power that fits are not looked into.
    power = F.aggregate(left, F.lit(None).cast("int"), lambda found, k: F.when(found.isNotNull(), found).otherwise(in_block(k)))
    return F.coalesce(power / 1000.0, F.lit(-1.0))


def pk(parent: Column, first: Column, second: Column, n: float) -> Column:
    return (F.pow(first, F.lit(n)) + F.pow(second, F.lit(n))) / F.pow(parent, F.lit(n))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def rescale(c: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    return to_low + (to_high - to_low) * (c - low) / (high - low)


def sigmoid(c: Column, alpha: float, beta: float, low: float = 0.0, high: float = 1.0) -> Column:
    return low + (high - low) / (1 + F.exp(-(c - beta) / alpha))


def inverted(c: Column, top: float) -> Column:
    return top - c


def threshold(c: Column, low: float, high: float, inside: float, outside: float) -> Column:
    return F.when(c.between(low, high), F.lit(inside)).otherwise(F.lit(outside))


def plane_angle(u: list[Column], v: list[Column], p: list[Column], q: list[Column]) -> Column:
    """Degrees between the plane of u and v and that of p and q."""
    return angle(normal(u, v), normal(p, q))


def k_smallest(values: Column, k: int) -> Column:
    return F.slice(F.array_sort(values), 1, k)


def k_largest(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def time_stamp(c: Column) -> Column:
    """A time as text that sorts and may stand in file names."""
    return F.date_format(c, "yyyy_MM_dd_HH_mm_ss")


def parts_of(c: Column, delimiter: str) -> Column:
    """Pieces of a text between a delimiter, empty ones left out."""
    return F.filter(F.split(c, "\\Q" + delimiter + "\\E"), lambda x: x != "")


def gaussian_noise(mean: float, sd: float, seed: int) -> Column:
    """A normal random number for each row."""
    return mean + sd * F.randn(seed)
