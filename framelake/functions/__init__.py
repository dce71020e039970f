"""Column expressions that operators share. Rounding is half to even throughout, as torch, numpy and Python round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def quantise(c: Column, levels: int = 255) -> Column:
    """Truncating quantisation of [0, 1]."""
    return F.floor(clamp(c, 0.0, 1.0) * levels).cast("int")


def quantise_up(c: Column, levels: int = 255) -> Column:
    """Ceiling quantisation, back in [0, 1]."""
    return F.ceil(c * levels) / F.lit(float(levels))


def balanced(c: Column) -> Column:
    """[0, 1] to [-1, 1]."""
    return (c - 0.5) / 0.5


def standardise(c: Column, mean: float, std: float) -> Column:
    return (c - mean) / std


# Channel means and deviations of the usual image statistics, R, G, B.
CHANNEL_STATISTICS = {"r": (0.485, 0.229), "g": (0.456, 0.224), "b": (0.406, 0.225)}


def even_down(c: Column) -> Column:
    return c - c % 2


def even_up(c: Column) -> Column:
    return c + c % 2


def bit_length(n: int) -> int:
    return int(n).bit_length()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def positional_encoding(c: Column, octaves: int) -> Column:
    """sin and cos of 2^k pi c for k below ``octaves``, sines and cosines by turns."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(octaves - 1)), lambda k: F.array(F.sin(F.pow(F.lit(2.0), k) * F.pi() * c), F.cos(F.pow(F.lit(2.0), k) * F.pi() * c))))


def rotary(even: Column, odd: Column, angle: Column) -> tuple[Column, Column]:
    """A pair of components turned by an angle."""
    return even * F.cos(angle) - odd * F.sin(angle), even * F.sin(angle) + odd * F.cos(angle)


def angle_rates(length: int, base: float = 10000.0) -> list[float]:
    """Angle per step of position for each pair of components of a vector that is ``length`` long: base^(-2i / length)."""
    return [base ** (-2.0 * i / length) for i in range(length // 2)]


def rotary_vector(vector: Column, position: Column, length: int, base: float = 10000.0) -> Column:
    """Each neighbouring pair of components turned by the angle of its position."""
    rates = F.array(*map(F.lit, angle_rates(length, base)))
    return F.flatten(F.transform(rates, lambda rate, i: F.array(*rotary(F.get(vector, i * 2), F.get(vector, i * 2 + 1), position * rate))))


def sinusoidal(position: Column, length: int, base: float = 10000.0) -> Column:
    """Encoding of a position: sine and cosine by turns, a pair for each rate."""
    rates = F.array(*map(F.lit, angle_rates(length, base)))
    return F.flatten(F.transform(rates, lambda rate: F.array(F.sin(position * rate), F.cos(position * rate))))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def swap_suffix(path: Column, new: str = ".npy") -> Column:
    return F.regexp_replace(path, r"\.(jpg|png)$", new)


def natural_key(path: Column) -> Column:
    """Sort key: the path's texts and numbers in turn, numbers by their value, then the path itself."""
    def part(p: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(p, r"(\d*)$", 1), "^0+", "")
        numbered = F.regexp_extract(p, r"(\d*)$", 1) != ""
        # A number without leading zeros is the greater the longer it is; a text at the end has none and comes first.
        return F.struct(F.regexp_extract(p, r"^(\D*)", 1).alias("text"), F.when(numbered, F.length(digits)).otherwise(-1).alias("digits"), digits.alias("number"))

    parts = F.filter(F.regexp_extract_all(path, F.lit(r"\D*\d*"), F.lit(0)), lambda p: p != "")
    return F.struct(F.transform(parts, part).alias("parts"), path.alias("whole"))


def last_digits_key(path: Column, digits: int = 4) -> Column:
    return F.right(stem(path), F.lit(digits)).cast("int")


def nested_map(value: Column, kind: T.DataType, f: Callable[[Column], Column]) -> Column:
    """``value`` of type ``kind`` with ``f`` applied to every leaf of its structs, arrays and maps' values; nulls of containers stay."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[nested_map(value[c.name], c.dataType, f).alias(c.name) for c in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: nested_map(x, kind.elementType, f))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: nested_map(x, kind.valueType, f))
    return f(value)
