"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is zero; within -1 and 1."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def known_cosine(a: Column, b: Column) -> Column:
    """The cosine over the places of the first vector, nulls as zeros, within -1 and 1; null if a norm is zero."""
    value = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    pairs = F.zip_with(a, F.slice(b, F.lit(1), F.size(a)), lambda x, y: F.struct(value(x).alias("x"), value(y).alias("y")))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("xy", "xx", "yy")))
    add = lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"))

    def finish(s: Column) -> Column:
        size = F.sqrt(s["xx"] * s["yy"])
        return F.when(size != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["xy"] / size)))

    return F.aggregate(pairs, zero, add, finish)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for empty vectors, vectors of different lengths and zero vectors."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(usable, 1 - cosine(a, b)).otherwise(F.lit(1.0))


def signature_match(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def hop_confidence(hops: Column) -> Column:
    return F.greatest(F.lit(0.5), 0.9 - 0.05 * (hops - 1))


def band_hash(values: Column) -> Column:
    """FNV-1a over the little-endian bytes of 32-bit values, as hexadecimal digits; products modulo 2^64 by halves of 32 bits in decimals."""
    two32, two64 = "4294967296", "18446744073709551616"
    dec = "decimal(38,0)"
    state = F.struct(F.lit(0xCBF29CE4).cast(dec).alias("hi"), F.lit(0x84222325).cast(dec).alias("lo"))
    data = F.flatten(F.transform(values, lambda v: F.array(*(F.shiftrightunsigned(v, 8 * k).bitwiseAND(F.lit(255)) for k in range(4)))))

    def step(s: Column, byte: Column) -> Column:
        low = s["lo"].cast("long").bitwiseXOR(byte).cast(dec)
        # The prime is 2^40 + 0x1B3: (hi 2^32 + low) times it, cut to 64 bits.
        product = low * F.lit(0x1B3).cast(dec) + (low * F.lit(256).cast(dec) % F.lit(two32).cast(dec) + s["hi"] * F.lit(0x1B3).cast(dec)) % F.lit(two32).cast(dec) * F.lit(two32).cast(dec)
        cut = product.cast(dec) % F.lit(two64).cast(dec)
        return F.struct(F.floor(cut / F.lit(two32).cast(dec)).cast(dec).alias("hi"), (cut % F.lit(two32).cast(dec)).cast(dec).alias("lo"))

    return F.aggregate(data, state, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"].cast("long")), 8, "0"), F.lpad(F.hex(s["lo"].cast("long")), 8, "0"))))
