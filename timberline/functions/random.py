"""Counter-based random numbers: a 64-bit mixer over row keys, so that draws don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) with 52 bits, from an MD5 of seed and key: equal on every engine that has MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def normal(key: Column, seed: int = 0) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    u = 1 - uniform(key, 2 * seed)
    return F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * uniform(key, 2 * seed + 1))


# --- the 64-bit counter generator --------------------------------------------------------------------------------

#: Increment and multipliers of splitmix64 (fixed values).
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_LOW = 0xFFFFFFFF


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _signed(n: int) -> int:
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def _add(x: Column, y: Column) -> Column:
    """The sum modulo 2**64, in halves, so that nothing overflows."""
    low = x.bitwiseAND(_LOW) + y.bitwiseAND(_LOW)
    high = F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftright(low, 32)
    return F.shiftleft(high.bitwiseAND(_LOW), 32).bitwiseOR(low.bitwiseAND(_LOW))


def _times(x: Column, c: int) -> Column:
    """The product with a constant modulo 2**64, by pieces of 16 bits of x."""
    high, low = c >> 32, c & _LOW
    a0, a1 = x.bitwiseAND(0xFFFF), F.shiftrightunsigned(x, 16).bitwiseAND(0xFFFF)
    b0, b1 = F.shiftrightunsigned(x, 32).bitwiseAND(0xFFFF), F.shiftrightunsigned(x, 48)
    cross = a0 * high + F.shiftleft((a1 * high).bitwiseAND(0xFFFF), 16) + b0 * low + F.shiftleft((b1 * low).bitwiseAND(0xFFFF), 16)
    return _add(_add(a0 * low, F.shiftleft(a1 * low, 16)), F.shiftleft(cross.bitwiseAND(_LOW), 32))


def splitmix64(state: Column) -> Column:
    """The mixer on 64-bit integers, as bigint with the same bits."""
    z = _add(state.cast("bigint"), F.lit(_signed(GOLDEN)))
    z = _let(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30)))
    z = _let(z, lambda v: _times(v, MIX_A))
    z = _let(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27)))
    z = _let(z, lambda v: _times(v, MIX_B))
    return _let(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def mixed(state: int) -> int:
    """The mixer on a Python number."""
    m = (1 << 64) - 1
    z = state + GOLDEN & m
    z = (z ^ z >> 30) * MIX_A & m
    z = (z ^ z >> 27) * MIX_B & m
    return z ^ z >> 31


def counter_uniform(stream: int, counter: Column) -> Column:
    """A number in [0, 1) with 53 bits, for every counter of a stream."""
    return F.shiftrightunsigned(splitmix64(_add(F.lit(_signed(stream)), counter.cast("bigint"))), 11).cast("double") / float(1 << 53)


def bag_stream(seed: int, bag: int) -> int:
    """Where the draws of a bag start."""
    return mixed((seed & (1 << 63) - 1) ^ (bag * GOLDEN & (1 << 64) - 1))
