"""64-bit mixing hashes as JVM-side BIGINT arithmetic.

A hash is held as the signed BIGINT with its bit pattern. Spark's ANSI mode rejects a
wrapping multiply, so products are put together from 16-bit limbs that never overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the hash functions.
MULTIPLY_1 = 0xBF58476D1CE4E5B9
MULTIPLY_2 = 0x94D049BB133111EB
SALT_B = 0xDEADBEEFCAFE
SALT_STEP = 0x517CC1B727220A95

_LOW = 0xFFFFFFFF


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _low_product(a: Column, c: int) -> Column:
    """The low 32 bits of a 32-bit number times a 32-bit constant."""
    return (a * (c & 0xFFFF) + F.shiftleft((a * (c >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW)


def multiply(x: Column, c: int) -> Column:
    """x * c modulo 2^64 for a BIGINT bit pattern and an unsigned constant."""
    low, high = x.bitwiseAND(_LOW), F.shiftrightunsigned(x, 32)
    c_low, c_high = c & _LOW, c >> 32
    p0, p1 = low * (c_low & 0xFFFF), low * (c_low >> 16)
    start = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16)
    top = F.shiftrightunsigned(start, 32) + F.shiftrightunsigned(p1, 16) + _low_product(low, c_high) + _low_product(high, c_low)
    return F.shiftleft(top.bitwiseAND(_LOW), 32).bitwiseOR(start.bitwiseAND(_LOW))


def with_hash64(df: DataFrame, source: Column | str, name: str, salt: int = 0) -> DataFrame:
    """Adds the hash of a BIGINT key (xor salt). Each step is a column, so no step is worked out twice."""
    x = F.col(source) if isinstance(source, str) else source
    steps = [(30, MULTIPLY_1), (27, MULTIPLY_2)]
    df = df.withColumn("_h", x.cast("bigint").bitwiseXOR(F.lit(signed(salt))))
    for k, (shift, c) in enumerate(steps):
        df = df.withColumn("_h", F.col("_h").bitwiseXOR(F.shiftrightunsigned("_h", shift)))
        df = df.withColumn("_h", multiply(F.col("_h"), c))
    return df.withColumn(name, F.col("_h").bitwiseXOR(F.shiftrightunsigned("_h", 31))).drop("_h")


def _folded(shift: int):
    return lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift))


def _times(c: int):
    return lambda v: multiply(v, c)


def hash64(x: Column, salt: int = 0) -> Column:
    """The hash of a BIGINT (xor salt) as one expression that names no step twice.

    Steps are bound by lambdas, so a filter on the hash that is pushed below the projection
    stays small; where no filter is, with_hash64 is faster.
    """
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    h = x.cast("bigint").bitwiseXOR(F.lit(signed(salt)))
    for shift, c in ((30, MULTIPLY_1), (27, MULTIPLY_2)):
        h = bound(h, _folded(shift))
        h = bound(h, _times(c))
    return bound(h, _folded(31))


def with_hash64b(df: DataFrame, source: Column | str, name: str) -> DataFrame:
    return with_hash64(df, source, name, SALT_B)


def nth_hash(h1: Column, h2: Column, i: int) -> Column:
    """h1 + i * h2 modulo 2^64 (for small i >= 0)."""
    add = multiply(h2, i)
    low = h1.bitwiseAND(_LOW) + add.bitwiseAND(_LOW)
    high = F.shiftrightunsigned(h1, 32) + F.shiftrightunsigned(add, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(_LOW), 32).bitwiseOR(low.bitwiseAND(_LOW))


def unsigned_mod(x: Column, n: Column | int) -> Column:
    """The unsigned value of a bit pattern modulo a positive number below 2^31."""
    return ((F.shiftrightunsigned(x, 1) % n) * 2 + x.bitwiseAND(1)) % n


def unsigned_text(x: Column) -> Column:
    wide = x.cast("decimal(20,0)")
    return F.when(x < 0, wide + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)").cast("string")


def partition_of(h: Column, partitions: int = 32) -> Column:
    """The memtable partition of a hash: its low bits."""
    return h.bitwiseAND(partitions - 1)
