"""Host metric conversions, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_SERIAL = "00000000"       # Fixed value: a host whose lines name no serial.
UNREADABLE_SERIAL = "ERROR0000"   # Fixed value: a host whose lines could not be read.


def _two_digits(size: Column, bits: int) -> Column:
    # Halves to even, in whole numbers: exact for any size, and unlike `bround`
    # it needs no decimal object per value.
    hundredths = size.cast("bigint") * 100
    below = F.shiftright(hundredths, bits)
    rest, half = hundredths - F.shiftleft(below, bits), 1 << (bits - 1)
    up = (rest > half) | ((rest == half) & (below % 2 == 1))
    return (below + up.cast("bigint")) / F.lit(100.0)


def to_mib(size: Column) -> Column:
    """Bytes to MiB, two digits, halves to even."""
    return _two_digits(size, 20)


def to_gib(size: Column) -> Column:
    """Bytes to GiB, two digits, halves to even."""
    return _two_digits(size, 30)


def cpu_temp(raw: Column) -> Column:
    """`temp=48.3'C` to 48.3; NULL where no number is left."""
    number = F.replace(F.replace(raw, F.lit("temp=")), F.lit("'C"))
    return number.try_cast("double")
