"""Register words to numbers.

Every rule is one SQL expression over an array of words. A word that would make
a record unusable gives NULL: a missing or null word, or a 32-bit pair with a
word outside 16 bits. The signed 16-bit rule is the lenient one: a null or
oversized word is 0 there, and only a word that is missing altogether is NULL.

`u16`, `s16`, ... give Columns. The `*_sql` functions give the text, for
projections of hundreds of fields: one parse per field costs far less on the
driver than a chain of Column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.catalog import Field


def _pair_sql(r: str, hi: int, lo: int) -> str:
    h, low = f"get({r}, {hi})", f"get({r}, {lo})"
    return (f"CASE WHEN {h} BETWEEN 0 AND 65535 AND {low} BETWEEN 0 AND 65535 "
            f"THEN shiftleft(CAST({h} AS BIGINT), 16) | CAST({low} AS BIGINT) END")


def u16_sql(r: str, i: int) -> str:
    return f"CAST(get({r}, {i}) AS DOUBLE)"


def s16_sql(r: str, i: int) -> str:
    w = f"get({r}, {i})"
    return (f"CAST(CASE WHEN {w} BETWEEN 0 AND 65535 THEN ({w} ^ 32768) - 32768 "
            f"WHEN size({r}) > {i} THEN 0 END AS DOUBLE)")


def u32_sql(r: str, hi: int, lo: int) -> str:
    return f"CAST({_pair_sql(r, hi, lo)} AS DOUBLE)"


def s32_sql(r: str, hi: int, lo: int) -> str:
    return f"CAST(({_pair_sql(r, hi, lo)} ^ 2147483648) - 2147483648 AS DOUBLE)"


def bit_sql(r: str, i: int, n: int) -> str:
    return f"CAST(shiftright(get({r}, {i}), {n}) & 1 AS DOUBLE)"


def scale_sql(x: str, divisor: int, multiplier: int = 1) -> str:
    # Dividing matters: x / 10 and x * 0.1 are other doubles.
    x = x if divisor == 1 else f"{x} / {divisor}D"
    return x if multiplier == 1 else f"{x} * {multiplier}D"


def clamp_negative_sql(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN 0D ELSE {x} END"


def field_sql(r: str, f: Field) -> str:
    """The value of one catalogue field, given the registers of its block."""
    if f.kind == "bit":
        return bit_sql(r, f.offset, f.aux)
    raw = {"u16": u16_sql, "s16": s16_sql, "u32": u32_sql, "s32": s32_sql}[f.kind]
    value = scale_sql(raw(r, *f.words()), f.divisor, f.multiplier)
    return clamp_negative_sql(value) if f.clamp else value


def rule_sql(r: str, rule: str = "") -> str:
    """The value of a catalogue row (see `Catalog.fields_frame`) on a whole block.

    The row's numbers drive one formula for all kinds, so a mixed fleet decodes
    in one pass and the code stays small enough to be compiled.
    """
    word = f"get({r}, {rule}lo)"
    low = (f"CASE WHEN {rule}lenient AND NOT coalesce({word} BETWEEN 0 AND 65535, false) "
           f"THEN 0 ELSE {word} END")
    high = f"coalesce(get({r}, {rule}hi), 0)"
    joined = f"shiftleft(CAST({high} AS BIGINT), 16) | CAST({low} AS BIGINT)"
    signed = f"((shiftright({joined}, {rule}shift) & {rule}mask) ^ {rule}sign) - {rule}sign"
    value = f"CAST({signed} AS DOUBLE) / {rule}divisor * {rule}multiplier"
    return f"CASE WHEN {rule}floor > {value} THEN {rule}floor ELSE {value} END"


def u16(registers: str, i: int) -> Column:
    """The word as a double; a value beyond 16 bits passes unchanged."""
    return F.expr(u16_sql(registers, i))


def s16(registers: str, i: int) -> Column:
    """Two's complement of the word; 0 for a word that is null or beyond 16 bits."""
    return F.expr(s16_sql(registers, i))


def u32(registers: str, hi: int, lo: int) -> Column:
    """Unsigned 32 bits from a high and a low word."""
    return F.expr(u32_sql(registers, hi, lo))


def s32(registers: str, hi: int, lo: int) -> Column:
    """Signed 32 bits from a high and a low word."""
    return F.expr(s32_sql(registers, hi, lo))


def bit(registers: str, i: int, n: int) -> Column:
    """Bit n of word i as 0.0 or 1.0."""
    return F.expr(bit_sql(registers, i, n))


def scale(x: Column, divisor: int, multiplier: int = 1) -> Column:
    """Divide, then multiply."""
    x = x / F.lit(float(divisor))
    return x if multiplier == 1 else x * F.lit(float(multiplier))


def clamp_negative(x: Column) -> Column:
    return F.when(x < 0, 0.0).otherwise(x)
