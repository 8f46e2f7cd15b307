"""Driver catalogue: what to read from a device and how to name and scale it.

The catalogue is data. Adding a device type is `register_driver(...)`: it adds
rows and changes no code. The catalogue lives on the driver and travels to the
executors as two small tables (`blocks_frame`, `fields_frame`) or as generated
Column expressions.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from helioframe.catalog import register_maps

KINDS = ("u16", "s16", "u32", "s32", "bit")
DIVISORS = (1, 10, 100, 1000)


@dataclass(frozen=True)
class Field:
    """One telemetry value: where its word is and how to scale it.

    `aux` is the low word of a 32-bit kind, the bit number of a `bit`, else None.
    """

    name: str
    kind: str
    block: int
    offset: int
    aux: int | None = None
    divisor: int = 1
    multiplier: int = 1
    clamp: bool = False

    def words(self) -> tuple[int, ...]:
        return (self.offset, self.aux) if self.kind in ("u32", "s32") else (self.offset,)


@dataclass(frozen=True)
class Block:
    """One register block; `accept` is a SQL predicate over `registers`."""

    block: int
    kind: str
    start: int
    count: int
    accept: str | None = None


@dataclass(frozen=True)
class Driver:
    name: str
    label: str
    version: str
    max_attempts: int
    blocks: tuple[Block, ...]
    fields: tuple[Field, ...]

    def block_numbers(self) -> list[int]:
        return sorted(b.block for b in self.blocks)

    def check(self) -> "Driver":
        counts = {b.block: b.count for b in self.blocks}
        names = [f.name for f in self.fields]
        if len(counts) != len(self.blocks) or len(set(names)) != len(names):
            raise ValueError(f"{self.name}: block numbers and field names must be unique")
        if any(not 0 <= k <= 62 for k in counts):
            raise ValueError(f"{self.name}: block numbers go from 0 to 62")
        for f in self.fields:
            if f.kind not in KINDS or f.divisor not in DIVISORS:
                raise ValueError(f"{self.name}.{f.name}: unknown kind or divisor")
            if any(not 0 <= w < counts.get(f.block, 0) for w in f.words()):
                raise ValueError(f"{self.name}.{f.name}: word outside block {f.block}")
            if f.kind == "bit" and not 0 <= f.aux <= 15:
                raise ValueError(f"{self.name}.{f.name}: bit outside a 16-bit word")
        return self


_BLOCKS_SCHEMA = pa.schema([
    ("driver", pa.string()), ("block", pa.int32()), ("kind", pa.string()),
    ("start", pa.int32()), ("count", pa.int32()), ("max_attempts", pa.int32()),
    ("accept", pa.string()), ("n_blocks", pa.int32()), ("min_size", pa.int32()),
    ("present", pa.list_(pa.int32())), ("paired", pa.list_(pa.int32())),
])
# A rule in numbers: value = ((hi << 16 | lo) >> shift & mask), its sign bit
# unfolded, / divisor * multiplier, not below floor. `lenient` takes a bad word as 0.
_RULE = [("field", pa.string()), ("kind", pa.string()), ("block", pa.int32()),
         ("hi", pa.int32()), ("lo", pa.int32()), ("shift", pa.int32()), ("mask", pa.int64()),
         ("sign", pa.int64()), ("lenient", pa.bool_()), ("divisor", pa.float64()),
         ("multiplier", pa.float64()), ("floor", pa.float64())]
_FIELDS_SCHEMA = pa.schema([("driver", pa.string()), *_RULE])
# The same per driver, for records: `key` is the name as JSON text, `slot` the
# place of the block in `block_numbers()`. Bits need less and are kept apart.
_VALUE = [("key", pa.string()), ("slot", pa.int32()), *_RULE[3:]]
_BIT = [("key", pa.string()), ("slot", pa.int32()), ("lo", pa.int32()), ("shift", pa.int32())]
_RULES_SCHEMA = pa.schema([("driver", pa.string()), ("numbers", pa.list_(pa.struct(_VALUE))),
                           ("bits", pa.list_(pa.struct(_BIT)))])
_VERSIONS_SCHEMA = pa.schema([
    ("driver", pa.string()), ("label", pa.string()), ("version", pa.string()),
])


@dataclass(frozen=True)
class Catalog:
    """An immutable set of drivers, keyed by the name a registry uses."""

    drivers: dict[str, Driver] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Driver:
        return self.drivers[name]

    def __iter__(self):
        return iter(self.drivers.values())

    def block_numbers(self) -> list[int]:
        return sorted({b.block for d in self for b in d.blocks})

    def only(self, *names: str) -> "Catalog":
        return Catalog({n: self.drivers[n] for n in names})

    def register_driver(self, name: str, version: str, blocks, fields, *,
                        label: str | None = None, max_attempts: int = 3) -> "Catalog":
        """Return a catalogue that also knows the driver `name`."""
        driver = Driver(name, label or name, version, max_attempts,
                        tuple(blocks), tuple(fields)).check()
        return Catalog({**self.drivers, name: driver})

    def with_tries(self, name: str, max_attempts: int) -> "Catalog":
        """Return a catalogue where `name` is tried `max_attempts` times per block."""
        return Catalog({**self.drivers,
                        name: replace(self.drivers[name], max_attempts=max_attempts)})

    # Arrow tables become local relations, so Catalyst knows their exact size.

    def blocks_frame(self, spark: SparkSession) -> DataFrame:
        """One row per (driver, block), with what a block must hold to be whole.

        `min_size` words have to exist, the words in `present` may not be null,
        and the words in `paired` have to fit 16 bits as they form 32-bit values.
        """
        rows = []
        for d in self:
            need = defaultdict(lambda: (set(), set(), set()))
            for f in d.fields:
                size, present, paired = need[f.block]
                size.update(f.words())
                if f.kind in ("u16", "bit"):
                    present.update(f.words())
                elif f.kind in ("u32", "s32"):
                    paired.update(f.words())
            for b in d.blocks:
                size, present, paired = need[b.block]
                rows.append((d.name, b.block, b.kind, b.start, b.count, d.max_attempts, b.accept,
                             len(d.blocks), max(size, default=-1) + 1,
                             sorted(present), sorted(paired)))
        return _frame(spark, rows, _BLOCKS_SCHEMA)

    def fields_frame(self, spark: SparkSession) -> DataFrame:
        """One row per (driver, field), its rule in numbers."""
        return _frame(spark, [(d.name, *_rule(f)) for d in self for f in d.fields],
                      _FIELDS_SCHEMA)

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        """One row per driver with all its rules in record order."""
        slots = {k: i for i, k in enumerate(self.block_numbers())}

        def entry(f: Field) -> dict:
            return {"key": json.dumps(f.name) + ":", "slot": slots[f.block],
                    **dict(zip([name for name, _ in _RULE], _rule(f)))}

        return _frame(spark, [
            (d.name, *[[{name: entry(f)[name] for name, _ in columns} for f in d.fields
                        if (f.kind == "bit") == bits] for columns, bits in ((_VALUE, False), (_BIT, True))])
            for d in self], _RULES_SCHEMA)

    def versions_frame(self, spark: SparkSession) -> DataFrame:
        """One row per driver with its label and version."""
        return _frame(spark, [(d.name, d.label, d.version) for d in self], _VERSIONS_SCHEMA)


def _rule(f: Field) -> tuple:
    wide = f.kind in ("u32", "s32")
    hi, lo = f.words() if wide else (None, f.offset)
    shift = f.aux if f.kind == "bit" else 0
    mask = {"bit": 1, "u16": -1, "s16": 0xFFFF, "u32": 0xFFFFFFFF, "s32": 0xFFFFFFFF}[f.kind]
    sign = {"s16": 1 << 15, "s32": 1 << 31}.get(f.kind, 0)
    return (f.name, f.kind, f.block, hi, lo, shift, mask, sign, f.kind == "s16",
            float(f.divisor), float(f.multiplier), 0.0 if f.clamp else None)


def _frame(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return spark.createDataFrame(
        pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema))


def _numeric_fields(text: str) -> list[Field]:
    fields = []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, kind, block, word, *rest = line.split()
        words = [int(w) for w in word.split(",")]
        scale = {r[0]: int(r[1:]) for r in rest if r[0] in "/*"}
        fields.append(Field(name, kind, int(block), words[0], words[1] if words[1:] else None,
                            scale.get("/", 1), scale.get("*", 1), "clamp" in rest))
    return fields


def _bit_fields(words: list[tuple[int, int, str, str]]) -> list[Field]:
    return [Field(prefix + name, "bit", block, word, bit)
            for block, word, prefix, names in words
            for bit, name in enumerate(names.split()) if name != "-"]


def _built_in() -> Catalog:
    blocks = defaultdict(list)
    for name, block, kind, start, count in map(str.split, register_maps.BLOCKS.strip().splitlines()):
        accept = register_maps.ACCEPT.get((name, int(block)))
        blocks[name].append(Block(int(block), kind, int(start), int(count), accept))
    catalog = Catalog()
    for name, label, version, tries in map(str.split, register_maps.DRIVERS.strip().splitlines()):
        fields = (_numeric_fields(register_maps.FIELDS[name])
                  + _bit_fields(register_maps.STATUS_WORDS.get(name, [])))
        catalog = catalog.register_driver(name, version, blocks[name], fields,
                                          label=label, max_attempts=int(tries))
    return catalog


CATALOG = _built_in()
register_driver = CATALOG.register_driver
