"""The 32-bit FNV-1a hash of each group's entries, joined by a byte, over parts of a group that are hashed apart.

A byte takes a state h to (h ^ byte) * PRIME modulo 2**32: it changes the lowest byte alone and PRIME carries the rest on. So a
text takes any state h to (h - h % 256) * factor + table[h % 256], and factor and table, a part, are known without h.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

# The offset and prime of the hash.
OFFSET, PRIME, MASK = 0x811C9DC5, 0x01000193, 0xFFFFFFFF
SEPARATOR = b"\x01"
#: The state that a separator before the first entry takes to OFFSET, so that each entry has one before it in any part.
START = (OFFSET * pow(PRIME, -1, MASK + 1) & MASK) ^ SEPARATOR[0]
#: Stretches of a text whose tables are made side by side.
LANES = 64

Part = tuple[int, np.ndarray]


def hashed(text: bytes, state: int = OFFSET) -> int:
    for byte in text:
        state = (state ^ byte) * PRIME & MASK
    return state


def part_of(text: bytes) -> Part | None:
    """What text does to any state; None if it is empty."""
    if not text:
        return None
    lanes = max(1, min(LANES, len(text) // LANES))
    width = len(text) // lanes
    states = np.repeat(np.arange(256, dtype=np.uint32)[:, None], lanes, 1)
    for step in np.ascontiguousarray(np.frombuffer(text, np.uint8, lanes * width).reshape(lanes, width).T).astype(np.uint32):
        states ^= step
        states *= np.uint32(PRIME)
    factor, out = pow(PRIME, width, MASK + 1), None
    for table in states.T:
        out = after(out, (factor, table))
    rest = text[lanes * width :]
    table = out[1].copy()
    for byte in rest:
        table ^= np.uint32(byte)
        table *= np.uint32(PRIME)
    return out[0] * pow(PRIME, len(rest), MASK + 1) & MASK, table


def after(first: Part | None, then: Part | None) -> Part | None:
    """One part of two that follow each other."""
    if first is None or then is None:
        return first or then
    low = first[1] & np.uint32(255)
    return first[0] * then[0] & MASK, (first[1] - low) * np.uint32(then[0]) + then[1][low]


def applied(part: Part, state: int) -> int:
    return ((state & ~255) * part[0] + int(part[1][state & 255])) & MASK


def group_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (group, entry) in order, a row for each group: its hash, or the part of it that these rows hold if others may
    hold more of it, which only the first and the last group may be. A batch is held at a time."""

    def rows_of(rows: pa.RecordBatch, starts: list[int], hashes: list, parts: list) -> pa.RecordBatch:
        keys = rows.take(pa.array(starts, pa.int64()))
        more = [pa.array(hashes, pa.int64()), pa.array([p and p[0] for p in parts], pa.int64()), pa.array([p and p[1].astype(np.int64) for p in parts], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*keys.columns, *more], ["group", "entry", "hash", "factor", "table"])

    last, part, cut = None, None, True  # the group that goes on: its first row, its part so far, whether it is the first one
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.concat_batches([last, batch])
        texts = [b"" if e is None else SEPARATOR + e for e in rows.column(1).cast(pa.binary()).to_pylist()]
        if last is not None:
            texts[0] = b""  # in its part already
        codes = np.asarray(rows.column(0).dictionary_encode().indices)
        starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist()]
        hashes, parts = [], []
        for a, b in zip(starts, starts[1:]):
            text = b"".join(texts[a:b])
            if a == 0:
                part = after(part, part_of(text))
                hashes.append(None if cut else applied(part, START) if part else OFFSET)
                parts.append(part if cut else None)
            else:
                hashes.append(hashed(text, START) if text else OFFSET)
                parts.append(None)
        if hashes:
            yield rows_of(rows, starts[:-1], hashes, parts)
            part, cut = None, False
        part, last = after(part, part_of(b"".join(texts[starts[-1] :]))), rows.slice(starts[-1], 1)
    if last is not None:
        yield rows_of(last, [0], [None], [part])


def group_hashes(members: DataFrame) -> DataFrame:
    """group, hash of rows (group, entry): of the group's distinct entries in bytewise order, joined by SEPARATOR; null entries
    are left out. A large group is spread over tasks, of which each gives a part of 256 numbers."""
    # nothing above the ranges may ask for other tasks: of a constant group, a distinct there deals entries anew, by hash
    ordered = members.distinct().repartitionByRange("group", "entry").sortWithinPartitions("group", "entry")
    schema = StructType().add("group", members.schema["group"].dataType).add("entry", StringType()).add("hash", LongType()).add("factor", LongType()).add("table", ArrayType(LongType()))
    parts = F.sort_array(F.collect_list(F.when(F.col("table").isNotNull(), F.struct("entry", "factor", "table"))))
    whole = ordered.mapInArrow(group_parts, schema).groupBy("group").agg(F.max("hash").alias("hash"), parts.alias("parts"))

    def step(h: Column, p: Column) -> Column:  # the lowest byte is set aside, so that no product leaves 64 bits
        rest = F.shiftleft((F.shiftright(h, 8) * p["factor"]).bitwiseAND(F.lit(0xFFFFFF)), 8)
        return (rest + F.element_at(p["table"], (h.bitwiseAND(F.lit(255)) + 1).cast("int"))).bitwiseAND(F.lit(MASK))

    joined = F.when(F.size("parts") == 0, F.lit(OFFSET).cast("bigint")).otherwise(F.aggregate("parts", F.lit(START).cast("bigint"), step))
    return whole.select("group", F.coalesce("hash", joined).alias("hash"))
