"""Fixed-size bit tables: what a task may ask about all keys without their being sent to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def bit_tables(keys: DataFrame, levels: int, bits: int = BITS) -> np.ndarray:
    """A (levels, bits / 64) table of words; bit ``key mod bits`` of row l - 1 is set for keys of level l and above.

    ``keys`` has key long and level int (1 or more).  Words are or-ed on the executors; the driver gets
    ``levels * bits / 64`` numbers at most, however many keys there are.
    """
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.select(
        F.explode(F.sequence(F.lit(1), F.least("level", F.lit(levels)))).alias("level"),
        F.shiftright(at, 6).alias("word"),
        F.expr(f"shiftleft(1L, cast(key & {63} as int))").alias("bit"),
    ).groupBy("level", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((levels, bits // 64), np.uint64)
    level, word, bits_ = (words[c].to_numpy() for c in ("level", "word", "bits"))
    out[level - 1, word] = bits_.view(np.uint64)
    return out


def level_of(tables: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of every key (uint64), 0 if its bit is not set; keys that share a bit share the highest level."""
    at = keys & np.uint64(tables.shape[1] * 64 - 1)
    word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    return ((tables[:, word] >> bit) & np.uint64(1)).sum(axis=0).astype(np.int8)


def ranges_of(keys: np.ndarray, ranges: int) -> pa.RecordBatch | None:
    """Sorted keys (uint64) as one packed row per hash range."""
    keys = np.sort(keys)
    low = (np.arange(ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64)
    cuts = np.searchsorted(keys, low).tolist() + [len(keys)]
    parts = [(r, keys[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    if not parts:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["range", "keys"])


def counted_levels(packed: DataFrame, ranges: int, steps: tuple[int, ...], marked: int = 0) -> np.ndarray:
    """Bit tables of the keys in ``packed`` (range int, keys binary): level l for steps[l - 1] occurrences or more.

    Keys travel as sorted runs of eight bytes each; a task counts one of the ranges.  With ``marked`` the
    lowest bits of a key tell where it occurs: equal keys count once, and the table is asked without these bits.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for r, blob in zip(batch.column("range").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                held.setdefault(r, []).append(blob)
        while held:
            keys = np.sort(np.frombuffer(b"".join(held.popitem()[1]), np.uint64))
            if marked:
                keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] >> np.uint64(marked)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            level = np.searchsorted(steps, np.diff(np.append(first, len(keys))), "right")
            some = level > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first[some]].view(np.int64)), pa.array(level[some].astype(np.int32))], ["key", "level"])

    return bit_tables(packed.repartition(ranges, "range").mapInArrow(count, "key long, level int"), len(steps))
