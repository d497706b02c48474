"""Helpers that several operators of this subpackage use.

Lineage is cut by ``materialize`` of the library, through a written table in the
folder that the cluster names in ``spark.checkpoint.dir``; a lost executor then only
costs the tasks it ran. ``Words`` turns a batch of texts into hashed lower-case words with
numpy alone, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop_scratch, materialize, scratch_path

__all__ = ["Words", "drop_scratch", "id_ranges", "kept", "materialize", "mix64", "range_bounds", "range_of", "row_key", "scratch_path", "slices", "small_batches", "table", "tidy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key():
    """doc_id; of rows without one a hash of their text, above usual ids, so that a row with an id goes first."""
    own = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col("doc_id").cast("long"), own)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of texts hold at most so many rows and about so many bytes: they stand in memory on both sides of the pipe."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        own = spark.conf.get(key).rstrip("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(key, str(most))


#: What an operator keeps in a worker process between its tasks, by the operator's name.
kept: dict[str, object] = {}


def release(owner: str | None = None) -> None:
    """Drops what others than the owner keep."""
    for name in [n for n in kept if n != owner]:
        del kept[name]


def give_back() -> None:
    """Returns freed memory of the worker to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run, owner: str | None = None):
    """A function of Arrow batches that gives freed memory back when its task ends, since Python workers live on.

    What other operators keep in the worker is dropped at its start.
    """

    def wrapped(batches):
        release(owner)  # a function of the module: what is kept here would be a copy
        yield from run(batches)
        give_back()

    return wrapped


def slices(batch, text: int, rows: int, size: int = 1 << 20) -> Iterator:
    """Parts of an Arrow batch of at most so many rows and, but for single longer texts, bytes in the column of that index."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def range_bounds(df: DataFrame, column: str, rows_per_range: int) -> list[int]:
    """Ascending upper cut points that split an integer column into even ranges.

    The list has one entry for each ``rows_per_range`` rows, at most 10,000.
    """
    n = df.count()
    parts = min(10_000, n // max(1, rows_per_range) + 1)
    if parts < 2:
        return []
    cuts = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000 + parts)).first()[0]
    return sorted(set(cuts or []))


def range_of(column, bounds: list[int], block: int = 100):
    """The index of the range that holds the value: how many cut points lie below it (nulls: -1).

    Two searches of at most ``block`` and ``len(bounds) / block`` steps a row.
    """
    value = F.col(column).cast("long")
    if not bounds:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    every, ends = F.lit([int(b) for b in bounds]).cast("array<bigint>"), F.lit([int(b) for b in bounds[block - 1 :: block]]).cast("array<bigint>")
    below = F.size(F.filter(ends, lambda b: b < value)) * block
    return F.when(value.isNull(), F.lit(-1)).otherwise(below + F.size(F.filter(F.slice(every, below + 1, F.lit(block)), lambda b: b < value)))


def id_ranges(df: DataFrame, column: str, tie: str, rows_per_range: int) -> Column:
    """An integer for each row that ascends with the column: ranges of about so many rows; nulls go below all, by descending tie.

    Cut points in the plan are 10,000 at most; beyond, each stretch between two of
    them is parted evenly by value. Ranges are 200,000 at most, then of more rows.
    tie: a hash.
    """
    value, x = F.col(column).cast("long"), F.col(column)
    n, known, low, high = df.agg(F.count("*"), F.count(x), F.min(value), F.max(value)).first()
    rows = max(rows_per_range, n // 200_000)
    many = max(1, -(-(n - known) // rows))
    top = F.shiftrightunsigned(F.lit((1 << 63) - 1).bitwiseXOR(F.col(tie)), 1).cast("double") / float(1 << 63)  # descends with the tie
    none = -1 - F.least(F.floor(top * many), F.lit(many - 1))
    if not known:
        return none.cast("int")
    bounds = range_bounds(df.where(x.isNotNull()), column, rows)
    at = range_of(column, bounds)
    parts = -(-known // (rows * (len(bounds) + 1)))
    if parts > 1:
        ends = F.lit([float(v) for v in (low, *bounds, high)])  # as doubles: differences of far ids overflow a long
        share = (value.cast("double") - F.get(ends, at)) / F.greatest(F.get(ends, at + 1) - F.get(ends, at), F.lit(1.0))
        at = at * parts + F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1))
    return F.when(x.isNull(), none).otherwise(at).cast("int")


# --- hashed words ----------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """Hashed lower-case words of an Arrow string column.

    A word is a run of ASCII letters, digits and non-ASCII bytes. ``hashes`` has
    all words in order, ``offsets[i]:offsets[i + 1]`` those of row i. Null texts
    have no words.
    """

    def __init__(self, column) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
        offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1 + low.offset)[low.offset :] if len(low) else np.zeros(1, np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(low.buffers()[2], np.uint8, last)[first:] if last > first else np.zeros(0, np.uint8)
        self.bounds = offsets - first
        starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        row, rows = 0, len(low)
        while row < rows:  # pieces of whole rows, about half a MB each, so that the tables of powers stay small
            stop = max(row + 1, int(np.searchsorted(self.bounds, self.bounds[row] + (1 << 19), side="right")) - 1)
            a, b = int(self.bounds[row]), int(self.bounds[stop])
            s, e, h = self._piece(data[a:b], self.bounds[row : stop + 1] - a)
            starts.append(s + a), ends.append(e + a), hashes.append(h)
            row = stop
        self.data, self.starts, self.ends, self.hashes = data, np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        self.offsets = np.searchsorted(self.starts, self.bounds, side="left")

    @staticmethod
    def _piece(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = _WORD_BYTE[data]
        opens = inside[:-1].copy()
        opens[1:] &= ~inside[:-2]
        cuts = bounds[(bounds > 0) & (bounds < len(data))]
        opens[cuts] = inside[cuts]
        starts = np.flatnonzero(opens)
        closes = inside[:-1] & ~inside[1:]
        closes[cuts - 1] |= inside[cuts - 1]
        ends = np.flatnonzero(closes) + 1
        up, down = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return starts, ends, mix64((total[ends] - total[starts]) * down[starts])

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of n words and their row offsets; a shorter row has one run of all its words."""
        counts = np.diff(self.offsets)
        out = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        offsets = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(out, out=offsets[1:])
        padded = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        rows = np.repeat(np.arange(len(counts)), out)
        at = np.arange(offsets[-1]) - offsets[rows] + self.offsets[rows]
        short = np.minimum(counts[rows], n)
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            step = (value * _BASE) ^ padded[at + k]
            value = np.where(k < short, step, value) if (short < n).any() else step
        return mix64(value + short.astype(np.uint64)), offsets
