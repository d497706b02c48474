"""Packing token pieces into sequences by linear grouping, configurations and best fit.

A document is its token ids and an end id; a longer one than a sequence is cut, so that
all its pieces but the first are full. What matters for packing is how many pieces
there are of each length, a table of at most ``capacity`` rows, and only that reaches
the driver, whatever the corpus. There, lengths over an eighth of the capacity are
sorted and put in groups of equal cardinality, each rounded up to its greatest length
(linear grouping); the configurations of a sequence over these few sizes are optimised
by a linear program with generated columns. Half of its sequences are filled, actual
lengths in the places of rounded ones, the last place by the greatest that fits; then
what is left is grouped anew, until few pieces are left. These, and all small ones, go
by best fit, largest first. A placement is a row of the plan: so many pieces of a length, from
its i-th on, go to a run of sequences at an offset. The plan has some thousand rows,
whatever the corpus, as it places lengths, not pieces.

Pieces are numbered within their length by two levels of counts, so that a length of
many pieces is no hot task, and each looks up its own placement.

Defined results: a null or empty text is the end id alone; rows that repeat an id and
text are all packed; rows without an id too; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, kept, materialize, slices, tidy


@dataclass(frozen=True)
class PackParams:
    capacity: int = 2048
    end_id: int = 0
    #: groups of equal cardinality that lengths over capacity / large_part fall into
    groups: int = 64
    large_part: int = 8
    #: of the configurations found, this share is filled before what is left is grouped anew, while so many pieces a group are left
    round_share: tuple[int, int] = (1, 2)
    least_round: int = 4
    #: there are 1 / so many times the square root of all pieces buckets in which they are numbered
    bucket_share: int = 16


#: Fixed value: the pattern by which byte-level models part words.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of so many bytes without white space, or with nothing else, goes to the tokenizer's own library.
LONG_RUN = 1000


class _Encoder:
    """Whole texts to ids of a tokenizer file.

    If it is a plain byte-level BPE whose merges stand in the order of their ids, texts of
    ASCII and Latin letters are encoded by a second implementation of the same merges,
    three times as fast. A worker compares both on every entry of the vocabulary when it
    starts, and on a text of every slice; if they ever differ, and for all other texts,
    the file's own library encodes.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.second = self._second()
        #: bytes of texts that only the library encodes: control characters that not all count as white space, and letters beyond Latin
        self.rare = np.zeros(256, bool)
        self.rare[[*range(0x1C, 0x20), 0x7F, 0xC2, *range(0xCA, 0x100)]] = True

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _second(self):
        import json

        import tiktoken

        whole = json.loads(self.tokenizer.to_str())
        model, parts = whole.pop("model"), whole.get("pre_tokenizer") or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in odd) or whole.get("normalizer") or parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or not parts.get("use_regex", True):
            return None
        shown = [c for c in range(256) if 0x21 <= c < 0x7F or 0xA1 <= c < 0xAD or c >= 0xAE]
        byte_of = {chr(c): c for c in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}  # how byte-level models write bytes
        made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.pop("merges")]
        tokens = {t: i for t, i in model["vocab"].items() if t not in self.special}
        if made != sorted(set(made)) or any(c not in byte_of for t in tokens for c in t):
            return None
        ranks = {bytes(byte_of[c] for c in t): i for t, i in tokens.items()}
        second = tiktoken.Encoding("merges", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        probes = [t for t in (b.decode("utf-8", "ignore") for b in ranks) if t] + ["it's we'll 12 b4 \t\n x  y\n\n", "É é ñandú straße Žižek"]
        for at in range(0, len(probes), 500):  # few at a time: what the library returns is large
            some = probes[at : at + 500]
            if any(e.ids != second.encode_ordinary(t) for t, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True)):
                return None
        return second

    def _quick(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which rows the second implementation may encode."""
        ok = np.ones(len(bounds) - 1, bool)
        at = np.flatnonzero(self.rare[data])
        ok[np.searchsorted(bounds, at, side="right") - 1] = False
        for inside in (data <= 32, data > 32):
            edges = np.concatenate([[-1], np.flatnonzero(inside), [len(data)]])
            far = np.flatnonzero(np.diff(edges) > LONG_RUN)
            for k in far:  # a run may cross rows: all of them then go the safe way
                lo, hi = np.searchsorted(bounds, [edges[k] + 1, edges[k + 1] - 1], side="right") - 1
                ok[max(lo, 0) : hi + 1] = False
        return ok

    def encode_all(self, texts) -> list[np.ndarray]:
        """The ids of each text of an Arrow column, without the end id."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[np.ndarray | None] = [None] * len(texts)
        own = texts.to_pylist()
        if self.second is not None and len(texts):
            bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
            data = np.frombuffer(texts.buffers()[2], np.uint8, int(bounds[-1]))[int(bounds[0]) :] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
            quick = self._quick(data, bounds - bounds[0])
            for k in np.flatnonzero(quick):
                if not any(s in own[k] for s in self.special):
                    out[k] = np.array(self.second.encode_ordinary(own[k]), "<u4")
            first = next((k for k, ids in enumerate(out) if ids is not None), None)
            if first is not None and not np.array_equal(out[first], self.plain(own[first])):
                self.second, out = None, [None] * len(texts)
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([own[k] for k in rest], add_special_tokens=False) if rest else [], strict=True):
            out[k] = np.array(e.ids, "<u4")
        return out


def _encoder(path: str) -> _Encoder:
    if path not in kept.get("packing", {}):
        kept["packing"] = {path: _Encoder(path)}
        give_back()
    return kept["packing"][path]


def pieces(docs: DataFrame, tokenizer_path: str, params: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """(doc_id, tie, piece, start, length, ids_crc32[, ids]) of each piece of each document; rows stay where they are."""
    capacity, end = params.capacity, params.end_id

    def run(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 2, 512):
                rows, lists = [[], [], [], [], [], []], []
                encoded = _encoder(tokenizer_path).encode_all(part.column(2))
                for doc_id, tie, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encoded, strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        for column, v in zip(rows, (doc_id, tie, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                            column.append(v)
                        if with_ids:
                            lists.append(ids[a:b].astype(np.int32))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]
                names = ["doc_id", "tie", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, tie long, piece int, start long, length long, ids_crc32 long"
    return d.mapInArrow(tidy(run, "packing"), schema + (", ids array<int>" if with_ids else ""))


# --- the plan, over counts of lengths ------------------------------------------------


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size in a sequence, so many sequences): the whole part of a least fractional packing.

    Simplex steps from one-size configurations; the column of a step is the
    configuration of the greatest value under the current prices, found room by room.
    """
    n = len(sizes)
    if not n:
        return []
    order = np.argsort(sizes)
    small_first = sizes[order].astype(int)
    basis = [np.eye(n, dtype=int)[g] * max(1, capacity // int(sizes[g])) for g in range(n)]
    inverse = np.diag([1.0 / basis[g][g] for g in range(n)])
    amount = inverse @ demand
    fitting = np.searchsorted(small_first, np.arange(capacity + 1), side="right")
    for _ in range(20 * n):
        price = inverse.sum(axis=0)[order]
        value, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
        for c in range(int(small_first[0]), capacity + 1):
            worth = value[c - small_first[: fitting[c]]] + price[: fitting[c]]
            pick[c] = worth.argmax()
            value[c] = max(0.0, worth[pick[c]])
        if value[capacity] <= 1 + 1e-7:
            break
        column, at = np.zeros(n, int), capacity
        while at >= small_first[0] and value[at] > 0:
            column[order[pick[at]]] += 1
            at -= int(small_first[pick[at]])
        change = inverse @ column
        can = np.flatnonzero(change > 1e-9)
        if not len(can):
            break
        out = int(can[np.argmin(amount[can] / change[can])])
        inverse[out] /= change[out]
        change[out] = 0.0
        inverse -= np.outer(change, inverse[out])
        basis[out] = column
        amount = np.maximum(inverse @ demand, 0.0)
    left, taken = demand.astype(np.int64).copy(), []
    for k in np.argsort(-amount, kind="stable"):
        m = int(np.floor(amount[k] + 1e-9))
        if m and basis[k].any():
            m = min(m, int((left[basis[k] > 0] // basis[k][basis[k] > 0]).min()))
        if m > 0:
            left -= basis[k] * m
            taken.append((basis[k], m))
    return taken


class _Plan:
    """Runs of sequences by the room they have left, and the rows of the plan."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, dict(counts)
        self.next = {s: 0 for s in counts}
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.sequences = 0
        self.large = np.zeros(0, int)

    def put(self, size: int, first: int, n: int, room: int, copies: int = 1, last: int | None = None) -> None:
        """``copies`` pieces of a size into each of n sequences with that room; last: pieces of the run, if fewer."""
        many = n * copies if last is None else last
        self.rows.append((size, self.next[size], many, copies, first, self.capacity - room))
        self.next[size] += many
        self.left[size] -= many

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def configure(self, slots: list[int], n: int) -> None:
        """n sequences; a slot takes the greatest lengths left up to its own, the last slot up to the room that actual lengths leave."""
        runs = [(self.open(n), n, self.capacity)]
        for at, slot in enumerate(sorted(slots, reverse=True), 1):
            done = []
            for first, m, room in runs:
                top = room if at == len(slots) else min(slot, room)
                for s in self.large[np.searchsorted(-self.large, -top) :]:
                    s = int(s)
                    k = min(m, self.left[s])
                    if k:
                        self.put(s, first, k, room)
                        done.append((first, k, room - s))
                        first, m = first + k, m - k
                    if not m:
                        break
                if m:
                    done.append((first, m, room))
            runs = done
        for first, m, room in runs:
            self.room[room].append((first, m))

    def best_fit(self) -> None:
        """All lengths that are left, the greatest first, each into the least room that holds it."""
        for s in sorted(self.left, reverse=True):
            for room in range(s, self.capacity + 1):
                if not self.left[s]:
                    break
                runs, self.room[room] = self.room[room], []
                while runs and self.left[s]:
                    first, n = runs.pop()
                    copies = min(room // s, self.left[s])
                    m = min(n, self.left[s] // copies)
                    self.put(s, first, m, room, copies)
                    self.room[room - copies * s].append((first, m))
                    if m < n:
                        runs.append((first + m, n - m))
                self.room[room].extend(runs)
            if self.left[s]:
                copies = self.capacity // s
                n, rest = divmod(self.left[s], copies)
                for k, c in ((n, copies), (1, rest)):
                    if k and c:
                        first = self.open(k)
                        self.put(s, first, k, self.capacity, c)
                        self.room[self.capacity - c * s].append((first, k))


def plan(counts: dict[int, int], params: PackParams = PackParams()) -> tuple[np.ndarray, int]:
    """(rows of length, first, many, copies, sequence, offset, by length and first; number of sequences). counts: pieces of each length."""
    p = _Plan({int(s): int(c) for s, c in counts.items() if c}, params.capacity)
    large = sorted((s for s in p.left if params.capacity // params.large_part < s < params.capacity), reverse=True)
    p.large = np.array(large, int)
    while (total := sum(p.left[s] for s in large)) > params.least_round * params.groups:
        groups: list[list[int]] = []
        upto, share = 0, total / params.groups
        for s in large:  # a length of many pieces is a group of its own: equal lengths need no rounding
            if p.left[s]:
                if not groups or upto >= share * len(groups):
                    groups.append([])
                groups[-1].append(s)
                upto += p.left[s]
        sizes = np.array([g[0] for g in groups])
        demand = np.array([sum(p.left[s] for s in g) for g in groups])
        found = configurations(sizes, demand, params.capacity)
        rounded = any(len(g) > 1 for g in groups)
        for amounts, n in found:
            n = -(-n * params.round_share[0] // params.round_share[1]) if rounded else n
            p.configure([int(sizes[g]) for g in np.flatnonzero(amounts) for _ in range(amounts[g])], n)
        if not rounded or not found:
            break
    p.best_fit()
    rows = np.array(sorted(p.rows), np.int64).reshape(-1, 6)
    return rows, p.sequences


def numbered_in_length(rows: DataFrame, params: PackParams) -> tuple[DataFrame, dict[int, int]]:
    """(rows with index: 0.. within each length, pieces of each length); rows: materialized pieces.

    Buckets are hashes of documents. The counts of a length in each bucket are added up
    first; a task then numbers one bucket's pieces of a length. Neither level holds more
    than some multiple of the square root of all pieces in one group, whatever share of
    them has one length.
    """
    buckets = max(1, math.isqrt(rows.count()) // params.bucket_share)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    counts = materialize(rows.groupBy("length", "bucket").agg(F.count("*").alias("c")), "counts")
    lengths = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # over buckets
    base = counts.select("length", "bucket", (F.sum("c").over(upto) - F.col("c")).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "tie", "piece")
    out = rows.join(base, ["length", "bucket"]).withColumn("index", F.col("base") + F.row_number().over(inside) - 1)
    return out.drop("bucket", "base"), lengths


def placed(rows: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """The pieces with sequence_id and offset; rows: materialized pieces."""
    numbered, lengths = numbered_in_length(rows, params)
    table, _ = plan(lengths, params)
    length, first, _, copies, sequence, offset = table.T
    begins = (length << 40) + first

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size, index = (batch.column(k).to_numpy() for k in (batch.schema.names.index("length"), batch.schema.names.index("index")))
            at = np.searchsorted(begins, (size << 40) + index, side="right") - 1
            k = index - first[at]
            own = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "index"]
            names = [name for name in batch.schema.names if name != "index"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence[at] + k // copies[at]), pa.array(offset[at] + k % copies[at] * size)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "index")
    return numbered.mapInArrow(tidy(run), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, params: PackParams = PackParams()) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialize(pieces(docs, tokenizer_path, params), "pieces")
    return placed(rows, params).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def write_sequences(docs: DataFrame, tokenizer_path: str, path: str, params: PackParams = PackParams()) -> None:
    """Parquet files of (sequence_id, ids, doc_ids, lengths): the packed sequences themselves, at most ``capacity`` ids each."""
    rows = placed(materialize(pieces(docs, tokenizer_path, params, with_ids=True), "pieces"), params)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    d = rows.groupBy("sequence_id").agg(parts.alias("p"))
    each = lambda name: F.transform("p", lambda x: x[name])
    d.select("sequence_id", F.flatten(each("ids")).alias("ids"), each("doc_id").alias("doc_ids"), each("length").alias("lengths")).write.parquet(path)


def lower_bound(lengths: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences."""
    over_half = sum(c for s, c in lengths.items() if 2 * s > capacity)
    return max(over_half, -(-sum(s * c for s, c in lengths.items()) // capacity))
