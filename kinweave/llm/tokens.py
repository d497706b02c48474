"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on ids.

``write_tokens`` sorts documents by id, encodes each whole text and writes one
file a partition, in ascending order of id. ORC keeps the ids of a stripe in
run-length encoded streams; stripes are the unit of parallel reads, row indexes
and the Bloom filter on doc_id let a lookup skip stripes and row groups.

A text is split at plain white space before it is encoded, if the tokenizer's own
pre-tokenizer does so as well; each distinct word of a batch is then encoded once,
and a worker keeps the ids of words it has seen, in a table of bounded size. Texts,
not ids, are shuffled into order: four bytes an id are more than the text.

Defined results: null and empty texts have the end id only; equal ids stand by
the hash of their texts, a null id first; repeated rows are all written; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import kept, materialize, range_bounds, range_of, scratch_path, slices, tidy

END_ID = 2
#: Words that a worker remembers, some 200 bytes each.
REMEMBERED = 120_000
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


#: Letters of one UTF-8 form whose lower case is one letter, and signs: such words are one run of letters and one of signs to the tokenizer.
_LETTERS = "".join(map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
_SIGNS = ".,!?:;#$%&*()|-"
_PROBES = ("a", "Word", "word...", "\u00c9tude,", "stra\u00dfe!?", "ZZZ-", "abcdefghijklmnopqrstuvwxyz")


class _Encoder:
    """Whole texts to ids.

    If white space only parts words to the tokenizer, each distinct word of a batch is
    encoded once; ids of words seen a second time are remembered, up to
    ``REMEMBERED``. New words of letters go through the file's own merges many at a
    time: a copy of the model spells a word's last letter as a character of its own,
    so words can stand side by side without a pre-tokenizer. If the copy does not
    give the library's ids for some probes, or white space means more, the library
    encodes texts as they are.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}
        self.door = bytearray(1 << 22)
        self.signs: dict[str, bytes] = {"": b""}
        self.parted = all(self._plain(f"{x}{gap}{y}") == self._plain(x) + self._plain(y) for x, y in (("a", "b"), ("Word,", "é1")) for gap in (" ", "\n", "  ", "\t\r"))
        self.line = re.compile(f"^(?:([{_LETTERS}]+)([{re.escape(_SIGNS)}]*)|.*)$", re.M)
        self.merger = self.final = None
        if self.parted:
            self._spell()
            if self.merger is not None and self.words(list(_PROBES)) != [self._plain(w) for w in _PROBES]:
                self.merger = None

    def _plain(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _spell(self) -> None:
        """The copy of a model of byte characters whose words end in a suffix: a last byte is the character 0xE000 + byte."""
        import json

        import numpy as np
        from tokenizers import Tokenizer, models

        model = json.loads(self.tokenizer.to_str())["model"]
        end = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not end or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return
        shown = {**{c: c for c in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}}
        shown |= {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in shown)}  # how byte-level models write bytes
        byte_of = {chr(c): b for b, c in shown.items()}
        spell = lambda t: t[: -len(end) - 1] + chr(0xE000 + byte_of[t[-len(end) - 1]]) if t.endswith(end) else t
        try:
            vocab = {spell(t): i for t, i in model["vocab"].items()}
            merges = [tuple(map(spell, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        except (KeyError, IndexError):
            return
        if len(vocab) < len(model["vocab"]) or not all(chr(shown[b]) in vocab and chr(0xE000 + b) in vocab for b in range(256)):
            return
        self.merger = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.inner = np.array([shown[b] for b in range(256)], "<u4")
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        self.final[[i for t, i in vocab.items() if "\ue000" <= t[-1] <= "\ue0ff"]] = True

    def _letters(self, cores: list[str]) -> list[bytes]:
        """The ids of words of letters."""
        import numpy as np

        raw = np.frombuffer(("\n".join(cores).lower() + "\n").encode(), np.uint8)
        stops = np.flatnonzero(raw == 10)
        codes = self.inner[raw]
        codes[stops - 1] = raw[stops - 1] + np.uint32(0xE000)
        text = np.delete(codes, stops).tobytes().decode("utf-32-le")
        ends = [0, *(stops - np.arange(len(stops))).tolist()]
        cuts = [*range(0, len(cores), 64), len(cores)]
        got = self.merger.encode_batch_fast([text[ends[a] : ends[b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<i4") for e in got])
        at = [0, *(np.flatnonzero(self.final[ids]) + 1).tolist()]
        flat = ids.tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        out: list[bytes | None] = [None] * len(words)
        if words and self.merger is not None:
            pairs = self.line.findall("\n".join(words))
            own = [k for k, (core, _) in enumerate(pairs) if core]
            if own:
                for k, ids in zip(own, self._letters([pairs[k][0] for k in own]), strict=True):
                    tail = pairs[k][1]
                    signs = self.signs.get(tail)
                    if signs is None:
                        signs = self._plain(tail)
                        if len(self.signs) < 10_000:
                            self.signs[tail] = signs
                    out[k] = ids + signs if tail else ids
        rest = [k for k, ids in enumerate(out) if ids is None]
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = array("i", e.ids).tobytes()
        return out

    def encode_all(self, texts, end_id: int):
        """(ids, offsets) of an Arrow column of texts, the end id behind each."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        end = np.array([end_id], "<i4")
        if not self.parted:
            own = [array("i", e.ids).tobytes() + end.tobytes() for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            offsets = np.zeros(len(own) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in own], out=offsets[1:])
            return np.frombuffer(b"".join(own), "<i4"), offsets
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
        first, last = int(bounds[0]), int(bounds[-1])
        data = _BLANKS[np.frombuffer(texts.buffers()[2], np.uint8, last)[first:]] if last > first else np.zeros(0, np.uint8)
        blank = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds - first), pa.py_buffer(data))
        lists = pc.split_pattern(blank, " ")
        coded = lists.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        known, door, last = self.known, self.door, len(self.door) - 1
        found = list(map(known.get, distinct))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self.words([distinct[k] for k in new]), strict=True):
            found[k] = ids
            if len(known) < REMEMBERED:
                w = distinct[k]
                at = hash(w) & last
                if door[at]:
                    known[w] = ids
                door[at] = 1
        found.append(end.tobytes())
        flat = np.frombuffer(b"".join(found), "<i4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        stops = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
        every = np.insert(index, stops, len(found) - 1)
        many = sizes[every]
        upto = np.cumsum(many)
        ids = flat[np.repeat(begins[every] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        offsets = np.zeros(len(texts) + 1, np.int64)
        offsets[1:] = upto[stops + np.arange(len(stops))]
        return ids, offsets.astype(np.int32)


def _blanks():
    import numpy as np

    out = np.arange(256, dtype=np.uint8)
    out[[9, 10, 13]] = 32
    return out


_BLANKS = _blanks()


def _encoder(path: str) -> _Encoder:
    """One for each worker process, whatever the number of its tasks."""
    if path not in kept.get("tokens", {}):
        kept["tokens"] = {path: _Encoder(path)}
    return kept["tokens"][path]


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, tie, ids): rows stay where they are. docs: (doc_id, tie, text)."""

    def run(batches):
        import pyarrow as pa

        encode_all = _encoder(tokenizer_path).encode_all
        for batch in batches:
            for part in slices(batch, 2, 512):
                ids, offsets = encode_all(part.column(2), end_id)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], ["doc_id", "tie", "ids"])

    return docs.mapInArrow(tidy(run, "tokens"), "doc_id long, tie long, ids array<int>")


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Files under path, in ascending order of doc_id."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    d = d.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    encode(d, tokenizer_path, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, tie, ids) from the files; of one document, if asked for, by the index and Bloom filter."""
    d = spark.read.schema("doc_id long, tie long, ids array<int>").orc(path)
    return d if doc_id is None else d.where(F.col("doc_id") == doc_id)


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, tie, n_tokens, ids_crc32) of rows with ids."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "tie", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(tidy(run), "doc_id long, tie long, n_tokens long, ids_crc32 long")


def starts(rows: DataFrame, rows_per_range: int = 20_000) -> DataFrame:
    """rows with start: n_tokens of all rows before, by (doc_id, tie). At most 10,001 ranges; their sums are broadcast."""
    rows = rows.withColumn("_range", range_of("doc_id", range_bounds(rows, "doc_id", rows_per_range)))
    sums = rows.groupBy("_range").agg(F.sum("n_tokens").alias("_sum"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # over ranges, not documents
    sums = sums.select("_range", (F.sum("_sum").over(upto) - F.col("_sum")).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(F.asc_nulls_first("doc_id"), "tie").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(sums), "_range").withColumn("start", F.col("_base") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return out.drop("_range", "_base")


def tokenize(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes the files, reads them back, and returns doc_id, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, tokenizer_path, path)
    rows = materialize(checksums(read_tokens(spark, path)), "crc")
    return starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
