"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, all else becomes one space; runs of one to three
characters are hashed into buckets. A feature is a bucket's share of the text's
n-grams times its inverse document frequency, which counts every training
document. Weights come from follow-the-regularised-leader with an elastic-net
penalty, which leaves most of them zero, and a temperature calibrates the scores.
The weights are fitted on a sample of ``sample_docs`` labelled documents; each
prediction reads the whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0, as
is every text if no document has a label; rows are kept as they are, repeated
ones included; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches, tidy

BITS = 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    #: labelled documents that the weights are fitted on, about evenly over languages
    sample_docs: int = 3000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001
    scale: float = 30.0


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # bucket x language, inverse document frequency included
    bias: np.ndarray
    temperature: float
    scale: float


_letters: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters["is"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters["is"]


def _codes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with runs of other characters as one space; row offsets; letters of each row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")).to_pylist()
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=bounds[1:])
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    seen, kept = np.zeros(len(codes) + 1, np.int64), np.zeros(len(codes) + 1, np.int64)
    np.cumsum(letter, out=seen[1:])
    np.cumsum(keep, out=kept[1:])
    return codes[keep], kept[bounds], np.diff(seen[bounds])


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    h = np.full(len(codes), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h[: len(codes) - k] = (h[: len(codes) - k] ^ codes[k:]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def _crossing(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Places whose n-gram leaves its row."""
    ends = np.concatenate([offsets[1:] - k for k in range(1, n)]) if n > 1 else np.zeros(0, np.int64)
    return np.unique(ends[(ends >= 0) & (ends < total)])


def _row_features(batch, text: int):
    """For each row: (buckets, shares, has letters)."""
    for part in slices(batch, text, 64, 1 << 18):
        part = part.column(text)
        codes, offsets, letters = _codes(part)
        grams = []
        for n in ORDERS:
            g = _grams(codes, n)
            g[_crossing(offsets, n, len(g))] = -1
            grams.append(g)
        for i in range(len(part)):
            own = np.concatenate([g[offsets[i] : offsets[i + 1]] for g in grams])
            buckets, counts = np.unique(own[own >= 0], return_counts=True)
            yield buckets, counts / max(1, counts.sum()), bool(letters[i])


def _document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches):
        import pyarrow as pa

        df, docs = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for buckets, _, some in _row_features(batch, 0):
                if some:
                    df[buckets] += 1
                    docs += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], docs))], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most a row for each bucket
    df = np.zeros(1 << BITS)
    for r in rows:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    return df, sum(r["n"] for r in rows if r["bucket"] < 0)


def _ftrl(xs, ys, k: int, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))
    order = np.random.default_rng(5)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(z[i]) <= p.l1, 0.0, w)

    for _ in range(p.epochs):
        for j in order.permutation(len(xs)):
            i, x = xs[j]
            w = weights(i)
            s = x @ w
            e = np.exp(s - s.max())
            e /= e.sum()
            e[ys[j]] -= 1
            g = x[:, None] * e
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1], w[-1]


def train(labelled: DataFrame, params: LangParams = LangParams(), id_col: str = "doc_id") -> LangModel | None:
    """labelled: (doc_id, text, lang), lang not null."""
    small_batches(labelled.sparkSession)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    each = params.sample_docs / len(langs)
    # a fixed share of each language, by a hash of the id and text
    share = F.create_map(*[x for c in langs for x in (F.lit(c), F.lit(min(1.0, each / counts[c])))])
    dice = F.pmod(F.xxhash64(F.col(id_col), F.xxhash64("text")), F.lit(1_000_000)) / 1_000_000
    sample = labelled.where(dice < F.element_at(share, F.col("lang"))).select("lang", "text")
    df, docs = _document_frequency(labelled)
    idf = np.log((1 + docs) / (1 + df)) + 0.1

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(_row_features(batch, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b.astype("<i4").tobytes() for b, _, _ in rows], pa.binary()), pa.array([s.astype("<f4").tobytes() for _, s, _ in rows], pa.binary())], ["lang", "buckets", "shares"]
            )

    xs, ys = [], []
    for r in sample.mapInArrow(tidy(run), "lang string, buckets binary, shares binary").collect():
        b = np.frombuffer(r["buckets"], "<i4")
        if len(b):
            xs.append((np.append(b, 1 << BITS), np.append(np.frombuffer(r["shares"], "<f4") * idf[b] * params.scale, 1.0)))
            ys.append(langs.index(r["lang"]))
    if not xs:
        return None
    turn = np.random.default_rng(1).permutation(len(xs))
    held = set(turn[: len(xs) // 5].tolist())
    fit = [j for j in range(len(xs)) if j not in held]
    w, bias = _ftrl([xs[j] for j in fit], [ys[j] for j in fit], len(langs), params)
    temperature = 1.0
    if held:
        s = np.array([xs[j][1][:-1] @ w[xs[j][0][:-1]] + bias for j in sorted(held)])
        y = np.array([ys[j] for j in sorted(held)])

        def loss(t: float) -> float:
            q = s / t
            q = q - q.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]))

        temperature = min(np.geomspace(0.1, 5, 60), key=loss)
    return LangModel(langs, (w * idf[:, None]).astype(np.float32), bias, float(temperature), params.scale)


def _judge(batch, text: int, model: LangModel | None) -> tuple[list[str], list[float]]:
    """(language, score) of each text."""
    preds, scores = [], []
    for part in slices(batch, text, 256, 1 << 19):
        part = part.column(text)
        codes, offsets, letters = _codes(part)
        if model is None or not len(codes):
            preds += [UNKNOWN] * len(part)
            scores += [0.0] * len(part)
            continue
        total, sums = np.zeros(len(part)), np.zeros((len(part), len(model.langs)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        for n in ORDERS:
            rows = model.table[_grams(codes, n)]
            out = _crossing(offsets, n, len(codes))
            rows[out] = 0
            sums[full] += np.add.reduceat(rows, offsets[full], axis=0, dtype=np.float64)
            total += np.maximum(0, np.diff(offsets) - (n - 1))
        s = (sums / np.maximum(total, 1)[:, None] * model.scale + model.bias) / model.temperature
        e = np.exp(s - s.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        best = e.argmax(axis=1)
        some = letters > 0
        preds += [model.langs[b] if x else UNKNOWN for b, x in zip(best, some, strict=True)]
        scores += np.where(some, e[np.arange(len(best)), best], 0.0).tolist()
    return preds, scores


def predict(docs: DataFrame, model: LangModel | None, id_col: str = "doc_id") -> DataFrame:
    """The id, lang_pred and score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            preds, scores = _judge(batch, 1, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, "text").mapInArrow(tidy(run), f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, params: LangParams = LangParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the labelled documents that are not held out."""
    model = train(docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), params)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5, params: LangParams = LangParams()) -> DataFrame:
    """The documents whose language the model tells with a score of ``least`` or more; columns as before."""
    model = train(docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), params)
    text = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            preds, scores = _judge(batch, text, model)
            yield batch.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(preds, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
