"""Quality scores by a regularised quadratic discriminant.

Statistics of the whole text (shares of letter cases, digits, symbols, line ends;
word lengths; repeated words and word 5-grams) are put on log scales. Each class
has a mean and a covariance, shrunk towards the pooled covariance and then
towards its diagonal; all are sums over every training document, added up before
the shuffle. The Cholesky factors are inverted once on the driver; a score is the
difference of log densities through the logistic function.

Defined results: a null or empty text is scored by the statistics of an empty
text; without training rows of both classes the score is the share of the class
there is, or 0.5; rows are kept as they are, repeated ones included; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Words, materialize, slices, tidy

FEATURES = ("words", "upper", "digits", "symbols", "exclaims", "bars", "stops", "word_length", "distinct", "repeats", "lines", "spaces", "foreign")
_DIM = len(FEATURES)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz")
_MASKS = (_UPPER, _LETTER, _class("0123456789"), _class("#$%&*@^~<>{}[]\\/=+_`"), _class("!"), _class("|"), _class(".,;:?"), _class("\n"), _class(" \t"), np.arange(256) >= 128)


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(offsets) - 1)


def _statistics(column) -> np.ndarray:
    """rows x features."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1]))[offsets[0] :] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    counts = []
    for mask in _MASKS:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask[data], out=total[1:])
        counts.append(np.diff(total[bounds]))
    upper, letters, digits, symbols, exclaims, bars, stops, lines, spaces, foreign = (c.astype(float) for c in counts)
    n = np.diff(bounds).astype(float)
    words = Words(column)
    w = np.diff(words.offsets).astype(float)
    total = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=total[1:])
    length = np.diff(total[words.offsets]).astype(float)
    grams, gram_offsets = words.shingles(5)
    g = np.diff(gram_offsets).astype(float)
    out = np.column_stack([
        np.log(w + 1), np.log((upper + 1) / (letters + 20)), np.log((digits + 1) / (n + 100)), np.log((symbols + 1) / (n + 100)), np.log((exclaims + 1) / (n + 100)),
        np.log((bars + 1) / (n + 100)), np.log((stops + 1) / (n + 50)), np.log((length + 5) / (w + 1)), np.log((_distinct(words.hashes, words.offsets) + 5) / (w + 5)),
        np.log((g - _distinct(grams, gram_offsets) + 1) / (g + 20)), np.log((lines + 1) / (n + 200)), np.log((spaces + 1) / (n + 20)), np.log((foreign + 1) / (n + 100)),
    ])
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>): the transformed statistics of each whole text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, 512):
                x = _statistics(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * _DIM), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, x array<double>")


@dataclass
class Discriminant:
    prior: float  # log odds of class 1
    means: list[np.ndarray]
    whiten: list[np.ndarray]  # inverses of the Cholesky factors
    log_dets: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        d = np.full(len(x), self.prior)
        for sign, mean, white, det in zip((-1, 1), self.means, self.whiten, self.log_dets, strict=True):
            z = (x - mean) @ white.T
            d += sign * -0.5 * ((z * z).sum(axis=1) + det)
        return 1 / (1 + np.exp(-np.clip(d / _DIM, -30, 30)))  # over the dimensions: else nearly all scores would be 0 or 1


def train(rows: DataFrame, pooled: float = 0.2, diagonal: float = 0.1) -> Discriminant | float:
    """rows: (x, label). The sums of every class come from all rows; two rows reach the driver."""
    x = [F.col("x")[i] for i in range(_DIM)]
    pairs = [(i, j) for i in range(_DIM) for j in range(i + 1)]
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs])
    got = {r["label"]: r for r in sums.where("label in (0, 1)").collect()}
    if len(got) < 2:
        return float(next(iter(got))) if got else 0.5
    n, means, covs = [], [], []
    for label in (0, 1):
        r = got[label]
        mean = np.array([r[f"s{i}"] for i in range(_DIM)]) / r["n"]
        second = np.zeros((_DIM, _DIM))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"]
        n.append(r["n"]), means.append(mean), covs.append(second / r["n"] - np.outer(mean, mean))
    both = (covs[0] * n[0] + covs[1] * n[1]) / sum(n)
    whiten, dets = [], []
    for cov in covs:
        c = (1 - pooled) * cov + pooled * both
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(_DIM)
        low = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(low)), dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(float(np.log(n[1] / n[0])), means, whiten, dets)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(rows: DataFrame, model: Discriminant | float) -> DataFrame:
    """(doc_id, x) -> (doc_id, score)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, _DIM)
            s = model.scores(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return rows.mapInArrow(tidy(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labels.quality of rows that are not held out."""
    rows = materialize(statistics(docs), "stats")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    out = score(rows, train(rows.join(known, "doc_id").select("x", "label")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
