"""Similarity search: k-mer candidates, alignment, Jaccard and cosine joins, hit cleaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pair
from ..runtime import materialize
from ..schemas import HITS
from .joins import SMALL_ROWS, join_counted, join_lookup, self_pairs
from .ranking import greatest_of


@dataclass(frozen=True)
class SearchParams:
    min_coverage: float = 0.8
    min_identity: float = 0.3
    coverage_mode: int = 0
    e_value: float = 1e-5
    #: "spaced": two spaced seeds of similar residues on one diagonal; "kmer": ``min_shared`` equal k-mers anywhere
    seeds: str = "spaced"
    kmer: int = 4
    #: k-mers that two sequences must share to be aligned
    min_shared: int = 1
    #: raw score that the ungapped extension of the seeds must reach, and how far it may fall on the way
    min_ungapped: int = 45
    x_drop: int = 20
    #: residues to each side of the seeds' diagonal that an alignment may take; 0: the whole matrix
    band: int = 32
    #: "exact": identical columns; "estimated": from the score per column, as fast aligners report it
    identity: str = "exact"


def drop_self_hits(hits: DataFrame) -> DataFrame:
    return hits.where("query <> target")


def dedup_mutual_hits(hits: DataFrame) -> DataFrame:
    """One hit for each unordered pair: the greatest identity, then the first direction."""
    return greatest_of(hits, [*pair(F.col("query"), F.col("target"))], "pident", [F.col("query"), F.col("target"), -F.col("bits")])


def kmer_index(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer, name) of distinct k-mers; sequences: (name, sequence)."""
    n = F.length("sequence")
    starts = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
    return sequences.select("name", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("sequence", i, F.lit(k))))).alias("kmer"))


#: Residues that replace each other often count as equal in a seed.
SIMILAR = ("A", "C", "DN", "EQ", "FY", "G", "H", "IV", "KR", "LM", "P", "ST", "W")
#: Places of the residues of a seed of five; a longer seed goes on in steps of 1, 2, 1, 2, ...
SPACED = ((0, 1, 2, 4, 6), (0, 1, 3, 4, 7), (0, 2, 3, 5, 8), (0, 1, 4, 6, 7), (0, 3, 4, 6, 9), (0, 1, 2, 3, 4))
#: Seeds of one diagonal this far apart, or farther, count as two.
APART = 6
#: How often two residues of usual shares are of one class.
ALIKE = 0.095


def seed_places(residues: int, by_chance: float = 15.0) -> tuple[tuple[int, ...], ...]:
    """The shortest seeds that a place shares with at most ``by_chance`` of all places by chance, so that chance pairs grow with the sequences, not with their square."""
    weight = len(SPACED[0])
    while residues * ALIKE**weight > by_chance:
        weight += 1
    return tuple((*p, *(p[-1] + k + (k + 1) // 2 for k in range(1, weight - len(p) + 1))) for p in SPACED)


def spaced_seeds(sequences: DataFrame, seeds: tuple[tuple[int, ...], ...] = SPACED) -> DataFrame:
    """(seed, name, at) of every place of every spaced seed; places with other letters have none; sequences: (name, sequence)."""
    letters = "".join(SIMILAR)
    classes = "".join(chr(97 + k) * len(group) for k, group in enumerate(SIMILAR))
    d = sequences.select("name", F.translate(F.regexp_replace(F.upper("sequence"), f"[^{letters}]", "-"), letters, classes).alias("s"))
    span = 1 + max(p[-1] for p in seeds)
    d = d.where(F.length("s") > 0).select("name", F.explode(F.transform(F.sequence(F.lit(0), F.length("s") - 1), lambda k: F.struct(k.alias("at"), F.substring("s", k + 1, F.lit(span)).alias("s")))).alias("x"))
    words = [F.concat(*[F.substring("x.s", o + 1, 1) for o in places]) for places in seeds]
    d = d.select("name", "x.at", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), w.alias("w")) for k, w in enumerate(words)])).alias("x"))
    return d.where((F.length("x.w") == len(seeds[0])) & ~F.contains("x.w", F.lit("-"))).select(F.xxhash64("x.k", "x.w").alias("seed"), "name", "at")


def candidate_pairs(sequences: DataFrame, params: SearchParams) -> DataFrame:
    """(a, b, shared, diagonal) with a < b; shared: seeds on the diagonal that has most, or k-mers (diagonal 0, of no meaning).

    Frequent seeds are split over tasks; hits of one diagonal are added up before they are shuffled.
    """
    if params.seeds == "kmer":
        pairs = self_pairs(kmer_index(sequences, params.kmer), ["kmer"], "name").groupBy(F.col("name_a").alias("a"), F.col("name_b").alias("b")).agg(F.count("*").alias("shared"))
        return pairs.where(F.col("shared") >= params.min_shared).withColumn("diagonal", F.lit(0))
    residues = sequences.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0))).first()[0]
    met = self_pairs(spaced_seeds(sequences, seed_places(residues)), ["seed"], "name", ("at",))
    lines = met.groupBy(F.col("name_a").alias("a"), F.col("name_b").alias("b"), (F.col("at_a") - F.col("at_b")).alias("diagonal")).agg(F.count("*").alias("n"), (F.max("at_a") - F.min("at_a")).alias("span"))
    lines = lines.where(F.col("span") >= APART)
    return lines.groupBy("a", "b").agg(F.max("n").alias("shared"), F.max_by("diagonal", F.struct("n", -F.col("diagonal"))).alias("diagonal"))


#: The BLOSUM62 matrix, rows and columns in this order of residues.
RESIDUES = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
GAP_OPEN, GAP_EXTEND = 11, 1
#: Slope and intercept of the estimated identity over the score per column.
ESTIMATE = (0.1656, 0.1141)
#: The Karlin-Altschul parameters of gapped scores with this matrix and these gaps.
LAMBDA, K = 0.267, 0.041


def _codes(pairs: list[tuple[str, str]]):
    """Residue numbers of both sides of each pair, -1 behind the end."""
    import numpy as np

    code = np.full(256, 22, np.int8)
    for i, c in enumerate(RESIDUES):
        code[ord(c)] = i
    out = []
    for side in (0, 1):
        rows = np.full((len(pairs), max((len(p[side]) for p in pairs), default=0)), -1, np.int8)
        for i, p in enumerate(pairs):
            own = p[side].upper().encode("latin-1", "replace")
            rows[i, : len(own)] = code[np.frombuffer(own, np.uint8)]
        out.append(rows)
    return out


def _scores_table():
    import numpy as np

    return np.array([list(map(int, r.split())) for r in BLOSUM62.strip().splitlines()], np.int32)


def ungapped_scores(pairs: list[tuple[str, str]], diagonals, x_drop: int):
    """The best score of a gapless stretch on each pair's diagonal, which ends where it falls by more than ``x_drop``."""
    import numpy as np

    if not pairs:
        return np.zeros(0, np.int32)
    table, (a, b) = _scores_table(), _codes(pairs)
    i = np.arange(a.shape[1])[None, :]
    j = i - np.asarray(diagonals)[:, None]
    inside = (a >= 0) & (j >= 0) & (j < b.shape[1])
    y = np.take_along_axis(b, np.clip(j, 0, max(0, b.shape[1] - 1)), axis=1)
    inside &= y >= 0
    step = np.where(inside, table[np.maximum(a, 0), np.maximum(y, 0)], -(10**4))
    best = np.zeros(len(pairs), np.int32)
    run, top = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32)
    for k in range(step.shape[1]):
        run = run + step[:, k]
        over = (run <= 0) | (run < top - x_drop)
        run[over], top[over] = 0, 0
        top = np.maximum(top, run)
        best = np.maximum(best, top)
    return best


def local_alignments(pairs: list[tuple[str, str]], diagonals=None, band: int = 0):
    """Affine-gap local alignments: an array of (score, identical, columns, start_a, end_a, start_b, end_b).

    All pairs of a batch advance together, cell by cell; identities, columns and starts
    travel with the scores, so there is no trace-back. With a band only the cells within
    it of each pair's diagonal (place in a minus place in b) are computed.
    """
    import numpy as np

    table = _scores_table()
    n, la, lb = len(pairs), max((len(a) for a, _ in pairs), default=0), max((len(b) for _, b in pairs), default=0)
    out = np.zeros((n, 7), np.int64)
    if not n or not la or not lb:
        return out
    a, b = _codes(pairs)
    low = -(10**6)
    banded = band > 0 and 2 * band + 1 < lb
    width = 2 * band + 1 if banded else lb
    # column w of row i is place i - diagonal - band + w of b, or w itself without a band
    shift = (-np.asarray(diagonals, np.int64) - band) if banded else np.zeros(n, np.int64)
    rows = np.arange(n)
    # state[w] = (score, identical, columns, start_a, start_b) of the best path that ends there; one more column on each side
    h, e = np.zeros((width + 2, n, 5), np.int32), np.full((width + 2, n, 5), low, np.int32)
    for i in range(la):
        x = a[:, i].astype(np.int64)
        new, fresh_e = np.zeros_like(h), np.full_like(e, low)
        f = np.full((n, 5), low, np.int32)
        for w in range(width):
            j = shift + w + (i if banded else 0)
            # above is one column to the right in a band, since its row starts one place earlier
            above, diag = (h[w + 2], h[w + 1]) if banded else (h[w + 1], h[w])
            e_above = e[w + 2] if banded else e[w + 1]
            opened, own = above.copy(), e_above.copy()
            opened[:, 0] -= GAP_OPEN + GAP_EXTEND
            own[:, 0] -= GAP_EXTEND
            better = opened[:, 0] > own[:, 0]
            own[better] = opened[better]
            own[:, 2] += 1
            opened = new[w].copy()
            opened[:, 0] -= GAP_OPEN + GAP_EXTEND
            f[:, 0] -= GAP_EXTEND
            better = opened[:, 0] > f[:, 0]
            f[better] = opened[better]
            f[:, 2] += 1
            y = np.where((j >= 0) & (j < b.shape[1]), b[rows, np.clip(j, 0, b.shape[1] - 1)], -1).astype(np.int64)
            ok = (x >= 0) & (y >= 0)
            best = diag.copy()
            fresh = best[:, 0] <= 0
            if fresh.any():
                best[fresh, 0], best[fresh, 1], best[fresh, 2], best[fresh, 3], best[fresh, 4] = 0, 0, 0, i, j[fresh]
            best[:, 0] = np.where(ok, best[:, 0] + table[np.maximum(x, 0), np.maximum(y, 0)], low)
            best[:, 1] += ok & (x == y)
            best[:, 2] += 1
            for gap in (own, f):
                better = gap[:, 0] > best[:, 0]
                best[better] = gap[better]
            own[~ok] = low
            f[~ok] = low
            best[(best[:, 0] < 0) | ~ok] = 0
            top = best[:, 0] > out[:, 0]
            if top.any():
                out[top, 0], out[top, 1], out[top, 2], out[top, 3], out[top, 5] = best[top].T
                out[top, 4], out[top, 6] = i + 1, j[top] + 1
            new[w + 1], fresh_e[w + 1] = best, own
        h, e = new, fresh_e
    return out


def extended_pairs(sequences: DataFrame, params: SearchParams) -> DataFrame:
    """(a, b, sa, sb, diagonal) of the candidates whose ungapped extension scores enough; k-mer candidates are not extended."""
    s = sequences.select("name", "sequence")
    pairs = candidate_pairs(sequences, params).select("a", "b", F.col("diagonal").cast("int").alias("diagonal"))
    d = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", "sa", "sb", "diagonal")

    def run(batches):
        for frame in batches:
            for at in range(0, len(frame), 512):
                f = frame.iloc[at : at + 512]
                yield f[ungapped_scores(list(zip(f["sa"], f["sb"], strict=True)), f["diagonal"].to_numpy(), params.x_drop) >= params.min_ungapped]

    return d.mapInPandas(run, d.schema) if params.seeds == "spaced" else d


def align(sequences: DataFrame, params: SearchParams = SearchParams(), remove_self_hits: bool = True) -> DataFrame:
    """Hits of an all-against-all search: seeds, ungapped and then banded extension in Arrow batches, filters, one hit per pair.

    pident is 0 to 100. Both sequences must be covered in coverage mode 0, the target in 1, the query in 2.
    With ``seeds="kmer"`` there is no ungapped extension, and the whole matrix is aligned.
    """
    import math

    size = sequences.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0))).first()[0]
    d = extended_pairs(sequences, params)
    if not remove_self_hits:
        d = d.unionByName(sequences.select(F.col("name").alias("a"), F.col("name").alias("b"), F.col("sequence").alias("sa"), F.col("sequence").alias("sb"), F.lit(0).alias("diagonal")))
    spaced = params.seeds == "spaced"

    def run(batches):
        import pandas as pd

        for frame in batches:
            for at in range(0, len(frame), 512):
                f = frame.iloc[at : at + 512]
                r = local_alignments(list(zip(f["sa"], f["sb"], strict=True)), f["diagonal"].to_numpy(), params.band if spaced else 0)
                la, lb = f["sa"].str.len().to_numpy(), f["sb"].str.len().to_numpy()
                bits = (LAMBDA * r[:, 0] - math.log(K)) / math.log(2)
                columns = r[:, 2].clip(1)
                share = r[:, 1] / columns if params.identity == "exact" else (ESTIMATE[0] * r[:, 0] / columns + ESTIMATE[1]).clip(0, 1)
                out = pd.DataFrame({"query": f["a"].to_numpy(), "target": f["b"].to_numpy(), "pident": 100.0 * share, "alnlen": r[:, 2].astype("int32"), "evalue": float(size) * la * 2.0**-bits, "bits": bits})
                qc, tc = (r[:, 4] - r[:, 3]) / la.clip(1), (r[:, 6] - r[:, 5]) / lb.clip(1)
                covered = {0: (qc >= params.min_coverage) & (tc >= params.min_coverage), 1: tc >= params.min_coverage, 2: qc >= params.min_coverage}[params.coverage_mode]
                yield out[covered & (out["pident"].to_numpy() >= 100 * params.min_identity) & (out["evalue"].to_numpy() <= params.e_value)]

    hits = d.mapInPandas(run, HITS)
    return dedup_mutual_hits(drop_self_hits(hits) if remove_self_hits else hits)


def _runs(n: int) -> Column:
    """The runs of n words of _w."""
    w = F.col("_w")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))


def shingles(docs: DataFrame, name: str, text: str, n: int = 5) -> DataFrame:
    """(name, shingle): distinct runs of n words between single spaces; shorter texts have none."""
    d = docs.select(F.col(name).alias("name"), F.split(F.col(text), " ").alias("_w")).where(F.size("_w") >= n)
    return d.select("name", F.explode(F.array_distinct(_runs(n))).alias("shingle"))


def hashed_sets(docs: DataFrame, name: str, text: str, n: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, size, s, kept columns): each text's hashed ``shingles`` in order of the hash, made where the text is."""
    d = docs.select(F.col(name).alias("name"), *keep, F.split(F.col(text), " ").alias("_w")).where(F.size("_w") >= n)
    d = d.select("name", *keep, F.sort_array(F.array_distinct(F.transform(_runs(n), lambda x: F.xxhash64(x)))).alias("s"))
    return d.select("name", F.size("s").alias("size"), "s", *keep)


#: Features fall into 2 to the power of this many buckets by their hash.
BUCKET_BITS = 21


def frequent_features(sets: DataFrame, least: float) -> DataFrame:
    """(h, df) of the features in more than ``least`` of the sets (of ``hashed_sets``, materialized).

    Buckets are counted first, which partitions reduce before the shuffle; then the features of buckets that reach so many.
    """
    bucket = F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int")
    h = sets.select(F.explode("s").alias("h"))
    full = materialize(h.groupBy(bucket.alias("b")).agg(F.count("*").alias("c")).where(F.col("c") > least).select("b"), "buckets")
    return h.join(F.broadcast(full), bucket == F.col("b"), "left_semi").groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") > least)


def frequent_last(sets: DataFrame, frequency: DataFrame) -> DataFrame:
    """``hashed_sets`` in the order of ``feature_sets`` by a frequency of few features (materialized), which go to where the sets are; of over ``SMALL_ROWS`` those in the sets are shuffled, and the sets."""
    if frequency.count() <= SMALL_ROWS:
        return _listed_last(sets, [tuple(r) for r in frequency.select("df", "h").collect()])
    listed = sets.select("name", F.explode_outer("s").alias("h")).join(frequency, "h")  # as in ``shared_sets``
    listed = listed.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x")).select("name", F.transform("x", lambda x: x["h"]).alias("_last"))
    last = F.coalesce("_last", F.array().cast("array<bigint>"))
    return sets.join(listed, "name", "left").withColumn("s", F.concat(F.array_except("s", last), last)).drop("_last")


def _listed_last(sets: DataFrame, listed: list[tuple[int, int]]) -> DataFrame:
    """sets with the features of listed (df, h) behind all others, in the order of listed."""
    import numpy as np

    if not listed:
        return sets
    ranks = {h: k for k, (_, h) in enumerate(sorted(listed), 1)}
    known = np.array(sorted(ranks), np.int64)
    rank = np.array([ranks[h] for h in known.tolist()], np.int32)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            at = batch.schema.get_field_index("s")
            own = batch.column(at)
            s, size = own.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(own).to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(known, s), len(known) - 1)
            order = np.lexsort((np.where(known[place] == s, rank[place], 0), np.repeat(np.arange(len(size)), size)))  # stable
            ends = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            yield batch.set_column(at, batch.schema.field(at), pa.ListArray.from_arrays(ends, pa.array(s[order]), type=own.type))

    return sets.mapInArrow(run, sets.schema)


def feature_sets(features: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """(name, size, s): each name's hashed features, rarest first; features: (name, shingle), distinct.

    frequency: (h, df) that fixes the order, so that sets made at other times can be
    joined; features it does not list count as the rarest. Without it features are counted.
    """
    f = features.select("name", F.xxhash64("shingle").alias("h"))
    df = f.groupBy("h").agg(F.count("*").alias("df")) if frequency is None else frequency
    counted = f.join(df, "h", "inner" if frequency is None else "left").select("name", F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), "h").alias("x"))
    return counted.groupBy("name").agg(F.sort_array(F.collect_list("x")).alias("s")).select("name", F.size("s").alias("size"), F.transform("s", lambda x: x["h"]).alias("s"))


#: Names, each with little besides, that are sent to where sets are, which are a hundred times as large.
SMALL_NAMES = 1_000_000


def set_key(s: Column) -> list[Column]:
    """128 bits of a sorted set, as two columns."""
    return [F.xxhash64(F.lit(1), s).alias("k1"), F.xxhash64(F.lit(2), s).alias("k2")]


def distinct_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets: name, size, s, k1, k2 and what else sets have, one for each equal set, under its least name; copies: name, copy_of); sets: materialized.

    A set may have any number of copies: they are counted before the shuffle and never
    stand in one row. Only names and keys are shuffled; the sets too where copies are more than ``SMALL_NAMES``.
    """
    keyed = sets.select("name", *set_key(F.col("s")))
    first = materialize(keyed.groupBy("k1", "k2").agg(F.min("name").alias("copy_of"), F.count("*").alias("c")), "distinct")
    named = join_counted(keyed, first.where("c > 1"), ["k1", "k2"], sets.count()).where("name <> copy_of")
    copies = materialize(named.select("name", "copy_of"), "copies")
    return join_lookup(sets, copies.select("name"), "name", "left_anti", SMALL_NAMES).withColumns(dict(zip(("k1", "k2"), set_key(F.col("s"))))), copies


def shared_sets(sets: DataFrame) -> DataFrame:
    """(name, size, s): of each set the features that others have too, rarest first, and the size of the whole set; sets: of ``hashed_sets``.

    No other feature can be shared, so these sets do for ``linked_sets``. Features are shuffled once, by feature. Sets of no shared feature go.
    """
    # no set is empty; explode would have its filter make each set once more, a text split for each run
    counted = sets.select("name", "size", F.explode_outer("s").alias("h")).withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    shared = counted.groupBy("name", "size").agg(F.sort_array(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "h"))).alias("x"))
    return shared.select("name", "size", F.transform("x", lambda x: x["h"]).alias("s"))


def least_shared(size: Column, min_pident: float) -> Column:
    """The features that a set of so many must share with any that is so similar."""
    return F.ceil(F.lit(float(min_pident)) * size / 100)


def linked_sets(left: DataFrame, right: DataFrame, min_pident: float, same: bool = False) -> DataFrame:
    """(query, target, pident) of similar sets of two tables, or of one (``same``, each pair once); tables: of ``feature_sets``, ``frequent_last`` or ``shared_sets``, materialized.

    Sets of similarity t share at least ``ceil(t * size)`` features, so k of those before the last
    ``ceil(t * size) - k`` of both, rarest first, whatever k. Pairs that meet there so often carry how many they share so far and how
    many can still follow the last one; only those that can reach t are verified on
    whole sets.
    """
    t = min_pident / 100
    meets = lambda size: 1 + F.floor(least_shared(size, min_pident) / 32)

    def prefix(sets: DataFrame, side: str) -> DataFrame:
        first = F.slice("s", F.lit(1), F.greatest(F.size("s") - least_shared(F.col("size"), min_pident) + meets(F.col("size")), F.lit(0)).cast("int"))
        d = sets.select(F.col("name").alias(side), F.col("size").alias(f"n_{side}"), F.size("s").alias("_k"), F.posexplode(first).alias("_at", "h"))
        return d.select(side, f"n_{side}", (F.col("_k") - F.col("_at")).alias(f"rest_{side}"), "h")

    met = prefix(left, "query").join(prefix(right, "target"), "h")
    met = met.where((F.col("query") < F.col("target")) if same else (F.col("query") != F.col("target"))).where(100.0 * F.least("n_query", "n_target") >= float(min_pident) * F.greatest("n_query", "n_target"))
    near = met.groupBy("query", "target").agg(F.count("*").alias("c"), *[F.min(x).alias(x) for x in ("rest_query", "rest_target", "n_query", "n_target")])
    most = F.col("c") + F.least("rest_query", "rest_target") - 1
    near = near.where(F.col("c") >= meets(F.least("n_query", "n_target"))).where(most >= t / (1 + t) * (F.col("n_query") + F.col("n_target")) - 1e-6).select("query", "target", "n_query", "n_target")
    shared = _shared_counts(materialize(near, "pairs"), left, None if same else right)
    return shared.select("query", "target", (100.0 * F.col("c") / (F.col("n_query") + F.col("n_target") - F.col("c"))).alias("pident")).where(F.col("pident") >= min_pident)


#: Features of the sets that a group of pairs may hold.
GROUP_FEATURES = 4_000_000


def _shared_counts(pairs: DataFrame, left: DataFrame, right: DataFrame | None) -> DataFrame:
    """pairs (query, target, n_query, n_target) with c, the number of features that both sets have; right: None if both sides are of one table.

    A set goes to groups of pairs, not to each pair: every name names the least of itself and those it
    is paired with, and a pair is of the lesser group of its two names, so a family of similar sets is mostly one group.
    Groups of many features are cut into blocks of pairs by hashes of the names.
    """
    import numpy as np

    kind, second = pairs.schema["query"].dataType.simpleString(), int(right is not None)
    ends = F.explode(F.array(F.struct(F.col("query").alias("name"), F.col("target").alias("to")), F.struct(F.col("target").alias("name"), F.col("query").alias("to"))))
    home = materialize(pairs.select(ends.alias("e")).groupBy("e.name").agg(F.min("e.to").alias("to")).select("name", F.least("name", "to").alias("home")), "homes")
    d = pairs
    for side in ("query", "target"):
        d = d.join(home.select(F.col("name").alias(side), F.col("home").alias(f"_{side}")), side)
    d = materialize(d.select("query", "target", "n_query", "n_target", F.least("_query", "_target").alias("home")), "grouped")

    def placed(d: DataFrame, *of: str) -> DataFrame:
        both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("query").alias("name"), F.col("n_query").alias("n")), F.struct(F.lit(second).alias("side"), F.col("target").alias("name"), F.col("n_target").alias("n"))))
        return d.select(*of, both.alias("e")).select(*of, "e.*").distinct()

    large = placed(d, "home").groupBy("home").agg(F.ceil(F.sum("n") / GROUP_FEATURES).cast("int").alias("_b")).where("_b > 1")
    parts = F.coalesce("_b", F.lit(1))
    i, j = F.pmod(F.xxhash64("query"), parts).cast("int"), F.pmod(F.xxhash64("target"), parts).cast("int")
    d = materialize(join_lookup(d, large, "home", "left").select("query", "target", "n_query", "n_target", "home", F.least(i, j).alias("i"), F.greatest(i, j).alias("j")), "blocks")
    group = ["home", "i", "j"]
    wanted = materialize(placed(d, *group).groupBy("side", "name").agg(F.collect_list(F.struct(*group)).alias("_in")), "wanted")
    rows = d.select(*group, F.lit(2).alias("side"), F.col("query").alias("name"), F.col("target").alias("to"), "n_query", "n_target", F.lit(None).cast("array<bigint>").alias("s"))
    for k, sets in enumerate((left, right)):
        if sets is not None:
            own = join_lookup(sets.select("name", "s"), wanted.where(F.col("side") == k).drop("side"), "name", "inner", SMALL_NAMES)
            rows = rows.unionByName(own.select(F.explode("_in").alias("g"), F.lit(k).alias("side"), "name", "s").select("g.*", "side", "name", "s"), allowMissingColumns=True)
    rows = rows.repartition(*group).sortWithinPartitions(*group, "side")

    def run(batches):
        import pyarrow as pa

        now, held = None, {}
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            groups = list(zip(*[column[c].to_pylist() for c in group], strict=True))
            side, name, to = (column[c].to_pylist() for c in ("side", "name", "to"))
            starts, values = column["s"].offsets.to_numpy(), column["s"].values.to_numpy()
            asked, c = [], []
            for k, g in enumerate(groups):
                if g != now:
                    now, held = g, {}
                if side[k] < 2:
                    held[side[k], name[k]] = np.sort(values[starts[k] : starts[k + 1]])
                else:
                    asked.append(k)
                    c.append(len(np.intersect1d(held[0, name[k]], held[second, to[k]], assume_unique=True)))
            rows = pa.array(asked, pa.int64())
            yield pa.record_batch([*[column[x].take(rows) for x in ("name", "to", "n_query", "n_target")], pa.array(c, pa.int32())], names=["query", "target", "n_query", "n_target", "c"])

    return rows.mapInArrow(run, f"query {kind}, target {kind}, n_query int, n_target int, c int")


def jaccard_join(features: DataFrame, min_pident: float) -> DataFrame:
    """(query, target, pident) of names whose feature sets are similar; features: (name, shingle), distinct."""
    sets = materialize(feature_sets(features), "sets")
    return linked_sets(sets, sets, min_pident, same=True)


def jaccard_texts(docs: DataFrame, name: str, text: str, min_pident: float, n: int = 5) -> DataFrame:
    """``jaccard_join`` of the texts' ``shingles``, whose sets are made where the text is."""
    sets = shared_sets(hashed_sets(docs, name, text, n)).where(F.size("s") >= least_shared(F.col("size"), min_pident))
    sets = materialize(sets, "sets")
    return linked_sets(sets, sets, min_pident, same=True)


def cosine_join(vectors: DataFrame, queries: DataFrame, min_pident: float) -> DataFrame:
    """(query, target, pident = 100 cosine): every stated query against all rows, in blocks; vectors, queries: (name, v).

    Queries travel to the rows block by block; a block is some thousand vectors.
    """
    import numpy as np

    total = queries.count()
    blocks = max(1, -(-total // 4096))
    out = None
    kind = vectors.schema["name"].dataType.simpleString()
    for k in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect()
        names = np.array([r["name"] for r in own])
        if not len(names):
            continue
        q = np.array([r["v"] for r in own], float)
        q /= np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]

        def run(batches, names=names, q=q):
            import pandas as pd

            for frame in batches:
                v = np.array(frame["v"].tolist(), float).reshape(len(frame), -1)
                if not len(v):
                    continue
                near = 100 * (q @ (v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]).T)
                i, j = np.nonzero(near >= min_pident)
                found = pd.DataFrame({"query": names[i], "target": frame["name"].to_numpy()[j], "pident": near[i, j]})
                yield found[found["query"] != found["target"]]

        part = vectors.select("name", "v").mapInPandas(run, f"query {kind}, target {kind}, pident double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], f"query {kind}, target {kind}, pident double")
