"""Near-duplicate join on word n-grams by MinHash banding.

1. One Arrow pass hashes every text's n-grams, takes MinHash values and folds
   them into band hashes; band and row counts follow from the target recall.
2. Texts with the same word sequence become one representative (map-side
   combined aggregation), so a large group of copies costs one row.
3. A shuffle on band hashes finds buckets of two or more representatives; of
   buckets with the same members one is kept.
4. Buckets that share members make candidate groups. A small group is verified in
   one task on the full n-gram sets. A large one is cut into blocks, and a task
   verifies one pair of blocks: of the whole group, or of each bucket, whichever
   compares fewer pairs. So a chain of texts that are only alike from one to the
   next costs its buckets, and copies that share all buckets are compared once. In
   buckets a pair is verified in the first one that it shares only. Tasks return
   link counts and a spanning forest, never the pairs themselves.
5. The forests' components are the classes.

Defined results: null and empty texts have no n-grams and stay alone; texts of
under n words have one n-gram, all their words; texts without words but with
other characters equal only the identical text; a row whose id is null stays
alone with a null class unless its text has copies. Ids are unique but for
repeated rows, which are rows of the same class; should an id have several texts,
the least one is compared. Other columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .shared import Words, drop_scratch, materialize, mix64, row_key, slices, tidy


@dataclass(frozen=True)
class JaccardParams:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    max_hashes: int = 192
    #: texts in a block of a large candidate group, and n-grams at most on average
    block_texts: int = 192
    block_grams: int = 1_000_000

    def bands(self) -> tuple[int, int]:
        """(bands, rows): the most rows for which ``max_hashes`` hashes reach the recall at the threshold."""
        best = None
        for rows in range(1, 33):
            p = self.threshold**rows
            bands = 1 if p >= 1 else math.ceil(math.log(1 - self.recall) / math.log(1 - p))
            if bands * rows <= self.max_hashes:
                best = (bands, rows)
        if best is None:
            raise ValueError("max_hashes is too small for this recall and threshold")
        return best


def _grams(column, n: int) -> tuple[np.ndarray, np.ndarray, Words]:
    words = Words(column)
    grams, offsets = words.shingles(n)
    return grams, offsets, words


def _wordless(words: Words, i: int) -> int | None:
    """A hash of a text without words but with other characters."""
    import xxhash

    text = words.data[words.bounds[i] : words.bounds[i + 1]].tobytes()
    return xxhash.xxh64_intdigest(text) if text.strip() else None


def signatures(docs: DataFrame, params: JaccardParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key_hi, key_lo, bands array<bigint>): keys equal for equal word sequences; both null where the text is empty."""
    bands, rows = params.bands()
    n = params.n

    def run(batches):
        import pyarrow as pa
        import xxhash

        rng = np.random.default_rng(20_001)
        mults = rng.integers(0, 1 << 63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for part in slices(batch, 1, 512, 1 << 21):
                grams, offsets, words = _grams(part.column(1), n)
                count = np.diff(offsets)
                full = np.flatnonzero(count > 0)
                minima = np.zeros((bands * rows, len(full)), np.uint64)
                if len(full):
                    for k, m in enumerate(mults):
                        minima[k] = np.minimum.reduceat(grams * m, offsets[full])
                hashes = np.zeros((bands, len(full)), np.uint64)
                for b in range(bands):
                    value = np.full(len(full), b + 1, np.uint64)
                    for r in range(rows):
                        value = mix64(value ^ minima[b * rows + r])
                    hashes[b] = value
                hi, lo, lists = [None] * part.num_rows, [None] * part.num_rows, [[]] * part.num_rows
                signed = hashes.T.astype(np.int64)
                for j, i in enumerate(full):
                    raw = words.hashes[words.offsets[i] : words.offsets[i + 1]].tobytes()
                    d = xxhash.xxh3_128_digest(raw)
                    hi[i], lo[i], lists[i] = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), signed[j]
                for i in np.flatnonzero(count == 0):
                    if (h := _wordless(words, i)) is not None:
                        hi[i], lo[i] = h - (1 << 63), 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    ["doc_id", "key_hi", "key_lo", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id long, key_hi long, key_lo long, bands array<long>"
    )


def _met_before(earlier: list[np.ndarray]) -> np.ndarray:
    """Whether two rows share one of the buckets that each lists."""
    buckets, inverse = np.unique(np.concatenate(earlier), return_inverse=True)
    rows = np.repeat(np.arange(len(earlier)), [len(x) for x in earlier])
    met = np.zeros((len(earlier), len(earlier)), np.float32)
    order = np.argsort(inverse, kind="stable")
    rows, cols = rows[order], inverse[order]
    for at in range(0, len(buckets), 4096):
        lo, hi = np.searchsorted(cols, [at, at + 4096])
        x = np.zeros((len(earlier), min(4096, len(buckets) - at)), np.float32)
        x[rows[lo:hi], cols[lo:hi] - at] = 1
        met += x @ x.T
    return met > 0


def _link_block(sets: list[np.ndarray], side: np.ndarray, threshold: float, met: np.ndarray | None = None):
    """Links of one block pair. side: 0 left, 1 right; 2 both (the diagonal). met: pairs that another task verifies.

    Returns (link counts by row, forest edges as row pairs).
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    parent = np.arange(m)
    links = np.zeros(m, np.int64)
    edges: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def accept(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((i, j))

    if m <= 8:
        for i in range(m):
            for j in range(i + 1, m):
                if side[i] == side[j] != 2 or met is not None and met[i, j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]) else 0
                if both and both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9:
                    links[[i, j]] += 1
                    accept(i, j)
        return links, edges
    tokens, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    del tokens
    rows = np.repeat(np.arange(m), sizes)
    keep = seen[inverse] > 1
    rows, inverse = rows[keep], inverse[keep]
    dense = np.full(len(seen), -1)
    shared = np.flatnonzero(seen > 1)
    dense[shared] = np.arange(len(shared))
    cols = dense[inverse]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for at in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(cols, [at, at + 4096])
        x = np.zeros((m, min(4096, len(shared) - at)), np.float32)
        x[rows[lo:hi], cols[lo:hi] - at] = 1
        both += x @ x.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = both >= threshold * union - 1e-6
    linked &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    np.fill_diagonal(linked, False)
    if met is not None:
        linked &= ~met
    links = linked.sum(axis=1)
    for i in range(m):
        near = np.flatnonzero(linked[i, i + 1 :]) + i + 1
        for j in near:
            if parent[j] != parent[i]:
                accept(i, int(j))
    return links, edges


def _verify(frame: DataFrame, params: JaccardParams) -> DataFrame:
    """Runs over (task, comp, rid, side, earlier, text); returns rows (a, b, links): forest edges (a < b) and, with b null, link counts.

    earlier: in a bucket, the row's kept buckets before this one; null elsewhere.
    """
    n, threshold = params.n, params.threshold

    def run(table):
        import pyarrow as pa

        grams, offsets, _ = _grams(table.column("text"), n)
        comp, rid, side = (table.column(c).to_numpy() for c in ("comp", "rid", "side"))
        earlier = table.column("earlier").combine_chunks()
        order = np.lexsort((rid, comp))
        cuts = np.flatnonzero(np.diff(comp[order])) + 1
        a, b, links = [], [], []
        for own in np.split(order, cuts):
            sets = [np.unique(grams[offsets[i] : offsets[i + 1]]) for i in own]
            met = _met_before([earlier[int(i)].values.to_numpy() for i in own]) if earlier[int(own[0])].is_valid else None
            count, edges = _link_block(sets, side[own], threshold, met)
            for i, c in zip(own, count, strict=True):
                if c:
                    a.append(int(rid[i])), b.append(None), links.append(int(c))
            for i, j in edges:
                x, y = sorted((int(rid[own[i]]), int(rid[own[j]])))
                a.append(x), b.append(y), links.append(0)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    return frame.groupBy("task").applyInArrow(run, "a long, b long, links long")


def _blocks(rows: DataFrame) -> DataFrame:
    """rows of groups of nb blocks, each text once for every pair of blocks it is in; a pair of blocks is a task."""
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("nb")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    side = F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1)
    return rows.select(F.xxhash64("comp", F.least("blk", "other"), F.greatest("blk", "other")).alias("task"), "comp", "rid", side.alias("side"), "earlier", "text")


def ngram_jaccard_join(docs: DataFrame, params: JaccardParams = JaccardParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, class_id, copy_of, n_links.

    copy_of: the least id with the same words. n_links: how many other different
    texts have a similarity of ``threshold`` or more. class_id: the least id that
    links or copies lead to.
    """
    sigs = materialize(signatures(docs, params, id_col, text_col), "sig")
    keyed = sigs.where("doc_id is not null and key_hi is not null")
    reps = materialize(keyed.groupBy("key_hi", "key_lo").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("key_hi", "key_lo", F.col("r.doc_id").alias("rid"), F.col("r.bands").alias("bands")), "reps")
    rows = reps.select("rid", F.explode("bands").alias("bh"))
    # a bucket's members: their number and two sums of hashes; of equal buckets the least is kept
    kept = rows.groupBy("bh").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y"), F.min("rid").alias("hub")).where("n > 1")
    kept = kept.groupBy("n", "x", "y").agg(F.min("bh").alias("bh"), F.min("hub").alias("hub")).select("bh", "n", "hub")
    buckets = materialize(rows.join(kept, "bh"), "buckets")
    comps = components(buckets, "rid", "hub").select(F.col("node").alias("rid"), F.col("component").alias("comp"))
    text = docs.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("text"))
    text = comps.join(text, "rid").groupBy("rid", "comp").agg(F.min("text").alias("text"))  # repeated rows count once
    grams = F.length("text") / 6 + 1
    members = materialize(text, "members")
    blocks = lambda m: F.greatest(F.ceil(m / params.block_texts), F.ceil(F.col("grams") / params.block_grams)).cast("int")
    sizes = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum(grams).alias("grams")).select("comp", "m", blocks(F.col("m")).alias("nb"))
    within = buckets.join(comps, "rid").groupBy("comp").agg(F.sum("n").alias("compared"))  # the sum of squares: each member has its bucket's size
    sizes = materialize(sizes.join(within, "comp").select("comp", "nb", ((F.col("nb") > 1) & (F.col("compared") < F.col("m").cast("double") * F.col("m"))).alias("by_bucket")), "sizes")
    bins = max(16, members.count() // 256)
    cut = members.join(sizes, "comp")
    none = F.lit(None).cast("array<bigint>")
    small = cut.where("nb = 1").select(F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("task"), "comp", "rid", F.lit(2).alias("side"), none.alias("earlier"), "text")
    whole = _blocks(cut.where("nb > 1 and not by_bucket").select("comp", "rid", "nb", none.alias("earlier"), "text"))
    in_buckets = buckets.select("rid", "bh").join(cut.where("by_bucket").select("rid", "text"), "rid")
    each = in_buckets.groupBy("rid").agg(F.collect_list("bh").alias("every"))  # as many as there are bands at most
    in_buckets = in_buckets.join(each, "rid").select(F.col("bh").alias("comp"), "rid", F.filter("every", lambda x: x < F.col("bh")).alias("earlier"), "text")
    counts = in_buckets.groupBy("comp").agg(F.count("*").alias("m"), F.sum(grams).alias("grams")).select("comp", blocks(F.col("m")).alias("nb"))
    single = _blocks(in_buckets.join(counts, "comp"))
    found = materialize(_verify(small.unionByName(whole).unionByName(single), params), "links")
    drop_scratch(buckets, comps, members, sizes)
    classes = components(found.where("b is not null"), "a", "b").select(F.col("node").alias("rid"), F.col("component").alias("class_id"))
    links = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("n_links"))
    done = reps.select("key_hi", "key_lo", "rid").join(classes, "rid", "left").join(links, "rid", "left")
    # texts without a key match nothing; their ids spread them over all tasks
    out = sigs.select("doc_id", F.coalesce("key_hi", "doc_id").alias("key_hi"), F.coalesce("key_lo", F.lit(-1)).alias("key_lo")).join(done, ["key_hi", "key_lo"], "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "rid", "doc_id").alias("class_id"),
        F.coalesce("rid", "doc_id").alias("copy_of"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """The rows of docs without those whose class has a lesser id; of repeated rows of an id one stays.

    Rows without an id count as one for each text, and come after all ids.
    """
    keyed = docs.select(F.struct("*").alias("_row"), row_key().alias("_row_key"), "text")
    classes = ngram_jaccard_join(keyed, params, id_col="_row_key")
    gone = materialize(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("_row_key")).distinct(), "gone")
    kept = keyed.select("_row", "_row_key").join(gone, "_row_key", "left_anti")
    twice = keyed.groupBy("_row_key").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["_row_key"]) if twice else kept).select("_row.*")
