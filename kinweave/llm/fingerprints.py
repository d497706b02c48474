"""Document fingerprints by gamma-based consistent weighted sampling.

Terms are word 5-shingles, weighted by their counts. For each of 64 samples a term
of weight w draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from its hash, sets
t = floor(ln w / r + beta), ln y = r (t - beta) and ln a = ln c - ln y - r; the term
of least a is the sample, which keeps the term and t. Two texts agree in a sample
with the probability of their generalised Jaccard similarity, so the share of
agreeing samples estimates it. A term's r and c come from pools of 16 draws each;
every sample pairs another r with another c and has a beta of its own, so each
sample has the full distribution, and all 64 together the spread of some 47
independent ones (standard error 0.073 at similarity 0.5).

All is Spark expressions: documents are dealt to ranges of ids, each range also
gets the first document of the next one, and a window gives every text the next
one; the text moves once. Then the terms of both texts become rows, one for a
term that both hold once, and one aggregation in the same partitions takes all
minima of the shared terms, of the others of the text and of those of the edited
one, in generated code. The lesser of two minima is that of a whole text.

Defined results: a null text counts as empty; texts without words have the
fingerprint of their characters; two empty texts have likeness 1, an empty and
another one 0; equal ids stand by the hash of their texts, and null ids last; a
single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_ranges

SAMPLES, POOL = 64, 16
SHINGLE = 5
_ID_BITS = 38  # of a sample, for the term and t; the score has the bits above


def _unit(bits: Column, shift: int, width: int) -> Column:
    """(0, 1) from some bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) / float(1 << width)


def _with_hashes(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with the sorted hashes of a text's terms, each as often as it occurs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # each step is a column of its own: what a lambda refers to must not be computed anew for each element
    df = df.withColumn("_w", F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]++"), ""), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(SHINGLE)]))
    return df.withColumn(name, F.when(n > 0, F.sort_array(runs)).when(text != "", F.array(F.xxhash64(text, F.lit("characters")))).otherwise(F.array().cast("array<bigint>"))).drop("_w")


def _with_starts(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """df with the place of each distinct hash in the sorted array."""
    h = F.col(hashes)
    first = lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1))
    return df.withColumn(name, F.when(F.size(h) > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0))), first)).otherwise(F.array().cast("array<int>")))


def with_terms(df: DataFrame, text_col: str) -> DataFrame:
    """A row for each distinct term of each text: df's columns, _term and _weight; both null for an empty text."""
    df = _with_starts(_with_hashes(df, text_col, "_h"), "_h", "_at").select("*", F.posexplode_outer("_at").alias("_k", "_i"))
    return df.withColumns({"_term": F.get("_h", F.col("_i")), "_weight": (F.coalesce(F.get("_at", F.col("_k") + 1), F.size("_h")) - F.col("_i")).cast("double")}).drop("_h", "_at", "_k", "_i")


def _once_and_repeated(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """In place of a text _u, the terms that it holds once, and _t and _n, the others and how often; each name ends with k."""
    df = _with_hashes(df, text_col, "_h").drop(text_col)
    h, r, at = F.col("_h"), F.col("_r"), F.col("_at")
    again = F.filter(h, lambda x, i: x.eqNullSafe(F.get(h, i + 1)) | x.eqNullSafe(F.get(h, i - 1)))
    df = df.withColumn("_d", F.array_distinct("_h"))  # most texts repeat no term
    df = df.withColumn("_r", F.when(F.size("_d") < F.size("_h"), again).otherwise(F.array().cast("array<bigint>")))
    df = _with_starts(df.withColumn(f"_u{k}", F.when(F.size(r) == 0, F.col("_d")).otherwise(F.array_except("_d", "_r"))).drop("_h", "_d"), "_r", "_at")
    times = F.transform(at, lambda i, j: F.coalesce(F.get(at, j + 1), F.size(r)) - i)
    return df.withColumns({f"_t{k}": F.transform(at, lambda i: F.get(r, i)), f"_n{k}": times}).drop("_r", "_at")


#: Values of _in: a term that both texts hold once, and other terms of the one and of the other text.
BOTH, OWN, OTHER = 0, 1, 2


def with_terms_of_two(df: DataFrame, own: str, other: str) -> DataFrame:
    """The terms of two texts, in place of the texts: _in, _term and _weight. A term that both hold once is one row, as its samples are the same.

    A term that a text repeats is a row for each text. Each text pair has a row for
    each value of _in at least, with null term and weight where there is none.
    """
    df = _once_and_repeated(_once_and_repeated(df, own, 0), other, 1)
    once = F.array().cast("array<int>")
    rows = [(BOTH, F.array_intersect("_u0", "_u1"), once), (OWN, F.array_except("_u0", "_u1"), once), (OTHER, F.array_except("_u1", "_u0"), once), (OWN, F.col("_t0"), F.col("_n0")), (OTHER, F.col("_t1"), F.col("_n1"))]
    sets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), t.alias("t"), n.alias("n")) for i, t, n in rows]))
    df = df.withColumn("_s", sets).drop("_u0", "_u1", "_t0", "_t1", "_n0", "_n1").withColumns({"_in": F.col("_s.i"), "_n": F.col("_s.n"), "_t": F.col("_s.t")}).drop("_s")
    df = df.select(*[c for c in df.columns if c != "_t"], F.posexplode_outer("_t").alias("_k", "_term"))
    return df.withColumn("_weight", F.when(F.col("_term").isNotNull(), F.coalesce(F.get("_n", F.col("_k")), F.lit(1)).cast("double"))).drop("_n", "_k")


def minima(term: Column, weight: Column) -> list[Column]:
    """An aggregate for each sample: the least score << 38 | term and t. The pools are common subexpressions, made once a row."""
    r = [-F.log(_unit(x, 0, 32) * _unit(x, 32, 32)) for x in (F.xxhash64(term, F.lit(i)) for i in range(POOL))]
    c = [F.log(-F.log(_unit(x, 0, 32) * _unit(x, 32, 32))) for x in (F.xxhash64(term, F.lit(POOL + i)) for i in range(POOL))]
    out = []
    for k in range(SAMPLES):
        beta = _unit(F.xxhash64(term, F.lit(2 * POOL + k // 4)), 16 * (k % 4), 16)
        own, other = r[k % POOL], c[(k // POOL + k) % POOL]
        t = F.floor(F.log(weight) / own + beta)
        score = F.floor((F.greatest(other - own * (t - beta + 1), F.lit(-63.0)) + 64) * float(1 << 18))
        out.append(F.min(F.shiftleft(score, _ID_BITS).bitwiseOR(term.bitwiseXOR(t).bitwiseAND(F.lit((1 << _ID_BITS) - 1)))))
    return out


def likeness(a: Column, b: Column) -> Column:
    """The share of agreeing samples; 1 for two empty texts, 0 for an empty and another one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return same / float(SAMPLES)


def as_text(fingerprint: Column) -> Column:
    """Each sample's term and t as 10 hexadecimal digits; of an empty text the empty string."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << _ID_BITS) - 1)))), 10, "0")), "")


def _sampled(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    made = rows.groupBy(*keys).agg(*[m.alias(f"_m{k}") for k, m in enumerate(minima(F.col("_term"), F.col("_weight")))])
    return made.select(*keys, F.array(*[F.col(f"_m{k}") for k in range(SAMPLES)]).alias(name))


def fingerprints(df: DataFrame, keys: list[str], text_col: str, name: str) -> DataFrame:
    """keys and the fingerprint, array<bigint>, in a column of that name: one row for each value of the keys, which should be one for each text."""
    return _sampled(with_terms(df.select(*keys, text_col), text_col), keys, name)


def united(a: Column, b: Column) -> Column:
    """The fingerprint of a text from those of two parts of its terms."""
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def in_ranges(df: DataFrame, rows_per_range: int = 500) -> DataFrame:
    """df with _part, _guest and _place: ranges by descending doc_id, each with the first row of the next range as its guest.

    df: (doc_id, _tie, ...); _tie orders rows of one id. The row at _place + 1 of a
    part is the next row; the last range's guest is the first row of all. The
    ranges' first rows, one for each range, are broadcast: at most some 200,000 rows.
    """
    df = df.withColumn("_range", id_ranges(df, "doc_id", "_tie", rows_per_range))
    first = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), F.col("_tie").alias("tie"))
    firsts = df.groupBy(F.col("_range").alias("_at")).agg(F.max(first).alias("_first"))
    ranges = Window.orderBy(F.desc("_at"))  # over ranges, not documents
    every = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_at", "_first", F.coalesce(F.lag("_at").over(ranges), F.last("_at").over(every)).alias("_before"))
    df = df.join(F.broadcast(firsts), F.col("_range") == F.col("_at"))
    home, guest = F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("guest"))
    is_first = F.col("doc_id").eqNullSafe(F.col("_first.id")) & (F.col("_tie") == F.col("_first.tie"))
    df = df.withColumn("_to", F.explode(F.when(is_first, F.array(home, guest)).otherwise(F.array(home))))
    df = df.withColumns({"_part": F.col("_to.r"), "_guest": F.col("_to.guest")}).drop("_to", "_range", "_at", "_first", "_before")
    return df.withColumn("_place", F.row_number().over(_order()))


def _order() -> Window:
    return Window.partitionBy("_part").orderBy("_guest", F.desc_nulls_last("doc_id"), F.desc("_tie"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form: the last third replaced by the start of the next document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = in_ranges(d.withColumn("_tie", F.xxhash64("text"))).withColumns({"next_text": F.lead("text").over(_order()), "n_chars": F.length("text")})
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.substring("next_text", F.lit(1), third))
    d = d.select("_part", "_guest", "_place", "doc_id", "n_chars", "text", F.when(F.col("_guest") == 0, edited).alias("edited")).withColumn("sha", F.sha2("edited", 256))
    keys = ["_part", "_guest", "_place", "doc_id", "n_chars", "sha", "_in"]
    d = _sampled(with_terms_of_two(d, "text", "edited"), keys, "both")
    # a document's three rows, and the next document's, follow each other
    row = Window.partitionBy("_part").orderBy("_place", "_in")
    d = d.withColumns({c: F.lead("both", k).over(row) for k, c in enumerate(("own", "other", "next_both", "next_own"), 1)}).where(f"_guest = 0 and _in = {BOTH}")
    d = d.withColumns({"fp": united(F.col("both"), F.col("own")), "efp": united(F.col("both"), F.col("other")), "nfp": united(F.col("next_both"), F.col("next_own"))}).withColumnRenamed("sha", "edited_sha256")
    return d.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
