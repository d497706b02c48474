"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node colours by category, and the colours of clusters and of others.
CATEGORY_COLORS = {"bacteria": "#2ca02c", "archaea": "#ffcc00", "plasmid": "#9467bd", "virus": "#d62728"}
OTHER_COLOR, CLUSTER_COLOR = "#7f7f7f", "#bbbbbb"
#: Placeholders in accession lists, and in numbers.
NO_ACCESSION = ("-", "nan", "N/A", "")


def sanitize(c: Column) -> Column:
    return F.translate(c, " |:;,()", "_______")


def accession_of_file(path: Column) -> Column:
    """The file's stem without any ``_proteins``."""
    return F.replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit("_proteins"), F.lit(""))


def product_of(description: Column) -> Column:
    rest = F.regexp_extract(F.trim(description), r"(?s)^\S+\s+(.+)$", 1)
    return F.when(rest == "", "hypothetical_protein").otherwise(rest)


def protein_key(taxon: Column, genome: Column, protein: Column, product: Column, index: Column) -> Column:
    return F.concat_ws("_", *map(sanitize, (taxon, genome, protein, product)), index.cast("string"))


def accession_of_organism(name: Column) -> Column:
    return F.concat(F.lit("NC_"), F.translate(name, ".", "_"))


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The two keys in code point order."""
    return F.least(a, b), F.greatest(a, b)


def pair_label(a: Column, b: Column) -> Column:
    """Null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("-", F.least(a, b), F.greatest(a, b)))


def category_color(category: Column) -> Column:
    out = None
    for name, color in CATEGORY_COLORS.items():
        is_it = F.lower(category) == name
        out = F.when(is_it, color) if out is None else out.when(is_it, color)
    return out.otherwise(OTHER_COLOR)


def one_decimal(c: Column) -> Column:
    return F.bround(c, 1)


def split_accessions(text: Column) -> Column:
    return F.filter(F.split(text, r"[,;\s|]+"), lambda x: ~x.isin(*NO_ACCESSION))


def accessions(main: Column, plasmids: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    own = F.coalesce(split_accessions(main), none)
    return own if plasmids is None else F.concat(own, F.coalesce(split_accessions(plasmids), none))


def _digits(c: Column, keep_point_zero: bool) -> Column:
    text = F.when(~F.lower(F.trim(c)).isin("-", "nan", "n/a", "", "none"), F.trim(c))
    text = text if keep_point_zero else F.regexp_replace(text, r"\.0+$", "")
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit(""))


def safe_int(c: Column, compat: bool = False) -> Column:
    """The digits as a number. A trailing ``.0`` goes first; with compat its digits stay."""
    return _digits(c, compat).try_cast("bigint")


def normalize_taxid(c: Column, compat: bool = False) -> Column:
    return _digits(c, compat)


def safe_filename(c: Column) -> Column:
    return F.substring(F.translate(c, "/\\", "__"), 1, 200)


def gc_percent(sequence: Column, digits: int = 1) -> Column:
    n = F.length(sequence)
    return F.when(n > 0, F.bround(100.0 * (n - F.length(F.translate(sequence, "GCSgcs", ""))) / n, digits))


def size_mb(sequence: Column, digits: int = 4) -> Column:
    return F.bround(F.length(sequence) / 1e6, digits)


def size_kb(sequence: Column, digits: int = 2) -> Column:
    return F.bround(F.length(sequence) / 1e3, digits)


def lineage_list(lineage: Column) -> Column:
    return F.filter(F.transform(F.split(lineage, ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def phylum(lineage: Column) -> Column:
    """The second entry of the lineage."""
    return F.get(lineage, F.lit(1))


def fit_quality(ks: Column) -> Column:
    return F.when(ks < 0.05, "Excellent").when(ks < 0.1, "Good").when(ks < 0.15, "Fair").otherwise("Poor")
