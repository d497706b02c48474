"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a Spark expression over one row: no shuffle, no Python. Patterns
use possessive repetition and look-behind guards, so a long run of one
character costs linear time and no stack.

Defined results: a null text counts as empty; a text without spans has empty
arrays, zero counts and the hash of the empty string; rows are kept as they are,
repeated ones included; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import apart, matches, pieces, placed


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of the text pass the Luhn checksum."""
    d = _digits(text)
    n = F.length(d)

    def weigh(total: Column, i: Column) -> Column:
        v = F.substring(d, n - i, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(v)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), weigh) % 10 == 0)


def mod97(text: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 modulo 97."""
    plain = F.regexp_replace(text, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), step) == 1


def _small_parts(text: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return text.rlike(rf"^{part}(?:\.{part}){{3}}$")


#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "TN": 24, "TR": 26,
}


def account_number(text: Column) -> Column:
    """The account number at the start of some groups: of the country's length, if that is listed; of several ends that pass modulo 97 the last."""
    groups = F.split(text, " ")
    heads = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    size = lambda h: F.length(F.replace(h, F.lit(" "), F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    fits = lambda h: F.coalesce(size(h) == F.try_element_at(known, F.substring(h, 1, 2)), size(h).between(15, 34)) & mod97(h)
    return F.get(F.filter(heads, fits), F.lit(0))


@dataclass(frozen=True)
class Detector:
    """score: of a bare match; proof: added if the checksum holds; near: added if a context word stands before it."""

    kind: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None
    #: the part of a match, from its start on, that is meant; null if there is none
    part: Callable[[Column], Column] | None = None
    score: float = 0.6
    proof: float = 0.3
    words: tuple[str, ...] = ()
    near: float = 0.1
    base: bool = False
    order: int = field(default=0)


#: The four base kinds, in the order that breaks ties.
BASE = (
    Detector("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), None, None, 0.8, 0.0, ("mail", "contact", "write"), base=True, order=0),
    Detector("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda t: t.rlike(r"[0-9]\.[0-9]"), _small_parts, None, 0.5, 0.2, ("ip", "host", "server", "address"), base=True, order=1),
    Detector("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), lambda m: F.length(_digits(m)).between(14, 19) & luhn(m), None, 0.2, 0.6, ("card", "visa", "credit", "payment"), base=True, order=2),
    Detector("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(10, 15), None, 0.5, 0.3, ("phone", "call", "tel", "mobile", "fax"), base=True, order=3),
)
#: What the method adds: account numbers by checksum, and formats that only context words can confirm.
ADDED = (
    Detector("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), lambda m: m.isNotNull(), account_number, 0.3, 0.5, ("iban", "account", "bank"), order=4),
    Detector("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"), None, None, 0.3, 0.0, ("ssn", "social", "security"), 0.4, order=5),
    Detector("local_phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])", lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), None, None, 0.3, 0.0, ("phone", "call", "tel", "mobile", "fax"), 0.4, order=6),
)


def find_pii(docs: DataFrame, detectors: tuple[Detector, ...] = BASE + ADDED, text_col: str = "text", threshold: float = 0.6, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``pii``: array<struct<start,order,end,kind,score,text,base>>, by start and kind.

    A base span stays whatever its score; another one needs the threshold and must not overlap a base span.
    """
    d = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.withColumns({f"_m_{x.kind}": matches(F.col("_text"), x.pattern, x.hint(F.col("_text"))) for x in detectors})
    d = d.withColumns({f"_p_{x.kind}": pieces(F.col("_text"), x.pattern, F.col(f"_m_{x.kind}")) for x in detectors})

    def scored(x: Detector) -> Column:
        words = "(?i)(?:" + "|".join(x.words) + ")"
        spans = placed(F.col(f"_m_{x.kind}"), F.col(f"_p_{x.kind}"))
        if x.part:
            spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), x.part(s["text"]).alias("text"), s["before"].alias("before")))
            spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end"), s["text"].alias("text"), s["before"].alias("before")))
        if x.valid:
            spans = F.filter(spans, lambda s: x.valid(s["text"]))
        proof = x.score + (x.proof if x.valid else 0.0)
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(x.order).alias("order"), s["end"].alias("end"), F.lit(x.kind).alias("kind"),
                (F.lit(proof) + F.when(s["before"].rlike(words), F.lit(x.near)).otherwise(F.lit(0.0))).alias("score"), s["text"].alias("text"), F.lit(x.base).alias("base"),
            ),
        )

    d = d.select(*keep, *[scored(x).alias(f"_s_{x.kind}") for x in detectors])
    join = lambda own: F.concat(*[F.col(f"_s_{x.kind}") for x in own]) if own else None
    base, more = join([x for x in detectors if x.base]), join([x for x in detectors if not x.base])
    d = d.select(*keep, *([base.alias("_base")] if base is not None else []), *([more.alias("_more")] if more is not None else []))
    every = F.col("_base") if base is not None else None
    if more is not None:
        added = F.filter(F.col("_more"), lambda s: s["score"] >= threshold)
        if base is not None:
            added = apart(added, F.col("_base"))
        every = F.concat(every, added) if every is not None else added
    return d.select(*keep, F.sort_array(every).alias("pii"))


def scores(spans: Column) -> Column:
    """The score of each span in hundredths, comma-joined in the same order."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
