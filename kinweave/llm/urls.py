"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule ``host/path`` fits the host and its subdomains where the URL's path starts
with the rule's; the longest wins. Other URLs are judged by trees over lengths,
depth, digit ratios, entropy, parameter counts and statistics of the host's suffix
(its last label and its last two) in the labelled URLs. Training is on the driver
from a bounded list of labelled URLs (``urls_of`` takes it from a table; by default
it is made by rule, without words or hyphens that tell); judging is one Arrow pass
without a shuffle, and features and trees work on whole batches.

Defined results: a null URL, and one without ``://``, has an empty host and path
and goes to the trees; rows are kept as they are, repeated ones included; other
columns are ignored; URLs of any length are judged whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import tidy
from .trees import Tree, boost

#: The rules, as (verdict, host/path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Syllables of the made-up names in the bundled labelled URLs.
SYLLABLES = ("ba", "ko", "lu", "mi", "nu", "pa", "sku", "vo", "za", "bra", "klo", "dru", "fli", "glo", "plu", "wen", "tar", "sol", "mar", "vik")
#: Endings of hosts in the bundled labelled URLs, with their weights in plain and in spam ones.
ENDINGS = {"com": (40, 25), "org": (15, 5), "net": (10, 10), "edu": (5, 0.2), "de": (6, 2), "co.uk": (6, 1), "ac.uk": (2, 0.1), "com.au": (3, 1), "io": (4, 2), "info": (3, 10), "biz": (1, 8), "top": (0.5, 14), "xyz": (0.7, 14), "click": (0.2, 8)}
#: a label or two of a host are a suffix with statistics of its own from so many labelled URLs on
LEAST = 5


def labelled_urls(n: int = 3000, seed: int = 7, syllables: tuple[str, ...] = SYLLABLES) -> list[tuple[str, int]]:
    """(url, 1 for spam), made by rule.

    Names, hyphens, languages, slugs and page numbers are drawn alike for both. Spam
    shows two to four of seven signs, a plain URL in ten shows one: a random name,
    many subdomains, an address of numbers, random parts of the path, many
    parameters, escapes, a run of digits in the host.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    joined = lambda k: "-".join(word() for _ in range(k))
    drawn = lambda lo, hi: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(lo, hi)))
    number = lambda: str(r.randint(1, 10 ** r.randint(1, 8)))
    tops = list(ENDINGS)

    def url(spam: bool) -> str:
        few = r.randint(2, 4) if spam else int(r.random() < 0.1)
        signs = set(r.sample(("name", "labels", "address", "parts", "parameters", "escapes", "digits"), few))
        name = drawn(9, 24) if "name" in signs else joined(r.choice((1, 1, 1, 2, 2, 3)))
        name += str(r.randint(100, 999_999)) if "digits" in signs else ""
        before = [r.choice((word(), drawn(3, 8))) for _ in range(r.randint(2, 5))] if "labels" in signs else [r.choice(("www", "m", "blog", "en", word()))] if r.random() < 0.5 else []
        host = ".".join([*before, name, *([word()] if r.random() < 0.2 else []), r.choices(tops, [ENDINGS[t][spam] for t in tops])[0]])
        if "address" in signs:
            host = ".".join(str(r.randint(1, 255)) for _ in range(4)) + r.choice(("", ":8080"))
        kind = r.randint(0, 7)
        path = (
            [], [word()], [r.choice(("en", "de", "fr", "es")), number()], [word(), number(), joined(r.randint(2, 8))], [str(r.randint(1998, 2026)), f"{r.randint(1, 12):02}", joined(r.randint(2, 9))],
            [word(), "_".join(word().title() for _ in range(r.randint(1, 4)))], [word(), f"{word()}.html"], [word(), word(), word(), number()],
        )[kind]
        if "parts" in signs:
            path = [*path, *(drawn(8, 40) for _ in range(r.randint(1, 4)))]
        query = r.choice(("", "", "", "", f"?page={r.randint(1, 30)}", f"?{word()}={word()}", "?utm_source=feed", f"?id={number()}&ref={word()}"))
        if "parameters" in signs:
            query = "?" + "&".join(f"{word()}={r.choice((number(), word(), drawn(5, 30)))}" for _ in range(r.randint(4, 12)))
        if "escapes" in signs:
            query += ("&" if query else "?") + f"{word()}=" + "".join(f"%{r.randint(32, 255):02X}" + r.choice(("", word())) for _ in range(r.randint(3, 12)))
        end = r.choice(("", "", "/")) if not query else ""
        return f"http{r.choice(('', 's', 's'))}://{host}/{'/'.join(path)}{end}{query}{r.choice(('', '', '', '#top'))}"

    return [(url(bool(y)), y) for y in (1, 0) for _ in range(n)]


def urls_of(rows: DataFrame, most: int = 50_000) -> list[tuple[str, int]]:
    """Labelled URLs of a table (url, label): all of them, or of more a hashed sample of about ``most``."""
    rows = rows.where("url is not null and label in (0, 1)")
    n = rows.count()
    dice = F.pmod(F.xxhash64("url"), F.lit(1_000_000)) / 1_000_000
    return [(r["url"], r["label"]) for r in rows.where(dice < most / max(1, n)).select("url", "label").collect()]


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the row of each."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8), np.repeat(np.arange(len(column)), sizes)


def _entropy(column) -> np.ndarray:
    """Bits a byte, by the bytes of each row."""
    data, rows = _bytes(column)
    key, n = np.unique(rows << 8 | data, return_counts=True)
    size = np.maximum(1, np.bincount(rows, minlength=len(column)))
    share = n / size[key >> 8]
    return -np.bincount(key >> 8, share * np.log2(share), len(column))


def _longest(column, sign: str) -> np.ndarray:
    """Bytes of the longest part of each row between signs."""
    data, rows = _bytes(column)
    out = np.zeros(len(column))
    if len(data):
        cut = data == ord(sign)
        part = np.cumsum(cut | (np.diff(rows, prepend=-1) > 0))  # a sign or a row's first byte begins a part
        size = np.bincount(part, ~cut)
        np.maximum.at(out, rows, size[part])
    return out


def _hosts(urls):
    """The lower-case host of each URL; empty where there is no ``://``."""
    import pyarrow.compute as pc

    rest = pc.replace_substring_regex(urls, r"(?s)^.*?://", "")
    host = pc.ascii_lower(pc.replace_substring_regex(rest, r"(?s)[/?#].*$", ""))
    return pc.if_else(pc.match_substring(urls, "://"), host, "")


def _suffixes(hosts):
    """(last label, last two labels) of each host."""
    import pyarrow.compute as pc

    one = pc.replace_substring_regex(hosts, r"(?s)^.*\.", "")
    two = pc.struct_field(pc.extract_regex(hosts, r"(?s)(?P<s>[^.]+\.[^.]+)$"), 0)
    return one, pc.fill_null(two, "")


def features(urls, hosts, rate: np.ndarray) -> np.ndarray:
    """A row of numbers for each URL. urls, hosts: Arrow strings without nulls; rate: of the host's suffix."""
    import pyarrow.compute as pc

    number = lambda x: x.to_numpy(zero_copy_only=False).astype(float)
    count = lambda column, pattern: number(pc.count_substring_regex(column, pattern))
    tail = pc.replace_substring_regex(urls, r"(?s)^.*?://[^/?#]*", "")
    path = pc.replace_substring_regex(tail, r"(?s)[?#].*$", "")
    size, wide, letters = number(pc.utf8_length(urls)), number(pc.utf8_length(hosts)), count(hosts, "[a-z]")
    one_of = lambda k: np.maximum(1, k)
    return np.stack([
        size, wide, number(pc.utf8_length(tail)), count(hosts, r"\."), count(path, "/"), count(urls, "[0-9]") / one_of(size), count(hosts, "[0-9]"), count(hosts, "[0-9]") / one_of(wide),
        _entropy(hosts), _entropy(tail), count(tail, "[=&]"), count(tail, "%"), count(path, "[0-9]") / one_of(number(pc.utf8_length(path))), _longest(hosts, "."), _longest(path, "/"), count(hosts, "[aeiou]") / one_of(letters), rate,
    ], axis=1)


@dataclass
class UrlModel:
    prior: float
    one: dict[str, float]  # rate of spam by last label
    two: dict[str, float]  # and by last two
    base: float
    trees: list[Tree]

    def rates(self, hosts) -> np.ndarray:
        """The rate of spam of the longest known suffix."""
        out = np.full(len(hosts), self.prior)
        for known, column in zip((self.one, self.two), _suffixes(hosts), strict=True):
            values = np.array([known.get(s, np.nan) for s in column.to_pylist()], float)
            out = np.where(np.isnan(values), out, values)
        return out

    def scores(self, urls, hosts=None) -> np.ndarray:
        """urls: strings or nulls, as an Arrow column or a list."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(urls):
            return np.zeros(0)
        urls = pc.fill_null(pa.array(urls, pa.large_string()) if isinstance(urls, list) else urls.cast(pa.large_string()), "")
        hosts = _hosts(urls) if hosts is None else hosts.cast(pa.large_string())
        x = features(urls, hosts, self.rates(hosts))
        return 1 / (1 + np.exp(-(self.base + sum(t.apply(x) for t in self.trees))))


def train(labelled: list[tuple[str, int]], rounds: int = 80, depth: int = 3) -> UrlModel:
    """A suffix's rate is drawn to that of its last label, and that to the rate of all, by ten rows."""
    import pyarrow as pa

    y = np.array([label for _, label in labelled], float)
    prior = float(y.mean()) if len(y) else 0.0
    model = UrlModel(prior, {}, {}, 0.0, [])
    urls = pa.array([u for u, _ in labelled], pa.large_string())
    hosts = _hosts(urls)
    one, two = (column.to_pylist() for column in _suffixes(hosts))
    for known, names, outer in ((model.one, one, lambda s: prior), (model.two, two, lambda s: model.one.get(s.rpartition(".")[2], prior))):
        counts: dict[str, list[float]] = {}
        for s, label in zip(names, y.tolist(), strict=True):
            c = counts.setdefault(s, [0.0, 0.0])
            c[0] += label
            c[1] += 1
        known.update({s: (c[0] + 10 * outer(s)) / (c[1] + 10) for s, c in counts.items() if s and c[1] >= LEAST})
    model.base, model.trees = boost(features(urls, hosts, model.rates(hosts)), y, rounds, depth)
    return model


@lru_cache(1)
def default_model() -> UrlModel:
    return train(labelled_urls())


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    part = lambda k: F.when(at > 0, F.regexp_extract(rest, r"(?s)^([^/?#]*+)([^?#]*+)", k)).otherwise("")
    return F.coalesce(F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(part(2), F.lit(""))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    model = model or default_model()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            page, url, host, path = batch.columns
            yield pa.RecordBatch.from_arrays([page, host, path, pa.array(model.scores(url, host))], ["page_id", "host", "path", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    host, path = url_parts(F.col("url"))
    d = pages.select("page_id", "url", host.alias("host"), path.alias("path")).mapInArrow(tidy(run), f"page_id {kind}, host string, path string, score double")
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        top, slash, rest = text.partition("/")
        fits = ((F.col("host") == top) | F.endswith("host", F.lit("." + top))) & F.startswith("path", F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    rule, verdict = (F.lit(None).cast("string"), method) if rule is None else (rule, verdict.otherwise(method))
    return d.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
