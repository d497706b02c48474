"""Secrets in texts: a pattern proposes candidates, a random forest removes false findings.

The forest reads a candidate's length, changes of character class, shares of
digits and distinct characters, the part that dictionary words cover, whether it
looks like a path, and the words before it. It is trained on labelled findings on
the driver (``findings_of`` takes them from a table; by default they are made by
rule) and written as one Spark expression, so the scan itself has no shuffle
and no Python.

A candidate is a run of 16 or more characters of keys; behind ``name=`` it is the
value, and the name is context. Right behind a telling word a value of 8 or more
characters is one too, with any signs but spaces, quotes and angle brackets.

Defined results: a null text counts as empty; a text without candidates has zero
counts and an empty list; rows are kept as they are, repeated ones included; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import matches, pieces, placed
from .trees import Tree, forest

#: Words that stand before secrets, and before other long strings.
TELLING = ("token", "secret", "key", "password", "passwd", "pwd", "api", "bearer", "auth", "credential", "private")
HARMLESS = ("commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "revision", "version", "etag", "integrity", "http", "href", "src", "file", "path", "id")
#: A run of characters of keys from its start, or from behind its last ``name=``.
_RUN = (
    r"(?:(?<![A-Za-z0-9_+/=.-])|(?<=[A-Za-z0-9_+/.-]=))(?=[A-Za-z0-9_+/=.-]{16})(?![A-Za-z0-9_+/.-]*+=[A-Za-z0-9_+/.-])"
    r"\.*+[A-Za-z0-9_+/=-]++(?:\.++[A-Za-z0-9_+/=-]++)*+"  # a last full stop is none of it
)
#: Right behind a telling word and a sign: a value of 8 or more characters, other signs included, up to a space, a quote or the next ``&name=``; of any length.
_VALUE = r"[^\s\"'`<>&]*[^\s\"'`<>&,;.:?)\]}]"
_TOLD = r"(?<=[\s\"'=:>])(?=[^\s\"'`<>=:][^\s\"'`<>&]{7}|[^\s\"'`<>=:&]+&(?!\w+=)[^\s\"'`<>]{6})(?<=(?i:" + "|".join(TELLING) + r")[^A-Za-z]{1,6})" + _VALUE + r"(?:&(?!\w+=)" + _VALUE + r")*+"
CANDIDATE = "(?:" + _TOLD + "|" + _RUN + ")"
#: Words that ordinary long strings are put together from.
DICTIONARY = (
    "about", "access", "account", "action", "address", "admin", "agent", "alpha", "android", "archive", "article", "asset", "author", "backup", "banner",
    "base", "beta", "binary", "block", "board", "body", "book", "border", "branch", "browser", "build", "button", "cache", "category", "center",
    "change", "channel", "check", "class", "client", "cloud", "cluster", "code", "color", "column", "comment", "common", "component", "config", "connect",
    "content", "control", "cookie", "copy", "core", "country", "create", "custom", "dashboard", "data", "database", "date", "debug", "default", "delete",
    "demo", "design", "detail", "device", "digital", "direct", "document", "domain", "download", "draft", "edit", "editor", "email", "engine", "error",
    "event", "example", "export", "feature", "feed", "field", "file", "filter", "folder", "font", "footer", "form", "format", "forum", "frame",
    "function", "gallery", "general", "global", "graph", "group", "guide", "header", "health", "help", "history", "home", "host", "house", "html",
    "image", "import", "index", "info", "input", "install", "item", "journal", "label", "language", "layout", "library", "license", "light", "link",
    "list", "local", "logger", "login", "manager", "market", "master", "media", "member", "menu", "message", "method", "mobile", "model", "module",
    "monitor", "music", "name", "network", "news", "node", "number", "object", "office", "online", "open", "option", "order", "output", "package",
    "page", "panel", "parent", "parser", "path", "photo", "plugin", "point", "post", "process", "product", "profile", "project", "property", "public",
    "query", "queue", "read", "record", "report", "request", "resource", "response", "result", "review", "river", "route", "sample", "schema", "script",
    "search", "section", "server", "service", "session", "setting", "share", "site", "source", "static", "status", "storage", "store", "stream", "style",
    "subject", "summary", "support", "system", "table", "target", "task", "template", "test", "text", "theme", "thread", "time", "title", "tool",
    "topic", "train", "type", "update", "upload", "user", "value", "version", "video", "view", "water", "widget", "window", "work", "world", "write",
)
#: Syllables of made-up words in the training rows.
SYLLABLES = ("ba", "ko", "lu", "mi", "nu", "pa", "sku", "vo", "za", "bra", "klo", "dru", "fli", "glo", "plu")
FEATURES = ("length", "changes", "digits", "uppers", "distinct", "covered", "path", "hex", "telling", "harmless", "signs")


def _features(text: Column, before: Column) -> Column:
    """The struct of FEATURES of one candidate."""
    n = F.length(text)
    without = lambda c, p: F.length(F.regexp_replace(c, p, ""))
    near = lambda words: F.lower(before).rlike("(?:" + "|".join(words) + r")[^a-z]{0,6}$").cast("double")
    changes = n - without(text, "(?<=[a-z])(?=[^a-z])[^a-z]|(?<=[A-Z])(?=[^A-Z])[^A-Z]|(?<=[0-9])(?=[^0-9])[^0-9]")
    own = (
        n.cast("double"),
        (changes / n),
        (1 - without(text, "[0-9]") / n),
        (1 - without(text, "[A-Z]") / n),
        (F.size(F.array_distinct(F.split(text, ""))) / F.least(n, F.lit(64))),
        (1 - without(F.lower(text), "(?:" + "|".join(DICTIONARY) + ")") / n),
        ((n - without(text, "[/.]")) / n),
        text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        near(TELLING),
        near(HARMLESS),
        (F.length(F.regexp_replace(text, "[A-Za-z0-9_+/=.-]", "")) / n),
    )
    # on a grid that no share of a length meets half-way, so that rounding cannot part this from training
    return F.struct(*[(F.floor(f * 1e6 + 0.3) / 1e6).alias(name) for name, f in zip(FEATURES, own, strict=True)])


def _row(text: str, before: str) -> list[float]:
    """The same for training, on the driver."""
    n = len(text)
    near = lambda words: float(bool(re.search("(?:" + "|".join(words) + r")[^a-z]{0,6}\Z", before.lower())))
    changes = len(re.findall("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]", text))
    own = [
        float(n), changes / n, len(re.findall("[0-9]", text)) / n, len(re.findall("[A-Z]", text)) / n, len(set(text)) / min(n, 64),
        1 - len(re.sub("(?:" + "|".join(DICTIONARY) + ")", "", text.lower())) / n, len(re.findall("[/.]", text)) / n,
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", text))), near(TELLING), near(HARMLESS), len(re.sub("[A-Za-z0-9_+/=.-]", "", text)) / n,
    ]
    return [math.floor(f * 1e6 + 0.3) / 1e6 for f in own]


def labelled_findings(n: int = 3000, seed: int = 6) -> list[tuple[str, str, int]]:
    """(candidate, words before it, label) made by rule: keys of usual forms, and what is mistaken for them."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    b64, hexa, alnum = string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_letters + string.digits
    told = lambda: r.choice(TELLING) + r.choice([' = "', ": ", "=", " ", "' '", " := "])
    told_not = lambda: r.choice(HARMLESS) + r.choice([" ", ": ", "=", ' = "'])
    made = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4)))
    word = lambda: "".join(r.choice(DICTIONARY) for _ in range(r.randint(1, 2))) if r.random() < 0.5 else made()
    plain = lambda: f"{word()} {word()} "
    mixed = lambda k: "".join(r.sample(pick(string.ascii_letters, k - 3) + pick(string.digits, 2) + pick("!@#$%^*~?", 1), k))
    signed = lambda: r.choice([mixed(r.randint(8, 24)), pick(alnum + "!@#$%^*~?&", r.randint(8, 24)) + pick("!@#$%^*~", 1) + pick(string.digits, 1)])
    secrets = [
        lambda: (pick(hexa, r.choice([32, 40, 64])), told()), lambda: (pick(hexa, r.choice([32, 40])).upper(), told()), lambda: (pick(b64, r.randint(24, 64)), told()),
        lambda: ("AKIA" + pick(string.ascii_uppercase + string.digits, 16), r.choice([told(), plain()])), lambda: (r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(alnum, r.randint(20, 40)), r.choice([told(), plain()])),
        lambda: (pick(alnum, r.randint(20, 48)), told()), lambda: (pick(b64, r.randint(36, 64)), plain()),
        lambda: (pick(hexa, r.choice([32, 40, 64])), r.choice(TELLING).upper() + "="), lambda: (pick(alnum, r.randint(10, 19)), told()),
        lambda: (signed(), told()), lambda: (pick(alnum.lower(), r.randint(12, 32)), told()),
    ]
    others = [
        lambda: ("".join(word() for _ in range(4))[: r.randint(16, 60)].ljust(16, "e"), plain()), lambda: ("/".join(word() for _ in range(4)) + "/index.html", plain()), lambda: (".".join(word() for _ in range(4)) + ".example.com", plain()),
        lambda: (pick(hexa, r.choice([32, 40, 64])), told_not()), lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice([told_not(), plain()])), lambda: (r.choice("=-_.") * r.randint(16, 80), plain()),
        lambda: (pick(string.digits, r.randint(16, 20)), plain()), lambda: ("_".join(word() for _ in range(4)).ljust(16, "n"), r.choice([plain(), told()])), lambda: ("".join(word().title() for _ in range(4)).ljust(16, "s"), r.choice([plain(), told()])),
        lambda: ("".join(word() for _ in range(4)).upper()[:40].ljust(16, "E"), plain()), lambda: (pick(string.digits, 4) + "-" + pick(string.digits, 2) + "-" + pick(string.digits, 2) + "-" + word() + word() + word(), plain()),
        lambda: (word() + "=" * r.randint(14, 30), plain()),
        lambda: ("".join(word() for _ in range(3))[: r.randint(8, 15)].ljust(8, "e"), told()), lambda: (r.choice("-_. ,").strip().join(word() for _ in range(3)).ljust(8, "n"), told()),
        lambda: (r.choice(["http://", "https://"]) + ".".join(word() for _ in range(2)) + ".example.com/" + word(), told()), lambda: (word() + r.choice(["(", "[", "{", "$", "::", "->"]) + word() + "." + word(), told()),
        lambda: (r.choice(["${", "{{", "$(", "%"]) + word().upper() + "_" + word().upper(), told()), lambda: (pick(string.digits, 4) + "-" + pick(string.digits, 2) + "-" + pick(string.digits, 2), told()),
    ]
    return [(*r.choice(secrets)(), 1) for _ in range(n)] + [(*r.choice(others)(), 0) for _ in range(n)]


@lru_cache(1)
def default_forest() -> tuple[Tree, ...]:
    rows = labelled_findings()
    return train(rows)


def findings_of(rows: DataFrame, most: int = 20_000) -> list[tuple[str, str, int]]:
    """Labelled findings of a table (candidate, before, label): all of them, or of more a hashed sample of about ``most``."""
    rows = rows.where("candidate is not null and label in (0, 1)")
    n = rows.count()
    dice = F.pmod(F.xxhash64("candidate", "before"), F.lit(1_000_000)) / 1_000_000
    return [(r["candidate"], r["before"] or "", r["label"]) for r in rows.where(dice < most / max(1, n)).select("candidate", "before", "label").collect()]


def train(findings: list[tuple[str, str, int]], trees: int = 15, depth: int = 6) -> tuple[Tree, ...]:
    """findings: (candidate, words before it, label), bounded by what the driver is given."""
    return tuple(forest(np.array([_row(t, b) for t, b, _ in findings]), np.array([y for *_, y in findings], float), trees, depth))


def forest_score(f: Column, trees: tuple[Tree, ...]) -> Column:
    """The mean of the trees' leaves as one expression over a struct of FEATURES."""

    def at(t: Tree, k: int) -> Column:
        if t.feature[k] < 0:
            return F.lit(round(t.value[k], 6))
        return F.when(f[FEATURES[t.feature[k]]] <= t.cut[k], at(t, t.left[k])).otherwise(at(t, t.right[k]))

    total = at(trees[0], 0)
    for t in trees[1:]:
        total = total + at(t, 0)
    return total / len(trees)


def find_secrets(docs: DataFrame, trees: tuple[Tree, ...] | None = None, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``secrets``: array<struct<start,end,text,score>>, and n_candidates."""
    trees = trees or default_forest()
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    d = d.withColumn("_m", matches(F.col("_text"), CANDIDATE, F.lit(True)))
    d = d.withColumn("_p", pieces(F.col("_text"), CANDIDATE, F.col("_m")))
    d = d.select(*keep, placed(F.col("_m"), F.col("_p")).alias("_c"))
    d = d.withColumn("_f", F.transform("_c", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), _features(c["text"], c["before"]).alias("f"))))
    d = d.withColumn("_s", F.transform("_f", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), forest_score(c["f"], trees).alias("score"))))
    return d.select(*keep, F.size("_c").alias("n_candidates"), F.filter("_s", lambda s: s["score"] >= threshold).alias("secrets"))
