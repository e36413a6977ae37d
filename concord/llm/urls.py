"""URL filter: rules for hosts and paths, and boosted trees on lexical features for all other URLs.

Rules and trees are Spark SQL expressions of the URL alone, so nothing is shuffled and
no Python runs on executors. The trees are learned on the driver from a bounded set of
labelled URLs: those of a given table, or made ones, in which spam shows by its form and
not by words: hyphens, digits or noise in the host, depth, parameters, rare suffixes.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm import gbt
from concord.llm.shared import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = "(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """``com/en/`` is host com and path /en/."""
    if verdict not in ("allow", "block"):
        raise ValueError(f"unknown verdict: {verdict!r}")
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


RULES = (
    rule("block", "com/en/"),
    rule("allow", "example.com/en/7"),
    rule("allow", "net/de/"),
    rule("block", "example.net/de/8"),
    rule("block", "org/es/"),
)
#: Rules in one expression at most; more need a join of their own.
MOST_RULES = 500
#: Labelled URLs that are used for training at most.
SAMPLE_URLS = 20_000

# What the made URLs are put together from. Words say nothing about the label; suffixes do.
_PARTS = "ba co di fe ga hu jo ki lo ma ne pa qui ro sa te vu wi ya zo tra ple stri mon ber lin".split()
_SHARED_TOPS = "com com com net org info".split()
_GOOD_TOPS = "de fr es uk nl it eu edu gov ch at se pl jp ca au".split()
_BAD_TOPS = "xyz top click loan win bid icu buzz online site club work".split()
_SECTIONS = "en de fr es news articles blog posts wiki docs about archive category tags products help".split()


class _Urls:
    """Draws labelled URLs. Each label has forms of hosts, paths and queries of its own, and both share some."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_PARTS) for _ in range(self.r.randint(2, 4)))

    def noise(self, low: int, high: int, signs: str = LOWER + "0123456789") -> str:
        return "".join(self.r.choice(signs) for _ in range(self.r.randint(low, high)))

    def slug(self) -> str:
        return "-".join(self.word() for _ in range(self.r.randint(2, 7)))

    def good(self) -> str:
        r = self.r
        host = "-".join(self.word() for _ in range(r.choice((1, 1, 1, 1, 1, 2, 2, 3)))) + (str(r.randint(1, 99)) if r.random() < 0.04 else "")
        host = r.choice(("", "", "www.", "blog.", "en.", "m.", "docs.")) + host + (f".{self.word()}" if r.random() < 0.2 else "") + "." + r.choice(_SHARED_TOPS + _GOOD_TOPS)
        parts = [r.choice(_SECTIONS) for _ in range(r.choice((0, 0, 1, 1, 2, 3)))]
        if r.random() < 0.2:
            parts += [str(r.randint(1995, 2025)), f"{r.randint(1, 12):02d}"]
        parts += r.choice(([], [str(r.randint(1, 99999))], [self.slug()], [self.slug() + ".html"], [""]))
        query = r.choice(("", "", "", "#top", f"?id={r.randint(1, 9999)}", "?page=2&ref=x", f"?utm_source={self.word()}&utm_medium=feed&utm_campaign={self.word()}"))
        return host + "".join(f"/{x}" for x in parts) + query

    def bad(self) -> str:
        r = self.r
        forms = r.sample(("hyphens", "noise", "digits", "deep", "parameters"), r.choice((1, 1, 2, 2, 3)))
        host = self.word()
        if "hyphens" in forms:
            host = "-".join(self.word() for _ in range(r.randint(3, 6)))
        if "noise" in forms:
            host = self.noise(11, 26)
        if "digits" in forms:
            host = ".".join(str(r.randint(1, 254)) for _ in range(4)) if r.random() < 0.2 else host + self.noise(3, 7, "0123456789")
        if not host[-1].isdigit() or "digits" not in forms or "." not in host:
            host = "".join(f"{self.noise(2, 6)}." for _ in range(r.choice((0, 0, 0, 1, 3)))) + host + "." + r.choice(_SHARED_TOPS[2:] + _BAD_TOPS)
        parts = [r.choice(_SECTIONS) for _ in range(r.choice((0, 0, 1)))]
        if "deep" in forms:
            parts += [self.noise(3, 14) for _ in range(r.randint(5, 10))]
        query = "?" + "&".join(f"{self.noise(1, 6, LOWER)}={self.noise(3, 24)}" for _ in range(r.randint(4, 10))) if "parameters" in forms else r.choice(("", "", f"?{self.noise(1, 4)}={self.noise(2, 9)}"))
        return host + "".join(f"/{x}" for x in parts) + r.choice(("", "/")) + query


def labelled_urls(n: int = 6000, seed: int = 5) -> list[tuple[str, int]]:
    """Made URLs; label 1: to be blocked. Those have hosts of many hyphens, digits or noise, deep paths or many parameters."""
    draw = _Urls(seed)
    out = []
    for _ in range(n):
        bad = draw.r.random() < 0.4
        out.append((draw.r.choice(("http", "https")) + "://" + (draw.bad() if bad else draw.good()), int(bad)))
    return out


#: SQL of the functions that differ; {url}, {host} and {path} are the names of columns.
_DIALECTS = {
    "spark": {
        "entropy": "aggregate(transform(array_distinct(split({host}, '')), c -> (length({host}) - length(replace({host}, c, ''))) / length({host})), 0D, (s, p) -> s - p * ln(p))",
        "longest": "array_max(transform(split({host}, '[-.]'), x -> length(x)))",
        "last": "element_at(split({host}, '[.]'), -1)",
    },
    "duckdb": {
        "entropy": "list_sum(list_transform(list_distinct(string_split({host}, '')), lambda c: -((length({host}) - length(replace({host}, c, '')))::DOUBLE / length({host})) * ln((length({host}) - length(replace({host}, c, '')))::DOUBLE / length({host}))))",
        "longest": "list_max(list_transform(regexp_split_to_array({host}, '[-.]'), lambda x: length(x)))",
        "last": "string_split({host}, '.')[-1]",
    },
}
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "hyphens", "dots", "parameters", "entropy", "longest_part", "suffix_rate")


@dataclass(frozen=True)
class Model:
    """Share of blocked URLs by the last part of the host, and the trees."""

    suffixes: tuple[tuple[str, float], ...]
    prior: float
    trees: gbt.Trees

    def feature_sql(self, dialect: str, url: str = "url", host: str = "host", path: str = "path") -> dict[str, str]:
        """SQL of each feature, of columns with these names."""
        d = {k: v.format(url=url, host=host, path=path) for k, v in _DIALECTS[dialect].items()}
        count = lambda text, sign: f"(length({text}) - length(replace({text}, '{sign}', '')))"
        cases = " ".join(f"WHEN '{s}' THEN {r!r}" for s, r in self.suffixes)
        rate = f"CASE {d['last']} {cases} ELSE {self.prior!r} END" if cases else repr(self.prior)
        made = {
            "length": f"length({url})",
            "host_length": f"length({host})",
            "path_length": f"length({path})",
            "depth": count(path, "/"),
            "digit_ratio": f"CASE WHEN length({url}) = 0 THEN 0 ELSE CAST(length({url}) - length(translate({url}, '0123456789', '')) AS double) / length({url}) END",
            "host_digits": f"length({host}) - length(translate({host}, '0123456789', ''))",
            "hyphens": count(host, "-"),
            "dots": count(host, "."),
            "parameters": count(url, "="),
            "entropy": f"CASE WHEN length({host}) = 0 THEN 0 ELSE round({d['entropy']}, 6) END",
            "longest_part": f"coalesce({d['longest']}, 0)",
            "suffix_rate": rate,
        }
        return {k: f"CAST({v} AS double)" for k, v in made.items()}

    def margin_sql(self, names: Sequence[str] = FEATURES) -> str:
        """The trees' sum in SQL that both dialects read, of columns with these names for FEATURES."""

        def tree(t: int, node: int) -> str:
            inner = self.trees.feature.shape[1]
            if node >= inner:
                return f"CAST({float(self.trees.leaf[t, node - inner])!r} AS double)"
            bound = self.trees.bound[t, node]
            if not math.isfinite(bound):
                return tree(t, 2 * node + 1)
            return f"CASE WHEN {names[self.trees.feature[t, node]]} > {float(bound)!r} THEN {tree(t, 2 * node + 2)} ELSE {tree(t, 2 * node + 1)} END"

        return f"CAST({self.trees.base!r} AS double) + " + " + ".join(f"({tree(t, 0)})" for t in range(len(self.trees.leaf)))


def _split(url: str | None) -> tuple[str, str]:
    rest = (url or "").partition("://")[2]
    stop = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[stop:]
    return rest[:stop].translate(str.maketrans(UPPER, LOWER)), path[: min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))]


def _features(url: str, suffixes: dict[str, float], prior: float) -> list[float]:
    """FEATURES of a labelled URL, as feature_sql() has them."""
    host, path = _split(url)
    pieces = host.replace("-", ".").split(".")
    p = [c / len(host) for c in Counter(host).values()]
    digits = sum(c in "0123456789" for c in url)
    return [
        len(url), len(host), len(path), path.count("/"), digits / len(url) if url else 0, sum(c in "0123456789" for c in host), host.count("-"), host.count("."),
        url.count("="), round(-sum(x * math.log(x) for x in p), 6) if p else 0, max(map(len, pieces)), suffixes.get(host.split(".")[-1], prior),
    ]


def train(labelled: Sequence[tuple[str, int]]) -> Model:
    """A model of at most SAMPLE_URLS labelled URLs (url, 1: block); the rest, of a longer list, is left out evenly."""
    labelled = labelled[:: -(-len(labelled) // SAMPLE_URLS) or 1]
    prior = (sum(y for _, y in labelled) + 1) / (len(labelled) + 2)
    seen, bad = Counter(), Counter()
    for url, y in labelled:
        last = _split(url)[0].split(".")[-1]
        seen[last] += 1
        bad[last] += y
    plain = lambda s: s.replace("-", "").isalnum() and s.isascii()
    suffixes = {s: round((bad[s] + 10 * prior) / (n + 10), 4) for s, n in seen.most_common(100) if n >= 20 and plain(s)}
    # a third of the URLs show the trees their suffix as unknown, so that other signs count for new ones
    x = np.array([_features(u, suffixes if i % 3 else {}, prior) for i, (u, _) in enumerate(labelled)])
    trees = gbt.fit(x, np.array([y for _, y in labelled]), trees=30, depth=3, rate=0.3)
    return Model(tuple(sorted(suffixes.items())), round(prior, 4), trees)


@lru_cache
def default_model() -> Model:
    return train(labelled_urls())


def host_and_path(url: str = "url") -> tuple[str, str]:
    """SQL of both dialects for the host, A to Z lowered, and the path of a URL; both empty for null and without ``://``."""
    get = lambda g: f"coalesce(regexp_extract({url}, '{_PATTERN}', {g}), '')"
    return f"translate({get(1)}, '{UPPER}', '{LOWER}')", get(2)


def rule_sql(rules: Sequence[Rule], value: str) -> str:
    """SQL of columns host and path: text or verdict of the longest rule that fits, else null; of equally long ones the first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "''") + "'"
    fits = lambda r: f"(host = {quote(r.host)} OR right(host, {len(r.host) + 1}) = {quote('.' + r.host)}) AND left(path, {len(r.path)}) = {quote(r.path)}"
    cases = " ".join(f"WHEN {fits(r)} THEN {quote(getattr(r, value))}" for r in sorted(rules, key=lambda r: -len(r.text)))
    return f"CASE {cases} ELSE NULL END" if rules else "CAST(NULL AS string)"


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, model: Model | None = None) -> DataFrame:
    """``pages`` (url) with host, path, rule and verdict; all other columns stay, these are replaced.

    The verdict is that of the longest rule whose host is the URL's or a parent of it
    and whose path the URL's begins with; rule is its text. Where none fits, rule is
    null, and the trees decide: block if the log-odds are above 0. Null and empty URLs,
    and those without ``://``, have an empty host and path, and the trees judge them as
    they do any other; equal URLs get equal verdicts. Rows may repeat. An empty table
    stays empty.
    """
    model = model or default_model()
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    url, sure, *names = (free_name(pages, x) for x in ("url_in", "sure", *FEATURES))
    host, path = host_and_path(url)
    df = pages.withColumn(url, F.coalesce(F.col("url").cast("string"), F.lit(""))).select(*kept, F.col(url))
    df = df.select(*kept, url, F.expr(host).alias("host"), F.expr(path).alias("path"))
    made = model.feature_sql("spark", url)
    df = df.select("*", F.expr(rule_sql(rules, "text")).alias("rule"), F.expr(rule_sql(rules, "verdict")).alias(sure), *(F.expr(made[k]).alias(n) for k, n in zip(FEATURES, names, strict=True)))
    verdict = F.coalesce(F.col(sure), F.when(F.expr(model.margin_sql(names)) > 0, "block").otherwise("allow"))
    return df.select(*kept, "host", "path", "rule", verdict.alias("verdict"))


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """The verdicts of default_model() in DuckDB SQL, for the table pages."""
    model = default_model()
    host, path = host_and_path("url")
    made = ", ".join(f"{v} AS {k}" for k, v in model.feature_sql("duckdb").items())
    return f"""
WITH split AS (SELECT page_id, coalesce(url, '') AS url, {host} AS host, {path} AS path FROM pages),
featured AS (SELECT *, {made} FROM split)
SELECT page_id, host, path, {rule_sql(rules, "text")} AS rule,
  coalesce({rule_sql(rules, "verdict")}, CASE WHEN {model.margin_sql()} > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM featured
"""


def labelled_from(labelled: DataFrame) -> list[tuple[str, int]]:
    """At most SAMPLE_URLS rows of a table (url, label), those of the least hash, for train()."""
    rows = labelled.where("url IS NOT NULL AND label IN (0, 1)").orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLE_URLS)
    return [(r.url, r.label) for r in rows.select("url", "label").collect()]
