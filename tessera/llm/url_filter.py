"""URL filters with DataFrame and SQL functions: host and path rules, else gradient-boosted trees on lexical features.

Features are plain SQL expressions that Spark and DuckDB share but for the names of a few functions, so the trained
model can be checked in SQL.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.gbt import Boosted, boost

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False))

#: Words that the labelled sample's hosts are made of.
BAD_WORDS = "spam farm casino win cheap pills ads track free bets adult cams loans fast lottery prize replica watch poker slots bonus crack warez miracle diet click bait".split()
GOOD_WORDS = "river garden museum library school journal bakery village science weather harbor theatre archive forum gallery recipe travel history football mountain".split()


def labelled_urls(n: int = 600, seed: int = 11) -> list[tuple[str, int]]:
    """A labelled sample: (url, 1 if it is to be blocked), made by rule from word lists and a seed."""
    rng, out = random.Random(seed), []
    syllables = ["th", "er", "ion", "ti", "re", "an", "he", "in", "on", "st", "ou", "ble", "ha", "nd"]
    for i in range(n):
        bad = i % 3 == 0
        if bad:
            name = "-".join(rng.sample(BAD_WORDS, rng.choice([2, 2, 2, 3])))
            if rng.random() < 0.3:
                name += f"{rng.choice(['', '-'])}{rng.randint(1, 9999)}"
        else:
            name = rng.choice(GOOD_WORDS) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
            if rng.random() < 0.05:
                name += f"-{rng.choice(GOOD_WORDS)}"
        host = rng.choice(["", "", "www.", "blog.", "m."]) + name + rng.choice([".example.com", ".example.org", ".example.net"])
        if bad and rng.random() < 0.3:
            host = name + rng.choice([".xyz", ".top", ".click", ".example.com"])
        path = "/" + "/".join(rng.choice(["en", "de", "fr", "es", "news", "item", str(rng.randint(1, 99999))]) for _ in range(rng.randint(1, 3)))
        query = rng.choice(["", "", "#top", ".html", "/", "?utm_source=feed", "?page=2&ref=x"])
        if bad and rng.random() < 0.4:
            query = "?" + "&".join(f"{rng.choice('abcdefgh')}{rng.randint(1, 99)}={rng.randint(1, 10**9)}" for _ in range(rng.randint(2, 6)))
        out.append((f"{rng.choice(['http', 'https'])}://{host}{path}{query}", int(bad)))
    return out


def _without(x: str, chars: str) -> str:
    return f"length(translate({x}, '{chars}', ''))"


def sql_parts(duckdb: bool = False) -> dict[str, str]:
    """host and path of a column url."""
    group = lambda p: f"regexp_extract(coalesce(url, ''), '{p}', 1)"
    return {"host": f"translate({group('://([^/?#]*)')}, '{UPPER}', '{LOWER}')", "path": group("://[^/?#]*([^?#]*)")}


def _literal(text: str, duckdb: bool) -> str:
    """A string in SQL; Spark's strings have escapes, DuckDB's double their quotes."""
    return "'" + (text.replace("'", "''") if duckdb else text.replace("\\", "\\\\").replace("'", "\\'")) + "'"


def sql_features(suffixes: dict[str, float], duckdb: bool = False) -> dict[str, str]:
    """Feature -> SQL over url, host and path."""
    url = "coalesce(url, '')"
    count = lambda x, c: f"(length({x}) - length(replace({x}, '{c}', '')))"
    last = "regexp_extract(host, '([^.]*)$', 1)"
    rates = " ".join(f"WHEN {last} = {_literal(s, duckdb)} THEN {r!r}" for s, r in sorted(suffixes.items()) if s != "")
    if duckdb:
        entropy = "round(coalesce(list_sum(list_transform(list_distinct(string_split(host, '')), lambda c: -((length(host) - length(replace(host, c, ''))) / length(host)::DOUBLE) * log2((length(host) - length(replace(host, c, ''))) / length(host)::DOUBLE))), 0), 4)"
    else:
        entropy = "round(aggregate(array_distinct(split(host, '')), 0D, (a, c) -> a - CASE WHEN c = '' THEN 0D ELSE ((length(host) - length(replace(host, c, ''))) / length(host)) * log2((length(host) - length(replace(host, c, ''))) / length(host)) END), 4)"
    return {
        "url_chars": f"length({url})",
        "depth": count("path", "/"),
        "digit_share": f"(length({url}) - {_without(url, '0123456789')}) / greatest(length({url}), 1)",
        "host_entropy": f"CASE WHEN host = '' THEN 0 ELSE {entropy} END",
        "params": f"{count(url, '&')} + CASE WHEN {count(url, '?')} > 0 THEN 1 ELSE 0 END",
        "host_hyphens": count("host", "-"),
        "host_labels": count("host", "."),
        "host_chars": "length(host)",
        "host_digits": f"length(host) - {_without('host', '0123456789')}",
        "suffix_rate": f"CASE {rates} ELSE {suffixes['']!r} END" if rates else repr(suffixes[""]),
    }


def features(url: str, suffixes: dict[str, float]) -> dict[str, float]:
    """The same features of one url, for training."""
    rest = url.partition("://")[2] if "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut].translate(str.maketrans(UPPER, LOWER)), rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    digits = lambda s: sum(c in "0123456789" for c in s)
    return {
        "url_chars": len(url),
        "depth": path.count("/"),
        "digit_share": digits(url) / max(len(url), 1),
        "host_entropy": round(-sum(n / len(host) * math.log2(n / len(host)) for n in Counter(host).values()), 4) if host else 0,
        "params": url.count("&") + ("?" in url),
        "host_hyphens": host.count("-"),
        "host_labels": host.count("."),
        "host_chars": len(host),
        "host_digits": digits(host),
        "suffix_rate": suffixes.get(host.rpartition(".")[2], suffixes[""]),
    }


@dataclass(frozen=True)
class UrlModel:
    trees: Boosted
    suffixes: dict


#: Labelled rows that a model is fitted on, and suffixes that it tells apart, at most.
MOST_LABELLED, MOST_SUFFIXES = 50_000, 200


def fit(labelled: list[tuple[str, int]], most: int = MOST_LABELLED, seed: int = 0) -> UrlModel:
    """Trees and suffix statistics (smoothed share of blocked urls by last host label; '' for unseen ones).

    Of more than ``most`` rows a sample is read, by a seeded hash of the url; of more suffixes than MOST_SUFFIXES the
    most frequent are told apart. Without any row every url is allowed.
    """
    if len(labelled) > most:
        labelled = sorted(labelled, key=lambda r: (xxhash.xxh3_64_intdigest(r[0], seed), r))[:most]
    if not labelled:
        labelled = [("", 0)]
    share = sum(y for _, y in labelled) / len(labelled)
    seen: dict[str, list[int]] = {}
    for url, y in labelled:
        seen.setdefault(url.partition("://")[2].partition("/")[0].rpartition(".")[2], []).append(y)
    known = sorted(seen, key=lambda s: (-len(seen[s]), s))[:MOST_SUFFIXES]
    suffixes = {"": round(share, 6)} | {s: round((sum(seen[s]) + 5 * share) / (len(seen[s]) + 5), 6) for s in seen if s in set(known)}
    return UrlModel(boost([features(u, suffixes) for u, _ in labelled], [y for _, y in labelled]), suffixes)


def fit_table(labelled: DataFrame, most: int = MOST_LABELLED, seed: int = 0) -> UrlModel:
    """``fit`` on a table (url, label 0 or 1, 1 to block): a sample of at most ``most`` of its rows with both reaches the driver."""
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("int").alias("label"))
    return fit([tuple(r) for r in rows.orderBy(F.xxhash64(F.lit(seed), "url"), "url", "label").limit(most).collect()], most, seed)


@lru_cache(maxsize=1)
def default_model() -> UrlModel:
    return fit(labelled_urls())


def sql_rule(rules: tuple[Rule, ...], value: str) -> str:
    """The longest fitting rule's name ('name') or verdict ('verdict'), else null; the rules are tried longest first."""
    cases = []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        suffix, n = f".{r.host}", len(r.host) + 1
        said = r.name if value == "name" else "allow" if r.allow else "block"
        cases.append(f"WHEN (host = '{r.host}' OR right(host, {n}) = '{suffix}') AND left(path, {len(r.path)}) = '{r.path}' THEN '{said}'")
    return f"CASE {' '.join(cases)} ELSE NULL END" if cases else "CAST(NULL AS STRING)"


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: UrlModel | None = None) -> DataFrame:
    """pages (url) with host, path, rule, verdict, block_score (log-odds); columns of pages with such names are replaced.

    A null url, or one without "://", has an empty host and path and no rule; the model still judges it. Rows are
    judged each by itself, in one pass without a shuffle.
    """
    model = model or default_model()
    named = {"host", "path", "rule", "verdict", "block_score", *sql_features(model.suffixes)}
    out = pages.drop(*named)
    rest = out.columns
    out = out.withColumns({k: F.expr(v) for k, v in sql_parts().items()})
    out = out.withColumns({k: F.expr(v).cast("double") for k, v in sql_features(model.suffixes).items()})
    out = out.withColumn("block_score", F.expr(model.trees.sql())).withColumn("rule", F.expr(sql_rule(rules, "name")))
    verdict: Column = F.coalesce(F.expr(sql_rule(rules, "verdict")), F.when(F.col("block_score") > 0, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).select(*rest, "host", "path", "rule", "verdict", "block_score")


def duckdb_sql(model: UrlModel | None = None, rules: tuple[Rule, ...] = RULES) -> str:
    """The registered query's rows, in DuckDB's SQL."""
    model = model or default_model()
    feats = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in sql_features(model.suffixes, duckdb=True).items())
    parts = ", ".join(f"{v} AS {k}" for k, v in sql_parts(duckdb=True).items())
    return (
        f"WITH parts AS (SELECT page_id, url, {parts} FROM pages), f AS (SELECT *, {feats} FROM parts) "
        f"SELECT page_id, host, path, {sql_rule(rules, 'name')} AS rule, coalesce({sql_rule(rules, 'verdict')}, CASE WHEN {model.trees.sql()} > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM f"
    )
