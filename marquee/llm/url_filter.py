"""URL filter: a weighted vocabulary matched by Aho-Corasick, under a list of host and path rules.

The automaton finds all terms of the vocabulary in one pass over a URL. A hit counts if no letter or digit
touches it on either side. One strict term rejects the URL; soft terms do if several different ones occur.
Rules go first: of those that fit, the longest decides.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule, and is
judged by the terms in it (a null one is allowed). Page ids may be null or repeat; every row is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of this filter's own choosing.
STRICT = ("porn", "porno", "xxx", "xvideos", "hentai", "camgirls", "escorts", "warez", "keygen", "spam-farm", "linkfarm", "phishing", "malware")
SOFT = ("sex", "adult", "nude", "casino", "poker", "betting", "bet", "jackpot", "slots", "viagra", "pills", "loan", "loans", "payday",
        "cheap", "free", "download", "torrent", "crack", "serial", "clickbait", "spam", "promo", "ads")
SOFT_HITS = 2
# The rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    raw = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does. A short list: it becomes part of the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def automaton(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> ahocorasick.Automaton:
    terms = ahocorasick.Automaton()
    for kind, words in (("soft", soft), ("strict", strict)):
        for word in words:
            terms.add_word(word, (kind, word))
    terms.make_automaton()
    return terms


def hits(url: str, terms: ahocorasick.Automaton) -> tuple[list[str], list[str]]:
    """The different strict and soft terms in a lower-case URL that stand by themselves."""
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for end, (kind, word) in terms.iter(url):
        before, after = url[end - len(word):end - len(word) + 1], url[end + 1:end + 2]
        if not before.isalnum() and not after.isalnum():
            found[kind].add(word)
    return sorted(found["strict"]), sorted(found["soft"])


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
               strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the strict and soft terms found."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in parts:
            found = [hits(u or "", terms) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array([f[i] for f in found], pa.list_(pa.string())) for i in (0, 1))],
                                             ["page_id", "host", "path", "rule", "strict_terms", "soft_terms"])

    url = F.col(url_col)
    cut = pages.select(F.col(id_col).cast("long").alias("page_id"), F.lower(url).alias("url"), host(url).alias("host"), path(url).alias("path"))
    ruled = cut.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    schema = "page_id long, host string, path string, rule struct<rule:string,verdict:string>, strict_terms array<string>, soft_terms array<string>"
    rejected = (F.size("strict_terms") >= 1) | (F.size("soft_terms") >= soft_hits)
    return ruled.mapInArrow(scan, schema).select(
        "page_id", "host", "path", F.col("rule.rule").alias("rule"),
        F.coalesce("rule.verdict", F.when(rejected, "block").otherwise("allow")).alias("verdict"), "strict_terms", "soft_terms")
