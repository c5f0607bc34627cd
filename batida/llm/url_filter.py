"""URL filters: host/path rules, then a weighted vocabulary.

The vocabulary is matched by an Aho-Corasick automaton over host and path.
A hit counts where no letter or digit touches it on either side. Strict
terms weigh 1, soft terms 0.5, each distinct term once; a url whose weights
reach 1 is blocked: one strict hit, or two distinct soft hits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELIMITER = "://"

# Rules as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# The vocabulary.
STRICT = ("adult", "casino", "escort", "gambling", "hentai", "malware", "phishing", "porn", "sportsbook", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cam", "cheap", "click", "crack", "dating", "deals", "farm", "free", "jackpot", "loan", "loans", "meds", "pharmacy", "pills", "poker", "promo", "sex", "slots", "track", "tracker", "win", "winner")


def weights(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> dict[str, float]:
    return {t: 0.5 for t in soft} | {t: 1.0 for t in strict}


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or end; A-Z lower-cased; '' without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to ? # or end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):  # the last one set wins: the longest
        h, _, p = rule.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def vocabulary_hits(terms: dict[str, float]):
    """A mapInArrow function that adds strict_hits and soft_hits (distinct terms) of `scanned`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        trie = ahocorasick.Automaton()
        for term, weight in terms.items():
            trie.add_word(term, (term, weight))
        if terms:
            trie.make_automaton()
        alnum = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in batches:
            strict, soft = [], []
            for text in batch.column("scanned").to_pylist():
                found: dict[str, float] = {}
                for end, (term, weight) in trie.iter(text) if text and terms else ():
                    start = end - len(term) + 1
                    if (start == 0 or text[start - 1] not in alnum) and (end + 1 == len(text) or text[end + 1] not in alnum):
                        found[term] = weight
                strict.append(sum(w >= 1 for w in found.values()))
                soft.append(sum(w < 1 for w in found.values()))
            keep = batch.drop_columns(["scanned"])
            yield keep.append_column("strict_hits", pa.array(strict, pa.int64())).append_column("soft_hits", pa.array(soft, pa.int64()))

    return run


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, terms: dict[str, float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits of every row.

    A null url or one without :// has empty host and path, no rule and no
    hits, so it is allowed. Repeated rows are judged alike, one result each;
    other columns are ignored. An empty table gives no rows. A conflict of
    equal rules is won by the one listed last. A url is read in whole, in a
    few times its length.
    """
    terms = weights() if terms is None else terms
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = split.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    scanned = ruled.withColumn("scanned", F.translate(F.concat("host", "path"), UPPER, LOWER))
    kinds = dict(ruled.dtypes)
    hits = scanned.mapInArrow(
        vocabulary_hits(terms),
        f"page_id {kinds['page_id']}, host string, path string, rule string, strict_hits long, soft_hits long",
    )
    by_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    by_terms = F.when(F.col("strict_hits") + 0.5 * F.col("soft_hits") >= 1, "block").otherwise("allow")
    return hits.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_terms).alias("verdict"), "strict_hits", "soft_hits")


def oracle() -> str:
    """DuckDB SQL for filter_urls with the rules and terms above."""
    case = " ".join(
        f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
        for h, _, p in (r.partition("/") for _, r in sorted(RULES, key=lambda r: -len(r[1])))
    )
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)
    words = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    return f"""
    WITH located AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS k FROM pages),
    rest AS (SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS r FROM located),
    split AS (SELECT page_id,
        translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    ruled AS (SELECT *, CASE {case} ELSE NULL END AS rule,
        list_distinct(regexp_split_to_array(translate(host || path, '{UPPER}', '{LOWER}'), '[^a-z0-9]+')) AS parts FROM split),
    hit AS (SELECT *, CAST(len(list_intersect(parts, {words(STRICT)})) AS BIGINT) AS strict_hits,
        CAST(len(list_intersect(parts, {words(SOFT)})) AS BIGINT) AS soft_hits FROM ruled)
    SELECT page_id, host, path, rule,
        CASE {verdicts} WHEN strict_hits + 0.5 * soft_hits >= 1 THEN 'block' ELSE 'allow' END AS verdict,
        strict_hits, soft_hits FROM hit
    """
