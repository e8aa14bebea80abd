"""Verdicts on urls by a list of rules: a blocked Bloom filter lets possible hits through to an exact hash join.

A rule is a host, a path and a verdict; it fits its host and all subdomains where the url's path starts with the rule's.
A url is tested under the keys that a rule of the list could have: so many last labels of its host and so many first
characters of its path as some rule has. Each key reads one block of the filter, 256 bits in four words of which a
listed key sets two each; keys with all eight bits set go on to the hash join with the rules on host and path, which
removes the false positives, and the longest rule that fits gives the verdict. All steps are DataFrame functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import hot_and_cold, numbered, stored

#: Rules a block of 256 bits is made for: at eight bits a rule, few keys pass that aren't listed.
BLOCK_RULES = 16
#: The most blocks of a filter (about 40 MB of bits). A longer list lets more false positives through to the exact join, and misses no hit.
MOST_BLOCKS = 1 << 20
WORDS = 4
#: So many pairs of (labels of the host, characters of the path) are looked for one by one; a list with more gets all ends and beginnings tested.
MOST_SHAPES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is between the first "://" and the next "/", "?" or "#", A-Z in lower case; empty if there is no "://"."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty if there is no "://"."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def labels_of(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def canonical_rules(rules: DataFrame) -> DataFrame:
    """host (A-Z in lower case), path, verdict: one row a (host, path), of several verdicts "block". Rules with a null, or without a host, go."""
    host = F.translate("host", _UPPER, _LOWER)
    sound = rules.select(host.alias("host"), "path", "verdict").where("host <> '' AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    return sound.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def rule_keys(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """row, host, path: for each url the ends of its host and the beginnings of its path that a listed rule could be."""
    shapes = [tuple(r) for r in listed.select(labels_of(F.col("host")), F.length("path")).distinct().limit(MOST_SHAPES + 1).collect()]
    if len(shapes) <= MOST_SHAPES:
        known = F.from_json(F.lit(json.dumps([{"labels": a, "chars": b} for a, b in sorted(shapes)])), "array<struct<labels: int, chars: int>>")
        fits = urls.select("*", labels_of(F.col("host")).alias("n_labels"), F.length("path").alias("n_chars"))
        fits = fits.select("row", "host", "path", F.inline(F.filter(known, lambda s: (s["labels"] <= F.col("n_labels")) & (s["chars"] <= F.col("n_chars")))))
    else:  # every end of the host with every beginning of the path, as far as rules go
        most = listed.agg(F.max(labels_of(F.col("host"))), F.max(F.length("path"))).first()
        ends = urls.select("row", "host", "path", F.explode(F.sequence(F.lit(1), F.least(labels_of(F.col("host")), F.lit(most[0])))).alias("labels"))
        fits = ends.select("*", F.explode(F.sequence(F.lit(0), F.least(F.length("path"), F.lit(most[1])))).alias("chars"))
    return fits.select("row", F.expr("substring_index(host, '.', -labels)").alias("host"), F.expr("left(path, chars)").alias("path"))


def with_bits(keys: DataFrame, blocks: int) -> DataFrame:
    """keys (host, path and others) with their block in a filter of so many, and w0 to w3: their two bits in each word of it."""
    bit = lambda k: f"shiftleft(1L, cast(shiftright(bits, {6 * k}) & 63 as int))"
    words = {f"w{w}": F.expr(f"{bit(2 * w)} | {bit(2 * w + 1)}") for w in range(WORDS)}
    hashed = keys.withColumns({"block": F.pmod(F.xxhash64("host", "path"), F.lit(blocks)), "bits": F.xxhash64("path", "host", F.lit("bits"))})
    return hashed.withColumns(words).drop("bits")


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """block, f0 to f3: the words of every block in which a rule has bits."""
    return with_bits(rules, blocks).groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"f{w}") for w in range(WORDS)])


def possible_hits(keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The keys that the filter lets through. It has MOST_BLOCKS rows at most, so every task gets it whole."""
    met = with_bits(keys, blocks).join(F.broadcast(bloom), "block")
    return met.where(" AND ".join(f"w{w} & f{w} = w{w}" for w in range(WORDS))).select(keys.columns)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """id_col, host, path, rule, verdict of every row of pages: the longest rule that fits, or null and `otherwise`.

    rules: host, path, verdict ("allow" or "block"). Of rules of equal length the one with the longer host counts, of
    equal rules with both verdicts "block". A null url, and one without "://", has an empty host and path and fits no
    rule. Repeated rows stay rows of their own, null ids stay; an empty table gives one; without rules `otherwise` is
    everyone's verdict. Only the id and the url are read of pages, whatever other columns it has.
    """
    spark = pages.sparkSession
    docs, (page, url), _ = numbered(pages, id_col, url_col)
    listed = stored(canonical_rules(rules), "url-rules")
    n_rules = listed.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n_rules // BLOCK_RULES)))
    # rows in the shared folder keep their numbers when tasks run again
    urls = stored(docs.select(F.col(page).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("row")), "url-parts")

    keys = rule_keys(urls, listed)
    hits = stored(possible_hits(keys, stored(bloom_filter(listed, blocks), "url-bloom"), blocks), "url-hits")
    by_rule = stored(hits.groupBy("host", "path").agg(F.count("*").alias("n_hits")).join(listed, ["host", "path"]), "url-hit-rules")
    found = None
    for part in hot_and_cold(by_rule, "n_hits", hits.count()):
        more = hits.join(part, ["host", "path"])
        found = more if found is None else found.union(more)
    longest = F.struct(F.length(F.concat("host", "path")), F.length("host"), F.concat("host", "path").alias("rule"), "verdict")
    best = found.groupBy("row").agg(F.max(longest).alias("best"))
    out = urls.join(best, "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
