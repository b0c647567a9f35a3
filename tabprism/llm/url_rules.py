"""URL filters (operator 10): host rules and pattern rules.

**Host rules** name a host and a path prefix; a rule fits its host and all
subdomains, the longest fitting rule decides.  Each URL offers its host
suffixes, an equi-join on the suffix finds the rules.

**Pattern rules** are written as in ad-block lists: ``*`` any run of
characters, ``^`` a separator or the end, ``||`` the start of a host label,
``|`` an end of the URL, ``@@`` first for an exception.  Every rule is stored
under one literal token, the rarest in the judged URLs among the tokens that
each of its matches must contain as whole tokens.  URL tokens fetch candidate
rules, and only candidates run their regular expression.  A rule without such
a token is a candidate for every URL.

Work is done once per distinct URL: a URL that fills a third of the table is
one row after the map-side combine, and the verdicts are joined back on the
URL (a join that Spark splits when it is skewed).

Defined results: null URLs and URLs without ``://`` have empty host and path,
no rule fits them, the verdict is ``allow`` unless a pattern matches the text;
a null URL is always allowed.  Repeated rows each get their row.  Other
columns are not touched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprism.llm.common import ascii_lower

#: Lists up to this many rules may be broadcast (Spark decides by size beyond it).
BROADCAST_RULES = 10_000

_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def compile_pattern(rule: str) -> tuple[str, list[str], bool]:
    """(regular expression over the lower-cased URL, literal whole tokens, is an exception)."""
    body = rule.lower()
    exception = body.startswith("@@")
    body = body[2:] if exception else body
    out, start = "", 0
    if body.startswith("||"):
        out, start = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", 2
    elif body.startswith("|"):
        out, start = "^", 1
    end = len(body) - 1 if body.endswith("|") and len(body) > start else len(body)
    core = body[start:end]
    for ch in core:
        out += ".*" if ch == "*" else _SEPARATOR if ch == "^" else re.escape(ch)
    out += "$" if end < len(body) else ""
    # a token counts if the characters beside it are bound to be no token characters
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", core):
        before = core[m.start() - 1] != "*" if m.start() else start > 0
        after = core[m.end()] != "*" if m.end() < len(core) else end < len(body)
        if before and after:
            tokens.append(m.group())
    return out, sorted(set(tokens)), exception


def url_tokens(url: Column) -> Column:
    """Distinct runs of letters and digits of the lower-cased URL, and "" for rules without a token."""
    found = F.split(ascii_lower(url), "[^a-z0-9]+")
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_RULES else df


def pattern_matches(urls: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Distinct ``_url`` rows to (_url, pattern, exception) of the matching rules."""
    spark = urls.sparkSession
    compiled = [(p, *compile_pattern(p)) for p in patterns]
    rules = spark.createDataFrame([(p, rx, ex) for p, rx, _, ex in compiled], "pattern string, rx string, exception boolean")
    literal = spark.createDataFrame([(p, t) for p, _, ts, _ in compiled for t in ts] or [("", None)], "pattern string, token string")
    tokens = urls.select("_url", F.explode(url_tokens(F.col("_url"))).alias("token"))
    known = _small(literal.select("token").distinct(), len(patterns))
    seen = tokens.join(known, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (literal.join(seen, "token", "left")
             .groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
             .select("pattern", F.col("best.token").alias("token")))
    indexed = (rules.join(index, "pattern", "left")
               .select("pattern", "rx", "exception", F.coalesce("token", F.lit("")).alias("token")))
    candidates = tokens.join(_small(indexed, len(patterns)), "token")
    return candidates.where(F.regexp_like(ascii_lower(F.col("_url")), F.col("rx"))).select("_url", "pattern", "exception")


def host_matches(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Distinct ``_url`` rows to (_url, rule, rule_verdict) of the longest fitting host rule.

    Rules of equal length: the smaller text, then ``allow`` before ``block``.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v) for h, p, v in rules],
                                  "_suffix string, _prefix string, rule string, rule_verdict string")
    labels = F.split(F.col("_host"), r"\.")
    # a longer suffix than the longest rule fits none, however many labels a host has
    most = max((h.count(".") + 1 for h, _, _ in rules), default=1)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, most), "."))
    offered = (urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
               .select("_url", "_path", F.explode(suffixes).alias("_suffix")))
    fits = (offered.join(_small(table, len(rules)), "_suffix")
            .where(F.substring(F.col("_path"), F.lit(1), F.length("_prefix")) == F.col("_prefix")))
    best = F.min(F.struct((-F.length("rule")).alias("k"), F.col("rule"), F.col("rule_verdict"))).alias("best")
    return fits.groupBy("_url").agg(best).select("_url", "best.rule", "best.rule_verdict")


def judge_urls(df: DataFrame, key: str, url: str, host_rules: Sequence[tuple[str, str, str]],
               patterns: Sequence[str]) -> DataFrame:
    """One row per row of ``df``: key, host, path, rule, verdict and the deciding pattern.

    A host rule decides if one fits; else an exception pattern allows, a
    pattern blocks, and nothing allows.
    """
    pages = df.select(F.col(key).alias(key), F.col(url).alias("_url"))
    urls = pages.where(F.col("_url").isNotNull()).select("_url").distinct()
    hosts = host_matches(urls, host_rules)
    hits = (pattern_matches(urls, patterns).groupBy("_url")
            .agg(F.max("exception").alias("excepted"), F.min("pattern").alias("pattern")))
    # facts exist only for URLs that some rule touches; joined from one table
    facts = (hosts.select("_url", "rule", "rule_verdict", F.lit(None).cast("boolean").alias("excepted"),
                          F.lit(None).cast("string").alias("pattern"))
             .unionByName(hits.select("_url", F.lit(None).cast("string").alias("rule"),
                                      F.lit(None).cast("string").alias("rule_verdict"), "excepted", "pattern"))
             .groupBy("_url").agg(*[F.max(c).alias(c) for c in ("rule", "rule_verdict", "excepted", "pattern")]))
    verdict = (F.when(F.col("rule_verdict").isNotNull(), F.col("rule_verdict"))
               .when(F.col("excepted") == F.lit(False), F.lit("block")).otherwise(F.lit("allow")))
    return (pages.join(facts, "_url", "left")
            .select(key, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "rule",
                    verdict.alias("verdict"), "pattern"))
