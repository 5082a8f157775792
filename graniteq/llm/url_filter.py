"""URL filtering: host and path rules, and a weighted vocabulary.

An Aho-Corasick automaton finds the vocabulary's terms in the whole URL (A-Z
lowered). A hit counts where no letter or digit touches it on either side. A
term has a weight, strict terms as much as two soft ones, and the distinct terms'
weights are summed: one strict term rejects the URL, and so do two or more
distinct soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from graniteq.llm.common import LOWER, UPPER, take
from graniteq.llm.url_terms import REJECT_WEIGHT, terms

STRICT, SOFT = terms(2), terms(1)
SOFT_TERMS_TO_REJECT = REJECT_WEIGHT  # as each weighs 1

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWERED = str.maketrans(UPPER, LOWER)


@cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, terms in ((0, soft), (1, strict)):  # a term of both lists is strict
        for t in terms:
            a.add_word(t, (t, kind))
    a.make_automaton()
    return a


def hits(url: str | None, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> tuple[int, int]:
    """The numbers of distinct strict and distinct soft terms in one URL."""
    if not url:
        return 0, 0
    text, found = url.translate(_LOWERED), set()
    for end, (term, kind) in _automaton(tuple(strict), tuple(soft)).iter(text):
        start = end + 1 - len(term)
        if (start and text[start - 1] in _WORD) or (end + 1 < len(text) and text[end + 1] in _WORD):
            continue
        found.add((term, kind))
    n_strict = sum(kind for _, kind in found)
    return n_strict, len(found) - n_strict


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty without ://."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def judge_urls(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_terms: int = SOFT_TERMS_TO_REJECT,
) -> DataFrame:
    """One row for each row: id, host, path, rule, verdict, n_strict, n_soft.

    A rule fits its host and all subdomains where the path starts with its own;
    of those that fit the longest (host and path) decides, else the vocabulary
    does. ``rules`` is a short list that becomes one expression. A null URL, or
    one without ://, has an empty host and path, which no rule fits. URLs of any
    length are searched whole; of rules that tie in length the one that comes last
    in alphabetical order decides. Null ids are kept, rows that repeat are judged
    each, an empty table gives no rows, and other columns may have clashing names.
    """
    strict, soft = tuple(strict), tuple(soft)

    @pandas_udf("struct<n_strict: long, n_soft: long>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([hits(u, strict, soft) for u in urls], columns=["n_strict", "n_soft"])

    url = F.col("url")
    rows = take(df, {"id": id_col, "url": url_col}).select("id", host_of(url).alias("host"), path_of(url).alias("path"), count(url).alias("n"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("n.n_strict") > 0) | (F.col("n.n_soft") >= soft_terms), "block").otherwise("allow")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("n.n_strict").alias("n_strict"), F.col("n.n_soft").alias("n_soft")
    )


def judge_urls_sql() -> str:
    """DuckDB SQL for ``judge_urls`` over pages with the default rules and terms."""
    boundary = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    count = lambda terms: " + ".join(f"{boundary(t)}::bigint" for t in terms)
    whens = [
        (f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    ]
    rule = "case " + " ".join(f"when {c} then '{r}'" for c, r, _ in whens) + " end"
    verdict = "case " + " ".join(f"when {c} then '{v}'" for c, _, v in whens) + f" when n_strict > 0 or n_soft >= {SOFT_TERMS_TO_REJECT} then 'block' else 'allow' end"
    return f"""with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as u from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, {count(STRICT)} as n_strict, {count(SOFT)} as n_soft from a)
select page_id, host, path, {rule} as rule, {verdict} as verdict, n_strict, n_soft from b"""
