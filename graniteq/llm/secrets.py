"""Secrets in texts: fixed patterns, and strings of high entropy.

Everything is a column expression. A pattern's matches come from
``regexp_extract_all``; splitting the text by the same pattern gives what lies
between them, and so their places. Long runs of key-like characters are
candidates beyond the fixed patterns: a window slides over each, its character
counts are updated by the character that enters and the one that leaves, and the
stretch where the window's Shannon entropy reaches its character class's
threshold is a finding, unless an allow-list explains it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteq.llm.common import take
from graniteq.llm.native import blocks_of_spans, let, running_totals

#: kind: (pattern, the group that is measured, its least length), in the order in which ties are listed
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),  # a run of these characters is matched whole, so a shorter one holds no match
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20


@dataclass(frozen=True)
class CharacterClass:
    """Candidates that match ``pattern`` whole and have a window of ``entropy`` bits a character."""

    kind: str
    pattern: str
    entropy: float


#: The first class that fits a candidate is its own.
CLASSES = (
    CharacterClass("entropy_hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", 2.95),
    CharacterClass("entropy_base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+$", 3.65),
    CharacterClass("entropy_mixed", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", 3.75),
)

#: A candidate (lowered) that matches is no secret.
ALLOWED = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|example|sample|placeholder|changeme|dummy|redacted|xxxx|0123456789|abcdefghij|"
    r"^[a-z]+([-_/][a-z]+)*[-_/]?[0-9]{1,4}$|(.)\2{7,}"
)
#: One that matches as it stands is a path: three words or more, none of them of mixed letters and digits.
_WORD = r"([A-Z]?[a-z]+([A-Z][a-z]{2,})*[0-9]{0,4}|[0-9]{1,4})"
ALLOWED_PATH = rf"^({_WORD}/){{3,}}{_WORD}?$"
#: What stands right before a candidate (lowered) and explains it.
ALLOWED_BEFORE = r"(sha1|sha256|sha384|sha512|md5|checksum|integrity|commit|revision|etag|digest)[\"']?\x20*[-:=@]?\x20*[\"']?$"

KINDS = (*PATTERNS, *(c.kind for c in CLASSES))


def _found(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans of the matches whose group is long enough."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = _placed(F.split(text, pattern, -1), hits)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    spans = F.zip_with(spans, values, lambda s, v: _span(s["start"], rank, s["end"], kind, v))
    return F.when(text.rlike(pattern), F.filter(spans, lambda s: F.length(s["value"]) >= least)).otherwise(_no_spans())


def _span(start: Column, rank: int, end: Column, kind: str, value: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string, value: string>>")


def _placed(gaps: Column, hits: Column) -> Column:
    """(start, end) of each hit; ``gaps`` are the texts around them."""
    long = lambda x: F.length(x).cast("long")
    ends = running_totals(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: long(g) + long(h)))
    return F.zip_with(ends, hits, lambda e, h: F.struct((e - long(h)).alias("start"), e.alias("end")))


def _sliding(chars: str, alphabet: str, limit: str) -> str:
    """SQL: the first and last window end, from 1, at which the sum of n log2 n over the window's counts n is at most ``limit``.

    ``chars`` is an array of places in ``alphabet``, whose size is that of the counts.
    """
    terms = "array(" + ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(WINDOW + 2)) + ")"
    enters, leaves = f"{chars}[i - 1]", f"if(i > {WINDOW}, {chars}[i - {WINDOW} - 1], 0)"
    count = lambda k: f"a.n[{k} - 1]"
    gain = f"{terms}[{count(enters)} + 1] - {terms}[{count(enters)}]"
    loss = f"if(i > {WINDOW}, {terms}[{count(f'{chars}[i - {WINDOW} - 1]')} - 1] - {terms}[{count(f'{chars}[i - {WINDOW} - 1]')}], 0D)"
    after = f"(a.s + if({enters} = {leaves}, 0D, {gain} + {loss}))"
    reached = f"(i >= {WINDOW} and {after} <= {limit} + 1e-9D)"
    return f"""aggregate(
        sequence(1, size({chars})),
        named_struct('n', array_repeat(0, size({alphabet})), 's', 0D, 'first', 0, 'last', 0),
        (a, i) -> named_struct(
            'n', if({enters} = {leaves}, a.n, transform(a.n, (x, k) -> x + if(k + 1 = {enters}, 1, 0) - if(k + 1 = {leaves}, 1, 0))),
            's', {after},
            'first', if(a.first = 0 and {reached}, i, a.first),
            'last', if({reached}, i, a.last)))"""


def _entropy_spans(text: Column) -> Column:
    """Stretches of high entropy in candidates that no allow-list explains."""
    hits = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(text, CANDIDATE, -1)
    ahead = F.zip_with(F.concat(F.array(F.lit("")), hits), gaps, lambda h, g: F.right(F.concat(F.right(h, F.lit(24)), g), F.lit(24)))
    placed = F.zip_with(_placed(gaps, hits), F.slice(ahead, F.lit(1), F.size(hits)), lambda s, b: F.struct(s["start"].alias("start"), b.alias("before")))

    def stretch(s: Column, value: Column) -> Column:
        rank, limit, kind = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("string")
        for c in reversed(CLASSES):
            fits = value.rlike(c.pattern)
            rank = F.when(fits, KINDS.index(c.kind)).otherwise(rank)
            limit = F.when(fits, WINDOW * (math.log2(WINDOW) - c.entropy)).otherwise(limit)
            kind = F.when(fits, c.kind).otherwise(kind)
        allowed = F.lower(value).rlike(ALLOWED) | value.rlike(ALLOWED_PATH) | F.lower(s["before"]).rlike(ALLOWED_BEFORE)
        letters = F.split(value, "", -1)
        return F.struct(
            s["start"].alias("start"), F.when(~allowed, rank).alias("rank"), kind.alias("kind"), limit.alias("max"), value.alias("value"), F.array_distinct(letters).alias("alphabet"), letters.alias("letters")
        )

    candidates = F.filter(F.zip_with(placed, hits, stretch), lambda c: c["rank"].isNotNull())
    coded = F.transform(candidates, lambda c: c.withField("letters", F.transform(c["letters"], lambda x: F.array_position(c["alphabet"], x).cast("int"))))
    return F.when(text.rlike(CANDIDATE), coded)


_STRETCHES = f"""transform(
    filter(transform(coalesce(__candidates, array()), c -> named_struct('c', c, 'w', {_sliding('c.letters', 'c.alphabet', 'c.max')})), x -> x.w.last > 0),
    x -> named_struct(
        'start', x.c.start + x.w.first - {WINDOW}, 'rank', x.c.rank, 'end', x.c.start + x.w.last, 'kind', x.c.kind,
        'value', substring(x.c.value, x.w.first - {WINDOW} + 1, x.w.last - x.w.first + {WINDOW})))"""


def _meets(start: Column, end: Column, blocks: Column) -> Column:
    """Whether a span in the blocks overlaps the stretch; only those of blocks that may hold one are compared."""
    return F.exists(blocks, lambda b: (b["first"] < end) & (start < b["reach"]) & F.exists(b["spans"], lambda s: (s["start"] < end) & (start < s["end"])))


def _apart(m: Column, blocks: Column) -> Column:
    """Whether the stretch's first or last window is free of the spans in the blocks."""
    return ~_meets(m["start"], m["start"] + WINDOW, blocks) | ~_meets(m["end"] - WINDOW, m["end"], blocks)


def scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), into: str = "secrets") -> DataFrame:
    """The columns ``keep`` of ``df`` and ``into``: the text's findings by start, then kind.

    A finding has start and end (code points, end exclusive), kind, its rank
    among the kinds, and value (what the pattern measures, or the stretch). A
    stretch whose first and last window both overlap fixed patterns' findings is
    left out. A null text is empty; a text of any length is read whole. Findings
    that start together are listed by kind. Repeated rows are scanned each, and an
    empty table gives no rows.
    """
    if into in keep:
        raise ValueError(f"a kept column is named {into!r}")
    rows = take(df, {**{c: c for c in keep}, "__text": text_col}).withColumn("__text", F.coalesce("__text", F.lit("")))
    body = F.col("__text")
    base = F.concat(*[_found(body, pattern, group, least, kind, i) for i, (kind, (pattern, group, least)) in enumerate(PATTERNS.items())])
    rows = rows.withColumn("__base", base).withColumn("__candidates", _entropy_spans(body)).withColumn("__more", F.expr(_STRETCHES))
    apart = let(blocks_of_spans(F.col("__base")), lambda blocks: F.filter("__more", lambda m: _apart(m, blocks)))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.array_sort(F.concat("__base", apart)).alias(into))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, the numbers of findings by fixed pattern, base_sha256, spans, n_entropy.

    Null ids are kept; other columns may have clashing names.
    """
    named = take(df, {"id": id_col, "text": text_col})
    rows = scan(named, "text", ("id",)).withColumn("base", F.filter("secrets", lambda s: s["rank"] < len(PATTERNS)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        F.col("id").alias(id_col),
        *[count(k) for k in PATTERNS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("secrets")).alias("spans"),
        (F.size("secrets") - F.size("base")).cast("long").alias("n_entropy"),
    )


def redact(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``df`` with every finding in the text replaced by its kind in brackets.

    Findings that overlap are replaced together, by the first one's kind. A null
    text stays null.
    """
    rows = scan(df, text_col, tuple(keep), "__secrets")
    body = F.col(f"`{text_col}`")
    clean = F.when(F.size("__secrets") > 0, let(_joined(F.col("__secrets")), lambda cuts: _replaced(body, cuts))).otherwise(body)
    return rows.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in keep])


def _joined(spans: Column) -> Column:
    """The stretches (start, end, kind of its first span) that overlapping spans, by start, cover together."""
    covers = lambda e, at: (e["start"] < at) & (e["end"] > at)
    before = lambda e, s: (e["start"] == s["start"]) & ((e["rank"] < s["rank"]) | ((e["rank"] == s["rank"]) & (e["end"] < s["end"])))

    def within(blocks: Column) -> Column:
        later = lambda s: F.exists(blocks, lambda b: (b["first"] <= s["start"]) & (b["reach"] > s["start"]) & F.exists(b["spans"], lambda e: covers(e, s["start"]) | before(e, s)))
        earlier = lambda s: F.exists(blocks, lambda b: (b["first"] < s["end"]) & (b["reach"] > s["end"]) & F.exists(b["spans"], lambda e: covers(e, s["end"])))
        ends = F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: ~earlier(s)), lambda s: s["end"])))
        return F.zip_with(F.filter(spans, lambda s: ~later(s)), ends, lambda s, e: F.struct(s["start"].alias("start"), e.alias("end"), s["kind"].alias("kind")))

    return let(blocks_of_spans(spans), within)


_CUTS_AT_ONCE = 128


def _replaced(body: Column, cuts: Column) -> Column:
    """The text with each cut's kind in its place.

    Finding a place takes a walk from the text's start, so the text is first
    divided into parts of a bounded number of cuts.
    """

    def part(at: Column) -> Column:
        begin = F.when(at > 1, F.get(cuts, at - 2)["end"]).otherwise(F.lit(0))

        def pieces(own: Column) -> Column:
            text = F.substring(body, (begin + 1).cast("int"), (F.element_at(own, -1)["end"] - begin).cast("int"))
            last = lambda i: F.when(i > 0, F.get(own, i - 1)["end"]).otherwise(begin)
            piece = lambda t, c, i: F.concat(F.substring(t, (last(i) - begin + 1).cast("int"), (c["start"] - last(i)).cast("int")), F.lit("["), c["kind"], F.lit("]"))
            return let(text, lambda t: F.array_join(F.transform(own, lambda c, i: piece(t, c, i)), ""))

        return let(F.slice(cuts, at, F.lit(_CUTS_AT_ONCE)), pieces)

    starts = F.sequence(F.lit(1), F.size(cuts), F.lit(_CUTS_AT_ONCE))
    rest = F.substring(body, (F.element_at(cuts, -1)["end"] + 1).cast("int"), F.length(body))
    return F.concat(F.array_join(F.transform(starts, part), ""), rest)


def digests_sql(table: str = "documents") -> str:
    """DuckDB SQL for ``digests`` over the documents."""
    q = lambda s: s.replace("'", "''")
    finds = []
    for i, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        finds.append(
            f"select doc_id, {i} as rank, '{kind}' as kind, string_split_regex(t, '{q(pattern)}') as gaps, regexp_extract_all(t, '{q(pattern)}') as hits, regexp_extract_all(t, '{q(pattern)}', {group}) as vals, {least} as least from d where regexp_matches(t, '{q(pattern)}')"
        )
    plain = lambda p: p.replace("(?=.*[0-9])", "").replace("(?=.*[A-Fa-f])", "").replace("(?=.*[A-Z])", "").replace("(?=.*[a-z])", "").replace("(?=.*[A-Za-z])", "")
    needs = {"entropy_hex": ("[0-9]", "[A-Fa-f]"), "entropy_base64": ("[0-9]", "[A-Z]", "[a-z]"), "entropy_mixed": ("[0-9]", "[A-Za-z]")}
    fits = lambda c: " and ".join([f"regexp_matches(v, '{plain(c.pattern)}')", *(f"regexp_matches(v, '{n}')" for n in needs[c.kind])])
    case = lambda f: "case " + " ".join(f"when {fits(c)} then {f(c)}" for c in CLASSES) + " end"
    allowed = ALLOWED.rpartition("|")[0]  # the repeated character needs a back-reference
    return f"""with d as (select doc_id, coalesce(text, '') as t from {table}),
f as ({' union all '.join(finds)}),
e as (select doc_id, rank, kind, least, gaps, hits, vals, unnest(range(1, len(hits) + 1)) as i from f),
p as (select doc_id, rank, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::bigint as s, length(hits[i]) as n, length(vals[i]) as m, least from e),
base as (select doc_id, s as start, rank, s + n as stop, kind from p where m >= least),
c as (select doc_id, string_split_regex(t, '{CANDIDATE}') as gaps, regexp_extract_all(t, '{CANDIDATE}') as hits from d where regexp_matches(t, '{CANDIDATE}')),
ce as (select doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) as i from c),
cp as (select doc_id, hits[i] as v, right(coalesce(hits[i-1], '') || gaps[i], 24) as before, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::bigint as s from ce),
ck as (select *, {case(lambda c: KINDS.index(c.kind))} as rank, {case(lambda c: f"'{c.kind}'")} as kind, {case(lambda c: repr(c.entropy))} as least from cp
  where not regexp_matches(lower(v), '{q(allowed)}') and not regexp_matches(v, '{q(ALLOWED_PATH)}') and not exists (select 1 from unnest(string_split('0123456789abcdefghijklmnopqrstuvwxyz+/_=-', '')) as u(x) where contains(lower(v), repeat(x, 8))) and not regexp_matches(lower(before), '{q(ALLOWED_BEFORE)}')),
cw as (select doc_id, s, rank, kind, least, v, unnest(range(1, length(v) - {WINDOW} + 2)) as w from ck where rank is not null),
cs as (select doc_id, s, rank, kind, min(w) as lo, max(w) as hi from cw where list_entropy(string_split(substr(v, w, {WINDOW}), '')) >= least - 1e-9 group by all),
more as (select doc_id, s + lo - 1 as start, rank, s + hi - 1 + {WINDOW} as stop, kind from cs),
apart as (select * from more m where not exists (select 1 from base b where b.doc_id = m.doc_id and b.start < m.start + {WINDOW} and m.start < b.stop) or not exists (select 1 from base b where b.doc_id = m.doc_id and b.start < m.stop and m.stop - {WINDOW} < b.stop)),
al as (select * from base union all select * from apart),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank, stop) filter (rank < {len(PATTERNS)}) as b, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank, stop) as spans, count(*) filter (rank >= {len(PATTERNS)}) as n_entropy from al group by 1)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_entropy, 0) as n_entropy from d left join g using (doc_id)"""
