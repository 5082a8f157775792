"""License mentions in texts by ordered signature rules.

A text becomes its words, lowered and set apart by two spaces, so that a rule is
a regular expression over whole words. A rule is asked only of texts that hold
its keyword. Each detection covers an interval of words. Where one lies within
another of a higher priority, or of the same priority and longer, it is
suppressed. Everything is a column expression; a text without any keyword is
only counted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteq.llm.common import take
from graniteq.llm.license_rules import NAMES, NOTICES, TEXTS
from graniteq.llm.native import blocks_of_spans, let, running_totals, words_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` is over a text of words that each have a space on both sides.

    Whatever it matches has one of ``keywords`` as a word.
    """

    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    weight: float
    base: bool = False


#: label: (words of the identifier, the name as a pattern over words, words of which the name has one)
LICENSES = {
    "0bsd": ("0bsd", "(bsd zero clause|zero clause bsd|0bsd)", "bsd 0bsd"),
    "afl-3.0": ("afl 3 0", "academic free license( version| v)?( 3| v3)( 0)?", "academic"),
    "agpl-3.0": ("agpl 3 0( only| or later)?", "(gnu )?(affero general public license|agpl)( version| v)?( 3| v3|v3)?( 0)?", "agpl affero agplv3"),
    "apache-1.1": ("apache 1 1", "apache( software)? license( version| v)? 1 1", "apache"),
    "apache-2.0": ("apache 2 0", "apache( software)? license( version| v)?( 2| v2)( 0)?", "apache"),
    "artistic-1.0": ("artistic 1 0", "artistic license( version| v)? 1 0", "artistic"),
    "artistic-2.0": ("artistic 2 0", "artistic license( version| v)? 2 0", "artistic"),
    "bsd-2-clause": ("bsd 2 clause", "(bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd freebsd"),
    "bsd-3-clause": ("bsd 3 clause", "(bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    "bsd-4-clause": ("bsd 4 clause", "(bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", "bsd"),
    "bsl-1.0": ("bsl 1 0", "boost software license( version| v)?( 1)?( 0)?", "boost"),
    "busl-1.1": ("busl 1 1", "business source license( version| v)?( 1 1)?", "business"),
    "cc0-1.0": ("cc0 1 0", "(cc0|creative commons zero)( 1 0)?", "cc0 creative"),
    "cc-by-4.0": ("cc by 4 0", "(cc by|creative commons attribution)( international)? 4 0", "cc creative"),
    "cc-by-3.0": ("cc by 3 0", "(cc by|creative commons attribution)( unported)? 3 0", "cc creative"),
    "cc-by-nc-4.0": ("cc by nc 4 0", "(cc by nc|creative commons attribution non( )?commercial)( international)? 4 0", "cc creative"),
    "cc-by-nc-3.0": ("cc by nc 3 0", "(cc by nc|creative commons attribution non( )?commercial)( unported)? 3 0", "cc creative"),
    "cc-by-nc-nd-4.0": ("cc by nc nd 4 0", "(cc by nc nd|creative commons attribution non( )?commercial no( )?deriv(s|ative|atives))( international)? 4 0", "cc creative"),
    "cc-by-nc-sa-4.0": ("cc by nc sa 4 0", "(cc by nc sa|creative commons attribution non( )?commercial share( )?alike)( international)? 4 0", "cc creative"),
    "cc-by-nd-4.0": ("cc by nd 4 0", "(cc by nd|creative commons attribution no( )?deriv(s|ative|atives))( international)? 4 0", "cc creative"),
    "cc-by-sa-4.0": ("cc by sa 4 0", "(cc by sa|creative commons attribution share( )?alike)( international)? 4 0", "cc creative"),
    "cc-by-sa-3.0": ("cc by sa 3 0", "(cc by sa|creative commons attribution share( )?alike)( unported)? 3 0", "cc creative"),
    "cddl-1.0": ("cddl 1 0", "(common development and distribution license|cddl)( version| v)?( 1 0)?", "cddl distribution"),
    "cecill-2.1": ("cecill 2 1", "cecill( license| licence)?( version| v)? 2 1", "cecill"),
    "cpl-1.0": ("cpl 1 0", "common public license( version| v)?( 1 0)?", "common"),
    "ecl-2.0": ("ecl 2 0", "educational community license( version| v)?( 2 0)?", "educational"),
    "elastic-2.0": ("elastic 2 0", "elastic license( version| v)?( 2| v2)( 0)?", "elastic"),
    "epl-1.0": ("epl 1 0", "eclipse public license( version| v)? 1( 0)?", "eclipse"),
    "epl-2.0": ("epl 2 0", "eclipse public license( version| v)? 2( 0)?", "eclipse"),
    "eupl-1.2": ("eupl 1 2", "(european union public licen[cs]e|eupl)( version| v)?( 1 2)?", "eupl union"),
    "fsl-1.1": ("fsl 1 1", "functional source license( version| v)?( 1 1)?", "functional"),
    "gfdl-1.3": ("gfdl 1 3( only| or later)?", "(gnu )?free documentation license( version| v)?( 1 3)?", "documentation"),
    "gpl-1.0": ("gpl 1 0( only| or later)?", "(gnu )?(general public license|gpl)( version| v)? 1( 0)?", "gpl general"),
    "gpl-2.0": ("gpl 2 0( only| or later)?", "(gnu )?((general public license|gpl)( version| v)?( 2| v2)|gplv2)( 0)?", "gpl general gplv2"),
    "gpl-3.0": ("gpl 3 0( only| or later)?", "(gnu )?((general public license|gpl)( version| v)?( 3| v3)|gplv3)( 0)?", "gpl general gplv3"),
    "hpnd": ("hpnd", "historical permission notice and disclaimer", "historical"),
    "icu": ("icu", "icu license", "icu"),
    "ijg": ("ijg", "independent jpeg group license", "jpeg"),
    "isc": ("isc", "isc", "isc"),
    "lgpl-2.0": ("lgpl 2 0( only| or later)?", "(gnu )?(library general public license|lgpl)( version| v)? 2( 0)?", "lgpl library"),
    "lgpl-2.1": ("lgpl 2 1( only| or later)?", "(gnu )?(lesser general public license|lgpl)( version| v)? 2 1", "lgpl lesser"),
    "lgpl-3.0": ("lgpl 3 0( only| or later)?", "(gnu )?((lesser general public license|lgpl)( version| v)?( 3| v3)|lgplv3)( 0)?", "lgpl lesser lgplv3"),
    "libpng": ("libpng", "libpng license", "libpng"),
    "lppl-1.3c": ("lppl 1 3c", "latex project public license( version| v)?( 1 3c?)?", "latex"),
    "mit": ("mit", "(mit|expat|mit x11)", "mit expat"),
    "mit-0": ("mit 0", "mit no attribution", "mit"),
    "mpl-1.1": ("mpl 1 1", "(mozilla public license|mpl)( version| v)? 1 1", "mozilla mpl"),
    "mpl-2.0": ("mpl 2 0", "(mozilla public license|mpl)( version| v)?( 2| v2)( 0)?", "mozilla mpl"),
    "ms-pl": ("ms pl", "microsoft public license", "microsoft"),
    "ms-rl": ("ms rl", "microsoft reciprocal license", "microsoft"),
    "ncsa": ("ncsa", "(university of illinois )?ncsa( open source)?", "ncsa"),
    "odbl-1.0": ("odbl 1 0", "(open database license|odbl)( version| v)?( 1 0)?", "database odbl"),
    "ofl-1.1": ("ofl 1 1", "(sil )?open font license( version| v)?( 1 1)?", "font"),
    "openssl": ("openssl", "openssl", "openssl"),
    "osl-3.0": ("osl 3 0", "open software license( version| v)? 3 0", "software"),
    "php-3.01": ("php 3 01", "php license( version| v)?( 3 01)?", "php"),
    "postgresql": ("postgresql", "postgresql", "postgresql"),
    "psf-2.0": ("psf 2 0", "python software foundation license( version| v)?( 2)?", "python"),
    "python-2.0": ("python 2 0", "python license( version| v)?( 2 0)?", "python"),
    "rpl-1.5": ("rpl 1 5", "reciprocal public license( version| v)?( 1 5)?", "reciprocal"),
    "sspl-1.0": ("sspl 1 0", "(server side public license|sspl)( version| v)?( 1)?( 0)?", "server sspl"),
    "unicode-3.0": ("unicode 3 0", "unicode license( version| v)?( 3)?", "unicode"),
    "unlicense": ("unlicense", "(unlicense|unlicence)", "unlicense unlicence"),
    "upl-1.0": ("upl 1 0", "universal permissive license( version| v)?( 1 0)?", "universal"),
    "vim": ("vim", "vim", "vim"),
    "w3c": ("w3c", "w3c software( notice and)?", "w3c"),
    "wtfpl": ("wtfpl", "(wtfpl|do what the fuck you want to public license)", "wtfpl fuck"),
    "x11": ("x11", "x11", "x11"),
    "zlib": ("zlib", "zlib", "zlib"),
    "zpl-2.1": ("zpl 2 1", "zope public license( version| v)?( 2 1)?", "zope"),
}

#: Phrases that are counted wherever their words stand.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

_VERBS = "licen[cs]ed|released|distributed|available|published|provided|offered|covered"
_GRANT = f"({_VERBS})( to you)?( under| by| with)( the terms of)?( the| a| an)?"
_LINK = "(spdx org|opensource org|choosealicense com) licenses?"


def _over_words(pattern: str) -> str:
    """A pattern with one space before each further word becomes one where each word has a space on both sides."""
    return f" {pattern.replace(' ', '  ')} "


def _written(text: str, priority: int, weight: float) -> list[Rule]:
    lines = [line.split(" | ") for line in text.strip().splitlines()]
    return [Rule(label, tuple(words.split()), _over_words(pattern), priority, weight) for label, words, pattern in lines]


def rules() -> list[Rule]:
    """All rules in order: base phrases, those that identifiers and names of licenses make, and the written ones.

    A text's own wording and an identifier outrank a grant, a grant outranks a
    name, and a name outranks a notice.
    """
    found = [Rule(label, ("license",), _over_words(p), 0, 0.5, True) for label, p in BASE]
    for label, (ident, name, words) in LICENSES.items():
        own = tuple(words.split())
        found += [
            Rule(label, ("spdx",), _over_words(f"spdx license identifier {ident}"), 5, 1.0),
            Rule(label, ("spdx", "opensource", "choosealicense"), _over_words(f"{_LINK} {ident}"), 4, 0.95),
            Rule(label, own, _over_words(f"{_GRANT} {name}( licen[cs]e)?"), 3, 0.9),
            Rule(label, own, _over_words(f"(the )?{name}( licen[cs]e)" + "?" * ("licen" in name)), 2, 0.7),
        ]
    return found + _written(TEXTS, 4, 0.95) + _written(NAMES, 2, 0.7) + _written(NOTICES, 1, 0.6)


RULES = rules()
KEYWORDS = tuple(sorted({k for r in RULES for k in r.keywords}))


def _rule_array() -> Column:
    rows = [{"label": r.label, "keywords": r.keywords, "pattern": r.pattern, "priority": r.priority, "weight": r.weight, "base": r.base, "rule": i} for i, r in enumerate(RULES)]
    kind = "array<struct<label: string, keywords: array<string>, pattern: string, priority: int, weight: double, base: boolean, rule: int>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)  # a constant, which the optimizer reads once


def _detections(spaced: Column, r: Column) -> Column:
    """The rule's detections, with their first word and the one after the last."""
    words = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" ")))) / 2).cast("long")
    fields = ("label", "priority", "weight", "base", "rule")

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(spaced, r["pattern"], -1), F.lit(1), F.size(hits))
        ends = running_totals(F.zip_with(gaps, hits, lambda g, h: words(g) + words(h)))
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - words(h)).alias("start"), e.alias("end"), *[r[f].alias(f) for f in fields]))

    return let(F.regexp_extract_all(spaced, r["pattern"], F.lit(0)), placed)


def _outranks(e: Column, d: Column) -> Column:
    """Whether detection e suppresses d."""
    within = (e["start"] <= d["start"]) & (e["end"] >= d["end"])
    longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
    same = (e["end"] - e["start"]) == (d["end"] - d["start"])
    return within & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (longer | (same & (e["rule"] < d["rule"])))))


def _suppressed(d: Column, blocks: Column) -> Column:
    """Whether a detection in the blocks outranks d; only those of blocks that may hold one about d are compared."""
    return F.exists(blocks, lambda b: (b["first"] <= d["start"]) & (b["reach"] >= d["end"]) & F.exists(b["spans"], lambda e: _outranks(e, d)))


def detect(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), into: str = "licenses") -> DataFrame:
    """The columns ``keep`` of ``df``, ``n_words``, and ``into``: all detections of the rules.

    A detection has start and end (words from 0, end exclusive), label, priority,
    weight, base (whether its rule is a base phrase), rule (its number) and
    suppressed. A null text is empty, and a text of any length is read whole; of
    detections that tie, the rule that comes first suppresses the other. Repeated
    rows are scanned each, and an empty table gives no rows.
    """
    if {into, "n_words"} & set(keep):
        raise ValueError(f"a kept column is named {into!r} or 'n_words'")
    # Lowering beyond A to Z neither adds nor removes words, and no phrase holds such letters.
    rows = take(df, {**{c: c for c in keep}, "__text": text_col}).withColumn("__text", F.lower(F.coalesce("__text", F.lit(""))))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], words_of(F.col("__text")).alias("__words"))
    rows = rows.withColumn("__keys", F.array_intersect("__words", F.array(*map(F.lit, KEYWORDS))))

    def found(spaced: Column) -> Column:
        asked = F.filter(_rule_array(), lambda r: F.exists(r["keywords"], lambda k: F.array_contains(F.col("__keys"), k)) & F.rlike(spaced, r["pattern"]))
        return F.flatten(F.transform(asked, lambda r: _detections(spaced, r)))

    spaced = F.concat(F.lit(" "), F.array_join("__words", "  "), F.lit(" "))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], F.size("__words").cast("long").alias("n_words"), F.when(F.size("__keys") > 0, let(spaced, found)).alias("__found"))
    judged = let(blocks_of_spans(F.col("__found")), lambda blocks: F.transform("__found", lambda d: d.withField("suppressed", _suppressed(d, blocks))))
    none = F.array().cast("array<struct<start: bigint, end: bigint, label: string, priority: int, weight: double, base: boolean, rule: int, suppressed: boolean>>")
    return rows.select(*[F.col(f"`{c}`") for c in keep], "n_words", F.coalesce(judged, none).alias(into))


def _labels(detections: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null ids are kept; other columns may have clashing names.
    ``labels`` are those of base phrases and of detections that aren't
    suppressed; the score is the greatest weight among these, or 0.
    """
    rows = detect(take(df, {"id": id_col, "text": text_col}), "text", ("id",))
    rows = rows.withColumn("base", F.filter("licenses", lambda d: d["base"])).withColumn("kept", F.filter("licenses", lambda d: d["base"] | ~d["suppressed"]))
    starts = F.transform("base", lambda d: d["start"])
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"),
        _labels(F.col("kept")).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def digests_sql() -> str:
    """DuckDB SQL for ``digests`` over documents."""
    values = ", ".join(f"({i}, '{r.label}', '{r.pattern}', {r.priority}, {r.weight!r}::double, {r.base})" for i, r in enumerate(RULES))
    words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)::bigint"
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: {words('y')})), 0)::bigint"
    return f"""with r(rule, label, pattern, priority, weight, base) as (values {values}),
d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
s as (select doc_id, ' ' || array_to_string(w, '  ') || ' ' as spaced from d),
m as (select doc_id, rule, string_split_regex(spaced, pattern) as gaps, regexp_extract_all(spaced, pattern) as hits from s, r where regexp_matches(spaced, pattern)),
e as (select doc_id, rule, gaps, hits, unnest(range(1, len(hits) + 1)) as i from m),
p as (select doc_id, rule, {total('gaps[1:i]')} + {total('hits[1:i-1]')} as start, {words('hits[i]')} as n from e),
f as (select doc_id, rule, start, start + n as stop, label, priority, weight, base from p join r using (rule)),
k as (select *, not exists (select 1 from f o where o.doc_id = f.doc_id and o.start <= f.start and o.stop >= f.stop and (o.priority > f.priority or (o.priority = f.priority and (o.stop - o.start > f.stop - f.start or (o.stop - o.start = f.stop - f.start and o.rule < f.rule))))) or base as kept from f),
g as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word, string_agg(distinct label, ',' order by label) filter (base) as base_labels,
  string_agg(distinct label, ',' order by label) filter (kept) as labels, max(weight) filter (kept) as score from k group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score from d left join g using (doc_id)"""
