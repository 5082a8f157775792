"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams of 1 to 3 characters in order
of frequency. A document's own list is compared with each profile by the
out-of-place distance: for each of its n-grams, how far its rank is from the
profile's, or the most where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteq.deploy import ship_package
from graniteq.llm.common import output, take

MAX_N = 3
PROFILE_SIZE = 1000

#: The profiles are learned from at most so many labelled documents, evenly over the languages.
SAMPLE_DOCUMENTS = 2000

UNKNOWN = "und"

_CHAR_BITS = 21
_BUCKETS = 256  # of a language's documents, so that none is chosen from in one task
_AT_ONCE = 1 << 20
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _coded(text: str) -> np.ndarray:
    """The text's lowered letters as code points; whatever stands between words is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, _SPACE)
    codes = np.concatenate(([_SPACE], codes, [_SPACE])).astype(np.uint64)
    return codes[np.r_[True, (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)]]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as sorted numbers, their counts) of the whole text; empty without a letter."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    codes = _coded(text or "")
    if len(codes) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, len(codes), _AT_ONCE):
        part = codes[at : at + _AT_ONCE + MAX_N - 1]
        starts = min(_AT_ONCE, len(codes) - at)
        gram, grams = np.zeros(len(part), np.uint64), []
        for n in range(1, MAX_N + 1):
            if len(part) < n:
                break
            gram = (gram[: len(part) - n + 1] << np.uint64(_CHAR_BITS)) | part[n - 1 :]
            own = gram[:starts]
            grams.append(own[own != _SPACE])
        found.append(np.unique(np.concatenate(grams), return_counts=True))
    return found[0] if len(found) == 1 else _summed(found)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, inverse, np.concatenate([c for _, c in parts]))
    return grams, counts


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by number."""
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    """Ranked n-grams by language, ready for lookups."""

    def __init__(self, by_language: dict[str, Sequence[int]], size: int):
        self.languages, self.size, self.sorted = sorted(by_language), size, []
        for lang in self.languages:
            grams = np.array(by_language[lang], np.uint64)
            order = np.argsort(grams)
            self.sorted.append((grams[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1); ties go to the first language in order."""
        own = ranked(*ngram_counts(text), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        place, distances = np.arange(len(own)), []
        for grams, ranks in self.sorted:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            distances.append(int(np.where(grams[at] == own, np.abs(ranks[at] - place), self.size).sum()))
        best = int(np.argmin(distances))
        return self.languages[best], 1.0 - distances[best] / (self.size * len(own))


def learn_profiles(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    size: int = PROFILE_SIZE,
    sample_documents: int = SAMPLE_DOCUMENTS,
) -> Profiles:
    """Profiles of the languages in ``labelled``.

    At most ``sample_documents`` documents with a language are read, in turn from
    each language and bucket of ids, by the hash of their id; their whole texts
    are counted where they lie. The driver gets ``size`` n-grams for each language.
    """
    rows = take(labelled, {"id": id_col, "text": text_col, "lang": lang_col})
    rows = rows.filter("id is not null and text is not null and lang is not null")
    key = F.col("id").cast("string")
    ids = rows.select("id", "lang", F.xxhash64(F.lit("spread"), key).alias("spread"), F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(_BUCKETS)).alias("bucket"))
    turn = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("spread", "id"))
    ids = ids.withColumn("turn", turn).filter(F.col("turn") <= -(-sample_documents // _BUCKETS))
    sample = ids.orderBy("turn", "bucket", "lang", "spread").limit(sample_documents).select("id").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                own = parts.setdefault(lang.as_py(), [])
                own.append(ngram_counts(text.as_py()))
                if len(own) >= 64:
                    own[:] = [_summed(own)]
        for lang, own in parts.items():
            grams, counts = _summed(own)
            yield output({"lang": (pa.string(), [lang] * len(grams)), "gram": (pa.int64(), grams.view(np.int64)), "n": (pa.int64(), counts)})

    counted = rows.join(F.broadcast(sample), "id", "left_semi").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    by_language: dict[str, list[int]] = {}
    for lang, gram, _ in totals.withColumn("place", place).filter(F.col("place") <= size).select("lang", "gram", "place").sort("lang", "place").collect():
        by_language.setdefault(lang, []).append(gram)
    return Profiles(by_language, size)


def predict_languages(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text where nothing was learned.
    """
    rows = take(df, {"id": id_col, "text": text_col})
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(1)]
            yield output({"id": (None, batch.column(0)), "lang_pred": (pa.string(), [x for x, _ in found]), "score": (pa.float64(), [x for _, x in found])})

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, profiles: Profiles, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of ``df``, all columns, whose language is known with a score above ``min_score``."""
    ship_package(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [lang != UNKNOWN and score > min_score for lang, score in (profiles.predict(t.as_py()) for t in batch.column(at))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)


FOLDS, HELD_OUT_FOLD = 3, 1


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """One row for each row: id, held_out, lang_pred, score.

    Profiles come from the rows that are not held out and have a language and an
    id. A null id is not held out and teaches nothing. A null text, or one without a
    letter, is ``und``; texts of any length are read whole. Languages that tie go
    by their names. Repeated rows are judged each, an empty table gives no rows,
    and other columns may have clashing names.
    """
    rows = take(df, {"id": id_col, "text": text_col, "lang": lang_col})
    profiles = learn_profiles(rows.filter(~held_out(F.col("id"))), "id", "text", "lang", size)
    return predict_languages(rows, profiles, "id", "text").select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def identify_sql(table: str = "documents") -> str:
    """DuckDB SQL for ``identify``, for tables whose labelled documents all fit the sample.

    Counts n-grams, ranks them, and sums the out-of-place distances as joins.
    """
    polynomial = 0xEDB88320
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * {polynomial}::bigint)), 4294967295::bigint)"
    rank = "desc, length(gram), gram"
    return f"""with d as (select row_number() over () as r, doc_id, lang, text, coalesce(doc_id is not null and {crc} % {FOLDS} = {HELD_OUT_FOLD}, false) as held_out,
  ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) || ' ' as t from {table}),
z as (select r, unnest(list_zip(l, l[2:], l[3:])) as z from (select r, string_split(t, '') as l from d where length(t) > 2)),
g as (select r, gram, count(*) as c from (select r, unnest([z[1], z[1] || z[2], z[1] || z[2] || z[3]]) as gram from z) where gram <> ' ' group by all),
p as (select * from (select lang, gram, row_number() over (partition by lang order by sum(c) {rank}) - 1 as place from g join d using (r) where not held_out and lang is not null and doc_id is not null and text is not null group by lang, gram) where place < {PROFILE_SIZE}),
o as (select * from (select r, gram, row_number() over (partition by r order by c {rank}) - 1 as place from g) where place < {PROFILE_SIZE}),
s as (select r, x.lang, sum(case when p.place is null then {PROFILE_SIZE} else abs(p.place - o.place) end)::double as distance, count(*) as n from o cross join (select distinct lang from p) x left join p on p.lang = x.lang and p.gram = o.gram group by all),
b as (select r, lang, 1.0::double - distance / ({PROFILE_SIZE} * n)::double as score from s qualify row_number() over (partition by r order by distance, lang) = 1)
select doc_id, held_out, coalesce(b.lang, '{UNKNOWN}') as lang_pred, coalesce(score, 0)::double as score from d left join b using (r)"""
