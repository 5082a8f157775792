"""Document fingerprints: SimHash over word pairs, and a search in permuted block tables.

Each pair of adjacent words is a term. Its hash votes on every bit of the
fingerprint, for it where the hash's bit is 1 and against it otherwise, with a
weight that grows with the term's length; a bit is 1 if the votes for it
outweigh those against it. All votes are sums over rows of terms, two bits to a
sum, in whole-stage code.

Fingerprints within a radius of each other agree on one block at least if they
are cut into one block more than the radius. A table for each block, keyed by
the block's bits, leads to all fingerprints within the radius.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniteq.llm.common import checkpointed, hex64, take

BITS = 128
RADIUS = 3
MAX_WEIGHT = 16

_BLOCK_BITS = 32
_LANES = 0x0000000100000001  # bits j and j + 32 of a hash, each with room for 2^31 of weight


def _votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """For each key the fingerprint ``f0``, ``f1`` of the text's terms; zero without terms.

    A term is a lowered word with the next one, which the last word lacks.
    """
    a, b = F.col("__t.a"), F.col("__t.b")
    words = rows.select(*keys, F.array_remove(F.split(F.lower(text), r"\s+"), "").alias("__w"))
    pairs = F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", F.lit(2), F.size("__w")).alias("b"))
    exploded = words.select(*keys, F.explode_outer(pairs).alias("__t"))
    weight = F.least(F.coalesce(F.octet_length(a), F.lit(0)) + F.coalesce(F.octet_length(b), F.lit(0)), F.lit(MAX_WEIGHT)).cast("long")
    hashed = exploded.select(*keys, weight.alias("__w"), F.xxhash64(a, b).alias("__h0"), F.xxhash64(F.lit("second"), a, b).alias("__h1"))
    sums = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES)) * F.col("__w")).alias(f"{h}_{j}") for h in ("__h0", "__h1") for j in range(_BLOCK_BITS)]
    counted = hashed.groupBy(*keys).agg(F.sum("__w").alias("__all"), *sums)

    def assembled(h: str) -> Column:
        out = F.lit(0).cast("long")
        for j in range(_BLOCK_BITS):
            low = F.col(f"{h}_{j}").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))
            high = F.shiftrightunsigned(f"{h}_{j}", _BLOCK_BITS)
            for votes, bit in ((low, j), (high, j + _BLOCK_BITS)):
                one = F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long")
                out = out.bitwiseOR(F.when(2 * votes > F.col("__all"), one).otherwise(F.lit(0).cast("long")))
        return out

    return counted.select(*keys, assembled("__h0").alias("f0"), assembled("__h1").alias("f1"))


def differing_bits(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of bits that agree: 1 for equal fingerprints, about a half for unrelated texts."""
    return 1.0 - differing_bits(a0, a1, b0, b1) / BITS


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id: id, f0, f1 (two longs). Rows that share an id vote together; a null text is empty."""
    rows = take(df, {"id": id_col, "text": text_col}).select("id", F.coalesce("text", F.lit("")).alias("text"))
    return _votes(rows, ["id"], "text").withColumnRenamed("id", id_col)


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each distinct fingerprint of ``queries`` (f0, f1): ``n``, the rows of ``prints`` within the radius.

    All are found, each once: in the first table in which both have the same
    block. Equal fingerprints are counted before they are looked up.
    """
    n_blocks = BITS // _BLOCK_BITS
    if not 0 <= radius < n_blocks:
        raise ValueError(f"radius must be 0 to {n_blocks - 1} for {n_blocks} blocks")
    blocks = lambda: [F.shiftrightunsigned("f0", 32), F.col("f0").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("f1", 32), F.col("f1").bitwiseAND(F.lit(0xFFFFFFFF))]
    tables = lambda rows: rows.select("*", F.posexplode(F.array(*blocks())).alias("t", "block"))
    asked = tables(queries.select("f0", "f1").distinct()).select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), "t", "block")
    held = tables(prints.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("n")))
    x0, x1 = F.col("q0").bitwiseXOR(F.col("f0")), F.col("q1").bitwiseXOR(F.col("f1"))
    upper = lambda x: F.shiftrightunsigned(x, 32) != 0
    lower = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)) != 0
    differ = [upper(x0), lower(x0), upper(x1), lower(x1)]
    first = F.lit(True)
    for i in range(n_blocks - 1):
        first = first & ((F.col("held.t") <= i) | differ[i])
    a, b = asked.alias("asked"), held.alias("held")
    near = F.bit_count(x0) + F.bit_count(x1) <= radius
    found = a.join(b, (F.col("asked.t") == F.col("held.t")) & (F.col("asked.block") == F.col("held.block")) & near & first)
    return found.groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg(F.sum("n").alias("n"))


# The next document in descending order of id. Ids are dealt by ranges; the first documents of a range also go to the range before it.

RANGE_ROWS = 256
MAX_RANGES = 1 << 16
_SAMPLED = 8  # ids for each range


def _constant(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")  # which the optimizer reads once


def _place(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by binary search."""
    if not bounds:
        return F.lit(0)
    held = _constant(bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(held, lo + step - 1) <= value, lo + step).otherwise(lo))


class _Ranges:
    """Ranges of ids that follow one another by descending id, then those of null ids, each with its first rows' key.

    Only ids are read for them, and the texts of rows without one. The driver gets
    at most ``MAX_RANGES`` keys and ``_SAMPLED`` sampled ids for each.
    """

    def __init__(self, rows: DataFrame):
        ids = rows.select("id")
        n, n_ids = ids.agg(F.count(F.lit(1)), F.count("id")).first()
        wanted = min(MAX_RANGES, max(1, n_ids // RANGE_ROWS))
        nth = max(1, n_ids // (wanted * _SAMPLED))
        sample = ids.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(nth)) == 0)).distinct().limit(2 * wanted * _SAMPLED)
        own = sorted(r[0] for r in sample.collect()) if wanted > 1 else []
        each = max(1, -(-len(own) // wanted))
        self.bounds = own[each::each]
        firsts = ids.filter("id is not null").groupBy(_place(F.col("id"), self.bounds).alias("at")).agg(F.max("id")).collect() if n_ids else []
        self.numbers = {at: i for i, (at, _) in enumerate(sorted(firsts, reverse=True))}
        self.firsts = [x for _, x in sorted(firsts, reverse=True)]
        self.null_bits = min(MAX_RANGES, (n - n_ids) // RANGE_ROWS).bit_length()
        nulls = rows.filter("id is null").groupBy(self._null_place().alias("at")).agg(F.min(F.xxhash64("text"))).collect() if n > n_ids else []
        self.null_places = sorted(at for at, _ in nulls)
        self.null_firsts = [x for _, x in sorted(nulls)]
        self.count = max(1, len(self.firsts) + len(self.null_firsts))

    def _null_place(self) -> Column:
        return F.shiftrightunsigned(F.xxhash64("text"), 64 - self.null_bits) if self.null_bits else F.lit(0).cast("long")

    def placed(self, rows: DataFrame) -> DataFrame:
        """The rows (id, text), with ``range``, ``donor`` 0 and ``tie``; a range's first rows once more, with ``donor`` 1 in the range before."""
        id_, tie = F.col("id"), F.when(F.col("id").isNull(), F.xxhash64("text"))
        top = len(self.bounds)
        place = top - _place(id_, self.bounds) if len(self.firsts) == top + 1 else F.get(_constant([self.numbers.get(i, 0) for i in range(top + 1)]), _place(id_, self.bounds)).cast("int")
        first = id_ == F.get(_constant(self.firsts), F.col("range")) if self.firsts else F.lit(False)
        if self.null_firsts:
            null_place = F.array_position(_constant(self.null_places), self._null_place()).cast("int") - 1
            place = F.when(id_.isNull(), null_place + len(self.firsts)).otherwise(place)
            first = F.when(id_.isNull(), F.col("tie") == F.get(_constant(self.null_firsts), F.col("range") - len(self.firsts))).otherwise(first)
        rows = rows.select("id", "text", place.alias("range"), tie.alias("tie"))
        own = F.struct(F.col("range").alias("range"), F.lit(0).alias("donor"))
        before = F.struct(F.pmod(F.col("range") - 1, F.lit(self.count)).cast("int").alias("range"), F.lit(1).alias("donor"))
        both = F.when(F.coalesce(first, F.lit(False)), F.array(own, before)).otherwise(F.array(own))
        return rows.select("id", "text", "tie", F.explode(both).alias("to")).select("id", "text", "tie", "to.range", "to.donor")


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", searched_ids: int = 100) -> DataFrame:
    """Fingerprints of each text and of an edited text, and how alike they are.

    The edited text's last half (floor of n_chars / 2) is the first as many code
    points of the next document, or all of it; documents follow one another by
    descending id, then by text, null ids last in an order that their texts'
    hashes give, and the first one follows the last. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and n_within: for ids divisible by ``searched_ids``
    the number of rows whose fingerprints are within RADIUS bits, itself
    included, else null. A null text is empty; a text without words has
    fingerprint zero; texts of any length are read whole. Rows that share an id
    are documents of their own. An empty table gives no rows, and other columns
    may have clashing names.

    The ranges are found from the ids alone. Then the texts are shuffled once, to
    their ranges, whatever the ids are; all votes are counted where they then are.
    """
    rows = take(df, {"id": id_col, "text": text_col}).select(F.col("id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("range").orderBy("donor", F.desc_nulls_last("id"), "tie", "text")
    placed = _Ranges(rows).placed(rows).select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))
    follow = Window.partitionBy("range").orderBy("rn")
    done = _edited(placed).select("*", F.lead("f0").over(follow).alias("n0"), F.lead("f1").over(follow).alias("n1"))
    done = checkpointed(done.filter("donor = 0").drop("range", "rn", "donor"))

    sought = F.col("id") % searched_ids == 0
    counts = within_radius(done.filter(sought), done).withColumnRenamed("n", "n_within").withColumn("sought", F.lit(True))
    out = done.withColumn("sought", F.coalesce(sought, F.lit(False))).join(counts, ["sought", "f0", "f1"], "left")
    shown = lambda a, b: F.concat(hex64(F.col(a)), hex64(F.col(b)))
    f, e, n = (F.col("f0"), F.col("f1")), (F.col("e0"), F.col("e1")), (F.col("n0"), F.col("n1"))
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        shown("f0", "f1").alias("fingerprint"),
        shown("e0", "e1").alias("edited_fingerprint"),
        likeness(*f, *e).alias("near_edited"),
        likeness(*f, *n).alias("near_next"),
        "n_within",
    )


def _edited(rows: DataFrame) -> DataFrame:
    """For each row (range, rn): donor, id, n_chars, edited_sha256, and both fingerprints; of a donor only its own."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = rows.select("id", "range", "rn", "donor", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("donor") == 0, edited).alias("edited"))
    keys = ["range", "rn", "which", "donor", "id", "n_chars", "edited_sha256"]
    own = F.struct(F.lit(0).alias("which"), F.lit("").alias("sha"), F.col("text").alias("body"))
    other = F.struct(F.lit(1).alias("which"), F.coalesce(F.sha2("edited", 256), F.lit("")).alias("sha"), F.col("edited").alias("body"))
    both = F.when(F.col("donor") == 0, F.array(own, other)).otherwise(F.array(own))
    split = rows.select("range", "rn", "donor", "id", "n_chars", F.explode(both).alias("x"))
    split = split.select("range", "rn", "donor", F.col("x.which").alias("which"), "id", "n_chars", F.col("x.sha").alias("edited_sha256"), F.col("x.body").alias("body"))
    votes = _votes(split, keys, "body")
    pick = lambda w, c: F.max(F.when(F.col("which") == w, F.col(c)))
    return votes.groupBy("range", "rn").agg(
        F.max("donor").alias("donor"),
        F.max("id").alias("id"),
        F.max("n_chars").alias("n_chars"),
        F.max("edited_sha256").alias("edited_sha256"),
        *[pick(w, c).alias(n) for w, c, n in ((0, "f0", "f0"), (0, "f1", "f1"), (1, "f0", "e0"), (1, "f1", "e1"))],
    )


def edited_sql(table: str = "documents") -> str:
    """DuckDB SQL for the lengths and edited texts' digests of ``edited_likeness``, for rows with ids."""
    order = "order by doc_id desc, coalesce(text, '')"
    return f"""with d as (select doc_id, coalesce(text, '') as t, coalesce(lead(coalesce(text, '')) over ({order}), first_value(coalesce(text, '')) over ({order})) as after from {table})
select doc_id, length(t) as n_chars, sha256(left(t, length(t) - length(t) // 2) || left(after, length(t) // 2)) as edited_sha256 from d"""
