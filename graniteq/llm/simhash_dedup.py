"""Near-duplicate documents: 64-bit SimHash fingerprints joined by walking binary tries.

A fingerprint's bit is 1 if it is set in over half the hashes of the document's
word shingles. Two documents link if their fingerprints differ in few bits; the
groups are the connected components.

Fingerprints that differ in at most 3 bits agree on one of four blocks of bits.
So each distinct fingerprint goes to four tables, and those that agree on a
table's block form a binary trie of their other bits. A walk over pairs of its
nodes, from the root pair down, adds up the differing bits and drops a pair of
nodes once they exceed the budget. All tries of a batch are walked together,
level by level. A walk emits a spanning forest of its links, never all pairs. The
tries of blocks that too many fingerprints share aren't walked but dealt out once
more, by four blocks of their remaining bits, and so on until they are small; what
remains at the last level has 16 bits, and so a bounded number of fingerprints.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteq.llm.common import LOWER, UPPER, checkpointed, hex64, output, take
from graniteq.llm.components import connected_components, forest

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_DIFFERING_BITS = 3

BITS = 64
WALK_ROWS = 4096  # a larger trie is dealt out once more
LEVELS = 5  # of dealing; with a budget of 3 the tries of the last one have 16 bits
BATCH_ROWS = 1 << 15  # of tries that are walked together
MAX_HOT_BROADCAST = 1 << 20  # keys, of 8 bytes; more are joined by a shuffle

_PAIRS_AT_ONCE = 1 << 18
_LINKS_AT_ONCE = 1 << 20
_HASHES_AT_ONCE = 1 << 16
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED).split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    hashed, seed, join = xxhash.xxh64_intdigest, HASH_SEED, b" ".join
    shingles = map(join, zip(*(words[i:] for i in range(k)), strict=False))
    ones, n = np.zeros(BITS, np.int64), len(words) - k + 1
    for at in range(0, n, _HASHES_AT_ONCE):
        part = np.fromiter((hashed(s, seed) for s in islice(shingles, min(_HASHES_AT_ONCE, n - at))), ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, check_words: int | None = None) -> DataFrame:
    """One row for each row of ``df``: id, the fingerprint ``fp`` as a signed long, and ``other``, that of ``check_words`` words, or 0."""
    rows = take(df, {"id": id_col, "text": text_col}).select(F.col("id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            columns = {"id": (pa.int64(), batch.column(0))}
            for name, words in (("fp", shingle_words), ("other", check_words)):
                fps = np.fromiter((fingerprint_of(t, words) if words else 0 for t in texts), np.uint64, batch.num_rows)
                columns[name] = (pa.int64(), fps.view(np.int64))
            yield output(columns)

    return rows.mapInArrow(run, "id long, fp long, other long")


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``parts`` blocks of nearly equal width, from the top."""
    widths = [bits // parts + (i < bits % parts) for i in range(parts)]
    return [(bits - sum(widths[: i + 1]), w) for i, w in enumerate(widths)]


def _level_bits(blocks: int) -> list[int]:
    """The bits that are left to deal by at each level, at most."""
    bits = [BITS]
    for _ in range(LEVELS):
        bits.append(bits[-1] - min(w for _, w in _cuts(bits[-1], blocks)))
    return bits


def _dealt(bits: int, blocks: int):
    """For each row (key, rest, node, other) a row for each block of the rest: key (with the block and its bits), rest without them, node, other."""
    cuts = _cuts(bits, blocks)
    most, numbered = np.uint64(max(w for _, w in cuts)), np.uint64((blocks - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rest = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            for i, (low, width) in enumerate(cuts):
                own = (rest >> np.uint64(low)) & np.uint64((1 << width) - 1)
                above = np.uint64(0) if low + width == BITS else rest >> np.uint64(low + width)
                others = (above << np.uint64(low)) | (rest & np.uint64((1 << low) - 1))
                named = (((key << numbered) | np.uint64(i)) << most) | own
                yield output({"key": (pa.int64(), named.view(np.int64)), "rest": (pa.int64(), others.view(np.int64)), "node": (None, batch.column(2)), "other": (None, batch.column(3))})

    return run


_ROW_SQL = "key long, rest long, node long, other long"


def trie_links(
    v: np.ndarray, starts: np.ndarray, width: int, budget: int, tally: Counter | None = None, others: np.ndarray | None = None, check_bits: int = BITS
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever links within each group of ``v``.

    A group begins at each of ``starts``; its values, of ``width`` bits, are distinct
    and sorted. Two values link if they differ in at most ``budget`` bits. A group's
    sorted values are its trie: a node is a range of them that agree on the upper
    bits. Pairs of nodes of one depth, at first each root with itself, are split on
    the next bit; children that take different branches cost one of the budget,
    and pairs without any left go no further. Two single leaves are followed to the
    end at once; they link only if their ``others`` differ in at most ``check_bits``
    bits. ``tally`` counts pairs of nodes, those pruned, and links.
    """
    tally = Counter() if tally is None else tally
    ends = np.r_[starts[1:], len(v)]
    roots = np.flatnonzero(ends - starts > 1)
    a0, a1 = starts[roots].astype(np.int32), ends[roots].astype(np.int32)
    todo = [(width, a0, a1, a0, a1, np.full(len(a0), budget, np.int8))]
    zeros: dict[int, np.ndarray] = {}  # by bit: how many values before each place have it unset
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    while todo:
        bit, a0, a1, b0, b1, left = todo.pop()
        if len(a0) > _PAIRS_AT_ONCE:
            todo += [(bit, *(x[i : i + _PAIRS_AT_ONCE] for x in (a0, a1, b0, b1, left))) for i in range(0, len(a0), _PAIRS_AT_ONCE)]
            continue
        tally["pairs"] += len(a0)
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            i, j = a0[leaves], b0[leaves]
            apart = np.bitwise_count((v[i] ^ v[j]) & np.uint64((1 << bit) - 1))
            near = apart <= left[leaves]
            if others is not None and check_bits < BITS:
                near &= np.bitwise_count(others[i] ^ others[j]) <= check_bits
            tally["pruned"] += int((~near).sum())
            tally["links"] += int(near.sum())
            found.append((i[near], j[near]))
            held += len(found[-1][0])
            if held > _LINKS_AT_ONCE:
                found = [forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                held = len(found[0][0])
            a0, a1, b0, b1, left = (x[~leaves] for x in (a0, a1, b0, b1, left))
        if not len(a0):
            continue
        bit -= 1
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((v >> np.uint64(bit)) & np.uint64(1) == 0))).astype(np.int32)
        c = zeros[bit]
        am, bm, same = a0 + c[a1] - c[a0], b0 + c[b1] - c[b0], a0 == b0
        crossing = [(a0, am, bm, b1, left - 1), (am[~same], a1[~same], b0[~same], bm[~same], left[~same] - 1)]
        children = [np.concatenate(x) for x in zip((a0, am, b0, bm, left), (am, a1, bm, b1, left), *crossing, strict=True)]
        whole = (children[0] < children[1]) & (children[2] < children[3])
        kept = whole & (children[4] >= 0)
        tally["pruned"] += int((whole & ~kept).sum())
        kept &= (children[0] != children[2]) | (children[1] - children[0] > 1)  # a leaf with itself
        if kept.any():
            todo.append((bit, *(x[kept] for x in children)))
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return forest(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _walk(width: int, budget: int, check_bits: int):
    """Walks the tries of keys, whose rows come together and sorted by rest; emits links (a, b)."""

    def linked(key: np.ndarray, rest: np.ndarray, node: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        a, b = trie_links(rest.view(np.uint64), starts, width, budget, None, other.view(np.uint64), check_bits)
        if len(a):
            yield output({"a": (pa.int64(), node[a]), "b": (pa.int64(), node[b])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= BATCH_ROWS:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key's rows may go on
                if last:
                    yield from linked(*(c[:last] for c in columns))
                held, rows = [[c[last:] for c in columns]], len(columns[0]) - last
        if rows:
            yield from linked(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def near_links(distinct: DataFrame, walk_rows: int = WALK_ROWS, budget: int = MAX_DIFFERING_BITS, check_bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect all of ``distinct`` (fp long, node long, other long) within the budget of bits.

    ``fp`` must not repeat. Linked rows' ``other`` differ in at most ``check_bits`` bits.
    The links are a spanning forest of each trie's groups, not all pairs; their
    components are those of all pairs. Rows are counted by key before any task gets
    a key's rows; those of keys with more than ``walk_rows`` go to the next level of
    dealing.
    """
    rows = distinct.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "node", "other")
    blocks = budget + 1
    bits = _level_bits(blocks)
    links = None
    for level in range(LEVELS):
        dealt = rows.mapInArrow(_dealt(bits[level], blocks), _ROW_SQL)
        small, hot, n_hot = dealt, None, 0
        if level + 1 < LEVELS:
            hot = checkpointed(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > walk_rows).select("key"))
            n_hot = hot.count()
        if n_hot:
            hot = F.broadcast(hot) if n_hot <= MAX_HOT_BROADCAST else hot
            small = dealt.join(hot, "key", "left_anti")
        own = small.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(_walk(bits[level + 1], budget, check_bits), "a long, b long")
        links = own if links is None else links.union(own)
        if not n_hot:
            break
        rows = checkpointed(dealt.join(hot, "key", "left_semi").select("key", "rest", "node", "other"))
    return links


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    walk_rows: int = WALK_ROWS,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_DIFFERING_BITS,
    check_words: int | None = None,
    check_bits: int = BITS,
) -> DataFrame:
    """One row for each row of ``df``: id, fingerprint and component_id.

    Fingerprints are of shingles of ``shingle_words`` words; they link at
    ``max_bits`` or fewer differing bits, and where ``check_words`` is given only if
    those of so many words differ in at most ``check_bits`` bits too. Of texts that
    share a fingerprint the least such check fingerprint stands for all.

    ``component_id`` is the smallest id that links reach, the row's own
    included. A null text counts as empty; texts without words have fingerprint
    zero and link like others. Texts are read whole, however long. Repeated rows
    are one row each in the result; an empty table gives none. A row with a null id takes its fingerprint's
    component but lends it no id; where no row of a component has an id, the
    component_id is null. Rows that share an id count as one document with
    several fingerprints.
    """
    prints = checkpointed(fingerprints(df, id_col, text_col, shingle_words, check_words))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least"), F.min("other").alias("other"))).withColumn("node", F.col("fp"))
    by_id = distinct.filter("least is not null")
    links = near_links(distinct, walk_rows, max_bits, check_bits)
    same_id = _repeated_ids(prints)
    roots = connected_components(links.union(same_id))
    members = by_id.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    named = named.join(least, "root", "left").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _repeated_ids(prints: DataFrame) -> DataFrame:
    """Links between the fingerprints of rows that share an id."""
    spread = prints.filter("id is not null").groupBy("id").agg(F.min("fp").alias("b"), F.max("fp").alias("top"))
    spread = spread.filter("b <> top").select("id", "b")
    return prints.join(spread, "id").select(F.col("fp").alias("a"), "b").filter("a <> b")
