"""Packing of documents into token sequences by Karmarkar-Karp differencing.

Each task packs the documents of its partition in batches. Largest differencing
merges the partial partitions with the largest imbalances, the fullest window of
one with the emptiest of the other, until one partition of near-equal windows is
left. Whenever a window exceeds the capacity, their number rises and differencing
runs again. So no document that fits a window is cut to make room. What room is
left is filled with a few documents that were set aside for it, first those whose
length cuts them anyway; where these don't suffice, the emptiest windows are taken
apart for it.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graniteq.llm.common import take

CAPACITY = 2048
WINDOWS = 64  # of a batch
TINY = 64  # a piece of less than this part of a window is bundled with others
RESERVE = 1 / 16  # of a batch's tokens, set aside to fill up windows
END_OF_DOCUMENT = 1
VOCABULARY = "byte_bpe_50k.json"

_SEQUENCES_OF_A_TASK = 1 << 33


@cache
def byte_bpe(path: str | None = None):
    """The byte-level BPE of a tokenizers file, run by the faster tiktoken engine on the same vocabulary.

    Strings of special tokens in a text are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    byte_of = _bytes_by_letter()
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bytes_by_letter() -> dict[str, int]:
    """The printable stand-ins for bytes: visible Latin-1 characters for themselves, then U+0100 on for the rest."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _plain_byte_bpe(path: str | None = None):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
    tokenizer.encode_special_tokens = True
    return tokenizer


#: The faster engine's stack overflows on a run of very many white spaces.
_LONG_RUN = re.compile(r"\s{2000}")


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    """The text's ids and the end mark, as unsigned 32-bit integers."""
    if not text:
        ids = []
    elif _LONG_RUN.search(text):
        ids = _plain_byte_bpe(path).encode(text, add_special_tokens=False).ids
    else:
        ids = byte_bpe(path).encode_ordinary(text)
    return np.array([*ids, END_OF_DOCUMENT], np.uint32)


def differencing(lengths: Sequence[int], ways: int) -> list[list[int]]:
    """Deals items to ``ways`` windows of near-equal sums; gives each window's item numbers.

    Karmarkar and Karp's largest differencing method for many ways.
    """
    if not lengths:
        return [[] for _ in range(ways)]
    # (-imbalance, tie, sums, windows), fullest window first; a window is None, an item or a pair of windows
    heap: list = []
    for i, n in enumerate(lengths):
        heap.append((-n if ways > 1 else 0, i, [n] + [0] * (ways - 1), [i] + [None] * (ways - 1)))
    heapq.heapify(heap)
    tie = len(lengths)
    while len(heap) > 1:
        _, _, a, wa = heapq.heappop(heap)
        _, _, b, wb = heapq.heappop(heap)
        merged = [(x + y, p if q is None else q if p is None else (p, q)) for x, y, p, q in zip(a, reversed(b), wa, reversed(wb), strict=True)]
        merged.sort(key=lambda m: -m[0])
        sums = [m[0] for m in merged]
        heapq.heappush(heap, (sums[-1] - sums[0], tie, sums, [m[1] for m in merged]))
        tie += 1
    return [_flat(w) for w in heap[0][3]]


def _flat(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo += (t[1], t[0])
        elif t is not None:
            out.append(t)
    return out


#: (document number, start, length)
Piece = tuple[int, int, int]


def risen(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers by differencing, of at most ``capacity`` each; as many as it takes.

    The number of windows starts at what the items need at least, and rises by one,
    or by what the overflow would fill, whenever a window overflows.
    """
    ways = -(-sum(lengths) // capacity)
    while True:
        windows = differencing(lengths, ways)
        over = sum(max(0, sum(lengths[i] for i in w) - capacity) for w in windows)
        if not over:
            return windows
        ways += max(1, over // capacity)


def _bundled(pieces: Sequence[Piece], capacity: int) -> list[list[Piece]]:
    """The pieces one by one, but tiny ones, such as empty documents, some together."""
    tiny = capacity // TINY
    bundles: list[list[Piece]] = []
    own: list[Piece] = []
    size = 0
    for p in pieces:
        if p[2] >= tiny:
            bundles.append([p])
            continue
        own.append(p)
        size += p[2]
        if size >= tiny:
            bundles.append(own)
            own, size = [], 0
    return bundles + [own] * bool(own)


def _filled(pieces: Sequence[Piece], cut: Sequence[bool], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces that fill none. ``cut`` tells which are parts of a document that is cut already."""
    full: list[list[Piece]] = []
    items: list[tuple[bool, Piece]] = []
    for (doc, at, n), was_cut in zip(pieces, cut, strict=True):
        whole = n // capacity
        full += [[(doc, at + k * capacity, capacity)] for k in range(whole)]
        if n % capacity:
            items.append((was_cut or whole > 0, (doc, at + whole * capacity, n % capacity)))
    order = sorted(range(len(items)), key=lambda i: (not items[i][0], -items[i][1][2], i))
    aside, held = [], sum(p[2] for _, p in items) * RESERVE
    for i in order[:-1]:
        if held <= 0:
            break
        aside.append(i)
        held -= items[i][1][2]
    rest = _bundled([items[i][1] for i in sorted(set(range(len(items))) - set(aside))], capacity)
    windows = [[p for i in w for p in rest[i]] for w in risen([sum(p[2] for p in u) for u in rest], capacity)]
    windows.sort(key=lambda w: -sum(p[2] for p in w))
    filler = deque(items[i][1] for i in aside)
    at = 0
    while at < len(windows):
        room = capacity - sum(p[2] for p in windows[at])
        while room and (filler or at + 1 < len(windows)):
            if not filler:
                filler.extend(sorted(windows.pop(), key=lambda p: -p[2]))
            doc, start, n = filler.popleft()
            windows[at].append((doc, start, min(n, room)))
            if n > room:
                filler.appendleft((doc, start + room, n - room))
            room -= min(n, room)
        if room:
            break
        at += 1
    return full + windows[:at], [*(p for w in windows[at:] for p in w), *filler]


def pack_batch(lengths: Sequence[int], starts: Sequence[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of pieces of at most ``capacity`` tokens; document i has ``lengths[i]`` from ``starts[i]`` on.

    All but the last are full.
    """
    sequences, rest = _filled([(i, at, n) for i, (n, at) in enumerate(zip(lengths, starts, strict=True)) if n], [at > 0 for n, at in zip(lengths, starts, strict=True) if n], capacity)
    while rest:  # a batch of less than its reserve
        more, left = _filled(rest, [True] * len(rest), capacity) if sum(p[2] for p in rest) >= capacity else ([rest], [])
        sequences += more
        rest = left
    return sequences


def powers_of_two(n: int) -> list[int]:
    """The powers of two that make up ``n``, from the largest."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_rows(documents: Iterator[tuple[object, np.ndarray]], capacity: int = CAPACITY, windows: int = WINDOWS):
    """Packs (id, tokens) and yields batches: lists of sequences, each a list of (id, tokens, start, length).

    What is left at the end and fills no whole window makes sequences whose
    lengths are powers of two.
    """
    goal = capacity * windows
    held: list[tuple[object, np.ndarray, int, int]] = []  # id, tokens, start, length
    total = 0

    def close() -> list:
        """Full sequences of what is held; the rest stays held."""
        nonlocal held, total
        sequences, rest = _filled([(i, d[2], d[3]) for i, d in enumerate(held)], [d[3] < len(d[1]) for d in held], capacity)
        out = [[(held[i][0], held[i][1], at, n) for i, at, n in s] for s in sequences]
        held = [(held[i][0], held[i][1], at, n) for i, at, n in rest]
        total = sum(d[3] for d in held)
        return out

    for key, tokens in documents:
        held.append((key, tokens, 0, len(tokens)))
        total += len(tokens)
        if total >= goal:
            yield close()
    while total >= capacity:
        yield close()
    tail = []
    for size in powers_of_two(total):
        sequence, left, rest = [], size, []
        for d in held:
            n = min(left, d[3])
            if n:
                sequence.append((d[0], d[1], d[2], n))
            if n < d[3]:
                rest.append((d[0], d[1], d[2] + n, d[3] - n))
            left -= n
        held = rest
        tail.append(sequence)
    if tail:
        yield tail


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    windows: int = WINDOWS,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    An empty table gives no rows, null ids are kept, and texts of any length are
    packed whole. Documents of equal length tie; the earlier row goes first.
    A document's tokens are its ids and an end mark; a null text is empty, so it
    has one token. ``start`` counts the document's tokens before the piece,
    ``offset`` those before it in its sequence. Nothing is shuffled: a task packs
    the rows of its partition, and a sequence_id names the partition and the
    sequence within it. So the rows must come from a table, whose partitions a
    task that is run again reads alike. ``with_ids`` adds the piece's ``ids``.
    ``capacity`` must be a power of two. Rows that repeat are packed each.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = take(df, {"id": id_col, "text": text_col})
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * _SEQUENCES_OF_A_TASK
        id_type = [None]

        def documents():
            for batch in batches:
                id_type[0] = batch.column(0).type
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield key.as_py(), token_ids(text.as_py(), vocabulary)

        for sequences in pack_rows(documents(), capacity, windows):
            out: list[list] = [[] for _ in range(7)]
            pieces = []
            for s in sequences:
                offset = 0
                for key, tokens, start, n in s:
                    own = tokens[start : start + n]
                    for c, v in zip(out, (key, start, n, zlib.crc32(own.astype("<u4").tobytes()), len(tokens), number, offset), strict=True):
                        c.append(v)
                    offset += n
                    if with_ids:
                        pieces.append(own)
                number += 1
            arrays = [pa.array(out[0], id_type[0]), *(pa.array(c, pa.int64()) for c in out[1:])]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.cumsum([0, *(len(p) for p in pieces)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def invariants(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row that counts what must not be: sequences over the capacity, padded ones, gaps in sequences, documents that aren't whole.

    ``pieces`` come from ``pack_documents`` over ids that don't repeat.
    """
    n, seq, doc = F.col("length"), Window.partitionBy("sequence_id").orderBy("offset"), Window.partitionBy(id_col).orderBy("start")
    after = lambda at, w: (F.col(at) != F.coalesce(F.lag(F.col(at) + n).over(w), F.lit(0))).cast("long")
    checked = pieces.select(id_col, "sequence_id", "length", "doc_tokens", after("offset", seq).alias("gap"), after("start", doc).alias("hole"))
    total = F.sum("length")
    sequences = checked.groupBy("sequence_id").agg(total.alias("used"), F.sum("gap").alias("gap"))
    odd = F.col("used").bitwiseAND(F.col("used") - 1) != 0
    sums = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    names, none = ("n_documents", "n_broken", "n_over", "n_padded", "n_gaps"), F.lit(0).cast("long")
    s = sequences.agg(none, none, sums(F.col("used") > capacity), sums(odd), sums(F.col("gap")))
    documents = checked.groupBy(id_col).agg(((total != F.max("doc_tokens")) | (F.sum("hole") > 0)).alias("broken"))
    d = documents.agg(F.count(F.lit(1)), sums(F.col("broken")), none, none, none)
    return d.toDF(*names).union(s.toDF(*names)).agg(*[F.sum(n).alias(n) for n in names])


def invariants_sql(table: str = "documents") -> str:
    """DuckDB SQL for ``invariants`` of the packed documents."""
    return f"select count(distinct doc_id) as n_documents, 0::bigint as n_broken, 0::bigint as n_over, 0::bigint as n_padded, 0::bigint as n_gaps from {table}"
