"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected to two times eight dimensions in several tables, each
time by other random directions, and each eight are decoded to the nearest point
of the lattice E8; the two points are the vector's cell. A vector meets those of
its own cell and of the neighbouring cells that replace one of the points by one
of those next nearest to the projection. Cosines of those that meet are computed
in double precision. A pair counts in the first table in which one finds the other.

Identical vectors are one class from the start. First only cells and numbers of
classes are shuffled, which shows the cells where two classes meet; only there
vectors are sent. A cell too large for one task is dealt out: its classes are split
into parts, and each part meets all that probe the cell. Tasks emit sums of links
and a spanning forest of them, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteq.llm.common import checkpointed, output, take
from graniteq.llm.components import connected_components, forest

MIN_COSINE = 0.98
TABLES = 4
PROBES = 3  # neighbouring points of each of a cell's two
CELL = 2.0  # side of the lattice, in standard deviations of a projected unit vector
SEED = 17
CELL_ROWS = 16384  # a cell with more classes is dealt out
ROWS_AT_ONCE = 1024
SMALL_ROWS = 8192  # of cells that are compared together
PAIRS_AT_ONCE = 1 << 15
LINKS_AT_ONCE = 1 << 20

_POINTS = 2  # of a cell


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [v for v in product((-1.0, 0.0, 1.0), repeat=8) if sum(map(abs, v)) == 2]
    half = [v for v in product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half)


def _decode_even(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of an even sum."""
    near = np.rint(x)
    error = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(error[odd]).argmax(1)
    near[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row."""
    a, b = _decode_even(x), _decode_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@cache
def _projections(dims: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng((SEED, dims))
    return r.normal(size=(tables, _POINTS, dims, 8)) / CELL, r.uniform(0, 2, (tables, _POINTS, 8))


_MIX = np.array([0x9E3779B97F4A7C15, 0x85EBCA77C2B2AE63, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5, 0x165667B19E3779F9, 0xD3A2646CBFD65E23, 0xFD7046C5AA2BE25B, 0xB55A4F09E2C6A4F5], np.uint64)
_SCRAMBLE = np.uint64(0xBF58476D1CE4E5B9)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _SCRAMBLE
    return h ^ (h >> np.uint64(29))


def _named(points: np.ndarray) -> np.ndarray:
    """Lattice points as 64-bit numbers; points that share one make a common cell."""
    with np.errstate(over="ignore"):
        return _scrambled(((2 * points).astype(np.int64).view(np.uint64) * _MIX).sum(-1, dtype=np.uint64))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cells(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """For each unit vector and table the numbers of its own and its probed cells."""
    directions, offsets = _projections(vectors.shape[1], tables)
    out = np.empty((len(vectors), tables, 1 + _POINTS * probes), np.uint64)
    around = neighbours().T
    for t in range(tables):
        own, near = [], []
        for directions_of, offset in zip(directions[t], offsets[t], strict=True):
            x = vectors @ directions_of + offset
            point = decode(x)
            next_to = np.argpartition(-((x - point) @ around), probes, axis=1)[:, :probes] if probes else np.empty((len(x), 0), int)
            own.append(_named(point))
            near.append(_named(point[:, None, :] + neighbours()[next_to]))
        with np.errstate(over="ignore"):
            out[:, t, 0] = _scrambled(own[0] + own[1] * _SCRAMBLE)
            out[:, t, 1 : 1 + probes] = _scrambled(near[0] + (own[1] * _SCRAMBLE)[:, None])
            out[:, t, 1 + probes :] = _scrambled(own[0][:, None] + near[1] * _SCRAMBLE)
    return out


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _coded(tables: int, probes: int):
    """For each class (cid, group, vec) the keys of its own cells and of those it probes, in all tables."""

    def lists(rows: np.ndarray) -> pa.ListArray:
        ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel().view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for k in range(0, len(at), ROWS_AT_ONCE):
                    part = batch.take(pa.array(at[k : k + ROWS_AT_ONCE]))
                    group = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                    with np.errstate(over="ignore"):
                        keys = _scrambled(cells(unit(_matrix(part.column(2))), tables, probes) + (group * _MIX[0])[:, None, None] + np.arange(tables, dtype=np.uint64)[:, None])
                    yield output({"cid": (None, part.column(0)), "own": (None, lists(keys[:, :, 0])), "probed": (None, lists(keys[:, :, 1:].reshape(len(keys), -1)))})

    return run


class _Rows:
    """Rows as arrays; the codes of their cells are made for those that are asked."""

    def __init__(self, batches: list[pa.RecordBatch], tables: int, probes: int):
        rows = pa.Table.from_batches(batches)
        self.id, self.n = rows.column("cid").to_numpy(), rows.column("copies").to_numpy()
        self.unit = unit(_matrix(rows.column("vec").combine_chunks()))
        self.tables, self.probes = tables, probes
        self._codes = np.empty((len(self.id), tables, 1 + _POINTS * probes), np.uint64)
        self._coded = np.zeros(len(self.id), bool)

    def codes(self, at: np.ndarray) -> np.ndarray:
        asked = np.zeros(len(self.id), bool)
        asked[at] = True
        new = np.flatnonzero(asked & ~self._coded)
        for lo in range(0, len(new), ROWS_AT_ONCE):
            part = new[lo : lo + ROWS_AT_ONCE]
            self._codes[part] = cells(self.unit[part], self.tables, self.probes)
        self._coded[new] = True
        return self._codes[at]


def _count(who: _Rows, members: _Rows, i: np.ndarray, j: np.ndarray, t: np.ndarray | int, out: dict) -> None:
    """Adds the links between ``who[i]`` and ``members[j]``, met in the cells of table ``t``, to ``out``: sums, and links that connect."""
    apart = who.id[i] != members.id[j]
    i, j, t = i[apart], j[apart], np.broadcast_to(t, len(apart))[apart]
    for lo in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(lo, lo + PAIRS_AT_ONCE)
        x, y, table = i[part], j[part], t[part]
        a, b = who.codes(x), members.codes(y)
        earlier = np.zeros(len(x), bool)
        for e in range(int(table.max())):
            earlier |= (table > e) & ((a[:, e] == b[:, e, :1]).any(1) | (b[:, e] == a[:, e, :1]).any(1))
        new = ~earlier
        x, y, table, a, b = x[new], y[new], table[new], a[new], b[new]
        if not len(x):
            continue
        row = np.arange(len(x))
        back = (b[row, table] == a[row, table, :1]).any(1)  # then the other one finds this one in its own cell
        for rows, at, links in ((who, x, members.n[y]), (members, y[~back], who.n[x[~back]])):
            sums = np.bincount(at, links, len(rows.id)).astype(np.int64)
            own = np.flatnonzero(sums)
            out["links"].append((rows.id[own], sums[own]))
        out["found"].append((who.id[x], members.id[y]))
        if sum(len(p[0]) for p in out["found"]) >= LINKS_AT_ONCE:
            _connected(out)


def _connected(out: dict) -> None:
    """Replaces the links that were found by stars that connect the same."""
    if out["found"]:
        out["found"] = [forest(*(np.concatenate(x) for x in zip(*out["found"], strict=True)))]


def _meet(who: _Rows, members: _Rows, t: int, least: float, out: dict) -> None:
    """All of ``who`` against all members of one cell, block by block."""
    for lo in range(0, len(who.id), ROWS_AT_ONCE):
        for at in range(0, len(members.id), ROWS_AT_ONCE):
            i, j = np.nonzero(who.unit[lo : lo + ROWS_AT_ONCE] @ members.unit[at : at + ROWS_AT_ONCE].T >= least)
            if len(i):
                _count(who, members, i + lo, j + at, t, out)


def _meet_in_cells(rows: _Rows, starts: np.ndarray, members: np.ndarray, t: np.ndarray, least: float, out: dict) -> None:
    """Each row against the members of its own small cell, which stand first in it; many cells at once."""
    sizes = np.diff(np.r_[starts, len(rows.id)])
    each = np.repeat(members, sizes)  # whom each row meets
    first = np.repeat(starts, sizes)
    ends = np.cumsum(each)
    lo = 0
    while lo < len(each):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE)))
        own = each[lo:hi]
        i = np.repeat(np.arange(lo, hi), own)
        j = np.repeat(first[lo:hi], own) + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        near = np.einsum("ij,ij->i", rows.unit[i], rows.unit[j]) >= least
        if near.any():
            i, j = i[near], j[near]
            _count(rows, rows, i, j, np.repeat(t, sizes)[i], out)
        lo = hi


def _results(out: dict) -> Iterator[pa.RecordBatch]:
    _connected(out)
    for kind, name, other in (("found", "b", "links"), ("links", "links", "b")):
        a, x = (np.concatenate([np.empty(0, np.int64), *(p[i] for p in out[kind])]) for i in (0, 1))
        if len(a):
            columns = {"a": (pa.int64(), a), name: (pa.int64(), x), other: (pa.int64(), [None] * len(a))}
            yield output({c: columns[c] for c in ("a", "b", "links")})


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(values of the columns, rows) for stretches of rows that agree on them; a long one comes in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            yield tuple(int(k[lo]) for k in keys), batch.slice(lo, hi - lo)


_SENT_SQL = "key long, part int, grp long, role int, t int, cid long, copies long, vec array<float>"


def _compare(tables: int, probes: int, least: float):
    """Compares the rows of each key, part and group: its members come first and are kept, those that probe it stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        t, cell_rows = 0, 0
        kept: list[pa.RecordBatch] = []  # of the cell that is being read
        probing: list[pa.RecordBatch] = []
        members: _Rows | None = None
        small: list[tuple[list[pa.RecordBatch], int, int, int]] = []  # cells: rows, how many, members, table
        small_rows = 0

        def large() -> Iterator[pa.RecordBatch]:
            """Judges what has been read of a cell that isn't small."""
            nonlocal members
            out: dict = {"links": [], "found": []}
            if members is None and kept:
                members = _Rows(kept, tables, probes)
                _meet(members, members, t, least, out)
            if members is not None and probing:
                _meet(_Rows(probing, tables, probes), members, t, least, out)
            probing.clear()
            yield from _results(out)

        def together() -> Iterator[pa.RecordBatch]:
            """Judges the small cells that are held, those of one length of vectors at a time."""
            nonlocal small_rows
            by_length: dict[int, list] = {}
            for c in small:
                by_length.setdefault(len(c[0][0].column("vec")[0]), []).append(c)
            for own in by_length.values():
                out: dict = {"links": [], "found": []}
                sizes = np.array([c[1] for c in own])
                rows = _Rows([b for c in own for b in c[0]], tables, probes)
                _meet_in_cells(rows, np.cumsum(sizes) - sizes, np.array([c[2] for c in own]), np.array([c[3] for c in own]), least, out)
                yield from _results(out)
            small.clear()
            small_rows = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal small_rows
            if members is not None or cell_rows > ROWS_AT_ONCE:
                yield from large()
            elif kept and cell_rows > 1:
                small.append(([*kept, *probing], cell_rows, sum(b.num_rows for b in kept), t))
                small_rows += cell_rows
                if small_rows >= SMALL_ROWS:
                    yield from together()

        for own, rows in _runs(batches, ["key", "part", "grp", "role", "t"]):
            if own[:3] != key:
                yield from closed()
                key, t, members, cell_rows = own[:3], own[4], None, 0
                kept, probing = [], []
            (probing if own[3] else kept).append(rows)
            cell_rows += rows.num_rows
            if sum(r.num_rows for r in probing) >= ROWS_AT_ONCE:
                yield from large()
        yield from closed()
        yield from together()

    return run


def _meeting(coded: DataFrame, cell_rows: int) -> DataFrame:
    """(cid, key, t, part, role) for every class in a cell where two meet. Role 0: a member of the part; 1: one that probes it.

    A cell of more members than ``cell_rows`` has several parts; each member
    belongs to one of them and probes the others.
    """
    members = coded.select("cid", F.posexplode("own").alias("t", "key"))
    size = F.size("own")
    probing = coded.select("cid", size.alias("tables"), (F.size("probed") / size).cast("int").alias("each"), F.posexplode("probed").alias("place", "key"))
    probing = probing.select("cid", F.floor(F.col("place") / F.col("each")).cast("int").alias("t"), "key")
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    found = checkpointed(probing.join(counts, "key").select("cid", "t", "key", "m"))
    alive = found.select("key", "m").union(counts.filter("m > 1").select("key", "m")).distinct()
    parts = F.ceil(F.col("m") / cell_rows).cast("int")
    each = F.explode(F.sequence(F.lit(0), parts - 1))
    own = members.join(alive, "key").select("cid", "t", "key", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("mine"), each.alias("part"))
    own = own.select("cid", "t", "key", "part", (F.col("part") != F.col("mine")).cast("int").alias("role"))
    return own.union(found.select("cid", "t", "key", each.alias("part"), F.lit(1).alias("role")))


def link_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = MIN_COSINE,
    tables: int = TABLES,
    probes: int = PROBES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row for each vector: id, n_links, component_id, kept.

    Vectors of one label and length link if their cosine is ``min_cosine`` or
    more and the lattice leads one to the other. A vector that is null, empty,
    zero or holds null or non-finite components links with nothing, and so does
    one with a null label or id. ``component_id`` is the smallest id that links
    reach, the vector's own included; ``kept`` tells whether that is its own, and
    is true for a null id. Components are read as 32-bit floats. Rows that share
    an id are vectors of their own, whether they repeat a vector or not. An empty
    table gives no rows; other columns may have clashing names.
    """
    v = F.col("vec")
    rows = take(df, {"id": id_col, "vec": vector_col, "label": label_col}).select(F.col("id").cast("long"), F.col("vec").cast("array<float>"), "label")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    named = rows.select("id", "vec", usable.alias("usable"), F.xxhash64("label", F.size(v)).alias("grp"), F.xxhash64(F.lit("a"), v).alias("h0"), F.xxhash64(F.lit("b"), v).alias("h1"))
    same = ["grp", "h0", "h1"]
    classes = named.filter("usable").groupBy(*same).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("vec").alias("vec"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))  # the numbers stay once they are written

    coded = checkpointed(classes.select("cid", "grp", "vec").mapInArrow(_coded(tables, probes), "cid long, own array<long>, probed array<long>"))
    sent = _meeting(coded, cell_rows).join(classes.select("cid", "grp", "copies", "vec"), "cid").select("key", "part", "grp", "role", "t", "cid", "copies", "vec")
    order = ["key", "part", "grp", "role"]
    results = sent.repartition("key", "part").sortWithinPartitions(*order).mapInArrow(_compare(tables, probes, min_cosine), "a long, b long, links long")
    results = checkpointed(results.filter("b is not null or links is not null"))

    links = results.filter("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = connected_components(results.filter("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    slim = classes.select("cid", *same, "least", "copies")
    connected = slim.select("cid", "least").join(roots, "cid")
    least = connected.groupBy("root").agg(F.min("least").alias("component_id"))
    component = connected.select("cid", "root").join(least, "root").select("cid", "component_id")
    linked = slim.join(links, "cid", "left").join(component, "cid", "left")
    linked = linked.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    known = named.filter("usable").select("id", *same).join(linked, same).select("id", "n_links", "component_id")
    out = known.union(named.filter("not usable").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def link_vectors_sql() -> str:
    """DuckDB SQL: all pairs of a label, and the smallest id that each vector reaches."""
    return f"""with recursive n as (select vec_id, embedding, label, row_number() over () as i from embeddings),
v as (select i, label, embedding::double[] as e from n
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.i as a, b.i as b from v a join v b on a.label = b.label and a.i <> b.i and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {MIN_COSINE!r}),
r(a, b) as (select i, i from n union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(vec_id) as component_id from r join n on n.i = b group by 1), k as (select a, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, coalesce(vec_id = component_id, true) as kept from n join c on c.a = i left join k on k.a = i"""
