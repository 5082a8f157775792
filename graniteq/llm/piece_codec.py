"""Encoding and decoding with a SentencePiece model of the merge type.

A text becomes the sequence of pieces that repeated merging of the best pair
gives, without merging: at each place the longest piece is tried (an
Aho-Corasick automaton finds the pieces), then its shorter ones. A piece may
follow another only if merging both their texts together gives those two
again. Where none may, the last piece is taken back, and a bit field marks the
place as one from which no encoding goes on.

Pieces never join two characters that stand side by side in no piece. So a text
is cut where a space mark follows another character, if no piece spans that
place, and each distinct chunk is encoded once while it is remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graniteq.llm.common import output, take

MODEL = "piece_bpe_32k.model"
SPACE = "▁"

#: Chunks and pairs of pieces that a worker remembers; when there are more, it starts anew.
REMEMBERED_CHUNKS = 500_000
REMEMBERED_PAIRS = 400_000

#: Places in one number of the bit field.
_FIELD_BITS = 9
_FIELD_MASK = (1 << _FIELD_BITS) - 1

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _one_mark_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("graniteq.one_mark_each", _one_mark_each)


class _Chunks(dict):
    """The encoded ids of chunks, made when they are first asked for. Long chunks aren't remembered."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED_CHUNKS:
            self.clear()
        ids = self.encode(chunk)
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


class PieceModel:
    """A merge-type model without text normalisation, with byte fallback and a leading space mark."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        trained, normal = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if (
            trained.model_type != trained.BPE
            or not trained.byte_fallback
            or trained.treat_whitespace_as_suffix
            or normal.precompiled_charsmap
            or normal.remove_extra_whitespaces
            or not normal.add_dummy_prefix
            or kinds & {_USER, _UNUSED}
        ):
            raise ValueError(f"{path}: only merge-type models with byte fallback and no normalisation are handled")
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.bos, self.eos = trained.bos_id, trained.eos_id
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else trained.unk_surface.encode() if p.type == _UNKNOWN else p.piece.encode() for p in proto.pieces]
        seen: dict[float, str] = {}
        for piece, score in self.scores.items():
            if len(piece) > 1 and score in seen and (set(piece) | set(seen[score])) != {SPACE}:
                raise ValueError(f"{path}: {piece!r} and {seen[score]!r} have the same score")
            if len(piece) > 1:
                seen[score] = piece
        runs = [s for p, s in self.scores.items() if len(p) > 1 and set(p) == {SPACE}]
        others = [s for p, s in self.scores.items() if len(p) > 1 and set(p) != {SPACE}]
        if runs and others and max(runs) >= min(others):
            raise ValueError(f"{path}: runs of space marks must merge last")
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.scores):
            raise ValueError(f"{path}: a piece spans the start of a word")
        self.splits: dict[str, tuple[str, str] | None] = {}
        known = "".join(sorted({c for p in self.scores for c in p}))
        self.foreign = re.compile(f"[^{re.escape(known)}]")
        self.cut = re.compile(self._chunks(set(known))).findall
        #: Which merge comes first; single characters need none.
        self.ranks = {p: i for i, p in enumerate(sorted((p for p in self.scores if len(p) > 1), key=lambda p: -self.scores[p]))}
        self.shorter: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ranks:  # runs of space marks and pieces that merging never makes are left out
            if piece.strip(SPACE) and self._split(piece):
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks = _Chunks(self._chunk_ids)

    def _chunks(self, known: set[str]) -> str:
        """A pattern for chunks, such that no piece joins characters across the start of one.

        A chunk starts at space marks, at punctuation that stands behind no letter,
        digit or the like in any piece but does here, and at ends of lines where no
        piece has them.
        """
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        cut = marks - {b for p in self.scores for a, b in pairwise(p) if a != SPACE and a not in marks}
        line = "" if "\n" in known else "\n"
        inner = lambda cs: "".join(map(re.escape, sorted(cs)))
        if not cut:
            return f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + f"|{line}+" * bool(line)
        on = f"(?:[^{SPACE}{line}{inner(cut)}]+|(?<![^{SPACE}{line}{inner(marks)}])[{inner(cut)}]+)"
        return f"{SPACE}+{on}*|[{inner(cut)}]+{on}*|{on}+" + f"|{line}+" * bool(line)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best score first, the leftmost of equal ones."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := self.scores.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, both, j))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes this piece, or None if merging never makes it."""
        if piece not in self.splits:
            parts, last = list(piece), None
            while len(parts) > 1:
                best = None
                for i in range(len(parts) - 1):
                    r = self.ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best[0]):
                        best = (r, i)
                if best is None:
                    break
                i = best[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.splits[piece] = last if len(parts) == 1 else None
        return self.splits[piece]

    def _fits(self, first: str, second: str) -> bool:
        """Whether merging both texts together gives the two pieces again.

        Undoes their merges from the last one back. The parts that face each other
        at the boundary must not merge before one of them is used up.
        """
        ranks, limit = self.ranks, len(self.ranks)
        while True:
            r = ranks.get(first + second)
            if r is not None and r < limit:
                return False
            a = ranks[first] if len(first) > 1 else -1
            b = ranks[second] if len(second) > 1 else -1
            if a > b:
                limit, first = a, self._split(first)[1]
            elif b >= 0:
                limit, second = b + 1, self._split(second)[0]
            else:
                return True

    def _shorter(self, piece: str) -> str:
        """The longest piece that begins this one, or its first character."""
        n = len(piece) - 1
        while n > 1 and not (piece[:n] in self.ranks and self._split(piece[:n])):
            n -= 1
        found = self.shorter[piece] = piece[:n]
        return found

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose only space mark, if any, is its first character."""
        n = len(text)
        longest = [1] * n
        for end, size in self.automaton.iter(text):  # of those that start together the longest comes last
            longest[end + 1 - size] = size
        closed, pairs, shorter = [0] * ((n >> _FIELD_BITS) + 1), self.pairs, self.shorter  # a bit for each place from which no encoding goes on
        out: list[str] = []
        at, last, piece = 0, None, text[: longest[0]]
        while at < n:
            while True:
                then = at + len(piece)
                if not closed[then >> _FIELD_BITS] >> (then & _FIELD_MASK) & 1:
                    if last is None:
                        break
                    fits = pairs.get((last, piece))
                    if fits is None:
                        if len(pairs) >= REMEMBERED_PAIRS:
                            pairs.clear()
                        fits = pairs[last, piece] = self._fits(last, piece)
                    if fits:
                        break
                if len(piece) == 1:
                    piece = None
                    break
                piece = shorter.get(piece) or self._shorter(piece)
            if piece is not None:
                out.append(piece)
                at += len(piece)
                last = piece
                if at < n:
                    piece = text[at : at + longest[at]]
            else:  # nothing may follow here: the last piece is taken back and a shorter one is tried
                closed[at >> _FIELD_BITS] |= 1 << (at & _FIELD_MASK)
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else None
        return out

    def _chunk_ids(self, chunk: str) -> bytes:
        word = chunk.lstrip(SPACE)
        marks = len(chunk) - len(word)
        whole = chunk if marks < 2 else SPACE + word
        pieces = [] if not word else self._long(whole) if self.foreign.search(word) else self.pieces(whole)
        if marks > 1 or not word:  # runs of marks merge last, and among themselves
            if word and pieces[0] == SPACE:
                pieces = self.merged(SPACE * marks) + pieces[1:]
            else:  # the word has taken its mark
                pieces = self.merged(SPACE * (marks - bool(word))) + pieces
        ids = list(map(self.ids.get, pieces))
        if None in ids:
            ids = [i for p in pieces for i in ((self.ids[p],) if p in self.ids else map(self.byte_ids.__getitem__, p.encode()))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _long(self, text: str) -> list[str]:
        """Cuts at characters that are in no piece; nothing joins across them."""
        out: list[str] = []
        at = 0
        for m in self.foreign.finditer(text):
            if m.start() > at:
                out += self.pieces(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pieces(text[at:]) if at < len(text) else out

    def encode(self, text: str) -> np.ndarray:
        """All ids, between the begin and the end id."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        chunks = self.cut(SPACE + text.replace(" ", SPACE)) if text else ()
        return np.frombuffer(b"".join([begin, *map(self.chunks.__getitem__, chunks), end]), "<u4")

    def decode(self, ids) -> str:
        """The text of ids; a byte that belongs to no character becomes one replacement mark."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = raw.decode(errors="graniteq.one_mark_each")
        return text.removeprefix(SPACE).replace(SPACE, " ")


@cache
def piece_model(path: str | None = None) -> PieceModel:
    import public_tokenizers

    return PieceModel(path or public_tokenizers.path(MODEL))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row for each row: id, and its ``ids`` as an array.

    A null text is empty; texts of any length are encoded whole, in linear time.
    Null ids are kept, repeated rows are encoded each, an empty table gives no
    rows, and other columns may have clashing names.
    """
    rows = take(df, {"id": id_col, "text": text_col})
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_model(model)
        for batch in batches:
            ids = [codec.encode(t.as_py() or "") for t in batch.column(1)]
            ends = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)))
            yield output({"id": (None, batch.column(0)), "ids": (None, lists)})

    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row for each row: id, n_tokens, ids_sha256, decoded_sha256, of the encoded and then decoded text.

    A null text is empty: its ids are the begin and the end id. Else as
    ``encode_documents``.
    """
    rows = take(df, {"id": id_col, "text": text_col})
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_model(model)
        for batch in batches:
            counts, own, back = [], [], []
            for t in batch.column(1):
                ids = codec.encode(t.as_py() or "")
                counts.append(len(ids))
                own.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield output({"id": (None, batch.column(0)), "n_tokens": (pa.int64(), counts), "ids_sha256": (pa.string(), own), "decoded_sha256": (pa.string(), back)})

    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def decoded_sql(table: str = "documents") -> str:
    """DuckDB SQL for the digests of decoded texts: decoding gives the text again, but with spaces for space marks."""
    return f"select doc_id, sha256(replace(coalesce(text, ''), '{SPACE}', ' ')) as decoded_sha256 from {table}"
