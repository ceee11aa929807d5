"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a SentencePiece model: the normaliser (rewriting arcs of the model's character map, the
longest first; runs of spaces to one where the model says so; a dummy prefix; spaces to U+2581), the lexicon (a trie over
code points whose final states put out a piece), and byte fallback (for a code point without a piece, an arc that
puts out its UTF-8 bytes; without byte pieces, one unknown id for a run of such code points).  An input is composed with them, arc by arc as a search asks for them, and the encoding is
the shortest path in the tropical semiring: the search takes the lightest open state first, of equal ones the furthest.

Weights.  For a unigram model an arc into a piece weighs minus its score.  For a BPE model, states also remember the
last piece, and the arc from piece u to piece v weighs 0 if merging their text anew gives u, v again, and infinity
otherwise.  A sequence of pieces is what greedy merging yields if and only if each neighbouring pair is stable in this
way, so exactly one path of finite weight is left, and it is the library's encoding; as this holds for each prefix of
a text too, a place is a state, and the last piece is known from the one path that leads there.

No piece holds U+2581 after another character, or a code point that the vocabulary lacks, so a text falls into units at
those places, whose paths are independent; the paths of units seen before are kept in a table of bounded size.

Defined results: a null text is an empty one; an empty text has no ids; text that holds U+2581 is decoded with spaces in
its place (round_trip is false), as in the library; a null doc_id is allowed; rows with one doc_id are encoded each.
Columns besides doc_id and text are only passed on.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
import struct
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._store import texts, tuned

SPACE = "▁"
_NORMAL, _USER, _BYTE = 1, 4, 6
UNIT_CACHE, PAIR_CACHE, MERGES_CACHE = 150_000, 200_000, 20_000
INFINITE, UNKNOWN = math.inf, 1e3  # the weight of a code point put out as bytes, in a unigram model
_SPACES = re.compile(" +")
_LETTERS = re.compile(f"{SPACE}*[^\\W\\d_{SPACE}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Normaliser:
    """The model's normaliser as a transducer on UTF-8 bytes.

    The character map is a double-array trie: a node's units hold the offset of its children, a child is found by its
    byte, and a leaf holds the place of what the bytes up to it are rewritten to.
    """

    def __init__(self, spec, suffix: bool):
        self.spec, self.suffix = spec, suffix
        self.space = SPACE if spec.escape_whitespaces else " "
        data = spec.precompiled_charsmap
        if data:
            (size,) = struct.unpack_from("<I", data)
            self.nodes, self.texts = struct.unpack_from(f"<{size // 4}I", data, 4), data[4 + size :]
        self.plain = not data and not spec.remove_extra_whitespaces

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)

    def rewritten(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the longest arc from `at` puts out, and how many bytes it reads; else one code point as it is."""
        best, node = None, self._offset(self.nodes[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.nodes[node] if node < len(self.nodes) else 0
            if unit & (1 << 31 | 0xFF) != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = self.nodes[node] & 0x7FFFFFFF, k + 1 - at
        if best:
            return self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1]
        size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        return data[at : at + size], size

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if not self.plain:
            if self.spec.precompiled_charsmap:
                data, out, at = text.encode(), [], 0
                while at < len(data):
                    part, size = self.rewritten(data, at)
                    out.append(part)
                    at += size
                text = b"".join(out).decode("utf-8", "replace")
            if self.spec.remove_extra_whitespaces:
                text = _SPACES.sub(" ", text).strip(" ")
            if not text:
                return ""
        text = text.replace(" ", self.space)
        if not self.spec.add_dummy_prefix:
            return text
        return text + self.space if self.suffix else self.space + text


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.normaliser = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.bpe = proto.trainer_spec.model_type == 2
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.out = [b""] * len(proto.pieces)
        for piece, (i, _) in self.pieces.items():
            self.out[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self.names = [None] * len(proto.pieces)  # of pieces that can merge
        for piece, (i, _) in self.pieces.items():
            self.names[i] = piece
        # the lexicon as a trie: code point -> node, and '' -> the pieces on the way there, the longest first: (piece, (piece, ...))
        self.lexicon: dict = {"": None}
        for piece in sorted(self.pieces):  # a piece comes after its prefixes
            node = self.lexicon
            for c in piece:
                node = node.setdefault(c, {"": node[""] or (c, None)})
            node[""] = (piece, node[""] if node[""] != (piece, None) else None)
        chars = set().union(*self.pieces)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        outside = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in chars)
        # units: maximal runs that start with spaces; control characters without a piece stand alone
        self.units = re.compile(f"[{outside}]|{SPACE}+[^{SPACE}{outside}]*|[^{SPACE}{outside}]+" if outside else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not inner else re.compile(r"(?s).+")
        self.new, self.old = {}, {}
        self.stable = lru_cache(PAIR_CACHE)(self._stable)
        self.merges = lru_cache(MERGES_CACHE)(self._merges)

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """Greedy merging of a short text: the best-scored neighbouring pair first, the leftmost of equals. steps takes of each merge the
        score and the parts that are first and last after it."""
        parts, get = list(text), self.pieces.get
        while True:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                p = get(parts[k] + parts[k + 1])
                if p and p[1] > best:
                    best, at = p[1], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))

    def _merges(self, piece: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether a piece is what its text merges to, and the steps."""
        steps: list = []
        return self.merged(piece, steps) == [piece], steps

    def _stable(self, u: str, v: str) -> bool:
        """Whether merging the text of both yields u, v: the merges of each by itself, in the order of their scores, until one across
        them is better scored than what is next (of equals the leftmost goes first)."""
        whole_v, right = self.merges(v)
        if not u or not whole_v:
            return whole_v
        whole_u, left = self.merges(u)
        if not whole_u:
            return False
        get, last, first, i, j = self.pieces.get, u[-1], v[0], 0, 0
        while True:
            a = left[i][0] if i < len(left) else -math.inf
            b = right[j][0] if j < len(right) else -math.inf
            across = get(last + first)
            if across and across[1] > a and across[1] >= b:
                return False
            if a >= b:
                if i == len(left):
                    return True
                last = left[i][2]
                i += 1
            else:
                first = right[j][1]
                j += 1

    def arcs_from(self, unit: str, i: int) -> tuple:
        """Pieces that the lexicon reads from place i, the longest first, each with the rest; a lone code point without a piece is in it too."""
        node = self.lexicon
        for c in unit[i:]:
            near = node.get(c)
            if near is None:
                break
            node = near
        return node[""] or (unit[i], None)

    def shortest_path(self, unit: str) -> list[str]:
        """The pieces of the lightest path through the unit composed with lexicon and fallback; a code point without a
        piece stands for its bytes.

        A state is a place in the unit.  Open states lie in a heap by cost, then furthest place, each with the arcs that
        haven't been weighed yet, longest first; no arc weighs less than 0, so the first state at the unit's end that comes
        out of the heap ends the lightest path.  All finite weights of a BPE model are 0; there the state opened last is the furthest, and a
        stack does for the heap.
        """
        if self.bpe:
            return self._finite_path(unit)
        n, pieces, arcs_from = len(unit), self.pieces, self.arcs_from
        heap, taken, came = [(0.0, 0, "", None)], {}, {}  # cost, -place, piece that led here, place before
        while heap:
            cost, place, piece, before = heappop(heap)
            i = -place
            if i not in taken:
                taken[i], came[i] = arcs_from(unit, i) if i < n else None, (piece, before)
                if i == n:
                    break
            elif came[i] != (piece, before):
                continue  # a heavier way to a place that is settled
            if taken[i]:
                v, taken[i] = taken[i]
                w = -pieces[v][1] if v in pieces else UNKNOWN
                if taken[i]:
                    heappush(heap, (cost, place, piece, before))
                heappush(heap, (cost + w, -(i + len(v)), v, i))
        path, i = [], n
        while i:
            v, i = came[i]
            path.append(v)
        return path[::-1]

    def _finite_path(self, unit: str) -> list[str]:
        """The stack of open states along the only finite path; a place that was left without a way on isn't entered again."""
        n, pieces, stable, lexicon = len(unit), self.pieces, self.stable, self.lexicon
        path, last, i, seen, waiting = [], "", 0, {0}, []
        while i < n:
            node = lexicon
            for c in unit[i:]:
                near = node.get(c)
                if near is None:
                    break
                node = near
            rest = node[""] or (unit[i], None)  # as arcs_from
            while True:
                while rest:
                    v, rest = rest
                    if i + len(v) not in seen:
                        if v not in pieces:
                            last = ""
                            break
                        if stable(last, v):
                            last = v
                            break
                else:  # no way on: back to the state before
                    rest = waiting.pop()
                    i -= len(path.pop())
                    last = path[-1] if path and path[-1] in pieces else ""
                    continue
                break
            path.append(v)
            waiting.append(rest)
            i += len(v)
            seen.add(i)
        return path

    def ids_of(self, unit: str) -> bytes:
        out = []
        for p in self.shortest_path(unit):
            known = self.pieces.get(p)
            if known:
                out.append(known[0])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return struct.pack(f"={len(out)}I", *out)

    def encode(self, text: str) -> np.ndarray:
        units = self.units.findall(self.normaliser(text))
        if not units:
            return np.zeros(0, np.uint32)
        parts = list(map(self.new.get, units))
        if None in parts:
            for k, u in enumerate(units):
                if parts[k] is None:
                    parts[k] = self._keep(u)
        ids = np.frombuffer(b"".join(parts), np.uint32)
        if not self.bytes:  # a run of code points without a piece is one unknown
            ids = ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])]
        return ids

    def _keep(self, unit: str) -> bytes:
        """Looks in both generations of the table; a full one becomes the old one."""
        ids = self.new.get(unit) or self.old.get(unit)
        if ids is None:
            ids = self._joined(unit) or self.ids_of(unit)
        if len(unit) <= 64:
            if len(self.new) >= UNIT_CACHE:
                self.old, self.new = self.new, {}
            self.new[unit] = ids
        return ids

    def _joined(self, unit: str) -> bytes | None:
        """The paths of a unit's letters and of what follows them, if the pair where they meet is stable: then every
        neighbouring pair of the two together is, and they are the unit's path."""
        if self.bpe and (m := _LETTERS.match(unit)) and 0 < m.end() < len(unit):
            a, b = self._keep(unit[: m.end()]), self._keep(unit[m.end() :])
            u, v = (self.names[int.from_bytes(x, "little")] for x in (a[-4:], b[:4]))
            if u is None or v is None or self.stable(u, v):
                return a + b
        return None

    def forget(self) -> None:
        """Empties the tables of paths and pairs, and gives their memory back."""
        self.new, self.old = {}, {}
        self.stable.cache_clear()
        self.merges.cache_clear()
        gc.collect()

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    """The compiled model, once per process."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str | None = None, column: str = "text", decode: bool = True) -> DataFrame:
    """docs with ids array<int>, n_tokens long, round_trip boolean and, if asked for, decoded (their text again), in place of
    columns of these names."""
    path = path or default_model()
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType()), *[T.StructField("decoded", T.StringType())] * decode]
    docs = docs.drop(*[f.name for f in more])
    at = docs.columns.index(column)

    def run(batches):
        fst = load(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                rows = [t or "" for t in part.column(at).to_pylist()]
                ids = [fst.encode(t) for t in rows]
                back = [fst.decode(x) for x in ids]
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids).astype(np.int32)))
                new = [lists, pa.array(np.diff(off).astype(np.int64)), pa.array([a == b for a, b in zip(rows, back, strict=True)]), *[pa.array(back, pa.string())] * decode]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *[f.name for f in more]])
        fst.forget()  # workers stay for other stages, which need the memory

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def summary(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip, decoded_sha256 without sending the text back to Spark."""
    path = path or default_model()

    def run(batches):
        fst = load(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                rows = part.column(1).to_pylist()
                ids = [fst.encode(t) for t in rows]
                back = [fst.decode(x) for x in ids]
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids).astype(np.int32)))
                sha = [hashlib.sha256(b.encode()).hexdigest() for b in back]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off).astype(np.int64)), lists, pa.array(sha), pa.array([a == b for a, b in zip(rows, back, strict=True)])], ["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(tuned(spark).read.parquet(f"{sf_dir}/documents.parquet"))


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with their ids, number of tokens, and whether decoding gives the text back."""
    return encoded(docs, path, decode=False)
