"""Alignment of two tokenizers' tokens on the bytes that they cover.

Both tokenizers cut a space and the text into tokens.  Byte offsets where tokens of both end cut these into groups; two tokens
are linked if their byte ranges overlap.  An id pair's count is the number of documents that hold it linked.

Method.  Encoding yields the end events of both sides, packed in blocks of WINDOW bytes of a document; they are one union, are dealt by
document, sorted by document, offset and side in their partitions, and stream through a sweep.  Tokens of one side don't
overlap, so each stretch between neighbouring ends is one link, and the sweep needs to hold the open group alone (and, for
the counts, the document's distinct pairs).  The sweep takes many documents at once with numpy.

Counts are added up in workers, then by bucket, where an A id's pairs meet, so that its highest count is known.  A worker holds the
HEAD most frequent pairs (a fixed bound); what else a document asks for is joined, which changes no result.

Encoding by pieces.  Neither tokenizer has a token over the place between a character that isn't white space and a space, or between a
letter and a mark: the A side splits there before it merges, and no piece of the B side has a space behind another
character, or such a mark behind a letter (this is checked when the files are loaded; where it isn't so, there is no
cut).  So pieces that start there are encoded once and kept.

Result: one row for each row of the input.  Odd input: null and empty texts, and those whose tokens of either side don't join
to the text's bytes (U+2581 in it, say), have no tokens: zeros and ''.  A null doc_id is allowed; rows with one doc_id are
documents each; equal rows count as documents each; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Counts, merged, pack, planes, texts, tuned, unpack, unplanes, written
from ._text import buffers, slices

U64 = np.uint64
WINDOW, HEAD, BITS = 1 << 16, 2_000_000, 8
CACHE, SWEEP = 100_000, 100_000
_BINS = 8  # of counts, for each power of two
_ODD, _INVERSE = 0x9E3779B1, pow(0x9E3779B1, -1, 1 << 32)
#: Last bytes of white space characters in UTF-8, and control characters: before a space, these may belong to one token with it.
_MAY_BE_SPACE = [*range(0x21), 0x80, 0x85, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level BPE file; special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        letters = byte_letters()
        self.bytes = [b""] * t.get_vocab_size(True)
        for token, i in t.get_vocab(False).items():
            self.bytes[i] = bytes(letters[c] for c in token)
        state = json.loads(t.pre_tokenizer.__getstate__()) if t.pre_tokenizer else {}
        self.pieces = t.normalizer is None and state.get("type") == "ByteLevel" and state.get("use_regex", True) and not state.get("add_prefix_space") and all(x.special for x in t.get_added_tokens_decoder().values())
        self.whole = self.pieces and {bytes([b]) for b in range(256)} <= set(self.bytes)

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


class Pieces:
    """Side B: a SentencePiece file, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            data = f.read()
        proto, self.model = pb.ModelProto.FromString(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        kinds = pb.ModelProto.SentencePiece
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else b"" for p in proto.pieces]
        n = proto.normalizer_spec
        as_it_is = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
        self.pieces = as_it_is and not proto.trainer_spec.treat_whitespace_as_suffix and not any("▁" in p.piece.lstrip("▁") or p.type == kinds.USER_DEFINED for p in proto.pieces)
        self.whole = as_it_is and sum(p.type == kinds.BYTE for p in proto.pieces) == 256
        #: marks that no piece has behind a letter a-z
        self.marks = [c for c in ".,;:!?" if not any(x.isascii() and x.isalpha() and y == c for p in proto.pieces for x, y in zip(p.piece, p.piece[1:], strict=False))]
        self.first, self.end = len(self.model.encode("a")), self.model.encode("a ")[len(self.model.encode("a")) :]

    def encode(self, parts: list[str]) -> list[list[int]]:
        """A part starts with the space that the model puts there, or with a mark, and then it is encoded behind a letter."""
        ids = self.model.encode([p[1:] if p[0] == " " else f"a{p}" for p in parts], num_threads=1)
        return [self.end if p == " " else x if p[0] == " " else x[self.first :] for p, x in zip(parts, ids, strict=True)]


class Encoder:
    """Both sides, with the pieces seen before: their places in two arrays of ids."""

    def __init__(self, a: str, b: str):
        self.sides = ByteLevel(a), Pieces(b)
        self.lengths = [np.array([len(x) for x in s.bytes], np.int64) for s in self.sides]
        self.by_piece = all(s.pieces for s in self.sides)
        self.whole = all(s.whole for s in self.sides)
        self.may = np.zeros(256, bool)
        self.may[_MAY_BE_SPACE] = True
        self.letter, self.mark = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.mark[[ord(c) for c in self.sides[1].marks]] = True
        self.known: dict[bytes, int] = {}
        self.ok, self.used = np.zeros(0, bool), np.zeros(0, np.int64)
        self.ids = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.upto = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _forget(self) -> None:
        """Keeps the pieces seen more than once since the last time, the most frequent half of the table at most."""
        often = np.flatnonzero(self.used > 1)
        often = np.sort(often[np.argsort(-self.used[often], kind="stable")[: CACHE // 2]])
        parts = list(self.known)
        self.known = {parts[k]: i for i, k in enumerate(often.tolist())}
        self.ok, self.used = self.ok[often], np.zeros(len(often), np.int64)
        for s in (0, 1):
            start, n = self.upto[s][often], self.upto[s][often + 1] - self.upto[s][often]
            self.upto[s] = np.concatenate([[0], np.cumsum(n)])
            self.ids[s] = self.ids[s][np.repeat(start - self.upto[s][:-1], n) + np.arange(n.sum())]

    def cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of a space and each text, and the first piece of each row (n + 1 places)."""
        raw, off = buffers(column)
        n = len(off) - 1
        data = np.insert(raw, off[:-1], 0x20)
        off = off + np.arange(n + 1)
        starts = off[:-1]
        if self.by_piece and len(data):
            begins = np.zeros(len(data), bool)
            begins[starts] = True
            begins[1:] |= (data[1:] == 0x20) & ~self.may[data[:-1]] | self.mark[data[1:]] & self.letter[data[:-1]]
            starts = np.flatnonzero(begins)
        ends = np.append(starts, len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return parts, np.searchsorted(starts, off)

    def _learn(self, parts: list[bytes]) -> None:
        plain = [p.decode() for p in parts]
        ids = [s.encode(plain) for s in self.sides]
        if self.whole:  # a piece's tokens join to its bytes unless the B side takes a character for a space
            ok = [b"\xe2\x96\x81" not in p for p in parts]
        else:
            ok = [all(b"".join(map(s.bytes.__getitem__, x[k])) == p for s, x in zip(self.sides, ids, strict=True)) for k, p in enumerate(parts)]
        self.ok, self.used = np.concatenate([self.ok, ok]), np.concatenate([self.used, np.zeros(len(ok), np.int64)])
        for s, x in enumerate(ids):
            n = np.fromiter(map(len, x), np.int64, len(x))
            self.ids[s] = np.concatenate([self.ids[s], np.fromiter(chain.from_iterable(x), np.uint32, int(n.sum()))])
            self.upto[s] = np.concatenate([self.upto[s], self.upto[s][-1] + np.cumsum(n)])
        self.known.update(zip(parts, range(len(self.known), len(self.ok)), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """ok of each row; for each side all ids, and the first of each row (n + 1 places)."""
        parts, first = self.cut(column)
        coded = parts.dictionary_encode()
        own = coded.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self._forget()
        lack = [p for p in own if p not in self.known]
        if lack:
            self._learn(lack)
        place, code = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)), coded.indices.to_numpy()
        self.used[place] += np.bincount(code, minlength=len(own))
        place = place[code]
        bad = np.concatenate([[0], np.cumsum(~self.ok[place])])
        ids, at = [], []
        for s in (0, 1):
            start = self.upto[s][place]
            n = self.upto[s][place + 1] - start
            upto = np.concatenate([[0], np.cumsum(n)])
            ids.append(self.ids[s][np.repeat(start - upto[:-1], n) + np.arange(upto[-1])])
            at.append(upto[first])
        return bad[first[1:]] == bad[first[:-1]], ids, at


_loaded: dict[tuple[str, str], Encoder] = {}


def load(models: tuple[str, str]) -> Encoder:
    if models not in _loaded:
        _loaded[models] = Encoder(*models)
    return _loaded[models]


_KEYS = ["doc_id", "digest", "part"]
_EVENTS = "doc_id long, digest long, part int, block int, side int, ids binary"


def events(docs: DataFrame, models: tuple[str, str]) -> DataFrame:
    """The end events of both sides, packed: a row for each document, WINDOW of its bytes, and side. A token's end follows from the
    ids before it. digest and part (the input's partition) tell apart rows with one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = load(models), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ok, ids, at = encoder.encode(part.column(1))
                size = np.diff(buffers(part.column(1))[1])
                ok &= size > 0
                rows, block, side, data = [], [], [], []
                ends = [np.cumsum(encoder.lengths[s][ids[s]]) for s in (0, 1)]
                for r in range(part.num_rows):
                    for s in (0, 1):
                        a, b = at[s][r : r + 2] if ok[r] else (0, 0)
                        cuts = [a, b]
                        if size[r] >= WINDOW and b > a:
                            e = ends[s][a:b] - (ends[s][a - 1] if a else 0)
                            cuts = [a, *(a + np.searchsorted(e, np.arange(WINDOW, int(e[-1]), WINDOW), "right")), b]
                        for k in range(len(cuts) - 1):
                            rows.append(r)
                            block.append(k)
                            side.append(s)
                            x = ids[s][cuts[k] : cuts[k + 1]]
                            data.append(_packed(x, squeeze))
                own = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3), pa.array(block, pa.int32()), pa.array(side, pa.int32()), pa.array(data, pa.binary())], [*_KEYS, "block", "side", "ids"])

    return texts(docs).select("doc_id", "text", F.xxhash64("text").alias("digest"), F.spark_partition_id().alias("part")).mapInArrow(run, _EVENTS)


def _packed(ids: np.ndarray, tool: zstandard.ZstdCompressor) -> bytes:
    """Byte planes, two or four of them, as the first byte says."""
    kind = np.uint32 if len(ids) and ids.max() >= 1 << 16 else np.uint16
    return bytes([np.dtype(kind).itemsize]) + tool.compress(planes(ids.astype(kind)))


def _unpacked(data: bytes, tool: zstandard.ZstdDecompressor) -> np.ndarray:
    return unplanes(tool.decompress(data[1:]), np.uint16 if data[0] == 2 else np.uint32).astype(np.uint32)


class Document:
    """What the sweep holds of a document: tokens of the open group, sums, and its distinct pairs."""

    def __init__(self, key: tuple):
        self.key, self.copies, self.last = key, 0, None
        self.held: tuple[list, list] = ([], [])
        self.size = 0
        self.sums = np.zeros(4, np.int64)
        self.text, self.pairs, self.times = None, np.zeros(0, U64), np.zeros(0, np.int64)

    def take(self, side: int, ids: np.ndarray) -> None:
        self.held[side].append(ids)
        self.size += len(ids)


class Sweep:
    """Merges the end events of documents, which come in order."""

    def __init__(self, lengths: list[np.ndarray]):
        self.lengths, self.nb = lengths, U64(len(lengths[1]))
        most = max(map(len, lengths))
        self.width = len(str(most)) + 1
        number = np.arange(most)
        self.digits = np.ones(most, np.int64)
        for p in range(1, self.width):
            self.digits += number >= 10**p
        self.letters = np.zeros((most, self.width), np.uint8)
        for p in range(self.width):
            here = self.digits > p
            self.letters[here, p] = 48 + number[here] // 10 ** (self.digits[here] - 1 - p) % 10

    def closed(self, doc: Document) -> tuple[np.ndarray, np.ndarray]:
        """The tokens up to the last common end, which go; the others stay."""
        ids = [np.concatenate(h) if h else np.zeros(0, np.uint32) for h in doc.held]
        ends = [np.cumsum(n[x]) for n, x in zip(self.lengths, ids, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        last = common[-1] if len(common) else 0
        at = [int(np.searchsorted(e, last, "right")) for e in ends]
        rest = [x[k:] for x, k in zip(ids, at, strict=True)]
        doc.held, doc.size = ([rest[0]], [rest[1]]), sum(map(len, rest))
        return ids[0][: at[0]], ids[1][: at[1]]

    def run(self, docs: list[Document], tokens: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """tokens: for each document whole groups, both sides of the same length in bytes."""
        a, b = (np.concatenate([t[s] for t in tokens]) for s in (0, 1))
        if not len(a):
            return
        ea, eb = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        na, nb = (np.cumsum([len(t[s]) for t in tokens]) for s in (0, 1))
        edge = np.concatenate([[0], ea])[na]
        is_a, is_b = np.zeros(ea[-1] + 1, bool), np.zeros(ea[-1] + 1, bool)
        is_a[ea], is_b[eb] = True, True
        ends = np.flatnonzero(is_a | is_b)
        in_a, in_b = is_a[ends], is_b[ends]
        pair = a[np.cumsum(in_a) - in_a].astype(U64) * self.nb + b[np.cumsum(in_b) - in_b]
        upto = np.searchsorted(ends, edge, "right")
        n_links = np.diff(upto, prepend=0)
        groups = np.diff(np.concatenate([[0], np.cumsum(in_a & in_b)])[upto], prepend=0)
        # a link's document and pair in one number
        both = np.sort(np.repeat(np.arange(len(docs), dtype=U64), n_links) << U64(40) | pair)
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        times, both = np.diff(np.append(at, len(both))), both[at]
        of = np.searchsorted(both, np.arange(len(docs) + 1, dtype=U64) << U64(40))
        # tokens in the order of their groups, A before B
        close_a, close_b = is_b[ea], is_a[eb]
        first_a, first_b = (np.concatenate([[0], np.flatnonzero(c) + 1]) for c in (close_a, close_b))
        place_a = np.arange(len(a)) + first_b[np.cumsum(close_a) - close_a]
        place_b = np.arange(len(b)) + first_a[np.cumsum(close_b) - close_b + 1]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a], mark[place_b] = np.where(close_a, 124, 44), np.where(close_b, 59, 44)
        digits = self.digits[ids]
        letters = self.letters[ids]
        letters[np.arange(len(ids)), digits] = mark
        text = letters[np.arange(self.width) <= digits[:, None]].tobytes()
        stop = np.concatenate([[0], np.cumsum(digits + 1)])[na + nb]
        start = 0
        sums = np.stack([np.diff(na, prepend=0), np.diff(nb, prepend=0), groups, n_links], 1)
        for k, doc in enumerate(docs):
            doc.sums += sums[k]
            if doc.text is None:
                doc.text = hashlib.sha256(text[start : max(start, stop[k] - 1)])
            elif stop[k] > start:
                doc.text.update(b";" + text[start : stop[k] - 1])
            start = stop[k]
            new, n = both[of[k] : of[k + 1]] & U64((1 << 40) - 1), times[of[k] : of[k + 1]]
            if len(doc.pairs):
                new, where = np.unique(np.concatenate([doc.pairs, new]), return_inverse=True)
                n = np.bincount(where, np.concatenate([doc.times, n])).astype(np.int64)
            doc.pairs, doc.times = new, n


_SWEPT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def swept(found: DataFrame, lengths: list[np.ndarray], parts: int | None = None) -> DataFrame:
    """A row for each document of events: its sums, the digest of its groups, and its distinct pairs with their times, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, tool, squeeze = Sweep(lengths), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        ready: list[Document] = []
        size, doc = 0, None

        def rows() -> pa.RecordBatch:
            sweep.run(ready, [sweep.closed(d) for d in ready])
            out = []
            for d in ready:
                packed = squeeze.compress(planes(np.diff(d.pairs, prepend=U64(0))) + planes(d.times.astype(np.uint32)))
                out += [(d.key[1], *d.sums.tolist(), d.text.hexdigest() if d.sums.any() else "", packed)] * d.copies
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            names = [c.split()[0] for c in _SWEPT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            null = batch.column(0).is_null().to_pylist()
            columns = [null, *(c.to_pylist() for c in batch.columns)]
            for *key, block, side, ids in zip(*columns, strict=True):
                if doc is None or tuple(key) != doc.key:
                    if doc is not None:
                        ready.append(doc)
                        size += doc.size
                        if size > SWEEP:
                            yield rows()
                            ready, size = [], 0
                    doc = Document(tuple(key))
                if (block, side) == (0, 0):
                    doc.copies += 1
                if (block, side) != doc.last:
                    doc.last = block, side
                    doc.take(side, _unpacked(ids, tool))
                    if side and doc.size > SWEEP:
                        sweep.run([doc], [sweep.closed(doc)])
        if doc is not None:
            ready.append(doc)
        if ready:
            yield rows()

    dealt = found.repartition(parts, *_KEYS) if parts else found.repartition(*_KEYS)
    return dealt.sortWithinPartitions(*_KEYS, "block", "side").mapInArrow(run, _SWEPT)


def pairs_of(data: bytes, tool: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and their times."""
    raw = tool.decompress(data)
    n = len(raw) // 12
    return np.cumsum(unplanes(raw[: 8 * n], U64), dtype=U64), unplanes(raw[8 * n :], np.uint32).astype(np.int64)


def counted(documents: DataFrame, nb: int) -> DataFrame:
    """bucket, keys, counts, best: how many documents hold each pair, and whether no pair of its A id has more, packed. A key's upper
    half is the A id times an odd number, so that the pairs of an A id share a bucket, and the lower half the B id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tool = Counts(BITS, 3_000_000), zstandard.ZstdDecompressor()
        waiting, size = [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                waiting.append(pairs_of(data, tool)[0])
                size += len(waiting[-1])
                if size > 500_000:
                    yield from held.add(0, _spread(np.concatenate(waiting), nb))
                    waiting, size = [], 0
        if waiting:
            yield from held.add(0, _spread(np.concatenate(waiting), nb))
        yield from held.flush()

    def add(table: pa.Table) -> pa.Table:
        keys, counts = merged(table)
        owner = keys >> U64(32)
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = counts == np.repeat(np.maximum.reduceat(counts, start), np.diff(np.append(start, len(keys))))
        return pa.table({"bucket": table["bucket"][:1], "keys": [pack(keys)], "counts": [pack(counts)], "best": [pack(best.astype(np.uint8))]})

    parts = documents.select("pairs").mapInArrow(count, Counts.ddl)
    return parts.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(add, "bucket int, keys binary, counts binary, best binary")


def _spread(pairs: np.ndarray, nb: int) -> np.ndarray:
    return (pairs // U64(nb) * U64(_ODD) & U64(0xFFFFFFFF)) << U64(32) | pairs % U64(nb)


def _gathered(keys: np.ndarray, nb: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(_INVERSE) & U64(0xFFFFFFFF)) * U64(nb) + (keys & U64(0xFFFFFFFF))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k, c, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield unpack(k, U64), unpack(c, np.int64), unpack(b, np.uint8)


def head(table: DataFrame, nb: int, most: int) -> tuple[int, bytes]:
    """The least count of which all pairs are among the `most` most frequent, and those pairs, packed; and how many others there are."""

    def bins(batches):
        n = np.zeros(64 * _BINS, np.int64)
        for _, c, _ in _each(batches):
            n += np.bincount((np.log2(c) * _BINS).astype(np.int64), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["bin", "n"])

    told = {r.bin: r.n for r in table.select("keys", "counts", "best").mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    total, least = 0, 1 + max(told, default=0)
    for b in sorted(told, reverse=True):
        total += told[b]
        if total > most:
            break
        least = b
    others = sum(n for b, n in told.items() if b < least)

    def upper(batches):
        for k, c, b in _each(batches):
            take = (np.log2(c) * _BINS).astype(np.int64) >= least
            yield pa.RecordBatch.from_arrays([pa.array([pack(_gathered(k[take], nb))]), pa.array([pack(c[take])]), pa.array([pack(b[take])])], ["keys", "counts", "best"])

    rows = table.select("keys", "counts", "best").mapInArrow(upper, "keys binary, counts binary, best binary").toArrow()
    k, c, b = (np.concatenate([unpack(x, kind) for x in rows[name].to_pylist()] or [np.zeros(0, kind)]) for name, kind in (("keys", U64), ("counts", np.int64), ("best", np.uint8)))
    order = np.argsort(k)
    return least, others, (pack(k[order]), pack(c[order]), pack(b[order]))


_held: dict[str, tuple] = {}


def looked_up(documents: DataFrame, table: DataFrame, nb: int, most: int = HEAD) -> DataFrame:
    """documents with n_best and count_sum in place of pairs."""
    spark = documents.sparkSession
    least, others, packed = head(table, nb, most)
    shared = spark.sparkContext.broadcast(packed)
    tag = f"{spark.sparkContext.applicationId}-{id(shared)}-{os.urandom(8).hex()}"

    def look(batches):
        if tag not in _held:
            _held.clear()
            _held[tag] = tuple(unpack(x, kind) for x, kind in zip(shared.value, (U64, np.int64, np.uint8), strict=True))
        keys, counts, best = _held[tag]
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            n_best, total, rest, rest_times, off = [], [], [], [], [0]
            for data in batch.column(batch.num_columns - 1).to_pylist():
                pair, times = pairs_of(data, tool)
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                n_best.append(int((times[hit] * best[at[hit]]).sum()))
                total.append(int((times[hit] * counts[at[hit]]).sum()))
                rest.append(pair[~hit])
                rest_times.append(times[~hit])
                off.append(off[-1] + len(rest[-1]))
            off = pa.array(off, pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x).astype(np.int64))) for x in (rest, rest_times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), *lists], [*batch.schema.names[:-1], "n_best", "count_sum", "rest", "times"])

    out = documents.mapInArrow(look, _SWEPT.removesuffix("pairs binary") + "n_best long, count_sum long, rest array<long>, times array<long>")
    if not others:
        return out.drop("rest", "times")

    def lower(batches):
        for k, c, b in _each(batches):
            take = (np.log2(c) * _BINS).astype(np.int64) < least
            yield pa.RecordBatch.from_arrays([pa.array(_gathered(k[take], nb).astype(np.int64)), pa.array(c[take]), pa.array(b[take].astype(np.int64))], ["pair", "count", "best"])

    out = written(out.withColumn("row", F.monotonically_increasing_id()), "looked")
    asked = out.select("row", F.explode(F.arrays_zip("rest", "times")).alias("e")).select("row", F.col("e.rest").alias("pair"), F.col("e.times").alias("times"))
    answers = asked.join(table.select("keys", "counts", "best").mapInArrow(lower, "pair long, count long, best long"), "pair")
    answers = answers.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more"))
    out = out.join(answers, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return out.drop("row", "rest", "times", "more_best", "more")


def aligned(docs: DataFrame, models: tuple[str, str] | None = None, most: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    models = models or default_models()
    tuned(docs.sparkSession)
    lengths = [n.astype(np.int64) for n in load(models).lengths]
    documents = written(swept(events(docs, models), lengths), "swept")
    table = written(counted(documents, len(lengths[1])), "pairs")
    return looked_up(documents, table, len(lengths[1]), most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
