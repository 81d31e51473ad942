"""Token ids in wavelet matrices: one compressed file a shard with access, counting and occurrence lookup.

File format, little endian: ``WMX1``, uint32 length of the JSON header, header, body.  The header names each array's
place in the body.  The ids of a shard lie in one bit plane for each bit of the largest id, highest first; a plane is cut
into blocks of ``BLOCK`` bits, each a zstandard frame, with the number of ones before it (the rank directory), so a
lookup inflates one block a plane.  Further arrays: the documents' ids and the ends of their tokens.

How it scales: encoding is a map; the one shuffle deals encoded documents to ranges of doc_id, whose bounds are quantiles
taken before; a task sorts its range and streams it into files of about ``SHARD`` tokens, one in memory at a time.  A file is written under a name of its own and then
renamed, so a task that runs twice leaves one whole file.  Readers take files through Spark's binaryFile source.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_text
from .token_counts import tokenizer

BLOCK = 1 << 18
STEP = 1 << 15
SHARD = 2_000_000
RANGE_ROWS = 2_000
SAMPLE = 400_000  # doc_ids, of which the ranges are told
MOST_RANGES = 20_000
CACHE = 1_500_000
MAGIC = b"WMX1"


class WaveletMatrix:
    """A wavelet matrix over token ids, with the documents that they belong to."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack_from("<I", data, 4)
        self.head = json.loads(data[8 : 8 + size])
        self.body = memoryview(data)[8 + size :]
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        self.inflate = zstandard.ZstdDecompressor()
        self.ones_before = self._array("ranks", np.int64).reshape(self.bits, -1)
        self.frames = self._array("frames", np.int64)
        self.doc_ids = self._array("doc_ids", np.int64)
        self.doc_null = self._array("doc_null", np.uint8)
        self.ends = self._array("ends", np.int64)
        self._held: dict[int, np.ndarray] = {}

    def _array(self, name: str, kind) -> np.ndarray:
        at, size = self.head[name]
        return np.frombuffer(self.inflate.decompress(bytes(self.body[at : at + size])), kind)

    @staticmethod
    def build(ids: np.ndarray, doc_ids: list, ends: np.ndarray, extra: dict | None = None) -> bytes:
        """The file's bytes.  ids: of all documents, one after another; ends: where each document's ids end."""
        ids = np.asarray(ids)
        bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        pack = zstandard.ZstdCompressor(level=1)
        n_blocks = -(-len(ids) // BLOCK)
        planes, frames, ranks, zeros = [], [0], np.zeros((bits, n_blocks + 1), np.int64), []
        for level in range(bits):
            plane = (now & now.dtype.type(1 << (bits - 1 - level))).astype(bool)
            packed = np.packbits(plane)
            for b in range(n_blocks):
                part = packed[b * BLOCK // 8 : (b + 1) * BLOCK // 8]
                ranks[level, b + 1] = ranks[level, b] + int(np.bitwise_count(part).sum())
                planes.append(pack.compress(part.tobytes()))
                frames.append(frames[-1] + len(planes[-1]))
            zeros.append(len(now) - int(ranks[level, -1]))
            cuts = range(0, len(now), STEP)  # steps that stay in a core's cache
            now = np.concatenate([now[a : a + STEP].compress(bits_of[a : a + STEP]) for bits_of in (~plane, plane) for a in cuts] or [now])
        nulls = np.array([d is None for d in doc_ids], np.uint8)
        arrays = {
            "ranks": ranks, "frames": np.array(frames, np.int64), "ends": np.asarray(ends, np.int64),
            "doc_ids": np.array([0 if d is None else d for d in doc_ids], np.int64), "doc_null": nulls,
        }
        body, head = b"".join(planes), {"n": len(ids), "bits": bits, "zeros": zeros} | (extra or {})
        for name, a in arrays.items():
            part = pack.compress(a.tobytes())
            head[name] = [len(body), len(part)]
            body += part
        top = json.dumps(head).encode()
        return MAGIC + struct.pack("<I", len(top)) + top + body

    def _block(self, level: int, b: int) -> np.ndarray:
        """A block's bytes; the last ones stay inflated."""
        k = level * (self.ones_before.shape[1] - 1) + b
        if k not in self._held:
            if len(self._held) >= 64:
                self._held.pop(next(iter(self._held)))
            raw = self.inflate.decompress(bytes(self.body[self.frames[k] : self.frames[k + 1]]))
            self._held[k] = np.frombuffer(raw, np.uint8)
        return self._held[k]

    def _bit(self, level: int, i: int) -> int:
        b, r = divmod(i, BLOCK)
        return int(self._block(level, b)[r >> 3]) >> (7 - (r & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        b, r = divmod(i, BLOCK)
        ones = int(self.ones_before[level, b])
        if r:
            part = self._block(level, b)
            ones += int(np.bitwise_count(part[: r >> 3]).sum())
            if r & 7:
                ones += (int(part[r >> 3]) >> (8 - (r & 7))).bit_count()
        return ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane."""
        before = self.ones_before[level]
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        b = int(np.searchsorted(before, k, side="right")) - 1
        flags = np.unpackbits(self._block(level, b))[: min(BLOCK, self.n - b * BLOCK)]
        return b * BLOCK + int(np.flatnonzero(flags == bit)[k - int(before[b])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _walk(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, low), self._rank1(level, high)
            one = token >> (self.bits - 1 - level) & 1
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if one else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often the id stands in positions low to high - 1."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._walk(token, max(0, low), self.n if high is None else min(high, self.n))
        return max(0, b - a)

    rank = count

    def select(self, token: int, k: int) -> int:
        """Position of the id's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._walk(token, 0, self.n)[0] + k
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def occurrences(self, token: int) -> Iterator[int]:
        return (self.select(token, k) for k in range(self.count(token)))

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        n_blocks = self.ones_before.shape[1] - 1
        for level in reversed(range(self.bits)):
            raw = b"".join(self.inflate.decompress(bytes(self.body[self.frames[k] : self.frames[k + 1]])) for k in range(level * n_blocks, (level + 1) * n_blocks))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            before, zero, one = np.empty(self.n, kind), 0, self.zeros[level]
            now[one:] |= kind(1 << (self.bits - 1 - level))
            for a in range(0, self.n, STEP):
                part, out = ones[a : a + STEP], before[a : a + STEP]
                high = np.flatnonzero(part)
                low = np.flatnonzero(~part)
                out[low] = now[zero : zero + len(low)]
                out[high] = now[one : one + len(high)]
                zero, one = zero + len(low), one + len(high)
            now = before
        return now

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first position, ids) of each document."""
        ids, at = self.decode(), 0
        for d, null, end in zip(self.doc_ids.tolist(), self.doc_null.tolist(), self.ends.tolist(), strict=True):
            yield (None if null else d), at, ids[at:end]
            at = end


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees a piece again only when CACHE others have made it forgotten.

    A text is cut before single spaces, around single line ends, and before commas and full stops that follow a letter or
    digit and precede white space.  A byte-level tokenizer's own pattern never crosses such a place, so the pieces' ids,
    joined, are the text's.  Where that is not certain, pieces are cut at spaces alone (no two together), or the library
    gets the text whole.  Cutting and telling pieces apart is Arrow's work, joining numpy's.
    """

    #: White space other than space and line end, the cutting mark, marks or spaces side by side.
    odd = "[\\x01\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]|[.,][.,]|  "
    #: Letters, with a space in front or not, and ASCII marks behind (no apostrophe): for the tokenizer's pattern too they
    #: are one piece or two, so its merges can be asked directly.
    word = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.model, byte_level = self.tok.model, self.tok.normalizer is None and "use_regex=True" in str(self.tok.pre_tokenizer)
        if not byte_level:
            raise ValueError("only a byte-level tokenizer's texts can be cut")
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self._forget()

    def _forget(self) -> None:
        """Pieces are known by 128 bits of hash, not by text: three numbers each, and the ids."""
        none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.levels = [none, none]  # sorted by the first hash: all but the newest, the newest
        self.tokens, self.stops, self.doubt = array(self.kind.char), array("q", [0]), bytearray()
        self.marks: dict[str, array] = {}  # ids of the marks behind a word, printable ASCII

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, piece: str) -> int:
        if piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            self.tokens.extend([t.id for t in self.model.tokenize(piece.replace(" ", "Ġ"))])
            self.doubt.append(False)
        else:
            simple = self.word.fullmatch(piece)
            if simple:
                word, marks = simple.groups()
                shown = word.replace(" ", "Ġ") if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
                self.tokens.extend([t.id for t in self.model.tokenize(shown)])
                if marks:
                    known = self.marks.get(marks)
                    if known is None:
                        known = self.marks[marks] = array(self.kind.char, [t.id for t in self.model.tokenize(marks)])
                    self.tokens.extend(known)
            elif piece:
                self.tokens.extend(self.tok.encode(piece, add_special_tokens=False).ids)
            # beside a fine cut there must be a mark alone, or a letter or digit
            self.doubt.append(piece not in (".", ",", "\n") and (piece in ("", " ") or piece[0] in ".," or not piece[-1].isalnum()))
        self.stops.append(len(self.tokens))
        return len(self.doubt) - 1

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where each piece's ids stand."""
        if len(self.doubt) > CACHE:
            self._forget()
        texts = np.array(pieces, object)
        one, two = (pd.util.hash_array(texts, hash_key=k, categorize=False) for k in ("pieces of texts.", "and once more..."))
        order = np.argsort(one)  # lookups in order stay in the cache
        asked, check, place = one[order], two[order], np.full(len(pieces), -1, np.int64)
        for known, known_check, at in self.levels:
            if len(known):
                i = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                hit = (known[i] == asked) & (known_check[i] == check)
                place[hit] = at[i[hit]]
        new = np.flatnonzero(place < 0)
        place[new] = [self._learn(pieces[i]) for i in order[new].tolist()]
        self._remember(asked[new], check[new], place[new])
        out = np.empty(len(pieces), np.int64)
        out[order] = place
        return out

    def _remember(self, *new: np.ndarray) -> None:
        old, recent = self.levels
        recent = self._merged(recent, new)
        if len(recent[0]) > 1 << 17:
            old, recent = self._merged(old, recent), tuple(x[:0] for x in recent)
        self.levels = [old, recent]

    @staticmethod
    def _merged(a, b):
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def _cut(self, texts: pa.Array, fine: bool) -> list[np.ndarray | None]:
        """The ids of each text, None where fine cuts are uncertain."""
        if not len(texts):
            return []
        for c in (".", ",") if fine else ():
            texts = pc.replace_substring(texts, c, "\x01" + c)
        if fine:
            texts = pc.replace_substring(texts, "\n", "\x01\n\x01")
        lists = pc.split_pattern(pc.replace_substring(texts, " ", "\x01 "), "\x01")
        told = lists.flatten().dictionary_encode()
        pieces, codes = told.dictionary.to_pylist(), told.indices.to_numpy()
        place = self._places(pieces)
        known = pa.LargeListArray.from_arrays(pa.array(np.frombuffer(self.stops, np.int64)), pa.array(np.frombuffer(self.tokens, self.kind)))
        doubt = np.frombuffer(self.doubt, np.uint8)[place].astype(bool)
        joined = known.take(pa.array(place)).take(told.indices)
        ids, ends = joined.values.to_numpy(), joined.offsets.to_numpy()
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        unsure = np.logical_or.reduceat(doubt[codes], cuts[:-1]).tolist() if fine else [False] * len(texts)
        at = ends[cuts].tolist()
        del known  # a view; the arrays grow again
        return [None if u else ids[a:b] for u, a, b in zip(unsure, at, at[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        out: list[np.ndarray | None] = [None] * len(texts)
        odd = pc.match_substring_regex(texts, self.odd)
        fine = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        for i, x in zip(fine.tolist(), self._cut(texts.take(pa.array(fine)), True), strict=True):
            out[i] = x
        rest = np.array([i for i, x in enumerate(out) if x is None], np.int64)
        double = pc.match_substring_regex(texts.take(pa.array(rest)), "  |\\x01").to_numpy(zero_copy_only=False)
        for i in rest[double].tolist():
            out[i] = self.whole(texts[i].as_py())
        for i, x in zip(rest[~double].tolist(), self._cut(texts.take(pa.array(rest[~double])), False), strict=True):
            out[i] = x
        return out


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    return _encoders.get(path) or _encoders.setdefault(path, PieceEncoder(path))


def write_tokens(docs: DataFrame, path: str, scratch: Scratch, end_id: int = 0, shard: int = SHARD) -> tuple[str, DataFrame]:
    """Writes the ids of ``docs(doc_id, text)`` in ascending doc_id order (nulls first, equal ids by text) and returns the
    folder and (task, part, n): each file and its tokens.  A null text is empty; every document ends in end_id.  An empty table gives a folder without files."""
    from pyarrow import fs

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    # ranges of doc_id of about as many rows, by a bounded sample; a task cuts its range into shards by tokens.  Results do not
    # depend on the sample
    count = rows.count()
    ranges = max(1, min(MOST_RANGES, -(-count // RANGE_ROWS)))
    seen = [r.doc_id for r in rows.select("doc_id").sample(min(1.0, SAMPLE / count), seed=1).where("doc_id is not null").collect()] if ranges > 1 else []
    seen = np.sort(np.array(seen, np.int64))
    bounds = np.unique(seen[(np.arange(1, ranges) * len(seen)) // ranges]) if len(seen) else seen

    def encode():
        enc = _encoder(path)
        end = np.array([end_id], enc.kind)

        def run(texts, doc_ids):
            ids = [np.concatenate([x, end]).tobytes() for x in enc.encode(texts)]
            return [bounds.searchsorted(pc.fill_null(doc_ids, -(1 << 63)).to_numpy(zero_copy_only=False)).astype(np.int32), ids]

        return run

    encoded = map_text(rows, encode, "range int, ids binary", chars=4_000_000, arrow_texts=True, given=("doc_id",))
    folder = scratch.path("tokens")
    where = scratch.uri(folder)
    out, inside = fs.FileSystem.from_uri(where)
    out.create_dir(inside, recursive=True)

    def write(frames):
        from pyspark import TaskContext

        out, inside = fs.FileSystem.from_uri(where)
        kind, task, part = _encoder(path).kind, TaskContext.get().partitionId(), 0
        ids, doc_ids, ends, size = [], [], [], 0

        def close():
            data = WaveletMatrix.build(np.frombuffer(b"".join(ids), kind), doc_ids, np.array(ends), {"task": task, "part": part})
            name = f"{inside}/{task:07d}-{part:05d}.wmx"
            own = f"{inside}/.{task}-{part}-{uuid.uuid4().hex}"
            with out.open_output_stream(own) as s:
                s.write(data)
            out.move(own, name)

        for f in frames:
            for d, x in zip(f["doc_id"].tolist(), f["ids"].tolist(), strict=True):
                ids.append(x)
                size += len(x) // kind.itemsize
                doc_ids.append(None if pd.isna(d) else int(d))
                ends.append(size)
                if size >= shard:
                    close()
                    yield pd.DataFrame({"task": [task], "part": [part], "n": [size]})
                    part, ids, doc_ids, ends, size = part + 1, [], [], [], 0
        if ids:
            close()
            yield pd.DataFrame({"task": [task], "part": [part], "n": [size]})

    ordered = encoded.repartitionById(len(bounds) + 1, "range").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return folder, scratch.table(ordered.mapInPandas(write, "task int, part int, n long"), "files")


def read_tokens(folder: str, made: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a folder; ``made`` as from write_tokens."""
    spark = made.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wmx").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def read(frames):
        for f in frames:
            for data in f["content"]:
                m = WaveletMatrix(data)
                rows = [(d, at, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, at, x in m.documents()]
                out = pd.DataFrame(rows, columns=["doc_id", "at", "n_tokens", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out.assign(task=m.head["task"], part=m.head["part"])

    # one number a task of the writer, then one a file
    tasks = made.groupBy("task").agg(F.sum("n").alias("n"))
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("task_base"))
    base = made.select("task", "part", F.coalesce(F.sum("n").over(Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_base")).join(tasks, "task")
    rows = files.select("content").mapInPandas(read, "doc_id long, at long, n_tokens long, ids_crc32 long, task int, part int")
    return rows.join(base, ["task", "part"]).select(
        "doc_id", (F.col("task_base") + F.col("part_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
