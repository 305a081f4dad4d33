"""Token files: ids of many documents in independent zstandard frames with a trailing seek table.

A file is (1) frames that hold the ids, as little-endian unsigned 32-bit integers, of the file's documents one after
another, cut every FRAME_IDS ids; (2) a skippable frame with the directory: for each document its doc_id and its first id's
place in the file; (3) a skippable frame with the seek table of the public zstandard seekable format: for each frame its
compressed size, its size and the low 32 bits of the xxh64 of its content. Any zstandard reader can unpack the ids; a
reader of ours unpacks only the frames that a document touches, and checks them.

Files are numbered in ascending order of doc_id. They are written under a temporary name and then renamed, so a task that
is run again leaves the same file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, give_back, remove_hidden, small_batches

# Fixed values of the zstandard format and of its seekable extension.
SKIPPABLE_DIRECTORY = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1 << 17
END_ID = 0
#: Texts encoded at once: memory follows this, not the batch.
ENCODE_CHARS = 1 << 20


#: Memory of the ids that a worker process keeps, from task to task, of parts it has met. PART_BYTES is what a part takes
#: besides its letters and ids. Where KEPT_BYTES are full, parts that have not been asked for of late go.
KEPT_BYTES, PART_BYTES = 256 << 20, 200
#: Marks that are neither letters, digits, spaces nor the start of a contraction.
_MARKS = ".,;:!?|#$%&*"


class _Parts(dict):
    """The ids of parts, which are found when they are first asked for, or when they were asked for of old."""

    def __init__(self, find: Callable[[str], bytes], older: dict | None = None):
        self.find, self.size, self.older = find, 0, older or {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.find(part)
        self[part] = ids
        self.size += PART_BYTES + len(part) + len(ids or b"")
        return ids

    def renewed(self, most: int) -> _Parts:
        """Itself, or when it holds most bytes a new one, to which it is the older one; what only its own older one had goes."""
        if self.size <= most:
            return self
        self.older = {}
        return _Parts(self.find, self)


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers, from a tokenizers file.

    A byte-level tokenizer that does nothing else to a text splits it into pieces, of which a space is only the beginning:
    no piece goes from a letter, digit or mark over white space, and the only look ahead, after white space, sees the same at
    a single space or line feed. So where neither stands beside other white space (Python's, which includes all of
    Unicode's), a text has the ids of its parts, cut before each. A part of letters and marks is the two pieces the
    tokenizer makes of it, which the library's model encodes; other parts are encoded by the whole tokenizer. All other
    tokenizers and texts are encoded as a whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        self.encode, self.pieces = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch), tokenizer.model.tokenize
        own = json.loads(tokenizer.to_str())
        split = own.get("pre_tokenizer") or {}
        added = [x["content"] for x in own.get("added_tokens") or []]
        self.by_piece = not own.get("normalizer") and own["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not any(" " in x or "\n" in x or x.rstrip(_MARKS).isalpha() or not x.rstrip(_MARKS) for x in added)
        self.by_piece &= not any(x.get(k) for x in own.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word"))
        # The byte-level alphabet: bytes that print stand for themselves, the others for letters from U+0100.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.space = self.alphabet[32]
        self.packed = [struct.pack("<I", i) for i in range(max(tokenizer.get_vocab().values()) + 1)]
        self.marks = _Parts(self._piece)
        self.first = _Parts(lambda part: self._part("", part))
        self.rest = _Parts(self._later)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.encode(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        packed = self.packed
        return b"".join([packed[x.id] for x in self.pieces(piece.encode().decode("latin-1").translate(self.alphabet))])

    def _part(self, front: str, part: str) -> bytes | None:
        stem = part.rstrip(_MARKS)
        # These are letters in every version of Unicode.
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):
            if len(stem) == len(part):
                return self._piece(front + stem)
            return (self.rest[stem] if front == " " else self._piece(front + stem)) + self.marks[part[len(stem) :]]
        if part and (part[0].isspace() or part[-1].isspace()):
            return None
        return self.whole([front + part])[0]

    def _later(self, part: str) -> bytes | None:
        """The ids of a part with the space or line feed before it; none where that stands beside white space."""
        if part.isalpha() and part.isascii():  # most are: what _part does, without the detours
            packed = self.packed
            return b"".join([packed[x.id] for x in self.pieces(self.space + part)])
        if part[:1] != "\n":
            return self._part(" ", part) if part else None
        ids = self._part("", part[1:]) if len(part) > 1 else None
        return None if ids is None else self.marks["\n"] + ids

    def one(self, text: str) -> bytes:
        # Each has two generations. A text's own parts come on top.
        self.marks, self.first, self.rest = self.marks.renewed(KEPT_BYTES // 16), self.first.renewed(KEPT_BYTES // 16), self.rest.renewed(KEPT_BYTES * 3 // 8)
        # The lines of a text are parts too, unless some are empty or begin or end with white space. Then they stay whole,
        # unless one ends with a space: a part with a line feed in front would be taken for a line.
        for parted in (text.replace("\n", " \n"), text)[: 1 + ("\n" in text and " \n" not in text)]:
            start, *more = parted.split(" ")
            try:
                return b"".join([self.first[start], *map(self.rest.__getitem__, more)])
            except TypeError:  # a part without ids of its own
                pass
        return self.whole([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts] if self.by_piece else self.whole(texts)


class TokenFileWriter:
    """Appends documents to a binary stream; finish() adds the directory and the seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.null_ids: list[int] = []
        self.places: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if doc_id is None:
            self.null_ids.append(len(self.doc_ids))
        self.doc_ids.append(doc_id or 0)
        self.places.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= FRAME_IDS:
            ids = np.concatenate(self.held)
            whole = len(ids) // FRAME_IDS * FRAME_IDS
            for at in range(0, whole, FRAME_IDS):
                self._frame(ids[at : at + FRAME_IDS])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def finish(self) -> None:
        if self.n_held:
            self._frame(np.concatenate(self.held))
        body = struct.pack("<QQQ", len(self.doc_ids), len(self.null_ids), self.n_ids)
        body += np.array(self.doc_ids, "<i8").tobytes() + np.array(self.null_ids, "<u8").tobytes() + np.array(self.places, "<u8").tobytes()
        body = self.pack.compress(body)
        self.out.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(body)) + body)
        body = b"".join(struct.pack("<III", *x) for x in self.frames)
        body += struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(body)) + body)


class TokenFileReader:
    """Random access to the documents of a seekable binary file; raises ValueError on a frame that fails its checksum."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(end - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.sums = table[:, 0], table[:, 2]
        self.packed_at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.ids_at = np.concatenate([[0], np.cumsum(table[:, 1])]) // 4
        at = int(self.packed_at[-1])
        magic, size = struct.unpack("<II", self._at(at, 8))
        if magic != SKIPPABLE_DIRECTORY:
            raise ValueError("no directory after the frames")
        self.unpack = zstandard.ZstdDecompressor()
        body = self.unpack.decompress(self._at(at + 8, size))
        n, nulls, self.n_ids = struct.unpack_from("<QQQ", body)
        self.doc_ids = np.frombuffer(body, "<i8", n, 24)
        self.nulls = set(np.frombuffer(body, "<u8", nulls, 24 + 8 * n).tolist())
        self.places = np.append(np.frombuffer(body, "<u8", n, 24 + 8 * (n + nulls)), self.n_ids).astype(np.int64)
        self.kept = (-1, np.empty(0, np.uint32))

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            raw = self.unpack.decompress(self._at(int(self.packed_at[k]), int(self.sizes[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self.kept = k, np.frombuffer(raw, "<u4")
        return self.kept[1]

    def parts(self, row: int) -> Iterator[np.ndarray]:
        """The ids of the row-th document, a frame's share at a time."""
        start, stop = int(self.places[row]), int(self.places[row + 1])
        k = int(np.searchsorted(self.ids_at, start, "right")) - 1
        while start < stop:
            base = int(self.ids_at[k])
            own = self.frame(k)[start - base : stop - base]
            yield own
            start, k = start + len(own), k + 1

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of that id."""
        known = np.array([r for r in range(len(self.doc_ids)) if r not in self.nulls], np.int64) if self.nulls else None
        ids = self.doc_ids if known is None else self.doc_ids[known]  # in ascending order, as they are written
        low, high = np.searchsorted(ids, [doc_id, doc_id + 1])
        return [np.concatenate([*self.parts(r), np.empty(0, np.uint32)]) for r in (range(low, high) if known is None else known[low:high].tolist())]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes the tokens of docs (doc_id, text, more) to files in folder, a URI that all executors reach, and returns one
    row per file: file, path, n_docs, n_tokens, first_token. Each document's ids are followed by END_ID.

    A null text is an empty one; rows without a doc_id come first; rows that share one are each written, in the order of
    their texts' hashes. The tokenizer is a file that all executors reach; only its place travels.
    """
    spark = docs.sparkSession
    target, source = tokenizer, folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spark reuses worker processes, and modules outlast the tasks in them.
        kept = vars(sys.modules.setdefault("lattica_encoders", types.ModuleType("lattica_encoders")))
        if target not in kept:
            kept[target] = Encoder(target)
        encoder, end = kept[target], struct.pack("<I", END_ID)
        number = TaskContext.get().partitionId()
        store, base = pa.fs.FileSystem.from_uri(source)
        store.create_dir(base, recursive=True)
        temporary, final = f"{base}/.{uuid.uuid4().hex}", f"{base}/tokens-{number:06d}.zst"
        writer = None
        with store.open_output_stream(temporary) as out:
            writer = TokenFileWriter(out)

            def flush(held: list[tuple[int | None, str]]) -> None:
                for (doc_id, _), ids in zip(held, encoder.batch([t for _, t in held]), strict=True):
                    writer.add(doc_id, np.frombuffer(ids + end, "<u4"))

            for batch in batches:
                held, chars = [], 0
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    text = text.as_py() or ""
                    held.append((doc_id.as_py(), text))
                    chars += len(text)
                    if chars >= ENCODE_CHARS:
                        flush(held)
                        held, chars = [], 0
                flush(held)
            writer.finish()
        give_back()
        if not writer.doc_ids:
            store.delete_file(temporary)
            return
        store.move(temporary, final)
        yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int64()), "name": [f"tokens-{number:06d}.zst"], "n_docs": pa.array([len(writer.doc_ids)], pa.int64()), "n_tokens": pa.array([writer.n_ids], pa.int64())})

    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    with small_batches(spark):
        made = ordered.mapInArrow(run, "file long, name string, n_docs long, n_tokens long").collect()  # a row for each file
    remove_hidden(spark, folder)
    rows, total = [], 0
    for r in sorted(made):
        rows.append((r.file, f"{folder}/{r.name}", r.n_docs, r.n_tokens, total))
        total += r.n_tokens
    return spark.createDataFrame(rows, "file long, path string, n_docs long, n_tokens long, first_token long")


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the files that write_token_files returned, in order: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                store, place = pa.fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    reader = TokenFileReader(file)
                    n = len(reader.doc_ids)
                    for low in range(0, n, 4096):
                        rows = range(low, min(n, low + 4096))
                        sums = []
                        for r in rows:
                            crc = 0
                            for part in reader.parts(r):
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([None if r in reader.nulls else int(reader.doc_ids[r]) for r in rows], pa.int64()),
                            "start": pa.array(reader.places[low : rows.stop] + first, pa.int64()),
                            "n_tokens": pa.array(np.diff(reader.places[low : rows.stop + 1]), pa.int64()),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        })

    n = max(1, files.count())
    return files.select("path", "first_token").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes token files in the shared folder and returns what reading them back gives."""
    work = Workspace(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, work.path("files")))
