"""Token-ID output as fixed-width bit-packed files.

A file holds ids in ceil(log2(vocabulary)) bits each. 64 ids of width w fill exactly w 64-bit words (a group), so packing and
unpacking are 64 vectorised shifts for any number of ids; a block is `BLOCK` ids and its byte offset is stored, so
any document can be read by seeking. Layout: blocks, then per document (id, has-id flag, end position in ids), then
block offsets, then a fixed footer. Files of one data set are ordered by doc_id, null first; a JSON-like manifest of
(file, documents, ids) is returned and written beside them.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, filesystem, noted, released, shared_folder, small_batches

BLOCK = 4096
MAGIC = b"QTOK0001"
_FOOTER = struct.Struct("<8sIIQQQ")
CACHE_WORDS = 400_000


def width_of(vocabulary: int) -> int:
    """The least number of bits that holds every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """uint64 words with `width` bits per id; the last group of 64 is padded with zeros."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes = np.ascontiguousarray(lanes.reshape(groups, 64).T)
    out = np.zeros((width, groups), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1)


def unpack(words: np.ndarray, width: int, count: int) -> np.ndarray:
    """The first `count` ids of packed words, as uint32."""
    groups = len(words) // width
    rows = np.ascontiguousarray(words.reshape(groups, width).T)
    out = np.empty((64, groups), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        lane = rows[word] >> np.uint64(shift)
        if shift + width > 64:
            lane = lane | (rows[word + 1] << np.uint64(64 - shift))
        out[j] = lane & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:count]


_MARKS = rb"[!-&(-/:-@\[-`{-~]+(?=[ \t\n\r\x0b\x0c]|\Z)"
_AFTER_ASCII = re.compile(rb"(?<=[a-z])" + _MARKS)
_AFTER_LATIN = re.compile(rb"(?<=[a-z\x80-\xbf])" + _MARKS)
_BEYOND_LATIN = re.compile(rb"[\xc2\xc4-\xff]|\xc3[\x97\xb7]").search
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
# the byte-level alphabet: bytes without a printable Latin-1 character get those from U+0100 on, in order
_HIDDEN = [*range(33), *range(127, 161), 173]
_ALPHABET = dict(zip(_HIDDEN, map(chr, range(256, 256 + len(_HIDDEN)))))


class _Known(dict):
    """Words to their little-endian 32-bit ids; a new word goes through the library. Two generations of CACHE_WORDS are kept."""

    def __init__(self, tokenizer):
        super().__init__()
        self.encode, self.tokenize, self.older = tokenizer.encode, tokenizer.model.tokenize, {}
        self.letters_only = False  # whether words of letters can go to the model without the steps before it

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            if self.letters_only and word.isalpha() and word.islower():
                found = [t.id for t in self.tokenize(word.decode())]
            elif self.letters_only and _LETTERS(word):
                found = [t.id for t in self.tokenize(word.decode().lower().encode().decode("latin-1").translate(_ALPHABET))]
            else:
                found = self.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids


def _splits_at_spaces(tokenizer) -> bool:
    """Whether white space parts words and leaves no trace, so that a text's ids are those of its words, one after the other."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    words = ["a", "12", "--", "it's", "é", "字"]
    return all(ids(f"{gap}{x}{gap}{y}{gap}") == ids(x) + ids(y) for gap in (" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", " \n\t") for x in words for y in words)


class Encoder:
    """Whole texts to ids. Where the tokenizer never joins characters across ASCII white space, each distinct word goes through the
    library once while it is known; other tokenizers get each text as it is."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        kinds = json.loads(self.tokenizer.to_str())
        self.splits = _splits_at_spaces(self.tokenizer)
        self.folds = "Lowercase" in json.dumps(kinds["normalizer"]) and "\\\\p{L}" in json.dumps(kinds["pre_tokenizer"]) and "ByteLevel" in json.dumps(kinds["pre_tokenizer"])
        self.known = _Known(self.tokenizer)
        self.known.letters_only = self.folds

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def words(self, text: bytes) -> list[bytes]:
        """Pieces that the tokenizer treats apart. One that folds case and splits letters from marks gets lower-cased ASCII, and marks
        behind a letter apart, which leaves fewer distinct words; a text with a special token's opening stays as it is."""
        if self.folds and b"<|" not in text:
            text = text.lower()
            text = (_AFTER_ASCII if _BEYOND_LATIN(text) else _AFTER_LATIN).sub(rb" \g<0>", text)
        return text.split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.splits:
            found = [self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]
        ids = self.known.__getitem__
        return [b"".join(map(ids, self.words(t))) for t in texts]


class Writer:
    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = self.at = 0
        self.ids: list[int] = []
        self.has: list[int] = []
        self.ends: list[int] = []
        self.blocks: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        self.ids.append(doc_id or 0)
        self.has.append(doc_id is not None)
        self.ends.append(self.total)
        if self.waiting >= 1 << 20:
            self._drain(False)

    def _drain(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        ready = len(ids) if last else len(ids) - len(ids) % BLOCK
        if ready:
            payload = pack(ids[:ready], self.width).astype("<u8").tobytes()
            self.blocks += [self.at + k * (BLOCK // 8 * self.width) for k in range(-(-ready // BLOCK))]
            self.stream.write(payload)
            self.at += len(payload)
        self.pending = [ids[ready:]]
        self.waiting = len(ids) - ready

    def close(self) -> None:
        self._drain(True)
        self.stream.write(np.array(self.ids, "<i8").tobytes() + np.array(self.has, "u1").tobytes() + np.array(self.ends, "<u8").tobytes())
        self.stream.write(np.array(self.blocks, "<u8").tobytes())
        self.stream.write(_FOOTER.pack(MAGIC, self.width, BLOCK, len(self.ids), self.total, self.at))
        self.stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        magic, self.width, self.block, docs, self.total, payload = _FOOTER.unpack(self._bytes(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        body = self._bytes(payload, size - _FOOTER.size - payload)
        self.doc_ids = np.frombuffer(body, "<i8", docs)
        self.has = np.frombuffer(body, "u1", docs, 8 * docs).astype(bool)
        self.ends = np.frombuffer(body, "<u8", docs, 9 * docs).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.blocks = np.concatenate([np.frombuffer(body, "<u8", -1, 17 * docs).astype(np.int64), [payload]])

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """ids of positions start..end of the file."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        words = np.frombuffer(self._bytes(self.blocks[first], self.blocks[last + 1] - self.blocks[first]), "<u8")
        return unpack(words, self.width, end - first * self.block)[start - first * self.block :]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.ends[i]))

    def spans(self, most: int = 1 << 20):
        """(first, end) runs of documents with about `most` ids."""
        lo = 0
        while lo < len(self.ends):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + most, "right")))
            yield lo, hi
            lo = hi


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """Encode docs(doc_id, text, ...) with the tokenizer file at path `tokenizer` and write token files in ascending doc_id
    order (null first; equal ids by a hash of their texts). Returns (folder, [(file, documents, ids)]), one entry a file.

    Null and empty texts give a document of the end id alone. An empty table gives no file. Other columns are ignored. Rows of one
    doc_id, or of none, are dealt to tasks by their texts; rows alike in both go through one task as a stream. A task writes under a
    name of its own and renames at its end, so a repeated task replaces its file by the same one. The driver gathers one row a file.
    """
    small_batches(docs.sparkSession)
    folder = folder or noted(shared_folder(docs.sparkSession, "tokens"))
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        store, root = filesystem(folder)
        encoder = Encoder.of(tokenizer)
        width = width_of(max(encoder.vocabulary, end_id + 1))
        name = f"part-{TaskContext.get().partitionId():06d}.qtok"
        writer = None
        end = struct.pack("<I", end_id)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                        writer = Writer(store.open_output_stream(temporary), width)
                    writer.add(doc_id, np.frombuffer(raw + end, "<u4"))
        if writer is not None:
            writer.close()
            store.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [len(writer.ids)], "ids": [writer.total]})

    made = rows.mapInArrow(released(run), "file string, docs long, ids long").collect()
    manifest = sorted((r.file, r.docs, r.ids) for r in made)
    if manifest:
        store, root = filesystem(folder)
        with store.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps({"end_id": end_id, "files": manifest}).encode())
    return folder, manifest


def read_token_files(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    files, start = [], 0
    for name, _, ids in manifest:
        files.append((name, start))
        start += ids
    listed = spark.createDataFrame(files, "file string, start long")
    if files:
        listed = listed.repartition(len(files))

    def run(batches):
        store, root = filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as stream:
                    reader = Reader(stream)
                    for lo, hi in reader.spans():
                        offset = int(reader.starts[lo])
                        raw = memoryview(reader.ids(offset, int(reader.ends[hi - 1])).astype("<u4").tobytes())
                        crcs = [zlib.crc32(raw[4 * (int(a) - offset) : 4 * (int(b) - offset)]) for a, b in zip(reader.starts[lo:hi], reader.ends[lo:hi])]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.doc_ids[lo:hi], mask=~reader.has[lo:hi]), pa.array(reader.starts[lo:hi] + base),
                                pa.array(reader.ends[lo:hi] - reader.starts[lo:hi]), pa.array(crcs, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return listed.mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
