"""Token-id files with a minimal perfect hash index.

A folder of shards, in ascending key order. ``NAME.ids`` holds nothing but the ids of its documents, each document closed by
the end id, as little-endian integers (16 bits if the vocabulary fits, else 32). ``NAME.idx`` holds a header and four arrays:
the displacements of a minimal perfect hash over the shard's distinct keys; per slot the first row of its key, the number of
rows and a 32-bit fingerprint of the key; per row its key (with a flag for NULL) and the offset of its first id. Finding a key
costs one hash, two array reads and a comparison, however many documents a shard holds. The manifest, one row per shard, is
written last and names the complete shards.

Documents are range-partitioned by key, then text hash, and sorted; each task streams its rows into shards of at most
``SHARD_ROWS`` rows, so nothing is gathered beyond one batch and one shard's index, and the rows of a key that is met very often
are many tasks and shards. The manifest knows the first and last key of each shard, so a reader opens only those whose range
holds a key. A shard is written under a name of the attempt and then renamed, so a lost or repeated task leaves no half file.

Defined results: a NULL text has only the end id; NULL keys come first, are read in order and are not found by key; repeated
keys keep all rows; an empty table gives a manifest without rows; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paneltide.session import cut_lineage, scratch_path

from .common import map_batches, texts
from .mph import PerfectHash, mix

MAGIC = b"IDSHARD1"
SHARD_ROWS = 1 << 14
MEMO = 800_000  # pieces and chunks a worker remembers, some 130 MB
END_ID = 2
#: Texts of these characters only can be cut before they are normalised: lower-casing maps each of them to one character.
PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿß]*")
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
GAPS = re.compile(r"[ \n\t\r]+")


_ready: dict[str, WordTokenizer] = {}  # of this process; at most one


class WordTokenizer:
    """The tokenizers library on pieces, remembered per worker. Its pre-tokens end in a word-end token and do not influence
    each other, so unknown pieces are encoded many at a time and the ids are cut after word ends."""

    def __init__(self, definition: str):
        self.definition = definition

    def __getstate__(self):
        return self.definition

    def __setstate__(self, state):
        self.definition = state

    def ready(self) -> WordTokenizer:
        """The tokenizer this process uses for the definition: a worker serves many jobs, and each brings a copy of its own."""
        if self.definition in _ready:
            return _ready[self.definition]
        if not hasattr(self, "memo"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.definition)
            self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            ends = [k for word, k in self.tokenizer.get_vocab().items() if word.endswith("</w>")]
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[ends] = True
            self.memo: dict[str, bytes] = {}
        _ready.clear()
        _ready[self.definition] = self
        return self

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, text: str) -> tuple[list[str], bool]:
        """Parts whose encodings make up that of the text, and whether all are plain: what stands between spaces and line
        ends, as no piece holds either; looking such a chunk up costs less than cutting it into its pieces."""
        if any(s in text for s in self.special):
            return GAPS.split(text), False
        if text.isascii() or PLAIN.fullmatch(text):
            return text.lower().replace("\n", " ").split(" "), True
        out = []
        for part in GAPS.split(text):
            out += PIECES.findall(part.lower()) if PLAIN.fullmatch(part) else [part]
        return out, False

    def learn(self, joint: list[str], others: list[str]) -> None:
        """Plain chunks are cut into pieces, and those not known yet encoded together."""
        pieces = list(map(PIECES.findall, joint))
        chunks = [(c, p) for c, p in zip(joint, pieces) if len(p) != 1 or p[0] != c]
        joint = [p for p in set().union(*pieces) if p not in self.memo]
        if joint:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(joint)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(joint):
                raw, begins = ids.tobytes(), [0, *(4 * stops).tolist()]
                self.memo.update(zip(joint, map(raw.__getitem__, map(slice, begins, begins[1:]))))
            else:
                others = [*joint, *others]
        for piece in others:
            if piece not in self.memo:
                self.memo[piece] = self.whole(piece)
        for chunk, parts in chunks:
            self.memo[chunk] = b"".join(map(self.memo.__getitem__, parts))

    def encode(self, given: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(given), 64):
            pieces = [self.cut(t) for t in given[at:at + 64]]
            if len(self.memo) > MEMO:
                self.memo.clear()
            found = [list(map(self.memo.get, p)) for p, _ in pieces]
            lacking = [k for k, ids in enumerate(found) if None in ids]
            plain, rest = ({p for k in lacking if pieces[k][1] is wanted for p, ids in zip(pieces[k][0], found[k]) if ids is None} for wanted in (True, False))
            if lacking:
                self.learn(list(plain), list(rest - plain))
                for k in lacking:
                    found[k] = map(self.memo.__getitem__, pieces[k][0])
            out += map(b"".join, found)
        return out


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def save(fs: pafs.FileSystem, path: str, parts: list) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        for p in parts:
            out.write(p)
    fs.move(temporary, path)


class ShardWriter:
    def __init__(self, folder: str, name: str, kind: str):
        self.fs, self.folder = store(folder)
        self.path, self.kind = f"{self.folder}/{name}", kind
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.temporary = f"{self.path}.ids.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        self.keys.append(key)
        self.sizes.append(len(ids))

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, f"{self.path}.ids")
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype("<i8")
        found, first, rows = np.unique(keys[null == 0], return_index=True, return_counts=True)
        hashes = mix(found.view(np.uint64)) if len(found) else np.zeros(0, np.uint64)
        index = PerfectHash.build(hashes)
        slot = index.slots(hashes)
        entries = np.zeros(len(found), [("first", "<i8"), ("rows", "<i8"), ("mark", "<u4")])
        entries["first"][slot], entries["rows"][slot], entries["mark"][slot] = first + int(null.sum()), rows, hashes >> np.uint64(32)
        save(self.fs, f"{self.path}.idx", [MAGIC, struct.pack("<4q", len(index.shifts), len(found), len(keys), np.dtype(self.kind).itemsize),
                                          index.shifts.astype("<i8").tobytes(), entries.tobytes(), null.tobytes(), keys.tobytes(), offsets.tobytes()])
        return {"path": self.path, "n_docs": len(keys), "n_ids": int(offsets[-1]), "first_key": int(found[0]) if len(found) else None, "last_key": int(found[-1]) if len(found) else None}


class Shard:
    """A shard's index in memory and its ids read on demand."""

    def __init__(self, folder: str, path: str):
        self.fs = store(folder)[0]
        self.path = path
        with self.fs.open_input_file(f"{path}.idx") as file:
            raw = memoryview(file.read())
        if bytes(raw[:8]) != MAGIC:
            raise ValueError(f"{path}.idx is not an id index")
        shifts, n, rows, self.width = struct.unpack("<4q", raw[8:40])
        at = 40

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.index = PerfectHash(n, take("<i8", shifts))
        self.entries = take(np.dtype([("first", "<i8"), ("rows", "<i8"), ("mark", "<u4")]), n)
        self.null, self.keys, self.offsets = take(np.uint8, rows), take("<i8", rows), take("<i8", rows + 1)

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; no rows for a key that is not stored."""
        hashes = mix(np.asarray(keys, "<i8").view(np.uint64))
        if not self.index.n:
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        entry = self.entries[self.index.slots(hashes)]
        own = entry["mark"] == (hashes >> np.uint64(32))
        own &= self.keys[np.where(own, entry["first"], 0)] == keys
        return np.where(own, entry["first"], 0), np.where(own, entry["rows"], 0)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of rows first to last - 1, as 32-bit integers."""
        begin, end = int(self.offsets[first]), int(self.offsets[last])
        with self.fs.open_input_file(f"{self.path}.ids") as file:
            raw = file.read_at((end - begin) * self.width, begin * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


class Reader:
    """Keyed access: ``manifest`` are the rows of the stored manifest. A key costs a search among the shards' first keys and
    opens the shards whose range holds it, one unless the key has rows in several; indexes stay open once read."""

    def __init__(self, folder: str, manifest: list):
        held = sorted((r for r in manifest if r["first_key"] is not None), key=lambda r: (r["part"], r["seq"]))
        self.folder, self.paths = folder, [r["path"] for r in held]
        self.first, self.last = (np.array([r[c] for r in held], np.int64) for c in ("first_key", "last_key"))
        self.opened: dict[str, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every row stored under the key, in stored order."""
        found = []
        for k in range(int(np.searchsorted(self.last, key, "left")), int(np.searchsorted(self.first, key, "right"))):
            path = self.paths[k]
            shard = self.opened.get(path) or self.opened.setdefault(path, Shard(self.folder, path))
            (first,), (rows,) = shard.rows_of(np.array([key], np.int64))
            found += [shard.ids(row, row + 1) for row in range(int(first), int(first + rows))]
        return found


def write(docs: DataFrame, definition: str, folder: str, shards: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenise and write; the manifest (part, seq, path, n_docs, n_ids, first_key, last_key) is the commit and is itself stored."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(WordTokenizer(definition))
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)

    def work(batches):
        own, part, writer, seq = shared.value.ready(), TaskContext.get().partitionId(), None, 0
        kind, done = "<u2" if len(own.ends) <= 1 << 16 else "<u4", []
        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist())):
                if writer and len(writer.keys) >= SHARD_ROWS:
                    done.append(writer.close() | {"part": part, "seq": seq})
                    writer, seq = None, seq + 1
                writer = writer or ShardWriter(folder, f"shard-{part:06d}-{seq:06d}", kind)
                writer.add(key, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if writer:
            done.append(writer.close() | {"part": part, "seq": seq})
        yield {n: [d[n] for d in done] for n in ("part", "seq", "path", "n_docs", "n_ids", "first_key", "last_key")}

    return cut_lineage(map_batches(ranged.sortWithinPartitions(*order), work,
                                   "part long, seq long, path string, n_docs long, n_ids long, first_key long, last_key long"), "id-manifest")


def positions(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the number of ids before the shard: running sums over parts, then inside a part."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return manifest.withColumn("inside", inside).join(before, "part").select("part", "seq", "path", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("base"))


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, each found by its key through the index."""
    located = positions(manifest)

    def work(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(folder, path)
                lost = int(shard.null.sum())
                keys, where = np.unique(shard.keys[lost:], return_inverse=True)
                first, rows = shard.rows_of(keys)
                order = np.arange(len(shard.keys))
                order[lost:] = first[where] + np.arange(len(where)) - np.searchsorted(shard.keys[lost:], shard.keys[lost:])
                if len(keys) and not (rows == np.bincount(where)).all():
                    raise ValueError(f"{path}: the index does not match the keys")
                for at in range(0, len(order), 1024):
                    part = order[at:at + 1024]
                    begin, ids = int(part.min()), shard.ids(int(part.min()), int(part.max()) + 1)
                    spans = [(int(shard.offsets[k] - shard.offsets[begin]), int(shard.offsets[k + 1] - shard.offsets[begin])) for k in part]
                    yield {"doc_id": [None if shard.null[k] else int(shard.keys[k]) for k in part], "start": [base + int(shard.offsets[k]) for k in part],
                           "n_tokens": [e - b for b, e in spans], "ids_crc32": [zlib.crc32(ids[b:e].tobytes()) for b, e in spans]}

    apart = located.repartition(max(1, min(manifest.count(), 10_000)), "part", "seq")  # shards are read in parallel however small
    return map_batches(apart.select("path", "base"), work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str, shards: int | None = None) -> DataFrame:
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    folder = scratch_path(docs.sparkSession, "id-files")
    return read(docs.sparkSession, write(docs, definition, folder, shards), folder)
