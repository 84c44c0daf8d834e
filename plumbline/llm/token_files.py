"""Token files: flat unsigned ids, 64-bit document offsets, read through memory maps.

A folder holds, for each part k in doc_id order: part-k.bin, ids as little-endian unsigned integers
of the narrowest of 2 or 4 bytes that holds the vocabulary; part-k.off, n + 1 unsigned 64-bit
offsets, in ids, of the part's documents; part-k.ids, n signed 64-bit doc_ids. A part's base, the
ids of all parts before it, is a prefix sum over the manifest.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import fresh_path, map_arrow, materialize, partitions

#: doc_id written for a null one.
NULL_ID = -(1 << 63)


class Store:
    """A folder that driver and executors share, on a mounted disk or in a store that pyarrow opens."""

    def __init__(self, uri: str):
        parts = urlparse(uri)
        self.local = parts.scheme in ("", "file")
        if self.local:
            self.path = parts.path if parts.scheme else uri
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def make(self) -> None:
        os.makedirs(self.path, exist_ok=True) if self.local else self.fs.create_dir(self.path, recursive=True)

    def put(self, name: str, chunks, attempt: str) -> None:
        """Under a name of the attempt's own first; the rename makes it whole or absent."""
        own, final = f"{self.path}/.{name}.{attempt}", f"{self.path}/{name}"
        with open(own, "wb") if self.local else self.fs.open_output_stream(own) as f:
            for c in chunks:
                f.write(c)
        os.replace(own, final) if self.local else self.fs.move(own, final)

    def read(self, name: str, dtype: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Items lo to hi of a file: a memory map on a disk, a read of that range from another store."""
        path, width = f"{self.path}/{name}", np.dtype(dtype).itemsize
        if self.local:
            return (np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype))[lo:hi]
        with self.fs.open_input_file(path) as f:
            end = f.size() if hi is None else hi * width
            return np.frombuffer(f.read_at(end - lo * width, lo * width), dtype)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then the same for the next."""
    out = np.repeat((start - (np.cumsum(size) - size)).astype(np.int32), size)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Encoder:
    """Texts to ids through the tokenizers library, which sees each distinct word of a group of texts once.

    A unit is a space and the word up to the next. Where a space follows a character that isn't white
    space, the pre-tokenizer always cuts, so ids of units join to ids of the text, and many units are
    encoded as one text, whose ids fall to the units by their numbers of bytes. Special tokens that
    stand in a text are one id, as by the library's default, and hold no space. A text in which a
    space follows white space, or whose ids don't fall to its units, is encoded whole.

    Arrow splits texts and finds their distinct words, and a group of texts is gathered from the words'
    ids at once, without a step of Python for each word.
    """

    TOGETHER = 2000  # units that are encoded as one text

    def __init__(self, path: str, end_id: int):
        self.t, self.end_id = tokenizer(path), end_id
        self.dtype = "<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4"
        added = {i: x.content for i, x in self.t.get_added_tokens_decoder().items()}
        vocab = self.t.get_vocab()
        # One character stands for each byte in a byte-level vocabulary.
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for x, i in vocab.items():
            self.width[i] = len(added[i].encode()) if i in added else len(x)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has)."""
        found = []
        for i in range(0, len(texts), 16):  # the library's results take far more memory than their ids
            found += [np.array(e.ids, self.dtype) for e in self.t.encode_batch_fast(texts[i : i + 16], add_special_tokens=False)]
        return np.concatenate([np.empty(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64)

    def _stems(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of each word with a space before it; size -1 where it isn't cut off safely."""
        ends_open = pc.or_(pc.equal(pc.binary_length(words), 0), pc.match_substring_regex(words, r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]\z"))
        safe = np.flatnonzero(~ends_open.to_numpy(zero_copy_only=False))
        some = words.take(pa.array(safe))
        cuts = np.minimum(np.arange(0, len(safe) + self.TOGETHER, self.TOGETHER), len(safe))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), some), pa.scalar(" ", pa.large_string())).to_pylist()
        ids, _ = self._encode([" " + x for x, n in zip(joined, np.diff(cuts)) if n])
        given = np.concatenate(([0], np.cumsum(self.width[ids])))
        wanted = np.concatenate(([0], np.cumsum(pc.binary_length(some).to_numpy() + 1)))
        at = np.searchsorted(given, wanted)
        fits = given[np.minimum(at, len(given) - 1)] == wanted
        start, size = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        start[safe] = at[:-1]
        size[safe] = np.where(fits[:-1] & fits[1:], np.diff(at), -1)
        return ids, start, size

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) as by _stems(), but that words which differ in the punctuation at their end
        share their stem's ids: the pre-tokenizer cuts between a letter and punctuation."""
        stems = pc.replace_substring_regex(words, r"([A-Za-z])[.,!?;:*$&\"')%#]+\z", r"\1")
        known = stems.dictionary_encode()
        ids, start, size = self._stems(known.dictionary)
        of = known.indices.to_numpy()
        start, size = start[of], size[of]
        longer = np.flatnonzero((pc.binary_length(words).to_numpy() > pc.binary_length(stems).to_numpy()) & (size >= 0))
        if not len(longer):
            return ids, start, size
        cut = [w[len(s) :] for w, s in zip(words.take(pa.array(longer)).to_pylist(), stems.take(pa.array(longer)).to_pylist())]
        tails = {x: i for i, x in enumerate(dict.fromkeys(cut))}
        own, n_own = self._encode(list(tails))
        tail = np.array([tails[x] for x in cut])
        both = np.concatenate([ids, own])
        at = np.stack([start[longer], len(ids) + (np.cumsum(n_own) - n_own)[tail]], 1).ravel()
        n = np.stack([size[longer], n_own[tail]], 1).ravel()
        more = both[_spread(at, n)]
        size[longer] += n_own[tail]
        start[longer] = len(ids) + np.cumsum(size[longer]) - size[longer]
        return np.concatenate([ids, more]), start, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with the end id; how many each has)."""
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        begin = split.offsets.to_numpy()
        begin = begin[:-1] - begin[0]
        n_words = np.diff(np.append(begin, len(words)))
        place = words.indices.to_numpy().astype(np.int64)
        ids, start, size = self._units(words.dictionary)
        # A text's first word has no space before it: words of their own, behind the others.
        first, where = np.unique(place[begin], return_inverse=True)
        own, n_own = self._encode(words.dictionary.take(pa.array(first)).to_pylist())
        place[begin] = len(size) + where
        size = np.concatenate([size, n_own])
        bad = np.logical_or.reduceat(size[place] < 0, begin)
        which = np.flatnonzero(bad)
        whole, n_whole = self._encode([texts[i].as_py() for i in which.tolist()])
        place[begin[which]] = len(size) + np.arange(len(which))
        size = np.concatenate([size, n_whole, [1, 0]])
        end, nothing = len(size) - 2, len(size) - 1
        rest = np.repeat(bad, n_words)
        rest[begin[which]] = False
        place[rest] = nothing
        ids = np.concatenate([ids, own, whole, np.array([self.end_id], self.dtype)])
        start = np.concatenate([start, len(ids) - 1 - len(whole) - len(own) + np.cumsum(n_own) - n_own, len(ids) - 1 - len(whole) + np.cumsum(n_whole) - n_whole, [len(ids) - 1, 0]])
        # The end id stands after each text's last word.
        place = np.insert(place, begin + n_words, end)
        begin = begin + np.arange(len(begin))
        n = size[place]
        return ids[_spread(start[place], n)], np.add.reduceat(n, begin)

    def groups(self, batches, column: int, most_bytes: int = 1 << 24):
        """encode() over the batches' texts (null: empty) in groups of about most_bytes. A longer text
        goes in pieces, cut before spaces that follow no white space."""
        held, size = [], 0
        for b in batches:
            texts = pc.fill_null(b.column(column).cast(pa.large_string()), "")
            long = np.flatnonzero(pc.binary_length(texts).to_numpy() > most_bytes)
            here = 0
            for i in [*long.tolist(), len(texts)]:
                if i > here:
                    held.append(texts.slice(here, i - here))
                    size += pc.sum(pc.binary_length(held[-1])).as_py()
                if held and (size > most_bytes or i < len(texts)):
                    yield self.encode(pa.concat_arrays(held))
                    held, size = [], 0
                if i < len(texts):
                    yield self._long(texts[i].as_py(), most_bytes)
                here = i + 1
        if held:
            yield self.encode(pa.concat_arrays(held))

    def _long(self, text: str, most: int) -> tuple[np.ndarray, np.ndarray]:
        parts, at = [], 0
        while at < len(text):
            cut = re.compile(r"(?<=\S) ").search(text, at + most)
            end = cut.start() if cut else len(text)
            parts.append(self.encode(pa.array([text[at:end]], pa.large_string()))[0][:-1])
            at = end
        ids = np.concatenate([*parts, np.array([self.end_id], self.dtype)])
        return ids, np.array([len(ids)], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One a worker."""
    return Encoder(path, end_id)


#: Bytes of the input's files that a part stands for, at most.
PART = 128 << 20


def parts_of(docs: DataFrame) -> int:
    """By the size that Spark's statistics give the input; frames that stand on no files have none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), -(-size // PART) if size < 1 << 60 else 1)


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Encodes whole texts (null: empty), ends each document with end_id, writes the files in
    ascending doc_id order (null ids first) and returns the manifest: part, docs, tokens, dtype.

    Equal doc_ids follow one another, in order of text, over parts where they are many. There are as many parts as the
    session shuffles to, and more where the input's files hold over PART bytes for each. A task that runs again writes
    the same files again.
    """
    spark = docs.sparkSession
    Store(folder).make()
    n = parts_of(docs)

    def run(batches):
        part, attempt = TaskContext.get().partitionId(), str(TaskContext.get().taskAttemptId())
        enc = encoder(tokenizer_file, end_id)
        sizes, ids = [], []
        store = Store(folder)

        def texts():
            for b in batches:
                ids.append(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                yield b

        def chunks():
            for made, n in enc.groups(texts(), 1):
                sizes.append(n)
                yield made.astype(enc.dtype, copy=False).tobytes()

        store.put(f"part-{part:05d}.bin", chunks(), attempt)
        sizes = np.concatenate([np.empty(0, np.int64), *sizes])
        off = np.concatenate(([0], np.cumsum(sizes.astype(np.uint64), dtype=np.uint64))).astype("<u8")
        store.put(f"part-{part:05d}.off", [off.tobytes()], attempt)
        store.put(f"part-{part:05d}.ids", [np.concatenate([np.empty(0, np.int64), *ids]).astype("<i8").tobytes()], attempt)
        total = int(off[-1])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(sizes)], pa.int64()), "tokens": pa.array([total], pa.int64()), "dtype": [enc.dtype]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return materialize(ordered.transform(map_arrow, run, "part int, docs long, tokens long, dtype string"), "manifest")


def read(manifest: DataFrame, folder: str, block: int = 4096) -> DataFrame:
    """Reads the files back: doc_id, start (ids before it), n_tokens, ids_crc32 of the ids as
    little-endian unsigned 32-bit integers, one row a document."""
    base = F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(manifest.withColumn("base", base), "bases")

    def run(batches):
        store = Store(folder)
        for b in batches:
            for row in b.to_pylist():
                name = f"part-{row['part']:05d}"
                for i in range(0, row["docs"], block):
                    o = store.read(f"{name}.off", "<u8", i, min(i + block, row["docs"]) + 1).astype(np.int64)
                    d = np.asarray(store.read(f"{name}.ids", "<i8", i, min(i + block, row["docs"])))
                    ids = store.read(f"{name}.bin", row["dtype"], int(o[0]), int(o[-1]))
                    crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip((o[:-1] - o[0]).tolist(), (o[1:] - o[0]).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, mask=d == NULL_ID), pa.array(o[:-1] + row["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, min(partitions(manifest.sparkSession), parts.count()))
    return parts.repartition(n, "part").transform(map_arrow, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Documents (doc_id, text, ...) -> doc_id, start, n_tokens, ids_crc32, through files in the shared
    folder: write(), then read(). A null text counts as empty and has the end id alone. Texts of
    any length go whole, in pieces beyond 16 MB. Rows of one doc_id stay together, in order of
    text; null doc_ids come first and stay null; columns beside doc_id and text play no part; an
    empty table gives no rows."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer_file), folder)
