"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

#: The characters with the Unicode property White_Space.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
#: No match of the pattern goes on from a character that isn't white space to one that is.
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: The pattern's search runs out of stack on longer runs of white space.
_LONG_RUN = re.compile(f"[{_SPACE}]{{5000,}}")
#: Texts of more characters are encoded in pieces of about so many.
PIECE = 1 << 16


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """One encoder a worker; reads the rank file (lines of base64 bytes and rank)."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str):
    """Cuts a text at safe boundaries: (piece, whole), where a whole piece is one match."""
    at = 0
    while at < len(text):
        cut = _SAFE.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        here = at
        for run in _LONG_RUN.finditer(text, at, end):
            # The match takes all of a run but its last character, which goes with what follows.
            stop = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > here:
                yield text[here : run.start()], False
            yield text[run.start() : stop], True
            here = stop
        if here < end:
            yield text[here:end], False
        at = end


def encode(enc, text: str) -> list[int]:
    if len(text) <= 4096:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece, whole in pieces(text):
        out += enc._encode_single_piece(piece) if whole else enc.encode_ordinary(piece)
    return out


def slices(batches, rows: int = 128):
    """Batches of a few rows each: ids as Python integers take ten times the text's memory."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _lists(ids: list[list[int]]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.int32), *(np.array(x, np.int32) for x in ids)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ids, array<int>, of each whole text (null: empty). Other columns pass through, also one
    already named ids, which is replaced."""
    keep = docs.drop(ids)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in slices(batches):
            made = _lists([encode(enc, x or "") for x in b.column(b.schema.get_field_index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, ids])

    return keep.transform(map_arrow, run, f"{_ddl(keep)}, `{ids}` array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded bytes, binary, of each row's ids; raw bytes, so any cut of ids decodes."""
    keep = encoded.drop(out)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in slices(batches):
            column = b.column(b.schema.get_field_index(ids))
            made = pa.array([enc.decode_bytes(x or []) for x in column.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, out])

    return keep.transform(map_arrow, run, f"{_ddl(keep)}, `{out}` binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, in one pass without moving
    the ids. Null and empty texts have no ids; repeated rows each give a row."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        name = [str(i) for i in range(enc.n_vocab)]
        for b in batches:
            n, a, d = [], [], []
            for x in b.column(1).to_pylist():
                ids = encode(enc, x or "")
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([name[i] for i in ids]).encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds n_tokens, ids (array<int>) and round_trip, whether the decoded bytes equal the text's, and
    drops the text; encoding and decoding in one pass. A null text counts as empty."""
    keep = docs.drop("text", "n_tokens", "ids", "round_trip")
    names = keep.columns

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in slices(batches):
            text = [x or "" for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            ids = [encode(enc, x) for x in text]
            same = [enc.decode_bytes(i) == x.encode() for i, x in zip(ids, text)]
            made = [pa.array([len(i) for i in ids], pa.int64()), _lists(ids), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, *made], [*names, "n_tokens", "ids", "round_trip"])

    return docs.select(*keep.columns, "text").transform(map_arrow, run, f"{_ddl(keep)}, n_tokens long, ids array<int>, round_trip boolean")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
