"""Repeated passages: every byte covered by a `length`-byte string that also starts in a document with
a smaller doc_id, found by sorting suffixes of the places where documents can match.

A string of `length` bytes holds the same minimizer wherever it stands, so two equal strings share an
anchor: a gram of bytes at one place in both. Anchors that occur in one document alone can't be
part of a repeat; the others are dealt by content, with what surrounds them. All different
surroundings of an anchor make one text, whose suffix array by linear grouping (lyndon.py) decides
which strings are equal: neighbours in suffix order with `length` bytes in common. An anchor of many
surroundings is split by the bytes that its strings share.

Of what many documents share, each flush of rows settles what it can by itself, as a string goes
where any smaller document has it, and sends its first holders alone. The few anchors that are hot
none the less (in 20,000 places and more) are dealt by their strings and not by themselves, so none
meets in one task. Bytes move in packed blocks, and no document, anchor of few or match goes to the
driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import give_back, join_checked, map_arrow, materialize, mix64
from .lyndon import suffix_arrays

#: A gram's bytes; the rest of a string is what a minimizer chooses from.
GRAM = 20
_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(17)]
_VALUE = mix64(np.arange(1001, 1257, dtype=np.uint64))
_LOW = np.uint64((1 << 24) - 1)
#: Texts beyond so many bytes are scanned in pieces that overlap.
PIECE = 1 << 23
#: The most surroundings in one text (a larger set is split first), and rows sorted at once.
TOGETHER = 8
ROWS = 8_000
NONE = np.iinfo(np.int64).max
#: Bytes of text whose anchors meet in one group, about.
DEAL_BYTES = 6 << 20
#: A text of more than HOT rows is met by them in SALTS tasks.
HOT, SALTS = 256, 32
#: An anchor so often in a flush of half a million is combined before it is sent; one in so many places is hot, and about
#: so many are hot at most, as more places are asked for beyond.
REPEATED, HOT_ANCHOR, MOST_HOT = 16, 20_000, 20_000


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, 48-bit hash) of each minimizer gram of the strings of `length` bytes."""
    if len(b) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(b) > PIECE + length:
        parts = [(i, *anchors(b[i : i + PIECE + length - 1], length)) for i in range(0, len(b) - length + 1, PIECE)]
        at, h = np.concatenate([i + a for i, a, _ in parts]), np.concatenate([h for _, _, h in parts])
        at, first = np.unique(at, return_index=True)
        return at, h[first]
    h1 = _VALUE[b]
    h2 = h1[:-1] * _P[1] + h1[1:]
    h4 = h2[:-2] * _P[2] + h2[2:]
    h8 = h4[:-4] * _P[4] + h4[4:]
    h = mix64((h8[:-8] * _P[8] + h8[8:])[:-4] * _P[4] + h4[16:])
    k = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, m, have = length - GRAM + 1, k, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    at = (m & _LOW).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, h[at] >> np.uint64(16)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which compress where high bytes are alike."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").ravel() for b in blobs)])


def _deal(key: np.ndarray, n: int):
    """For each of n deals that has any: (deal, places of its keys)."""
    d = (key % n).astype(np.int64)
    order = np.argsort(d, kind="stable")
    cuts = np.flatnonzero(np.diff(d[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(d[part[0]]), part


# Messages between the stages: packed columns of numbers, and rows of bytes, for one deal.
COLUMNS = [f"x{k}" for k in range(6)]
MESSAGE = f"deal long, kind int, {', '.join(f'{c} binary' for c in COLUMNS)}, rows binary"
_SCHEMA = pa.schema([("deal", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in [*COLUMNS, "rows"])])


def _send(kind: int, key: np.ndarray, n: int, columns: list[np.ndarray], rows: np.ndarray | None = None) -> list[dict]:
    return [{"deal": deal, "kind": kind, "rows": None if rows is None else rows[at].tobytes()} | {c: _pack(x[at]) for c, x in zip(COLUMNS, columns)} for deal, at in _deal(key, n)]


def _received(table: pa.Table, kind: int, n: int) -> list[np.ndarray]:
    """The first n columns of a kind's messages, and their rows of bytes one after another."""
    own = table.filter(pc.equal(table.column("kind"), kind))
    raw = b"".join(x for x in own.column("rows").to_pylist() if x is not None)
    return [*(_unpack(own.column(c).to_pylist()) for c in COLUMNS[:n]), np.frombuffer(raw, np.uint8)]


def _least(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NONE)
    np.minimum.at(out, of, values)
    return out


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


# --- which strings of a set of surroundings are equal -------------------------------------------


def _classes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each class of equal rows of 64-bit words, each row's class). Hashes bring equal rows
    together; bytes decide."""
    x, y = np.full(len(words), _P[3]), np.full(len(words), _P[5])
    for k in range(words.shape[1]):
        x, y = mix64(x ^ words[:, k]) * _P[1], mix64(y * _P[7] + words[:, k])
    order = np.lexsort((y, x))
    new = np.ones(len(words), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    of = np.empty(len(words), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _wide(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, the last one filled up with zeros."""
    full = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    full[:, : rows.shape[1]] = rows
    return full.view("<u8")


def first_holders(around: np.ndarray, group: np.ndarray, least: np.ndarray, lead: np.ndarray, tail: np.ndarray, length: int) -> np.ndarray:
    """For surroundings (rows of bytes): the least document that holds each string of `length` bytes in
    a surrounding of the same group, rows x strings; NONE where a row has no such string.

    lead and tail: how many bytes a row really has before and after the gram.
    """
    span = around.shape[1]
    low, high = (span - GRAM) // 2 - lead, tail
    return _holders(around, group, least, low, high, 0, span - length, length)


def _holders(around, cell, least, low, high, a: int, b: int, length: int) -> np.ndarray:
    """first_holders() for the strings that begin at a to b; a row has those from low to high.

    Rows alike in what these strings cover count once. A cell of up to TOGETHER different rows is
    sorted as one text. In a larger one the strings are halved, and each half's rows part by the
    bytes that all strings of the half cover: rows that differ there share none of them. With one
    string left these bytes are the string, and a cell holds one row.
    """
    low, high = np.clip(low, a, b + 1), np.clip(high, a - 1, b)
    one, of = _classes(np.concatenate([np.stack([cell, low, high], 1).astype(np.int64).view("<u8"), _wide(around[:, a : b + length])], 1))
    around, cell, low, high = around[one], cell[one], low[one], high[one]
    lowest = np.full(len(one), NONE)
    np.minimum.at(lowest, of, least)
    o = np.arange(a, b + 1)
    valid = (o[None] >= low[:, None]) & (o[None] <= high[:, None])
    out = np.where(valid, lowest[:, None], NONE)
    _, cell, count = np.unique(cell, return_inverse=True, return_counts=True)
    few = np.flatnonzero((count[cell] > 1) & (count[cell] <= TOGETHER))
    if len(few):
        out[few] = _sorted(around[few, a : b + length], cell[few], lowest[few], valid[few], length)
    many = np.flatnonzero(count[cell] > TOGETHER)
    middle = (a + b) // 2
    for x, y in ((a, middle), (middle + 1, b)) if len(many) and a < b else ():
        part = many[(low[many] <= y) & (high[many] >= x)]
        if len(part):
            _, deeper = _classes(np.concatenate([cell[part, None].view("<u8"), _wide(around[part, y : x + length])], 1))
            out[part, x - a : y - a + 1] = _holders(around[part], deeper, lowest[part], low[part], high[part], x, y, length)
    return out[of]


def _sorted(rows: np.ndarray, cell: np.ndarray, least: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """first_holders() for cells of few rows: a cell's rows make one text, each ended by a 1, the text by
    a 0, and runs of neighbours in suffix order with equal strings share the least document."""
    out = np.where(valid, least[:, None], NONE)
    n, span = rows.shape
    n_strings = span - length + 1
    held = np.bincount(cell)
    order = np.lexsort((cell, held[cell]))  # texts of one size stand together
    ends = np.flatnonzero(np.append(cell[order][1:] != cell[order][:-1], True)) + 1
    cuts = [0]
    while cuts[-1] < n:  # whole texts, about ROWS rows at once
        cuts.append(int(ends[min(np.searchsorted(ends, cuts[-1] + ROWS), len(ends) - 1)]))
    for c, d in zip(cuts, cuts[1:]):
        take = order[c:d]
        t = cell[take]
        begin = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        k = np.diff(np.append(begin, len(t)))
        size = k * (span + 1) + 1
        base = np.cumsum(size) - size
        chars = np.zeros(int(size.sum()), np.int64)
        spot = np.repeat(base, k) + (np.arange(len(t)) - np.repeat(begin, k)) * (span + 1)
        at = spot[:, None] + np.arange(span + 1)
        chars[at[:, :-1]] = rows[take].astype(np.int64) + 2
        chars[at[:, -1]] = 1
        sa = suffix_arrays(chars, base, size)
        # Suffixes that begin one of the rows' strings, in suffix order.
        owner = np.full(len(chars), -1, np.int64)
        which = valid[take]
        owner[at[:, :n_strings][which]] = np.flatnonzero(which)
        s = sa[owner[sa] >= 0]
        r, w = np.divmod(owner[s], n_strings)
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(rows[take], length, axis=1)).reshape(len(take) * n_strings, length)
        words = _wide(words)[owner[s]]
        new = np.ones(len(s), bool)
        new[1:] = (words[1:] != words[:-1]).any(1) | (t[r[1:]] != t[r[:-1]])
        begin = np.flatnonzero(new)
        if len(begin):
            out[take[r], w] = np.repeat(np.minimum.reduceat(least[take[r]], begin), np.diff(np.append(begin, len(s))))
    return out


# --- the stages ---------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, length: int = 50, return_text: bool = False) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    return_text the kept bytes (binary), one row for each row.

    Whole texts as UTF-8 (null: empty). Matches don't cross documents; a string repeated within one
    document alone is no match, nor one in a row with the same doc_id. Texts shorter than `length`
    lose nothing. Rows with a null doc_id take no part and keep all. length is 2 * GRAM at least.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    side = length - GRAM
    span = GRAM + 2 * side
    texts = docs.select(F.col("doc_id").cast("long"), "text")

    def digest(batches):
        for b in batches:
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary())],
                ["doc_id", "own", "n_bytes", "whole"],
            )

    own = F.pmod(F.xxhash64("text"), F.lit(1 << 62)) + 1
    known = materialize(
        texts.where("doc_id is not null").withColumn("own", own).transform(map_arrow, digest, "doc_id long, own long, n_bytes long, whole binary").where(F.col("n_bytes") >= length),
        "texts",
    )
    # Rows of one doc_id may hold several texts: mark tells them apart, and is 0 elsewhere.
    several = materialize(known.groupBy("doc_id").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("doc_id", F.lit(True).alias("several")), "several")
    n_several = several.count()

    def marked_rows(rows, own):
        if not n_several:
            return rows.withColumn("mark", F.lit(0).cast("long"))
        rows = join_checked(rows, several, "doc_id", "left", n_several, 24)
        return rows.withColumn("mark", F.when(F.col("several"), own).otherwise(F.lit(0)).cast("long")).drop("several")

    known, texts = marked_rows(known, F.col("own")), marked_rows(texts, own)
    # Copies: all of a text that stands in a document with a smaller doc_id goes.
    first = known.groupBy("whole").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    first = materialize(first, "first")
    hot = first.where(F.col("c") > HOT).select("whole", F.col("first").alias("hot"))
    n_hot = hot.count()
    rows = known
    if n_hot:  # one text may be a third of all rows: they meet its first holder in SALTS tasks
        hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = join_checked(known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), hot, ["whole", "salt"], "left", n_hot * SALTS, 48)
    key = ["doc_id", "mark"]
    pairs = (rows.where("hot is null") if n_hot else rows).join(first.where(F.col("c") <= HOT), "whole").select(*key, "first")
    if n_hot:
        pairs = pairs.unionByName(rows.where("hot is not null").select(*key, F.col("hot").alias("first")))
    copies = materialize(pairs.where("doc_id > first").select("doc_id", "mark").distinct(), "copies")
    n_copies = copies.count()
    total = known.agg(F.sum("n_bytes")).first()[0] or 0
    # Groups go by the data alone: every group may send to every other, so more of them would be more messages.
    deals = int(max(16, total // DEAL_BYTES + 1))
    left = join_checked(texts.where("doc_id is not null and text is not null"), copies, ["doc_id", "mark"], "left_anti", n_copies, 48)

    hot_least = max(HOT_ANCHOR, total // (15 * MOST_HOT))  # there is an anchor in about 15 bytes

    def find_anchors(batches):
        def flush(ids, hashes, rows):
            h = (np.concatenate(hashes) & np.uint64((1 << 48) - 1)).view(np.int64)
            of, i = np.array(rows, np.int64).reshape(-1, 2).repeat([len(x) for x in hashes], 0), np.concatenate(ids)
            order = np.argsort(h, kind="stable")
            h, d, m, i = h[order], of[order, 0], of[order, 1], i[order]
            begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            width = np.diff(np.append(begin, len(h)))
            low, high = np.minimum.reduceat(d, begin), np.maximum.reduceat(d, begin)
            # An anchor that repeats here in several documents is shared for sure: two occurrences, with the
            # number of all, stand for it where it meets the others'.
            many = np.repeat((width >= REPEATED) & (low != high), width)
            group, weight, sent = np.repeat(np.arange(len(begin)), width), np.ones(len(h), np.int64), ~many
            for side_ in (low, high):
                at = np.flatnonzero(many & (d == side_[group]))
                _, one = np.unique(group[at], return_index=True)
                sent[at[one]] = True
                if side_ is low:
                    weight[at[one]] = width[group[at[one]]] - 1
            sure = ~sent
            out = _send(0, h[sent].view(np.uint64), deals, [h[sent], d[sent], m[sent], i[sent], weight[sent]])
            return pa.RecordBatch.from_pylist(out + _send(1, mix64(d[sure].view(np.uint64)), deals, [d[sure], m[sure], i[sure]]), _SCHEMA)

        ids, hashes, rows, size = [], [], [], 0
        for b in batches:
            for doc, mark, text in zip(*(c.to_pylist() for c in b.columns)):
                at, h = anchors(_bytes_of(text), length)
                if len(at):
                    ids.append(np.arange(len(at)))
                    hashes.append(h)
                    rows.append((doc, mark))
                    size += len(at)
                if size > 500_000:
                    yield flush(ids, hashes, rows)
                    ids, hashes, rows, size = [], [], [], 0
        if rows:
            yield flush(ids, hashes, rows)

    def shared(table):
        h, d, m, i, weight, _ = _received(table, 0, 5)
        sure = _received(table, 1, 3)
        order = np.argsort(h, kind="stable")
        h, d, m, i, weight = (x[order] for x in (h, d, m, i, weight))
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        out = []
        if len(begin):
            two = np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
            hot = h[begin[two & (np.add.reduceat(weight, begin) >= hot_least)]]
            if len(hot):
                out.append({"deal": -1, "kind": 1, "x0": _pack(hot)})
            keep = np.repeat(two, np.diff(np.append(begin, len(h))))
            d, m, i = d[keep], m[keep], i[keep]
        d, m, i = (np.concatenate(x) for x in zip((d, m, i), sure[:3]))
        del h, order, weight
        give_back()
        return pa.Table.from_pylist(out + _send(0, mix64(d.view(np.uint64)), deals, [d, m, i]), _SCHEMA)

    def by_document(table):
        """Which of a row's anchors are shared: one bit an anchor. The hot anchors stand in a row without
        doc_id."""
        d, m, i, _ = _received(table, 0, 3)
        order = np.lexsort((i, m, d))
        d, m, i = d[order], m[order], i[order]
        cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(m) != 0)) + 1
        first = np.concatenate(([0], cuts)) if len(d) else np.empty(0, np.int64)
        bits = []
        for part in np.split(i, cuts) if len(d) else []:
            flags = np.zeros(part[-1] + 1, bool)
            flags[part] = True
            bits.append(np.packbits(flags).tobytes())
        ids, marks = d[first].tolist(), m[first].tolist()
        hot = _received(table, 1, 1)[0]
        if len(hot):
            ids, marks, bits = [*ids, None], [*marks, None], [*bits, hot.tobytes()]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "mark": pa.array(marks, pa.int64()), "at": pa.array(bits, pa.binary())})

    found = left.select("doc_id", "mark", "text").transform(map_arrow, find_anchors, MESSAGE).groupBy("deal").applyInArrow(shared, MESSAGE)
    marks = materialize(found.groupBy("deal").applyInArrow(by_document, "doc_id long, mark long, at binary"), "marks")
    hot_anchors = np.unique(np.concatenate([np.empty(0, np.int64), *(np.frombuffer(bytes(r["at"]), np.int64) for r in marks.where("doc_id is null").collect())]))
    marks = marks.where("doc_id is not null")
    n_marks, mark_bytes = marks.agg(F.count("*"), F.coalesce(F.sum(F.length("at")), F.lit(0))).first()
    marked = join_checked(left, marks, ["doc_id", "mark"], "inner", 1, int(mark_bytes) + 128 * n_marks).select("doc_id", "mark", "text", "at")

    def surroundings(batches):
        """Kind 0: surroundings; 1: strings of hot anchors; 2: spans that go for sure. What stands in a
        smaller document of the same flush needs no other task; only first holders meet the others', so a
        surrounding or string that all documents share is sent once a flush."""

        def flush(*got):
            h, d, m, p, lead, tail = (np.concatenate(x) for x in got[:6])
            rows, out = np.concatenate(got[6]), []
            gone = [[np.empty(0, np.int64)] for _ in range(4)]

            def cut(at, lo, hi):
                for x, y in zip(gone, (d[at], m[at], lo, hi)):
                    x.append(y)

            hot = np.isin(h, hot_anchors)
            plain = np.flatnonzero(~hot)
            if len(plain):
                one, of = _classes(np.concatenate([np.stack([h, lead, tail], 1)[plain].view("<u8"), _wide(rows[plain])], 1))
                first = d[plain] == _least(d[plain], of, len(one))[of]
                x = plain[~first]
                cut(x, p[x] - lead[x], p[x] + GRAM + tail[x])
                x = plain[first]
                out += _send(0, mix64(h[x].view(np.uint64)), deals, [h[x], d[x], m[x], p[x], lead[x], tail[x]], rows[x])
            hot = np.flatnonzero(hot)
            for c in range(0, len(hot), 10_000):
                row, o = np.nonzero((np.arange(side + 1)[None] >= side - lead[hot[c : c + 10_000], None]) & (np.arange(side + 1)[None] <= tail[hot[c : c + 10_000], None]))
                row += c
                strings = np.lib.stride_tricks.sliding_window_view(rows[hot[c : c + 10_000]], length, axis=1)[row - c, o]
                one, of = _classes(_wide(strings))
                row = hot[row]
                first = d[row] == _least(d[row], of, len(one))[of]
                lo = p[row] - side + o
                go = np.flatnonzero(~first)  # in runs: row by row, string after string
                if len(go):
                    new = np.flatnonzero(np.append(True, (row[go][1:] != row[go][:-1]) | (o[go][1:] != o[go][:-1] + 1)))
                    cut(row[go[new]], lo[go[new]], lo[go[np.append(new[1:], len(go)) - 1]] + length)
                key = np.zeros(len(one), np.uint64)
                for w in _wide(strings[one]).T:
                    key = mix64(key * _P[1] + w)
                out += _send(1, key[of[first]], deals, [d[row[first]], m[row[first]], lo[first]], strings[first])
            ids, marks_, lo, hi = (np.concatenate(x) for x in gone)
            return pa.RecordBatch.from_pylist(out + _send(2, mix64(ids.view(np.uint64)), deals, [ids, marks_, lo, hi]), _SCHEMA)

        got, size = [[] for _ in range(7)], 0
        for b in batches:
            for doc, mark, text, at in zip(*(c.to_pylist() for c in b.columns)):
                raw = _bytes_of(text)
                every, hashes = anchors(raw, length)
                some = np.flatnonzero(np.unpackbits(np.frombuffer(at, np.uint8))[: len(every)])
                full = np.zeros(len(raw) + 2 * side, np.uint8)
                full[side : side + len(raw)] = raw
                for c in range(0, len(some), 100_000):
                    place, h = every[some[c : c + 100_000]], hashes[some[c : c + 100_000]].view(np.int64)
                    for x, y in zip(
                        got,
                        (
                            h,
                            np.full(len(h), doc, np.int64),
                            np.full(len(h), mark, np.int64),
                            place,
                            np.minimum(place, side),
                            np.minimum(len(raw) - place - GRAM, side),
                            full[place[:, None] + np.arange(span)],
                        ),
                    ):
                        x.append(y)
                    size += len(h)
                    if size >= 100_000:
                        yield flush(*got)
                        got, size = [[] for _ in range(7)], 0
        if size:
            yield flush(*got)

    def repeats(table):
        h, d, m, p, lead, tail, around = _received(table, 0, 6)
        around = around.reshape(-1, span)
        gone = _received(table, 2, 4)[:4]
        ids, own, lo, hi = ([x] for x in gone)
        if len(h):
            # Equal surroundings count once, with their least document.
            one, of = _classes(np.concatenate([np.stack([h, lead, tail], 1).view("<u8"), _wide(around)], 1))
            least = first_holders(around[one], h[one], _least(d, of, len(one)), lead[one], tail[one], length)
            for c in range(0, len(h), 100_000):
                less = least[of[c : c + 100_000]] < d[c : c + 100_000, None]
                hit = less.any(1)
                start = p[c : c + 100_000] - side
                ids.append(d[c : c + 100_000][hit])
                own.append(m[c : c + 100_000][hit])
                lo.append((start + less.argmax(1))[hit])
                hi.append((start + less.shape[1] - 1 - less[:, ::-1].argmax(1) + length)[hit])
            del least
        del around
        d, m, at, strings = _received(table, 1, 3)
        if len(d):
            one, of = _classes(_wide(strings.reshape(-1, length)))
            hit = d > _least(d, of, len(one))[of]
            for x, y in zip((ids, own, lo, hi), (d[hit], m[hit], at[hit], at[hit] + length)):
                x.append(y)
        ids, own, lo, hi = (np.concatenate(x) for x in (ids, own, lo, hi))
        give_back()
        return pa.Table.from_pylist(_send(0, mix64(ids.view(np.uint64)), deals, [ids, own, lo, hi]), _SCHEMA)

    def spans_of(table):
        d, m, lo, hi, _ = _received(table, 0, 4)
        ids, own, spans = [], [], []
        order = np.lexsort((lo, m, d))
        d, m, lo, hi = d[order], m[order], lo[order], hi[order]
        for part in np.split(np.arange(len(d)), np.flatnonzero((np.diff(d) != 0) | (np.diff(m) != 0)) + 1):
            if len(part):
                a, z = lo[part], np.maximum.accumulate(hi[part])
                new = np.concatenate(([True], a[1:] > z[:-1]))
                ids.append(int(d[part[0]]))
                own.append(int(m[part[0]]))
                spans.append(np.stack([a[new], z[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]], 1).astype("<i8").tobytes())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "mark": pa.array(own, pa.int64()), "spans": pa.array(spans, pa.binary())})

    met = marked.transform(map_arrow, surroundings, MESSAGE)
    gone = met.groupBy("deal").applyInArrow(repeats, MESSAGE).groupBy("deal").applyInArrow(spans_of, "doc_id long, mark long, spans binary")
    gone = materialize(gone, "spans")
    n_gone, gone_bytes = gone.agg(F.count("*"), F.coalesce(F.sum(F.length("spans")), F.lit(0))).first()
    rows = join_checked(texts, copies.withColumn("copy", F.lit(True)), ["doc_id", "mark"], "left", n_copies, 48)
    rows = join_checked(rows, gone, ["doc_id", "mark"], "left", 1, int(gone_bytes) + 128 * n_gone)

    def cut(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for text, copy, spans in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                s = [(0, len(raw))] if copy else np.frombuffer(spans or b"", "<i8").reshape(-1, 2).tolist()
                kept, here = [], 0
                for a, z in s:
                    kept.append(raw[here:a])
                    here = z
                kept = b"".join([*kept, raw[here:]]) if s else raw
                for x, y in zip(out, (len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept if return_text else None)):
                    x.append(y)
            arrays = [b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[4], pa.binary())][: 5 + return_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + return_text])

    return rows.select("doc_id", "text", "copy", "spans").transform(map_arrow, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * return_text)
