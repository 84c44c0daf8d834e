"""Which filter of a cascade removes what, in every order, from counts of failure masks alone.

One pass over the texts gives each document a mask of the filters it fails; documents of one part and
mask are then a count. A subset-zeta transform turns a part's counts by mask into the survivors of
every subset of the filters: what a step of an order removes is the difference between the subset
before it and the subset with it, and so are the labelled documents that it costs.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, join_checked, materialize

#: What a mask's documents are counted by.
COUNTS = ["n", "good", "toxic"]
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_flags(text: Column) -> dict[str, Column]:
    """The failure conditions that a text shows by itself; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, flags: dict[str, Column], part: Column) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, and how many of them are
    labelled of quality 1 and toxic 1. flags: conditions by name, in the order of the mask's bits; the
    bit after the last is that a smaller doc_id has the same text.

    A null text is empty. Rows with a null doc_id copy nothing, are copied by none and have no label. Rows
    that repeat a doc_id count each and are no copies of each other; of several labels of one doc_id the
    highest counts. No columns beside doc_id, text, those that flags and part name, quality and toxic play
    a part. Without documents there are no rows.

    Texts are read once. What is dealt after that is a digest, an id and a mask a document; a text that
    many documents share is combined before each shuffle, and its first copy is found by digest and id
    together, so no task holds a text's copies.
    """
    digest = F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    mask = sum((F.when(flag, 1 << bit).otherwise(0) for bit, flag in enumerate(flags.values())), F.lit(0))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), part.alias("part"), mask.cast("int").alias("mask"))
    seen = materialize(seen.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "masks")

    first = seen.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 1 << len(flags)).otherwise(0)
    known = seen.where("doc_id is not null").join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"), "n")

    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("long").alias(c)
    marks = materialize(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic")), "marks")
    known = join_checked(known, marks, "doc_id", "left", marks.count(), 24)
    nameless = seen.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    rows = known.select("part", "mask", "n", "quality", "toxic").unionByName(nameless)
    lost = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias({"quality": "good"}.get(c, c))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("quality"), lost("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """counts[..., m0, m1, ...]: documents by whether they fail each filter, one axis of length 2 a
    filter, behind one leading axis. The result is indexed by subset in the same way: the documents that fail no filter of it. A
    filter outside the subset passes both halves of its axis, one inside only those that don't fail."""
    for axis in range(1, counts.ndim):
        passes, fails = np.take(counts, [0], axis), np.take(counts, [1], axis)
        counts = np.concatenate([passes + fails, passes], axis)
    return counts


def audit_part(part: str, counts: np.ndarray, names: str) -> list[tuple]:
    """The AUDIT rows of one part; counts: COUNTS by mask, shape (3, 2, 2, ...)."""
    k = len(names)
    left = survivors(counts)
    at = lambda subset: tuple(int(f in subset) for f in range(k))
    everything = int(left[(0, *at(()))])
    fails = [everything - int(left[(0, *at((f,)))]) for f in range(k)]
    alone = [int(counts[(0, *at((f,)))]) for f in range(k)]
    #: A filter's marginal removal behind each subset, by the number of orders that pass through it.
    share = [0] * k
    for subset in np.ndindex(*(2,) * k):
        for f in range(k):
            if not subset[f]:
                within = subset[:f] + (1,) + subset[f + 1 :]
                orders = factorial(sum(subset)) * factorial(k - 1 - sum(subset))
                share[f] += orders * int(left[(0, *subset)] - left[(0, *within)])
    out = []
    for order in permutations(range(k)):
        name = "".join(names[f] for f in order)
        for step, f in enumerate(order):
            before, after = left[(slice(None), *at(order[:step]))], left[(slice(None), *at(order[: step + 1]))]
            gone, good, toxic = (before - after).tolist()
            out.append((part, name, step + 1, int(after[0]), gone, fails[f] - gone, alone[f], good, toxic, share[f]))
    return out


def audit(counts: DataFrame, names: str) -> DataFrame:
    """(part, mask, n, good, toxic) -> a row for each part, order of the filters and step. names: a
    letter for each bit of the mask, lowest first. Every part has rows for all orders, zeros included; a part
    is 2**len(names) counts at most."""
    k = len(names)

    def run(key, table):
        cube = np.zeros((len(COUNTS), 1 << k), np.int64)
        cube[:, table.column("mask").to_numpy()] = [table.column(c).to_numpy() for c in COUNTS]
        # Bit 0 varies fastest in a flat mask, so axes come in reverse.
        cube = cube.reshape(len(COUNTS), *(2,) * k).transpose(0, *range(k, 0, -1))
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        rows = audit_part(key[0].as_py(), cube, names)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [f.split()[0] for f in AUDIT.split(", ")])

    return counts.groupBy("part").applyInArrow(run, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over documents by language; documents without one are the part ''."""
    flags = text_flags(F.col("text"))
    return audit(mask_counts(docs, labels, flags, F.coalesce("lang", F.lit(""))), "".join(flags) + "E")
