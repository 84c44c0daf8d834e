"""Language ID by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit of it has a binary classifier over hashed n-gram shares. A
text's bits are decoded to the codeword with the least loss, each bit weighted by how well its
classifier does on documents kept apart, and near ties are flagged.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import give_back, join_checked, map_arrow, materialize


#: Hashed features: byte trigrams and bigrams of lower-cased letters, the rest as one separator.
FEATURES = 1 << 13
UNKNOWN = "und"

_CLASS = np.arange(256, dtype=np.int64)
_CLASS[:128] = 0
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS = _CLASS.astype(np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if not text.isascii() else bool(np.any(_CLASS[np.frombuffer(text.encode(), np.uint8)]))


def counts(text: str) -> np.ndarray:
    """How often each byte trigram and bigram feature occurs in the whole text, in pieces of bounded
    size that overlap by what an n-gram at the cut needs, so none counts twice."""
    out = np.zeros(FEATURES, np.int64)
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    step = 1 << 20
    for i in range(0, len(raw), step):
        c = _CLASS[raw[i : i + step + 2]]
        letter = c != 0
        pair = letter[:-1] & letter[1:]
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        if len(c) > 2:
            h = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
            h *= np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
            full = pair[:-1] | pair[1:] | (letter[:-2] & letter[2:])
            out += np.bincount((h & np.uint32(FEATURES - 1))[full], minlength=FEATURES)
        two, pair = two[:step], pair[:step]
        out += np.bincount((two * np.uint32(0x27D4EB2F) >> np.uint32(19))[pair], minlength=FEATURES)
    if len(raw) == 1:
        out[int(_CLASS[raw[0]])] += 1
    return out


def features(c: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of unit length, of the square roots of shares."""
    x = np.sqrt(c.astype(np.float32))
    n = np.sqrt((x * x).sum(-1, keepdims=True))
    return x / np.maximum(n, 1e-9)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1/-1: the exhaustive code up to 7 languages, else the best of random dense codes.
    No bit is constant."""
    if n <= 2:
        return np.array([[1], [-1]][:n] or np.empty((0, 1)), np.int8)
    if n <= 7:
        bits = [[1, *[1 if (m >> j) & 1 else -1 for j in range(n - 1)]] for m in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.int8).T
    rng, length, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        m = np.where(rng.random((n, length)) < 0.5, 1, -1).astype(np.int8)
        if (np.abs(m.sum(0)) == n).any():
            continue
        d = (length - m.astype(int) @ m.T) / 2 + np.eye(n) * length
        if best is None or d.min() > best[0]:
            best = d.min(), m
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # bits
    coef: np.ndarray  # features x bits
    bias: np.ndarray  # bits

    def predict(self, c: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of counts to (place of the language, score 0 to 1, ambiguous)."""
        f = np.clip(features(c) @ self.coef + self.bias, -3, 3)
        # Exponential loss of every bit against every codeword.
        loss = np.einsum("b,nlb->nl", self.weight, np.exp(-f[:, None, :] * self.code[None]))
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        return best, top[:, -1], (top[:, -1] - top[:, -2] < near) if p.shape[1] > 1 else np.zeros(len(p), bool)


def train(lang: list[str], x: np.ndarray, seed: int = 11, rounds: int = 300) -> Model:
    """Ridge-penalised logistic classifiers, one a bit, by accelerated gradient steps on all rows;
    each bit's weight is its accuracy above chance on every fifth row, kept apart from the fit.
    x: rows of counts as float32, which become features in place."""
    langs = sorted(set(lang))
    code = codewords(len(langs), seed)
    if not langs:
        return Model([], np.empty((0, 1), np.int8), np.ones(1), np.zeros((FEATURES, 1), np.float32), np.zeros(1))
    place = {v: i for i, v in enumerate(langs)}
    y = np.array([place[v] for v in lang])
    np.sqrt(x, out=x)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    apart = np.arange(len(y)) % 5 == 4
    balance = (1 / np.bincount(y, minlength=len(langs)))[y].astype(np.float32)
    # Steps in terms of the rows' inner products are the same steps, and cheaper with fewer rows than
    # features. The constant feature of the bias adds 1 to each product.
    gram = x @ x.T + np.float32(1) if len(x) <= x.shape[1] else None

    def fit(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Rows kept apart weigh nothing.
        t = code[y].astype(np.float32)
        b = np.where(keep, balance, np.float32(0))
        b = (b / b.sum())[:, None]
        w = v = np.zeros((len(x) if gram is not None else x.shape[1] + 1, t.shape[1]), np.float32)
        step, decay = np.float32(4.0), np.float32(1e-5)
        for i in range(rounds):
            out = gram @ v if gram is not None else x @ v[:-1] + v[-1]
            pull = b * t / (1 + np.exp(np.clip(t * out, -30, 30)))
            new = v - step * (decay * v - (pull if gram is not None else np.concatenate([x.T @ pull, pull.sum(0, keepdims=True)])))
            v, w = new + np.float32(i / (i + 3)) * (new - w), new
        return (x.T @ w, w.sum(0)) if gram is not None else (w[:-1], w[-1])

    weight = np.ones(code.shape[1])
    if apart.any() and (~apart).any():
        coef, bias = fit(~apart)
        right = (np.sign(x[apart] @ coef + bias) == code[y[apart]]).mean(0)
        weight = np.maximum(2 * right - 1, 0.05)
    coef, bias = fit(np.ones(len(y), bool))
    return Model(langs, code, weight / weight.sum(), coef.astype(np.float32), bias)


def learn(labelled: DataFrame, per_lang: int = 500, most_rows: int = 4000, most_langs: int = 400) -> Model:
    """Fits on a bounded sample: of each language (the most_langs most frequent, ties by name) the
    per_lang documents with the least hashes of doc_id and text, fewer a language where all would
    pass most_rows; their whole texts count. The sample's size holds whatever the ids are: equal and
    null ids too are ranked within their language, and of rows alike in id and text one counts.

    Workers reduce each text to its counts and one task fits the classifiers; the driver gets the
    fitted model alone, at most FEATURES floats a bit.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_langs), "languages")
    n_langs = n.count()
    each = max(1, min(per_lang, most_rows // max(1, n_langs)))
    # Twice as many as wanted pass the hash, so that texts without letters don't use up the sample;
    # the rank then holds the bound, first within each task.
    h = F.xxhash64("doc_id", "text")
    near = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n") <= 2 * each + 20
    taken = join_checked(rows, n, "lang", "inner", n_langs, 64).where(near & F.col("text").rlike(r"\p{L}")).withColumn("h", h)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "text"))
    taken = taken.select("lang", "h", "doc_id", "text").dropDuplicates(["lang", "h", "doc_id"]).withColumn("at", rank).where(F.col("at") <= each).select("lang", "h", "text")

    def count(batches):
        for b in batches:
            got = [counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([np.flatnonzero(g).astype("<u2").tobytes() for g in got], pa.binary()), pa.array([g[g > 0].astype("<f4").tobytes() for g in got], pa.binary())],
                ["lang", "h", "at", "n"],
            )

    counted = materialize(taken.transform(map_arrow, count, "lang string, h long, at binary, n binary"), "sample")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("lang", "ascending")])
        x = np.zeros((table.num_rows, FEATURES), np.float32)
        for i, (at, c) in enumerate(zip(table.column("at"), table.column("n"))):
            x[i, np.frombuffer(at.as_py(), "<u2")] = np.frombuffer(c.as_py(), "<f4")
        model = train(table.column("lang").to_pylist(), x)
        give_back()
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = counted.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "model binary").collect() if n_langs else []
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros((0, FEATURES), np.float32))


def identify(docs: DataFrame, model: Model, near: float = 0.1) -> DataFrame:
    """Adds lang_pred, score and ambiguous to the documents, from the whole text alone. A null text,
    one without a letter, or a model without languages gives "und", score 0, not ambiguous. Every row
    is judged on its own: repeated rows and null ids get their text's result, columns already named
    like the added ones give way, an empty table gives no rows; of equal scores the first language by
    name wins, and ambiguous says so."""
    keep = docs.drop("lang_pred", "score", "ambiguous")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            pred, score, near_tie = [UNKNOWN] * len(text), np.zeros(len(text)), np.zeros(len(text), bool)
            at = [i for i, t in enumerate(text) if t and m.langs and has_letter(t)]
            for k in range(0, len(at), 256):
                some = at[k : k + 256]
                best, s, a = m.predict(np.stack([counts(text[i]) for i in some]), near)
                for i, j in zip(some, best):
                    pred[i] = m.langs[j]
                score[some], near_tie[some] = s, a
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(near_tie)], [*b.schema.names, "lang_pred", "score", "ambiguous"])

    return keep.transform(map_arrow, run, f"{ddl}, lang_pred string, score double, ambiguous boolean")
