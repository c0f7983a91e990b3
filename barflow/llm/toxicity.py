"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(threshold_k - weight . x): one weight vector serves all thresholds, which are kept in order. Features are the
words of a text, their beginnings and their inner character runs, hashed; x is 1 where a feature occurs and grows with the logarithm
of its mentions, so one mention in a long text still counts. The model is fitted on a bounded sample of labelled documents and is a
few kilobytes; scoring reads every text whole."""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.common import query, read, slices, stored, tidy

#: Hashed feature space; labelled documents per class in the sample; features that stay after selection.
SPACE, PER_CLASS, SELECTED = 1 << 22, 6000, 4096
#: Standard deviations by which a feature's shares of the two classes must lie apart to be selected.
TELLING = 6.0
#: Words whose features a worker remembers: of selected features most words have none, all features of a word take far more room.
_MEMORY, _MEMORY_ALL = 200_000, 30_000
#: Feature counts that a task gathers before it hands them on; bytes of text and rows that are scored together.
_COUNTS, _BYTES, _ROWS = 200_000, 1 << 20, 256
_BAD = 1 << 32
_WORD = re.compile(r"\w+").findall


class Features:
    """Feature numbers of words, remembered; with ``keep`` only those, numbered by their place in it."""

    def __init__(self, keep: np.ndarray | None = None):
        self.place = None if keep is None else {int(f): i for i, f in enumerate(keep)}
        self.known: dict[str, tuple] = {}
        self.room = _MEMORY_ALL if keep is None else _MEMORY

    def of(self, word: str) -> tuple:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > self.room:
                self.known.clear()
            w = f"^{word}$"
            grams = {w, *(w[:k] for k in (4, 5, 6)), *(w[i:i + 4] for i in range(1, len(w) - 3))}
            got = [zlib.crc32(g.encode()) % SPACE for g in grams]
            got = tuple(set(got)) if self.place is None else tuple({self.place[f] for f in got if f in self.place})
            self.known[word] = got
        return got

    def counts(self, text: str) -> dict[int, int]:
        found, of = {}, self.of
        for w in _WORD(text.lower()):
            for f in of(w):
                found[f] = found.get(f, 0) + 1
        return found


def values(found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(found, np.int64, len(found)), 1 + np.log(np.fromiter(found.values(), np.float64, len(found))) / 2


@dataclass
class Model:
    features: np.ndarray        # hashed features with a weight
    weights: np.ndarray
    thresholds: np.ndarray      # ascending; grade k is above k of them
    reject: float               # P(grade > 0) from which a document is rejected

    def grades(self, score: float) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 40)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, n_features: int, l1: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated proximal gradient descent on the mean negative log-likelihood with an L1 penalty.
    Thresholds are a first one plus positive gaps, so they cannot cross."""
    top = int(grade.max())
    lens = np.array([len(a) for a, _ in rows])
    row = np.repeat(np.arange(len(rows)), lens)
    col = np.concatenate([a for a, _ in rows]).astype(np.int64)         # empty lists come without a type
    val = np.concatenate([v for _, v in rows]).astype(np.float64)
    share = np.array([(grade > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    w, t = np.zeros(n_features), np.log((1 - share) / share)
    t = np.maximum.accumulate(t + 1e-3 * np.arange(top))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    # a step of its own for each feature: this diagonal bounds the curvature, features that come together included
    spread = np.bincount(col, val * np.bincount(row, val, len(rows))[row], n_features) / len(rows)
    step, step_t = 2.0 / np.maximum(spread, 1e-9), 1.0
    vw, vt, momentum = w.copy(), t.copy(), 1.0
    for _ in range(rounds):
        s = np.bincount(row, val * vw[col], len(rows))
        hi = np.where(grade < top, sig(vt[np.minimum(grade, top - 1)] - s), 1.0)
        lo = np.where(grade > 0, sig(vt[np.maximum(grade - 1, 0)] - s), 0.0)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gs = (dhi - dlo) / p / len(rows)                    # d(-log p) / ds
        gt = np.zeros(top)
        np.add.at(gt, np.minimum(grade, top - 1), np.where(grade < top, -dhi / p, 0) / len(rows))
        np.add.at(gt, np.maximum(grade - 1, 0), np.where(grade > 0, dlo / p, 0) / len(rows))
        new = vw - step * np.bincount(col, val * gs[row], n_features)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_t = np.maximum.accumulate(vt - step_t * gt)
        new_t += 1e-3 * np.arange(top)                      # strictly ascending
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        vw, vt = new + (momentum - 1) / after * (new - w), np.maximum.accumulate(new_t + (momentum - 1) / after * (new_t - t))
        w, t, momentum = new, new_t, after
    return w, t


def sampled(labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled documents of each class, chosen by the hash of their id: the same ones at any layout."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda cond: one.where(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return pick("toxic > 0").unionByName(pick("toxic <= 0"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` toxic and as many clean labelled documents (by hash of doc_id; a documented bound). Labels say only
    whether a document is toxic, so grades above 0 are thirds of the mentions of telling features: 1 few or none, 3 many.
    None where a class is missing."""
    chosen = F.broadcast(sampled(labels, per_class))        # at most 2 * per_class ids
    sample = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").dropDuplicates(["doc_id"]), "toxic-sample")
    sizes = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("class")).agg(F.count(F.lit(1)).alias("n")).toDF("toxic", "n").collect()}
    if len(sizes) < 2:
        return None

    def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats, seen = Features(), {}

        def handed() -> pa.RecordBatch:
            n = np.fromiter(seen.values(), np.int64, len(seen))
            return pa.RecordBatch.from_pydict({"f": np.fromiter(seen, np.int64, len(seen)), "clean": n % _BAD, "bad": n // _BAD})

        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1)):
                for f in {f for w in set(_WORD(text.as_py().lower())) for f in feats.of(w)}:
                    seen[f] = seen.get(f, 0) + (_BAD if toxic > 0 else 1)         # both counts in one number
                if len(seen) > _COUNTS:
                    yield handed()
                    seen.clear()
        if seen:
            yield handed()

    c, t = sizes[False], sizes[True]
    freq = (sample.select("toxic", "text").mapInArrow(tidy(class_counts), "f long, clean long, bad long").groupBy("f")
            .agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")))
    # how far the shares of the two classes lie apart, in standard deviations of a pooled share
    pooled = (F.col("clean") + F.col("bad") + 1) / (c + t + 2)
    apart = (F.col("bad") / t - F.col("clean") / c) / F.sqrt(pooled * (1 - pooled) * (1 / t + 1 / c))
    telling = freq.where("bad + clean >= 3").withColumn("z", apart).where(F.abs("z") > TELLING).orderBy(F.abs("z").desc(), "f").limit(SELECTED).collect()
    if not telling:
        return None
    keep = np.array([r["f"] for r in telling], np.int64)
    strong = {i for i, r in enumerate(telling) if r["z"] > 0 and r["clean"] * t * 20 < r["bad"] * c}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features(keep)
        for b in batches:
            ids, at, val, mentions = b.column(0), [], [], []
            for text in b.column(2):
                found = feats.counts(text.as_py())
                x, v = values(found)
                at.append(x)
                val.append(v)
                mentions.append(sum(k for f, k in found.items() if f in strong))
            yield pa.RecordBatch.from_arrays([ids, b.column(1), pa.array(at, pa.list_(pa.int64())), pa.array(val, pa.list_(pa.float64())), pa.array(mentions, pa.int64())],
                                             names=["doc_id", "toxic", "at", "val", "mentions"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, at array<bigint>, val array<double>, mentions bigint"
    rows = sample.select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(tidy(vectors), schema).orderBy("doc_id").toPandas()
    mentions, toxic = rows["mentions"].to_numpy(), rows["toxic"].to_numpy() > 0
    cuts = np.quantile(mentions[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (mentions > cuts[0]) + (mentions > cuts[1]), 0)
    _, grade = np.unique(grade, return_inverse=True)        # a third may be empty: grades without gaps
    x = list(zip(rows["at"], rows["val"]))
    # the L1 penalty picks the features, a second fit of those alone undoes its shrinking
    used = np.flatnonzero(np.abs(fit_ordinal(x, grade, len(keep), l1=1e-3)[0]) > 0.02)
    place = np.full(len(keep), -1)
    place[used] = np.arange(len(used))
    x = [(place[a][place[a] >= 0], v[place[a] >= 0]) for a, v in ((np.asarray(a, np.int64), np.asarray(v)) for a, v in x)]
    w, thresholds = fit_ordinal(x, grade, len(used), l1=1e-5)
    return Model(keep[used], w, thresholds, best_cut(1 / (1 + np.exp(thresholds[0] - np.array([w[a] @ v for a, v in x]))), toxic))


def best_cut(p: np.ndarray, toxic: np.ndarray, clean_counts: int = 5) -> float:
    """The cut with the smallest loss on the sample, where a clean document rejected counts as ``clean_counts`` toxic ones kept; the
    middle of the gap it lies in."""
    order = np.argsort(p)
    p, toxic = p[order], toxic[order]
    loss = np.concatenate([[0], np.cumsum(toxic)]) + clean_counts * np.concatenate([np.cumsum(~toxic[::-1])[::-1], [0]])
    loss[1:-1][p[1:] == p[:-1]] = len(p) * (1 + clean_counts)       # no cut between equals
    k = int(np.argmin(loss))
    return float((p[max(k - 1, 0)] + p[min(k, len(p) - 1)]) / 2)


class Scorer:
    """Severity, P(grade > 0) and verdict of texts."""

    def __init__(self, model: Model | None):
        self.model, self.features = model, Features(model.features) if model else None

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[float], list[bool]]:
        severity, p = [], []
        for text in texts:
            above, found = np.zeros(1), self.features.counts(text or "") if self.model else {}
            if found:       # without a feature there is no evidence
                at, v = values(found)
                above = self.model.grades(float(self.model.weights[at] @ v))
            severity.append(float(above.sum()))
            p.append(float(above[0]))
        return severity, p, [not x or x < self.model.reject for x in p]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, severity (expected grade), p_toxic (P(grade > 0)), kept (p_toxic below the model's cut) for every row.

    NULL, empty and blank texts and those without a feature of the model carry no evidence: severity 0, kept. Without a model (a class
    without labels) the same holds for all. Repeated rows are scored one by one; empty tables give no rows; other columns are not read."""
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()),
                        T.StructField("kept", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)        # at most SELECTED features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Scorer(shared.value)
        for s in (b.slice(x, y - x) for b in batches for x, y in slices(b.column(1), _BYTES, _ROWS)):
            severity, p, kept = judge(s.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(severity, pa.float64()), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), out)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, all columns as they were; no shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Scorer(shared.value)
        for s in (b.slice(x, y - x) for b in batches for x, y in slices(b.column(at), _BYTES, _ROWS)):
            yield s.filter(pa.array(judge(s.column(at).to_pylist())[2], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
