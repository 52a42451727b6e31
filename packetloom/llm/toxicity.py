"""Toxicity by the nearest labelled examples under exact TF-IDF cosine over selected terms.

Terms are words and their heads of three to nine letters. A bounded sample of labelled documents picks the
terms whose presence tells the labels apart, and only those make up the vectors; frequencies of
those terms are counted over all documents. What the selection costs and gains is in the README.
The examples' unit vectors form an inverted index in blocks of similar examples; for each term a
block's largest weight bounds what its members can reach. The blocks of highest bound are evaluated
first, then all whose bound reaches the worst of the nearest found, so the nearest are exact.
Their votes, weighted by cosine against a prior, go through a logistic curve fitted on the
examples themselves, each without its own vote. When all documents are scored, an example meets
itself like any other text as near: ids are no input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._shared import table, written
from packetloom.llm.line_quality import labelled

#: Most labelled documents of each label.
SAMPLE = 4000
#: Most terms, how many standard errors apart the labels' shares must be for each, and how
#: closely its presence must go with the label (a correlation), which doesn't grow with the sample.
TERMS = 20_000
APART = 4.0
EFFECT = 0.07
#: In how many examples a term must be.
LEAST = 6
NEAREST = 15
BLOCK = 32
#: Blocks that are evaluated before any bound can be held against what was found.
FIRST = 8
HEADS = range(3, 10)
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    """A word and its heads of three to nine letters, which are marked by a star."""
    return [word, *(word[:k] + "*" for k in HEADS if len(word) > k)]


def terms(text: str | None) -> list[str]:
    """The distinct terms of a text."""
    return sorted({t for w in set(_WORD.findall((text or "").lower())) for t in parts(w)})


class _Known(dict):
    """Word -> numbers of its terms that are in the vocabulary; emptied when it grows large."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = tuple(self.vocabulary[t] for t in parts(word) if t in self.vocabulary)
        return found


class Index:
    """Unit vectors of the examples in blocks, with the largest weight of each term in each block."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_terms: int):
        heaviest = [(int(t[np.argmax(w)]), -float(w.max()), k) if len(t) else (n_terms, 0.0, k) for k, (t, w) in enumerate(vectors)]
        order = [k for *_, k in sorted(heaviest) if len(vectors[k][0])]
        self.ids, self.y, self.weight = ids[order], y[order].astype(float), weight[order]
        empty = [k for k in range(len(ids)) if not len(vectors[k][0])]
        w, p = weight[empty].sum(), (weight[empty] * y[empty]).sum()
        self.prior = float((p + 0.02) / (w + 1.0))
        n = len(order)
        self.n_blocks = -(-n // BLOCK)
        t = np.concatenate([vectors[k][0] for k in order] or [np.empty(0, np.int64)])
        v = np.concatenate([vectors[k][1] for k in order] or [np.empty(0)])
        e = np.repeat(np.arange(n), [len(vectors[k][0]) for k in order])
        by = np.lexsort((e, t))
        self.t, self.v, self.e = t[by], v[by], e[by]
        slot = self.t * self.n_blocks + self.e // BLOCK
        #: Postings of a term's block k are ``at[term * n_blocks + k]`` up to the next of ``at``.
        self.at = np.searchsorted(slot, np.arange(n_terms * self.n_blocks + 1)).astype(np.int32)
        most = np.zeros(n_terms * self.n_blocks, np.float32)
        held = np.flatnonzero(np.diff(self.at))
        if len(held):  # rounded upwards, as a bound must be
            most[held] = np.nextafter(np.maximum.reduceat(self.v, self.at[held]).astype(np.float32), np.float32(2))
        self.most = most.reshape(n_terms, self.n_blocks)

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the ``k`` nearest with a positive cosine, highest first, ties by place."""
        found_e, found_c, worst = np.empty(0, np.int64), np.empty(0), 0.0
        if not len(t) or not self.n_blocks:
            return found_e, found_c
        bound = (w.astype(np.float32) @ self.most[t]).astype(float) * (1 + 1e-4) + 1e-9  # more than single precision can be off
        ranked = np.argsort(-bound)
        rest = ranked[FIRST:]
        for some in (ranked[:FIRST], rest):
            if some is rest:
                some = rest[bound[rest] >= worst]
            places = ((t * self.n_blocks)[:, None] + some).ravel()
            size = self.at[places + 1] - self.at[places]
            held = np.flatnonzero(size)
            if not len(held):
                continue
            posts = _ranges(self.at[places[held]].astype(np.int64), self.at[places[held] + 1].astype(np.int64))
            total = np.bincount(self.e[posts], np.repeat(w[held // len(some)], size[held]) * self.v[posts])
            if 0 <= without < len(total):
                total[without] = 0
            hit = np.flatnonzero((total > 0) & (total >= worst))
            found_e, found_c = np.append(found_e, hit), np.append(found_c, total[hit])
            best = np.lexsort((found_e, -found_c))[:k]
            found_e, found_c = found_e[best], found_c[best]
            worst = found_c[-1] if len(found_c) >= k else 0.0
        return found_e, found_c

    def raw(self, e: np.ndarray, c: np.ndarray) -> float:
        """Log odds of the votes: cosines times sampling weights, beside a prior of half a vote."""
        votes = c * self.weight[e]
        p = (float((votes * self.y[e]).sum()) + 0.5 * self.prior) / (float(votes.sum()) + 0.5)
        p = min(1 - 1e-4, max(1e-4, p))
        return math.log(p / (1 - p))


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers of the ranges a[k]..b[k]-1, one after another."""
    n = b - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def unit(t: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector of terms ``t`` with counts ``n``."""
    w = (1 + np.log(np.maximum(n, 1))) * idf[t]
    norm = math.sqrt(float(w @ w)) if len(w) else 1.0
    return t, w / (norm or 1.0)


def frequencies(n_terms: int):
    """For ``mapInPandas``: in how many documents of the task each term is, a row per term and none per document."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(n_terms, np.int64)
        for b in batches:
            n += np.bincount(np.concatenate([np.empty(0, np.int64), *b["t"]]).astype(np.int64), minlength=n_terms)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"t": at, "n": n[at]})

    return summed


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, most_terms: int = TERMS, apart: float = APART, least: int = LEAST, effect: float = EFFECT) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of ``docs``.

    ``evidence`` lists the ids of the nearest toxic examples among the neighbours. The fit is
    bounded by ``sample`` documents of each label, ``most_terms`` terms, and the terms' limits
    ``apart``, ``effect`` and ``least``; every text is scored, whatever its length. A text without any of the terms
    (null and empty texts too) scores as the examples without any do. Repeated rows are scored each on
    their own; of several texts under one labelled id the first in order is the example. Without
    labelled rows all scores are alike. Other columns of ``docs`` aren't read, and of ``labels``
    only doc_id and toxic are, so their names don't matter.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def termed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "term": [terms(t) for t in b["text"]]})

    examples = written(labelled(docs, labels, "toxic", sample), "examples")
    of = {r.y: r.n for r in examples.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = of.get(0, 0), of.get(1, 0)
    train = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("y"))
    known = train.join(docs.select("doc_id"), F.col("label_id") == F.col("doc_id"), "left_semi")  # labels of documents there are, each once
    all_of = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("y").isin(0, 1)).collect()}
    weight_of = {y: max(1, all_of.get(y, 1)) / max(1, of.get(y, 1)) for y in (0, 1)}
    stats = examples.mapInPandas(termed, "y int, term array<string>").select("y", F.explode("term").alias("term"))  # terms of the sample only
    stats = stats.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1.0), (F.col("n") - F.col("n1") + 0.5) / (n0 + 1.0)
    p = (F.col("n") + 1.0) / (n0 + n1 + 2.0)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / (n1 + 1.0) + 1 / (n0 + 1.0)))
    chosen = stats.filter(F.col("n") >= least).withColumn("z", F.abs(z)).filter(F.col("z") >= max(apart, effect * math.sqrt(n0 + n1)))
    best = [r.term for r in chosen.orderBy(F.desc("z"), "term").limit(most_terms).collect()]
    vocabulary = {t: k for k, t in enumerate(sorted(best))}
    shared = spark.sparkContext.broadcast(vocabulary)  # at most ``most_terms`` words

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(shared.value)
        for b in batches:
            t, n = [], []
            for text in b["text"]:
                own: Counter = Counter()
                for w, m in Counter(_WORD.findall((text or "").lower())).items():
                    for x in known[w]:
                        own[x] += m
                items = sorted(own.items())
                t.append([x for x, _ in items])
                n.append([x for _, x in items])
            yield pd.DataFrame({**{c: b[c] for c in b.columns if c != "text"}, "t": t, "n": n})

    rows = written(docs.select("doc_id", "text").mapInPandas(counted, f"doc_id {kind}, t array<int>, n array<int>"), "counted")
    total = rows.count()
    df = np.zeros(len(vocabulary))
    for r in rows.select("t").mapInPandas(frequencies(len(vocabulary)), "t int, n bigint").groupBy("t").agg(F.sum("n")).collect():  # at most ``most_terms`` rows
        df[r[0]] = r[1]
    idf = np.log((1 + total) / (1 + df)) + 1
    vectors = examples.select(F.col("doc_id").alias("of_id"), "y", "text").mapInPandas(counted, f"of_id {kind}, y int, t array<int>, n array<int>")
    got = sorted(vectors.collect(), key=lambda r: r.of_id)  # at most 2 * sample short vectors
    units = [unit(np.array(r.t, np.int64), np.array(r.n, float), idf) for r in got]
    index = Index(np.array([r.of_id for r in got]), np.array([r.y for r in got]), units, np.array([weight_of[r.y] for r in got]), len(vocabulary))
    place = {i: k for k, i in enumerate(index.ids.tolist())}
    raws, truth, heavy = [], [], []
    for r, (t, w) in zip(got, units, strict=True):
        raws.append(index.raw(*index.nearest(t, w, without=place.get(r.of_id, -1))))
        truth.append(r.y)
        heavy.append(weight_of[r.y])
    slope, offset = _curve(np.array(raws), np.array(truth, float), np.array(heavy))
    sent = spark.sparkContext.broadcast((index, idf, slope, offset))  # at most 2 * sample examples of ``most_terms`` terms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, idf, slope, offset = sent.value
        for b in batches:
            scores, evidence = [], []
            for t, n in zip(b["t"], b["n"], strict=True):
                e, c = index.nearest(*unit(np.asarray(t, np.int64), np.asarray(n, float), idf))
                scores.append(1 / (1 + math.exp(-(slope * index.raw(e, c) + offset))))
                evidence.append(index.ids[e[index.y[e] == 1]].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "evidence": evidence})

    out = rows.mapInPandas(run, f"doc_id {kind}, score double, evidence array<{kind}>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression on one number; near the identity with few examples."""
    a, b = 1.0, 0.0
    if len(x) < 20 or y.min() == y.max():
        return a, b
    weight = weight / weight.mean()
    for _ in range(60):  # Newton's method with a little shrinkage towards the identity
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (y - p) * x).sum() - (a - 1), (weight * (y - p)).sum() - 0.1 * b])
        s = weight * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = max(0.1, a + float(step[0])), b + float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
