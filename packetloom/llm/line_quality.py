"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Measures of the line and of its neighbours, in buckets, score its
state; a transition matrix ties neighbours together. The field is fitted on a bounded sample of
labelled documents whose lines take the document's label. A document's quality is the mean of
its lines' marginal probabilities, weighted by length, put through a fitted logistic curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm._shared import sample_by_hash, table, written

#: Most labelled documents to fit on, of each label.
SAMPLE = 1500
#: Lines to fit on in all: documents of any length come in until so many are reached.
SAMPLE_LINES = 200_000
THRESHOLD = 0.3
#: Bucket edges of each measure.
EDGES = (
    (0.5, 1.5, 3.5, 7.5, 15.5, 40.5),  # words
    (0.005, 0.02, 0.06, 0.15),  # symbols by character
    (0.02, 0.1, 0.3),  # bars by word
    (0.05, 0.3, 0.8),  # bangs by word
    (0.05, 0.15, 0.5),  # capitals by character
    (0.02, 0.1, 0.3),  # digits by character
    (2.5, 4.0, 6.5, 9.0),  # characters by word
    (0.02, 0.2, 0.5),  # words equal to the one before
    (0.5,),  # ends a sentence
    (0.5,),  # equal to an earlier line
)
#: Measures whose buckets in the lines before and after count too.
AROUND = (0, 1, 2, 3, 4, 7, 9)
BUCKETS = max(map(len, EDGES)) + 1
N_FEATURES = len(EDGES) + 2 * len(AROUND)
_CLASSES = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"#*$%&|<>", b"|", b"!", bytes(range(65, 91)), bytes(range(48, 58)), b" \t\r\x0b\x0c")):
    for _c in _chars:
        _CLASSES[_c] |= 1 << _k


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature of each line with a word, characters of those lines)."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, N_FEATURES), np.int8), np.zeros(0)
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    bits = _CLASSES[np.frombuffer(b"".join(raw), np.uint8)]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(sizes) - sizes
    symbols, bars, bangs, capitals, digits, spaces = (np.add.reduceat((bits >> k) & 1, starts, dtype=np.int64) for k in range(6))
    n_words, repeats, final, again, seen = [], [], [], [], set()
    for x in lines:
        w = x.split()
        n_words.append(len(w))
        repeats.append(sum(map(str.__eq__, w, w[1:])))
        final.append(w[-1][-1] in ".!?\"'")
        again.append(x in seen)
        seen.add(x)
    words, solid = np.maximum(np.array(n_words, float), 1), np.maximum(sizes - spaces, 1)
    measures = (words, symbols / solid, bars / words, bangs / words, capitals / solid, digits / solid, solid / words, np.array(repeats) / words, np.array(final, float), np.array(again, float))
    own = [np.digitize(m, e) for m, e in zip(measures, EDGES, strict=True)]
    for k in AROUND:
        own.append(np.concatenate([[BUCKETS - 1], own[k][:-1]]))
        own.append(np.concatenate([own[k][1:], [BUCKETS - 1]]))
    return np.stack(own, axis=1).astype(np.int8), solid.astype(float)


class Field:
    """Weights of the field: of each feature's bucket for "good", and of the four transitions."""

    def __init__(self) -> None:
        self.emit, self.bias, self.move = np.zeros((N_FEATURES, BUCKETS)), 0.0, np.zeros((2, 2))
        self.slope, self.offset = 6.0, -3.0

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability that each line is good, expected transition counts), by forward-backward."""
        n = len(x)
        score = self.bias + self.emit[np.arange(N_FEATURES), x].sum(axis=1)
        good = np.exp(np.clip(score, -30, 30)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.move).tolist()
        ahead = []
        b, g = 1.0, good[0]
        for t in range(n):
            if t:
                b, g = b * bb + g * gb, (b * bg + g * gg) * good[t]
            s = b + g
            b, g = b / s, g / s
            ahead.append((b, g))
        p, moves = [0.0] * n, np.zeros((2, 2))
        rb = rg = 1.0
        for t in range(n - 1, -1, -1):
            b, g = ahead[t]
            zb, zg = b * rb, g * rg
            p[t] = zg / (zb + zg)
            if t:
                pb, pg = ahead[t - 1]
                e = good[t]
                m = (pb * bb * rb, pb * bg * e * rg, pg * gb * rb, pg * gg * e * rg)
                s = sum(m)
                moves += np.array(m).reshape(2, 2) / s
                rb, rg = bb * rb + bg * e * rg, gb * rb + gg * e * rg
                s = rb + rg
                rb, rg = rb / s, rg / s
        return np.array(p), moves

    def raw(self, x: np.ndarray, size: np.ndarray) -> float:
        """Mean probability of "good" over the characters of a document; one half without lines."""
        return float(np.average(self.marginals(x)[0], weights=size)) if len(x) else 0.5

    def score(self, x: np.ndarray, size: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.raw(x, size) + self.offset))))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 6, rate: float = 0.5) -> Field:
    """A field by adaptive stochastic gradient on the labelled line sequences, and its logistic curve."""
    field, rng = Field(), np.random.Generator(np.random.PCG64(5))
    data = [e for e in examples if len(e[0])]
    seen, seen_move, seen_bias = np.full((N_FEATURES, BUCKETS), 1.0), np.full((2, 2), 1.0), 1.0
    columns = np.arange(N_FEATURES)
    for _ in range(rounds):
        for k in rng.permutation(len(data)):
            x, size, y = data[k]
            p, moves = field.marginals(x)
            gap = (y - p) / math.sqrt(len(x))  # long documents don't drown short ones
            g = np.zeros((N_FEATURES, BUCKETS))
            np.add.at(g, (np.broadcast_to(columns, x.shape), x), gap[:, None])
            own = np.zeros((2, 2))
            own[y, y] = len(x) - 1
            gm = (own - moves) / math.sqrt(len(x))
            g -= 1e-3 * field.emit
            seen, seen_move, seen_bias = seen + g**2, seen_move + gm**2, seen_bias + gap.sum() ** 2
            field.emit += rate * g / np.sqrt(seen)
            field.move = np.clip(field.move + 0.2 * rate * gm / np.sqrt(seen_move), -2, 2)
            field.bias += rate * gap.sum() / math.sqrt(seen_bias)
    if data:
        z, y = np.array([field.raw(x, size) for x, size, _ in data]), np.array([e[2] for e in data], float)
        a, b = field.slope, field.offset
        for _ in range(500):  # logistic regression on one number, with a little shrinkage
            p = 1 / (1 + np.exp(-(a * z + b)))
            a += 2.0 * (np.mean((y - p) * z) - 1e-4 * a)
            b += 2.0 * np.mean(y - p)
        field.slope, field.offset = float(a), float(b)
    return field


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` training documents of each label, by a hash of their id.

    Of several texts under one id the first in order stands for all. The join's small side has
    at most ``2 * most`` rows, so it may be broadcast.
    """
    train = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).filter(F.col(label).isin(0, 1))
    train = train.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(label).cast("int").alias("y"))
    of = lambda y: sample_by_hash(train.filter(F.col("y") == y), ["label_id"], most)
    picked = of(0).unionByName(of(1))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    return found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines) for every row of ``docs``.

    The fit takes at most ``sample`` documents of each label, in order of a hash of their id and
    whatever their length, until their lines reach ``sample_lines``. A text without lines (null,
    empty, blank) has a raw quality of one half. Repeated rows are scored each on their own. Without labelled rows every weight is zero. Other columns of
    ``docs`` aren't read; of ``labels`` only doc_id and quality are.
    """

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, y, *features(t)) for i, y, t in zip(b["place"], b["y"], b["text"], strict=True)]
            yield pd.DataFrame([(i, y, x.tobytes(), s.tolist()) for i, y, x, s in rows], columns=["place", "y", "x", "size"])

    examples = labelled(docs, labels, "quality", sample).select(F.xxhash64("doc_id").alias("place"), "y", "text")
    chosen = written(examples.mapInPandas(measured, "place bigint, y int, x binary, size array<double>"), "examples")
    before = F.sum(F.size("size")).over(Window.orderBy("place", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size("size")
    few = chosen.select("place", "x", "size", "y", before.alias("before"))  # one window over at most 2 * sample rows
    chosen = few.filter(F.col("before") < sample_lines)
    rows = sorted((r.y, bytes(r.x), tuple(r.size)) for r in chosen.collect())  # at most 2 * sample rows
    field = fit([(np.frombuffer(x, np.int8).reshape(-1, N_FEATURES), np.array(s), y) for y, x, s in rows])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [field.score(*e) for e in each], "n_lines": [len(e[0]) for e in each]})

    out = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, n_lines bigint")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
