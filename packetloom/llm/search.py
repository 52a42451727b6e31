"""Ranked lexical search: exact top documents of every item, term at a time with limited accumulators.

A first scan turns each text into the counts of those of its terms that some item asks for, and
tells the collection's figures. The second job reads only these counts. Each task inverts them in
blocks of documents and takes an item's terms in turn, the rarest first. A document gets an
accumulator when one of these terms is met in it, until what the remaining terms can add at most
in this block is less than the k-th best score so far; from then on only documents that have an
accumulator are brought up to date, so their scores are whole. A block in which all terms
together can't reach the k-th best is passed over. Each task hands on its k best per item, and
the best of those are the result. Documents, not terms, are dealt among tasks, so a term that
every text holds is no one's burden.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm._shared import LOWER, UPPER, table, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents returned per item, and documents that are inverted at once.
BEST = 20
BLOCK = 8192
#: Terms of items that one pass over the documents answers; more items take more passes.
PASS_TERMS = 200_000
_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_PLAIN).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """The items of one pass: their ids, and each one's terms, rarest first, with repeats counted."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        self.texts = [Counter(terms(t)) for _, t in rows]
        self.place = {t: k for k, t in enumerate(sorted({t for own in self.texts for t in own}))}
        self.terms: list[tuple[np.ndarray, np.ndarray]] = []

    def rank(self, df: np.ndarray) -> None:
        """Order each item's terms by the number of documents that hold them; those in none go."""
        for own in self.texts:
            found = sorted((int(df[self.place[t]]), self.place[t], q) for t, q in own.items() if df[self.place[t]])
            self.terms.append((np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64)))


class Best:
    """The k best documents of each item within a task."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [[] for _ in range(n)]

    def floor(self, item: int) -> int:
        """The least score that still counts."""
        return self.found[item][-1][0] if len(self.found[item]) == self.k else 1

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, docs: list) -> None:
        rows = self.found[item] + list(zip(scores.tolist(), (docs[x] for x in ids.tolist()), strict=True))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        self.found[item] = rows[: self.k]


def accumulate(t: np.ndarray, f: np.ndarray, doc: np.ndarray, m: np.ndarray, docs: list, items: Items, w: np.ndarray, best: Best) -> int:
    """Take one block of documents into ``best``; returns how many accumulators were made.

    ``t``, ``f`` and ``doc`` are the postings (term, count, place of the document in ``docs``),
    ``m`` the documents' length terms, ``w`` the terms' weights.
    """
    order = np.argsort(t, kind="stable")
    t, f, doc = t[order], f[order].astype(np.int64), doc[order]
    value = w[t] * ((1_000_000_000 * f) // (1000 * f + 12 * m[doc]))
    start = np.searchsorted(t, np.arange(len(w) + 1))
    held = np.flatnonzero(np.diff(start))
    most = np.zeros(len(w), np.int64)
    if len(held):
        most[held] = np.maximum.reduceat(value, start[held])
    made = 0
    for item, (own, times) in enumerate(items.terms):
        bounds = times * most[own]
        left = np.cumsum(bounds[::-1])[::-1].tolist()  # what a term and all after it can add
        least = best.floor(item)
        if not left or left[0] < least:
            continue
        acc, open_ = np.zeros(len(docs), np.int64), True
        for x, q, rest in zip(own.tolist(), times.tolist(), left, strict=True):
            a, b = int(start[x]), int(start[x + 1])
            if a == b or not w[x]:
                continue
            open_ = open_ and rest >= least
            d, v = doc[a:b], value[a:b] * q
            if not open_:
                kept = acc[d] > 0
                d, v = d[kept], v[kept]
            acc[d] += v
            if open_ and len(docs) > best.k:
                least = max(least, int(np.partition(acc, len(docs) - best.k)[len(docs) - best.k]))
        at = np.flatnonzero(acc)
        made += len(at)
        best.add(item, acc[at[acc[at] >= least]], at[acc[at] >= least], docs)
    return made


def search(docs: DataFrame, items: DataFrame, k: int = BEST, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best rows of ``docs`` for each row of ``items``.

    Ties go to the smaller doc_id, null last. Rows that repeat an id are ranked each on their own,
    in ``docs`` as in ``items``; repeated rows of ``items`` count once. Null, empty and blank
    texts hold no terms: such a document is in no figure and no result, such an item has none.
    Texts of any length are counted whole. An empty table on either side gives no rows. Only the
    id and the text are read, so other columns don't matter. Items beyond ``pass_terms`` terms are
    answered in several passes over the documents, so what is sent to the tasks stays bounded
    (by one item's terms, if that has more).
    """
    spark = docs.sparkSession
    kind, of = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").distinct()
    total = asked.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 0
    n_passes = max(1, -(-total // pass_terms))
    out = None
    for p in range(n_passes):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_passes)) == p)
        found = _one_pass(spark, docs.select("doc_id", "text"), Items([tuple(r) for r in part.collect()]), k, kind, of)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("n_pass", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _one_pass(spark: SparkSession, docs: DataFrame, items: Items, k: int, kind: str, of: str) -> DataFrame:
    place = spark.sparkContext.broadcast(items.place)  # at most ``pass_terms`` terms

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        for b in batches:
            at, n, t, f = [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                own = terms(text)
                if own:
                    of_own = [(known[x], c) for x, c in Counter(own).items() if x in known]
                    at.append(k), n.append(len(own)), t.append([x for x, _ in of_own]), f.append([c for _, c in of_own])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (t, f)]
            yield pa.record_batch([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "t", "f"])

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that hold each term, then all documents (-1) and all their terms (-2)."""
        df, n_docs, length = np.zeros(len(place.value), np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column("t").flatten().to_numpy(zero_copy_only=False), minlength=len(df))
            n_docs, length = n_docs + b.num_rows, length + int(b.column("n").to_numpy().sum())
        at = np.flatnonzero(df)
        yield pa.record_batch({"t": np.append(at, [-1, -2]), "n": np.append(df[at], [n_docs, length])})

    rows = written(docs.mapInArrow(counted, f"doc_id {kind}, n bigint, t array<int>, f array<int>"), "postings")
    got = {r[0]: r[1] for r in rows.mapInArrow(figures, "t bigint, n bigint").groupBy("t").agg(F.sum("n")).collect()}
    n_docs, length = got.get(-1, 0), max(1, got.get(-2, 0))
    df = np.zeros(len(items.place), np.int64)
    for t, n in got.items():
        if t >= 0:
            df[t] = n
    items.rank(df)
    w = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    sent = spark.sparkContext.broadcast((items, w))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = sent.value
        best = Best(len(items.ids), k)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = b.slice(at, BLOCK)
                t, f = (x.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "f"))
                sizes = np.diff(x.column("t").offsets.to_numpy())
                m = 75 + (25 * x.column("n").to_numpy() * n_docs) // length
                accumulate(t, f, np.repeat(np.arange(len(sizes)), sizes), m, x.column("doc_id").to_pylist(), items, w, best)
        lines = [(p, items.ids[p], i, s) for p, own in enumerate(best.found) for s, i in own]
        schema = pa.schema([("item", pa.int32()), ("item_id", item_type), ("doc_id", doc_type), ("score", pa.int64())])
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*lines, strict=True), schema, strict=True)] if lines else [pa.array([], f.type) for f in schema], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type, doc_type = (to_arrow_type(spark.createDataFrame([], f"x {x}").schema["x"].dataType) for x in (of, kind))
    return rows.mapInArrow(ranked, f"item int, item_id {of}, doc_id {kind}, score bigint").withColumn("n_pass", F.lit(rows._packetloom_path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents), k AS (SELECT r, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM k),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM k) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score FROM p JOIN q USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= {BEST}"""
