"""Near-duplicate documents by SimHash and Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the bitwise majority over the hashes of its four-word
shingles. Two fingerprints link if they differ in at most four bits; the components of those
links are the groups of near copies.

Finding the links. The 64 bits are cut into three segments A, B, C of 22, 21 and 21 bits, each
read as a word of the perfect binary Golay code [23, 12, 7]. The indices of all codewords
within four bits of a segment (one or six of them) are its fuzzy keys: two segments that differ
in at most two bits have a midpoint one bit from both, and the codeword within three bits of
that midpoint is a key of both. Four errors over three segments leave two cases:

* some segment X has none; then another, Y, has at most two: key (X exact, fuzzy Y);
* every segment has one at least; then two segments have exactly one and the third, Z, at most
  two: key (one half of X exact, one half of Y exact, fuzzy Z).

These are 18 kinds of key of 33 bits or more. Fingerprints with a common key are compared;
those with more than ``RUN`` companions under one key are linked through the points within two
bits of them instead: fingerprints at most four bits apart, and no others, share such a point,
so every group under a point is linked whole and a star per point is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._shared import LOWER, UPPER, forget, fresh, table, written

SHINGLE = 4
SEED = 42
BITS = 4
#: Fingerprints under one key up to which all are compared with each other, within one task.
RUN = 1024
#: (first bit, bits) of the segments, from the lowest bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the cyclic binary Golay code (fixed value).
GOLAY = 0b110001110101
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned number; 0 where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - SHINGLE].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, fp) of every row, with the text's ``digest`` if asked for; fp is the fingerprint as a signed long."""
    more = ["digest"] if digest else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp, **{m: b[m] for m in more}})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[text_digest(docs[text_col]).alias(m) for m in more])
    return rows.mapInPandas(run, f"id {kind}, fp bigint" + "".join(f", {m} string" for m in more))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainder of each 12-bit index, and per remainder the error patterns of up to four bits."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    of_index = np.array([remainder(m << 11) for m in range(4096)], dtype=np.int64)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            found[int(of_index[e >> 11]) ^ (e & 2047)].append(e)
    count = np.array([len(x) for x in found])
    patterns = np.zeros((2048, count.max()), np.int64)
    for s, x in enumerate(found):
        patterns[s, : len(x)] = x
    return of_index, patterns, count


OF_INDEX, PATTERNS, N_PATTERNS = _golay_tables()


def fuzzy(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every codeword within four bits of each 23-bit word."""
    s = OF_INDEX[segment >> 11] ^ (segment & 2047)
    n = N_PATTERNS[s]
    row = np.repeat(np.arange(len(segment)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (segment[row] ^ PATTERNS[s[row], nth]) >> 11


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of fingerprints that are given as uint64."""
    seg = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    indexed = [fuzzy(x) for x in seg]
    half = [(x & 1023, x >> 10) for x in seg]
    rows, keys, kind = [], [], 0
    for z, (row, index) in enumerate(indexed):
        x, y = (k for k in range(3) if k != z)
        exact = [seg[x], seg[y], *((half[x][i] << 12) | half[y][j] for i in (0, 1) for j in (0, 1))]
        for value in exact:
            rows.append(row)
            keys.append((np.int64(kind) << 40) | (value[row] << 12) | index)
            kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def _near_points(fp: np.ndarray) -> np.ndarray:
    """All points within two bits of one fingerprint."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    flips = np.concatenate([[np.uint64(0)], one, [a | b for a, b in combinations(one, 2)]]).astype(np.uint64)
    return fp ^ flips


def _runs(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows sorted by key, as (key, fp, hot) blocks that end with a whole key.

    A key with more than ``most`` rows comes as blocks of its own, marked hot.
    """
    key, fp, hot = np.array([], np.int64), np.array([], np.int64), None
    for b in batches:
        key, fp = np.concatenate([key, b["key"].to_numpy()]), np.concatenate([fp, b["fp"].to_numpy()])
        cuts = np.flatnonzero(np.diff(key)) + 1
        if hot is not None:
            n = int(np.searchsorted(key != hot, True)) if (key != hot).any() else len(key)
            if n:
                yield key[:n], fp[:n], True
            key, fp = key[n:], fp[n:]
            hot = hot if not len(key) else None
            cuts = np.flatnonzero(np.diff(key)) + 1
        if not len(key):
            continue
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield from _split(key[:last], fp[:last], most)
        key, fp = key[last:], fp[last:]
        if len(key) > most:
            hot = key[0]
            yield key, fp, True
            key, fp = key[:0], fp[:0]
    if len(key):
        yield from _split(key, fp, most)


def _split(key: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    large = np.repeat(sizes > most, sizes)
    if large.any():
        yield key[large], fp[large], True
        key, fp = key[~large], fp[~large]
    yield key, fp, False


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) from the first to each other one of those that verified links join under a key; (a, null) for members of hot keys."""
    for key, fp, hot in _runs(batches, RUN):
        if hot:
            members = np.unique(fp)
            yield pd.DataFrame({"a": members, "b": pd.array([None] * len(members), dtype="Int64")})
            continue
        left, right, at, bits = [], [], np.arange(len(key)), fp.view(np.uint64)
        for d in range(1, RUN):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            near = at[np.bitwise_count(bits[at] ^ bits[at + d]) <= BITS]
            left.append(near)
            right.append(near + d)
        root = _roots(len(key), np.concatenate([[], *left]).astype(np.int64), np.concatenate([[], *right]).astype(np.int64))
        links = np.stack([fp[root], fp], axis=1)[root != np.arange(len(key))]
        if len(links):
            links = np.unique(links, axis=0)
            yield pd.DataFrame({"a": links[:, 0], "b": pd.array(links[:, 1], dtype="Int64")})


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first of the rows that links join, for each of ``n`` rows."""
    root = np.arange(n)
    while len(left):
        least, new = np.minimum(root[left], root[right]), root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _starred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A link from the first fingerprint under each point to every other one there."""
    key = fp = None
    for b in batches:
        keys, fps = b["key"].to_numpy(), b["fp"].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        firsts = fps[starts].copy()
        if key is not None and keys[0] == key:
            firsts[0] = fp
        first = np.repeat(firsts, np.diff(np.concatenate([starts, [len(keys)]])))
        key, fp = keys[-1], firsts[-1]
        links = np.unique(np.stack([first, fps], axis=1)[first != fps], axis=0)
        if len(links):
            yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all links."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            for k in range(0, len(fp), 2048):
                part = fp[k : k + 2048]
                row, key = keys_of(part.view(np.uint64))
                yield pd.DataFrame({"key": key, "fp": part[row]})

    def pointed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["fp"].to_numpy():
                yield pd.DataFrame({"key": _near_points(np.int64(x).view(np.uint64)).view(np.int64), "fp": x})

    rows = distinct.select("fp").mapInPandas(keyed, "key bigint, fp bigint")
    found = written(rows.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_compared, "a bigint, b bigint"), "links")
    near = found.filter("b IS NOT NULL").distinct()
    hot = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return near
    points = hot.mapInPandas(pointed, "key bigint, fp bigint").repartition("key").sortWithinPartitions("key", "fp")
    return near.union(points.mapInPandas(_starred, "a bigint, b bigint")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); equal labels mean the same component.

    Each round hooks every node to its least neighbour, shortens the chains of hooks and
    contracts the edges, until none is left. Rounds are written to the shared folder, so a lost
    executor costs one round at most.
    """
    edges, maps = written(edges.filter("a <> b"), "edges"), []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        hooks = hooks.select("node", F.least("node", "to").alias("to"))
        for _ in range(2):
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("up"))
            hooks = hooks.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to"))
        hooks = written(hooks, "hooks")
        maps.append(hooks)
        of = lambda c: hooks.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        shorter = edges.join(of("a"), "a").join(of("b"), "b").filter("to_a <> to_b")
        before = edges
        edges = written(shorter.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        forget(before)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = maps[0].select("node", F.col("to").alias("label"))
    for later in maps[1:]:
        step = later.select(F.col("node").alias("label"), "to")
        out = out.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return out


def _labelled(distinct: DataFrame, first: str) -> DataFrame:
    """(fp, ``first``, label) of the distinct fingerprints; the label is one for each group of linked ones."""
    distinct = written(distinct, "distinct")
    label = components(links(distinct)).select(F.col("node").alias("fp"), "label")
    return written(distinct.join(label, "fp", "left").select("fp", first, F.coalesce("label", "fp").alias("label")), "labelled")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id of the group. Null and blank texts have fingerprint zero,
    which links like any other; ids that are null have no part in the smallest id, and a group
    of such rows only has a null component. Repeated rows each give a row. An empty table gives
    an empty result. No other columns are read, so their names don't matter.
    """
    rows = written(fingerprinted(docs, id_col, text_col), "fingerprints")
    labelled = _labelled(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "first_id")
    # a table of its own, so that the join may split a label that many fingerprints have
    least = written(labelled.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")
    of_fp = labelled.join(least, "label").select("fp", "component_id")
    out = rows.join(of_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group exactly one row, that with the smallest id.

    Null ids come last; of several texts under that id the one with the least digest stays. So
    different texts that share an id, or have none, don't displace each other. Null and blank
    texts are one group, repeated rows are one row, an empty table stays empty, and any other
    columns are passed on.
    """
    rows = fingerprinted(docs, digest=True)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    least = _labelled(rows.groupBy("fp").agg(first), "first").groupBy("label").agg(F.min("first").alias("first"))
    digest, kept_id, kept_digest = fresh(docs, "digest"), fresh(docs, "kept_id"), fresh(docs, "kept_digest")
    kept = least.select(F.col("first.id").alias(kept_id), F.col("first.digest").alias(kept_digest))
    out = docs.withColumn(digest, text_digest(docs["text"]))
    out = out.join(kept, out["doc_id"].eqNullSafe(kept[kept_id]) & (out[digest] == kept[kept_digest]), "left_semi")
    return out.dropDuplicates(["doc_id", digest]).drop(digest)
