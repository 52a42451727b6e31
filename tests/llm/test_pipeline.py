"""The pipeline's stages, one after another, against plain Python on a table with planted cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from packetloom.llm import quality_rules, simhash
from packetloom.llm._shared import written
from tests.llm.conftest import filler

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean texts in four sources, copies, near copies, junk, passages of the benchmark, shared and missing ids."""
    d, rng = str(tmp_path_factory.mktemp("planted")), random.Random(2)
    item = filler(900, 30)
    texts = [(i, f"{filler(i, rng.randrange(40, 90)).capitalize()}.") for i in range(60)]
    texts += [(100 + i, texts[i][1]) for i in range(8)]
    near = [(200 + i, texts[10 + i][1].split(" ")) for i in range(8)]
    texts += [(i, " ".join(w[:-1] + [w[-1] + "x"])) for i, w in near]
    texts += [(300 + i, " ".join(w + "###" for w in filler(400 + i, 40).split())) for i in range(8)]
    texts += [(310 + i, " ".join(["buy", "now", "here"] * 30)) for i in range(3)] + [(320, "too short"), (321, None), (322, "")]
    texts += [(400 + i, f"{filler(500 + i, 30).capitalize()} {' '.join(item.split()[i : i + 10 + i])} {filler(600 + i, 20)}.") for i in range(6)]
    texts += [(410, f"{filler(700, 30).capitalize()} {' '.join(item.split()[:9])} {filler(701, 20)}.")]
    texts += [(7, f"{filler(800, 60).capitalize()}."), (None, f"{filler(801, 60).capitalize()}."), (None, f"{filler(802, 60).capitalize()}."), (None, texts[3][1])]
    rows = [(i, t, "en", rng.choice(("a", "b", "c", None)), len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def votes(text):
    """Base verdict and votes of one text."""
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    chars, n = sum(map(len, w)), len(w)
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    share = lambda a, b: a / b if b else 0.0
    symbols = sum(t.count(c) for c in "#*$%&|<>")
    signal = {
        "shortness": 1 / n if n else 1.0, "symbol_share": share(symbols, chars), "symbols_per_word": share(symbols, n), "bang_share": share(t.count("!"), n), "capital_share": share(sum("A" <= c <= "Z" for c in t), chars),
        "repeat_share": share(len(covered), n), "dup_line_share": share(len(lines) - len(set(lines)), len(lines)), "word_length_gap": abs(share(chars, n) - 5.0), "pipe_share": share(t.count("|"), n),
    }
    return n < 10 or 100 * len(covered) > 20 * n, tuple(-1 if signal[r.signal] > r.bad else int(signal[r.signal] <= r.good) for r in quality_rules.RULES)


def fingerprint(text):
    """Majority of the bits of the shingles' hashes, bit by bit."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def test_fingerprints_equal_brute_force():
    rng = random.Random(6)
    texts = [filler(i, rng.choice((0, 1, 3, 4, 5, 40, 300))).title() for i in range(60)] + ["é ß 漢字 a b C\x0bD\x1cE " * 9, " \t\n", "Ä B c D e"]
    assert [simhash.fingerprint(t) for t in texts] == [fingerprint(t) for t in texts]


def test_stages_equal_plain_python(spark, planted):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{planted}/documents.parquet")
    assert list(stages) == ["quality_rules", "simhash_dedup", "decontamination", "source_mixing", "sharding"]
    step = lambda name, x: written(stages[name](spark, x, planted), f"test-{name}")
    rows = docs.collect()

    kept = step("quality_rules", docs)
    judged = [votes(r.text) for r in rows]
    prior, rates = quality_rules.fit(sorted(Counter(v for _, v in judged).items()))
    want = [r for r, (failed, v) in zip(rows, judged, strict=True) if not failed and quality_rules.posterior(v, prior, rates) >= 0.5]
    assert kept.columns == docs.columns and plain(kept.collect()) == plain(want)
    ids = {r.doc_id for r in want}
    assert set(range(60)) <= ids and not ids & {300, 310, 320, 321, 322}

    rows, kept = want, step("simhash_dedup", kept)
    fps, group = [fingerprint(r.text) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] != group[b]:
                group = [group[a] if g == group[b] else g for g in group]
    order = lambda r: (r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest())
    want = [min((r for r, g in zip(rows, group, strict=True) if g == k), key=order) for k in set(group)]
    assert kept.columns == docs.columns and plain(kept.collect()) == plain(want)
    assert not {r.doc_id for r in want} & set(range(100, 108)) and sum(r.doc_id == 7 for r in want) == 2 and sum(r.doc_id is None for r in want) == 2

    rows, kept = want, step("decontamination", kept)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    item = words(filler(900, 30))
    windows = {tuple(item[k : k + 10]) for k in range(21)}
    want = [r for r in rows if not any(tuple(w[k : k + 10]) in windows for w in [words(r.text)] for k in range(len(w)))]
    assert kept.columns == docs.columns and plain(kept.collect()) == plain(want)
    assert {r.doc_id for r in rows} - {r.doc_id for r in want} == {400 + i for i in range(6)}

    rows, kept = want, step("source_mixing", kept)
    mixed, sizes, taken = Counter(map(tuple, kept.collect())), Counter(), Counter()
    assert set(mixed) <= set(map(tuple, rows)) and max(mixed.values()) <= 2
    for r in rows:
        sizes[r.source] += len(r.text.split())
        taken[r.source] += len(r.text.split()) * mixed[tuple(r)]
    from tests.llm.test_mixing_sharding import water

    target = water(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= 90 for s in sizes)

    last = stages["sharding"](spark, kept, planted).collect()
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars) for r in last) == Counter((r.doc_id, r.lang, r.source, r.n_chars) for r in kept.collect())
    for k in {r.shard for r in last}:
        own = [r for r in last if r.shard == k]
        assert {(r.shard_rows, r.shard_bytes) for r in own} == {(len(own), sum(r.n_bytes for r in own))}
    again = corpus_pipeline.run(spark, planted).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in again) == Counter((r.doc_id, r.n_bytes) for r in last)


def test_stages_in_order_and_whole(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "source_mixing", "sharding"]
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0 and "shard" in out.columns


def test_registry_names_every_operator():
    from packetloom.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
