import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from packetloom.llm import variants as va


def words_of(docs, misspelt=199):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % misspelt == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v is not None and n[v] >= 5 * n[w] else None for w, v in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def planted(seed=3):
    """Texts of words that are chains of edits of one another, common ones five times and more as common."""
    rng = random.Random(seed)
    letters, texts = "abé", []
    for _ in range(12):
        w, n = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))), 700
        while n >= 5:
            texts += [w.upper() if rng.random() < 0.2 and w.isascii() else w] * n
            k, n = rng.randrange(len(w)), n // rng.choice([3, 5, 6])
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
    rng.shuffle(texts)
    return [(i, " ".join(texts[i * 40 : i * 40 + 40]) + rng.choice([".", "! 9", "Ā", ""])) for i in range(-(-len(texts) // 40))]


@pytest.mark.parametrize(("cells", "tile"), [(1 << 16, 256), (40, 3)])
def test_equals_brute_force(spark, cells, tile):
    docs = planted() + [(900, None), (901, ""), (None, "planted planted planted planted planted plantef"), (902, "x" * 30_000 + " " + "naïveté×÷ " * 6)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    want = brute(words_of(docs))
    assert got(va.variants(df, group_cells=cells, tile=tile)) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # chains of forms occur


@pytest.mark.parametrize("cells", [1 << 16, 60, 1])
def test_near_finds_each_pair_once(spark, cells):
    """All words over two letters of six and seven places: many edits are ambiguous in place."""
    words = ["".join(x) for k in (6, 7) for x in itertools.product("ab", repeat=k)]
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n bigint")
    pairs = [(r.word, r.near) for r in va.near(df, group_cells=cells, tile=16).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_words_whose_letter_is_taken_out(spark):
    docs = [(i, "Somewhat otherwise") for i in range(2000)]
    assert got(va.variants(spark.createDataFrame(docs, "doc_id bigint, text string"), least=1)) == sorted(brute({w: c for w, c in _all(docs).items() if len(w) >= 6}))


def _all(docs):
    n = Counter()
    for i, text in docs:
        for w in text.lower().split():
            h = zlib.crc32(f"{i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return n


def test_odd_documents(spark, odd_docs, no_docs):
    assert got(va.variants(odd_docs)) == brute(words_of([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert va.variants(no_docs).count() == 0
    with pytest.raises(ValueError):
        va.variants(odd_docs, times=1)
