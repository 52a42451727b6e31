import random
import re

from pyspark.sql import functions as F

from packetloom.llm import line_quality, quality_rules
from tests.llm.conftest import filler

WORD = r"[^\x20\x09-\x0D]+"


def base(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    seen = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {p for ks in seen.values() if len(ks) > 1 for k in ks for p in range(k, k + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(2)
    texts = ["a b a b a b a b a b a b", "x\nx\n \nx\ny", "#|<> a & b", None, "", "one two three four five", "a a a a a a"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) + rng.choice(["", "\n", "\t"]) for _ in range(60)]
    texts += [f"{filler(1, 12)}\n{filler(2, 20)}\n{filler(1, 12)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality_rules.judge(df, ["doc_id"]).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    rows = quality_rules.judge(odd_docs, odd_docs.columns)
    assert rows.count() == odd_docs.count() and rows.columns[: len(odd_docs.columns)] == odd_docs.columns and rows.columns[-1] == "kept_1"
    assert quality_rules.judge(no_docs, ["doc_id"]).count() == 0
    assert quality_rules.stage(spark, odd_docs, "").columns == odd_docs.columns
    assert quality_rules.stage(spark, no_docs, "").count() == 0


def test_em_finds_the_planted_accuracies():
    rng, n = random.Random(4), len(quality_rules.RULES)
    counts = {}
    for _ in range(20000):
        good = rng.random() < 0.85
        votes = tuple((1 if rng.random() < (0.98 if good else 0.4) else -1) if rng.random() < 0.9 else 0 for _ in range(n))
        counts[votes] = counts.get(votes, 0) + 1
    prior, rates = quality_rules.fit(sorted(counts.items()))
    assert abs(prior - 0.85) < 0.03
    assert all(abs(r[-1][1] / (r[-1][1] + r[1][1]) - 0.6) < 0.08 for r in rates)
    assert quality_rules.posterior((-1,) * n, prior, rates) < 0.01 < 0.99 < quality_rules.posterior((1,) * n, prior, rates)


def test_no_python_in_the_plan(spark, odd_docs):
    plan = quality_rules.measured(odd_docs, ["doc_id"])[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def labelled(spark):
    good = [(i, "\n".join(filler(1000 * i + k, 12).capitalize() + "." for k in range(4)), 1) for i in range(0, 120)]
    bad = [(i, "\n".join(" ".join(w + "***" for w in filler(1000 * i + k, 12).split()) for k in range(3)), 0) for i in range(200, 260)]
    rows = good + bad
    return spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")


def test_line_field_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    out = line_quality.scored(docs, labels).join(labels, "doc_id")
    assert out.filter("held_out AND predicted <> quality").count() == 0
    assert out.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).count() == 0


def test_line_field_on_odd_documents(spark, odd_docs, no_docs):
    _, labels = labelled(spark)
    out = line_quality.scored(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert line_quality.scored(no_docs, labels).count() == 0
    assert line_quality.scored(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_long_documents_are_fitted_on_within_the_bound_of_lines(spark):
    docs, labels = labelled(spark)
    long = docs.filter("doc_id < 3").select((F.col("doc_id") + 500).alias("doc_id"), F.repeat(F.concat("text", F.lit("\n")), 400).alias("text"))
    both, marks = docs.unionByName(long), labels.unionByName(long.select("doc_id", F.lit(1).alias("quality")))
    out = line_quality.scored(both, marks).join(marks, "doc_id")
    assert out.filter("held_out AND predicted <> quality").count() == 0
    assert line_quality.scored(both, marks, sample_lines=1).count() == both.count()


def test_marginals_equal_enumeration():
    import itertools
    import math

    import numpy as np

    rng, f = np.random.default_rng(1), line_quality.Field()
    f.emit[:], f.move[:], f.bias = rng.normal(size=f.emit.shape), rng.normal(size=(2, 2)), 0.3
    x = rng.integers(0, 2, size=(4, line_quality.N_FEATURES)).astype(np.int8)
    e = f.bias + f.emit[np.arange(line_quality.N_FEATURES), x].sum(axis=1)
    total, good = 0.0, np.zeros(4)
    for s in itertools.product((0, 1), repeat=4):
        w = math.exp(sum(e[t] for t in range(4) if s[t]) + sum(f.move[a, b] for a, b in zip(s, s[1:], strict=False)))
        total += w
        good += w * np.array(s)
    assert np.allclose(f.marginals(x)[0], good / total)
