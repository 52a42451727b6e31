import numpy as np

from packetloom.llm import toxicity
from tests.llm.conftest import filler


def toy(spark):
    bad = ["zorgit", "zorgling", "plunkor"]
    rows = [(i, f"{filler(i, 40)} {bad[i % 3]} {filler(i + 5000, 20)}" if i % 4 == 0 else filler(i, 60), int(i % 4 == 0)) for i in range(400)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")


def test_held_out_documents(spark):
    docs, labels = toy(spark)
    out = toxicity.scored(docs, labels).join(labels, "doc_id")
    held = out.filter("held_out").collect()
    assert held and all(r.predicted == r.toxic for r in held)
    assert all(r.evidence for r in held if r.toxic)


def test_term_that_clean_documents_have_too_counts(spark):
    """A word in all toxic and two fifths of the clean examples tells them apart, though it isn't three times as common."""
    has = lambda i: i % 4 == 0 or i % 5 < 2
    docs = spark.createDataFrame([(i, f"{filler(i, 40)} {'plunkor' if has(i) else ''}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    score = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert min(score[i] for i in score if has(i)) > max(score[i] for i in score if not has(i))


def test_odd_documents(spark, odd_docs, no_docs):
    _, labels = toy(spark)
    out = toxicity.scored(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.scored(no_docs, labels).count() == 0
    assert toxicity.scored(odd_docs, labels.limit(0)).select("score").distinct().count() == 1


def test_nearest_are_exact():
    rng = np.random.default_rng(3)
    n_terms, n = 60, 300
    vectors = []
    for _ in range(n):
        t = np.sort(rng.choice(n_terms, rng.integers(0, 8), replace=False))
        vectors.append(toxicity.unit(t, rng.integers(1, 5, len(t)).astype(float), np.ones(n_terms)))
    index = toxicity.Index(np.arange(n), rng.integers(0, 2, n), vectors, np.ones(n), n_terms)
    dense = np.zeros((len(index.ids), n_terms))
    dense[index.e, index.t] = index.v
    for _ in range(200):
        t = np.sort(rng.choice(n_terms, rng.integers(0, 6), replace=False))
        q = toxicity.unit(t, np.ones(len(t)), np.ones(n_terms))
        all_c = dense[:, q[0]] @ q[1] if len(t) else np.zeros(len(dense))
        e, c = index.nearest(*q)
        assert np.allclose(c, np.sort(all_c[all_c > 0])[::-1][: toxicity.NEAREST]) and np.allclose(all_c[e], c)


def test_nearest_of_many_blocks_with_ties_and_one_left_out():
    """More blocks than are evaluated at first, few weights so that bounds and cosines tie, an example without its own vote."""
    rng = np.random.default_rng(11)
    n_terms, n = 40, 1500
    of = lambda k: np.sort(rng.choice(n_terms, k, replace=False))
    vectors = [toxicity.unit(t, np.ones(len(t)), np.ones(n_terms)) for t in (of(rng.integers(1, 5)) for _ in range(n))]
    index = toxicity.Index(np.arange(n), rng.integers(0, 2, n), vectors, np.ones(n), n_terms)
    assert index.n_blocks > toxicity.FIRST
    dense = np.zeros((n, n_terms))
    dense[index.e, index.t] = index.v
    for k in range(300):
        t, w = vectors[index.ids[k]]
        all_c = dense[:, t] @ w
        all_c[k] = 0
        e, c = index.nearest(t, w, without=k)
        assert k not in e and np.allclose(c, np.sort(all_c[all_c > 0])[::-1][: toxicity.NEAREST]) and np.allclose(all_c[e], c)


def test_labels_count_once_and_only_where_there_is_a_document(spark):
    docs, labels = toy(spark)
    more = labels.unionByName(labels).unionByName(spark.range(10_000, 12_000).selectExpr("id AS doc_id", "1 AS toxic"))
    of = lambda l: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.scored(docs, l).collect())  # noqa: E731, E741
    assert of(labels.unionByName(labels)) == of(labels) == of(more)


def test_clashing_label_columns_and_ids_with_two_texts(spark):
    docs, labels = toy(spark)
    twice = docs.unionByName(docs.filter("doc_id < 40").selectExpr("doc_id", "concat('plunkor ', text) AS text"))
    odd = labels.selectExpr("doc_id", "toxic", "1 AS y", "'t' AS text", "2 AS label_id", "3 AS n", "4 AS place")
    of = lambda parts: sorted((r.doc_id, r.score) for r in toxicity.scored(twice.repartition(parts), odd).collect())
    assert of(2) == of(5) and len(of(2)) == 440


def test_counts_make_no_row_per_document_and_term():
    """Document frequencies are summed within tasks: a row per term, however many documents and batches there are."""
    import pandas as pd

    (out,) = list(toxicity.frequencies(4)(pd.DataFrame({"t": [[0, 2], [], [2]]}) for _ in range(50)))
    assert out.values.tolist() == [[0, 50], [2, 100]]
    (none,) = list(toxicity.frequencies(4)(iter([])))
    assert not len(none)


def test_vectors_are_tf_idf():
    """Frequencies over all documents and unit weights, against plain Python."""
    docs = [["a", "b", "b"], ["b"], ["a", "c", "c", "c"]]
    df = {"a": 2, "b": 2, "c": 1}
    idf = np.array([np.log((1 + 3) / (1 + df[t])) + 1 for t in "abc"])
    for words in docs:
        t = np.array(sorted({"abc".index(w) for w in words}))
        n = np.array([words.count("abc"[k]) for k in t], float)
        got = toxicity.unit(t, n, idf)[1]
        plain = [(1 + np.log(words.count("abc"[k]))) * idf[k] for k in t]
        assert np.allclose(got, np.array(plain) / np.sqrt(sum(x * x for x in plain)))
