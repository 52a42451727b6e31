import random

import pytest

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, shard string, hit_id bigint, size bigint, score double, rules string, row_bytes bigint, shard_path string, mixed int, label_id int, fingerprint string, component_id int, spans string, copies int, fitting string, n_blocks int, target string, passes int, src int, block int, key int, number int, path string, `of` int"


def filler(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and blank texts, a very long one, repeated rows, and columns with clashing names."""
    rng = random.Random(9)
    extra = (True, "s", 1, 2, 0.5, "r", 3, "p", 4, 5, "f", 6, "x", 1, "f", 2, "t", 3, 4, 5, 6, 7, "p", 8)
    rows = [(i, filler(i, rng.randrange(5, 60)), "en", f"src{i % 3}", i, *extra) for i in range(40)]
    rows += [(100, None, None, None, None, *[None] * 24), (101, "", "en", None, 0, *extra), (102, " \t\n\x0b ", "en", "src0", 5, *extra)]
    rows += [(103, filler(7, 60_000), "en", "src1", 1, *extra), rows[3], rows[3], (None, filler(11, 30), None, "src0", None, *extra), (None, None, None, None, None, *[None] * 24)]
    rows += [(104, rows[3][1], "en", "src0", 1, *extra), (105, "é ß 漢字 \U0001f600 " * 20, "fr", "src2", 1, *extra)]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def tables(spark, odd_docs, tmp_path_factory):
    """A folder of tables, as the queries and stages read them."""
    d = str(tmp_path_factory.mktemp("tables"))
    odd_docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, filler(2, 20)), (2, "just four words here"), (None, "left out"), (3, None), (4, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d
