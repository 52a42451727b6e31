import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from packetloom.llm import licenses, pii, warc
from packetloom.llm._shared import new_path
from tests.llm.conftest import filler

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(t):
    out = []
    for k, (kind, p) in enumerate(RULES.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    "mail a.b@c.de@f.gh, x@y, @z.com q@r-s.t.u.", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.0004 1.2.3", "4111 1111 1111 1111 and 4111111111111112 4111-1111-1111-1111-",
    "+1 (367) 555-7441 +12 +1-2-3-4-5-6-7-8-9 +1(2", "é漢 +44 20 7946 0958 \U0001f600 a@b.co", "a" * 3000 + "@b.c", "1" * 5000, "+1" + " " * 3000, "a@b.c@d.e.f x@@y.z", "",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_the_rules(text):
    assert pii.base_spans(text) == base(text)


def notes(n):
    out = []
    for i in range(n):
        card = next(f"41{i:02d}{k:012d}" for k in range(10 * i, 10 * i + 10) if pii.luhn(f"41{i:02d}{k:012d}"))
        out.append(f"{filler(i, 9)} user{i}.x{i}@mail{i % 7}.example.com {filler(i + 1, 5)} +1 ({200 + i}) 555-{1000 + i} {filler(i + 2, 6)} {card} {filler(i + 3, 4)} {i}.{i + 1}.2{i % 10}.9 end")
    return out


def test_model_adds_respelt_spans_and_keeps_base(spark):
    more = ["write to jane.roe (at) mail3.example (dot) com please", "call (367) 555-7441 today", "number 4115031129155693 is no card", "order 83920184 of 2024-05-06"]
    rows = list(enumerate(notes(80) + more))
    out = {r.doc_id: r for r in pii.found(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        b = base(t)
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in b) for j in range(4)]
        assert out[i].base_sha256 == hashlib.sha256(pii._listed(b).encode()).hexdigest()
        assert set(pii._listed(b).split(",")) - {""} <= set(out[i].spans.split(","))
    assert out[80].spans == "email:9:46" and out[81].spans.startswith("phone:5:")
    assert out[82].spans == "" and out[83].spans == ""


def test_held_out_respelt_spans_are_added():
    """Recall and precision on spellings that the fit has not seen: other texts, another draw."""
    import numpy as np

    texts = notes(300)
    weights = pii.fit([(t, base(t)) for t in texts[:150]])
    rng, hit, true, said = np.random.Generator(np.random.PCG64(99)), 0, 0, 0
    for t in texts[150:]:
        respelt, spans = pii._respelt(t, base(t), rng)
        own = base(respelt)
        want = {x for x in spans if all(x[2] <= a or x[0] >= b for a, _, b in own)}
        got = {(a + lo, k, b + lo) for lo, hi in pii.islands(respelt) for a, k, b in pii.added(respelt[lo:hi], [(x - lo, k, y - lo) for x, k, y in own], weights)}
        hit, true, said = hit + len(want & got), true + len(want), said + len(got)
    assert hit / true > 0.8 and hit / said > 0.9


def test_long_addresses_are_whole():
    long = "x" * 300 + "@" + "y" * 200 + ".com"
    assert pii.base_spans(f"to {long} now") == [(3, 0, 3 + len(long))]
    assert pii.islands(f"to {long} now") == [(3, 3 + len(long))]
    spelt = "x" * 300 + " (at) " + "y" * 200 + " dot com"
    assert pii.islands(f"to {spelt} now") == [(3, 3 + len(spelt))]


def test_marginals_and_best_equal_enumeration():
    import itertools
    import math

    text = "call (367) 555-7441 or a@b.co"
    n, cands = pii.candidates(text, 0, len(text))
    cands = cands[:9]
    weights = {f: 0.1 * ((hash(f[:3]) % 7) - 3) + 0.05 * len(f) for c in cands for f in c[3]}
    z, score, p = pii.marginals(n, cands, weights)
    total, mass, top = 0.0, [0.0] * len(cands), (-1.0, None)
    for chosen in itertools.chain.from_iterable(itertools.combinations(range(len(cands)), k) for k in range(len(cands) + 1)):
        spans = sorted(cands[x][:2] for x in chosen)
        if all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False)):
            s = sum(score[x] for x in chosen)
            total += math.exp(s)
            top = max(top, (s, chosen), key=lambda v: v[0]) if top[1] is not None else (s, chosen)
            for x in chosen:
                mass[x] += math.exp(s)
    assert z == pytest.approx(math.log(total)) and p == pytest.approx([m / total for m in mass])
    assert sum(score[x] for x in pii.best(n, cands, score)) == pytest.approx(top[0])


def test_pii_odd_documents(odd_docs, no_docs):
    out = pii.found(odd_docs)
    assert out.count() == odd_docs.count() and out.filter("spans IS NULL").count() == 0
    assert pii.found(no_docs).count() == 0


def test_license_notices(spark):
    texts = [f"{filler(i, 30)}\n{t}\n{filler(i + 1, 8)}" for i, (_, t) in enumerate(licenses.TEMPLATES)]
    texts += ["Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU General Public License, version 4.", "no licence here", "Licensed under CC BY-NC 4.0. Released under the MIT License.", None, ""]
    got = [r.licenses for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    n = len(licenses.TEMPLATES)
    assert got[:n] == [name for name, _ in licenses.TEMPLATES]
    assert got[n : n + 3] == ["", "", ""] and "CC-BY-NC-4.0" in got[n + 3] and got[n + 4 :] == ["", ""]


def test_license_notices_in_one_long_line():
    scanner = licenses.Scanner()
    for i, (name, notice) in enumerate(licenses.TEMPLATES):
        for before in (0, 9_950 + 7 * i, 20_000):
            block = licenses.words(f"{filler(i, before)} {notice} {filler(i + 1, 20_000 - before)}")
            assert [x[0] for x in scanner.confirmed(block)] == [name]


def test_every_license_of_a_block_is_found():
    scanner = licenses.Scanner()
    for i, (a, x) in enumerate(licenses.TEMPLATES):
        for b, y in licenses.TEMPLATES[i % 3 :: 3]:
            block = licenses.words(f"{x} {filler(3, 20)} {y}")
            assert {n for n, *_ in scanner.confirmed(block)} == {a, b}
    everything = licenses.words(" ".join(t for _, t in licenses.TEMPLATES))
    assert {n for n, *_ in scanner.confirmed(everything)} == {n for n, _ in licenses.TEMPLATES}
    other = "Licensed under the Apache License, Version 1.1. " * 3
    assert scanner.confirmed(licenses.words(other)) == []
    assert [n for n, *_ in scanner.confirmed(licenses.words(other + licenses.TEMPLATES[0][1]))] == ["Apache-2.0"]


def test_six_licenses_in_a_row(spark):
    want = ["MIT", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "MPL-2.0", "Apache-2.0"]
    text = "\n".join(next(t for n, t in licenses.TEMPLATES if n == w) for w in want)
    got = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert got.licenses.split(",") == sorted(want) and got.n_exact == 6


def test_notices_wrapped_over_lines(spark):
    wrapped = [(i, "\n".join([filler(i, 9), *(" ".join(t.split()[k : k + 4]) for k in range(0, len(t.split()), 4)), filler(i + 1, 9)])) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    got = licenses.scanned(spark.createDataFrame(wrapped, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [n for n, _ in licenses.TEMPLATES]


def everywhere(text):
    """Licences borne out anywhere in a text: every template held against every place, without blocks, windows or ranking."""
    words, out = licenses.words(text), set()
    for (name, _), t in zip(licenses.TEMPLATES, licenses._WORDS, strict=True):
        for at in range(len(words)):
            missing = licenses._missing(words[at : at + len(t) + 2], t)
            if missing is not None and missing <= int((1 - licenses.SHARE) * len(t) + 1e-9):
                out.add(name)
                break
    return ",".join(sorted(out))


def test_scan_equals_brute_force(spark):
    """Notices with words changed, lost or put in, at any place of a text, some of them two in one."""
    rng, texts = random.Random(4), []
    for i in range(90):
        parts = [filler(i, rng.randrange(0, 12))]
        for _ in range(rng.randrange(1, 3)):
            notice = rng.choice(licenses.TEMPLATES)[1].split(" ")
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(notice))
                notice[k : k + 1] = rng.choice(([], ["other"], [notice[k], "also"], [notice[k].upper()]))
                notice = notice or ["none"]
            parts += [rng.choice((" ", "\n", "\n" * 9)).join((" ".join(notice), filler(i + 1, rng.randrange(0, 9))))]
        texts.append(" ".join(parts))
    got = [r.licenses for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    want = [everywhere(t) for t in texts]
    assert got == want and sum(map(bool, want)) > 40


@pytest.mark.parametrize("gap", ["\n", "  ", " \n\t "])
def test_notices_wrapped_at_every_single_place(gap):
    """One line end, or doubled blanks, between any two words of any template."""
    scanner = licenses.Scanner()
    for i, (name, notice) in enumerate(licenses.TEMPLATES):
        parts = notice.split(" ")
        for k in range(1, len(parts)):
            text = f"{filler(i, 30)} {' '.join(parts[:k])}{gap}{' '.join(parts[k:])} {filler(i + 1, 25)}"
            found = [(n, d, places[a][0], places[b - 1][1]) for block, places in licenses.blocks(text) for n, _, d, a, b in scanner.confirmed(block)]
            assert [x[:2] for x in found] == [(name, 0)], (name, k, found)
            assert licenses.words(text[found[0][2] : found[0][3]]) == licenses.words(notice)


def test_changed_notices_without_the_usual_words_are_found(spark):
    """As many words changed as may be, any of them but the names: nothing that the wording bears out is lost."""
    rng, texts = random.Random(11), []
    for i in range(150):
        name, notice = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        own = notice.split(" ")
        free = [k for k, w in enumerate(own) if not any(x in licenses.NAMES or any(ch.isdigit() for ch in x) for x in licenses.words(w))]
        for k in sorted(rng.sample(free, min(len(free), licenses.most_missing(licenses.words(notice)))), key=lambda k: -len(own[k])):
            own[k] = filler(1000 * i + k, 1)
        texts.append(f"{filler(i, rng.randrange(0, 40))} {' '.join(own)} {filler(i + 7, rng.randrange(0, 40))}")
    got = [r.licenses for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    want = [everywhere(t) for t in texts]
    assert got == want and sum(bool(w) for w in want) > 120


def test_the_ranking_decides(monkeypatch):
    """Without savings nothing is confirmed, and what saves most is asked first."""
    scanner = licenses.Scanner()
    block = licenses.words(f"{filler(1, 20)} {licenses.TEMPLATES[9][1]} {filler(2, 20)}")
    asked = []
    real = licenses.placed
    monkeypatch.setattr(licenses, "placed", lambda b, t, o: asked.append(t) or real(b, t, o))
    assert [x[0] for x in scanner.confirmed(block)] == ["GPL-2.0"]
    assert asked[0] == licenses._WORDS[9] and len(asked) < len(licenses.TEMPLATES)
    monkeypatch.setattr(scanner, "ranked", lambda w: [(0.0, k) for k in range(len(licenses.TEMPLATES))])
    assert scanner.confirmed(block) == []


def test_licenses_odd_documents(odd_docs, no_docs):
    assert licenses.scanned(odd_docs).count() == odd_docs.count() and licenses.scanned(no_docs).count() == 0


def test_warc_round_trip(spark):
    same, tiny = "<p>" + "x" * 1200, "y" * 999
    rows = [(i, f"http://h.example/{i}?q=é", f"<html>{filler(i, 200)}</html>") for i in range(60)]
    rows += [(100 + i, "http://s", same) for i in range(20)] + [(200 + i, None, tiny) for i in range(3)] + [(300, "u", None), (None, "v", same), (301, None, ""), (5, "w", rows[5][2]), (119, "again", same)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("shard", F.lit("clash"))
    path = new_path(spark, "warc-test")
    manifest = warc.write(df.repartition(3), path, shard_bytes=20_000, roll_bytes=4_000)
    out = warc.read(manifest, with_payload=True).collect()
    assert len(out) == len(rows) and manifest.count() > 3
    want = {(str(i) if i is not None else None, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}
    assert {(r.page_id, r.payload_digest) for r in out} == want
    for r in out:
        again = r.payload_digest == hashlib.sha1(same.encode()).hexdigest() and r.page_id != "119"
        assert (r.record_type, r.refers_to) == (("revisit", "119") if again else ("response", None))
        assert again or hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    second = warc.write(df, new_path(spark, "warc-test"), shard_bytes=20_000, roll_bytes=4_000)
    key = lambda m: sorted((r.shard, r.number, r.records, r.file_bytes) for r in m.collect())
    assert key(manifest) == key(second)
    assert warc.read(warc.write(df.limit(0), new_path(spark, "warc-test"))).count() == 0


def test_warc_refuses_a_written_path_and_leaves_it_whole(spark):
    many = spark.createDataFrame([(i, "u", filler(i, 30)) for i in range(20)], "page_id bigint, url string, html string")
    path = new_path(spark, "warc-test")
    manifest = warc.write(many, path)
    with pytest.raises(FileExistsError):
        warc.write(many.limit(5), path)
    assert warc.read(manifest).count() == 20
    draft = f"{path}/late"
    manifest.write.parquet(draft)
    with pytest.raises(Exception, match="(?i)exist"):
        warc.rename(spark, draft, f"{path}/manifest")


def test_warc_hot_and_missing_ids_are_dealt_over_shards(spark):
    rows = [(7 if i % 2 else None, "u", filler(i, 60)) for i in range(120)] + [(i, "u", filler(i, 60)) for i in range(1000, 1040)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write(df.repartition(4), new_path(spark, "warc-test"), shard_bytes=4_000)
    out = warc.read(manifest, with_payload=True).collect()
    assert sorted((str(r.page_id), bytes(r.payload).decode()) for r in out) == sorted((str(i), h) for i, _, h in rows)
    assert max(r.records for r in manifest.collect()) < 30
    by_page = {}
    for f in manifest.orderBy("shard", "number").collect():
        for r in warc.read(manifest.filter(manifest["path"] == f.path)).collect():
            by_page.setdefault(r.page_id, []).append(f.shard)
    order = [s for i in (None, *map(str, sorted({i for i, *_ in rows if i is not None}))) for s in sorted(by_page[i])]
    assert order == sorted(order)


def test_warc_ignores_what_a_crashed_writer_left(spark):
    df = spark.createDataFrame([(i, "u", filler(i, 30)) for i in range(20)], "page_id bigint, url string, html string")
    path = new_path(spark, "warc-test")
    warc.write(df.limit(3), path)  # a writer that got as far as its files, but not to its manifest
    warc.hadoop_path(spark, f"{path}/manifest", lambda fs, p: fs.delete(p, True))
    again = warc.write(df, path)
    assert sorted(int(r.page_id) for r in warc.read(again).collect()) == list(range(20))


def test_archive_paths_are_qualified_or_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, None, "<p>" + "y" * 5000)], "page_id bigint, url string, html string")
    manifest = warc.write(pages, str(tmp_path / "plain"), shard_bytes=100, roll_bytes=100)
    paths = [r.path for r in manifest.collect()]
    assert paths and all(p.startswith("file:/") for p in paths)
    got = warc.read(manifest, with_payload=True).collect()
    assert sorted((r.page_id, len(r.payload)) for r in got) == [("1", 1), ("2", 5003)]  # longer than a shard and a file
    clash = pages.selectExpr("*", "1 AS shard", "'a' AS digest", "2 AS kind", "3 AS turn", "'b' AS refers_to", "4 AS payload_bytes")
    assert warc.read(warc.write(clash, str(tmp_path / "clash"))).count() == 2
    from packetloom.sources.series_files import opened_uri

    assert opened_uri("s3a://bucket/key") == "s3://bucket/key" and opened_uri("hdfs://name:8020/a") == "hdfs://name:8020/a"
    for path in ("dbfs:/a", "wasbs://c@a/x", "/no/scheme"):
        with pytest.raises(ValueError):
            opened_uri(path)
