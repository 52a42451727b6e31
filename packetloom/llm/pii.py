"""Personal data by a semi-Markov conditional random field over whole spans.

One pass over the texts finds the base spans by rule and cuts out islands: short stretches
that may hold personal data, also in spellings that the rules miss ("name (at) host (dot) org",
numbers without their plus). Within an island every span that looks like some kind is a
candidate, up to an entity's bound of ``MOST_TOKENS`` tokens (numbers of any kind are shorter by
their spelling; a longer address is found by rule only); features of the whole span and its surroundings score it,
and a dynamic program over the island's tokens chooses the best set of disjoint spans, types
and boundaries together. The weights are fitted on a bounded sample of islands, with their base
spans as labels, and with copies in which those spans are respelt as people respell them.
Base spans are always kept; the model adds spans that touch none of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._shared import sample_by_hash, table, written

KINDS = ("email", "ip", "card", "phone")
#: Islands that the model is fitted on, and the characters of the longest of them.
SAMPLE = 1500
SAMPLE_CHARS = 400
MOST_TOKENS = 40
CONTEXT = 24
#: A candidate is added if its marginal probability is at least this.
SURE = 0.9
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = r"(?:@|[\[(]\s?at\s?[\])]|\sat\s)"
_DOT = r"(?:\.|[\[(]\s?dot\s?[\])]|\sdot\s)"
LOOSE = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+\s?{_AT}\s?[A-Za-z0-9-]+(?:\s?{_DOT}\s?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,4}(?:\s?(?:\.|\[\.\])\s?[0-9]{1,4}){3}"),
    "card": re.compile(r"[0-9](?:[ .-]?[0-9]){11,18}"),
    "phone": re.compile(r"\+?\(?[0-9](?:[ ().-]{0,3}[0-9]){6,14}"),
}
_NUMBERS = re.compile(r"\+?\(?[0-9](?:[ ()\[\].,-]{0,3}[0-9])+")
_SPELT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?{_AT}\s?[A-Za-z0-9-]+(?:\s?{_DOT}\s?[A-Za-z0-9-]+)+")
_SPELT_OUT = re.compile(r"[\[(]\s?at\s?[\])]|[\[(]\s?dot\s?[\])]|\sdot\s")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the rules, in order of start and kind."""
    out, free = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            a = m.start()
            if a <= free:
                continue
            low = a
            while low > free and (m2 := _LOCAL.search(text, max(free, low - 64), low)):
                low = m2.start()
            if low < a:
                out.append((low, 0, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _only_digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def islands(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches that may hold personal data in some spelling."""
    found = [m.span() for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 7]
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        found.append((a, b))
        at = text.find("@", b)
    if "at)" in text or "at]" in text or "at )" in text or "at ]" in text or "dot" in text:
        found += [m.span() for m in _SPELT.finditer(text) if _SPELT_OUT.search(m.group())]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 3:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def features(kind: str, span: str, before: str, after: str) -> list[str]:
    """Names of the features of one whole candidate span."""
    digits = _only_digits(span)
    f = ["bias", f"len{min(len(span) // 6, 6)}"]
    left, right = before[-1:], after[:1]
    f.append("left_word" if left.isalnum() else "left_mark" if left in "+-_.@%(#/=" and left else "left_gap")
    f.append("right_word" if right.isalnum() else "right_mark" if right in "-_@%/=" and right else "right_gap")
    if re.match(r"[.,]?[A-Za-z0-9]", after):
        f.append("goes_on")
    if kind == "email":
        at = re.search(_AT, span)
        f.append("at_sign" if at.group() == "@" else "at_bracket" if at.group()[-1] in ")]" else "at_word")
        tail = re.split(_DOT, span[at.end() :])
        f += [f"labels{min(len(tail), 4)}", "tld_alpha" if tail[-1].strip().isalpha() else "tld_other", f"tld_len{min(len(tail[-1].strip()), 5)}"]
        f += ["gaps"] * (" " in span and at.group() == "@")
    elif kind == "ip":
        parts = re.split(r"[.\s\[\]]+", span)
        f += ["in_range" if all(int(p) <= 255 for p in parts) else "out_of_range"] + ["ip_gaps"] * (" " in span) + ["ip_brackets"] * ("[" in span)
    elif kind == "card":
        groups = [len(x) for x in re.split(r"[ .-]", span)]
        f += ["luhn" if luhn(digits) else "no_luhn", f"n{len(digits)}", "grouped" if groups[:1] == [4] else "one_run" if len(groups) == 1 else "odd_groups"]
    else:
        f += ["plus" if span[0] == "+" else "no_plus", f"digits{len(digits)}", f"groups{min(len(re.findall('[0-9]+', span)), 6)}"]
        f += ["paren"] * ("(" in span) + ["odd_paren"] * (span.count("(") != span.count(")")) + ["dotted_quad"] * (span.count(".") == 3)
        f += ["wide_gap"] * ("  " in span)
    return [f"{kind}:{x}" for x in f]


def candidates(text: str, lo: int, hi: int) -> tuple[int, list[tuple[int, int, int, list[str], int, int]]]:
    """Number of tokens of text[lo:hi]; (first token, end token, kind, features, start, end) of all candidates."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    out = []
    for i, (a, _) in enumerate(tokens):
        c = text[a]
        if not (c in "+(._%-" or (c.isascii() and c.isalnum())):
            continue
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            b = tokens[j][1]
            if not (text[b - 1].isascii() and (text[b - 1].isalnum() or text[b - 1] == "-")):
                continue
            for k, kind in enumerate(KINDS):
                if kind != "email" and not (c in "+(" or "0" <= c <= "9"):
                    continue
                if LOOSE[kind].fullmatch(text, a, b):
                    out.append((i, j + 1, k, features(kind, text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]), a, b))
    return len(tokens), sorted(out, key=lambda x: x[:3])


def marginals(n: int, cands: list, weights: dict[str, float]) -> tuple[float, list[float], list[float]]:
    """log Z, each candidate's score, and its probability over all segmentations of ``n`` tokens."""
    score = [sum(weights.get(f, 0.0) for f in c[3]) for c in cands]
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for x, c in enumerate(cands):
        ends.setdefault(c[1], []).append(x)
        starts.setdefault(c[0], []).append(x)

    def plus(values: list[float]) -> float:
        m = max(values)
        return m + math.log(sum(math.exp(v - m) for v in values))

    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for t in range(1, n + 1):
        alpha[t] = plus([alpha[t - 1], *(alpha[cands[x][0]] + score[x] for x in ends.get(t, ()))]) if t in ends else alpha[t - 1]
    for t in range(n - 1, -1, -1):
        beta[t] = plus([beta[t + 1], *(beta[cands[x][1]] + score[x] for x in starts.get(t, ()))]) if t in starts else beta[t + 1]
    z = alpha[n]
    return z, score, [math.exp(min(0.0, alpha[c[0]] + s + beta[c[1]] - z)) for c, s in zip(cands, score, strict=True)]


def best(n: int, cands: list, score: list[float]) -> list[int]:
    """The candidates of the highest-scoring segmentation, by dynamic programming over token ends."""
    ends: dict[int, list[int]] = {}
    for x, c in enumerate(cands):
        ends.setdefault(c[1], []).append(x)
    top, back = [0.0] * (n + 1), [-1] * (n + 1)
    for t in range(1, n + 1):
        top[t] = top[t - 1]
        for x in ends.get(t, ()):
            if top[cands[x][0]] + score[x] > top[t]:
                top[t], back[t] = top[cands[x][0]] + score[x], x
    out, t = [], n
    while t > 0:
        if back[t] >= 0:
            out.append(back[t])
            t = cands[back[t]][0]
        else:
            t -= 1
    return out[::-1]


def _respelt(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans spelt another way, and where they are then."""
    out, moved, at = "", [], 0
    for a, k, b in spans:
        if a < at:
            continue
        out += text[at:a]
        s = text[a:b]
        true = True
        if k == 0:
            mark = (" (at) ", " [at] ", "(at)", "[at]", " at ")[int(rng.integers(5))]
            dots = (" dot ", "(dot)", "[dot]", " [dot] ", " (dot) ", ".")
            head, _, tail = s.partition("@")
            labels = tail.split(".")
            labels = labels[-2:] if rng.integers(2) else labels
            s = head + mark + dots[int(rng.integers(5 if mark == " at " else 6))].join(labels)
        elif k == 1:
            way = int(rng.integers(3))
            true = way < 2
            s = s.replace(".", (" . ", "[.]", ".")[way])
            s = s if true else re.sub("^[0-9]+", str(int(rng.integers(300, 1000))), s)  # no address any more
        elif k == 2:
            d = _only_digits(s)
            s = (" ", "-", ".")[int(rng.integers(3))].join(d[x : x + 4] for x in range(0, len(d), 4))
        else:
            s = s[1:] if rng.integers(2) else re.sub(r"^\+[0-9]+[ .-]?", "", s) or s
        if true and LOOSE[KINDS[k]].fullmatch(s):
            moved.append((len(out), k, len(out) + len(s)))
        out += s
        at = b
    return out + text[at:], moved


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 8, rate: float = 0.3) -> dict[str, float]:
    """Weights by stochastic gradient on the log-likelihood of the labelled segmentations."""
    rng, data = np.random.Generator(np.random.PCG64(11)), []
    for text, spans in examples:
        for t, s in ((text, spans), _respelt(text, spans, rng)):
            n, cands = candidates(t, 0, len(t))
            gold = {(a, b, k) for a, k, b in s}
            hit = [x for x, c in enumerate(cands) if (c[4], c[5], c[2]) in gold]
            if cands and (len(hit) == len(gold)):
                data.append((n, cands, hit))
    weights: dict[str, float] = {}
    for r in range(rounds):
        step = rate / (1 + r)
        for x in rng.permutation(len(data)):
            n, cands, hit = data[x]
            _, _, p = marginals(n, cands, weights)
            for y, c in enumerate(cands):
                g = (y in hit) - p[y]
                if abs(g) > 1e-3:
                    for f in c[3]:
                        weights[f] = weights.get(f, 0.0) + step * g - step * 1e-3 * weights.get(f, 0.0)
    return weights


def added(text: str, base: list[tuple[int, int, int]], weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """Spans of the best segmentation that the model is sure of and that touch no base span."""
    n, cands = candidates(text, 0, len(text))
    if not cands:
        return []
    _, score, p = marginals(n, cands, weights)
    out = []
    for x in best(n, cands, score):
        a, b, k = cands[x][4], cands[x][5], cands[x][2]
        if p[x] >= SURE and all(b <= s or a >= e for s, _, e in base):
            out.append((a, k, b))
    return out


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, islands): base spans, and each island's text with some context, its place and its base spans."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bases, lands = [], []
            for text in b["text"]:
                text = text or ""
                base = base_spans(text)
                bases.append([list(x) for x in base])
                own, k = [], 0
                for lo, hi in islands(text):
                    lo, hi = max(0, lo - CONTEXT), min(len(text), hi + CONTEXT)
                    while k < len(base) and base[k][2] <= lo:
                        k += 1
                    inside = []
                    for x in base[k:]:
                        if x[0] >= hi:
                            break
                        inside.append([x[0] - lo, x[1], x[2] - lo])
                    own.append({"at": lo, "text": text[lo:hi], "base": inside})
                lands.append(own)
            yield pd.DataFrame({"id": b["id"], "base": bases, "islands": lands})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    spans = "array<array<bigint>>"
    return rows.mapInPandas(run, f"id {kind}, base {spans}, islands array<struct<at:bigint,text:string,base:{spans}>>")


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    The counts are of base spans; ``spans`` has all. The model is fitted on at most ``sample``
    islands of at most ``sample_chars`` characters, the first by a hash of their text; islands of
    any length are scanned. Null and empty texts have no spans. Repeated
    rows each give a row. An empty table, or one without islands, fits no weights and adds
    nothing. Other columns aren't read.
    """
    rows = written(scanned(docs, id_col, text_col), "scanned")
    each = rows.select(F.explode("islands").alias("x")).select("x.text", "x.base").filter(F.length("text") <= sample_chars)
    chosen = sample_by_hash(each.distinct(), ["text"], sample).collect()
    weights = fit([(r.text, [tuple(x) for x in r.base]) for r in chosen])
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for base, lands in zip(b["base"], b["islands"], strict=True):
                base = [tuple(int(y) for y in x) for x in base]
                more, free = [], 0
                for land in lands:
                    at = int(land["at"])
                    for a, k, e in added(land["text"], [tuple(int(y) for y in x) for x in land["base"]], weights):
                        if a + at >= free:
                            more.append((a + at, k, e + at))
                            free = e + at
                n = [sum(k == j for _, k, _ in base) for j in range(4)]
                out.append((*n, _listed(base), _listed([*base, *more]), len(more)))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"]
            yield pd.concat([b[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    counts = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint"
    out = rows.mapInPandas(run, f"id {kind}, {counts}, base string, spans string, n_added bigint")
    return out.select(F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))
