"""Quality rules by weak supervision.

Every rule votes good, votes bad or abstains. Expectation-maximisation over the counts of
vote patterns estimates each rule's accuracy on good and on bad documents and the share of good
documents, without labels;
the posterior probability of "good" replaces an all-must-pass filter. Column functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm._shared import SPACE_CHARS, fresh, let, table, words_of, written

SYMBOLS = "#*$%&|<>"
GRAM = 5


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``signal`` is above ``bad``, good where it is at most ``good``."""

    name: str
    signal: str
    good: float
    bad: float


#: Each signal is a share, so that the rules mean the same at every document length.
RULES = (
    Rule("short", "shortness", 1 / 30, 1 / 10),
    Rule("symbols", "symbol_share", 0.01, 0.06),
    Rule("symbol_load", "symbols_per_word", 0.1, 0.8),
    Rule("bangs", "bang_share", 0.05, 0.3),
    Rule("capitals", "capital_share", 0.15, 0.5),
    Rule("repeated_words", "repeat_share", 0.05, 0.15),
    Rule("repeated_lines", "dup_line_share", 0.1, 0.3),
    Rule("odd_words", "word_length_gap", 2.0, 6.0),
    Rule("cells", "pipe_share", 0.02, 0.2),
)


def _covered(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort, keep equal neighbours, merge."""

    def merged(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(GRAM), F.coalesce(F.get(starts, i + 1) - p, F.lit(GRAM))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def doubled(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), merged)

    return let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), doubled)


def _word_counts(words: Column) -> Column:
    """(number of words, number of words in windows that repeat) of one array of words."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    gram = lambda h: lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, GRAM)])
    windows = lambda h: F.slice(F.transform(h, gram(h)), F.lit(1), F.size(h) - (GRAM - 1))
    grams = F.when(n > GRAM, let(hashed, windows)).otherwise(F.array().cast("array<bigint>"))
    repeated = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g)))
    return F.struct(n.cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"))


def measures(docs: DataFrame, text: str = "text") -> Column:
    """A struct of the base counts and of the counts that only the votes use."""
    t = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    count = lambda chars: F.regexp_count(t, F.lit(f"[{chars}]"))
    lines_of = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return F.struct(
        let(words_of(docs[text]), _word_counts).alias("w"),
        F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        count("|").alias("pipes"),
        count("!").alias("bangs"),
        count("A-Z").alias("capitals"),
        lines_of.alias("l"),
    )


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, str]:
    """``keep`` columns and one struct column of measures and votes; the name of that column."""
    name, raw = fresh(docs, "rules"), fresh(docs, "raw")
    m = docs.select(*[docs[c] for c in keep], measures(docs, text).alias(raw))
    c = lambda x: F.col(f"{raw}.{x}")
    n, chars = c("w.n_words"), c("word_chars")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    signals = {
        "shortness": F.coalesce(F.try_divide(F.lit(1.0), n.cast("double")), F.lit(1.0)),
        "symbol_share": share(c("n_symbols"), chars),
        "symbols_per_word": share(c("n_symbols"), n),
        "bang_share": share(c("bangs"), n),
        "capital_share": share(c("capitals"), chars),
        "repeat_share": share(c("w.n_repeat_words"), n),
        "dup_line_share": share(c("l.n") - c("l.d"), c("l.n")),
        "word_length_gap": F.abs(share(chars, n) - 5.0),
        "pipe_share": share(c("pipes"), n),
    }
    vote = lambda r: F.when(signals[r.signal] > r.bad, -1).when(signals[r.signal] <= r.good, 1).otherwise(0)
    fields = [
        n.alias("n_words"),
        chars.alias("word_chars"),
        c("n_symbols").alias("n_symbols"),
        (c("l.n") - c("l.d")).cast("long").alias("n_dup_lines"),
        c("w.n_repeat_words").alias("n_repeat_words"),
        ((n < 10) | (100 * c("w.n_repeat_words") > 20 * n)).alias("base_failed"),
        *[vote(r).cast("tinyint").alias(r.name) for r in RULES],
    ]
    return m.select(*[F.col(f"`{k}`") for k in keep], F.struct(*fields).alias(name)), name


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Share of good documents and, for each rule, how often good and bad documents get each vote.

    There are at most 3 ** len(RULES) patterns, so this input doesn't grow with the corpus.
    The start takes a document with one bad vote for good or bad alike, one with more for bad:
    bad documents fail in different ways, and most rules have nothing against each of them. A
    rule may turn out weak, but it is never read backwards: a bad vote is at least as likely
    from bad documents as from good ones.
    """
    prior, rates = 0.9, [{1: (0.95, 0.55), 0: (0.04, 0.15), -1: (0.01, 0.3)} for _ in RULES]
    total = sum(n for _, n in patterns)
    if not total:
        return prior, rates
    believed = {votes: (0.97, 0.5, 0.05)[min(2, votes.count(-1))] for votes, _ in patterns}
    for _ in range(rounds):
        good = 0.0
        seen = [{v: [x * 2 for x in r[v]] for v in r} for r in rates]  # a little of the last round smooths the next
        for votes, n in patterns:
            p = believed[votes]
            good += n * p
            for j, v in enumerate(votes):
                seen[j][v][0] += n * p
                seen[j][v][1] += n * (1 - p)
        new_prior = min(0.99, max(0.05, good / total))
        new = []
        for s in seen:
            of_good, of_bad = (sum(x[k] for x in s.values()) for k in (0, 1))
            r = {v: (max(1e-6, s[v][0] / of_good), max(1e-6, s[v][1] / of_bad)) for v in s}
            r[-1] = (min(r[-1]), max(r[-1]))
            r[1] = (max(r[1]), min(r[1]))
            new.append(r)
        moved = abs(new_prior - prior) + sum(abs(a[v][k] - b[v][k]) for a, b in zip(new, rates, strict=True) for v in a for k in (0, 1))
        prior, rates = new_prior, new
        believed = {votes: posterior(votes, prior, rates) for votes in believed}
        if moved < 1e-9:
            break
    return prior, rates


def weights(rates: list[dict[int, tuple[float, float]]]) -> list[dict[int, float]]:
    """Log odds that each vote adds; an abstention adds nothing."""
    return [{v: math.log(g / b) if v else 0.0 for v, (g, b) in r.items()} for r in rates]


def posterior(votes: tuple[int, ...], prior: float, rates: list[dict[int, tuple[float, float]]]) -> float:
    z = math.log(prior / (1 - prior)) + sum(w[v] for v, w in zip(votes, weights(rates), strict=True))
    return 1 / (1 + math.exp(-min(500.0, max(-500.0, z))))


def judge(docs: DataFrame, keep: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep`` columns of every row, the base counts, ``p_good`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike,
    each on its own. An empty table gives an empty result. Columns beside ``keep`` are ignored;
    where a kept column has the name of a result column, the result column gets the next free
    name (``kept_1`` and so on).

    The kept columns are written once beside the measures, which are dear beside a copy of a text.
    """
    m, name = measured(docs, keep, text)
    m = written(m, "rules")
    votes = [F.col(f"{name}.{r.name}") for r in RULES]
    counted = m.groupBy(*[v.alias(r.name) for v, r in zip(votes, RULES, strict=True)]).count()
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in counted.collect())  # at most 3 ** 9 rows
    prior, rates = fit(patterns)
    z = F.lit(math.log(prior / (1 - prior)))
    for v, w in zip(votes, weights(rates), strict=True):
        z = z + F.when(v == 1, w[1]).when(v == 0, 0.0).otherwise(w[-1])
    p_good = 1 / (1 + F.exp(-z))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    free = {b: fresh(m, b) for b in [*base, "p_good", "kept"]}
    failed = F.col(f"{name}.base_failed")
    return m.select(
        *[F.col(f"`{k}`") for k in keep],
        *[F.col(f"{name}.{b}").alias(free[b]) for b in base],
        p_good.alias(free["p_good"]),
        (~failed & (p_good >= threshold)).alias(free["kept"]),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with their own columns.

    Null, empty and blank texts go, as they fail the base rule. Null ids don't matter, repeated
    rows stay or go alike, an empty table stays empty, and any other columns are passed on.
    """
    judged = judge(docs, docs.columns)
    return judged.filter(judged[judged.columns[-1]]).select(*[F.col(f"`{c}`") for c in docs.columns])
