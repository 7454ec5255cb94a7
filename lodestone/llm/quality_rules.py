"""Quality rules as weak supervision.

Each rule looks at one trait of a text and votes good (+1), bad (-1) or abstains
(0). Rules are never taken at face value: expectation-maximisation over the
counts of vote patterns estimates how often each rule votes either way in good
and in bad texts, and a text is kept when its posterior probability of being
good reaches the threshold. What the driver holds is one row per distinct vote
pattern, at most 3 ** len(RULES), whatever the size of the corpus.

Defined cases: null text counts as empty; an empty text has no words, only
abstentions and fails the base rules; with an empty table nothing is estimated
and nothing returned; repeated rows vote and are returned each; texts are read
whole. Columns besides id and text are left out of the scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
#: Common function words of the corpus languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for on was be with as are this by from or an a "
    "le la les de des et en un une que qui dans pour par sur est au aux du pas avec "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch "
    "el los las que y se del por con para una su al lo como más".split()
)
RULES = ("symbols", "capitals", "shouting", "repeats", "repeated_lines", "vocabulary", "function_words", "letters")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
THRESHOLD = 0.5

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
VOTES = ", ".join(f"v_{r} int" for r in RULES)


def measure(text: str) -> tuple[tuple[int, int, int, int, int], list[str]]:
    """The five base figures of a text, and its words."""
    words = WORD.findall(text)
    n = len(words)
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line in seen:
                dup += WORD.search(line) is not None
            else:
                seen.add(line)
    repeated = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            counts = Counter(grams)
            covered = 0  # first position not yet counted
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    return (n, sum(map(len, words)), n_symbols, dup, repeated), words


def _vote(value: float, good_to: float, bad_from: float) -> int:
    return 1 if value <= good_to else -1 if value >= bad_from else 0


def vote(figures: tuple[int, int, int, int, int], words: list[str], n_lines: int) -> list[int]:
    """The vote of each of RULES."""
    n, chars, symbols, dup, repeated = figures
    if not n:
        return [0] * len(RULES)
    capitals = sum(w.isupper() and len(w) > 1 for w in words) / n
    shouting = sum(w.endswith("!!") for w in words) / n
    common = len(FUNCTION_WORDS.intersection(words)) and sum(w in FUNCTION_WORDS for w in words) / n
    letters = sum(map(str.isalpha, words)) / n
    return [
        _vote(symbols / n, 0.05, 0.15),
        _vote(capitals, 0.15, 0.35),
        _vote(shouting, 0.02, 0.1),
        _vote(repeated / n, 0.2, 0.45),
        _vote(dup / n_lines, 0.2, 0.45),
        _vote(-len(set(words)) / n, -0.5, -0.35) if n <= 400 else _vote(-len(set(words)) / n, -0.3, -0.15),
        _vote(-common, -0.12, -0.02) if n >= 20 else 0,
        _vote(-letters, -0.7, -0.45),
    ]


def _batches(batches):
    for b in batches:
        rows = []
        for t in b.column("text").to_pylist():
            f, words = measure(t)
            rows.append((*f, *vote(f, words, t.count("\n") + 1)))
        cols = list(zip(*rows, strict=True)) or [()] * (5 + len(RULES))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.int32()) for c in cols[5:])], names=["doc_id", *(x.split()[0] for x in MEASURES.split(", ")), *(f"v_{r}" for r in RULES)])


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 100, prior_good: float = 0.9) -> dict:
    """Expectation-maximisation over vote patterns and their counts.

    Starts from: a text is likely bad if any rule says bad. Returns the share of
    good texts, each rule's vote probabilities in both classes, its accuracy,
    and the posterior of every pattern.
    """
    total = sum(patterns.values())
    m = len(RULES)
    good = {p: 0.1 if -1 in p else 0.95 for p in patterns}
    share, table = prior_good, None
    for _ in range(rounds):
        mass = [[{v: 1.0 for v in (-1, 0, 1)} for _ in range(m)] for _ in range(2)]
        weight = [3.0, 3.0]
        for p, n in patterns.items():
            for c, q in ((1, good[p]), (0, 1 - good[p])):
                weight[c] += n * q
                for j, v in enumerate(p):
                    mass[c][j][v] += n * q
        table = [[{v: x / weight[c] for v, x in mass[c][j].items()} for j in range(m)] for c in range(2)]
        share = min(0.99, max(0.01, (weight[1] - 3 + prior_good) / (total + 1)))
        new = {}
        for p in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(table[1][j][v] / table[0][j][v]) for j, v in enumerate(p) if v)
            new[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        change = max((abs(new[p] - good[p]) for p in patterns), default=0.0)
        good = new
        if change < 1e-9:
            break
    accuracy = {r: (share * table[1][j][1] + (1 - share) * table[0][j][-1]) / max(1e-12, share * (table[1][j][1] + table[1][j][-1]) + (1 - share) * (table[0][j][1] + table[0][j][-1])) for j, r in enumerate(RULES)} if table else {}
    return {"share": share, "accuracy": accuracy, "table": table, "posterior": good}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base figures, votes, posterior (quality), base_failed and kept of each row of docs.

    The figures are computed once and kept in the shared folder; only pattern
    counts reach the driver, and the posteriors come back as a broadcast of as
    many rows.
    """
    spark = docs.sparkSession
    figures = materialize(texts(docs, id_col, text_col).mapInArrow(_batches, f"doc_id long, {MEASURES}, {VOTES}"), "quality")
    votes = [f"v_{r}" for r in RULES]
    counted = {tuple(r[v] for v in votes): r["n"] for r in figures.groupBy(*votes).agg(F.count("*").alias("n")).collect()}
    model = fit(counted)
    posterior = spark.createDataFrame([(*p, float(q)) for p, q in model["posterior"].items()], f"{VOTES}, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return figures.join(F.broadcast(posterior), votes).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose document judge() keeps; a doc_id is kept if every text under it is."""
    from .common import like_documents

    rejected = judge(docs, threshold=threshold).filter(~F.col("kept")).select(F.col("doc_id").alias("_rejected")).distinct()
    return like_documents(docs.join(rejected, docs["doc_id"].cast("long").eqNullSafe(rejected["_rejected"]), "left_anti"), docs)
