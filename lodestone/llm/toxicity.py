"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents (at most ``max_examples`` of them and
``max_chars`` characters) is turned into TF-IDF vectors over all of their words;
document frequencies come from all documents, and words that the labels bear on
weigh more (``bearing``), but none weighs less than its idf or is left out. Words
that no example holds count neither for nor against a similarity.

Examples stand in blocks of BLOCK. The lists of rare words are added up in full;
of the words that stand in many examples the greatest weight in each block is
kept, so a block's greatest possible similarity is known before these words are
looked at, and a block that cannot hold one of the k nearest examples is passed
over. Blocks hold examples that resemble each other, which keeps their bounds
tight. The k nearest examples are exact; their similarity-weighted votes,
calibrated by leave-one-out on the examples, are the score, and the nearest of
them are the evidence.

Defined cases: null and empty texts, like all texts without a known word, get
the calibrated rate of such texts; labels that are null or name no document are
ignored and of several labels on one document the highest holds; of several
texts of one labelled doc_id the one of smallest hash is the example; documents
without an id are scored like others; without any labelled row every score is 0;
similarities equal in 12 places go to the lower position in the index; repeated
rows are scored each; an empty table gives no rows. Columns besides id and text
are never read for a score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, texts

WORD = re.compile(r"[^\W\d_]+")
#: What the driver and the broadcast hold is bounded by these.
MAX_EXAMPLES, MAX_CHARS = 5_000, 20_000_000
NEIGHBOURS = 15
#: Texts scored together; examples in a block.
BATCH, BLOCK = 64, 64
REJECT_FROM = 0.7
#: Words of more than one in COMMON_FROM examples are looked at block by block, the MAX_COMMON most common ones; this changes the speed only.
COMMON_FROM, MAX_COMMON = 16, 512
#: So many standard deviations from chance double a word's weight.
DOUBLE_AT = 2.0
#: Into so many rows a task's counts of words are cut.
RANGES = 64


def term_counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def hashed(words) -> np.ndarray:
    """The 64-bit hash by which a word is known, of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def look_up(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in terms (sorted hashes), -1 if it isn't there."""
    if not len(terms):
        return np.full(len(hashes), -1, np.int64)
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    return np.where(terms[at] == hashes, at, -1)


def bearing(seen: np.ndarray, hits: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """Factors of terms in seen examples, hits of them toxic, of n examples and toxic ones: 1 at the rate of chance, and rising with the square of the distance from it."""
    rate = toxic / n if n else 0.0
    return 1 + (hits - seen * rate) ** 2 / (seen * rate * (1 - rate) + 1) / DOUBLE_AT**2


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples: posting lists of rare terms, and rows of common ones with their greatest weights in each block."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], ids: list[int]):
        """terms: sorted hashes; vectors: rising places in terms and unit weights of each example; those without any are left out."""
        self.terms, self.weights = terms, np.asarray(weights, np.float64)
        some = [i for i, (ts, _) in enumerate(vectors) if len(ts)]
        n, m = len(some), len(terms)
        size = np.array([len(vectors[i][0]) for i in some], np.int64)
        ts = np.concatenate([vectors[i][0] for i in some]).astype(np.int32) if n else np.zeros(0, np.int32)
        ws = np.concatenate([vectors[i][1] for i in some]).astype(np.float32) if n else np.zeros(0, np.float32)
        seen = np.bincount(ts, minlength=m)
        common = np.argsort(-seen, kind="stable")[:MAX_COMMON]
        common = common[seen[common] * COMMON_FROM > n]
        self.slot = np.full(m, -1, np.int32)
        self.slot[common] = np.arange(len(common))
        who, slot = np.repeat(np.arange(n, dtype=np.int32), size), self.slot[ts]
        rows = np.zeros((len(common), -(-n // BLOCK) * BLOCK), np.float32)
        rows[slot[slot >= 0], who[slot >= 0]] = ws[slot >= 0]
        # Like examples side by side: by label, then by the common word of the greatest weight.
        heaviest = rows[:, :n].argmax(axis=0) if len(common) else np.zeros(n, np.int64)
        order = np.lexsort(([ids[i] for i in some], heaviest, [toxic[i] for i in some])) if n else np.zeros(0, np.int64)
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.common = np.zeros_like(rows)
        self.common[:, :n] = rows[:, order]
        self.ids = np.array([ids[some[i]] for i in order], np.int64)
        self.toxic = np.array([toxic[some[i]] for i in order], np.float64)
        ts, who, ws = ts[slot < 0], place[who[slot < 0]], ws[slot < 0]
        order = np.lexsort((who, ts))
        self.who, self.rare = who[order], ws[order]
        self.begin = np.searchsorted(ts[order], np.arange(m + 1)).astype(np.int32)
        self._widen()

    def _widen(self) -> None:
        """What follows from the rest: block rows and maxima in double precision."""
        c, n = self.common.shape
        self.blocks = self.common.reshape(c, n // BLOCK, BLOCK).transpose(1, 0, 2).astype(np.float64, order="C")
        self.most = self.blocks.max(axis=2).T if n else np.zeros((c, 0))
        self.visited = self.passed = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("blocks", "most")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._widen()

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of a text's word counts over the index terms: rising terms, and their weights."""
        ts = look_up(self.terms, hashed(counts))
        ns = np.fromiter(counts.values(), np.float64, len(counts))[ts >= 0]
        ts = ts[ts >= 0]
        order = np.argsort(ts)
        return unit(ts[order], (1 + np.log(ns[order])) * self.weights[ts[order]])

    def near(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list | None = None) -> list[list[tuple[float, int]]]:
        """(similarity, position) of the k nearest examples with a similarity above 0 of each of some vectors of rising terms and their weights; without: an id for each to leave out."""
        n, count = len(self.ids), len(queries)
        if not n:
            return [[] for _ in queries]
        held, score = np.zeros((count, len(self.common))), np.zeros((count, self.common.shape[1]))
        for j, (ts, qs) in enumerate(queries):
            slot = self.slot[ts]
            held[j, slot[slot >= 0]] = qs[slot >= 0]
            rare = ts[slot < 0]
            begin, size = self.begin[rare], self.begin[rare + 1] - self.begin[rare]
            at = np.repeat(begin - np.cumsum(size, dtype=np.int32) + size, size) + np.arange(size.sum(), dtype=np.int32)
            score[j] = np.bincount(self.who[at], self.rare[at] * np.repeat(qs[slot < 0], size), score.shape[1])
        split = score.reshape(count, -1, BLOCK)
        bound = split.max(axis=2) + held @ self.most + 1e-9
        skip = [np.flatnonzero(self.ids == i) for i in without] if without is not None else None
        # The most promising blocks first: their k-th best similarity is the one to beat.
        tops = min(bound.shape[1], 1 + -(-k // BLOCK))
        best = np.argpartition(-bound, tops - 1, axis=1)[:, :tops]
        seen = np.zeros(bound.shape, bool)
        np.put_along_axis(seen, best, True, axis=1)
        self._visit(seen, held, split)
        beat = np.zeros(count)
        for j in range(count):
            if skip is not None:
                score[j, skip[j]] = -2.0
            done = split[j, best[j]].ravel()
            if len(done) > k:
                beat[j] = max(0.0, np.partition(done, -k)[-k])
        more = ~seen & (bound >= beat[:, None])
        self._visit(more, held, split)
        self.visited += int(seen.sum() + more.sum())
        self.passed += int(seen.size - seen.sum() - more.sum())
        out = []
        for j in range(count):
            # What is in no visited block has less than the similarity to beat, and where that is 0 all blocks are visited.
            at = np.flatnonzero(score[j] >= max(beat[j] - 1e-9, 1e-13))
            found = np.round(score[j, at], 12)
            order = np.lexsort((at, -found))[:k]
            out.append([(float(found[i]), int(at[i])) for i in order if found[i] > 0])
        return out

    def _visit(self, wanted: np.ndarray, held: np.ndarray, split: np.ndarray) -> None:
        """Add the common terms' share to the similarities of the wanted (query, block) pairs."""
        for b in np.flatnonzero(wanted.any(axis=0)).tolist():
            rows = np.flatnonzero(wanted[:, b])
            split[rows, b] += held[rows] @ self.blocks[b]

    def vote(self, near: list[tuple[float, int]], prior: float, weight: float = 0.25) -> float:
        """Labels weighted by the similarity, drawn to prior where nothing is near."""
        ws = [s for s, _ in near]
        return (sum(w * self.toxic[i] for w, (_, i) in zip(ws, near, strict=True)) + weight * prior) / (sum(ws) + weight)


def unit(ts: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ts, v / math.sqrt(v @ v) if len(ts) else v


class Model:
    """Index, the rate of toxic examples among those without a known term, and the calibration of votes."""

    def __init__(self, index: BlockMaxIndex | None, bare: float, prior: float, steps: tuple[list[float], list[float]]):
        self.index, self.bare, self.prior, self.steps = index, bare, prior, steps

    def score(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Score and evidence of each text."""
        if self.index is None:
            return [(self.bare, []) for _ in texts]
        out = []
        for a in range(0, len(texts), BATCH):
            queries = [self.index.vector(term_counts(t)) for t in texts[a : a + BATCH]]
            for (ts, _), near in zip(queries, self.index.near(queries), strict=True):
                if len(ts):
                    out.append((float(np.interp(self.index.vote(near, self.prior), *self.steps)), [(int(self.index.ids[i]), s) for s, i in near[:3]]))
                else:
                    out.append((self.bare, []))
        return out


def calibrate(raw: list[float], toxic: list[int]) -> tuple[list[float], list[float]]:
    """Isotonic regression of labels on votes, as the points of a rising line from (0, .) to (1, .)."""
    pools: list[list[float]] = []  # sum of votes, sum of labels, n
    for r, y in sorted(zip(raw, toxic, strict=True)):
        pools.append([r, float(y), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            r2, y2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + r2, pools[-1][1] + y2, pools[-1][2] + n2]
    xs = [p[0] / p[2] for p in pools]
    ys = [(p[1] + 0.1) / (p[2] + 0.2) for p in pools]  # never quite 0 or 1
    ys = list(np.maximum.accumulate(ys)) if ys else []
    return ([0.0, *xs, 1.0], [min(ys[0], 0.01) if ys else 0.0, *ys, ys[-1] if ys else 1.0])


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]], frequency: np.ndarray, n_docs: int, terms: np.ndarray) -> Model:
    """Model of rows (id, toxic, rising places in terms, counts). frequency: in how many documents each of terms stands.

    For the calibration an example is a query from whose term weights its own label is taken out.
    """
    if not rows:
        return Model(None, 0.0, 0.0, ([0.0, 1.0], [0.0, 1.0]))
    toxic = [r[1] for r in rows]
    n, p = len(rows), sum(toxic)
    prior = p / n
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    seen, hits = np.zeros(len(terms)), np.zeros(len(terms))
    for _, y, ts, _ in rows:
        seen[ts] += 1
        hits[ts] += y
    held = [(r[2], 1 + np.log(r[3])) for r in rows]
    weights = idf * bearing(seen, hits, n, p)
    index = BlockMaxIndex(terms, weights, [unit(ts, tf * weights[ts]) for ts, tf in held], toxic, [r[0] for r in rows])
    bare = [y for y, (ts, _) in zip(toxic, held, strict=True) if not len(ts)]
    some = [(r[0], r[1], ts, tf) for r, (ts, tf) in zip(rows, held, strict=True) if len(ts)]
    raw = []
    for a in range(0, len(some), BATCH):
        part = some[a : a + BATCH]
        queries = [unit(ts, tf * idf[ts] * bearing(seen[ts] - 1, hits[ts] - y, n - 1, p - y)) for _, y, ts, tf in part]
        raw += [index.vote(near, prior) for near in index.near(queries, without=[x[0] for x in part])]
    return Model(index, (sum(bare) + prior) / (len(bare) + 1), prior, calibrate(raw, [x[1] for x in some]))


def _frequencies(held):
    """Per partition: in how many texts each of the held terms stands, in RANGES rows of counts, and how many texts there are (range -1)."""

    def run(batches):
        terms = held.value
        seen, n = np.zeros(len(terms), np.int64), 0
        for b in batches:
            n += b.num_rows
            for a in range(0, b.num_rows, 512):  # sorted hashes are found faster, and a few hundred texts of them are small
                found = np.concatenate([hashed(set(WORD.findall(t.lower()))) for t in b.column("text")[a : a + 512].to_pylist()])
                at = look_up(terms, np.sort(found))
                np.add.at(seen, at[at >= 0], 1)
        parts = np.array_split(seen, RANGES)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(RANGES)], pa.int32()), pa.array([np.array([n], np.int64).tobytes(), *(x.tobytes() for x in parts)], pa.binary())], names=["range", "counts"])

    return run


def _total(batches):
    """The sum of the counts of each range."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for r, c in zip(b.column("range").to_pylist(), b.column("counts").to_pylist(), strict=True):
            c = np.frombuffer(c, np.int64)
            total[r] = total[r] + c if r in total else c
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["range", "counts"])


def _examples(batches):
    """Each labelled text as hashes and counts of its words, and a sketch that texts of the same words in the same order share, so that the driver gets no texts."""
    for b in batches:
        out = []
        for t in b.column("text").to_pylist():
            words = WORD.findall(t.lower())
            counts = Counter(words)
            out.append((hashlib.sha256(" ".join(words).encode()).digest(), hashed(counts).tobytes(), np.fromiter(counts.values(), np.int32, len(counts)).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *(pa.array([x[k] for x in out], pa.binary()) for k in range(3))], names=["doc_id", "toxic", "sketch", "words", "counts"])


def choose(corpus: DataFrame, labels: DataFrame, max_examples: int, max_chars: int) -> DataFrame:
    """doc_id, toxic of the sample: labelled documents by a hash of doc_id, as many as both bounds allow."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = corpus.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    rows = known.join(size, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).collect()
    total, out = 0, []
    for r in rows:
        total += r["n"]
        if total <= max_chars:
            out.append((r["doc_id"], r["toxic"]))
    return corpus.sparkSession.createDataFrame(out, "doc_id long, toxic int")


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_chars: int = MAX_CHARS) -> Model:
    """Learn from labels (doc_id, toxic): a sample of max_examples documents and max_chars characters at most, the first by a hash of doc_id; corpus figures from all docs.

    Of examples of the same words in the same order and the same label one stays.
    The sample is bounded, so the driver holds at most the word counts of that
    many texts, and their vocabulary may be broadcast.
    """
    corpus = texts(docs)
    # The ids of the sample are at most max_examples, so they may be broadcast; the texts stay where they are but for those of a repeated id, of which one is taken.
    chosen = corpus.join(F.broadcast(choose(corpus, labels, max_examples, max_chars)), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    by_sketch: dict[tuple[bytes, int], tuple] = {}
    for b in chosen.mapInArrow(_examples, "doc_id long, toxic int, sketch binary, words binary, counts binary").toArrow().to_batches(max_chunksize=500):
        for r in b.to_pylist():
            key = (r["sketch"], r["toxic"])
            if key not in by_sketch or r["doc_id"] < by_sketch[key][0]:  # one example of equal texts and labels
                by_sketch[key] = (r["doc_id"], r["toxic"], np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int32))
    rows = sorted(by_sketch.values(), key=lambda x: x[0])
    terms = np.unique(np.concatenate([r[2] for r in rows])) if rows else np.zeros(0, np.uint64)
    frequency, n_docs = np.zeros(len(terms)), 0
    if len(terms):
        places = docs.sparkSession.sparkContext.broadcast(terms)
        counted = corpus.select("text").mapInArrow(_frequencies(places), "range int, counts binary").repartition("range").mapInArrow(_total, "range int, counts binary")
        found = {r["range"]: np.frombuffer(r["counts"], np.int64) for r in counted.toArrow().to_pylist()}
        n_docs, frequency = int(found[-1][0]), np.concatenate([found[k] for k in range(RANGES)])
    for k, (i, y, words, counts) in enumerate(rows):
        ts = look_up(terms, words)
        order = np.argsort(ts)
        rows[k] = (i, y, ts[order].astype(np.int32), counts[order])
    return train(rows, frequency, n_docs, terms)


def _slices(batches, rows: int = 1_024):
    """Batches of fewer rows, so that few texts are held twice."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (ids and similarities of the nearest examples) of each row of docs; no shuffle. The model is bounded, so it may be broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in _slices(batches):
            found = m.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([min(1.0, max(0.0, s)) for s, _ in found], pa.float64()), pa.array([",".join(f"{i}:{x:.4f}" for i, x in e) for _, e in found], pa.string())], names=["doc_id", "score", "evidence"]
            )

    return texts(docs).mapInArrow(run, "doc_id long, score double, evidence string")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of doc_id as text, modulo 3, isn't 1."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def drop_toxic(docs: DataFrame, labels: DataFrame, reject_from: float = REJECT_FROM) -> DataFrame:
    """docs without the rows whose text scores reject_from or more: decided row by row, in place, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, training_labels(labels)))
    release(docs.sparkSession)

    def run(batches):
        m = held.value
        for b in _slices(batches):
            kept = [x < reject_from for x, _ in m.scores([t or "" for t in b.column("text").to_pylist()])]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
