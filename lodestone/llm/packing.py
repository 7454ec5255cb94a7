"""Best-fit packing by a grouping genetic algorithm.

Documents become token sequences; only those longer than a sequence are cut.
Pieces are dealt by a hash into shards of about SHARD pieces. A shard is first
packed best fit, greatest first; if that meets the lower bound it is done, as no
packing has fewer sequences. Otherwise several islands evolve packings: crossover
injects whole well-filled bins of one parent into another, bins that now hold a
piece twice are dissolved, and the displaced pieces go to the bins that they fit
best. After each epoch every island's elite migrates to the next island, and in
the end the best packing found wins. A shard is all that a task ever holds, so
memory is bounded and a lost executor costs a shard.

Defined cases: null text counts as empty, and an empty text is one piece of one
token (the closing id); an empty table gives no rows; repeated rows are packed
as pieces of their own; pieces of a whole sequence fill one alone; other columns
are left out. Special tokens of the vocabulary that a text spells out get their own
ids, as the library gives them. Equal inputs give equal packings.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from array import array
from bisect import bisect_left, insort
from unicodedata import is_normalized

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

LENGTH = 2048
SHARD = 4_000
#: Islands to a shard; packings on one; generations between migrations, and how many of these rounds.
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2, 5, 10, 3
CACHE = 500_000
END = 0
#: How the byte-level alphabet writes the bytes that aren't printable: in order, from 256 on.
BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
LETTERS = r"|[\\p{L}]+|[\\p{N}]|"

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Tokenizer:
    """Ids of whole texts by a vocabulary file of the tokenizers library whose pre-tokenizer never joins across a space.

    Words are remembered; those that are new to a batch are encoded together.
    """

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        # Words of letters go to the model itself if the steps before it are known to leave them whole.
        steps = json.loads(self.library.to_str())
        self.direct = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and LETTERS in str((steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern"))
        self.ends = {e: array("I", self.library.encode(e, add_special_tokens=False).ids).tobytes() for e in ("", ".", ",")}

    def _learn(self, words: set[str]) -> None:
        if len(self.young) >= CACHE:
            self.young, self.old = {"": b""}, self.young
        new = []
        for w in words:
            if (v := self.old.get(w)) is not None:
                self.young[w] = v
            else:
                new.append(w)
        # Letters and what follows them are pieces of their own, so "word." is "word" and ".".
        plain = []
        for w in new:
            end = w[-1] if w[-1] in ".," else ""
            stem = self._stem(w[:-1] if end else w)
            if stem is None:
                plain.append(w)
                continue
            if (v := self.young.get(stem)) is None:
                v = self.young[stem] = array("I", [t.id for t in self.library.model.tokenize(stem.encode("utf-8").decode("latin-1").translate(BYTES))]).tobytes()
            self.young[w] = v + self.ends[end]
        for w, e in zip(plain, self.library.encode_batch(plain, add_special_tokens=False) if plain else [], strict=True):
            self.young[w] = array("I", e.ids).tobytes()

    def _stem(self, word: str) -> str | None:
        """A word of letters alone as the normalizer makes it, which the model can take as it is; None for any other word."""
        if not self.direct or not word.isalpha():
            return None
        if word.isascii():
            return word.lower()
        low = "".join([c.lower() for c in word])  # letter by letter, as the library does
        return low if low.isalpha() and is_normalized("NFC", word) and is_normalized("NFC", low) else None

    def batch(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, as unsigned 32-bit integers."""
        out = []
        for t in batch:
            words = t.replace("\n", " ").split(" ")
            found = list(map(self.young.get, words))
            if None in found:
                missing = {w for w, v in zip(words, found, strict=True) if v is None}
                self._learn(missing)
                get = self.young.get
                found = [get(w) if v is None else v for w, v in zip(words, found, strict=True)]
            out.append(b"".join(found))
        return out


_tokenizers: dict[str, Tokenizer] = {}


def _cut(path: str, length: int):
    def run(batches):
        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer(path)
        tok, size, end = _tokenizers[path], 4 * length, array("I", [END]).tobytes()
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            rows = []
            for d, ids in zip(b.column("doc_id").to_pylist(), tok.batch(b.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((uid, d, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of at most length tokens, in place; no shuffle."""
    return texts(docs).mapInArrow(_cut(path, length), PIECES)


# --- grouping genetic algorithm over one shard; a packing is a list of bins, a bin a tuple of item positions


def best_fit(items, sizes: list[int], length: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put items, in the order given, each into the fullest bin that still has room, else a new one."""
    bins = [] if bins is None else bins
    room = sorted((length - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        s = sizes[i]
        at = bisect_left(room, (s, -1))
        if at < len(room):
            r, k = room.pop(at)
            bins[k].append(i)
        else:
            r, k = length, len(bins)
            bins.append([i])
        if r > s:
            insort(room, (r - s, k))
    return bins


def fitness(bins: list[list[int]], sizes: list[int], length: int) -> tuple[int, float]:
    """Fewer bins first, then fuller full ones."""
    return len(bins), -sum((sum(sizes[i] for i in b) / length) ** 2 for b in bins)


def cross(giver: list[list[int]], taker: list[list[int]], sizes: list[int], length: int, rng: random.Random, share: float = 0.3) -> list[list[int]]:
    """Inject a share of giver's best-filled bins whole into taker, dissolve the bins they clash with, best-fit what that displaces."""
    full = sorted(giver, key=lambda b: -sum(sizes[i] for i in b))
    injected = [b for b in full[: max(1, len(full) * 2 // 3)] if rng.random() < share] or full[:1]
    taken = {i for b in injected for i in b}
    child = [list(b) for b in injected]
    displaced = []
    for b in taker:
        if taken.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(displaced, sizes, length, child)


def mutate(bins: list[list[int]], sizes: list[int], length: int, rng: random.Random) -> list[list[int]]:
    """Dissolve the emptiest bins and a few others, then best-fit their items."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = set(order[: max(1, len(bins) // 50)]) | {k for k in order if rng.random() < 0.02}
    items = sorted((i for k in gone for i in bins[k]), key=lambda i: (-sizes[i], i))
    return best_fit(items, sizes, length, [list(b) for k, b in enumerate(bins) if k not in gone])


def seed_packing(sizes: list[int], length: int) -> list[list[int]]:
    """Best fit, greatest first."""
    return best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, length)


def evolve(sizes: list[int], length: int, seed: int, elites: list[list[list[int]]] | None = None, population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing of items of the given sizes that one island finds; elites: packings that it begins with, its own or migrated ones. Ends at the lower bound."""
    rng = random.Random(seed)
    floor = -(-sum(sizes) // length)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    group: list[tuple[tuple[int, float], list[list[int]]]] = []

    def enter(bins):
        group.append((fitness(bins, sizes, length), bins))

    for e in elites or [seed_packing(sizes, length)]:
        enter([list(b) for b in e])
    while len(group) < population:  # the same, with the order blurred
        blur = {i: -sizes[i] * rng.uniform(0.93, 1.0) for i in order}
        enter(best_fit(sorted(order, key=blur.__getitem__), sizes, length))
    group.sort(key=lambda g: g[0])
    # Small shards get as many more generations as theirs are cheaper.
    for _ in range(min(50 * generations, max(generations, generations * SHARD // max(1, len(sizes))))):
        if group[0][0][0] <= floor:
            break
        a, b = sorted(rng.sample(range(len(group)), 2)) if len(group) > 1 else (0, 0)
        enter(cross(group[a][1], group[b][1], sizes, length, rng))
        enter(cross(group[b][1], group[0][1], sizes, length, rng))
        enter(mutate(group[0][1], sizes, length, rng))
        group = sorted(group, key=lambda g: g[0])[: max(population, 1)]
    return group[0][1]


COLUMNS = [c.split()[0] for c in PIECES.split(", ")]
STATE = f"shard long, island int, {PIECES}, bin int, done boolean"


def _state(pdf, island: int, bins: list[list[int]], done: bool):
    import pandas as pd

    at = [0] * len(pdf)
    for k, b in enumerate(bins):
        for i in b:
            at[i] = k
    return pd.DataFrame({"shard": pdf["shard"], "island": island, **{c: pdf[c] for c in COLUMNS}, "bin": at, "done": done}).astype({"island": "int32", "piece": "int32", "bin": "int32"})


def _bins(at: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(at):
        bins.setdefault(k, []).append(i)
    return [*bins.values()]


def _seed(length: int):
    """The packing that all islands of a shard begin with; done: it meets the lower bound, so none can be better."""

    def run(pdf):
        pdf = pdf.sort_values("uid", kind="stable").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        bins = seed_packing(sizes, length)
        return _state(pdf, -1, bins, len(bins) <= -(-sum(sizes) // length))

    return run


def _epoch(length: int, epoch: int):
    """One island's generations, from its own best packing and the one that migrated to it."""

    def run(key, pdf):
        parts = [g.sort_values("uid", kind="stable").reset_index(drop=True) for _, g in pdf.groupby("guest")]
        sizes = parts[0]["length"].tolist()
        best = evolve(sizes, length, (int(key[0]) * 1_000_003 + int(key[1])) * 101 + epoch, elites=[_bins(g["bin"].tolist()) for g in parts])
        return _state(parts[0], int(key[1]), best, len(best) <= -(-sum(sizes) // length))

    return run


def _settle(length: int):
    """Sequences of a shard, from its islands' best packing."""

    def run(key, pdf):
        import pandas as pd

        choices = []
        for island, g in pdf.groupby("island"):
            g = g.sort_values("uid", kind="stable").reset_index(drop=True)
            bins = _bins(g["bin"].tolist())
            choices.append((fitness(bins, g["length"].tolist(), length), island, bins, g))
        _, _, bins, g = min(choices, key=lambda c: c[:2])
        sizes, seq, off = g["length"].tolist(), [0] * len(g), [0] * len(g)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i] = (int(key[0]) << 32) + k, at
                at += sizes[i]
        return pd.DataFrame({**{c: g[c] for c in COLUMNS[1:]}, "sequence_id": seq, "offset": off}).astype({"piece": "int32"})

    return run


def pack(pieces: DataFrame, length: int = LENGTH, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Sequences of at most length tokens for pieces (PIECES): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    pieces must be fixed (materialized): it is read more than once. Shards whose
    seed meets the lower bound are done; the others evolve on islands, in epochs
    between which each island's best packing also goes to the next one.
    """
    whole = pieces.filter(F.col("length") >= length).select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("-1 - uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.filter(F.col("length") < length)
    shards = max(1, -(-part.count() // shard))
    dealt = part.withColumn("shard", F.expr(f"pmod(xxhash64(uid), {shards})"))
    seeded = materialize(dealt.groupBy("shard").applyInPandas(_seed(length), STATE), "seeded")
    settled = seeded.filter("done")
    state = seeded.filter("not done").withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)])))
    for epoch in range(epochs):
        if not state.limit(1).count():
            break
        guests = state.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)) if epoch and islands > 1 else F.array(F.lit(0))))
        met = guests.withColumn("island", F.pmod(F.col("island") + F.col("guest"), F.lit(islands)))
        evolved = materialize(met.groupBy("shard", "island").applyInPandas(_epoch(length, epoch), STATE), "islands")
        over = evolved.filter("done").select("shard").distinct()
        settled = settled.unionByName(evolved.join(over, "shard", "left_semi"))
        state = evolved.join(over, "shard", "left_anti")
    return whole.unionByName(settled.unionByName(state).groupBy("shard").applyInPandas(_settle(length), PACKED))


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Tokenize, cut and pack all rows of docs. path: a vocabulary file that every executor has."""
    return pack(materialize(cut_documents(docs, path, length), "pieces"), length)
