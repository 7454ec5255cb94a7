"""N-gram Jaccard join by signature trees: exact links and their connected components.

A document's set holds the hashes of its distinct word shingles. The join runs in
three steps, none of which drops a pair:

1. Routing. Equal sets become one. For thresholds of PARTED percent or more, linked
   sets of two neighbouring size classes differ in at most d shingles, so of d + 1 + e
   parts by hash e + 1 are equal, and one of these isn't empty if either set has e
   empty parts at most; sets with more are parted again by another hash. The first
   parting leaves out the shingles of very many documents, so that a passage that
   many quote doesn't count. For lower thresholds, in any fixed order of shingles
   linked sets share one of their first (1 - t) * n + 1; the order puts those
   shingles last. Sets that share such a key and a size class are tied, and the
   components of these ties are the clusters that can hold links. Each block of rows
   first ties its own sets and passes on one (key, tied sets) pair a key, packed with
   others of its bucket of keys; a bucket gives a star for each group of tied sets.
   So a frequent key arrives as often as there are blocks, and ties grow with the
   sets, never with their pairs. Chance ties grow with the pairs, though, and in a
   large corpus chain unlike sets to clusters of much of it. Linked sets are tied in
   every family of parts (by other hashes), unlike ones rarely in two: so the sets of
   wide clusters are tied again among themselves, and only those stay together that
   are connected in both, until that cuts off little.
2. Signature trees. A cluster, or a chunk of a large one, is one tree: leaves are
   sets in an order that brings alike ones together, and each node holds the OR
   of its token bitmaps, its range of sizes and the most tokens that share bits.
   Two trees, or a tree with itself, are traversed in pairs of nodes; a pair goes
   no further when its sizes or its greatest possible overlap rule links out, or
   all that it holds is linked already. What is left at the leaves is compared
   exactly.
3. Large clusters. Chunks hold about the square root of the cluster's sets. The
   largest parts of 16 neighbouring chunks, of 16 such groups and so on are compared
   by one set each; after that only sets outside the cluster's largest part visit
   the other chunks, so pairs that are known to be connected are never met again,
   and every other pair is. No task gets a whole cluster.

Defined cases: a null text, or one without words, has an empty set, links with
nothing and is its own component; fewer words than a shingle has make one; equal
sets are linked; repeated rows are returned each, and rows of one doc_id with
unlike texts count as documents that share a name; rows without a doc_id take part
like others, and a component's id is its smallest doc_id that isn't null (null if
it has none); an empty table gives no rows; texts are read whole; other columns are
left out. docs is read twice and has to give the same rows both times (a table, not
a random sample).
"""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import discard, discard_path, like_documents, materialize, materialize_by, release, texts

#: Sets in a chunk at least; shingles that may be put last (their number bounds the broadcast); copies in a block from which one counts as frequent there.
CHUNK, FREQUENT, LOCALLY_FREQUENT = 256, 65_536, 3
FANOUT = 8
MEMBER_BITS = 1 << 24
#: Percent from which a part of a set holds enough shingles (over three at 75, nine at 90) to stand for it alone, and from which frequent shingles don't matter; by how many hashes sets with too many empty parts are parted.
PARTED, CLOSE, PARTINGS = 75, 88, 4
#: A block of rows holds about so many keys (or shingles, when these are counted), and at most SETS rows; input bytes to a bucket of keys, and the range of their number.
BLOCK_KEYS, SETS, BUCKET_BYTES, BUCKETS = 1_500_000, 1 << 20, 4 << 20, (8, 18)
#: Sets from which a cluster is wide and is cut by ties of other families, how many families are tried, and the share of sets in wide clusters that one has to leave in narrower ones for another to follow.
WIDE, FAMILIES, WORTH = 1_024, 8, 0.1
#: Groups of chunks whose largest parts meet, how many of each, and how often groups are grouped again (16 ** 6 chunks at least cover any cluster).
GROUP, HEADS, LEVELS = 16, 4, 6


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z in lower case, words as between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def unpack(packed: bytes, size: int) -> np.ndarray:
    """The shingles of a packed text."""
    return shingles(zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass"), size)


def name_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


class Classes:
    """Size classes such that a set links only into its own and the next ones: integer borders, each over 1 / t of the one before."""

    def __init__(self, percent: int):
        self.percent, self.borders = percent, [1]
        self.shapes: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> int:
        while self.borders[-1] <= n:
            self.borders.append(100 * self.borders[-1] // self.percent + 1)
        lo, hi = 0, len(self.borders)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.borders[mid] <= n:
                lo = mid + 1
            else:
                hi = mid
        return lo - 1

    def shape(self, low: int) -> tuple[int, int]:
        """Parts for linked sets of the classes low and low + 1, and how many of them may be empty; (0, 0) if only equal sets are linked, which are one already."""
        while len(self.borders) < low + 3:
            self.borders.append(100 * self.borders[-1] // self.percent + 1)
        if low not in self.shapes:
            smaller = self.borders[low + 1] - 1
            larger = min(self.borders[low + 2] - 1, 100 * smaller // self.percent)
            d, e = (smaller + larger) * (100 - self.percent) // (100 + self.percent), 0

            def empty(e):  # as many as chance leaves empty, and some more
                mean = (d + 1 + e) * math.exp(-0.85 * self.borders[low] / (d + 1 + e))
                return mean + 2 * math.sqrt(mean)

            while e < (d + 1) // 8 and e < empty(e):
                e += 1
            self.shapes[low] = (d + 1 + e, e) if d else (0, 0)
        return self.shapes[low]

    def parted_keys(self, tokens: np.ndarray, frequent: np.ndarray, family: int = 0) -> np.ndarray:
        """Keys for thresholds of PARTED percent or more: the sums of a set's parts, for both pairs of classes that it may be linked in. family: another number parts by other hashes.

        A linked pair has one more equal part than may be empty. So it shares a
        key of a parting unless both sets have more empty parts than that, and
        then both go on to the next one; in the last, empty parts are keys too.
        """
        c, out = self.of(len(tokens)), []
        rare = tokens
        if len(frequent):
            at = np.searchsorted(frequent, tokens)
            at[at == len(frequent)] = 0
            rare = tokens[frequent[at] != tokens]
        for low in (c - 1, c):
            parts, spare = self.shape(low) if low >= 0 else (0, 0)
            if not parts:
                continue
            for k in range(PARTINGS + 1):
                own = rare if k == 0 else tokens
                mixed = own
                if family:
                    mixed = (own ^ np.uint64(family * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
                part = ((mixed * np.uint64(2 * k + 1) >> np.uint64(20 + k)) % np.uint64(parts)).astype(np.int64)
                sums = np.zeros(parts, np.uint64)
                np.add.at(sums, part, own)
                h = (sums ^ (np.arange(parts, dtype=np.uint64) + np.uint64((low + 1) * (PARTINGS + 1) + k << 32)) * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
                filled = np.bincount(part, minlength=parts) > 0
                enough = parts - int(filled.sum()) <= spare
                out.append(h if k == PARTINGS and not enough else h[filled])
                if enough:
                    break
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def keys(self, tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, family: int = 0) -> np.ndarray:
        """Keys of a set: its parts, or for low thresholds its first shingles in the order, with both size classes where it may meet a partner."""
        if self.percent >= PARTED:
            return self.parted_keys(tokens, frequent, family)
        n = len(tokens)
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        place = np.where(frequent[at] == tokens, rank[at], 0) if len(frequent) else np.zeros(n, np.int64)
        first = n - (-(-self.percent * n // 100)) + 1
        if first < n:
            order = np.lexsort((tokens, place))
            tokens = tokens[order[:first]]
        c = self.of(n)
        # With a partner of the next class this set is the smaller one, and so shares more of itself.
        fewer = tokens[: n - (-(-2 * self.percent * n // (100 + self.percent))) + 1]
        both = np.concatenate([tokens + np.uint64((c + 1) * 0xD1B54A32D192ED03 % 2**64), fewer + np.uint64((c + 2) * 0xD1B54A32D192ED03 % 2**64)])
        return both


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    """Levels of nodes over sets; level 0 are the sets, in the order self.order."""

    def __init__(self, sets: list[np.ndarray], words: int):
        self.sets = sets
        sizes = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((sizes, np.array([s[0] for s in sets], np.uint64)))
        bits = np.zeros((len(sets), words), np.uint64)
        for k, i in enumerate(self.order):
            t = sets[i]
            np.bitwise_or.at(bits[k], (t >> np.uint64(6)) % np.uint64(words), np.uint64(1) << (t & np.uint64(63)))
        sizes = sizes[self.order]
        excess = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, excess)]
        while len(bits) > 1:
            at = np.arange(0, len(bits), FANOUT)
            _, low, high, excess = self.levels[-1]
            bits = np.bitwise_or.reduceat(bits, at, axis=0)
            self.levels.append((bits, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))


class Parts:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def bitmap_words(sets: list[np.ndarray]) -> int:
    most = max(len(s) for s in sets)
    return max(4, min(512, 1 << max(0, math.ceil(math.log2(4 * most / 64)))))


def traverse(a: SignatureTree, b: SignatureTree, percent: int, parts: Parts, name_a: list[int], name_b: list[int]) -> None:
    """Join in parts all linked sets of two trees (or of one with itself); name_*: the position in parts of each set."""
    same = a is b
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if la == 0 and lb == 0:
            x, y = int(a.order[i]), int(b.order[j])
            if not (same and x == y) and parts.find(name_a[x]) != parts.find(name_b[y]) and linked(a.sets[x], b.sets[y], percent):
                parts.join(name_a[x], name_b[y])
            continue
        # Open the higher node; both where they are as high.
        na = range(i * FANOUT, min((i + 1) * FANOUT, len(a.levels[la - 1][1]))) if la and la >= lb else range(i, i + 1)
        nb = range(j * FANOUT, min((j + 1) * FANOUT, len(b.levels[lb - 1][1]))) if lb and lb >= la else range(j, j + 1)
        ca, cb = (la - 1 if la and la >= lb else la), (lb - 1 if lb and lb >= la else lb)
        bits_a, low_a, high_a, ex_a = (v[na.start : na.stop] for v in a.levels[ca])
        bits_b, low_b, high_b, ex_b = (v[nb.start : nb.stop] for v in b.levels[cb])
        overlap = np.bitwise_count(bits_a[:, None, :] & bits_b[None, :, :]).sum(axis=2).astype(np.int64) + np.minimum(ex_a[:, None], ex_b[None, :])
        overlap = np.minimum(overlap, np.minimum(high_a[:, None], high_b[None, :]))
        need = percent * (low_a[:, None] + low_b[None, :])
        fits = ((100 + percent) * overlap >= need) & (100 * high_a[:, None] >= percent * low_b[None, :]) & (100 * high_b[None, :] >= percent * low_a[:, None])
        for x, y in zip(*np.nonzero(fits), strict=True):
            p, q = na.start + int(x), nb.start + int(y)
            if not (same and p > q):
                stack.append((ca, p, cb, q))


def _rows_of(batches, *columns):
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _groups(rows, keys: int):
    """Rows in a row that agree in their first columns."""
    held, group = None, []
    for r in rows:
        if r[:keys] != held:
            if group:
                yield held, group
            held, group = r[:keys], []
        group.append(r)
    if group:
        yield held, group


def _frequent(size: int):
    def often(seen):
        token, n = np.unique(np.concatenate(seen), return_counts=True)
        many = n >= LOCALLY_FREQUENT
        return pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(n[many].astype(np.int64))], names=["token", "n"])

    def run(batches):
        seen, held = [], 0
        for b in batches:
            for t in set(b.column("text").to_pylist()):
                seen.append(shingles(t, size))
                held += len(seen[-1])
                if held >= BLOCK_KEYS:
                    yield often(seen)
                    seen, held = [], 0
        if seen:
            yield often(seen)

    return run


ROUTED = "bucket int, kind int, doc_id long, text_hash long, n_shingles long, name binary, node long, keys binary, owners binary"
TIED = "kind int, doc_id long, text_hash long, n_shingles long, name binary, node long, other long"
_TYPES = {"bucket": pa.int32(), "kind": pa.int32(), "doc_id": pa.int64(), "text_hash": pa.int64(), "n_shingles": pa.int64(), "name": pa.binary(), "node": pa.int64(), "other": pa.int64(), "keys": pa.binary(), "owners": pa.binary()}


def _batch(schema: str, n: int, **columns):
    """A batch of n rows of a schema; columns that aren't given are null."""
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _TYPES[c]) if c in columns else pa.nulls(n, _TYPES[c]) for c in names], names=names)


class Block:
    """Rows of a task, their distinct sets, and the keys of these."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.keys: list[np.ndarray] = []
        self.n_keys, self.rows = 0, []

    def add(self, row: tuple, tokens: np.ndarray, keys_of) -> None:
        name = name_of(tokens) if len(tokens) else None
        at = None
        if name is not None and (at := self.known.get(name)) is None:
            at = self.known[name] = len(self.known)
            self.keys.append(keys_of(tokens))
            self.n_keys += len(self.keys[-1])
        self.rows.append((*row, len(tokens), name, at))

    def batches(self, block: int, bits: int):
        """A row a document (kind 0) with the first set that its own is tied to here (node), and the keys of each bucket with their nodes (kind 1)."""
        sets = len(self.known)
        parts = Parts(sets)
        key = np.concatenate(self.keys) if self.keys else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(sets), [len(k) for k in self.keys]) if self.keys else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        _star(key, owner, parts)
        # A group of tied sets is known by the least hash of their names, so copies have one node in every block and need no tie.
        hashes = np.frombuffer(b"".join(k[:8] for k in self.known), np.int64)
        group = np.fromiter(map(parts.find, range(sets)), np.int64, sets)
        least = np.full(sets, np.iinfo(np.int64).max)
        np.minimum.at(least, group, hashes)
        root = least[group]
        doc_id, text_hash, n, name, at = zip(*self.rows, strict=True)
        node = [None if a is None else int(root[a]) for a in at]
        for a in range(0, len(self.rows), 20_000):
            e = slice(a, a + 20_000)
            yield _batch(ROUTED, len(name[e]), bucket=(np.arange(len(name[e])) + 7919 * (block >> 20)).astype(np.int32) % (1 << bits), kind=np.zeros(len(name[e]), np.int32), doc_id=doc_id[e], text_hash=text_hash[e], n_shingles=n[e], name=name[e], node=node[e])
        if len(key):
            # Sets that share a key are tied by now, so one of them stands for it. 32 bits of a key within its bucket do: a tie by chance is no link.
            first = np.r_[True, key[1:] != key[:-1]]
            key, who = key[first], root[owner[first]]
            bucket, low = (key >> np.uint64(64 - bits)).astype(np.int64), ((key >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            end = np.r_[begin[1:], len(bucket)]
            for a in range(0, len(begin), 2_000):
                spans = list(zip(begin[a : a + 2_000].tolist(), end[a : a + 2_000].tolist(), strict=True))
                yield _batch(ROUTED, len(spans), bucket=bucket[begin[a : a + 2_000]].astype(np.int32), kind=np.ones(len(spans), np.int32), keys=[low[x:y].tobytes() for x, y in spans], owners=[who[x:y].tobytes() for x, y in spans])


def _star(key: np.ndarray, owner: np.ndarray, parts: Parts) -> None:
    """Join in parts all owners of equal keys; key: sorted."""
    if len(key):
        first = np.r_[True, key[1:] != key[:-1]]
        head = owner[np.flatnonzero(first)[np.cumsum(first) - 1]]
        tied = head != owner
        if tied.any():
            for i, j in np.unique(np.stack([owner[tied], head[tied]], axis=1), axis=0).tolist():
                parts.join(i, j)


def _route(size: int, percent: int, held, bits: int, family: int = 0):
    """Rows and keys of each block of a task's rows (ROUTED). held: a broadcast of frequent shingles and their ranks; family: of the parts."""

    def run(batches):
        frequent, rank = held.value
        classes, block, number = Classes(percent), Block(), TaskContext.get().partitionId() << 20
        for b in batches:
            for d, h, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                block.add((d, h), shingles(t, size), lambda s: classes.keys(s, frequent, rank, family))
                if block.n_keys >= BLOCK_KEYS or len(block.rows) >= SETS:
                    yield from block.batches(number, bits)
                    block, number = Block(), number + 1
        if block.rows:
            yield from block.batches(number, bits)

    return run


def _tie(batches):
    """Documents as they are (kind 0), and the sets that share keys, each tied to the first (kind 2). Rows come ordered by bucket; as many buckets as make a block are tied at once."""
    keys, owners, held, now = [], [], 0, None

    def ties():
        key, node = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        again = np.r_[False, key[1:] == key[:-1]]
        again[:-1] |= again[1:]
        names, at = np.unique(node[again], return_inverse=True)
        parts = Parts(len(names))
        _star(key[again], at, parts)
        root = np.fromiter(map(parts.find, range(len(names))), np.int64, len(names))
        tied = np.flatnonzero(root != np.arange(len(names)))
        return _batch(TIED, len(tied), kind=np.full(len(tied), 2, np.int32), node=names[tied], other=names[root[tied]])

    for b in batches:
        kind = b.column("kind").to_numpy()
        if len(docs := np.flatnonzero(kind == 0)):
            d = b.take(pa.array(docs))
            yield _batch(TIED, len(docs), **{c: d.column(c) for c in ("kind", "doc_id", "text_hash", "n_shingles", "name", "node")})
        for i in np.flatnonzero(kind == 1).tolist():
            bucket = b.column("bucket")[i].as_py()
            if bucket != now and held >= BLOCK_KEYS:
                yield ties()
                keys, owners, held = [], [], 0
            now = bucket
            keys.append(np.frombuffer(b.column("keys")[i].as_py(), np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            owners.append(np.frombuffer(b.column("owners")[i].as_py(), np.int64))
            held += len(keys[-1])
    if keys:
        yield ties()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of edges.

    Labels spread along edges and, from the third round on, also jump to their
    label's label, so the rounds grow with the logarithm of a component's width;
    every round is written to the shared folder.
    """
    both = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for k in itertools.count():
        heard = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("heard"))
        new = labels.join(heard, labels["node"] == heard["to"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        if k > 1:  # most components are stars, and done before
            of = labels.select(F.col("node").alias("via"), F.col("label").alias("root"))
            new = new.join(of, new["label"] == of["via"], "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label"))
        seen = Observation()
        new = materialize(new.observe(seen, F.count(F.when(F.col("label") != F.col("old"), 1)).alias("moved")), "labels")
        discard(labels)
        labels = new.drop("old")
        labels._lodestone_path = new._lodestone_path
        if not seen.get["moved"]:
            discard(both)
            release(edges.sparkSession)
            return labels


def _chunk_links(size: int, percent: int):
    """Within each chunk: the part of each set, named by its first set, and how large the part is; sets of large clusters keep their packed texts."""

    def run(batches):
        out = []
        for (cluster, chunk), rows in _groups(_rows_of(batches, "cluster", "chunk", "name", "packed", "is_large"), 2):
            sets, kept = [], []
            for r in rows:
                if kept and kept[-1][2] == r[2]:
                    continue  # a document that is there twice
                s = unpack(r[3], size)
                if len(s) and name_of(s) == r[2]:  # rows of one doc_id may have unlike texts
                    sets.append(s)
                    kept.append(r)
            parts = Parts(len(sets))
            if len(sets) > 1:
                tree = SignatureTree(sets, bitmap_words(sets))
                traverse(tree, tree, percent, parts, range(len(sets)), range(len(sets)))
            roots = [parts.find(i) for i in range(len(sets))]
            count: dict[int, int] = {}
            for r in roots:
                count[r] = count.get(r, 0) + 1
            out += [(cluster, chunk, r[2], kept[root][2], count[root], r[3] if r[4] else None) for r, root in zip(kept, roots, strict=True)]
            if len(out) > 2_000:
                yield _named(out)
                out = []
        if out:
            yield _named(out)

    return run


LINKED = "cluster long, chunk int, name binary, part binary, part_size int, packed binary"


def _named(rows):
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["cluster", "chunk", "name", "part", "part_size", "packed"])


def _visit(size: int, percent: int):
    """Within each group: which parts of the visitors and of the residents are linked (without residents: of the visitors among them)."""

    def run(batches):
        for _, rows in _groups(_rows_of(batches, "cluster", "chunk", "party", "guest", "part", "packed"), 3):
            if not any(r[3] for r in rows):
                continue
            sets = [unpack(r[5], size) for r in rows]
            guests, own = [i for i, r in enumerate(rows) if r[3]], [i for i, r in enumerate(rows) if not r[3]]
            names = sorted({r[4] for r in rows})
            at = {p: i for i, p in enumerate(names)}
            words = bitmap_words(sets)
            tree = SignatureTree([sets[i] for i in guests], words)
            other = SignatureTree([sets[i] for i in own], words) if own else tree
            parts = Parts(len(names))
            traverse(tree, other, percent, parts, [at[rows[i][4]] for i in guests], [at[rows[i][4]] for i in own or guests])
            pairs = [(names[i], names[parts.find(i)]) for i in range(len(names)) if parts.find(i) != i]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

    return run


def _meet(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the parts of each (cluster, chunk, party). groups: those, guest, part, packed."""
    key = ["cluster", "chunk", "party"]
    return groups.repartition(*key).sortWithinPartitions(*key).mapInArrow(_visit(size, percent), "a binary, b binary")


def _large_clusters(sets: DataFrame, chunks: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label) over the parts of clusters of several chunks. sets: LINKED; chunks: cluster, chunks."""
    # One set from each of the largest parts of each chunk, then of each group of chunks, and so on; a group of groups is met under a number of its own.
    heads = sets.filter(F.col("name") == F.col("part")).select("cluster", "chunk", "part", "part_size", "packed")
    rounds = []
    for level in range(LEVELS):
        # Level 0 ranks within chunks, so that no group ever gets more than GROUP * HEADS sets.
        within = Window.partitionBy("cluster", F.floor(F.col("chunk") / GROUP**level)).orderBy(F.col("part_size").desc(), "part")
        heads = heads.withColumn("k", F.row_number().over(within)).filter(F.col("k") <= HEADS).drop("k")
        if level:
            heads = heads.join(chunks.filter(F.col("chunks") > GROUP**level).select("cluster"), "cluster", "left_semi")
        heads = materialize(heads, "heads")
        met = heads.select("cluster", F.floor(F.col("chunk") / GROUP ** (level + 1)).cast("int").alias("chunk"), F.lit(level).alias("party"), F.lit(True).alias("guest"), "part", "packed")
        rounds.append(materialize(_meet(met, size, percent), "hublinks"))
        if not chunks.filter(F.col("chunks") > GROUP ** (level + 1)).limit(1).count():
            break
    found = reduce(DataFrame.unionByName, rounds)
    labels = connected(found)
    now = materialize(sets.join(labels, sets["part"] == labels["node"], "left").select("cluster", "chunk", "part", "packed", F.coalesce("label", "part").alias("label")), "labelled")
    # The label of most sets in each cluster, told to each of its chunks; all other sets visit every chunk, those of four chunks together.
    count = now.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    most = count.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("m")).join(chunks, "cluster").select("cluster", F.col("m.label").alias("main"), "chunks", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    outside = now.join(most, ["cluster", "chunk"]).filter("label <> main").select("cluster", "chunk", "part", "packed", "chunks")
    party = F.floor(F.col("chunk") / 4).cast("int")
    guests = outside.select("cluster", F.explode(F.expr("sequence(0, chunks - 1)")).alias("to"), "chunk", party.alias("party"), "part", "packed").filter("to <> chunk")
    guests = guests.select("cluster", F.col("to").alias("chunk"), "party", F.lit(True).alias("guest"), "part", "packed")
    parties = outside.select("cluster", party.alias("party"), "chunks").distinct().select("cluster", "party", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    residents = now.join(parties, ["cluster", "chunk"]).select("cluster", "chunk", "party", F.lit(False).alias("guest"), "part", "packed")
    return connected(found.unionByName(_meet(guests.unionByName(residents), size, percent)))


def bucket_bits(docs: DataFrame) -> int:
    """So many leading bits of a key name its bucket that buckets stay small however large the input is."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(BUCKETS[1], max(BUCKETS[0], math.ceil(math.log2(max(1, size) / BUCKET_BYTES)) if size > BUCKET_BYTES else 0))


def _tied(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents of routed (ROUTED), and (node, label) of the sets that ties connect."""
    tied, path = materialize_by(routed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tie, TIED), "tied", "kind")
    clusters = connected(tied.filter("kind = 2").select("node", "other"), "node", "other")
    discard_path(routed.sparkSession, f"{path}/kind=2")
    every = tied.filter("kind = 0").select("doc_id", "text_hash", "n_shingles", "name", "node")
    every._lodestone_path = path
    return every, clusters


def _member_bit():
    return F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(MEMBER_BITS))


def _members(chosen: DataFrame):
    """A broadcast of the bitmap of the hashes of chosen (doc_id, text_hash), of a fixed size."""
    bit = _member_bit()
    words = chosen.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(MEMBER_BITS // 64, np.uint64)
    bitmap[np.asarray(words.column("word").to_numpy(), np.int64)] = np.asarray(words.column("bits").to_numpy(), np.int64).view(np.uint64)
    return chosen.sparkSession.sparkContext.broadcast(bitmap)


def _taken(batches, member_of):
    """The rows of batches whose bit is in a bitmap."""
    for b in batches:
        h = np.asarray(b.column("bit").to_numpy(zero_copy_only=False), np.int64)
        yield b.take(pa.array(np.flatnonzero((member_of.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1))))


def _narrowed(rows: DataFrame, clustered: DataFrame, shingle: int, percent: int, held, bits: int) -> DataFrame:
    """clustered (doc_id, text_hash, name, cluster), a materialized part of rows, with wide clusters cut where another family of parts doesn't tie their sets.

    A bitmap tells the rows that are tied again; what it lets through by chance keeps
    its cluster. Clusters are named by a hash: two of one name are one, which loses nothing.
    """
    if percent < PARTED:
        return clustered
    before = None
    for family in range(1, FAMILIES + 1):
        sizes = materialize(clustered.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= WIDE), "wide")
        now = sizes.agg(F.sum("n")).first()[0] or 0
        if not now or (before is not None and now > (1 - WORTH) * before):
            discard(sizes)
            break
        before = now
        member_of = _members(clustered.join(sizes, "cluster", "left_semi"))
        route = _route(shingle, percent, held, bits, family)
        routed = rows.select("doc_id", "text_hash", "text", _member_bit().alias("bit")).mapInArrow(lambda batches, m=member_of, f=route: f(_taken(batches, m)), ROUTED)
        every, ties = _tied(routed)
        node = every.filter("name is not null").groupBy("name").agg(F.min("node").alias("node"))
        tie = node.join(ties, "node", "left").select("name", F.coalesce("label", "node").alias("tie"))
        cut = clustered.join(sizes, "cluster", "left").join(tie, "name", "left")
        cut = materialize(cut.select("doc_id", "text_hash", "name", F.when(F.col("n").isNotNull(), F.xxhash64("cluster", "tie")).otherwise(F.col("cluster")).alias("cluster")), "clustered")
        for old in (clustered, sizes, every, ties):
            discard(old)
        clustered = cut
    return clustered


def _packed(rows: DataFrame, chosen: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text_hash, packed text and columns of chosen (doc_id, text_hash, ...), a materialized part of rows (doc_id, text_hash, text).

    Only chosen documents are moved. They are told by a bitmap of their hashes of
    a fixed size; what it lets through by chance, the join drops. Packed texts are
    a fraction of their shingles' hashes, so texts move and are shingled where
    they arrive.
    """
    member_of = _members(chosen)

    def run(batches):
        met = set()
        for b in _taken(batches, member_of):
            own = [r for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True) if r[:2] not in met and not met.add(r[:2])]
            pack = zstandard.ZstdCompressor(level=3).compress
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.int64()), pa.array([pack(r[2].encode("utf-8", "surrogatepass")) for r in own], pa.binary())], names=["doc_id", "text_hash", "packed"])

    packed = rows.select("doc_id", "text_hash", "text", _member_bit().alias("bit")).mapInArrow(run, "doc_id long, text_hash long, packed binary")
    joined = packed.join(chosen, packed["doc_id"].eqNullSafe(chosen["doc_id"]) & (packed["text_hash"] == chosen["text_hash"]))
    return joined.select(packed["doc_id"], packed["text_hash"], packed["packed"], *columns)


def _classes(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """A row for each of docs (doc_id, text_hash, n_shingles, name), and of each name (component_id, component: a name that all of a component share)."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    # For close thresholds parts are large, and need not know which shingles are frequent.
    often = rows.select("text").filter(F.lit(percent < CLOSE)).mapInArrow(_frequent(shingle), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(FREQUENT).toArrow()
    token, n = np.asarray(often.column("token").to_numpy(), np.int64).view(np.uint64), np.asarray(often.column("n").to_numpy(), np.int64)
    order = np.argsort(token)
    held = spark.sparkContext.broadcast((token[order], n[order]))
    bits = bucket_bits(docs)
    every, clusters = _tied(rows.select("doc_id", "text_hash", "text").mapInArrow(_route(shingle, percent, held, bits), ROUTED))
    # Of each set the row of smallest id stands for it, one without an id only if there is no other. Copies of a set in many blocks have many nodes, of one cluster.
    one = every.filter("name is not null").groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")).alias("of"), F.min("node").alias("node"))
    one = materialize(one.select("name", "node", "of.doc_id", "of.text_hash"), "one")
    # Sets tied within one block only have a node that no tie between blocks names: it is their cluster.
    clustered = materialize(one.join(clusters, "node", "left").select("doc_id", "text_hash", "name", F.coalesce("label", "node").alias("cluster")), "clustered")
    discard(clusters)
    clustered = _narrowed(rows, clustered, shingle, percent, held, bits)
    # A cluster of one set (copies in several blocks) holds no link.
    counted = materialize(clustered.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    sizes = materialize(counted.select("cluster", F.ceil(F.col("n") / F.greatest(F.lit(CHUNK), F.sqrt("n"))).cast("int").alias("chunks")), "sizes")
    chunked = clustered.join(sizes, "cluster").select("doc_id", "text_hash", "name", "cluster", F.pmod(F.hash("name"), "chunks").alias("chunk"), (F.col("chunks") > 1).alias("is_large"))
    chunked = materialize(chunked, "chunked")
    discard(clustered)
    placed = _packed(rows, chunked, "cluster", "chunk", "name", "is_large").repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "name")
    parts = materialize(placed.mapInArrow(_chunk_links(shingle, percent), LINKED), "parts")
    discard(chunked)
    release(spark)
    part_of = parts.select("name", "part").distinct()
    large = sizes.filter("chunks > 1")
    if large.limit(1).count():
        labels = _large_clusters(parts.filter("packed is not null"), large, shingle, percent)
        part_of = part_of.join(labels, part_of["part"] == labels["node"], "left").select("name", F.coalesce("label", "part").alias("part"))
    first = one.select("name", "doc_id").join(part_of, "name", "left").select("name", "doc_id", F.coalesce("part", "name").alias("component"))
    smallest = first.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return every, first.join(smallest, "component").select("name", "component_id", "component")


def components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links of at least percent Jaccard similarity) of each row of docs."""
    every, named_class = _classes(docs, shingle, percent, id_col, text_col)
    # Sets without words have no name, meet nothing, and stay their own component.
    found = every.filter("name is not null").join(named_class, "name").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(every.filter("name is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one of smallest doc_id, and of those without any id the one of smallest text hash.

    Rows that repeat the kept document stay, as do all rows without words.
    """
    every, named_class = _classes(docs, shingle, percent, "doc_id", "text")
    named_class = materialize(named_class, "classes")  # it is read twice
    release(docs.sparkSession)
    found = every.filter("name is not null").join(named_class, "name")
    bare = found.filter("component_id is null").groupBy("component").agg(F.min("text_hash").alias("kept_hash"))
    other = F.when(F.col("component_id").isNotNull(), F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(True))).otherwise(F.col("text_hash") != F.col("kept_hash"))
    gone = found.join(bare, "component", "left").filter(other).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return like_documents(docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (text_hash == gone["gone_hash"]), "left_anti"), docs)
