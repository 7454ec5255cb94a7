"""SpotSigs document fingerprints.

Wherever a common word (an anchor) stands, it and the next CHAIN content words
after it form a spot signature; a text's fingerprint is its set of signatures,
as 32-bit hashes. Near duplicates are found by partitioning fingerprints by set
length, so that a set meets only those of its own and the next partition, and by
sharing a signature of the prefix that any pair as alike must share; pairs are
then compared by Jaccard similarity with pruning on lengths.

Defined cases: a null text counts as empty; an empty text has the empty
fingerprint, whose likeness is 1 to itself and 0 to any other; a text without a
whole chain takes its word triples, and with fewer words the text itself, as
signatures, so that only empty texts have none; documents of equal id follow
each other by the hash of their text, greatest first, and those without an id come
last; a single document is its own next one; an empty table gives no rows. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

WORD = re.compile(r"[^\W_]+")
CHAIN = 2
#: Anchors, the commonest words of the corpus languages.
ANCHORS = frozenset(
    "a an and are as at be been but by for from had has have he in is it its of on or that the this to was were will with "
    "au aux avec ce dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui se son sur un une "
    "als auch auf aus bei das dem den der die ein eine für im ist mit nach nicht sich sie und von wie zu zum zur "
    "al como con del el ella es las lo los más no para pero por se sin su una y".split()
)
#: Rows of a run of consecutive documents; runs are bounded in number, as their borders reach the driver.
RUN_ROWS, MAX_RUNS = 500, 65_536
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def signatures(text: str, chain: int = CHAIN) -> frozenset[int]:
    """The spot signatures of a text."""
    words = WORD.findall(text.lower())
    content = [w for w in words if w not in ANCHORS]
    out, at, last = set(), 0, len(content) - chain
    add, crc = out.add, zlib.crc32
    if len(content) < len(words):
        for w in words:
            if w in ANCHORS:
                if at > last:
                    break
                add(crc(f"{w}:{' '.join(content[at : at + chain])}".encode()))
            else:
                at += 1
    if not out:
        out = {crc(" ".join(g).encode()) for g in zip(words, words[1:], words[2:], strict=False)} or ({crc(text.encode())} if text else out)
    return frozenset(out)


def fingerprint(sigs: frozenset[int]) -> str:
    return "".join(f"{s:08x}" for s in sorted(sigs))


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    """Jaccard similarity; 1 between empty sets."""
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the start of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(batches):
    """Rows in order within each run; the row after a document is its next one, and guests only follow."""
    held = None  # run, doc_id, text, signatures
    for b in batches:
        rows = []
        for run, doc, text, guest in zip(*(b.column(c).to_pylist() for c in ("run", "doc_id", "text", "guest")), strict=True):
            if held is not None and held[0] != run:
                held = None
            if guest and held is None:
                continue
            sigs = signatures(text) if held is None or held[2] != text else held[3]
            if held is not None:
                new = edited(held[2], text)
                new_sigs = signatures(new) if new != held[2] else held[3]
                rows.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), fingerprint(held[3]), fingerprint(new_sigs), likeness(held[3], new_sigs), likeness(held[3], sigs)))
            held = None if guest else (run, doc, text, sigs)
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _run_of(doc_id, borders: list[int]):
    """Position of doc_id among borders: how many are at most doc_id; found in two steps, so that a row looks at few."""
    wide = max(1, round(len(borders) ** 0.5))
    coarse = borders[::wide]
    count = lambda values: F.aggregate(values, F.lit(0), lambda n, x: n + F.when(x <= doc_id, 1).otherwise(0))
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values]).cast("array<bigint>")
    if len(borders) <= 16:
        return count(longs(borders))
    tables = F.array(*[longs(borders[k : k + wide]) for k in range(0, len(borders), wide)])
    c = count(longs(coarse))
    return F.when(c == 0, 0).otherwise((c - 1) * wide + count(F.get(tables, F.greatest(c - 1, F.lit(0)))))


def compare_with_next(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Fingerprints of each text, of its edit, and likenesses to the edit and to the next document by descending id.

    Ids are cut into runs at quantiles (only ids are read for that; the driver
    holds the runs' borders, MAX_RUNS at most). The texts are shuffled once, by
    run; a run's first document also goes, as a guest, to the run before it, so
    that every document meets its next one without a global order.
    """
    rows = texts(docs)
    ids = rows.select("doc_id").filter("doc_id is not null")
    n = ids.count()
    runs = max(1, min(MAX_RUNS, n // run_rows))
    borders = sorted({int(x) for x in ids.approxQuantile("doc_id", [k / runs for k in range(1, runs)], 0.25 / runs)}) if runs > 1 else []
    placed = rows.withColumn("hash", F.xxhash64("text")).withColumn("run", _run_of(F.coalesce("doc_id", F.lit(-(1 << 63))), borders).cast("int"))
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "hash")).alias("top")
    ends = sorted((r["run"], r["top"]["doc_id"], r["top"]["hash"]) for r in placed.groupBy("run").agg(top).collect())
    # The document after a run's smallest id is the greatest of the run below; after the lowest run comes the highest.
    heads = docs.sparkSession.createDataFrame([(ends[k - 1][1], ends[k - 1][2], ends[k][0]) for k in range(len(ends))], "id long, hash long, to int")
    visiting = placed.join(F.broadcast(heads), placed["doc_id"].eqNullSafe(heads["id"]) & (placed["hash"] == heads["hash"]))
    visiting = visiting.select(placed["doc_id"], placed["text"], placed["hash"], F.col("to").alias("run"), F.lit(True).alias("guest"))
    all_rows = placed.select("doc_id", "text", "hash", "run", F.lit(False).alias("guest")).unionByName(visiting)
    ordered = all_rows.repartition("run").sortWithinPartitions(F.col("run"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text").desc())
    return ordered.select("run", "doc_id", "text", "guest").mapInArrow(_compare, SCHEMA)


# --- near duplicates over a corpus


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (left, right, similarity) of distinct fingerprints at or above threshold, named by their smallest doc_id, plus membership through fingerprint_classes().

    A set of n signatures is alike at most to sets of n * threshold to
    n / threshold; partitions by length are as wide as that, so a set looks into
    its own and the next longer one. There it meets the sets that share one of
    the first (1 - threshold) * n + 1 signatures in hash order, as any pair as
    alike must.
    """
    import math

    sets = fingerprint_classes(docs).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).filter("fingerprint <> ''")
    step = math.log(1 / threshold)
    sets = sets.withColumn("n", (F.length("fingerprint") / 8).cast("long")).withColumn("sigs", F.expr("transform(sequence(0, cast(n as int) - 1), i -> substring(fingerprint, i * 8 + 1, 8))")).drop("fingerprint")
    sets = sets.withColumn("part", F.floor(F.log(F.col("n")) / step + 1e-9)).withColumn("sig", F.explode(F.expr(f"slice(sigs, 1, cast(n - ceil({threshold} * n - 1e-9) + 1 as int))")))
    a = sets.select(F.col("doc_id").alias("left"), F.col("n").alias("n1"), F.col("sigs").alias("s1"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("part").alias("p1"))
    b = sets.select(F.col("doc_id").alias("right"), F.col("n").alias("n2"), F.col("sigs").alias("s2"), "sig", "part")
    met = a.join(b, ["sig", "part"]).filter((F.col("p1") < F.col("part")) | (F.col("left") < F.col("right"))).filter((F.least("n1", "n2") >= threshold * F.greatest("n1", "n2") - 1e-9) & (F.col("left") != F.col("right")))
    both = F.size(F.array_intersect("s1", "s2"))
    found = met.withColumn("similarity", both / (F.col("n1") + F.col("n2") - both)).filter(F.col("similarity") >= threshold)
    return found.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "similarity").distinct()


def fingerprint_classes(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs; no shuffle."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(signatures(t)) for t in b.column("text").to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")
