"""Secret scans over an incremental blob ledger, by DataFrame and SQL operations only.

Every version of every path is named by the hash of its content. The ledger is
a Parquet table with a row for each pair of blob and rule version that was ever
scanned, findings or none; a scan takes only the pairs that it lacks, each blob
once however many paths and versions hold it, and joins the ledger's findings
back to all of them. New rules are a new version, so old blobs are scanned again
for them alone.

Defined cases: null content is an empty blob; repeated rows, and equal texts
under many ids, are each returned, with equal findings; an empty table gives no
rows; texts are scanned whole, and the work grows with their findings, not with
the square of these; a path may be null; other columns are left out of findings,
and kept by redact under any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import shared_dir

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
#: kind, pattern, cheap test as a pattern, least length of the group that counts. The first three are the base rules.
RULES = {
    "1": (
        ("assign", ASSIGN, r"(?i:password|passwd|secret|token|api_?key)[\x20\"']*[:=]", 1, 12),
        ("access", r"AKIA[A-Z0-9]++", "AKIA", 0, 18),
        ("hex", r"[0-9a-f]{16,}+", r"[0-9a-f]{16}", 0, 16),
        ("forge", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", r"gh[pousr]_|glpat-", 0, 1),
        ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ", 0, 1),
        ("pem", r"-----BEGIN (?:[A-Z0-9]++ )*+PRIVATE KEY-----", "-----BEGIN ", 0, 1),
        ("bearer", r"(?:[Bb]earer )[A-Za-z0-9._~+/-]{20,}+", "[Bb]earer ", 0, 1),
    )
}
BASE_KINDS = ("assign", "access", "hex")
CURRENT = "1"
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, findings {FINDINGS}"


def _at_least(pattern: str, group: int, least: int):
    """Whether the group of the pattern that counts has least characters or more."""
    return lambda x: F.length(F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]) >= least


def scan(text: Column, version: str = CURRENT) -> Column:
    """All findings of a text under a rule version, by start, then kind as listed."""
    found = []
    for rank, (kind, pattern, test, group, least) in enumerate(RULES[version]):
        hits = spans.find(text, kind, rank, pattern, text.rlike(test))
        if least > 1:
            hits = F.filter(hits, _at_least(pattern, group, least))
        found.append(hits)
    return spans.by_start(F.concat(*found))


def hash_versions(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, text and blob (content hash) of each version."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return versions.select(F.col(f"`{path_col}`").alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob"))


def update_ledger(versions: DataFrame, ledger: str | None, version: str = CURRENT, path_col: str = "path", text_col: str = "text") -> tuple[DataFrame, str]:
    """Scan blobs that the ledger (a folder of Parquet, or None for a new one) lacks under this version, and add them.

    Returns all of the ledger's rows for the version, and its folder. Equal
    blobs meet after each task has kept one of its own, so a blob that a third
    of all paths hold arrives as often as there are tasks.
    """
    spark = versions.sparkSession
    hashed = hash_versions(versions, path_col, text_col).select("blob", "text")
    known = None
    if ledger is not None:
        known = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == version)
        hashed = hashed.join(known.select("blob"), "blob", "left_anti")
    else:
        ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    unseen = hashed.groupBy("blob").agg(F.first("text").alias("text"))
    unseen.select("blob", F.lit(version).alias("rule_version"), scan(F.col("text"), version).cast(FINDINGS).alias("findings")).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == version), ledger


def findings(versions: DataFrame, ledger: str | None = None, version: str = CURRENT, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """path, blob and findings of each version, after an update of the ledger."""
    rows, _ = update_ledger(versions, ledger, version, path_col, text_col)
    paths = hash_versions(versions, path_col, text_col).select("path", "blob")
    # Adaptive execution splits the partition of a blob that very many paths hold.
    return paths.join(rows.select("blob", "findings"), "blob").select("path", "blob", "findings")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with each finding's stretch of text replaced by mask, overlapping ones by one; n_chars, if there, follows. Rows without findings stay as they are, and other columns whatever their names."""
    rows, _ = update_ledger(docs, None, path_col="doc_id")
    # All of a row goes into one column, so that no name of docs meets one of ours.
    whole = docs.select(F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias("blob"), F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"))
    found = rows.filter(F.size("findings") > 0).select(F.col("blob").alias("known"), "findings")
    joined = whole.join(found, whole["blob"] == found["known"], "left").select("row", "findings")
    hit = F.col("findings").isNotNull()
    text = F.when(hit, spans.masked(F.col("row.text"), F.col("findings"), mask)).otherwise(F.col("row.text"))
    out = joined.select("row", hit.alias("hit"), text.alias("new"))
    kind = {f.name: f.dataType for f in docs.schema.fields}

    def column(c):
        old = F.col("row")[c]
        if c == "text":
            return F.col("new").alias(c)
        return (F.when(F.col("hit"), F.length("new").cast(kind[c])).otherwise(old) if c == "n_chars" else old).alias(c)

    return out.select(*[column(c) for c in docs.columns])
