"""Personal data by weak supervision, by DataFrame and SQL operations only.

Candidates are the matches of the strict patterns and of looser ones. Labelers
vote on each or abstain: the strict pattern with its check, a gazetteer (domains,
issuer, country and area prefixes, address ranges), the words before it, and the
characters that it is glued to. For each kind expectation-maximisation over the
counts of vote patterns estimates the labelers' reliabilities and each pattern's
posterior. With these as soft labels a naive Bayes classifier is trained on
traits that no labeler looks at (which pattern, separators, grouping, length, the
characters beside it); a span's posterior joins the evidence of its votes and of
its traits. Matches of the strict patterns always stay; another candidate is
added if some labeler speaks for it, its posterior reaches the threshold, and it
doesn't overlap one that stays.

What the driver holds is one row per combination of kind, votes and traits, a
number that the domains of these bound, whatever the size of the corpus.

Defined cases: a null text counts as empty and has no spans; an empty table
gives no rows; repeated rows and rows without an id are returned each and count
each; texts are read whole, and the work grows with their candidates, not with
the square of these; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import materialize, texts

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns, written so that no position is tried twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
VALID_IP = rf"^{PART}(?:\.{PART}){{3}}$"
#: Looser ones, whose spans count only if the classifier says so.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(](?i:at)[\])]\x20?|\x20(?i:at)\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]{2,63}+){1,4}+"
LOOSE_PHONE = r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
#: Gazetteers and cues.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
COUNTRIES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
AREAS = r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9][0-9]{2}"
RESERVED = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CUES = {"email": "mail|contact|write|courriel|correo|schreib", "ip": "ip|address|adresse|host|server|client|from", "card": "card|visa|mastercard|amex|carte|karte|tarjeta|payment", "phone": "tel|phone|call|mobile|fax|ruf|llam|appel"}
ANTI_CUES = "version|release|isbn|serial|order|invoice|total|price|figure|table|page|section"
LABELERS = ("regex", "gazetteer", "context", "surroundings")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean,votes:string,traits:string>>"
CONTEXT = 24
THRESHOLD = 0.8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts twice, less 9 where that is over 9."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def strict(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's strict pattern counts."""
    n = F.length(_digits(hit))
    if kind == "ip":
        return hit.rlike(VALID_IP)
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(_digits(hit))).otherwise(F.lit(False))
    return (n >= 8) & (n <= 15) if kind == "phone" else F.lit(True)


def _labelled(found: Column, kind: str, loose: bool) -> Column:
    """A span in its context, with its labelers' votes (letters g, b, or - for none) and its traits for the classifier."""
    x = found["span"]
    hit = x["hit"]
    before, left, right = F.lower(found["before"]), F.right(found["before"], F.lit(1)), found["after"]
    ok = F.lit(False) if loose else strict(kind, hit)
    gazetteer = {"email": F.when(hit.rlike(DOMAINS), "g").otherwise("-"), "ip": F.when(hit.rlike(RESERVED), "b").otherwise("-"), "card": F.when(hit.rlike(ISSUERS), "g").otherwise("-"), "phone": F.when(hit.rlike(AREAS), "g").otherwise("b") if loose else F.when(hit.rlike(COUNTRIES), "g").otherwise("-")}[kind]
    cue = F.when(before.rlike(CUES[kind]), "g").when(before.rlike(ANTI_CUES), "b").otherwise("-")
    glued = left.rlike(r"[\p{L}\p{N}_/=]") | right.rlike(r"[\p{L}\p{N}_/=]")
    votes = F.concat(F.lit("-") if loose else F.when(ok, "g").otherwise("b"), gazetteer, cue, F.when(glued, "b").otherwise("-"))
    n = F.length(_digits(hit)) if kind != "email" else F.length(hit)
    size = F.when(n < 8, "0").when(n < 12, "1").when(n < 16, "2").when(n < 20, "3").otherwise("4")
    marks = F.when(hit.rlike(r"[()\[]"), "p").when(hit.rlike(r"\x20"), "s").when(hit.rlike("-"), "h").when(hit.rlike(r"\."), "d").otherwise("-")
    groups = F.when(hit.rlike(r"^[0-9]{4}([\x20-][0-9]{4}){3}$"), "4").when(hit.rlike(r"[0-9]{3}[\x20.-][0-9]{4}$"), "7").otherwise("-")
    beside = lambda c: F.when(c.rlike(r"[\x20\n\t]"), "s").when(c.rlike(r"[:;,.(<\[\"')>\]]"), "p").when(c == "", "e").otherwise("o")
    traits = F.concat(F.lit("l" if loose else "s"), size, marks, groups, beside(left), beside(right))
    return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), ok.alias("base"), votes.alias("votes"), traits.alias("traits"))


def _labeller(kind: str, loose: bool):
    return lambda x: _labelled(x, kind, loose)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, in order of their starts."""
    digits16 = text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    found = [
        (spans.find(text, "email", 0, EMAIL, text.contains("@")), "email", False),
        (spans.find(text, "ip", 1, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), "ip", False),
        (F.filter(spans.find(text, "card", 2, CARD, digits16), lambda x: F.length(_digits(x["hit"])).between(13, 19)), "card", False),
        (spans.find(text, "phone", 3, PHONE, text.rlike(r"\+[0-9]")), "phone", False),
        (spans.find(text, "email", 0, LOOSE_EMAIL, text.rlike(r"(?i)[\[(\x20]at[\])\x20]") & text.rlike(r"(?i)[\[(\x20]dot[\])\x20]|[A-Za-z0-9-]\.[A-Za-z]")), "email", True),
        (spans.find(text, "phone", 3, LOOSE_PHONE, text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")), "phone", True),
    ]
    return F.array_sort(F.concat(*[F.transform(spans.in_context(text, hits, CONTEXT), _labeller(kind, loose)) for hits, kind, loose in found]).cast(SPAN))


def estimate(counts: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Expectation-maximisation over one kind's vote patterns: each pattern's posterior, and each labeler's (sensitivity, specificity).

    Starts from the majority of votes, the strict pattern's counting twice.
    """
    m, total = len(LABELERS), sum(counts.values())
    lean = lambda p: sum({"g": 1, "b": -1, "-": 0}[v] * (2 if j == 0 else 1) for j, v in enumerate(p))
    good = {p: 1 / (1 + math.exp(-1.5 * lean(p))) for p in counts}
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        share = min(0.99, max(0.01, sum(n * good[p] for p, n in counts.items()) / total))
        rates = []
        for j in range(m):
            yes = sum(n * good[p] for p, n in counts.items() if p[j] == "g") + 4
            miss = sum(n * good[p] for p, n in counts.items() if p[j] == "b") + 1
            no = sum(n * (1 - good[p]) for p, n in counts.items() if p[j] == "b") + 4
            false = sum(n * (1 - good[p]) for p, n in counts.items() if p[j] == "g") + 1
            rates.append((yes / (yes + miss), no / (no + false)))
        new = {}
        for p in counts:
            odds = math.log(share / (1 - share))
            for (sens, spec), v in zip(rates, p, strict=True):
                odds += math.log(sens / (1 - spec)) if v == "g" else math.log((1 - sens) / spec) if v == "b" else 0.0
            new[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        change = max(abs(new[p] - good[p]) for p in counts)
        good = new
        if change < 1e-9:
            break
    return good, rates


def train(rows: list[tuple[str, str, str, int]]) -> dict[tuple[str, str, str], float]:
    """Posterior of (kind, votes, traits): odds of the votes by expectation-maximisation, times those of naive Bayes over the traits with the votes' posteriors as soft labels. rows: kind, votes, traits, count."""
    out: dict[tuple[str, str, str], float] = {}
    for kind in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == kind]
        votes: dict[str, int] = {}
        for _, v, _, n in own:
            votes[v] = votes.get(v, 0) + n
        soft, _ = estimate(votes)
        mass = [2.0, 2.0]
        seen: dict[tuple[int, int, str], float] = {}
        for _, v, t, n in own:
            for c, w in ((1, n * soft[v]), (0, n * (1 - soft[v]))):
                mass[c] += w
                for j, x in enumerate(t):
                    seen[c, j, x] = seen.get((c, j, x), 1.0) + w
        for v, t in {r[1:3] for r in own}:
            p = min(1 - 1e-9, max(1e-9, soft[v]))
            odds = math.log(p / (1 - p)) + sum(math.log(seen[1, j, x] / (mass[1] + 4)) - math.log(seen[0, j, x] / (mass[0] + 4)) for j, x in enumerate(t))
            out[kind, v, t] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return out


def _added(found: Column, says: list[str]) -> Column:
    """Candidates that the classifier adds and that overlap no base span; found: in order of their starts."""
    far = (1 << 31) - 1

    def over(xs):
        past = spans.running(F.transform(xs, lambda x: F.when(x["base"], x["end"]).otherwise(0)), lambda a, v: F.greatest(a, v))
        ahead = F.reverse(spans.running(F.transform(F.reverse(xs), lambda x: F.when(x["base"], x["start"]).otherwise(far)), lambda a, v: F.least(a, v), far))
        clear = F.zip_with(past, ahead, lambda p, n: F.struct(p.alias("past"), n.alias("ahead")))
        marked = F.zip_with(xs, clear, lambda x, c: F.struct(x.alias("x"), (~x["base"] & (c["past"] <= x["start"]) & (c["ahead"] >= x["end"])).alias("clear")))
        kept = F.filter(marked, lambda m: m["clear"] & F.concat_ws("/", m["x"]["kind"], m["x"]["votes"], m["x"]["traits"]).isin(says))
        return F.transform(kept, lambda m: m["x"])

    return spans.let(found, over)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base (strict) and spans (base and added ones) of each row of docs, as arrays of kind, start, end ordered by kind as listed, then start.

    One pass over the texts; candidates are kept in the shared folder, so that
    fitting and applying the classifier read those alone.
    """
    found = materialize(texts(docs, id_col, text_col).select("doc_id", candidates(F.col("text")).alias("found")), "pii")
    each = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.traits").agg(F.count("*").alias("n"))
    model = train([(r["kind"], r["votes"], r["traits"], r["n"]) for r in each.collect()])
    says = sorted(f"{k}/{v}/{t}" for (k, v, t), p in model.items() if p >= threshold and "g" in v)
    base = F.filter("found", lambda x: x["base"])
    added = _added(F.col("found"), says) if says else F.slice("found", 1, 0)
    return found.select("doc_id", spans.by_kind(base).alias("base"), spans.by_kind(F.concat(base, added)).alias("spans"))
