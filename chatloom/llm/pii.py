"""Personal data by weak supervision: labelers vote on candidate spans, a classifier learns from their votes.

Base kinds are found by pattern and check alone and always stay. Wider patterns give more candidates. Three
labelers vote for, against or not at all on every candidate, base spans included: its form, a gazetteer, and
the words before it. Expectation-maximisation over the counts of vote patterns (one row per pattern, a few
hundred whatever the corpus) estimates how reliable each labeler is and how likely each pattern is personal
data; a logistic classifier of kind, votes and length is fitted to these likelihoods and decides which further
candidates are added. Everything that touches documents is column expressions in one pass without a shuffle;
the passes over the candidate table that follow read spans only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .spans import how_many, listed, place, spans

#: Quantifiers that cannot give back (++), and starts only where a run or the search begins, keep long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED_EMAIL = r"(?:(?<![A-Za-z0-9._-])|\G)[A-Za-z0-9._-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z]{2,}+)++"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
TAX_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
PERSON = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
WIDER = {"spelled_email": SPELLED_EMAIL, "local_phone": LOCAL_PHONE, "tax_number": TAX_NUMBER, "account": ACCOUNT, "person": PERSON}
KINDS = [*BASE, *WIDER]
#: A short text that every text with a match contains, to skip the search elsewhere.
NEEDS = {"email": "@", "phone": "+", "spelled_email": "at"}

# What the labelers know, kind by kind: strict form; gazetteer for and against; words before it for and against.
FORM = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$",
    "ip": r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20(.-]",
    "spelled_email": r"(?i)[a-z]{2,24}$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]",
    "tax_number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "account": r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    "person": r"\.\x20[A-Z][a-z]+\x20[A-Z][a-z]+$",
}
GAZETTEER = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|it|uk|eu|us)$", r"(?i)^(?:no-?reply|example|test)@"),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(?:0|10|127|255)\.|^192\.168\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", r"^(?:0|1|7|8|9)"),
    "phone": (r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0"),
    "spelled_email": (r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|it|uk|eu|us)$", r"(?i)^(?:look|see|meet)[(\[\x20]"),
    "local_phone": (r"^\(?(?:20[1-9]|21[0-9]|30[1-9]|31[0-9]|41[0-9]|51[0-9]|61[0-9]|71[0-9]|80[0-8]|91[0-9])", r"^\(?(?:000|999)"),
    "tax_number": (r"^[0-7]", r"^(?:078-05-1120|219-09-9999|123-45-6789)"),
    "account": (r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|NL|NO|PL|PT|RO|SE)", r"^(?:AA|XX|ZZ)"),
    "person": (r"\x20(?:James|Mary|John|Anna|Maria|Peter|Paul|Thomas|Michael|Sarah|Jean|Marie|Hans|Karl|Jose|Carmen|Luis|David)\b", r"\x20(?:The|This|That|Who|No)\b"),
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|from|to)\W*$",
    "ip": r"(?i)(?:ip|address|host|server|client|login)\W*$",
    "card": r"(?i)(?:card|credit|debit|visa|pay|number)\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|contact|number)\W*$",
    "spelled_email": r"(?i)(?:mail|contact|write|reach|from|to)\W*$",
    "local_phone": r"(?i)(?:phone|tel|call|mobile|fax|contact|number)\W*$",
    "tax_number": r"(?i)(?:ssn|social|security|tax|number)\W*$",
    "account": r"(?i)(?:iban|account|bank|konto|compte|cuenta)\W*$",
    "person": r"(?i)(?:by|with|name|dear|is|from|to|and)\W*$",
}
AGAINST = r"(?i)(?:version|isbn|order|part|item|serial|ref|sku|page|section|rfc|build)\W*$"
BEFORE = 24
ROUNDS, STEPS = 40, 60


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    """Every second digit from the right counts twice, less 9 above 9; the sum is a multiple of ten."""
    places = F.split(F.reverse(_digits(found)), "")
    worth = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(found)).between(13, 19), _luhn(found)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _vote(column: Column, good: str | None, bad: str | None) -> Column:
    vote = F.lit("0")
    if bad:
        vote = F.when(column.rlike(bad), "-").otherwise(vote)
    return F.when(column.rlike(good), "+").otherwise(vote) if good else vote


def _candidates(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, votes>>: the votes of the three labelers and the length as one pattern."""
    pattern = (BASE | WIDER)[kind]
    found = F.filter(spans(text, pattern), lambda x: _valid(kind, x["found"])) if kind in BASE else spans(text, pattern)

    def labelled(x: Column) -> Column:
        form = F.when(x["found"].rlike(FORM[kind]), "+").otherwise("-")
        start = F.greatest(F.lit(0), x["start"] - BEFORE)
        cue = _vote(F.substring(text, start + 1, x["start"] - start), CUES[kind], AGAINST)
        long = F.when(x["end"] - x["start"] > 20, "l").otherwise("s")
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.concat(form, _vote(x["found"], *GAZETTEER[kind]), cue, long).alias("votes"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,votes:string>>")
    out = F.transform(found, labelled)
    return F.when(F.contains(text, F.lit(NEEDS[kind])), out).otherwise(none) if kind in NEEDS else out


def reliabilities(counts: dict[tuple[str, str], int], rounds: int = ROUNDS):
    """Expectation-maximisation over {(kind, votes): rows}: how likely each pattern is personal data.

    Each labeler has a chance of every vote on true and on false spans, shared by all kinds (smoothed by one
    row); each kind has a share of true spans. Starts from the majority of votes.
    """
    likely = {key: min(0.95, max(0.05, 0.5 + 0.3 * (key[1][:3].count("+") - key[1][:3].count("-")))) for key in counts}
    chance = {}
    for _ in range(rounds):
        share = {}
        for (kind, _), rows in counts.items():
            share.setdefault(kind, [1.0, 2.0])[1] += rows
        for key, rows in counts.items():
            share[key[0]][0] += rows * likely[key]
        chance = {(i, vote, truth): 1.0 for i in range(3) for vote in "+0-" for truth in (0, 1)}
        for key, rows in counts.items():
            for i in range(3):
                chance[i, key[1][i], 1] += rows * likely[key]
                chance[i, key[1][i], 0] += rows * (1 - likely[key])
        for i in range(3):
            for truth in (0, 1):
                total = sum(chance[i, v, truth] for v in "+0-")
                for v in "+0-":
                    chance[i, v, truth] /= total
        for kind, votes in counts:
            true, all_ = share[kind]
            odds = math.log(true / all_) - math.log(max(1e-12, 1 - true / all_))
            odds += sum(math.log(chance[i, votes[i], 1] / chance[i, votes[i], 0]) for i in range(3))
            likely[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return likely, chance


def classifier(counts: dict[tuple[str, str], int], likely: dict[tuple[str, str], float], steps: int = STEPS) -> dict[tuple[str, str], float]:
    """Scores of all patterns by a logistic model of kind, votes and length, fitted to the likelihoods."""

    def features(key):
        return [f"kind {key[0]}", *(f"{i}{v}" for i, v in enumerate(key[1]))]

    weight = {name: 0.0 for key in counts for name in features(key)}
    score = {}
    for _ in range(steps):
        slope, bend = dict.fromkeys(weight, 0.0), dict.fromkeys(weight, 1e-3)
        for key, rows in counts.items():
            names = features(key)
            score[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[n] for n in names)))))
            for n in names:
                slope[n] += rows * (likely[key] - score[key])
                bend[n] += rows * score[key] * (1 - score[key]) * len(names)
        for n in weight:
            weight[n] += max(-2.0, min(2.0, (slope[n] - 1e-3 * weight[n]) / bend[n]))
    return score


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added), one row per input row: arrays of struct<kind, start, end>.

    Null texts count as empty. An added span never overlaps a base span; added spans of different kinds may
    overlap each other. Null doc_ids, repeated rows and extra columns are no matter; no rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    found = docs.select(
        "doc_id",
        F.concat(*[_candidates(F.col("text"), kind) for kind in BASE]).alias("base"),
        F.concat(*[_candidates(F.col("text"), kind) for kind in WIDER]).alias("wider"),
    )
    found = staged(found, "candidates")
    span = F.explode(F.concat("base", "wider")).alias("x")
    patterns = found.select(span).groupBy(F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes")).count()
    counts = {(r["kind"], r["votes"]): r["count"] for r in patterns.collect()}  # at most 9 kinds x 54 patterns
    scores = classifier(counts, reliabilities(counts)[0]) if counts else {}
    taken = F.array(*[F.lit(f"{kind} {votes}") for (kind, votes), score in sorted(scores.items()) if score >= 0.5 and kind in WIDER]).cast("array<string>")
    apart = lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    added = F.filter("wider", lambda x: F.array_contains(taken, F.concat_ws(" ", x["kind"], x["votes"])) & apart(x))
    plain = lambda column: F.transform(column, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("doc_id", plain(F.col("base")).alias("base"), plain(added).alias("added"))


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of (doc_id, base, added)."""
    order = (lambda x: place(KINDS, x["kind"]), lambda x: x["start"])
    return found.select(
        "doc_id",
        *[how_many(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(F.col("base"), *order), 256).alias("base_sha256"),
        listed(F.concat("base", "added"), *order).alias("spans"),
    )
