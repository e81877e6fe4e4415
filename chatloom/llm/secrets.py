"""Secret scans over an incremental ledger of content-addressed blobs.

A version of a file (or a document) is a blob, named by the SHA-256 of its text. The ledger is a Parquet folder
with one row per scan of a blob: the rules it was scanned with (kind and version) and what they found. A scan
takes any versions, leaves out every pair of blob and rule version that the ledger holds, scans each remaining
blob once, however many paths or versions share it, and appends. Findings are joined back to all paths.
Everything is column expressions; a text is shuffled once, and equal texts meet their like before that.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from .common import with_plain_names
from .spans import how_many, listed, place, spans

LEDGER = "blob string, rules array<string>, findings array<struct<kind:string,version:int,start:int,end:int>>"
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `valid` drops matches; raise `version` whenever the pattern or the test changes."""

    kind: str
    version: int
    pattern: str
    valid: Callable[[Column], Column] | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Runs of one class of characters are matched from their least valid length on: shorter runs hold no match.
BASE = (
    Rule("assign", 1, ASSIGN, lambda found: F.length(F.regexp_extract(found, ASSIGN, 2)) >= 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: What the method adds: keys and tokens whose form alone gives them away.
ADDED = (
    Rule("private_key", 1, r"-----BEGIN(?: [A-Z0-9]+){0,4} PRIVATE KEY-----"),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", 1, r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _found(text: Column, rule: Rule) -> Column:
    found = spans(text, rule.pattern)
    if rule.valid is not None:
        found = F.filter(found, lambda x: rule.valid(x["found"]))
    return F.transform(found, lambda x: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), x["start"].alias("start"), x["end"].alias("end")))


def open_ledger(spark, path: str) -> DataFrame:
    """The ledger at `path`, made empty if there is none."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Append to the ledger what it does not hold yet of the texts of `versions`.

    Null texts count as empty. Scanning the same versions again appends nothing; a raised rule version scans
    all blobs for that rule alone. Rows of a run that failed half-way were not committed and are scanned again.
    """
    spark = versions.sparkSession
    known = open_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
    texts = versions.select(blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    wanted = F.array(*[F.lit(rule.name) for rule in rules])
    todo = texts.join(known, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))))
    todo = todo.where(F.size("rules") > 0)
    none = F.array().cast("array<struct<kind:string,version:int,start:int,end:int>>")
    per_rule = [F.when(F.array_contains("rules", rule.name), _found(F.col("text"), rule)).otherwise(none) for rule in rules]
    todo.select("blob", "rules", F.concat(*per_rule).alias("findings")).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`versions` without text, with `findings` of the given rule versions (empty where there are none)."""
    current = F.array(*[F.lit(rule.name) for rule in rules])
    held = versions.sparkSession.read.schema(LEDGER).parquet(ledger).where(F.size("findings") > 0)
    held = held.groupBy(F.col("blob").alias("__blob")).agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("__findings"))
    held = held.withColumn("__findings", F.filter("__findings", lambda x: F.array_contains(current, F.concat_ws("@", x["kind"], x["version"]))))
    paths = versions.withColumn("__blob", blob(F.col("text"))).drop("text", "findings")
    none = F.array().cast("array<struct<kind:string,version:int,start:int,end:int>>")
    return paths.join(held, "__blob", "left").withColumn("findings", F.coalesce("__findings", none)).drop("__blob", "__findings")


def scan_documents(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, findings), one row per input row. Without a ledger a new one in the shared folder is used.

    Null doc_ids, repeated rows and extra columns are no matter; no rows give no rows.
    """
    versions = docs.select("doc_id", "text")
    ledger = ledger or shared_path(docs.sparkSession, "ledger")
    scan(versions, ledger, rules)
    return findings(versions, ledger, rules)


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of (doc_id, findings): the base kinds, and all spans."""
    base, kinds = [rule.kind for rule in BASE], [rule.kind for rule in RULES]
    own = F.filter("findings", lambda x: x["kind"].isin(base))
    by_start = (lambda x: x["start"], lambda x: place(kinds, x["kind"]))
    return found.select(
        "doc_id",
        *[how_many(F.col("findings"), kind).alias(f"n_{kind}") for kind in base],
        F.sha2(listed(own, *by_start), 256).alias("base_sha256"),
        listed(F.col("findings"), *by_start).alias("spans"),
    )


@with_plain_names
def clean_documents(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """`docs` with every secret in its text replaced by `mark`; all rows and columns stay.

    Overlapping findings become one mark. Findings are looked up by blob, so equal texts change alike and a
    null text stays null. Null doc_ids and repeated rows are no matter; no rows give no rows.
    """
    ledger = ledger or shared_path(docs.sparkSession, "ledger")
    scan(docs.select("text"), ledger, rules)
    held = findings(docs.select("text").withColumn("__key", blob(F.col("text"))), ledger, rules)
    held = held.where(F.size("findings") > 0).groupBy("__key").agg(F.first("findings").alias("__found"))
    ordered = F.array_sort(F.transform("__found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, F.greatest(F.lit(0), x["start"] - state["at"]))
        # a finding that begins inside the last one only moves its end
        out = F.when(x["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda state: F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, F.length("text")))
    joined = docs.withColumn("__key", blob(F.col("text"))).join(held, "__key", "left")
    text = F.when(F.col("__found").isNull(), F.col("text")).otherwise(F.aggregate(ordered, start, cut, rest))
    return joined.withColumn("text", text).select(*docs.columns)
