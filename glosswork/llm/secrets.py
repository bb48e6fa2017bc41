"""Secret scans over an incremental blob ledger.

Every version of a file is named by the SHA-256 of its content. A blob is scanned once for every
version of a rule, however many paths and revisions hold it: the ledger keeps which (blob, rule
version) pairs were scanned and what was found, only unseen pairs are scanned, and findings are
joined back to all paths.

Defined results: a null text is the empty text; repeated rows each get their findings; an empty
table gives an empty table and an empty ledger; texts are scanned whole, whatever their length.
Spans are in code points, their end is exclusive. Only the named columns of the input are read.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, shared_dir, small_side


def either_case(word: str) -> str:
    """A pattern for the ASCII word in any mix of cases, alike in every regex engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose group has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        body = f"{self.pattern}\x00{self.group}\x00{self.least}"
        return f"{self.kind}@{hashlib.sha256(body.encode()).hexdigest()[:12]}"


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])

RULES = (
    Rule("assign", "(?:" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]+", 0, 16),
)

#: Kinds that the digest of a report covers, whatever other rules there are.
BASE = ("assign", "access", "hex")

LEDGER = "blob string, rules array<string>, findings array<struct<start:long,ord:int,kind:string,end:long,rule:string>>"


def _quick(rule: Rule) -> Column:
    """True for every text that can hold a finding of the rule; spares the others the full scan."""
    if rule.group == 0 and rule.pattern.endswith("]+"):
        unit = rule.pattern[rule.pattern.rindex("[") :]
        fixed = rule.pattern[: rule.pattern.rindex("[")]
        return F.col("text").rlike(f"{fixed}{unit[:-1]}{{{rule.least - len(fixed)},}}")
    return F.col("text").rlike(rule.pattern)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings of (blob, text, pending): one row a blob that has any. ``pending``: rule versions.

    Splitting a text at a pattern gives the gaps between its matches, so running sums of the
    lengths of gaps and matches give the positions; they run within one rule of one blob.
    """
    scans = []
    for ord_, rule in enumerate(rules):
        lengths = lambda column: F.transform(column, lambda x: F.length(x).cast("long"))
        found = F.arrays_zip(
            lengths(F.split("text", rule.pattern, -1)).alias("gap"),
            lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).alias("whole"),
            lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))).alias("part"),
        )
        due = F.array_contains("pending", rule.version) & _quick(rule)
        scans.append(F.struct(F.lit(ord_).alias("ord"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("rule"), F.lit(rule.least).alias("least"), F.when(due, found).alias("found")))
    each = blobs.select("blob", F.explode(F.array(*scans)).alias("scan")).where("scan.found is not null")
    each = each.select("blob", "scan.ord", "scan.kind", "scan.rule", "scan.least", F.posexplode("scan.found").alias("i", "m"))
    each = each.selectExpr("blob", "ord", "kind", "rule", "least", "i", "m.gap", "m.whole", "m.part").where("whole is not null")
    each = each.withColumn("end", F.expr("sum(gap + whole) over (partition by blob, ord order by i rows between unbounded preceding and current row)"))
    span = F.struct((F.col("end") - F.col("whole")).alias("start"), "ord", "kind", "end", "rule")
    return each.where("part >= least").groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("findings"))


def scan_versions(versions: DataFrame, ledger_path: str, rules=RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scan what the ledger hasn't, append to it, and return ``keep`` + (blob, findings) of all rows.

    The ledger is a Parquet folder, made when missing. An append shows only when it is whole, so
    a run that breaks off leaves the ledger as it was.
    """
    spark = versions.sparkSession
    wanted = [r.version for r in rules]
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = versions.select(*keep, F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    everything = F.array(*map(F.lit, wanted))
    try:
        seen = spark.read.schema(LEDGER).parquet(ledger_path)
        seen.limit(1).count()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        seen = None
    if seen is None:
        texts = named.withColumn("pending", everything)
    else:
        # digests alone decide what is new; the texts of known blobs stay where they are
        done = seen.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        new = named.select("blob").distinct().join(done, "blob", "left").withColumn("pending", F.array_except(everything, F.coalesce("done", F.array().cast("array<string>"))))
        texts = named.join(small_side(cut_lineage(new.where(F.size("pending") > 0).select("blob", "pending"))), "blob")
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"), F.first("pending").alias("pending"))
    found = scan_blobs(blobs, rules)
    # each scanned blob goes into the ledger, found or clean; this side has no text
    scanned = texts.select("blob", "pending").distinct().withColumnRenamed("pending", "rules")
    empty = F.array().cast(LEDGER.partition("findings ")[2])
    scanned.join(found, "blob", "left").select("blob", "rules", F.coalesce("findings", empty).alias("findings")).write.mode("append").parquet(ledger_path)
    current = spark.read.schema(LEDGER).parquet(ledger_path)
    hits = current.where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(wanted))
    # cut here, so that the join deals out both sides itself and a blob with many rows is split
    hits = cut_lineage(hits.groupBy("blob").agg(F.sort_array(F.collect_set("f")).alias("findings")))
    return named.select(*keep, "blob").join(small_side(hits), "blob", "left").select(*keep, "blob", F.coalesce("findings", empty).alias("findings"))


def secret_report(docs: DataFrame, ledger_path: str | None = None, rules=RULES) -> DataFrame:
    """Counts, digest and spans of each document, from a ledger (a new one unless named)."""
    path = ledger_path or f"{shared_dir(docs.sparkSession)}/blob-ledger-{uuid.uuid4().hex}"
    rows = scan_versions(docs, path, rules)

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def spans(column: str | Column) -> Column:
        return F.array_join(F.transform(column, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    counts = [count(rule.kind) for rule in rules]
    base = spans(F.filter("findings", lambda f: f["kind"].isin(*BASE)))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans("findings").alias("spans"), "blob")
