"""Secret scan with an incremental blob ledger, in DataFrame operations only.

Every version of every file is content-addressed: its blob is the SHA-256 of its text. The ledger (two Parquet
folders) holds the (blob, rule, rule version) pairs scanned so far and what they found. A scan takes the versions,
keeps the pairs that the ledger lacks, reads one text per unseen blob, applies the rules it is due and appends
to the ledger. Findings are then joined back to all paths that hold the blob.

Findings are written before the pairs that vouch for them; a scan that breaks off in between is repeated
and its findings, being the same rows, count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import clear_of, quoted, stored

SCANNED = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, start int, end int"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost, non-overlapping matches that are never empty; ``group`` must have ``least`` characters.

    ``hints``: lower-case strings of which a lower-cased text with a match contains at least one (none: all are scanned).
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()


# The rules, in the order in which spans at one place are listed.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)


def blob_id(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger folder; one that no scan has written yet is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def findings(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, version, start, end) of ``texts`` (blob, text, due: names of the rules to apply); code points, end exclusive.

    Between two matches lies what ``split`` returns, so each match starts after the lengths of all pieces and matches before it.
    """
    text, lower = F.col("text"), F.col("lower")
    parts = []
    for r in rules:
        hinted = F.lit(True)
        if r.hints:
            hinted = F.lit(False)
            for x in r.hints:
                hinted = hinted | lower.contains(x)
        else:
            hinted = text.rlike(r.pattern)
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias("found"), F.transform(F.split(text, r.pattern, -1), F.length).alias("gap"))
        parts.append(F.when(F.array_contains("due", r.name) & hinted, F.struct(F.lit(r.name).alias("rule"), pairs.alias("pairs"))))
    each = texts.withColumn("lower", F.lower("text")).select("blob", F.explode(F.array(*parts)).alias("x")).where("x is not null")
    rows = each.select("blob", "x.rule", F.posexplode("x.pairs").alias("at", "pair")).where("pair.found is not null")
    lengths = rows.select("blob", "rule", "at", F.length("pair.found").alias("n"), F.col("pair.gap").alias("gap"), _group_length(rules).alias("g"))
    ends = lengths.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("blob", "rule").orderBy("at")).cast("int"))
    least, version = (F.create_map(*[F.lit(y) for r in rules for y in (r.name, x(r))]) for x in (lambda r: r.least, lambda r: r.version))
    return ends.where(F.col("g") >= least[F.col("rule")]).select("blob", "rule", version[F.col("rule")].alias("version"), (F.col("end") - F.col("n")).alias("start"), "end")


def _group_length(rules: tuple[Rule, ...]) -> Column:
    """Characters of the rule's group, from the match alone: no pattern looks beyond its match."""
    out = F.lit(0)
    for r in rules:
        out = F.when(F.col("rule") == r.name, F.length(F.regexp_extract(F.col("pair.found"), r.pattern, r.group) if r.group else F.col("pair.found"))).otherwise(out)
    return out


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger folder up to date for ``versions`` (a column ``text``); returns the pairs (blob, rule, version) scanned now."""
    spark = versions.sparkSession
    seen = _read(spark, f"{ledger}/scanned", SCANNED)
    named = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules]))
    blobs = versions.select(blob_id(F.col("text")).alias("blob")).distinct()
    unseen = stored(blobs.select("blob", named.alias("r")).select("blob", "r.*").join(seen, ["blob", "rule", "version"], "left_anti"), "unseen")
    due = unseen.groupBy("blob").agg(F.collect_set("rule").alias("due"))
    texts = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"]).join(due, "blob")
    findings(texts, rules).write.mode("append").parquet(f"{ledger}/findings")
    unseen.write.mode("append").parquet(f"{ledger}/scanned")
    return unseen


def blob_findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob with findings under the given rule versions: n_<rule> and spans, ``rule:start:end`` by start, then rule as listed."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    current = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")
    rows = _read(spark, f"{ledger}/findings", FINDINGS).join(F.broadcast(current), ["rule", "version"]).distinct()
    spans = F.transform(F.array_sort(F.collect_list(F.struct("start", order[F.col("rule")].alias("o"), "end", "rule"))), lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"]))
    return rows.groupBy("blob").agg(*[F.count_if(F.col("rule") == r.name).alias(f"n_{r.name}") for r in rules], F.array_join(spans, ",").alias("spans"))


def secrets(versions: DataFrame, ledger: str, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what is unseen, then gives for every row of ``versions`` the columns ``keep``, blob, n_<rule> and spans.

    Null and empty texts are the empty blob and find nothing; repeated rows and paths with one blob are scanned once and each
    give a row. Names of ``keep`` that clash with the new columns get the new ones underscores.
    """
    scan(versions, ledger, rules)
    known = blob_findings(versions.sparkSession, ledger, rules)
    own = [f"__k{i}" for i in range(len(keep))]
    rows = versions.select(*[c.alias(k) for c, k in zip(quoted(keep), own)], blob_id(F.col("text")).alias("blob"))
    blob, spans, *counts = clear_of(keep, "blob", "spans", *[f"n_{r.name}" for r in rules])
    numbers = [F.coalesce(f"n_{r.name}", F.lit(0)).cast("long").alias(c) for r, c in zip(rules, counts)]
    found = rows.join(known, "blob", "left")
    return found.select(*[F.col(k).alias(c) for c, k in zip(keep, own)], F.col("blob").alias(blob), *numbers, F.coalesce("spans", F.lit("")).alias(spans))
