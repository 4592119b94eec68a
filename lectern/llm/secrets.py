"""Secrets found through an incremental ledger of contents.

Every version of every document is addressed by the SHA-256 of its text, so a text is
scanned once however many paths and versions hold it. The ledger keeps the pairs of
content and rule version that were scanned, and what was found. A run scans only
pairs it has not seen: new contents under all rules, known ones under new or changed
rules. Findings then join back to every path of the content.

Positions come from SQL functions alone: splitting a text at a pattern gives the
gaps between the matches that `regexp_extract_all` lists, and running sums of both
lengths give starts and ends in code points.

Defined results: a null text is an empty one; repeated rows are paths of their own; an
empty table gives no rows; matches too short for their rule are passed over but still
consume their text; columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored
from lectern.session import new_folder


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    # The part whose length counts, and the least length that makes a match a finding.
    group: int = 0
    least: int = 1
    version: int = 1
    # The part that is the finding; it ends the match.
    span: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The patterns of secrets. The first three are the base.
RULES = (
    Rule(
        "assign",
        "(" + either_case("password|passwd|secret|token|api_?key") + ")"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    # A run of hex digits ends where none follows, so short runs need not be matched at all.
    Rule("hex", "[0-9a-f]{24,}", least=24),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    # It starts where a run of its letters starts, so that no run is read from each of its places.
    Rule(
        "jwt",
        r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)",
        version=2,
        span=1,
    ),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
FINDING = "content string, rule string, kind string, start bigint, end bigint"
PAIR = "content string, rule string"


class Ledger:
    """Scanned pairs and findings, each a table that runs append to.

    Findings are written before their pairs: a run that fails in between is repeated by
    the next one, and its findings count once, as they are made distinct when read.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or new_folder(spark, "secret-ledger")
        for name, schema in (("pairs", PAIR), ("findings", FINDING)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema).option("pathGlobFilter", "*.parquet")
        return reader.parquet(f"{self.folder}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")


def content_key(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, size, span, counts>>: characters before each match since the last, its own,
    those of the finding at its end, and whether it is long enough."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    spans = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.span)), F.length)
    parts = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    # The last gap follows the last match.
    found = F.transform(
        F.arrays_zip(
            F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"),
            sizes.alias("size"),
            spans.alias("span"),
            parts.alias("part"),
        ),
        lambda m: F.struct(
            m["gap"].cast("bigint").alias("gap"),
            m["size"].cast("bigint").alias("size"),
            m["span"].cast("bigint").alias("span"),
            (m["part"] >= rule.least).alias("counts"),
        ),
    )
    # Most texts hold nothing; they are read once and not cut.
    return F.when(text.rlike(rule.pattern), found)


def scan(contents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of the rules not in a content's `seen` list; content, text, seen."""
    per_rule = F.array(
        *[
            F.struct(
                F.lit(rule.key).alias("rule"),
                F.lit(rule.kind).alias("kind"),
                F.when(
                    ~F.array_contains("seen", rule.key), matches(F.col("text"), rule)
                ).alias("found"),
            )
            for rule in rules
        ]
    )
    hits = contents.select(
        "content", F.inline(F.filter(per_rule, lambda r: r["found"].isNotNull()))
    )
    by_text = Window.partitionBy("content", "rule").orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        hits.select("content", "rule", "kind", F.posexplode("found").alias("i", "m"))
        .withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(by_text))
        .where("m.counts")
        .select("content", "rule", "kind", (F.col("end") - F.col("m.span")).alias("start"), "end")
    )


def unseen_contents(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...], text: str) -> DataFrame:
    """One text per content that lacks a rule, with the rules it was scanned under."""
    contents = docs.select(
        content_key(text).alias("content"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    scanned = ledger.read("pairs", PAIR)
    if scanned.isEmpty():
        return contents.dropDuplicates(["content"]).withColumn("seen", F.array().cast("array<string>"))
    # Only digests meet the ledger. What it lacks is stored, so that its size is known: while it is
    # small, texts stay in place and known ones are passed over there.
    seen = scanned.groupBy("content").agg(F.collect_set("rule").alias("seen"))
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    lacking = stored(
        contents.select("content")
        .distinct()
        .join(seen, "content", "left")
        .withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        .where(F.size(F.array_except(wanted, F.col("seen"))) > 0),
        "unseen-contents",
    )
    return contents.join(lacking, "content").dropDuplicates(["content"])


def update_ledger(
    docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> None:
    """Scan what the ledger lacks and write it down."""
    contents = unseen_contents(docs, ledger, rules, text)
    ledger.append("findings", scan(contents, rules))
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    pairs = docs.select(content_key(text).alias("content")).distinct()
    pairs = pairs.select("content", F.explode(wanted).alias("rule"))
    ledger.append("pairs", pairs.join(ledger.read("pairs", PAIR), ["content", "rule"], "left_anti"))


def findings_by_path(
    docs: DataFrame,
    ledger: Ledger,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row's id with the sorted spans of its content under the given rules."""
    order = {rule.kind: i for i, rule in enumerate(rules)}
    rank = F.lit(len(order))
    for kind, i in order.items():
        rank = F.when(F.col("kind") == kind, F.lit(i)).otherwise(rank)
    findings = ledger.read("findings", FINDING).where(
        F.col("rule").isin([rule.key for rule in rules])
    ).distinct()
    per_content = findings.groupBy("content").agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("spans")
    )
    return (
        docs.select(F.col(id_column), content_key(text).alias("content"))
        .join(per_content, "content", "left")
        .select(
            id_column,
            "content",
            F.coalesce(
                "spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
            ).alias("spans"),
        )
    )
