"""Secret scans over content-addressed versions, in DataFrame functions alone."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .texts import other_columns, staged


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, what a match needs besides, and what it must contain.

    `least` is the least length of `group`; `hints` are literals of which every text
    with a match contains one, so that most texts never meet the pattern.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    hints: tuple[str, ...] = ()


#: Kinds, their order, patterns and lengths.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
        hints=("=", ":"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, hints=("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", hints=("eyJ",)),
    Rule("login", r"://[^\s:/@]{1,64}:[^\s:/@]{3,64}@", hints=("://",)),
)
RULES = BASE_RULES + ADDED_RULES
RULE_VERSION = "1"

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_FINDINGS = f"blob string, rule_version string, spans {_SPANS}"


def _running_sums(values: Column, block: int = 256) -> Column:
    """Sums up to each value, in blocks, so that long arrays are not copied for each value."""

    def sums(part: Column) -> Column:
        return F.aggregate(
            part,
            F.array().cast("array<bigint>"),
            lambda done, x: F.concat(
                done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x)
            ),
        )

    count = F.floor((F.size(values) + block - 1) / block).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda k: sums(F.slice(values, k * block + 1, F.lit(block))),
    )
    totals = sums(F.transform(parts, lambda part: F.coalesce(F.get(part, F.size(part) - 1), F.lit(0))))
    moved = F.zip_with(
        parts,
        F.concat(F.array(F.lit(0).cast("bigint")), totals),
        lambda part, before: F.transform(part, lambda end: end + before),
    )
    return F.flatten(F.filter(moved, lambda part: part.isNotNull()))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """The spans of one rule: a match ends after all gaps and matches up to it."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    lengths = F.zip_with(
        F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)),
        found,
        lambda gap, match: (F.length(gap) + F.length(match)).cast("bigint"),
    )
    spans = F.zip_with(
        F.zip_with(found, tested, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("least"))),
        _running_sums(lengths),
        lambda match, end: F.struct(
            F.when(match["least"] >= rule.least, end - match["n"]).alias("start"),
            F.lit(number).alias("kind"),
            end.alias("end"),
        ),
    )
    likely = text.rlike(rule.pattern)
    if rule.hints:
        hinted = F.lit(False)
        for hint in rule.hints:
            hinted = hinted | text.contains(hint)
        likely = F.when(hinted, likely).otherwise(F.lit(False))
    kept = F.filter(spans, lambda s: s["start"].isNotNull())
    return F.when(likely, kept.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all rules by start, then rule, in code points, end exclusive.

    Those of one kind are leftmost and do not overlap.
    """
    return F.array_sort(F.concat(*(_spans(text, k, rule) for k, rule in enumerate(rules))))


class Ledger:
    """What has been scanned: one row for each blob and rule version, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self, rule_version: str) -> DataFrame:
        try:
            seen = self.spark.read.schema(_FINDINGS).parquet(f"{self.path}/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _FINDINGS)
        return seen.filter(F.col("rule_version") == rule_version)

    def add(self, findings: DataFrame, rule_version: str) -> None:
        rows = findings.select("blob", F.lit(rule_version).alias("rule_version"), "spans")
        rows.write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")


def scan_history(
    history: DataFrame,
    ledger_path: str,
    path_col: str = "path",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """history (a row for each path and version) with `blob` and `spans`, without the text.

    A blob is the SHA-256 of a text; null counts as empty. Blobs that the ledger has
    under this rule version are not read again; of the others one copy is scanned and
    noted. Findings then go back to every row of history with that blob, repeated rows
    included. Columns of history with these names are replaced. Only hashes are grouped;
    texts are dealt over the cluster once, by their blob's chosen path, and only those
    not yet scanned. When run again after a failure the ledger is taken as it is; a blob
    noted twice counts once. The plan joins by path and blob, so that
    neither a path with many versions nor a blob with many copies meets in one task.
    """
    spark = history.sparkSession
    ledger = Ledger(spark, ledger_path)
    kept = [c for c in other_columns(history, ["blob", "spans"]) if c != text_col]
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    addressed = staged(history.select(*kept, F.sha2(whole, 256).alias("blob")), "addressed")
    unseen = (
        addressed.groupBy("blob")
        .agg(F.min(path_col).alias("chosen"))
        .join(ledger.rows(rule_version).select("blob"), "blob", "left_anti")
        .withColumnRenamed("blob", "new_blob")
    )
    copies = history.select(F.col(path_col).alias("path"), whole.alias("text"))
    chosen = copies.withColumn("blob", F.sha2("text", 256)).join(
        unseen.hint("shuffle_hash"),
        F.expr("blob = new_blob and path <=> chosen"),
        "left_semi",
    )
    ledger.add(chosen.select("blob", find_spans(F.col("text"), rules).alias("spans")), rule_version)
    nothing = F.array().cast(_SPANS)
    noted = ledger.rows(rule_version).filter(F.size("spans") > 0).dropDuplicates(["blob"])
    return addressed.join(noted.select("blob", "spans"), "blob", "left").withColumn(
        "spans", F.coalesce("spans", nothing)
    )


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def span_report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    results = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))

    def count(number: int, rule: Rule) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("bigint").alias(f"n_{rule.kind}")

    counts = [count(k, rule) for k, rule in enumerate(BASE_RULES)]
    return scanned.select(
        *[c for c in other_columns(scanned, results) if c != "blob"],
        *counts,
        F.sha2(span_text(base, rules), 256).alias("base_sha256"),
        span_text(F.col("spans"), rules).alias("spans"),
    )


def redact(docs: DataFrame, found: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of its text replaced by [kind]; of spans that overlap, the first names it.

    `found` is the result of scan_history: spans go by blob, so copies and repeated rows
    are all redacted. Texts without findings stay as they are.
    """
    held = [c for c in docs.columns if c.lower() not in ("blob", "spans")]
    blobs = found.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    state = "struct<done:string,at:bigint>"
    kinds = F.array(*(F.lit(f"[{rule.kind}]") for rule in rules))
    text = F.col(text_col)
    walked = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")).cast(state),
        lambda s, span: F.struct(
            F.when(
                span["start"] >= s["at"],
                F.concat(
                    s["done"],
                    F.substring(text, s["at"].cast("int") + 1, (span["start"] - s["at"]).cast("int")),
                    F.get(kinds, span["kind"]),
                ),
            )
            .otherwise(s["done"])
            .alias("done"),
            F.greatest(s["at"], span["end"]).alias("at"),
        ).cast(state),
    )
    clean = F.concat(
        walked["done"], F.substring(text, walked["at"].cast("int") + 1, F.length(text))
    )
    return (
        docs.select(*held)
        .withColumn("blob", F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))
        .join(blobs, "blob", "left")
        .withColumn(text_col, F.when(F.col("spans").isNotNull(), clean).otherwise(text))
        .select(*held)
    )
