"""Secrets, told apart by how widely their values are spread over repositories and owners.

Patterns propose candidates; the hash of each candidate's value is counted over the whole corpus by
distinct owners and distinct repositories. A value that several owners hold, or that many repositories
hold, whoever owns them, is a copied example; a value of few owners, seen in few of their repositories,
is live-looking. Base spans stay either way. ``spread`` gives "owners:repositories" of each span's value,
in the order of ``spans``.

Defined cases: null text counts as empty; very long texts are scanned whole; all rows with a null owner count as
one owner that no other value equals, also not the empty string, and so do null repositories; repeated rows give
a row each and count as one repository; ties in start are ordered by kind; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, small_side
from quantloom.llm.spans import Rule, find_spans, span_digest

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
PEM = r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"
HOST_TOKEN = r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"
#: From this many owners on, a value counts as a copied example.
EXAMPLE_OWNERS = 3
#: And from this many repositories on, of one owner or of several.
EXAMPLE_REPOSITORIES = 10


def value_of(hit: Column) -> Column:
    return F.when(F.col("kind") == 0, F.regexp_extract(hit, ASSIGN, 1)).otherwise(hit)


def rules() -> list[Rule]:
    t = F.col("t")
    long_value = F.length(F.regexp_extract("hit", ASSIGN, 1)) >= 6
    always = F.lit(True)
    return [
        Rule("assign", ASSIGN, t.rlike("(?i:passw|secret|token|api_?key)"), long_value),
        Rule("access", ACCESS, t.contains("AKIA"), always),
        Rule("hex", HEX, t.rlike(HEX), always),
        Rule("jwt", JWT, t.contains("eyJ"), always, base=False),
        Rule("pem", PEM, t.contains("PRIVATE KEY"), always, base=False),
        Rule("host_token", HOST_TOKEN, t.rlike("gh[pousr]_|xox|sk_live_"), always, base=False),
    ]


def ownership(spans: DataFrame) -> DataFrame:
    """(value, owners, repositories) over the corpus; partial sums before every shuffle."""
    pairs = spans.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    return pairs.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def named(column: str) -> Column:
    """A key that is never null: null and every text stay apart."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n"))


def secret_spans(docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repository_col="doc_id") -> DataFrame:
    """(row, id, kind, start, stop, valid, value, owner, repository): one row per candidate or a null kind."""
    packed = docs.select(F.struct(F.col(id_col).alias("id"), named(owner_col).alias("owner"), named(repository_col).alias("repository")).alias("who"), F.col(text_col).alias("text"))
    spans = find_spans(packed, rules(), "who", "text")
    return spans.select("row", F.col("id.id").alias("id"), "kind", "start", "stop", "valid", F.when(F.col("valid"), F.sha2(value_of(F.col("hit")).cast("binary"), 256)).alias("value"), F.col("id.owner").alias("owner"), F.col("id.repository").alias("repository"))


def secrets(docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repository_col="doc_id", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """One row per document: counts, base_sha256, spans, n_live, n_example, spread."""
    spans = materialize(secret_spans(docs, id_col, text_col, owner_col, repository_col), "secret-spans")
    # values of one repository need no row: their counts are 1 and 1
    shared = ownership(spans.where("valid")).where(F.col("repositories") > 1)
    shared = materialize(shared.select(F.col("value").alias("shared"), "owners", "repositories"), "secret-owners")
    spans = spans.join(small_side(shared), F.col("value") == F.col("shared"), "left")
    owners, repositories = F.coalesce("owners", F.lit(1)), F.coalesce("repositories", F.lit(1))
    copied = (owners >= example_owners) | (repositories >= example_repositories)
    live = F.count(F.when(F.col("valid") & ~copied, 1)).alias("n_live")
    example = F.count(F.when(F.col("valid") & copied, 1)).alias("n_example")
    entry = F.struct("start", "kind", F.concat_ws(":", owners.cast("string"), repositories.cast("string")).alias("label"))
    spread = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("valid"), entry))), lambda x: x["label"])).alias("spread")
    return span_digest(spans, rules(), id_col, [live, example, spread])


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
