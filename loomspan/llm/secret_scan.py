"""Secret scans: patterns for whole secrets, and links between the parts of multipart credentials.

Base kinds (assign, access, hex) are always reported. Weak kinds (an identifier, a high-entropy string, an endpoint) are common
in harmless text, so each is reported only when complementary parts lie within `scope` characters of it:
a weak secret needs an identifier, a weak identifier needs a secret, an endpoint needs both.

All of it is DataFrame code. A lazy gap before each match gives its place: `(.*?)(?:(pattern)|\\z)` consumes the text in one scan, so
a running sum of lengths yields code-point offsets. The link is an interval join on (row, bucket of characters): spans of a kind
don't overlap, so a bucket holds a bounded number of them, and a document with very many is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, numbered

VALUE = r"[A-Za-z0-9+/_.=-]"
#: kind -> (pattern, group that is measured, least length). The order of kinds breaks ties. Fixed values for the first three.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (rf"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?({VALUE}+)", 1, 12),
    "access": (r"(AKIA[A-Z0-9]{14,})", 1, 18),
    "hex": (r"([0-9a-f]{16,})", 1, 16),  # a run is never split, so shorter ones needn't be matched
    "weak_id": (r"((?:ASIA|AROA|AIDA)[A-Z0-9]{12,}|(?i:client_?id|access_?key_?id|account_?(?:id|name))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,})", 1, 4),
    "weak_secret": (r"((?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2})", 1, 32),
    "endpoint": (r"((?:https?|wss?|postgres(?:ql)?|mysql|redis|mongodb|amqps?)://[^\s\"'<>]+)", 1, 8),
}
BASE = ("assign", "access", "hex")
IDENTIFIERS, SECRETS = ("access", "weak_id"), ("assign", "hex", "weak_secret")
#: A cheap necessary condition of each kind, so that the costly scan runs on few rows.
SCREEN = {"assign": None, "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}", "weak_id": None, "weak_secret": r"[A-Za-z0-9+/]{32}", "endpoint": r"://"}


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, gap, len, val>> of a kind: characters before each match since the last one, of it, and of its value."""
    pattern, _, _ = KINDS[kind]
    scan = rf"(?s)(.*?)(?:({pattern})|\z)"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(scan), F.lit(1)).alias("g"), F.regexp_extract_all(text, F.lit(scan), F.lit(2)).alias("m"), F.regexp_extract_all(text, F.lit(scan), F.lit(3)).alias("v"))
    order = list(KINDS).index(kind)
    rows = F.transform(found, lambda x: F.struct(F.lit(order).alias("kind"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("val")))
    return F.when(text.rlike(SCREEN[kind] or pattern), rows).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,val:int>>"))


def find_spans(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(_rid, kind, start, end) of all candidates of all kinds in rows(_rid, text): code points, end exclusive."""
    text = F.col(text_col)
    hits = rows.select("_rid", F.posexplode(F.concat(*[_matches(text, k) for k in KINDS])).alias("pos", "x")).select("_rid", "pos", "x.*")
    so_far = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("_rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in KINDS.values()]), F.col("kind") + 1)
    placed = hits.withColumn("end", so_far.cast("long")).withColumn("start", F.col("end") - F.col("len"))
    return placed.where((F.col("len") > 0) & (F.col("val") >= least)).select("_rid", "kind", "start", "end")


def link_parts(spans: DataFrame, scope: int = 256) -> DataFrame:
    """The weak spans that have complementary parts within the scope and don't overlap a base span."""
    names = list(KINDS)
    base, ids, secrets = ([names.index(k) for k in x] for x in (BASE, IDENTIFIERS, SECRETS))
    width = 2 * scope
    weak = spans.where(F.col("kind") >= len(BASE))
    near = weak.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    parts = spans.where(F.col("kind") != names.index("endpoint")).select("_rid", F.col("kind").alias("pk"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    parts = parts.withColumn("bucket", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("ps") - scope) / width), F.floor((F.col("pe") + scope) / width))))
    close = (F.col("ps") - scope < F.col("end")) & (F.col("start") < F.col("pe") + scope)
    over = (F.col("ps") < F.col("end")) & (F.col("start") < F.col("pe"))
    flags = near.join(parts, ["_rid", "bucket"]).where(close).groupBy("_rid", "kind", "start", "end").agg(
        F.max(F.col("pk").isin(base) & over).alias("taken"), F.max(F.col("pk").isin(ids) & ~over).alias("has_id"), F.max(F.col("pk").isin(secrets) & ~over).alias("has_secret"))
    fits = F.when(F.col("kind") == names.index("weak_secret"), F.col("has_id")).when(F.col("kind") == names.index("weak_id"), F.col("has_secret")).otherwise(F.col("has_id") & F.col("has_secret"))
    return flags.where(~F.col("taken") & fits).select("_rid", "kind", "start", "end")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 256) -> DataFrame:
    """One row per row of docs: doc_id and spans array<struct<start, order, end, kind>>, sorted by start, then kind as listed.

    Null or empty text has no spans. Repeated rows and repeated or null ids stay apart: rows are told by number. Any other column
    of docs is left out.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    spans = checkpoint(find_spans(rows.select("_rid", "text")))  # a few rows; three uses follow
    reported = spans.where(F.col("kind") < len(BASE)).unionByName(link_parts(spans, scope))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    by_row = reported.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("order"), "end", name.alias("kind")))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    return rows.select("_rid", "doc_id").join(by_row, "_rid", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from scan_secrets()."""
    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("spans", lambda x: x["order"] == i)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
