"""Secret scan with multipart credential linking, in DataFrame expressions throughout.

Patterns of high confidence (base kinds) are reported wherever they match. Weak parts, which on their own are
everyday text, are reported only when complementary parts lie in their scope, ``SCOPE`` code points to either side:
an identifier needs a secret, a secret-like key needs an identifier, each either of a base kind or, if weak itself,
backed by an endpoint; an endpoint needs an identifier and a secret. A part of any length lies in a scope that it
overlaps. Scopes and parts meet in an interval join: each lies in the buckets of its text that it touches, and rows
join on (text, bucket); a pair that meets in several buckets counts as one.

A match's place comes from the pieces between matches: regular expressions find and split alike, so running sums of
the lengths of pieces and matches are the offsets. They run over exploded rows, linear in the number of matches.

Defined results: null and empty texts have no spans; repeated rows are scanned each on its own, also under one id or
a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm import common

#: Fixed patterns of the base kinds, in the order of kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Weak parts of credentials.
ID = r"""(?i:client_?id|access_?key(?:_?id)?|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
KEY = r"[A-Za-z0-9+/]{20,}={0,2}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
BASE = KINDS[:3]
SCOPE = 200
_BUCKET = 512
MIN_VALUE, MIN_ACCESS = 6, 20


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def scan(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """rid (a number for each row), doc_id, and ``found``: for each kind the matches and the lengths before them.

    Weak patterns run only over texts that hold what they would need: a key needs an identifier, an endpoint both.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("m_assign", _matches(t, ASSIGN)).withColumn("m_access", _matches(t, ACCESS)).withColumn("m_hex", _matches(t, HEX)).withColumn("m_id", _matches(t, ID))
    rows = rows.withColumn("m_key", F.when(F.size("m_access") + F.size("m_id") > 0, _matches(t, KEY)).otherwise(empty))
    both = (F.size("m_access") + F.size("m_id") > 0) & (F.size("m_assign") + F.size("m_hex") + F.size("m_key") > 0)
    rows = rows.withColumn("m_endpoint", F.when(both, _matches(t, ENDPOINT)).otherwise(empty))
    found = []
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, ID, KEY, ENDPOINT)):
        m = F.col(f"m_{kind}")
        before = F.transform(F.split(t, pattern, -1), lambda x: F.char_length(x))
        found.append(F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.when(F.size(m) > 0, before).otherwise(F.array().cast("array<int>")).alias("before")))
    return common.materialize(rows.select("doc_id", F.array(*found).alias("found")).withColumn("rid", F.monotonically_increasing_id()))


def parts(scanned: DataFrame) -> DataFrame:
    """rid, kind, s, e: every match that its kind accepts, with offsets in code points, the end exclusive."""
    each = scanned.select("rid", F.explode("found").alias("f")).where(F.size("f.m") > 0)
    each = each.select("rid", "f.kind", F.posexplode(F.arrays_zip(F.col("f.m").alias("m"), F.slice("f.before", 1, F.size("f.m")).alias("b"))).alias("i", "x"))
    each = each.select("rid", "kind", "i", F.col("x.m").alias("m"), F.col("x.b").alias("b"), F.char_length("x.m").alias("n"))
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("e", F.sum(F.col("b") + F.col("n")).over(upto)).withColumn("s", F.col("e") - F.col("n"))
    accepted = (
        F.when(F.col("kind") == "assign", F.char_length(F.regexp_extract("m", ASSIGN, 1)) >= MIN_VALUE)
        .when(F.col("kind") == "access", F.col("n") >= MIN_ACCESS)
        .when(F.col("kind") == "key", F.col("m").rlike("[0-9]") & F.col("m").rlike("[A-Z]") & F.col("m").rlike("[a-z]"))
        .otherwise(True)
    )
    return each.where(accepted).select("rid", "kind", "s", "e")


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``found`` that complementary parts in their scope confirm: rid, kind, s, e."""
    weak = found.where(~F.col("kind").isin(*BASE)).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("s") - scope) / _BUCKET), F.floor((F.col("e") + scope) / _BUCKET))))
    other = found.select(F.col("rid"), F.col("kind").alias("kind2"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.explode(F.sequence(F.floor(F.col("s") / _BUCKET), F.floor((F.col("e") - 1) / _BUCKET))).alias("bucket"))
    met = weak.join(other, ["rid", "bucket"]).where((F.col("e2") > F.col("s") - scope) & (F.col("s2") < F.col("e") + scope))
    has = lambda *kinds: F.bool_or(F.col("kind2").isin(*kinds))
    inside = F.bool_or(F.col("kind2").isin(*BASE) & (F.col("s2") < F.col("e")) & (F.col("e2") > F.col("s")))
    seen = met.groupBy("rid", "kind", "s", "e").agg(has("access").alias("sure_id"), has("id").alias("weak_id"), has("assign", "hex").alias("sure_secret"), has("key").alias("weak_secret"), has("endpoint").alias("place"), inside.alias("inside"))
    some_id = F.col("sure_id") | (F.col("weak_id") & F.col("place"))
    some_secret = F.col("sure_secret") | (F.col("weak_secret") & F.col("place"))
    linked = F.when(F.col("kind") == "id", some_secret).when(F.col("kind") == "key", some_id & ~F.col("inside")).otherwise((F.col("sure_id") | F.col("weak_id")) & (F.col("sure_secret") | F.col("weak_secret")))
    return seen.where(linked).select("rid", "kind", "s", "e")


def find_secrets(df: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``df``: doc_id and ``spans``, an array of (s, rank, kind, e) by start, then kind; base kinds
    have ranks 0 to 2."""
    scanned = scan(df, text, doc_id)
    found = common.materialize(parts(scanned))
    every = found.where(F.col("kind").isin(*BASE)).unionByName(link(found, scope))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    gathered = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", rank.alias("rank"), "kind", "e"))).alias("spans"))
    out = scanned.select("rid", "doc_id").join(gathered, "rid", "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast(gathered.schema["spans"].dataType)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
