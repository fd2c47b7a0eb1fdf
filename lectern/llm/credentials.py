"""Secrets: base patterns, and ownership of every candidate over the whole corpus. DataFrame functions only.

Each text is cut by the base patterns and by runs of token characters, so the places of all
matches are running sums of lengths. Candidates (the value of an assignment, a key, a run of
hexadecimal digits, a long mixed run) are named by their SHA-256 digest; no value leaves its
row. Ownership counts, for each digest, the distinct repositories and owners that hold it,
combined within tasks first at each of three steps. A value that WIDE owners or more hold, or
that says it is a placeholder, is an example; one that a single owner holds and that looks
live (letters and digits of enough entropy) is live; others are unclear. A mixed run outside
all base spans becomes a span of kind ``token`` if it is live and either stands in a base
span somewhere, or has both cases, digits and a high entropy itself.

Defined cases: a null text is empty; a null owner or repository counts as one of its own; a
null doc_id keeps its row; rows alike in doc_id and text share one result, which each of them
gets; ties in order go by kind, as listed; an empty table gives an empty result; very long
texts are cut whole, their matches spread as rows; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import let
from lectern.runtime import cut

KINDS = ("assign", "access", "hex", "token")
# The base patterns. Their runs are possessive where that changes no match.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\x22']?\x20*+[:=]\x20*+[\x22']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Runs that may be unlabelled secrets.
TOKEN_LEAST = 20
TOKEN = rf"[A-Za-z0-9_+/.=-]{{{TOKEN_LEAST},}}+"
#: Characters that a value keeps only inside.
EDGE = "+/_.=-"
#: Values that say that they are none.
PLACEHOLDER = r"(?i)example|sample|dummy|change.?me|placeholder|your|redacted|x{5}|12345|abcdef|(.)\1{5}"
#: Distinct owners from which a value is widely copied.
WIDE = 3
#: Characters and bits of entropy a character of a value that looks live, and of one that needs no label.
LIVE, ALONE = (12, 2.8), (24, 3.8)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<kind, k, gap, match>>: each match and the length of the text between the one before and it."""

    def placed(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda between: F.transform(found, lambda m, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(between[k]).alias("gap"), m.alias("match"))))

    empty = F.array().cast("array<struct<kind:int,k:int,gap:int,match:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(empty))


def entropy(value: Column) -> Column:
    """Bits a character, of the value's own characters."""
    n = F.length(value)

    def bits(total: Column, c: Column) -> Column:
        return let((n - F.length(F.replace(value, c, F.lit("")))) / n, lambda p: total - p * F.log2(p))

    return F.aggregate(F.filter(F.array_distinct(F.split(value, "")), lambda c: c != ""), F.lit(0.0), bits)


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """row, doc_id, th (hash of the text), owner, repository, kind, start, end, base, digest, live and alone of every base span and candidate."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"),
        F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{repository}`").cast("string").alias("repository"), text.alias("text"),
    )
    found = F.concat(*[_matches(F.col("text"), p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    keep = ("row", "doc_id", "th", "owner", "repository")
    matches = rows.select(*keep, F.explode(found).alias("m")).select(*keep, "m.*").repartition("row")  # all that follows needs a text's matches together
    so_far = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.length("match")).cast("long")).over(so_far)
    placed = matches.select(*keep, "kind", "match", (end - F.length("match")).alias("start"), end.alias("end"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", f"^{ASSIGN}$", 2)).otherwise(F.col("match"))
    placed = placed.withColumn("value", value).where((F.col("kind") > 0) | (F.length("value") >= 6)).withColumn("base", F.col("kind") < 3)
    trimmed = F.ltrim(F.rtrim("value", F.lit(EDGE)), F.lit(EDGE))
    before = F.length("value") - F.length(F.ltrim("value", F.lit(EDGE)))
    open_ = ~F.col("base")
    placed = placed.withColumns({"secret": trimmed, "start": F.when(open_, F.col("start") + before).otherwise(F.col("start"))})
    placed = placed.withColumn("end", F.when(open_, F.col("start") + F.length("secret")).otherwise(F.col("end")))
    # A run is no candidate if a base span that begins before its end reaches beyond its start.
    by_start = Window.partitionBy("row").orderBy("start", F.col("base").desc())
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    left = F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    right = F.min(base_start).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    free = ~((F.coalesce(left, F.lit(-1)) > F.col("start")) | (F.coalesce(right, F.col("end")) < F.col("end")))
    placed = placed.withColumn("free", free).where(F.col("base") | (F.col("free") & (F.length("secret") >= TOKEN_LEAST)))
    looks = placed.withColumns({"bits": F.round(entropy(F.col("secret")), 9), "n": F.length("secret"), "digits": F.length(F.regexp_replace("secret", "[^0-9]", ""))})
    mixed = (F.col("digits") > 0) & (F.col("digits") < F.col("n")) & ~F.rlike("secret", F.lit(PLACEHOLDER))
    both = F.rlike("secret", F.lit("[a-z]")) & F.rlike("secret", F.lit("[A-Z]")) & ~F.rlike("secret", F.lit("[/.]")) & (F.col("digits") >= 3)
    looks = looks.withColumn("live", mixed & (F.col("n") >= LIVE[0]) & (F.col("bits") >= LIVE[1]))
    looks = looks.withColumn("alone", F.col("live") & both & (F.col("n") >= ALONE[0]) & (F.col("bits") >= ALONE[1]))
    digest = F.unhex(F.sha2("secret", 256)).alias("digest")
    return looks.select(*keep, "kind", "start", "end", "base", digest, F.rlike("secret", F.lit(PLACEHOLDER)).alias("placeholder"), "live", "alone")


def ownership(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """digest, n_repositories, n_owners, labelled (stands in a base span) and verdict of every candidate value."""
    flags = [F.max(c).alias(c) for c in ("labelled", "placeholder", "live")]
    held = found.withColumn("labelled", F.col("base")).groupBy("digest", "owner", "repository").agg(*flags)
    held = held.groupBy("digest", "owner").agg(F.count("*").alias("n_repositories"), *flags)
    held = held.groupBy("digest").agg(F.sum("n_repositories").alias("n_repositories"), F.count("*").alias("n_owners"), *flags)
    verdict = F.when(F.col("placeholder") | (F.col("n_owners") >= wide), "example").when(F.col("live") & (F.col("n_owners") == 1), "live").otherwise("unclear")
    return held.select("digest", "n_repositories", "n_owners", "labelled", verdict.alias("verdict"))


def scan_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide: int = WIDE) -> DataFrame:
    """doc_id, th, kind (number), start, end, base, n_repositories, n_owners and verdict of every span, once for rows alike."""
    found = cut(candidates(docs, owner, repository))
    # A value of very many rows is one key of this join; Spark splits it (adaptive skew join), as only the span's side is large there.
    judged = found.join(ownership(found, wide), "digest")
    added = (F.col("verdict") == "live") & (F.col("labelled") | F.col("alone"))
    return judged.where(F.col("base") | added).select("doc_id", "th", "kind", "start", "end", "base", "n_repositories", "n_owners", "verdict")


def scan_documents(docs: DataFrame, owner: str = "source", repository: str = "doc_id", wide: int = WIDE) -> DataFrame:
    """doc_id, spans (sorted by start, then kind) and the counts of kinds and verdicts of every row."""
    one = F.struct("start", "kind", "end", "base", "n_repositories", "n_owners", "verdict")
    found = scan_spans(docs, owner, repository, wide).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(one)).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"))
    key = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["th"] == found["th"])
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans")
    return rows.join(found, key, "left").select(rows["doc_id"], spans)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
