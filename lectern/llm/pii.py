"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

One pass over the whole texts finds the base spans (seeds) and every other token that
looks like an identifier, each with its lexical contexts: the words left of it on its line
(two, one) and around it. Spark then scores the graph of contexts and instances until a
round finds nothing new. A context is trusted for a kind if it holds at least SUPPORT known
instances of it, seeds or found in earlier rounds, whose scores make TRUST of all its
distinct instances; an instance of the kind's shape becomes known if its trusted contexts
together reach TRUST, and may then lift further contexts. What is known stays known, so the
rounds end. Mentions of the right shape in a trusted context become further spans. Only
mentions are shuffled, never texts.

Defined cases: a null text is empty; a null doc_id keeps its row; repeated rows each keep
their own row; an empty table gives an empty result; other columns are not looked at,
whatever their names; base spans are never taken away and an added span never overlaps a
base span; of equally trusted kinds the first listed wins. Very long texts and tokens are
read whole, in linear time: a context reaches back to the mention before at most, which
stands in it as one word. Instances and contexts of more than LONG characters are named by
their digest.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import column, keyed_texts, map_rows, sha, texts
from lectern.runtime import cut

KINDS = ("email", "ip", "card", "phone")
#: Distinct known instances that a context needs, and the precision from which it is trusted.
SUPPORT, TRUST = 3, 0.8
#: Characters above which an instance or a context is named by its digest; of text that is searched for context words at first.
LONG, REACH = 64, 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs: a number that fails from its first digit fails from any later one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_SEED_OF_TOKEN = re.compile(r"[0-9]++(?:[ -]?[0-9]++)*+|@")
_TOKEN_END = re.compile(r"\S*")
_NUMBER = re.compile("[0-9]+")
#: Stands in a context for a mention beside it.
MENTION = "\0"
_TRIM = "\"'()[]{}<>|*#$%&=,;:.!?"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every base match, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(n := p.lstrip("0") or "0") <= 3 and int(n) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]
    return sorted(out)


def shape(token: str) -> list[int]:
    """Kinds whose shape the token has."""
    digits = len(_DIGITS.sub("", token))
    kinds = []
    if "@" in token[1:-1]:
        kinds.append(0)
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}|[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}", token):
        kinds.append(1)
    if digits >= 8 and re.fullmatch(r"[0-9]+([ -][0-9]+)*", token):
        kinds.append(2)
    if 7 <= digits <= 15 and re.fullmatch(r"\+?[0-9(][0-9()./ -]*", token):
        kinds.append(3)
    return kinds


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of tokens with digits or an @ that look like identifiers and touch no base span."""
    out, pos, k = [], 0, 0
    spans = sorted((a, b) for a, _, b in base)
    while found := _SEED_OF_TOKEN.search(text, pos):
        start, end = found.start(), _TOKEN_END.match(text, found.end()).end()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        pos = max(end, found.end())
        while start < end and text[start] in _TRIM and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in _TRIM:
            end -= 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        if shape(text[start:end]):
            out.append((start, end))
    return out


def _left_words(text: str, low: int, start: int) -> list[str]:
    """The last two words of text[low:start] on start's line; MENTION first if fewer stand after a mention on it."""
    reach = REACH
    while True:
        at = max(low, start - reach)
        part = text[at:start]
        line = part.rpartition("\n")
        words = line[2].split()
        if line[1]:
            return words[-2:]
        if at == low:
            return ([MENTION] * (low > 0) + words)[-2:]
        if len(words) > 2:
            return words[-2:]
        reach *= 2


def _right_word(text: str, end: int, high: int) -> str:
    """The first word of text[end:high] on end's line; MENTION or nothing if there is none."""
    reach = REACH
    while True:
        at = min(high, end + reach)
        part, newline, _ = text[end:at].partition("\n")
        words = part.split(None, 1)
        if words and (newline or len(words) == 2 or at == high or part[-1].isspace()):
            return words[0]
        if newline or at == high:
            return MENTION if not newline and high < len(text) else ""
        reach *= 2


def named(text: str) -> str:
    """A text as it is, or its digest if it is long."""
    return text if len(text) <= LONG else sha(text)


def contexts(text: str, low: int, start: int, end: int, high: int) -> list[str]:
    """Lexical contexts of a mention between the mentions that end at ``low`` and begin at ``high``."""
    left = [_NUMBER.sub("0", w.lower()) for w in _left_words(text, low, start)]
    if not left:
        return []
    right = _right_word(text, end, high).lower()
    out = [f"1 {left[-1]}"]
    if len(left) == 2:
        out.append(f"2 {left[0]} {left[1]}")
    if right:
        out.append(f"r {left[-1]} _ {right}")
    return [named(x) for x in out]


def mentions_of(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds (base spans) and candidates of a text in order, with shapes, instance and contexts."""
    found = sorted([(a, b, k) for a, k, b in base] + [(a, b, -1) for a, b in candidates(text, base)])
    out, low = [], 0
    for at, (a, b, k) in enumerate(found):
        high = max(b, found[at + 1][0]) if at + 1 < len(found) else len(text)
        token = text[a:b]
        near = contexts(text, min(low, a), a, b, high)
        out.append({"start": a, "end": b, "seed": k, "shapes": [k] if k >= 0 else shape(token), "instance": named(token.lower()), "contexts": near})
        low = max(low, b)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), counts, base_sha256, base spans and mentions (seeds and candidates with contexts)."""

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            counts, digests, spans, mentions = [], [], [], []
            for text in texts(batch):
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                counts.append([kinds.count(k) for k in range(4)])
                digests.append(sha(joined(base)))
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                mentions.append(mentions_of(text, base))
            return {"doc_id": column(batch, "doc_id"), "th": column(batch, "th"), "base_sha256": digests, "base": spans, "mentions": mentions} | {
                f"n_{name}": [c[k] for c in counts] for k, name in enumerate(KINDS)
            }

        return one

    ddl = (
        "doc_id long, th long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, base array<struct<start: int, kind: int, end: int>>, "
        "mentions array<struct<start: int, end: int, seed: int, shapes: array<int>, instance: string, contexts: array<string>>>"
    )
    return map_rows(keyed_texts(docs).withColumn("th", F.xxhash64("text")), per_task, ddl)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def trusted_contexts(mentions: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(context, kind, confidence) after bootstrapping over the context-instance graph.

    mentions: instance, seed (kind index, -1 for none), shapes and contexts. Contexts of
    fewer than ``support`` distinct instances can never be trusted and are left out at once.
    """
    edges = mentions.select(F.explode("contexts").alias("context"), "instance", "seed", "shapes").groupBy("context", "instance").agg(
        F.max("seed").alias("seed"), F.bit_or(F.aggregate("shapes", F.lit(0), lambda m, k: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), k)))).alias("shapes")
    )
    edges = cut(edges)
    size = edges.groupBy("context").agg(F.count("*").alias("size")).where(F.col("size") >= support)
    edges = cut(edges.join(size, "context"))
    known = cut(edges.where("seed >= 0").select("instance", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0)))
    while True:
        weight = edges.join(known, "instance").groupBy("context", "kind").agg(F.count("*").alias("n"), F.sum(F.col("score").cast("decimal(20,9)")).alias("weight"), F.max("size").alias("size"))
        confidence = (F.col("weight") / F.col("size")).cast("double").alias("confidence")
        scored = cut(weight.where(F.col("n") >= support).select("context", "kind", confidence).where(F.col("confidence") >= trust))
        has_shape = F.call_function("shiftright", F.col("shapes"), F.col("kind")).bitwiseAND(F.lit(1)) == 1
        doubt = F.sum(F.log(1.0001 - F.col("confidence")).cast("decimal(20,9)"))  # decimals: the same in any order of rows
        found = edges.where("seed < 0").join(scored, "context").where(has_shape).groupBy("instance", "kind").agg((1 - F.exp(doubt.cast("double"))).alias("score"))
        new = cut(found.where(F.col("score") >= trust).join(known.select("instance", "kind"), ["instance", "kind"], "left_anti"))
        if new.isEmpty():
            return scored
        known = cut(known.unionByName(new))


def find(docs: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """doc_id, th (hash of the text), counts, base_sha256, base (spans), added (spans) and row, a number that names the row."""
    rows = cut(scan(docs).withColumn("row", F.monotonically_increasing_id()))
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    contexts_ = trusted_contexts(mentions, support, trust)
    open_ = mentions.where("seed < 0").select("row", "start", "end", "shapes", F.explode("contexts").alias("context"))
    best = F.max_by("kind", F.struct("confidence", -F.col("kind"))).cast("int")
    added = (
        open_.join(contexts_, "context").where(F.array_contains("shapes", F.col("kind")))
        .groupBy("row", "start", "end").agg(best.alias("kind"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    )
    return rows.drop("mentions").join(added, "row", "left")


def spans_column() -> F.Column:
    """All spans of find()'s rows as kind:start:end, by start, then kind."""
    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(both, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlaps merged, replaced by its kind in brackets."""
    out, done = [], 0
    for a, k, b in sorted(spans):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def added_by_text(found: DataFrame) -> DataFrame:
    """(doc_id, th, added), once for rows alike, of find()'s rows that have added spans."""
    return found.where(F.col("added").isNotNull()).select("doc_id", "th", "added").dropDuplicates(["doc_id", "th"])
