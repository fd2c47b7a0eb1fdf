"""Text functions of the corpus as Catalyst expressions (Column to Column)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical buckets, and the order in which their patterns are tried.
BUCKETS = ("introduction", "methods", "results", "discussion", "conclusion")
PRIORITY = ("methods", "results", "discussion", "conclusion", "introduction")

# Parts of titles of administrative sections.
ADMIN_PARTS = (
    "data availability",
    "author contributions",
    "conflict of interest",
    "competing interests",
    "publisher",
    "publisher's note",
    "ethics",
    "ethical",
    "funding",
    "acknowledg",
    "abbreviations",
    "supplementary",
    "supporting information",
    "availability of data",
    "consent",
    "trial registration",
    "guarantor",
    "disclaimer",
    "patient and public involvement",
)

# Words of a title that settle its bucket, whatever the parent's.
STRONG = {
    "introduction": r"introduction|background|related work|literature review",
    "methods": r"materials?\s+and\s+methods?|methods?|methodology|experimental procedures|study design|patients?\s+and\s+methods?",
    "results": r"results?|findings?|outcomes?",
    "discussion": r"discussion|interpretation",
    "conclusion": r"conclusions?|concluding|final remarks|summary",
}

# Words of a title that make it methods where no parent says otherwise.
WEAK_METHODS = r"data analysis|statistical analysis|measures?|questionnaire|survey|endpoints?|variables?"

# Headings of two terms and the bucket they go to, first match first.
COMBINED = (("results", "discussion", "results"), ("discussion", "conclusion", "discussion"), ("methods", "results", "methods"))

# Fixed value: leading numbering of a title, such as "1.", "IV)", "Section 2:".
LABEL = r"^\s*(?:section|chapter)?\s*(?:\(?\s*(?:\d+|[ivxlcdm]+|[a-z])\s*\)?\s*[\.\)\-:]\s*)+"

#: White space as in Unicode, with the four separators of ASCII.
SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U){SPACE}+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def without_label(title: Column) -> Column:
    return F.regexp_replace(title, f"(?iU){LABEL}", "")


def normalize_title(title: Column) -> Column:
    """Lower case, no leading label, only a-z, 0-9 and single spaces."""
    lower = without_label(strip(F.lower(F.coalesce(title, F.lit("")))))
    return normalize_whitespace(F.regexp_replace(lower, f"(?U)(?:[^a-z0-9\\s\\x1c-\\x1f])+", " "))


def clean_path_title(title: Column) -> Column:
    """A title for a path: no leading label, single spaces; null as empty."""
    return normalize_whitespace(without_label(F.coalesce(title, F.lit(""))))


def is_admin(normalized: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(normalized, F.lit(p)) for p in ADMIN_PARTS])


def combined_bucket(normalized: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b, bucket in reversed(COMBINED):
        out = F.when(F.contains(normalized, F.lit(a)) & F.contains(normalized, F.lit(b)), bucket).otherwise(out)
    return out


def pattern_bucket(normalized: Column) -> Column:
    """The first bucket whose words a title holds, null if none."""
    out = F.lit(None).cast("string")
    for bucket in reversed(PRIORITY):
        out = F.when(F.rlike(normalized, F.lit(rf"\b(?:{STRONG[bucket]})\b")), bucket).otherwise(out)
    return out


def is_weak(normalized: Column) -> Column:
    return F.rlike(normalized, F.lit(rf"\b(?:{WEAK_METHODS})\b"))


def strong_bucket(normalized: Column) -> Column:
    """The bucket that a title settles, null if none; administrative and empty titles settle none."""
    return F.when((normalized != "") & ~is_admin(normalized), F.coalesce(combined_bucket(normalized), pattern_bucket(normalized)))


def weak_bucket(normalized: Column) -> Column:
    """methods where only weak words say so, else null."""
    return F.when((normalized != "") & ~is_admin(normalized) & strong_bucket(normalized).isNull() & is_weak(normalized), F.lit("methods"))


def title_marks(title: Column) -> Column:
    """struct(strong, weak, admin) of a title, each test made once."""

    def strong(n: Column, admin: Column) -> Column:
        return F.when((n != "") & ~admin, F.coalesce(combined_bucket(n), pattern_bucket(n)))

    def marks(x: Column) -> Column:
        weak = F.when((x["n"] != "") & ~x["admin"] & x["strong"].isNull() & is_weak(x["n"]), F.lit("methods"))
        return F.struct(x["strong"].alias("strong"), weak.alias("weak"), x["admin"].alias("admin"))

    named = let(normalize_title(title), lambda n: F.struct(n.alias("n"), is_admin(n).alias("admin")))
    return let(let(named, lambda x: F.struct(x["n"].alias("n"), x["admin"].alias("admin"), strong(x["n"], x["admin"]).alias("strong"))), marks)


def path_string(path: Column) -> Column:
    """Non-empty titles of a path, cleaned, joined by " > "."""
    return F.array_join(F.transform(F.filter(path, lambda p: p != ""), clean_path_title), " > ")


def prefixed_pmcid(value: Column) -> Column:
    return F.when(F.startswith(value, F.lit("PMC")), value).otherwise(F.concat(F.lit("PMC"), value))


def zero_filled(value: Column) -> Column:
    """At least two characters, zeros in front; longer text as it is."""
    return F.when(F.length(value) < 2, F.lpad(value, 2, "0")).otherwise(value)


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD of texts; null without a year; a day counts only with a month."""
    year, month, day = (F.nullif(x, F.lit("")) for x in (year, month, day))
    with_month = F.concat_ws("-", year, zero_filled(month))
    return F.when(year.isNull(), F.lit(None)).when(month.isNull(), year).when(day.isNull(), with_month).otherwise(F.concat_ws("-", with_month, zero_filled(day)))


def year_number(year: Column) -> Column:
    return F.when(F.rlike(year, F.lit(r"^\d+$")), year.try_cast("int"))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def best_doi(dois: Column) -> Column:
    """The DOI without a revision suffix, then the shortest, then the first."""
    ranked = F.transform(dois, lambda d, k: F.struct(F.rlike(d, F.lit(r"\.r\d{3,}$")).alias("revision"), F.length(d).alias("size"), k.alias("at"), d.alias("doi")))
    return F.array_min(ranked)["doi"]


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each value, in order, by two sorts; nulls go."""
    known = F.filter(values, lambda v: v.isNotNull())
    ranked = F.sort_array(F.transform(known, lambda v, k: F.struct(F.lower(v).alias("low"), k.alias("at"), v.alias("value"))))
    first = let(ranked, lambda all_: F.filter(all_, lambda x, k: (k == 0) | (F.get(all_, k - 1)["low"] != x["low"])))
    return F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["at"], x["value"]))), lambda x: x["value"])


def joined_distinct(values: Column, separator: str = "; ") -> Column:
    """Distinct values joined in order; null if there are none."""
    return F.when(F.size(values) > 0, F.array_join(F.array_distinct(values), separator))


def file_stem(path: Column) -> Column:
    """The name of a file without folders and its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def without_citations(answer: Column) -> Column:
    """An answer without its citation marks, in any of their spellings."""
    return F.regexp_replace(answer, "⟦S:?\\d+⟧", "")


def with_header(header: Column, body: Column) -> Column:
    """The stripped header, an empty line, and the body; the body alone if there is no header."""
    return F.when(F.nullif(header, F.lit("")).isNull(), body).otherwise(F.concat(strip(header), F.lit("\n\n"), body))


# English stop words of letters only.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


#: Marks that part words, as in a class of a pattern, and contractions.
MARKS, CONTRACTIONS = r""",;:?!()\[\]{}<>"@#$%&""", r"n't|'(?:s|m|d|ll|re|ve)"
#: A word of spaced_words() that is of letters only.
IS_WORD = r"^\p{L}+\z"
#: All of them in a lower-cased text without double hyphens, found in one scan.
WORDS = rf"(?<![^\s{MARKS}])\p{{L}}+(?=\.?(?:{CONTRACTIONS})?(?![^\s{MARKS}]))"


def spaced_words(text: Column) -> Column:
    """Lower-cased words between white space: marks part words, contractions and a last dot are split off."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[{MARKS}]|--", " ")
    parted = F.regexp_replace(spaced, rf"({CONTRACTIONS})(\s|\z)", " $1$2")
    return F.split(F.regexp_replace(parted, r"\.(?=\s|\z)", ""), r"\s+")


def tokens(text: Column) -> Column:
    """Lower-cased words of letters only that are not stop words.

    A word with a digit or an inner hyphen is not of letters only and goes. These are the words of
    spaced_words() that IS_WORD allows; one scan finds them, instead of four and one more a word.
    """
    spaced = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("--"), F.lit(" "))
    return F.filter(F.regexp_extract_all(spaced, F.lit(WORDS), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
