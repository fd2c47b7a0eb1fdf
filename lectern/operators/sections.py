"""Sections of a paper: buckets, de-duplication and the bucket index, inside each row.

Everything works on the array of a paper's sections, in time linear in them but for sorts,
so nothing is shuffled. A section's
bucket has a closed form. At depth 0 it is the strong match, else the weak one, else (unless
the title is administrative or inheritance is off) the last strong match among earlier
sections of depth 0, else the title, else "untitled". Deeper it is the nearest strong match
among itself and its ancestors, else the bucket of its ancestor at depth 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

#: What the parser gives for each section: places of its ancestors, the outermost first, and itself.
RAW = "section_index int, depth int, chain array<int>, title string, text string"


def with_buckets(raw: Column, inherit: bool = True) -> Column:
    """Sections (array of RAW, in document order) with path, path_string and bucket."""
    marked = F.transform(
        raw,
        lambda s: F.struct(
            *[s[k].alias(k) for k in ("section_index", "depth", "chain", "title", "text")],
            T.title_marks(s["title"]).alias("marks"),
        ),
    )

    def carried(all_: Column) -> Column:
        """For each section the last strong bucket among earlier ones of depth 0, null if there is none: runs between them, end to end."""
        strong = F.filter(all_, lambda s: (s["depth"] == 0) & s["marks"]["strong"].isNotNull())
        run = lambda found: lambda s, j: F.array_repeat(s["marks"]["strong"], (F.coalesce(F.get(found, j + 1)["section_index"], F.size(all_) - 1) - s["section_index"]).cast("int"))
        before = lambda found: F.array_repeat(F.lit(None).cast("string"), F.coalesce(F.get(found, F.lit(0))["section_index"] + 1, F.size(all_)).cast("int"))
        return T.let(strong, lambda found: F.concat(before(found), F.flatten(F.transform(found, run(found)))))

    def at_top(carry: Column, s: Column) -> Column:
        inherited = F.when(~s["marks"]["admin"], F.get(carry, s["section_index"])) if inherit else F.lit(None)
        return F.coalesce(s["marks"]["strong"], s["marks"]["weak"], inherited, F.nullif(T.strip(F.coalesce(s["title"], F.lit(""))), F.lit("")), F.lit("untitled"))

    def build(all_: Column, carry: Column) -> Column:
        def one(s: Column) -> Column:
            chain = F.transform(s["chain"], lambda k: F.get(all_, k))
            below = lambda up: F.filter(F.transform(F.slice(up, F.lit(2), F.size(up)), lambda o: o["marks"]["strong"]), lambda b: b.isNotNull())
            bucket = lambda up: T.let(below(up), lambda b: F.when(F.size(b) > 0, F.get(b, F.size(b) - 1)).otherwise(at_top(carry, F.get(up, F.lit(0)))))
            path = lambda up: F.filter(F.transform(up, lambda o: o["title"]), lambda t: F.coalesce(t, F.lit("")) != "")
            return T.let(chain, lambda up: F.struct(
                s["section_index"].alias("section_index"), s["depth"].alias("depth"), path(up).alias("path"), T.path_string(path(up)).alias("path_string"),
                F.nullif(s["title"], F.lit("")).alias("title"), bucket(up).alias("bucket"), s["text"].alias("text"),
            ))

        return F.transform(all_, one)

    return T.let(T.let(marked, lambda all_: F.struct(all_.alias("all"), carried(all_).alias("carry"))), lambda x: build(x["all"], x["carry"]))


def meaningful(sections: Column) -> Column:
    """Sections with a title or text; their indices keep the gaps."""
    return F.filter(sections, lambda s: s["title"].isNotNull() | (F.coalesce(s["text"], F.lit("")) != ""))


def distinct_sections(sections: Column) -> Column:
    """The first section of each path string and text, in order, by two sorts."""
    ranked = F.sort_array(F.transform(sections, lambda s, k: F.struct(s["path_string"].alias("path"), s["text"].alias("text"), k.alias("at"))))
    alike = lambda x, y: x["path"].eqNullSafe(y["path"]) & x["text"].eqNullSafe(y["text"])
    first = T.let(ranked, lambda all_: F.filter(all_, lambda x, k: (k == 0) | ~alike(F.get(all_, k - 1), x)))
    kept = F.sort_array(F.transform(first, lambda x: x["at"]))
    return T.let(F.struct(sections.alias("all"), kept.alias("kept")), lambda x: F.transform(x["kept"], lambda k: F.get(x["all"], k)))


def bucket_index(sections: Column) -> Column:
    """Map of each of the five buckets to the indices of its sections that have text."""
    names = F.array(*map(F.lit, T.BUCKETS))
    full = F.filter(sections, lambda s: F.rlike(F.coalesce(s["text"], F.lit("")), F.lit(f"(?U)[^{T.SPACE[1:-1]}]")))
    own = lambda x: lambda b: F.transform(F.filter(x, lambda s: s["bucket"] == b), lambda s: s["section_index"])
    return T.let(full, lambda x: F.map_from_arrays(names, F.transform(names, own(x))))


def _stripped(text: Column) -> Column:
    """strip() that only rewrites a text whose first or last character is white space."""
    ends = lambda t: F.rlike(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))), F.lit(f"(?U){T.SPACE}"))
    return T.let(text, lambda t: F.when(ends(t), T.strip(t)).otherwise(t))


def _joined(texts: Column, places: Column, separator: str) -> Column:
    """The texts at some places that are not blank, stripped; so the whole needs no stripping."""
    found = F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda k: _stripped(F.coalesce(F.get(texts, k.cast("int")), F.lit(""))))
    return F.array_join(F.filter(found, lambda t: t != ""), separator)


def bucket_text(buckets: Column, sections: Column, bucket: str, separator: str = "\n\n") -> Column:
    """Texts of a bucket's sections in order; empty for a bucket that is not there."""
    return T.let(texts_by_index(sections), lambda texts: _joined(texts, F.try_element_at(buckets, F.lit(bucket)), separator))


def bucket_texts(buckets: Column, sections: Column, separator: str = "\n\n") -> Column:
    """Map of each of the five buckets to its text; the sections are placed once for all of them."""
    names = F.array(*map(F.lit, T.BUCKETS))
    both = F.named_struct(F.lit("texts"), texts_by_index(sections), F.lit("at"), buckets)
    return T.let(both, lambda x: F.map_from_arrays(names, F.transform(names, lambda b: _joined(x["texts"], F.try_element_at(x["at"], b), separator))))


def texts_by_index(sections: Column) -> Column:
    """Texts at their section_index, null in the gaps; the indices ascend."""

    def placed(all_: Column) -> Column:
        gap = lambda s, k: s["section_index"] - F.coalesce(F.when(k > 0, F.get(all_, k - 1)["section_index"]), F.lit(-1)) - 1
        return F.flatten(F.transform(all_, lambda s, k: F.concat(F.array_repeat(F.lit(None).cast("string"), gap(s, k).cast("int")), F.array(s["text"]))))

    return T.let(sections, placed)


def assemble(papers: DataFrame, raw: str = "raw_sections", inherit: bool = True) -> DataFrame:
    """Papers with sections and buckets made from the column of raw sections."""
    given = F.coalesce(F.col(raw), F.array().cast(f"array<struct<{_typed(RAW)}>>"))
    made = T.let(distinct_sections(meaningful(with_buckets(given, inherit))), lambda s: F.struct(s.alias("sections"), bucket_index(s).alias("buckets")))
    rest = [c for c in papers.columns if c != raw]
    return papers.select(*rest, made.alias("_made")).select(*rest, "_made.sections", "_made.buckets")


def _typed(ddl: str) -> str:
    return ", ".join(": ".join(f.split(" ", 1)) for f in ddl.split(", "))
