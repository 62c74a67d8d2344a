"""Words of code and prose: identifiers with their parts, stems, identifiers that a question may mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing, endings that are cut, and words of questions that name no code.
STOPWORDS = "a an and are as at be before by do does for from how i in is it its long of on or our point s that the their then there this to up we what when where which who why will with you your us did was were has have had".split()
ENDINGS = ("ances", "ement", "ing", "ies", "ers", "ed", "es", "s")
QUESTION_WORDS = "what which how when why where who does do is are can could should the a an of for to and or in on at into from by with as if not it this that these those i my our your their there here me us them explain tell show give help please about between difference".split()
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"


def parts(token: Column) -> Column:
    """The words of an identifier in camel or snake case, lower-cased."""
    spaced = F.replace(F.regexp_replace(token, "(?<=[a-z0-9])(?=[A-Z])", " "), F.lit("_"), F.lit(" "))
    return F.transform(F.filter(F.split(spaced, " "), lambda p: p != ""), F.lower)


def tokens(text: Column, split: bool = True) -> Column:
    """Lower-cased identifiers and numbers in order, each followed by its parts if it has several; without stop words and
    single characters."""

    def with_parts(t: Column) -> Column:
        p = parts(t)
        return F.concat(F.array(F.lower(t)), F.when(F.size(p) > 1, p).otherwise(F.array().cast("array<string>")))

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    every = F.flatten(F.transform(found, with_parts)) if split else F.transform(found, F.lower)
    return F.filter(every, lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 1))


def stem(token: Column) -> Column:
    """A token without the first of the endings that it has, if more than two characters stay; `ies` becomes `y`."""
    out = token
    for ending in reversed(ENDINGS):
        cut = F.substring(token, F.lit(1), F.length(token) - len(ending))
        cut = F.concat(cut, F.lit("y")) if ending == "ies" else cut
        out = F.when(token.endswith(ending) & (F.length(token) > len(ending) + 2), cut).otherwise(out)
    return out


def looks_like_code(token: Column) -> Column:
    """Whether a word of a question may be a name in code: it has an underscore or a dot, or letters of both cases; an
    acronym is none."""
    joined = F.contains(token, F.lit("_")) | F.contains(token, F.lit("."))
    mixed = F.rlike(token, F.lit("[A-Z]")) & F.rlike(token, F.lit("[a-z]"))
    return ~F.lower(token).isin(*QUESTION_WORDS) & (F.length(token) >= 3) & (joined | mixed)


def candidate_identifiers(question: Column) -> Column:
    """The names in a question that may be code, each once, in their order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), looks_like_code))


def overlap_tier(query: Column, target: Column) -> Column:
    """full, partial or zero: how many of a query's stems stand in a text."""
    q, t = (F.array_distinct(F.transform(tokens(c), stem)) for c in (query, target))
    both = F.size(F.array_intersect(q, t))
    return F.when(both == 0, "zero").when(both == F.size(q), "full").otherwise("partial")
