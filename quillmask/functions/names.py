"""Column expressions over names of people and organisations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import CATEGORY_LABELS, HONORIFICS, NICKNAMES, NOT_A_PERSON, NOT_NAMES, ORGANISATION_WORDS
from .text import bind


def words_of(list_: list[str]) -> Column:
    return F.array(*map(F.lit, list_))


def tokens(text: Column) -> Column:
    """Words between white space; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def folded(text: Column) -> Column:
    """Lower case, each run of white space one space, trimmed: the form in which names are compared."""
    return F.array_join(tokens(F.lower(text)), " ")


def variations(name: Column, keep_short: Column | None = None) -> Column:
    """Written forms of a full name, in order and distinct: whole, first, last, "F. Last", "First L.", "F.L.", and initials of
    three or more parts. Forms under three characters are left out, but for the name that must stay (by default itself)."""
    initial = lambda x: F.substring(x, 1, 1)

    def made(name: Column, part: Column) -> Column:
        first, last = F.element_at(part, 1), F.element_at(part, -1)
        initials = F.array_join(F.transform(part, initial), "")
        forms = F.array(name, first, last, F.concat(initial(first), F.lit(". "), last), F.concat(first, F.lit(" "), initial(last), F.lit(".")),
                        F.concat(initial(first), F.lit("."), initial(last), F.lit(".")))
        forms = F.when(F.size(part) >= 3, F.concat(forms, F.array(initials))).when(F.size(part) == 2, forms).otherwise(F.array(name))
        keep = name if keep_short is None else keep_short
        return F.array_distinct(F.filter(forms, lambda v: (v != "") & ((F.length(v) >= 3) | (v == keep))))

    # the name may be a long expression, so it and its words are computed once
    return bind(F.btrim(F.coalesce(name, F.lit(""))), lambda n: bind(tokens(n), lambda part: made(n, part)))


def nicknames(name: Column) -> Column:
    """Short forms of each part of a name, and full forms of each part that is a short form, sorted."""
    shorter = F.create_map(*[x for k, v in NICKNAMES.items() for x in (F.lit(k), words_of(v))])
    longer: dict[str, list[str]] = {}
    for full, shorts in NICKNAMES.items():
        for s in shorts:
            longer.setdefault(s, []).append(full)
    longer_map = F.create_map(*[x for k, v in longer.items() for x in (F.lit(k), words_of(v))])
    none = F.array().cast("array<string>")
    found = F.flatten(F.transform(tokens(F.lower(name)), lambda p: F.concat(F.coalesce(F.try_element_at(shorter, p), none), F.coalesce(F.try_element_at(longer_map, p), none))))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (F.length(n) >= 3) & ~n.isin(NOT_NAMES))))


def organisation_forms(name: Column) -> Column:
    """An organisation's name and its telling words of three or more characters."""
    word = lambda w: F.regexp_replace(w, "^['’]+|['’]+$", "")
    fine = lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(NOT_NAMES + ORGANISATION_WORDS)
    return F.concat(F.array(name), F.filter(F.transform(tokens(name), word), fine))


def is_person_category(category: Column) -> Column:
    c = F.lower(F.coalesce(category, F.lit("")))
    return ~c.rlike("organi[sz]ation") & c.rlike("name|person|parent|family")


def clean_person(name: Column) -> Column:
    """A candidate's name with single spaces and without titles in front; null if it is no person: more than four words, words
    that are not letters (but for apostrophes and hyphens), or words of forms."""
    title = lambda t: F.regexp_replace(F.lower(t), r"\.+$", "").isin(HONORIFICS)
    core = lambda t: F.regexp_replace(t, r"^[.'’-]+|[.'’-]+$", "")

    def untitled(part: Column) -> Column:
        leading = F.aggregate(part, F.lit(0), lambda n, t: F.when((n >= 0) & title(t), n + 1).when(n > 0, -n).when(n == 0, F.lit(-1000)).otherwise(n))
        return bind(F.when(leading == -1000, 0).otherwise(F.abs(leading)), lambda lead: F.slice(part, lead + 1, F.greatest(F.size(part) - lead, F.lit(0))))

    def person(part: Column) -> Column:
        bad = F.exists(part, lambda t: ~F.regexp_replace(core(t), "['’-]", "").rlike(r"^\p{L}+$") | F.lower(core(t)).isin(NOT_A_PERSON))
        return F.when((F.size(part) >= 1) & (F.size(part) <= 4) & ~bad, F.array_join(part, " "))

    return bind(bind(tokens(name), untitled), person)


def is_form_label(text: Column) -> Column:
    """Whether every word is one that forms print before a field."""
    part = tokens(F.replace(F.coalesce(text, F.lit("")), F.lit(":"), F.lit(" ")))
    core = lambda t: F.regexp_replace(F.lower(t), r"^[.,:;'’-]+|[.,:;'’-]+$", "")
    return (F.size(part) > 0) & F.forall(part, lambda t: core(t).isin(NOT_A_PERSON))


def category_label(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv])[category]
