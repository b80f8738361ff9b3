"""Names and texts as Columns: tokens, stems, shapes, suffixes, hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Lower-case tokens of two characters or more; splits at non-alphanumerics and at inner capitals."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")
    t = F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(t), " "), lambda w: F.length(w) > 1)


def norm_tok(token: Column) -> Column:
    """A light stemmer: plural endings one after another, then endings of longer words, then a final e.

    "classes" and "class" meet: each rule reads what the rule before it left.
    """
    t = F.lower(token)
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "ies$", "y"), "(s|x|sh|ch)es$", "$1"), "s$", "")
    two = one
    for ending, by in (("ation$", "ate"), ("[ts]ion$", "t"), ("ing$", ""), ("(er|or)$", "")):
        two = F.regexp_replace(two, ending, by)
    two = F.when(F.length(one) >= 6, two).otherwise(one)
    three = F.when(F.length(two) >= 5, F.regexp_replace(two, "e$", "")).otherwise(two)
    return F.when(F.length(t) <= 3, t).otherwise(three)


#: Pairs of classes that fold into one unit, once or repeated.
SHAPE_UNITS = ["Ua", "_a", "_U", "-a", "-U", ".a", ".U", "$a", "$U"]


def name_shape(name: Column) -> Column:
    """Runs of capitals are U, runs of lower case and digits a, other marks but _ - $ . are ?; runs of a mark and of
    units fold: ``BaseDto`` is ``(Ua)+``, ``a__b`` is ``a(_)+a``. Nothing is ?."""
    t = F.regexp_replace(F.regexp_replace(name, "[A-Z]+", "U"), "[a-z0-9]+", "a")
    t = F.regexp_replace(F.regexp_replace(t, r"[^Ua_\-$.]", "?"), r"(.)\1+", "($1)+")
    units = "|".join(re.escape(u) for u in SHAPE_UNITS)
    t = F.regexp_replace(t, rf"({units})\1*", "($1)+")
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.lit("?")).otherwise(t)


def suffix(path: Column) -> Column:
    """The last two dotted parts of a base name of three or more, else its extension, else nothing; lower case."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), r"\.")
    found = F.when(F.size(parts) >= 3, F.concat_ws(".", F.slice(parts, -2, 2))).when(F.size(parts) == 2, F.element_at(parts, -1)).otherwise(F.lit(""))
    return F.lower(found)


def name_suffix(name: Column) -> Column:
    """The last token of a name of two tokens or more, else ``none``."""
    t = tokenize(name)
    return F.when(F.size(t) >= 2, F.element_at(t, -1)).otherwise(F.lit("none"))


def doc_tokens(text: Column, stop: list[str] = (), most: int = 24) -> Column:
    """Tokens of the first sentence of a comment, without its marks and without stop words."""
    first = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^[\s/*#;!-]+", " "), r"^([^.!?]*)", 1)
    return F.slice(F.filter(tokenize(first), lambda w: ~w.isin(*stop)) if stop else tokenize(first), 1, most)


def symbols(text: Column, most: int = 12) -> Column:
    """Identifiers of four characters or more with an inner capital or underscore, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+|[a-z0-9][A-Z][A-Za-z0-9]*)+)\b"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda w: F.length(w) >= 4)), 1, most)


def is_fix(message: Column) -> Column:
    """A message that speaks of a repair."""
    return F.coalesce(message.rlike(r"(?i)\b(fix(e[sd])?|bug(fix)?|revert(s|ed)?|hotfix|regression)\b"), F.lit(False))


def resolve_import(spec: Column, path: Column) -> Column:
    """A relative import from a file, as ``~/`` and the path without extension; other imports stay as they are."""
    base = F.regexp_replace(path, "[^/]*$", "")
    parts = F.split(F.concat(base, spec), "/")
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x.isin("", "."), out)
                     .when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    return F.when(spec.startswith("."), F.concat(F.lit("~/"), F.regexp_replace(F.array_join(up, "/"), r"\.[a-z]+$", ""))).otherwise(spec)


def stem(path: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of the text, each one unit (so up to U+FFFF)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619, F.lit(4294967296)))


def prefixes(path: Column) -> Column:
    """All directory prefixes of a path, shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; two empty sets share nothing."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def weighted_jaccard(a: Column, b: Column, heavy: tuple[str, ...] = ("dec:", "sup:", "ret:"), factor: float = 3.0) -> Column:
    """Jaccard where features that begin with one of ``heavy`` count ``factor`` times."""

    def weight(features: Column) -> Column:
        one = lambda x: F.when(F.array_contains(F.transform(F.array(*map(F.lit, heavy)), lambda p: F.startswith(x, p)), True), F.lit(factor)).otherwise(F.lit(1.0))
        return F.aggregate(F.transform(features, one), F.lit(0.0), lambda x, y: x + y)

    union = weight(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(weight(F.array_intersect(a, b)) / union)


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ``**`` crosses directories, ``*`` and ``?`` don't, braces are choices."""
    out, i, deep = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            deep += 1
            out.append("(?:")
        elif c == "}" and deep:
            deep -= 1
            out.append(")")
        elif c == "," and deep:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    return F.coalesce(path.rlike(glob_pattern(glob)), F.lit(False))
