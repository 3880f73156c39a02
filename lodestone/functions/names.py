"""Names of conditions as they are compared: a normal form and its variants, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plural endings with what they stand for (all that apply are tried) and names said otherwise.
PLURALS = (("oses", "osis"), ("ses", "sis"), ("ae", "a"), ("ies", "y"), ("i", "us"), ("es", ""), ("s", ""))
REWRITES = (
    (r"^(.*?) cancer$", "malignant neoplasm of $1"),
    (r"^(.*?) cancer$", "malignant tumor of $1"),
    (r"^broken (.*)$", "fracture of $1"),
    (r"^(.*?) stones?$", "calculus of $1"),
    (r"^(.*?) injur(?:y|ies)$", "injury of $1"),
    (r"^dislocated (.*)$", "dislocation of $1"),
)
QUALIFIER = r"\s+(in adults?|in children( and young people)?|in babies|in men|in women|in pregnancy|in over \d+s|in under \d+s)$"


def norm(c: Column) -> Column:
    """Lower case, brackets dropped, & read as and, all but letters and digits to blanks, squeezed."""
    steps = ((r"\s*\([^)]*\)", " "), ("&", " and "), (r"[^a-z0-9 ]", " "), (r"\s+", " "))
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.lower(c)))


def variants(display: Column) -> Column:
    """Normal forms to try, the most faithful first: cross-reference, brackets, qualifier, halves, plurals, rewrites."""
    refers = F.instr(display, ", see ") > 0
    body = F.when(refers, F.substring(display, F.instr(display, ", see ") + 6, F.length(display))).otherwise(display)
    head = F.when(refers, F.substring_index(display, ", see ", 1))
    words = lambda x: F.size(F.split(F.trim(x), r"\s+"))
    brackets = F.filter(F.regexp_extract_all(body, F.lit(r"\(([^)]+)\)"), 1), lambda x: (words(x) <= 6) & ((x != F.upper(x)) | ~x.rlike("[A-Za-z]")))
    halves = F.filter(F.split(body, r"\s+and\s+"), lambda x: words(x) >= 2)
    none = F.array().cast("array<string>")
    wrap = lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(none)
    tidy = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))
    first = tidy(F.concat(F.array(norm(body)), wrap(norm(head)), F.transform(brackets, norm), F.array(norm(F.regexp_replace(norm(body), QUALIFIER, ""))), F.transform(halves, norm)))

    def plural(x: Column) -> Column:
        return F.array(*(F.when(x.endswith(e) & (F.length(x) - len(e) >= 3), norm(F.concat(F.substring(x, F.lit(1), F.length(x) - len(e)), F.lit(r)))) for e, r in PLURALS))

    second = tidy(F.concat(first, F.flatten(F.transform(first, plural))))
    said = lambda x: F.array(*(F.when(x.rlike(p), norm(F.regexp_replace(x, p, r))) for p, r in REWRITES))
    return tidy(F.concat(second, F.flatten(F.transform(second, said))))
