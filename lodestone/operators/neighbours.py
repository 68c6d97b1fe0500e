"""The lexicon by deletions, kept so that fuzzy terms are looked up instead of compared.

Two terms within ``k`` edits give a common string after at most ``k`` deletions each.  ``neighbour_table`` holds every string
that a term gives after up to ``DELETIONS`` of them, sorted, so that a query's few strings skip row groups and a batch's meet
the table by one equality join.  It grows with the lexicon (about half the square of a term's length), not with the postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits up to which terms meet by deletions, and the longest asked term for which they do; else by segments.
DELETIONS, LONGEST = 2, 24


def deletions(term: Column, times: int) -> Column:
    """The term and what is left of it after up to ``times`` deletions of a character."""
    less = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, 1, i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))
    out = F.array(term)
    for _ in range(times):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, less))))
    return out


def text_deletions(term: str, times: int) -> set[str]:
    """The same for a query term."""
    out = {term}
    for _ in range(times):
        out |= {t[:i] + t[i + 1 :] for t in out for i in range(len(t))}
    return out


def neighbour_table(lexicon: DataFrame) -> DataFrame:
    """(cut, times, term): what each of ``lexicon(term)`` gives after ``times`` deletions, least ones."""
    rows = lexicon.where(F.length("term") <= LONGEST + DELETIONS).select("term", F.array(*[deletions(F.col("term"), n) for n in range(DELETIONS + 1)]).alias("upto"))
    fresh = [F.get("upto", F.lit(0)), *[F.array_except(F.get("upto", F.lit(n)), F.get("upto", F.lit(n - 1))) for n in range(1, DELETIONS + 1)]]
    rows = rows.select("term", F.posexplode(F.array(*fresh)).alias("times", "cuts")).select(F.explode("cuts").alias("cut"), "times", "term")
    return rows.repartitionByRange("cut").sortWithinPartitions("cut")
