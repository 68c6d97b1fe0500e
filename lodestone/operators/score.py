"""Term expansion and ranking as Columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.plans.query import Leaf

EXACT, PREFIX, FUZZY = 0, 1, 2
#: Fixed value: how much a prefix match's weight falls with each further character, against a fuzzy one's with each edit.
PREFIX_DECAY = 0.3


def term_filter(leaf: Leaf, term: Column, edits: bool = True) -> Column:
    """Terms that a leaf expands to.  Equality and literal prefixes reach the scan; fuzzy terms are held to a length band
    (without ``edits``: left to another condition)."""
    found = term == F.lit(leaf.term)
    if leaf.prefix:
        found = found | term.startswith(F.lit(leaf.term))
    if leaf.distance and edits:
        found = found | (F.length(term).between(len(leaf.term) - leaf.distance, len(leaf.term) + leaf.distance) & (F.levenshtein(term, F.lit(leaf.term), leaf.distance) >= 0))
    return found


def expansion(leaf: Leaf, term: Column) -> Column:
    """struct(leaf, kind, weight) of a term, null if the leaf does not expand to it: exact before prefix before fuzzy."""
    size, own = F.length(term).cast("double"), float(len(leaf.term))
    row = lambda kind, weight: F.struct(F.lit(leaf.index).alias("leaf"), F.lit(kind).alias("kind"), (weight * F.lit(leaf.boost)).alias("weight"))
    out = F.when(term == F.lit(leaf.term), row(EXACT, F.lit(1.0)))
    if leaf.prefix:
        out = out.when(term.startswith(F.lit(leaf.term)), row(PREFIX, F.lit(leaf.weights["prefix"]) * size / (size + F.lit(PREFIX_DECAY) * (size - F.lit(own)))))
    if leaf.distance:
        edits = F.levenshtein(term, F.lit(leaf.term), leaf.distance)
        near = F.length(term).between(len(leaf.term) - leaf.distance, len(leaf.term) + leaf.distance) & (edits > 0)
        out = out.when(near, row(FUZZY, F.lit(leaf.weights["fuzzy"]) * size / (size + edits)))
    return out


def expansions(leaves: list[Leaf], term: Column) -> Column:
    """Array of the expansions of a term over all leaves."""
    return F.array_compact(F.array(*[expansion(x, term) for x in leaves]))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def by_leaf(leaves: list[Leaf], value, leaf: Column) -> Column:
    """``value(leaf)`` for the leaf number in a column; one literal if all leaves agree."""
    values = {x.index: value(x) for x in leaves}
    if len(set(values.values())) == 1:
        return F.lit(next(iter(values.values())))
    return F.element_at(F.create_map(*[F.lit(y) for x in values.items() for y in x]), leaf)


def field_boost(leaves: list[Leaf], field_ids: Mapping[str, int], leaf: Column, field_id: Column) -> Column:
    """Boost of a field for a leaf; null if the leaf does not search the field."""
    table = {(x.index, field_ids[name]): boost for x in leaves for name, boost in x.fields}
    if not table:
        return F.lit(None).cast("double")
    width = len(field_ids)
    return F.try_element_at(F.create_map(*[F.lit(y) for (a, b), boost in table.items() for y in (a * width + b, boost)]), leaf * width + field_id)


def bm25(tf: Column, documents: int, matching: Column, length: Column, mean: Column, k: Column, b: Column, d: Column) -> Column:
    """BM25+ with a floor ``d`` for each match; all arithmetic in doubles."""
    rarity = F.log(1 + (F.lit(float(documents)) - matching + 0.5) / (matching + 0.5))
    return rarity * (d + tf * (k + 1) / (tf + k * (1 - b + b * length / mean)))
