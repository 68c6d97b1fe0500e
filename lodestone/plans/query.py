"""Queries as small driver-side trees: options, their resolution, and leaves for the executors.

A query is a string, ``WILDCARD``, or a ``Tree`` of queries.  Resolution gives a ``Node`` tree whose leaves are numbered
from the left; each leaf is one query term (or the wildcard) with all options settled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from lodestone.functions.analysis import Analyzer, query_terms, truthy


class SearchError(ValueError):
    """A request that cannot be answered."""


class _Wildcard:
    def __repr__(self) -> str:
        return "WILDCARD"


#: The query that all documents match; recognised by identity.
WILDCARD = _Wildcard()

#: Defaults of ranking and expansion.
BM25 = {"k": 1.2, "b": 0.7, "d": 0.5}
WEIGHTS = {"fuzzy": 0.45, "prefix": 0.375}
SEARCH_DEFAULTS: dict[str, Any] = {"combine_with": None, "prefix": False, "fuzzy": False, "max_fuzzy": 6, "boost": {}, "weights": WEIGHTS, "bm25": BM25}
OPTIONS = frozenset({"fields", "filter", "boost", "boost_term", "weights", "boost_document", "prefix", "fuzzy", "max_fuzzy", "combine_with", "tokenize", "process_term", "bm25"})
COMBINATORS = ("or", "and", "and_not")
#: Share of a term's length that ``fuzzy=True`` allows to differ.
FUZZY_SHARE = 0.2


@dataclass(frozen=True)
class Tree:
    """A combination of queries.  ``options`` hold for all of them unless they set their own."""

    queries: Sequence[Any]
    options: Mapping[str, Any] = field(default_factory=dict)


def tree(*queries: Any, **options: Any) -> Tree:
    return Tree(queries, options)


@dataclass(frozen=True)
class Leaf:
    """One query term with its settled options; ``term`` is None for the wildcard."""

    index: int
    term: str | None
    prefix: bool = False
    distance: int = 0
    boost: float = 1.0
    fields: tuple[tuple[str, float], ...] = ()
    weights: Mapping[str, float] = field(default_factory=dict)
    bm25: Mapping[str, float] = field(default_factory=dict)
    boost_document: Callable | None = None


@dataclass(frozen=True)
class Node:
    combine_with: str
    children: tuple[Node | Leaf, ...]


def combinator(name: str | None) -> str:
    found = "or" if name is None else str(name).lower()
    if found not in COMBINATORS:
        raise SearchError(f"invalid combination operator: {name}")
    return found


def checked(options: Mapping[str, Any]) -> dict[str, Any]:
    unknown = set(options) - OPTIONS
    if unknown:
        raise SearchError(f"unknown search options: {sorted(unknown)}")
    return dict(options)


def fuzzy_distance(term: str, fuzzy: Any, max_fuzzy: int) -> int:
    """Edits allowed: a share of the length, capped, or a whole number as it is."""
    if not truthy(fuzzy):
        return 0
    share = FUZZY_SHARE if fuzzy is True else float(fuzzy)
    if share < 1:
        return int(min(max_fuzzy, math.floor(len(term) * share + 0.5)))
    if share != int(share):
        raise SearchError("a fuzzy distance of 1 or more must be whole")
    return int(share)


class Resolver:
    """Turns a query and call options into a ``Node`` tree."""

    def __init__(self, fields: Sequence[str], analyzer: Analyzer, defaults: Mapping[str, Any]):
        self.fields, self.analyzer, self.defaults, self.count = tuple(fields), analyzer, dict(defaults), 0

    def resolve(self, query: Any, options: Mapping[str, Any]) -> Node:
        found = self._node(query, checked(options))
        return found if isinstance(found, Node) else Node("or", (found,))

    def _next(self) -> int:
        self.count += 1
        return self.count - 1

    def _node(self, query: Any, inherited: dict[str, Any]) -> Node | Leaf:
        if query is WILDCARD:
            settled = {**self.defaults, **inherited}
            return Leaf(self._next(), None, boost_document=settled.get("boost_document"))
        if isinstance(query, Mapping):
            rest = {k: v for k, v in query.items() if k != "queries"}
            query = Tree(query["queries"], rest)
        if isinstance(query, Tree):
            own = {**inherited, **checked(query.options)}
            # the constructor's combinator is for the terms of a string, not for trees
            return Node(combinator(own.get("combine_with")), tuple(self._node(q, own) for q in query.queries))
        if not isinstance(query, str):
            raise SearchError(f"not a query: {query!r}")
        settled = {**self.defaults, **inherited}
        terms = query_terms(query, settled.get("tokenize") or self.analyzer.tokenize_text, settled.get("process_term") or self.analyzer.process_text)
        return Node(combinator(settled.get("combine_with")), tuple(self._leaf(t, i, terms, settled) for i, t in enumerate(terms)))

    def _leaf(self, term: str, i: int, terms: list[str], options: dict[str, Any]) -> Leaf:
        of = lambda x: x(term, i, terms) if callable(x) else x
        boost = options.get("boost") or {}
        names = options.get("fields") or self.fields
        unknown = [n for n in names if n not in self.fields]
        bm25 = options.get("bm25") or BM25
        if set(bm25) != set(BM25):
            raise SearchError("bm25 needs k, b and d")
        fields = tuple((n, float(boost[n]) if truthy(boost.get(n)) else 1.0) for n in names if n not in unknown)
        weights = {**WEIGHTS, **(options.get("weights") or {})}
        boost_term = options.get("boost_term")
        max_fuzzy = SEARCH_DEFAULTS["max_fuzzy"] if options.get("max_fuzzy") is None else options["max_fuzzy"]  # 0 allows none
        return Leaf(self._next(), term, of(options.get("prefix")) is True or (callable(options.get("prefix")) and truthy(of(options["prefix"]))), fuzzy_distance(term, of(options.get("fuzzy")), max_fuzzy), float(of(boost_term)) if callable(boost_term) else 1.0, fields, {k: float(v) for k, v in weights.items()}, {k: float(v) for k, v in bm25.items()}, options.get("boost_document"))


def leaves(node: Node | Leaf) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for c in node.children for x in leaves(c)]
