"""Text to terms: Column builders for documents and their driver-side counterparts for queries."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers get these functions with the task, so they need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: line breaks, separators and punctuation; tabs and symbols are parts of terms.
SEPARATORS = r"[\n\r\p{Z}\p{P}]+"
_split = regex.compile(SEPARATORS).split
#: Bytes of text, or terms, that are counted at a time.
STRETCH = 1 << 20
#: The distinct terms of a document's fields and their occurrences.
ENTRIES = "array<struct<term: string, field_id: int, tf: bigint>>"


def tokenize_column(value: Column, field: str | None = None) -> Column:
    """Pieces between separators, empty ones at either end included."""
    return F.split(value, SEPARATORS, -1)


def tokenize_text(text: str) -> list[str]:
    return _split(text)


def process_column(term: Column, field: str | None = None) -> Column:
    return F.lower(term)


def process_text(term: str) -> str:
    return term.lower()


def truthy(value: object) -> bool:
    """Null, false, zero, NaN and the empty string are not."""
    return not (value is None or value is False or value == "" or value == 0 or value != value)


@dataclass(frozen=True)
class Analyzer:
    """How documents (Columns) and queries (Python values) become terms.

    ``process_column`` may give a string, null to drop the term, or an array of strings (``expands=True``);
    ``process_text`` likewise a string, a falsy value or a list.
    """

    tokenize_column: Callable[[Column, str], Column] = tokenize_column
    process_column: Callable[[Column, str], Column] = process_column
    tokenize_text: Callable[[str], Iterable[str]] = tokenize_text
    process_text: Callable[[str], object] = process_text
    expands: bool = False

    @property
    def plain(self) -> bool:
        """Whether documents are analysed by the default functions."""
        return self.tokenize_column is tokenize_column and self.process_column is process_column and not self.expands

    def terms_column(self, tokens: Column, field: str) -> Column:
        """Terms of a token array: processed, expanded, without nulls and empty strings; repeats stay."""
        out = F.transform(tokens, lambda t: self.process_column(t, field))
        out = F.flatten(F.filter(out, lambda x: x.isNotNull())) if self.expands else out
        return F.filter(out, lambda t: t.isNotNull() & (t != ""))


class PythonAnalyzer(Analyzer):
    """An analyzer of plain Python functions, for what no Column expresses; documents go to them in Arrow batches.

    ``tokenize(text) -> tokens`` and ``process(token) -> term, falsy value or list of terms`` serve documents and queries
    alike.  Texts are cut in one batch function and tokens processed in another, so a field's lengths are counted over raw
    tokens, as with Columns.  ``tokenize`` alone, or ``process`` alone, leaves the other to Columns.
    """

    def __init__(self, tokenize: Callable[[str], Iterable[str]] | None = None, process: Callable[[str], object] | None = None):
        cut = _batched(tokenize) if tokenize else None
        object.__setattr__(self, "_terms_of", _batched(lambda tokens: _terms(tokens, process)) if process else None)
        super().__init__(
            tokenize_column=(lambda value, field: cut(value)) if cut else tokenize_column,
            tokenize_text=tokenize or tokenize_text,
            process_text=process or process_text,
        )

    def terms_column(self, tokens: Column, field: str) -> Column:
        return self._terms_of(tokens) if self._terms_of else super().terms_column(tokens, field)


def _terms(tokens: Iterable[str], process: Callable[[str], object]) -> list[str]:
    out: list[str] = []
    for token in tokens:
        made = process(token)
        out += [t for t in (made if isinstance(made, (list, tuple)) else [made]) if truthy(t)]
    return out


def _batched(function: Callable) -> Callable[[Column], Column]:
    """A Column function that applies ``function`` to the values of Arrow batches; null for null, arrays of strings else."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else list(function(v)))

    return F.pandas_udf(run, T.ArrayType(T.StringType()))


def lines_column(text: Column) -> Column:
    """The default tokens of a text, as lines: they hold no line breaks."""
    return F.regexp_replace(text, SEPARATORS, "\n")


def line_counts(lines: Column, field_id: int) -> Column:
    """struct<len, entries> of tokens as lines under the default processing: distinct tokens, and distinct terms with their
    occurrences; null for null.  Lines are cut and counted by Arrow batches."""
    count = lambda raw, lowered: _line_counts(raw, lowered, field_id)
    return F.arrow_udf(count, f"struct<len: bigint, entries: {ENTRIES}>")(lines, process_column(lines))


def term_counts(terms: Column, field_id: int) -> Column:
    """The entries of arrays of terms: the distinct ones with their occurrences; null for null."""
    count = lambda lists: _term_counts(lists, field_id)
    return F.arrow_udf(count, ENTRIES)(terms)


def _line_counts(lines: pa.Array, lowered: pa.Array, field_id: int) -> pa.Array:
    parts = []
    for at, n in _stretches(pc.binary_length(lines)):
        tokens, terms = (pc.split_pattern(x.slice(at, n), "\n") for x in (lines, lowered))
        rows, coded = pc.list_parent_indices(tokens).to_numpy(), pc.list_flatten(tokens).dictionary_encode()
        codes = coded.indices.to_numpy()
        # a line is lower-cased by itself, so all lines of a token give the term that its first one gives
        first = np.empty(len(coded.dictionary), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        of = pc.list_flatten(terms).take(pa.array(first)).dictionary_encode()
        lens = pa.array(np.bincount(_pairs(rows, codes, len(first))[0], minlength=n), mask=tokens.is_null().to_numpy(zero_copy_only=False))
        entries = _entries(tokens, rows, of.indices.to_numpy()[codes], of.dictionary, field_id)
        parts.append(pa.StructArray.from_arrays([lens, entries], ["len", "entries"]))
    return pa.concat_arrays(parts)


def _term_counts(lists: pa.Array, field_id: int) -> pa.Array:
    parts = []
    for at, n in _stretches(pc.list_value_length(lists)):
        terms = lists.slice(at, n)
        coded = pc.list_flatten(terms).dictionary_encode()
        parts.append(_entries(terms, pc.list_parent_indices(terms).to_numpy(), coded.indices.to_numpy(), coded.dictionary, field_id))
    return pa.concat_arrays(parts)


def _stretches(sizes: pa.Array) -> list[tuple[int, int]]:
    """(first row, rows) of stretches of about ``STRETCH`` in sum, a row at least; an empty one of no rows."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    out, at = [], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, "right")))
        out.append((at, to - at))
        at = to
    return out or [(0, 0)]


def _pairs(rows: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a row and a number below ``n``, in order, and how often each stands there."""
    pairs, times = np.unique(rows * max(1, n) + codes, return_counts=True)
    return *np.divmod(pairs, max(1, n)), times


def _entries(lists: pa.Array, rows: np.ndarray, codes: np.ndarray, terms: pa.Array, field_id: int) -> pa.Array:
    """For each of ``lists`` the pairs of its row and a term's number with how often they stand there, without the empty term."""
    row, code, times = _pairs(rows, codes, len(terms))
    left = code != pc.index(terms, "").as_py()
    row, code, times = row[left], code[left], times[left]
    ends = np.cumsum(np.bincount(row, minlength=len(lists)))
    fields = pa.array(np.full(len(code), field_id, np.int32))
    entries = pa.StructArray.from_arrays([terms.take(pa.array(code)), fields, pa.array(times)], ["term", "field_id", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), entries, mask=lists.is_null())


def query_terms(text: str, tokenize: Callable, process: Callable) -> list[str]:
    """Terms of a query string in order; repeats stay, falsy ones go."""
    return _terms(tokenize(text), process)
