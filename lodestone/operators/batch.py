"""Best documents of a batch of queries, window by window of documents.

A batch's frequent terms bring almost every document to almost every query, so pairs of queries and documents are far more than
postings.  They are not made into rows: the weights of a window's documents lie in one group, where each query adds them up and
keeps its ``k`` best documents.  What is exchanged is the weights of the terms that are asked for, and ``k`` rows for each query and
window.  Where bounds of blocks say which blocks of documents a query needs, each window gets those with its weights, and a query
keeps to them; the bounds themselves are added up the same way, blocks standing for documents.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get these functions with the task, so they need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents of a window, as a power of two.
WINDOW_BITS = 12
#: Terms of all queries together up to which they are sent to the tasks.
BATCH_TERMS = 100_000

Queries = list[tuple[int, list[tuple[int, int]]]]


def sent_terms(asked: DataFrame) -> list | None:
    """The rows of ``asked(query_id, asked, times)``; None if they are too many to be sent."""
    pairs = asked.select("query_id", "asked", "times").limit(BATCH_TERMS + 1).collect()
    return pairs if len(pairs) <= BATCH_TERMS else None


def best_in_windows(weights: DataFrame, pairs: list, k: int | None, every: bool, bits: int | None = None, blocks: DataFrame | None = None, block_bits: int = 0) -> DataFrame:
    """(query_id, doc_ord, score): at least the ``k`` best documents (None: all) of each query of ``pairs(query_id, asked, times)``, by
    ``weights(asked, doc_ord, w)``, which may have several rows for a pair; only documents with all terms if ``every``.

    ``bits``: documents of a window, as a power of two.  ``blocks(query_id, block)``: each query's documents are those whose number,
    shifted by ``block_bits``, is one of its blocks.
    """
    bits = WINDOW_BITS if bits is None else bits
    numbers = {word: i for i, word in enumerate(sorted({r["asked"] for r in pairs}))}
    queries: dict[int, list[tuple[int, int]]] = {}
    for r in pairs:
        queries.setdefault(r["query_id"], []).append((numbers[r["asked"]], r["times"]))
    sent = sorted(queries.items())
    words = weights.sparkSession.createDataFrame(list(numbers.items()), "asked string, word int")
    rows = weights.join(F.broadcast(words), "asked").select("word", "doc_ord", "w", F.shiftright("doc_ord", bits).alias("window"))
    shown = "query_id long, doc_ord long, score double"
    if blocks is None:
        return rows.groupBy("window").applyInArrow(lambda window: _best(window, sent, k, every, bits), shown)
    wanted = blocks.select("query_id", "block", F.shiftright("block", bits - block_bits).alias("window"))

    def run(window: pa.Table, wanted: pa.Table) -> pa.Table:
        if not window.num_rows or not wanted.num_rows:
            return _none()
        query, block = wanted["query_id"].to_numpy(), wanted["block"].to_numpy()
        order = np.argsort(query, kind="stable")
        query, block = query[order], block[order]
        cuts = [0, *(np.flatnonzero(np.diff(query)) + 1).tolist(), len(query)]
        held = {int(query[low]): block[low:high] for low, high in zip(cuts[:-1], cuts[1:], strict=True)}
        return _best(window, [x for x in sent if x[0] in held], k, every, bits, held, block_bits)

    return rows.groupBy("window").cogroup(wanted.groupBy("window")).applyInArrow(run, shown)


def _none() -> pa.Table:
    return pa.table({"query_id": pa.array([], pa.int64()), "doc_ord": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _best(window: pa.Table, queries: Queries, k: int | None, every: bool, bits: int, blocks: dict[int, np.ndarray] | None = None, block_bits: int = 0) -> pa.Table:
    """The ``k`` best documents of a window for each query, in its ``blocks``; equal scores to nine places by the document."""
    size = 1 << bits
    first = window["window"][0].as_py() << bits
    word, place, w = window["word"].to_numpy(), window["doc_ord"].to_numpy() - first, window["w"].to_numpy()
    order = np.argsort(word, kind="stable")
    word, place, w = word[order], place[order], w[order]
    cuts = [0, *(np.flatnonzero(np.diff(word)) + 1).tolist(), len(word)]
    held = {}
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        places = np.flatnonzero(np.bincount(place[low:high], minlength=size))
        held[int(word[low])] = places, np.bincount(place[low:high], w[low:high], size)[places]
    ids, docs, scores = [], [], []
    for query, terms in queries:
        score, met = np.zeros(size), np.zeros(size, np.int64)
        for term, times in terms:
            if term in held:
                places, sums = held[term]
                score[places] += sums * times
                met[places] += 1
        if blocks is not None:
            inside = np.zeros(size >> block_bits, bool)
            inside[blocks[query] - (first >> block_bits)] = True
            met[~np.repeat(inside, 1 << block_bits)] = 0
        found = np.flatnonzero(met == len(terms) if every else met)
        score = score[found] * met[found]
        if k is not None and len(found) > k:
            near = np.round(score, 9)
            some = np.flatnonzero(near >= np.partition(near, -k)[-k])
            some = some[np.lexsort((found[some], -near[some]))[:k]]
            found, score = found[some], score[some]
        ids.append(np.full(len(found), query, np.int64))
        docs.append(found + first)
        scores.append(score)
    if not ids:
        return _none()
    return pa.table({"query_id": np.concatenate(ids), "doc_ord": np.concatenate(docs).astype(np.int64), "score": np.concatenate(scores)})
