"""Byte-level BPE encoding and decoding by tree reduction.

A text's halves are encoded recursively, down to leaves of LEAF_CHARS characters, and neighbours are joined by re-encoding
a window about the cut.  The window grows on both sides until it meets a place where a piece of the tokenizer's pattern
starts whatever surrounds it (a single space between two other characters): tokens beyond depend on nothing inside, so
they are final.  Where a text has no such places, its pieces are reduced by themselves: the halves of a piece's bytes are
encoded recursively and joined over a window of tokens that grows until its outermost tokens are compatible with their
outer neighbours; a token sequence is the encoding of its bytes exactly if each two neighbours are the encoding of their
joint bytes, so no token outside can change.

Decoding looks up the bytes of each id and concatenates them up the tree.

Defined results: a null text is the empty text and has no ids; special tokens do not exist, their strings are ordinary
text; unpaired surrogates cannot occur in Spark strings; a piece of any length is encoded whole; repeated rows are encoded
alike; an empty table gives an empty result; other input columns are carried along by ``encode`` unless their names clash
with the new ones, which is refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import bounded_batches
from lodestone.llm.words import chunks

#: Patterns (fixed values) of which each match that holds a space and another character starts with that one space.
SPACED = frozenset([r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""])
#: Characters of a text that are not halved further.
LEAF_CHARS = 256
#: Ids of a leaf in decoding.
LEAF_IDS = 256
#: Bytes of a piece below which a merge loop is used without halving.
LEAF = 4
#: No merge; above any rank.
NEVER = 1 << 62
#: Remembered pieces and halves in each worker.
REMEMBER = 300_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file's contents."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Remembered(dict):
    """A function's values for the keys met lately: two generations of at most ``bound`` keys each."""

    def __init__(self, function, bound: int):
        super().__init__()
        self.function, self.bound, self.old = function, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TreeBpe:
    """Encoder and decoder for one vocabulary; ``pattern`` cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = REMEMBER):
        self.ranks, self.remember = ranks, remember
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Remembered(lambda piece: np.array(self.encode_bytes(piece.encode("utf-8")), "<u4").tobytes(), remember)
        self.spaced = pattern in SPACED
        # Leaves, and windows, are short texts: the tokenizer library's merge loop encodes them.
        self.leaf = tiktoken.Encoding("leaves", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The encoding by repeated merging of the adjacent pair of least rank, leftmost first."""
        ranks = self.ranks
        if len(data) > 48:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        get = ranks.get
        costs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while costs and (low := min(costs)) != NEVER:
            at = costs.index(low)
            whole = parts[at] + parts[at + 1]
            parts[at : at + 2] = [whole]
            del costs[at]
            if at:
                costs[at - 1] = get(parts[at - 1] + whole, NEVER)
            if at < len(costs):
                costs[at] = get(whole + parts[at + 1], NEVER)
        return tuple([ranks[p] for p in parts])

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """``merge`` with a heap of adjacent pairs over a linked list: n log n."""
        get, n = self.ranks.get, len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of the two has been merged meanwhile
            end[i], after[i] = stop, after[j]
            end[j] = 0
            if after[i] < n:
                before[after[i]] = i
                if (r := get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return tuple([self.ranks[data[i : end[i]]] for i in range(n) if end[i]])

    def compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= 4 * self.remember:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joint bytes of two encodings."""
        if not left or not right:
            return left + right
        if self.compatible(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.encode_window(left[len(left) - i :] + right[:j])
            good_left = i == len(left) or self.compatible(left[len(left) - i - 1], window[0])
            good_right = j == len(right) or self.compatible(window[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - i] + window + right[j:]
            if not good_left:
                i = min(len(left), 2 * i)
            if not good_right:
                j = min(len(right), 2 * j)

    def encode_window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        data = b"".join(map(self.bytes_of.__getitem__, tokens))
        got = self.known.get(data)
        if got is None:
            got = self.merge(data)
            if len(data) <= 64:
                self.known[data] = got
        return got

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """One piece.  A piece that is a token is that token, as in the merge tables' own reading."""
        rank = self.ranks.get(data)
        if rank is not None:
            return (rank,)
        return self._tree(data)

    def _tree(self, data: bytes) -> tuple[int, ...]:
        got = self.known.get(data)
        if got is None:
            if len(data) <= LEAF:
                got = self.merge(data)
            else:
                half = len(data) // 2
                got = self.join(self._tree(data[:half]), self._tree(data[half:]))
            if len(data) <= 64:
                if len(self.known) >= self.remember:
                    self.known.clear()
                self.known[data] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        return np.array(self.tree(text, 0, len(text)), "<u4") if text else np.empty(0, "<u4")

    def tree(self, text: str, low: int, high: int) -> list[int]:
        """Tokens of ``text[low:high]`` by itself: halves, joined over a window about the cut."""
        if high - low <= LEAF_CHARS:
            return self.leaf(text[low:high])
        cut = (low + high) // 2
        left, right = self.tree(text, low, cut), self.tree(text, cut, high)
        a, b = self.before(text, low, cut), self.after(text, cut, high)
        if a == low and b == high and high - low > 4 * LEAF_CHARS:
            return self.encode_pieces(text[low:high])  # no certain start of a piece: join within pieces
        return self.outside(left, len(text[a:cut].encode("utf-8")), -1) + self.leaf(text[a:b]) + self.outside(right, len(text[cut:b].encode("utf-8")), 1)

    def before(self, text: str, low: int, cut: int) -> int:
        """The last place in ``text[low:cut]`` at which a piece starts whatever surrounds it; ``low`` if there is none."""
        at = cut - 1
        while self.spaced and (at := text.rfind(" ", low + 1, at)) > low:
            if not (text[at - 1].isspace() or text[at + 1].isspace()):
                return at
        return low

    def after(self, text: str, cut: int, high: int) -> int:
        """The first such place in ``text[cut:high]``; ``high`` if there is none."""
        at = cut
        while self.spaced and 0 <= (at := text.find(" ", at + 1, high - 1)):
            if not (text[at - 1].isspace() or text[at + 1].isspace()):
                return at
        return high

    def outside(self, tokens: list[int], drop: int, side: int) -> list[int]:
        """``tokens`` without those of the ``drop`` bytes at their end (side -1) or start."""
        n = 0
        while drop > 0:
            drop -= len(self.bytes_of[tokens[-1 - n if side < 0 else n]])
            n += 1
        if drop:
            raise AssertionError("a token crosses a certain start of a piece")
        return (tokens[: len(tokens) - n] if n else tokens) if side < 0 else tokens[n:]

    def encode_pieces(self, text: str) -> list[int]:
        """Piece by piece, each by the tree over its bytes."""
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.find(text))), "<u4").tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes: a leaf's are looked up, and the halves of longer sequences are concatenated up the tree."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", output: str = "digest") -> DataFrame:
    """``docs``' columns (without the text for ``digest``) and, by ``output``:

    ``digest``: n_tokens, ids_sha256, decoded_sha256; ``ids``: n_tokens, ids (array<int>), decoded (binary).
    ``ranks`` is the content of a rank file, under a megabyte; it goes to the workers with the task.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if output == "digest" else ["n_tokens", "ids", "decoded"]
    carried = [c for c in docs.columns if c != text]
    clash = {c.lower() for c in carried} & {*new, "bpe_text"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the operator's own")
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kinds = dict.fromkeys(new, T.StringType()) | {"n_tokens": T.LongType()} | ({} if output == "digest" else {"ids": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType()})
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(c, kinds[c]) for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(read_ranks(sent.value), pattern)
        for b in chunks(batches):
            n, first, second = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                ids = bpe.encode(t)
                whole = bpe.decode(ids)
                n.append(len(ids))
                first.append(hashlib.sha256(ids.tobytes()).hexdigest() if output == "digest" else ids.astype(np.int32))
                second.append(hashlib.sha256(whole).hexdigest() if output == "digest" else whole)
            made = [pa.array(n, pa.int64()), pa.array(first, pa.string() if output == "digest" else pa.list_(pa.int32())), pa.array(second, pa.string() if output == "digest" else pa.binary())]
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + made, names=[*carried, *new])

    return docs.select(*[docs[c] for c in carried], docs[text].alias("bpe_text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """``tokens``' columns and ``decoded`` (binary) from an array<int> column; null ids decode to nothing."""
    if "decoded" in {c.lower() for c in tokens.columns}:
        raise ValueError("column decoded clashes with the operator's own")
    sent = tokens.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])
    names = tokens.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(read_ranks(sent.value), pattern)
        for b in batches:
            made = [bpe.decode(np.array(x or [], np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*names, "decoded"])

    return tokens.mapInArrow(run, schema)
