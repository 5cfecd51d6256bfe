"""Token counts by a unigram model over pre-tokens that share a trie.

A text's words (runs of other characters than white space, as str.split() cuts them), each with a leading
mark, are its pre-tokens. A pre-token's tokens are the pieces of its best segmentation, the
one with the highest sum of piece scores. Distinct pre-tokens make a trie: a node's forward
score, the best of all segmentations of its prefix, and its count of pieces are computed
once from the nodes above it and shared by all pre-tokens below; terminal nodes store their
counts. All new nodes of one depth are scored at once. Documents then add up the counts of
their pre-tokens.

The vocabulary is that of a public tokenizer. Its own scores are ranks of merges, no
logarithms of probabilities, so a piece's probability is taken from its rank by Zipf's law.
Characters that are no piece cost a token a byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dirgauge.llm.common import read
from dirgauge.llm.textkeys import PIECE_BYTES, mix

MARK = "▁"
#: Pre-tokens whose counts a worker keeps.
CACHE = 1_000_000
#: Pre-tokens of one trie, and characters from which on a pre-token is long.
TRIE_WORDS, DEPTH = 16_384, 64
_FACTOR = 0xD6E8FEB86659FD93
_POWERS, _INVERSE = (np.array([pow(f, k, 1 << 64) for k in range(DEPTH + 1)], dtype=np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))


class Vocabulary:
    """Scores of pieces, from a sentencepiece model's list of pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        total = math.log(sum(1 / (rank + 1) for rank in range(len(names) + 1)))
        self.scores = {name: -math.log(rank + 1) - total for rank, name in enumerate(names)}
        self.byte_score = -math.log(len(names) + 1) - total
        self.longest = max(map(len, names))
        self.table = PieceTable(self.scores)


class PieceTable:
    """Scores by the hash of a piece: a slot of one table, or of a second one where two pieces meet."""

    BITS = 20

    def __init__(self, scores: dict[str, float]) -> None:
        names = list(scores)
        flat, lengths = _points(names)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(flat.astype(np.uint64) + np.uint64(1)) * _POWERS[_places(lengths)], dtype=np.uint64)))
        ends = np.cumsum(lengths)
        hashes, values = mix(sums[ends] - sums[ends - lengths]), np.array([scores[n] for n in names])
        self.tables = []
        for shift in (64 - self.BITS, 64 - 2 * self.BITS, 0):
            slots = self._slots(hashes, shift)
            _, first, held = np.unique(slots, return_index=True, return_counts=True)
            keys, values_at, more = np.zeros(1 << self.BITS, dtype=np.uint64), np.full(1 << self.BITS, -np.inf), np.zeros(1 << self.BITS, dtype=bool)
            keys[slots[first]], values_at[slots[first]], more[slots[first]] = hashes[first], values[first], held > 1
            self.tables.append((shift, keys, values_at, more))
            rest = np.setdiff1d(np.arange(len(hashes)), first)
            hashes, values = hashes[rest], values[rest]
        if len(hashes):
            raise ValueError("Pieces can't be told apart by their hashes")

    def _slots(self, hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes >> np.uint64(shift)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the hashes that are a piece's."""
        at, places, scores = np.arange(len(hashes)), [], []
        for shift, keys, values, more in self.tables:
            slots = self._slots(hashes, shift)
            met = np.flatnonzero(keys[slots] == hashes)
            places.append(at[met])
            scores.append(values[slots[met]])
            rest = np.flatnonzero(more[slots])
            if not len(rest):
                break
            at, hashes = at[rest], hashes[rest]
        return np.concatenate(places), np.concatenate(scores)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, end to end, and how many each has."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return flat, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def _places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class TrieCounter:
    """Counts of tokens of pre-tokens; forward scores live on the trie of the pre-tokens that are being added."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.counts: dict[str, int] = {}

    def add(self, pre_tokens) -> None:
        """Score the trie of the given distinct pre-tokens; long ones are walked by themselves."""
        ordered = sorted(w for w in pre_tokens if len(w) < DEPTH)
        for k in range(0, len(ordered), TRIE_WORDS):
            part = ordered[k : k + TRIE_WORDS]
            self.counts.update(zip(part, self._levels(part).tolist(), strict=True))
        self._walk(sorted(w for w in pre_tokens if len(w) >= DEPTH))

    def _levels(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the words, which are sorted. Row k, depth d is a node if no row before has the same d characters."""
        flat, lengths = _points(words)
        n, depth = len(words), int(lengths.max()) + 1
        points = np.full((n, depth), 0xFFFFFFFF, dtype=np.uint32)
        points[:, 0] = ord(MARK)
        points[:, 1:][np.arange(depth - 1) < lengths[:, None]] = flat
        lengths = lengths + 1
        node = np.ones((n, depth), dtype=bool)
        np.logical_or.accumulate(points[1:] != points[:-1], axis=1, out=node[1:])
        # a row for each depth, so that what is read at once lies together
        points, node = np.ascontiguousarray(points.T), np.ascontiguousarray(node.T)
        sums = np.zeros((depth + 1, n), dtype=np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * _POWERS[:depth, None], axis=0, dtype=np.uint64, out=sums[1:])
        best, pieces = np.zeros((depth + 1, n)), np.zeros((depth + 1, n), dtype=np.int64)
        rows = np.arange(n)
        for end in range(1, depth + 1):
            new = node[end - 1] & (lengths >= end)
            at = np.flatnonzero(new)
            c = points[end - 1, at]
            n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            top, count = best[end - 1, at] + n_bytes * self.v.byte_score, pieces[end - 1, at] + n_bytes
            for begin in range(max(0, end - self.v.longest), end):
                hit, score = self.v.table.find(mix((sums[end, at] - sums[begin, at]) * _INVERSE[begin]))
                total, less = best[begin, at[hit]] + score, pieces[begin, at[hit]] + 1
                better = (total > top[hit]) | ((total == top[hit]) & (less < count[hit]))
                top[hit[better]], count[hit[better]] = total[better], less[better]
            best[end, at], pieces[end, at] = top, count
            owner = np.maximum.accumulate(np.where(new, rows, 0))
            best[end], pieces[end] = best[end, owner], pieces[end, owner]
        return pieces[lengths, rows]

    def _walk(self, ordered: list[str]) -> None:
        """As _levels(), one word after the other along the sorted words' common beginnings."""
        scores, longest, byte_score = self.v.scores, self.v.longest, self.v.byte_score
        best, pieces, last = [0.0], [0], ""
        for word in ordered:
            text = MARK + word
            shared, most = 0, min(len(text), len(last))
            while shared < most and text[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                n_bytes = len(text[end - 1].encode("utf-8", "replace"))
                top, n = best[end - 1] + n_bytes * byte_score, pieces[end - 1] + n_bytes
                for begin in range(max(0, end - longest), end):
                    s = scores.get(text[begin:end])
                    if s is not None:
                        total = best[begin] + s
                        if total > top or (total == top and pieces[begin] + 1 < n):
                            top, n = total, pieces[begin] + 1
                best.append(top)
                pieces.append(n)
            last = text
            self.counts[word] = pieces[-1]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.counts) > CACHE:
            self.counts.clear()
        split = [t.split() for t in texts]
        self.add(set().union(*split).difference(self.counts))
        of = self.counts.__getitem__
        return [(len(w), sum(map(of, w))) for w in split]


_counters: dict[str, TrieCounter] = {}


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, TrieCounter(Vocabulary(path)))
        for batch in batches:
            row = 0
            while row < batch.num_rows:
                texts, size, begin = [], 0, row
                while row < batch.num_rows and (size < PIECE_BYTES or row == begin):
                    texts.append(batch.column(1)[row].as_py() or "")
                    size += len(texts[-1])
                    row += 1
                found = counter.count(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, row - begin), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["doc", "n_pre_tokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_pre_tokens, n_tokens), one row per row of docs, in one pass without a shuffle.

    Null and empty texts have none. Ids may be null or repeat: each row has its own counts.
    Other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[doc].dataType.simpleString()
    out = docs.select(docs[doc].alias("doc"), docs[text].alias("text")).mapInArrow(_counted(vocabulary), f"doc {kind}, n_pre_tokens long, n_tokens long")
    return out.withColumnRenamed("doc", doc)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents by the pieces of piece_bpe_32k.model."""
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
