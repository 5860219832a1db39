"""Byte-level BPE by tree reduction: halves are encoded by themselves and joined at their boundary.

A text is cut twice. First a pattern splits it into matches, then the ranks merge the
bytes of each match. Both are *monoids*: the code of a whole is the code of its two
halves, but for a window around the cut.

* **Matches.** Reading from a match's start, the matches that follow depend only on the
  text from there on. A match that ends three characters before the cut or earlier saw
  nothing beyond the cut (the pattern looks at most three characters past a match's start
  or one past its end), so it stays. From the first one that may change, the text is split
  again, until a match ends where the right half has a start; from there the right half's
  matches stand.
* **Tokens.** Tokens t1 … tn are the code of their bytes exactly if each pair (ti, ti+1)
  is the code of its own bytes: a merge across a boundary would be the first such merge,
  and until then both tokens have grown as they grow alone. So a join encodes the last
  and first tokens around the cut again, and doubles this window until both of its ends
  form such stable pairs with the tokens outside.

Decoding joins the bytes of halves up the same tree.

Texts are split over tasks by Spark; a text lies in one task, as its digest is a digest of
the whole. Null texts count as empty; empty texts have no ids. Rows with equal or null
ids are answered one by one. No other column is read.
"""

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from trajlake.llm.common import ids_and_texts

LEAF_CHARS = 16_384  # a text this short is split into matches in one go
LEAF_BYTES = 24  # a match this short is merged in one go
LOOK = 3  # characters that the pattern looks past a match's start
NEVER = 1 << 62  # the rank of a pair that no rank joins
KEEP = 600_000  # matches whose ids a worker remembers; beyond that it starts anew
KEEP_BYTES = 128  # longer matches are not remembered


class TreeBpe:
    """Encoder and decoder for a rank file and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.stable = lru_cache(1 << 16)(self._stable)
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "TreeBpe":
        import base64

        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines)
            return cls({base64.b64decode(p[0]): int(p[1]) for p in pairs if p}, pattern)

    # Tokens of one match.

    def merge(self, raw: bytes) -> list[int]:
        """The lowest-ranked adjacent pair is merged, the leftmost first, until none has a rank."""
        if len(raw) > 4 * LEAF_BYTES:
            return self._merge_long(raw)
        rank = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i : i + 2], NEVER) for i in range(len(raw) - 1)]
        while pairs and (low := min(pairs)) < NEVER:
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same rule with a heap of pairs, for long windows."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
        before = list(range(-1, n - 1))

        def rank_at(i: int) -> int | None:
            j = end[i]
            return ranks.get(raw[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank_at(k)) is not None:
                    heappush(heap, (r, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def _stable(self, left: int, right: int) -> bool:
        return self.merge(self.tokens[left] + self.tokens[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The code of the bytes of two codes."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            reach = min(reach, max(len(left), len(right)))
            outer, inner = left[:-reach], left[-reach:]
            near, far = right[:reach], right[reach:]
            window = self.merge(b"".join([self.tokens[t] for t in inner + near]))
            if (not outer or self.stable(outer[-1], window[0])) and (not far or self.stable(window[-1], far[0])):
                return outer + window + far
            reach *= 2

    def _tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF_BYTES:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join(self._tree(raw[:half]), self._tree(raw[half:]))

    def match_ids(self, raw: bytes) -> list[int]:
        rank = self.ranks.get(raw)
        return self._tree(raw) if rank is None else [rank]

    # Matches of a text.

    def matches(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.split(text)
        half = len(text) // 2
        return self.join_matches(self.matches(text[:half]), self.matches(text[half:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of the text of two lists of matches."""
        tail: list[str] = []  # the left half's matches that may change
        length = 0
        while left and length < LOOK:
            tail.append(left.pop())
            length += len(tail[-1])
        tail.reverse()
        reach = 4
        while True:
            near = right[:reach]
            last = reach >= len(right)
            window = self.split("".join(tail + near))
            starts = {length: 0}
            at = length
            for i, match in enumerate(near):
                at += len(match)
                starts[at] = i + 1
            limit = at if last else at - LOOK
            at = 0
            for i, match in enumerate(window):
                at += len(match)
                if at > limit:
                    break
                if at in starts:
                    return left + window[: i + 1] + right[starts[at] :]
            if last:
                return left + window
            reach *= 2

    # Whole texts.

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known = self.known
        found = self.matches(text)
        try:
            return b"".join([known[m] for m in found])
        except KeyError:
            pass
        import numpy as np

        own: dict[str, bytes] = {}
        for match in found:
            if match not in known and match not in own:
                raw = match.encode()
                ids = np.array(self.match_ids(raw), "<u4").tobytes()
                (known if len(raw) <= KEEP_BYTES else own)[match] = ids
        out = b"".join([known[m] if m in known else own[m] for m in found]) if own else b"".join([known[m] for m in found])
        if len(known) > KEEP:
            known.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return self._bytes(np.frombuffer(ids, "<u4").tolist())

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_CHARS:
            tokens = self.tokens
            return b"".join([tokens[i] for i in ids])
        half = len(ids) // 2
        return self._bytes(ids[:half]) + self._bytes(ids[half:])


_CODERS: dict[tuple[str, str], TreeBpe] = {}


def coder(path: str, pattern: str) -> TreeBpe:
    """The worker's coder for a rank file."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = TreeBpe.from_file(path, pattern)
    return _CODERS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, text_bytes)``: little-endian unsigned 32-bit ids and the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            ids = [own.encode(text) for text in batch["text"].to_pylist()]
            back = [own.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "text_bytes"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, ids binary, text_bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every text, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch["text"]:
                ids = own.encode(text.as_py())
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
