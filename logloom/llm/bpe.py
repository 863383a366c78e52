"""BPE encoding and decoding with a byte-level vocabulary file of the `tokenizers` format.

Each pre-token's symbols form a doubly linked list; a priority queue holds the adjacent pairs by
(merge rank, position). The lowest is taken; it is stale, and skipped, if either symbol has since been
merged away or changed. The merged symbol's two new pairs are pushed. Decoding concatenates the
vocabulary strings of the ids and maps their characters back to bytes.

Work is per row in Arrow batches, without a shuffle. Merges of a pre-token are kept in a bounded
per-task memo, since words repeat; the memo is emptied when full, which never changes a result.

Defined results: null and empty texts have no ids. One row per input row; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, values

#: Fixed value: how byte-level BPE splits text before merging.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 600_000
LONG = 64  # longer pre-tokens aren't kept in the memo


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """Ids of pre-tokens; emptied when full."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.merge(word)
        if len(word) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        byte_of = {ord(c): b for b, c in enumerate(chars)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.first = [vocab[c] for c in chars]
        self.width = len(vocab).bit_length() + 1
        # a rank is kept as rank * 2^32, so that adding a position makes a queue entry
        self.ranks = {vocab[a] << self.width | vocab[b]: rank << 32 for rank, (a, b) in enumerate(pairs)}
        self.made = {rank << 32: vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.start = [[self.ranks.get(a << self.width | b) for b in self.first] for a in self.first]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pretokens = regex.compile(PRETOKEN).findall
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[ord(c)] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i) for i in range(size)]
        self.memo = Memo(self.merge)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token. A queue entry is rank * 2^32 + position; a rank stands for one pair."""
        raw = word.encode()
        first, start = self.first, self.start
        sym = [first[b] for b in raw]
        n = len(sym)
        queue = [start[a][b] + i for i, (a, b) in enumerate(zip(raw, raw[1:], strict=False)) if start[a][b] is not None]
        if not queue:
            return tuple(sym)
        heapq.heapify(queue)
        width, rank_of, made, pop, push = self.width, self.ranks.get, self.made, heapq.heappop, heapq.heappush
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = nxt[i]
            a = sym[i]
            if j >= n or a < 0 or rank_of(a << width | sym[j]) != entry - i:
                continue  # stale: one of the two has been merged since
            sym[i] = new = made[entry - i]
            sym[j] = -1
            nxt[i] = after = nxt[j]
            if after < n:
                prev[after] = i
                rank = rank_of(new << width | sym[after])
                if rank is not None:
                    push(queue, rank + i)
            before = prev[i]
            if before >= 0:
                rank = rank_of(sym[before] << width | new)
                if rank is not None:
                    push(queue, rank + before)
        return tuple([s for s in sym if s >= 0])

    def encode(self, text: str) -> list[int]:
        parts = self.split_added.split(text) if self.split_added and any(t in text for t in self.added) else [text]
        out: list[int] = []
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(itertools.chain.from_iterable(map(self.memo.__getitem__, self.pretokens(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def loaded(path: str) -> Bpe:
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, ids (array<int>): the general encoder."""

    def encode(batch, _):
        bpe = loaded(vocabulary)
        return {"doc_id": values(batch, "_id"), "ids": [bpe.encode(t or "") for t in values(batch, "_text").to_pylist()]}

    return map_columns(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), encode, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc id, text: the general decoder."""

    def decode(batch, _):
        bpe = loaded(vocabulary)
        return {"doc_id": values(batch, "_id"), "text": [bpe.decode(i or []) for i in values(batch, "_ids").to_pylist()]}

    return map_columns(encoded.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).alias("_ids")), decode, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_tokens, and digests of the ids and of the text decoded from them, in one pass."""
    path = vocabulary or default_vocabulary()

    def run(batch, _):
        bpe = loaded(path)
        n, of_ids, of_text = [], [], []
        for text in values(batch, "_text").to_pylist():
            ids = bpe.encode(text or "")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return {"doc_id": values(batch, "_id"), "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text}

    return map_columns(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
