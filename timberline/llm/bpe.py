"""Byte-level BPE through a pair occurrence index, with the exact inverse.

Texts are cut into pre-tokens; the distinct new ones of a batch are laid out in one array, and every adjacent pair is
entered in an index from merge rank to all its positions. Active ranks are taken in ascending order; a merge applies
to all positions of its pair at once and enters the pairs it makes. A pair made by a merge always has a later rank
than that merge, so one ascending pass is the same as repeated search for the lowest rank in each pre-token.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import released, slices

#: The pre-token pattern of byte-level BPE (fixed by the vocabulary's format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept between batches, of up to `LONG` characters; the cache starts anew when full.
CACHE, LONG = 500_000, 64


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, ids and token bytes from a tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, symbols = spec["model"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or [] if t.get("content")}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.byte_id[b] = model["vocab"][c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([model["vocab"][a] for a, _ in pairs], np.int64)
        right = np.array([model["vocab"][b] for _, b in pairs], np.int64)
        self.merged = np.array([model["vocab"][a + b] for a, b in pairs], np.int64)
        self.size = size
        keys = left * size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.pattern = regex.compile(PRETOKEN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        length = np.array([len(p) for p in pieces], np.int64)
        token = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        piece = np.repeat(np.arange(len(pieces)), length)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(length)[length > 0] - 1
        after[last] = n
        before[(np.cumsum(length) - length)[length > 0]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, -1)  # the rank of the pair that starts at each position
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            at = at[after[at] < n]
            if not len(at):
                return
            rank = pair[at] = self.ranks(token[at], token[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, where in zip(rank[np.r_[0, cut]] if len(rank) else [], np.split(at, cut)):
                r = int(r)
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(where)

        enter(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
            at = at[pair[at] == rank]
            if len(found) > 1 and len(at) > 1:
                at = at[np.r_[True, at[1:] != at[:-1]]]
            if len(at) > 1:  # of overlapping places (a a a) the leftmost go first
                touching = after[at[:-1]] == at[1:]
                if touching.any():
                    begin = np.r_[True, ~touching]
                    first = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            token[at] = self.merged[rank]
            alive[gone] = False
            pair[gone] = pair[at] = -1
            follow = after[gone]
            after[at] = follow
            inner = follow < n
            before[follow[inner]] = at[inner]
            prior = before[at]
            again = np.sort(np.r_[at, prior[prior >= 0]])
            enter(again[np.r_[True, again[1:] != again[:-1]]])
        ids = token[alive].astype("<u4").tobytes()
        end = np.cumsum(np.bincount(piece[alive], minlength=len(pieces))) * 4
        return [ids[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist())]

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text, in order."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        cut = [self.pretokens(t) for t in texts]
        new: set[str] = set()
        for c in cut:
            new.update(c)
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
        fresh = [w for w in new if w not in self.cache]
        plain = [w for w in fresh if w not in self.special]
        self.cache.update(zip(plain, self.merge([w.encode() for w in plain])))
        self.cache.update((w, np.array([self.special[w]], "<u4").tobytes()) for w in fresh if w in self.special)
        get = self.cache.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for w in fresh:
            if len(w) > LONG:
                del self.cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    """The vocabulary of the query; TIMBERLINE_BPE names another file."""
    if "TIMBERLINE_BPE" in os.environ:
        return os.environ["TIMBERLINE_BPE"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns the kept columns, n_tokens, ids_sha256 and decoded_sha256, and with `ids` also the ids (array<long>) and
    the decoded text. A null text counts as empty: no ids. Rows are independent: ties and repeated rows give equal
    results, an empty table gives none.
    """
    at = path or default_path()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", *["ids array<bigint>, decoded string"] * ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(at)
        for whole in released(batches):
            for batch in slices(whole, text, 4 << 20):
                packed = vocab.encode_batch([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
                decoded = [vocab.decode(p) for p in packed]
                columns = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                columns += [
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                ]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in packed], pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
