"""Token counts of byte-level BPE by rank-synchronous array merging.

Distinct pre-tokens of a slice lie as one ragged array of symbol ids. Each step looks up the rank of every
adjacent pair, finds the lowest rank of each sequence and applies it in all sequences at once; sequences
without a pair of known rank leave the array with the number of symbols that they have left.

The rank tables have as many entries as the vocabulary, which bounds what is broadcast.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import slices

#: Fixed value: the pattern that cuts text before the merges of this kind of vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Counts of pre-tokens that a worker remembers; when full it starts anew, which changes no result.
REMEMBERED = 400_000

#: Symbols from which a pre-token is merged by itself.
LONG = 1_000

NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Sorted pair keys with their ranks and results, the ids of bytes, and the strings cut out before."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space and normalizer is supported")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with own matching rules are not supported")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], dtype=np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        order = np.argsort(key := (left << 32) | right)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made[order]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)

    def counts(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Symbols that each pre-token ends with. All lie in one array; memory follows its bytes."""
        lengths = np.fromiter(map(len, pre_tokens), dtype=np.int64, count=len(pre_tokens))
        if (lengths > LONG).any():
            out = np.zeros(lengths.size, dtype=np.int64)
            short = np.flatnonzero(lengths <= LONG)
            out[short] = self.counts([pre_tokens[i] for i in short]) if short.size else 0
            for i in np.flatnonzero(lengths > LONG):
                out[i] = self.long_count(self.of_byte[np.frombuffer(pre_tokens[i], dtype=np.uint8)])
            return out
        out = lengths.copy()
        flat = self.of_byte[np.frombuffer(b"".join(pre_tokens), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(pre_tokens)), lengths)
        while flat.size > 1:
            key = (flat[:-1] << 32) | flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            rank = np.full(flat.size, NO_RANK, dtype=np.int32)
            known = (self.keys[at] == key) & (seq[:-1] == seq[1:])
            rank[:-1][known] = self.ranks[at[known]]
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[first, flat.size])
            lowest = np.repeat(np.minimum.reduceat(rank, first), sizes)
            going = lowest != NO_RANK
            if not going.any():
                break
            hit = np.flatnonzero((rank == lowest) & going)
            if (near := np.diff(hit) == 1).any():  # a run of one symbol: pairs from its left, without overlap
                start = np.r_[True, ~near]
                hit = hit[(hit - hit[np.maximum.accumulate(np.where(start, np.arange(hit.size), 0))]) % 2 == 0]
            flat[hit] = self.made[at[hit]]
            out -= np.bincount(seq[hit], minlength=out.size)
            going[hit + 1] = False
            flat, seq = flat[going], seq[going]
        return out


    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of pairs; NO_RANK for those that aren't merged."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], NO_RANK), self.made[at]

    def long_count(self, symbol: np.ndarray) -> int:
        return self.long_symbols(symbol).size

    def long_symbols(self, symbol: np.ndarray) -> np.ndarray:
        """The symbols that survive of one long sequence: all places of its lowest rank merge at once, and only pairs next to a
        merge are looked up again. Places wait by rank, so that time grows with the merges and not with rounds times length."""
        n = symbol.size
        symbol, after, before = symbol.astype(np.int64), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, made = np.full(n + 1, NO_RANK, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        rank[: n - 1], made[: n - 1] = self.ranks_of(symbol[:-1], symbol[1:])
        order = np.argsort(rank[: n - 1], kind="stable")
        order = order[rank[order] != NO_RANK]
        edges = np.r_[0, np.flatnonzero(np.diff(rank[order])) + 1, order.size]
        waiting = {int(rank[order[a]]): [order[a:b]] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b > a}
        heap = sorted(waiting)
        alive = np.ones(n, dtype=bool)
        while heap:
            r = heapq.heappop(heap)
            held = waiting.pop(r)
            hit = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            hit = hit[rank[hit] == r]
            if not hit.size:
                continue
            if hit.size > 1 and (near := after[hit[:-1]] == hit[1:]).any():  # a run of one symbol: pairs from its left
                start = np.r_[True, ~near]
                place = np.arange(hit.size)
                hit = hit[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
            gone = after[hit]
            symbol[hit], rank[gone] = made[hit], NO_RANK
            alive[gone] = False
            after[hit] = after[gone]
            inner = after[hit] < n
            before[after[hit][inner]] = hit[inner]
            front = before[hit]
            again = np.unique(np.r_[hit, front[front >= 0]])
            last = after[again] >= n
            rank[again[last]] = NO_RANK
            again = again[~last]
            rank[again], made[again] = self.ranks_of(symbol[again], symbol[after[again]])
            again = again[rank[again] != NO_RANK]
            for i, k in zip(again.tolist(), rank[again].tolist(), strict=True):
                if k in waiting:
                    waiting[k].append([i])
                else:
                    waiting[k] = [np.array([i])]
                    heapq.heappush(heap, k)
        return symbol[alive]


class Counts(dict):
    """Pre-token to number of tokens, filled for many at once."""

    def __init__(self, merges: Merges):
        import regex

        super().__init__()
        self.merges, self.cut = merges, regex.compile(PRE_TOKEN).findall
        self.out = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many added tokens stand in the text as such."""
        if self.out is None or not self.out.search(text):
            return self.cut(text), 0
        parts = self.out.split(text)
        return [w for p in parts for w in self.cut(p)], len(parts) - 1

    def of(self, texts: list[str | None]) -> list[int]:
        cut = [self.pieces(t or "") for t in texts]
        if len(self) > REMEMBERED:
            self.clear()
        if new := list({*()}.union(*(words for words, _ in cut)).difference(self)):
            self.update(zip(new, self.merges.counts([w.encode() for w in new]).tolist(), strict=True))
        return [sum(map(self.__getitem__, words)) + n for words, n in cut]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """`keep` columns with n_bytes (UTF-8), n_tokens and over_limit (more tokens than `limit`) of each row.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and ids each give a row; an empty table gives
    none. Other columns are not read. Texts are never cut; strings of added tokens inside a text count as one
    token each, as the library does by default. No shuffle: each input split is counted where it is read.
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges(vocabulary))
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(merges.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column(part.num_columns - 1)
                n = pa.array(counts.of(texts.to_pylist()), type=pa.int64())
                n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n_bytes, n, pc.greater(n, limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")
