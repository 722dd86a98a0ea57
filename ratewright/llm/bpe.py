"""Byte-level BPE, both ways, by merge rounds over flat numpy arrays.

The symbols of many distinct words lie in one array. In each round all adjacent pairs are looked up by binary search over
the sorted pair keys; every word merges its lowest-ranked pair wherever it stands, and words without a known pair leave
the array with their ids. Ids go back to bytes through one table: the bytes of all tokens in a row, and where each begins.

What is broadcast, merges and the bytes of tokens, has the size of the vocabulary.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import CHUNK_BYTES, slices
from ratewright.llm.tokens import LONG, NO_RANK, PRE_TOKEN, REMEMBERED, Merges, byte_symbols

#: Ids in this form follow each other in a binary value.
ID = np.dtype("<u4")

#: Words after which the ids of one text are joined, so that a long text isn't held as single words.
WORDS_AT_ONCE = 200_000


class Vocabulary(Merges):
    """The merges, and the bytes of every token."""

    def __init__(self, path: str):
        super().__init__(path)
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special_id = {content: i for i, content in added.items()}
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | added
        # a token with a character that stands for no byte is given as it is
        of = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in (tokens.get(i, "") for i in range(max(tokens) + 1))]
        self.begin = np.cumsum([0, *map(len, of)])
        self.bytes = np.frombuffer(b"".join(of), dtype=np.uint8)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes. All words lie in one array; memory follows their bytes."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if (lengths > LONG).any():
            out: list[bytes] = [b""] * len(words)
            short = np.flatnonzero(lengths <= LONG)
            for i, ids in zip(short.tolist(), self.encoded([words[i] for i in short]) if short.size else [], strict=True):
                out[i] = ids
            for i in np.flatnonzero(lengths > LONG).tolist():
                out[i] = self.long_symbols(self.of_byte[np.frombuffer(words[i], dtype=np.uint8)]).astype(ID).tobytes()
            return out
        flat = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while flat.size:
            rank, made = np.full(flat.size, NO_RANK, dtype=np.int64), np.zeros(flat.size, dtype=np.int64)
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner], made[inner] = self.ranks_of(flat[inner], flat[inner + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, flat.size]))
            if (settled := lowest == NO_RANK).any():
                ready.append((word[settled], flat[settled]))
            merge = np.flatnonzero((rank == lowest) & ~settled)
            if merge.size > 1:  # in a run of overlapping pairs every second one counts, from the left
                run = np.r_[True, np.diff(merge) != 1]
                place = np.arange(merge.size)
                merge = merge[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            flat[merge] = made[merge]
            stay = ~settled
            stay[merge + 1] = False
            flat, word = flat[stay], word[stay]
        if not ready:
            return [b""] * len(words)
        word, flat = (np.concatenate(x) for x in zip(*ready, strict=True))
        ids = flat[np.argsort(word, kind="stable")].astype(ID).tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def token_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, one after the other."""
        if ids.size and int(ids.max()) >= self.begin.size - 1:
            raise ValueError(f"id {ids.max()} is not in the vocabulary")
        begin, sizes = self.begin[ids], self.begin[ids + 1] - self.begin[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(ends[-1] if ends.size else 0) + np.repeat(begin - ends + sizes, sizes)].tobytes()

    def decoded(self, ids: bytes) -> str:
        """The text of ids as bytes; what isn't UTF-8 becomes U+FFFD."""
        every, reader, step = np.frombuffer(ids, dtype=ID).astype(np.int64), codecs.getincrementaldecoder("utf-8")("replace"), CHUNK_BYTES
        parts = [reader.decode(self.token_bytes(every[i : i + step])) for i in range(0, every.size, step)]
        return "".join(parts) + reader.decode(b"", True)


class Encoder(dict):
    """Word to its ids as bytes, filled for many words at once; when full it starts anew."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.cut = vocabulary, regex.compile(PRE_TOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in order, in lists of bounded length; added tokens in the text are lists of their own."""
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                yield [part]
            elif len(part) <= WORDS_AT_ONCE:
                yield self.cut.findall(part)
            else:
                some: list[str] = []
                for m in self.cut.finditer(part):
                    some.append(m.group())
                    if len(some) == WORDS_AT_ONCE:
                        yield some
                        some = []
                yield some

    def learn(self, words: set[str]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        if new := [w for w in words if w not in self]:
            special = self.vocabulary.special_id
            self.update(zip(new, self.vocabulary.encoded([b"" if w in special else w.encode() for w in new]), strict=True))
            self.update((w, np.array([special[w]], dtype=ID).tobytes()) for w in new if w in special)

    def of(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        long_ = [t is not None and len(t) > WORDS_AT_ONCE for t in texts]
        cut = [[] if far else [w for some in self.words(t or "") for w in some] for t, far in zip(texts, long_, strict=True)]
        self.learn(set().union(*cut))
        for t, words, far in zip(texts, cut, long_, strict=True):
            if not far:
                self.learn(set(words))  # nothing to do, unless a long text before it has filled the memory
                out.append(b"".join(map(self.__getitem__, words)))
                continue
            parts = []
            for some in self.words(t or ""):
                self.learn(set(some))
                parts.append(b"".join(map(self.__getitem__, some)))
            out.append(b"".join(parts))
        return out


def fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, ids (binary: the ids as little-endian unsigned 32-bit integers) and n_tokens of each row.

    Null and empty texts have no ids. Repeated rows and ids each give a row; an empty table gives none. Other columns aren't
    read, whatever their names. Texts are encoded whole, one of many megabytes by words as they come; strings of added tokens
    inside a text are those tokens, as the library has it by default. No shuffle: rows are encoded where they are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids = encoder.of(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, type=pa.binary()), pa.array([len(x) // 4 for x in ids], type=pa.int64())], names=[*keep, "ids", "n_tokens"])

    return source.mapInArrow(run, f"{fields(docs.select(*keep))}, ids binary, n_tokens long")


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of `encoded` and a column `text` with the text of its ids; added tokens are written out.

    Null ids give a null text, none the empty text; bytes that aren't UTF-8 give U+FFFD. An id beyond the vocabulary is an error.
    """
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ids):
                texts = [None if x is None else held.value.decoded(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.string())], names=[*part.schema.names, text])

    return encoded.mapInArrow(run, f"{fields(encoded)}, `{text}` string")
