"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens, and parts of them, that a worker remembers; characters of a text that are split at once.
REMEMBERED, AT_ONCE = 200_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def perfect_hash(ranks: dict[bytes, int], keys_per_bucket: int = 3) -> dict:
    """A minimal perfect hash of the vocabulary, as plain lists: every token has a slot of its own.

    Tokens fall into buckets by their hash. Largest first, each bucket gets the least
    seed under which all its tokens hash to free slots; the one of a single token is
    its slot itself, as a negative number. A lookup is two hashes and a comparison.
    """
    n = len(ranks)
    m = max(1, n // keys_per_bucket)
    hashed = xxhash.xxh64_intdigest
    buckets: list[list[bytes]] = [[] for _ in range(m)]
    for token in ranks:
        buckets[hashed(token) % m].append(token)
    seeds, tokens = [0] * m, [b""] * n
    free = bytearray(b"\1") * n
    for b in sorted(range(m), key=lambda b: -len(buckets[b])):
        own = buckets[b]
        if len(own) < 2:
            break
        seed = 1
        while True:
            slots = []
            for token in own:
                s = hashed(token, seed) % n
                if not free[s] or s in slots:
                    break
                slots.append(s)
            else:
                break
            seed += 1
        seeds[b] = seed
        for s, token in zip(slots, own):
            free[s], tokens[s] = 0, token
    left = (s for s in range(n) if free[s])
    for b in range(m):
        if len(buckets[b]) == 1:
            s = next(left)
            seeds[b], tokens[s] = -s - 1, buckets[b][0]
    by_rank: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_rank[rank] = token
    return {"seeds": seeds, "tokens": tokens, "ranks": [ranks[t] for t in tokens], "by_rank": by_rank, "remembered": {}, "parts": {}}


def finder(table: dict):
    """The rank of a token, -1 if the vocabulary lacks it."""
    seeds, tokens, ranks = table["seeds"], table["tokens"], table["ranks"]
    n, m, hashed = len(tokens), len(seeds), xxhash.xxh64_intdigest

    def find(token: bytes) -> int:
        seed = seeds[hashed(token) % m]
        slot = hashed(token, seed) % n if seed >= 0 else -seed - 1
        return ranks[slot] if tokens[slot] == token else -1

    return find


def merged(piece: bytes, find) -> list[int]:
    """Ranks of a pre-token's parts: neighbours of the lowest rank merge first, the leftmost of equals.

    Parts are linked by where they end and where the one before starts; a heap holds
    the merges that were possible when they were seen.
    """
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(piece[i : i + 2])) >= 0]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != e:  # a part of it has merged otherwise since
            continue
        end[i], end[j], before[e] = e, -1, i
        p = before[i]
        if p >= 0 and (r := find(piece[p:e])) >= 0:
            heappush(heap, (r, p, e))
        if e < n and (r := find(piece[i : end[e]])) >= 0:
            heappush(heap, (r, i, end[e]))
    out, i = [], 0
    while i < n:
        out.append(find(piece[i : end[i]]))
        i = end[i]
    return out


class Remembered(dict):
    """Ids of pre-tokens; those not met before are looked up."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.find(piece)
        return ids


class Encoder:
    """Encodes and decodes with a table of ``perfect_hash``; pre-tokens met before are remembered in the table."""

    def __init__(self, table: dict, pattern: str):
        self.find = finder(table)
        self.split = regex.compile(pattern)
        self.remembered: dict[str, bytes] = table["remembered"]
        if not isinstance(self.remembered, Remembered):
            self.remembered = table["remembered"] = Remembered(self.piece)
        self.parts: dict[bytes, int] = table["parts"]
        self.by_rank: list[bytes] = table["by_rank"]

    def piece(self, piece: str) -> bytes:
        data = piece.encode()
        rank = self.find(data)
        if rank >= 0:
            return rank.to_bytes(4, "little")
        ids = merged(data, self.part)
        if min(ids) < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        return np.array(ids, "<u4").tobytes()

    def part(self, part: bytes) -> int:
        """The rank of a part of a pre-token; parts recur, so they are remembered too."""
        rank = self.parts.get(part)
        if rank is None:
            if len(self.parts) > REMEMBERED:
                self.parts.clear()
            rank = self.parts[part] = self.find(part)
        return rank

    def _join(self, pieces: list[str]) -> bytes:
        known = self.remembered
        if len(known) > REMEMBERED:
            known.clear()
        return b"".join(map(known.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) <= AT_ONCE:
            return self._join(self.split.findall(text))
        found, out = (m.group() for m in self.split.finditer(text)), []
        while pieces := list(islice(found, 1 << 16)):
            out.append(self._join(pieces))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.by_rank.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def vocabulary(docs: DataFrame, path: str):
    """The rank file's table on every worker; its size is that of the vocabulary."""
    return docs.sparkSession.sparkContext.broadcast(perfect_hash(read_ranks(path)))


def encode_documents(docs: DataFrame, table, pattern: str, id_column: str = "doc_id", text_column: str = "text", decoded: str | None = None) -> DataFrame:
    """(id, n_tokens, ids): the ids of each text as little-endian unsigned 32-bit integers.

    With ``decoded``, a column of that name has the bytes that the ids stand for, as of
    ``with_decoded``, without a second pass through Python.

    ``table`` comes from ``vocabulary``; each match of ``pattern`` is encoded by itself;
    there are no special tokens. A null text is empty and has no ids. Null ids and
    repeated rows are rows like others. An empty table gives no rows. Other columns are
    not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, out, back, size = 0, [], [], 0
            for i in range(batch.num_rows):
                out.append(encoder.encode(texts[i].as_py()))
                size += len(out[-1])
                if decoded:
                    back.append(encoder.decode(out[-1]))
                    size += len(back[-1])
                if size > 1 << 23 or i == batch.num_rows - 1:
                    counts = pa.array([len(x) // 4 for x in out], pa.int64())
                    columns = {"id": keys.slice(start, len(out)), "n_tokens": counts, "ids": pa.array(out, pa.binary())}
                    yield pa.RecordBatch.from_pydict(columns | ({decoded: pa.array(back, pa.binary())} if decoded else {}))
                    start, out, back, size = i + 1, [], [], 0

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    told = f"id {kind}, n_tokens long, ids binary" + (f", `{decoded}` binary" if decoded else "")
    return rows.mapInArrow(run, told).withColumnRenamed("id", id_column)


def with_decoded(encoded: DataFrame, table, pattern: str, ids_column: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for in column ``out``; no ids give no bytes."""

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        encoder = Encoder(table.value, pattern)
        return pd.Series([encoder.decode(x) for x in ids])

    return encoded.withColumn(out, decoded(F.col(ids_column)))
