"""Tokens of two vocabularies side by side: where their ends meet, which overlap, how often."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.session import checkpoint_folder, spread

#: Pairs of ids that are broadcast with their counts at most.
FREQUENT = 1 << 18
#: Parts of texts whose ids a worker remembers.
REMEMBERED = 150_000
#: Characters of texts that are aligned at once; a longer text is taken by itself.
AT_ONCE = 1 << 19

#: Sizes between the places that are searched one after another, coarse to fine.
STRIDES = (4096, 256, 32, 8, 4, 2, 1)

#: A space that a word may end before: one that follows no other white space.
_SPACE = re.compile(r"(?<=\S) ")
_LOOSE = re.compile(r"(?<!\S) ")


def gallop(shorter: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of a rising list, the number of smaller ones in another, and if it is there too.

    Each search starts where a search for an earlier value ended and doubles its step
    until it is past the value, then halves the last step. Every 4,096th value is
    sought first, then those between, whose searches start at their forerunner's place;
    the searches of a round run side by side.
    """
    n, m = len(shorter), len(longer)
    rank = np.zeros(n, np.int64)
    if not n or not m:
        return rank, np.zeros(n, bool)
    longer = np.append(longer, np.iinfo(np.int64).max)  # nothing is sought behind it
    before = 0
    for stride in STRIDES:
        at = np.arange(0, n, stride)
        if before:
            at = at[at % before != 0]
        value = shorter[at]
        low = rank[at - at % before] if before else np.zeros(len(at), np.int64)
        # all below `low` are smaller than the value, the one at `high` is not
        high = low.copy()
        open_ = np.flatnonzero(longer[low] < value)
        step = 1
        while len(open_):
            low[open_] = high[open_] + 1
            high[open_] = np.minimum(low[open_] + step - 1, m)
            open_ = open_[longer[high[open_]] < value[open_]]
            step *= 2
        open_ = np.flatnonzero(low < high)
        while len(open_):
            lows, highs = low[open_], high[open_]
            middle = (lows + highs) >> 1
            smaller = longer[middle] < value[open_]
            low[open_] = lows = np.where(smaller, middle + 1, lows)
            high[open_] = highs = np.where(smaller, highs, middle)
            open_ = open_[lows < highs]
        rank[at] = low
        before = stride
    return rank, longer[rank] == shorter


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, x, y): where both lists of rising ends meet, by place in each, and all overlapping pairs of tokens.

    The shorter list drives the search. The ranks of a token's two ends in the other
    list bound the tokens it overlaps, and their difference is how many these are.
    """
    swapped = len(a_ends) > len(b_ends)
    rank, met = gallop(b_ends, a_ends) if swapped else gallop(a_ends, b_ends)
    own = np.flatnonzero(met)
    other = rank[own]
    first = np.zeros(len(rank), np.int64)
    first[1:] = (rank + met)[:-1]
    number = rank - first + 1
    left = np.repeat(np.arange(len(rank)), number)
    right = np.arange(len(left)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
    return (other, own, right, left) if swapped else (own, other, left, right)


def byte_level(symbols: str) -> bytes:
    """The bytes that an entry of a byte-level vocabulary stands for."""
    return bytes(_byte_of()[c] for c in symbols)


@lru_cache
def _byte_of() -> dict[str, int]:
    # printable bytes stand for themselves, the others for the characters from 256 on, in order
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers. Texts are cut where neither joins what stands on both sides.

    That is a space behind anything but white space: the pattern of the byte-level
    tokenizer begins a new match there, and no piece has a space behind another
    character. The ids of the parts are remembered, as words return.
    """

    def __init__(self, byte_json: bytes, piece_model: bytes, pattern: str, remembered: int = REMEMBERED):
        said = json.loads(byte_json)
        special = {t["content"] for t in said["added_tokens"]}
        ranks = {byte_level(t): i for t, i in said["model"]["vocab"].items() if t not in special}
        merged = [ranks[byte_level(m.replace(" ", "") if isinstance(m, str) else "".join(m))] for m in said["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the order of merges is not that of the ids")
        self.a = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_tokens[i] = token
        self.b_tokens = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_lengths = np.array([len(t) for t in self.a_tokens], np.int64)
        self.b_lengths = np.array([len(t) for t in self.b_tokens], np.int64)
        # a token's number and what follows it: inside a group, and at its end
        self.a_text = np.array([f"{i}{c}" for c in ",|" for i in range(len(self.a_tokens))], object)
        self.b_text = np.array([f"{i}{c}" for c in ",;" for i in range(len(self.b_tokens))], object)
        # a lone space: an empty text gets no space in front
        self.space = self.b.encode("a ")[len(self.b.encode("a")) :]
        self.remembered, self.known_a, self.known_b = remembered, {}, {}
        self.unlike: set[str] = set()

    def parts(self, text: str) -> list[str]:
        """The text's parts; each has a space in front that is not in it."""
        if not self.splits:
            return [text]
        return _SPACE.split(text) if _LOOSE.search(text) else text.split(" ")

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.known_a]
        if len(self.known_a) + len(new) > self.remembered:
            self.known_a.clear()
            self.known_b.clear()
            self.unlike.clear()
            new = list(parts)
        for p, ids in zip(new, self.b.encode(new, num_threads=1) if new else []):
            ids = ids if p else self.space
            whole = f" {p}"
            own = self.a.encode_ordinary(whole)
            self.known_a[p], self.known_b[p] = (np.array(x, "<u4").tobytes() for x in (own, ids))
            raw = whole.encode()
            if b"".join([self.a_tokens[i] for i in own]) != raw or b"".join([self.b_tokens[i] for i in ids]) != raw:
                self.unlike.add(p)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text under both; of one that either changes, none."""
        cut = [self.parts(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        a = [b"".join(map(self.known_a.__getitem__, p)) for p in cut]
        b = [b"".join(map(self.known_b.__getitem__, p)) for p in cut]
        if self.unlike:
            for i, p in enumerate(cut):
                if not self.unlike.isdisjoint(p) and not self._same(a[i], b[i], texts[i]):
                    a[i] = b[i] = b""
        return a, b

    def _same(self, a: bytes, b: bytes, text: str) -> bool:
        raw = f" {text}".encode()
        joined = [b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]) for tokens, ids in ((self.a_tokens, a), (self.b_tokens, b))]
        return joined == [raw, raw]


@lru_cache(maxsize=1)
def _encoders(byte_json: bytes, piece_model: bytes, pattern: str) -> Encoders:
    """One for each worker process, whatever its number of tasks."""
    return Encoders(byte_json, piece_model, pattern)


def aligned_texts(encoders: Encoders, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each text: numbers of A tokens, B tokens, groups and links; the groups; where its pairs start; pairs and their counts.

    The lists of ends of all texts are laid end to end, as both reach each text's end.
    """
    a_raw, b_raw = encoders.encode(texts)
    n_a, n_b = (np.array([len(x) // 4 for x in raw], np.int64) for raw in (a_raw, b_raw))
    a, b = (np.frombuffer(b"".join(raw), "<u4").astype(np.int64) for raw in (a_raw, b_raw))
    at, there, x, y = align(np.cumsum(encoders.a_lengths[a]), np.cumsum(encoders.b_lengths[b]))
    a_stop, b_stop = np.cumsum(n_a), np.cumsum(n_b)
    groups_until = np.searchsorted(at, a_stop, "left")  # ends before the text's stop
    n_groups = np.diff(groups_until, prepend=0)
    # the groups as text: tokens of A, then those of B, group by group
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_last[at], b_last[there] = 1, 1
    a_size, b_size = np.diff(at, prepend=-1), np.diff(there, prepend=-1)
    said = np.empty(len(a) + len(b), object)
    said[np.arange(len(a)) + np.repeat(there - b_size + 1, a_size)] = encoders.a_text[a + a_last * len(encoders.a_tokens)]
    said[np.arange(len(b)) + np.repeat(at + 1, b_size)] = encoders.b_text[b + b_last * len(encoders.b_tokens)]
    words = said.tolist()
    stops = (a_stop + b_stop).tolist()
    groups = ["".join(words[s:e])[:-1] for s, e in zip([0, *stops], stops)]
    # pairs of ids, sorted by text and pair
    base = len(encoders.b_tokens)
    span = len(encoders.a_tokens) * base
    owner = np.repeat(np.arange(len(texts)), n_a)[x]
    n_links = np.bincount(owner, minlength=len(texts))
    keys = np.sort(owner * span + a[x] * base + b[y])
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(starts, append=len(keys))
    keys = keys[starts]
    offsets = np.searchsorted(keys, np.arange(len(texts) + 1) * span, "left")
    codes = keys % span
    return [n_a, n_b, n_groups, n_links], groups, offsets, codes // base << 32 | codes % base, times


def align_documents(
    docs: DataFrame, byte_path: str, piece_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times): both token lists of each text cut at common ends.

    A encodes a space and the text by the byte-level vocabulary at ``byte_path``, B the
    text by the piece model at ``piece_path``, which puts the space itself; control
    strings in texts are plain text. ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids between
    common byte offsets. ``pairs`` are the different pairs (A id * 2 ** 32 + B id) of
    overlapping tokens, ``times`` how many such links the text has of each.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have
    no tokens. Null ids and repeated rows are rows like others. An empty table gives no
    rows. Other columns are not read. A text must fit in a worker's memory about a
    hundred times.
    """
    with open(byte_path, "rb") as f, open(piece_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read(), pattern))  # as large as the vocabularies
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(*shared.value)
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        for batch in batches:
            keys, texts, start, held = batch.column(0), [], 0, 0
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py())
                held += len(texts[-1] or "")
                if held < AT_ONCE and i < batch.num_rows - 1:
                    continue
                numbers, groups, offsets, pairs, times = aligned_texts(encoders, texts)
                at = pa.array(offsets, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((pairs, pa.int64()), (times, pa.int32()))]
                columns = [keys.slice(start, len(texts)), *[pa.array(v, pa.int64()) for v in numbers], pa.array(groups, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names)
                texts, start, held = [], i + 1, 0

    rows = spread(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def with_link_counts(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` without its pairs, with n_best and count_sum.

    A pair's count is the number of links of all texts that hold it. ``count_sum`` adds
    the counts of a text's links; ``n_best`` counts links whose count is the highest of
    their B id, ties included.

    Of N links at most ``frequent`` pairs can have N / ``frequent`` or more each; these
    are broadcast. Links of the others meet their counts in a shuffle, in which no pair
    has more links than that. ``aligned`` is written once to the shared folder, with a
    number for each row, and stays there, as the result is read from it.
    """
    spark = aligned.sparkSession
    place = f"{checkpoint_folder(spark)}/aligned-{uuid.uuid4().hex}"
    aligned.withColumn("__row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{place}/texts")
    stored = spark.read.schema(aligned.schema.add("__row", "long")).parquet(f"{place}/texts")
    links = stored.select("__row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    links.groupBy("pair").agg(F.sum("times").alias("count")).write.option("compression", "zstd").parquet(f"{place}/counts")
    counts = spark.read.schema("pair long, count long").parquet(f"{place}/counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    # an id has at most as many partners as the other vocabulary has ids
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("best"))
    judged = counts.withColumn("b", b_id).join(best, "b").select("pair", "count", (F.col("count") == F.col("best")).cast("long").alias("best"))
    least = max(1, -(-total // frequent))
    common = F.broadcast(judged.where(F.col("count") >= least))
    rare = judged.where(F.col("count") < least)
    sums = [F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    often = links.join(common, "pair").groupBy("__row").agg(*sums)
    seldom = links.join(common, "pair", "left_anti").join(rare, "pair").groupBy("__row").agg(*sums)
    both = often.unionByName(seldom).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = stored.drop("pairs", "times").join(both, "__row", "left")
    none = F.lit(0).cast("long")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")}).drop("__row")
