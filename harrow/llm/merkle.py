"""Document fingerprints: a Merkle tree over the sections and paragraphs of a text."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of an inner node, of a leaf; words in a leaf on average and at most.
NODE, LEAF, WORDS_PER_LEAF, LONGEST_LEAF = 16, 8, 8, 24

_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
_PIECE = re.compile(r"\S+\s*|\s+")


def _digest(data: str | bytes, digits: int) -> str:
    return hashlib.blake2b(data if isinstance(data, bytes) else data.encode("utf-8", "surrogatepass"), digest_size=digits // 2).hexdigest()


def leaves(paragraph: str) -> list[str]:
    """A paragraph's runs of words, each ended by a word whose length and letters say so.

    Where a run ends depends on the word alone, unless it grows too long, so an edit
    changes the runs it touches and seldom others.
    """
    out, start, words = [], 0, 0
    for m in _PIECE.finditer(paragraph):
        word = m.group()
        words += 1
        if words == LONGEST_LEAF or (sum(map(ord, word[:3])) + 7 * len(word)) % WORDS_PER_LEAF == 0:
            out.append(paragraph[start : m.end()])
            start, words = m.end(), 0
    if start < len(paragraph) or not out:
        out.append(paragraph[start:])
    return out


def fingerprint(text: str | None) -> str:
    """The tree of a text, written ``root;section(paragraph:leaf...,paragraph:leaf...)...``.

    Sections are divided by blank lines, paragraphs are lines, leaves are runs of
    about eight words. A paragraph's digest is of its text, that of a section and of the
    root of the digests below, so equal roots mean equal texts and a differing branch
    shows where texts differ. Null is the empty text.
    """
    text = text or ""
    sections, at = [], 0
    bounds = [m.end() for m in _BLANK_LINE.finditer(text)] + [len(text)]
    for end in bounds:
        paragraphs = []
        for line in text[at:end].split("\n"):
            below = [_digest(x, LEAF) for x in leaves(line)]
            paragraphs.append(_digest(line, NODE) + ":" + "".join(below))
        node = _digest("".join(p[:NODE] for p in paragraphs), NODE)
        sections.append(f"{node}({','.join(paragraphs)})")
        at = end
    root = _digest("".join(s[:NODE] for s in sections) + str(len(text)), NODE)
    return f"{root};{''.join(sections)}"


def branches(mark: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """The sections of a fingerprint, each with its paragraphs and their leaves."""
    out = []
    for section in mark[NODE + 1 :].split(")")[:-1]:
        node, rest = section[:NODE], section[NODE + 1 :]
        paragraphs = []
        for p in rest.split(","):
            digits = p[NODE + 1 :]
            paragraphs.append((p[:NODE], [digits[i : i + LEAF] for i in range(0, len(digits), LEAF)]))
        out.append((node, paragraphs))
    return out


def likeness(left: str, right: str) -> float:
    """Twice the shared leaves by the leaves of both, 1 for equal roots.

    Sections and then paragraphs with equal digests count whole and are not
    descended; only the leaves of differing branches are compared.
    """
    if left[:NODE] == right[:NODE]:
        return 1.0
    sizes, shared = [0, 0], 0
    rest: list[Counter] = []
    a, b = branches(left), branches(right)
    for side, tree in enumerate((a, b)):
        sizes[side] = sum(len(p[1]) for s in tree for p in s[1])
    same = Counter(s[0] for s in a) & Counter(s[0] for s in b)
    open_paragraphs = []
    for tree in (a, b):
        left_over, closed = Counter(same), []
        for node, paragraphs in tree:
            if left_over[node]:
                left_over[node] -= 1
                shared += sum(len(p[1]) for p in paragraphs) if tree is a else 0
            else:
                closed.extend(paragraphs)
        open_paragraphs.append(closed)
    same = Counter(p[0] for p in open_paragraphs[0]) & Counter(p[0] for p in open_paragraphs[1])
    for side, paragraphs in enumerate(open_paragraphs):
        left_over, found = Counter(same), Counter()
        for node, below in paragraphs:
            if left_over[node]:
                left_over[node] -= 1
                shared += len(below) if side == 0 else 0
            else:
                found.update(below)
        rest.append(found)
    shared += (rest[0] & rest[1]).total()
    return 2 * shared / sum(sizes) if sum(sizes) else 0.0


def differing_paragraphs(left: str, right: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of ``left`` that ``right`` does not hold in an equal branch."""
    if left[:NODE] == right[:NODE]:
        return []
    theirs = branches(right)
    sections = Counter(s[0] for s in theirs)
    paragraphs = Counter(p[0] for s in theirs for p in s[1])
    out = []
    for i, (node, below) in enumerate(branches(left)):
        if sections[node]:
            sections[node] -= 1
            continue
        for j, (digest, _) in enumerate(below):
            if paragraphs[digest]:
                paragraphs[digest] -= 1
            else:
                out.append((i, j))
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chars_per_slice: int = 1 << 24) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like they and the next text's are.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). The next document is that of the next smaller id, after the last the
    first. Null ids come last; rows of the same id stand by text hash; null texts are
    empty; a single row is its own next. An empty table gives no rows. Other columns
    are not read.

    Ids are cut into slices of about ``chars_per_slice`` characters by approximate
    quantiles. Each text is shuffled once, to its slice, where rows stream past in
    order; the first row of the following slice is sent along.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    narrow = docs.select(F.coalesce(F.col(id_column), lowest).alias("at"), F.length(text_column).alias("n"), F.xxhash64(text_column).alias("h"))
    summary = narrow.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slices = max(1, min(summary[0], -(-summary[1] // chars_per_slice)))
    bounds: list[int] = []
    if slices > 1:
        points = [i / slices for i in range(1, slices)]
        bounds = sorted(set(narrow.agg(F.percentile_approx("at", points, 20 * slices)).first()[0]))
    # slice 0 has the largest ids
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    slice_of = lambda at: F.size(F.filter(edges, lambda b: b >= at))
    tops = narrow.groupBy(slice_of(F.col("at")).alias("slice")).agg(F.max(F.struct("at", (-F.col("h").cast("decimal(20,0)")).alias("minus"))).alias("top"))
    firsts = sorted((r["slice"], r["top"]["at"], -int(r["top"]["minus"])) for r in tops.collect())  # a row a slice
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(id_column), lowest).alias("at"), F.xxhash64(text_column).alias("h"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    # where a slice's first row goes besides: behind the slice before it
    sent = F.array(*[
        F.struct(F.lit(at).cast("long").alias("at"), F.lit(h).cast("long").alias("h"), F.lit(firsts[i - 1][0]).alias("to")) for i, (_, at, h) in enumerate(firsts)
    ]) if firsts else F.array().cast("array<struct<at:bigint,h:bigint,to:int>>")
    extra = F.transform(
        F.filter(sent, lambda s: (s["at"] == F.col("at")) & (s["h"] == F.col("h"))), lambda s: F.struct(s["to"].alias("slice"), F.lit(True).alias("behind"))
    )
    places = F.concat(F.array(F.struct(slice_of(F.col("at")).alias("slice"), F.lit(False).alias("behind"))), extra)
    dealt = rows.select("id", "at", "h", "text", F.inline(places)).repartition(max(1, len(firsts)), "slice")
    ordered = dealt.sortWithinPartitions("slice", "behind", F.desc("at"), "h").select("slice", "behind", "id", "text")
    return ordered.mapInArrow(_stream, RESULT).withColumnRenamed("id", id_column)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # (slice, id, text, fingerprint) of the row that waits for its next
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(i) for i in range(4)]
        size = 0
        for i in range(batch.num_rows):
            part, behind, key, text = (c[i].as_py() for c in columns)
            if held is None and behind:
                continue
            mark = fingerprint(text)
            if held is not None and held[0] == part:
                new = edited(held[2], text)
                other = fingerprint(new)
                out.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), held[3], other, likeness(held[3], other), likeness(held[3], mark)))
                size += len(held[3]) + len(other)
            # rows behind the slice serve as next of its last only
            held = None if behind else (part, key, text, mark)
            if size > 1 << 22:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
