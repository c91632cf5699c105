"""Quality rules: how far a document's histograms are from those of its language."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.measures import CLASSES, class_counts, measure

#: A common word makes up at least this share of its language's words.
COMMON = 0.002
#: Words counted together before the rare ones are let go.
COUNTED = 400_000
#: Languages with fewer words than this give no reference.
LEAST_WORDS = 2_000


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two histograms, 0 to 1: the square root of the divergence in bits."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, terms.sum() / 2)))


def references(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", common: float = COMMON) -> dict[str, dict]:
    """For each language: its character classes and its common words with their counts.

    Both come from all documents of at least 50 words. A first pass lets each task keep
    the words that reach half the share among a stretch of its own words. A word that
    reaches the share overall must add up, over the stretches that kept it, to all but
    what the others can hide, which leaves at most 2 / share candidates a language. A
    second pass counts those over all documents.
    """
    rows = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")).where(F.col("lang").isNotNull())
    kept = rows.mapInArrow(_frequent(common / 2), "lang string, word binary, n long, of long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    totals = {r["lang"]: r["n"] for r in kept.where(F.col("word").isNull()).collect()}  # a row a language
    totals = {k: n for k, n in totals.items() if n >= LEAST_WORDS}
    if not totals:
        return {}
    everything = F.element_at(F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]), F.col("lang"))
    hidden = F.lit(common / 2) * (everything - F.col("of"))
    able = kept.where(F.col("word").isNotNull() & F.col("lang").isin(list(totals)) & (F.col("n") + hidden >= F.lit(common) * everything))
    candidates = defaultdict(list)
    for r in able.select("lang", "word").collect():  # at most 2 / common for each language
        candidates[r["lang"]].append(bytes(r["word"]))
    exact = rows.where(F.col("lang").isin(list(totals))).mapInArrow(_counted(dict(candidates)), "lang string, place int, word binary, n long")
    found: dict[str, dict] = {k: {"classes": np.zeros(len(CLASSES)), "words": {}} for k in totals}
    for r in exact.groupBy("lang", "place", "word").agg(F.sum("n").alias("n")).collect():
        own = found[r["lang"]]
        if r["word"] is None:
            own["classes"][r["place"]] = r["n"]
        elif r["n"] >= common * totals[r["lang"]]:
            own["words"][bytes(r["word"])] = r["n"]
    for k, own in found.items():
        own["words"] = dict(sorted(own["words"].items()))
        own["rest"] = totals[k] - sum(own["words"].values())
    return found


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str, list[bytes]]]:
    langs, texts = batch.column(0), batch.column(1)
    for i in range(batch.num_rows):
        text = texts[i].as_py() or ""
        words = text.encode("utf-8", "surrogatepass").split()
        if len(words) >= 50:
            yield langs[i].as_py(), text, words


def _frequent(share: float):
    names = ["lang", "word", "n", "of"]

    def flush(counts: dict[str, Counter]) -> pa.RecordBatch:
        out = []
        for lang, words in counts.items():
            total = words.total()
            out.append((lang, None, total, 0))
            out.extend((lang, w, n, total) for w, n in words.items() if n >= share * total)
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        held = 0
        for batch in batches:
            for lang, _, words in _texts(batch):
                counts[lang].update(words)
                held += len(words)
                if held >= COUNTED:
                    yield flush(counts)
                    counts, held = defaultdict(Counter), 0
        if counts:
            yield flush(counts)

    return run


def _counted(candidates: dict[str, list[bytes]]):
    wanted = {k: set(v) for k, v in candidates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text, words in _texts(batch):
                classes[lang] += class_counts(text)
                counts[lang].update(filter(wanted.get(lang, set()).__contains__, words))
        out = [(k, i, None, int(n)) for k, v in classes.items() for i, n in enumerate(v)]
        out += [(k, -1, w, n) for k, c in counts.items() for w, n in c.items()]
        if out:
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["lang", "place", "word", "n"])

    return run


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "char_distance double, word_distance double, kept boolean"
)


class Judge:
    """Measures a text against the references."""

    def __init__(self, found: dict[str, dict], char_limit: float, word_limit: float, least_chars: int, least_words: int):
        self.references = {
            k: (v["classes"], {w: i for i, w in enumerate(v["words"])}, np.array([*v["words"].values(), v["rest"]], float)) for k, v in found.items()
        }
        self.limits = char_limit, word_limit, least_chars, least_words

    def distances(self, lang: str | None, text: str, words: list[bytes]) -> tuple[float | None, float | None]:
        """To the document's language, or where that has no reference to the nearest; null below the least lengths."""
        char_limit, word_limit, least_chars, least_words = self.limits
        own = [self.references[lang]] if lang in self.references else list(self.references.values())
        chars = len(text) >= least_chars and text and own
        char = min(jensen_shannon(c, r) for r, _, _ in own) if chars and (c := class_counts(text)) is not None else None
        word = None
        if len(words) >= least_words and words and own:
            near = []
            for _, places, counts in own:
                h = np.bincount([places.get(w, len(places)) for w in words], minlength=len(places) + 1)
                near.append(jensen_shannon(h.astype(float), counts))
            word = min(near)
        return char, word

    def row(self, lang: str | None, text: str | None) -> tuple:
        m = measure(text)
        failed = m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words
        char, word = self.distances(lang, text or "", m.words)
        kept = not failed and (char is None or char <= self.limits[0]) and (word is None or word <= self.limits[1])
        return m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, char, word, kept


def judge_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    char_limit: float = 0.3,
    word_limit: float = 0.44,
    least_chars: int = 200,
    least_words: int = 50,
) -> DataFrame:
    """(id, the base counts, base_failed, char_distance, word_distance, kept).

    A document is kept if it has 50 words or more, at most half of them in repeated
    windows, and its histograms of character classes and of common words (all others in
    one bin) are no further from its language's than the limits. A histogram of fewer
    than the least characters or words is not compared: its distance is null and speaks
    for no one. A null or rare language is compared with every reference, the nearest
    counts; without any reference only the base rules hold.

    Null texts are empty and fail; null ids and repeated rows are rows like others. An
    empty table gives no rows. Other columns are not read.
    """
    found = references(docs, text_column, lang_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(found, char_limit, word_limit, least_chars, least_words)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            keys, langs, texts = batch.columns
            rows = [judge.row(langs[i].as_py(), texts[i].as_py()) for i in range(batch.num_rows)]
            if rows:
                out = [keys, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]]
                yield pa.RecordBatch.from_arrays(out, ["id", *[x.split()[0] for x in RESULT.split(", ")]])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_column)
