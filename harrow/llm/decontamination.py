"""Benchmark passages in documents: a prefix-filtered join of rare shingles, all in the JVM."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import text_or_empty
from harrow.session import cut_lineage, spread

#: Runs of ASCII letters, digits and anything beyond ASCII, once A-Z are small.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same runs in a text as it stands.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Item windows that are broadcast at most, about 200 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The hash of a document's extra row; a shingle of this hash is told apart by its place.
MARK = 1


def words_of(text: Column) -> Column:
    """The words of a text with A-Z as small letters; other letters stay as they are."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def shingle_hashes(words: Column, size: int) -> Column:
    """The hash of every run of ``size`` words; none if there are fewer."""
    places = F.sequence(F.lit(0), F.size(words) - size)
    made = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(F.size(words) >= size, made).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """(words, items): each different window of the items and the ids of the items that hold it.

    A window is ``window`` words in a row; an item of fewer words is one window, an item
    without words has none. Ids are text, a null id is the empty text.
    """
    told = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), words_of(text_or_empty(text_column)).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    cut = told.where(F.size("all") > 0).select("item", "all", F.explode(starts).alias("start"))
    return cut.select("item", F.slice("all", F.col("start"), F.lit(window)).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 10,
    shingle: int = 5,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, n_words, n_hit, items, spans): what each document holds of the benchmark.

    ``spans`` lists [start, end) in words of every occurrence of an item's window, merged
    where they touch; ``n_hit`` counts the words inside; ``items`` are the sorted ids of
    items with an occurring window.

    1. The places of the windows' shingles in all documents are found in one pass, kept
       and counted. A window with a shingle that occurs nowhere cannot occur.
    2. Ordered by rarity, a window that is held whole must share its first shingle, so
       only the places of that one go on.
    3. The shingle's place in the window gives the place in the document; it must leave
       room for the window on both sides. The words there are then compared one by one;
       only texts with such a place are read again.

    Windows up to ``broadcast_rows`` are broadcast. More are joined by shuffles, which the
    adaptive planner splits where a shingle is crowded.

    Null texts have no words. Null ids and repeated rows keep their rows. An empty
    benchmark or one without words gives no hits; an empty table no rows. Other columns
    are not read.
    """
    base = spread(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    base = base.select("id", F.xxhash64(text_or_empty("text")).alias("print"), text_or_empty("text").alias("text"))
    windows = cut_lineage(item_windows(items, item_id_column, item_text_column, window).select(F.xxhash64("words").alias("window"), "words", "items"))
    # short items have shorter shingles; there are at most as many lengths as words in a shingle
    long = F.least(F.size("words"), F.lit(shingle))
    lengths = sorted(r[0] for r in windows.select(long).distinct().collect())
    few = windows.count() <= broadcast_rows
    small = F.broadcast if few else (lambda df: df)

    parts = [shingle_hashes(F.col("words"), n) for n in lengths] or [F.array().cast("array<bigint>")]
    shingled = base.select("id", "print", words_of(F.col("text")).alias("words"))
    shingled = shingled.select("id", "print", "words", F.when(F.size("words") > 0, F.flatten(F.array(*parts))).alias("hashes"))

    # of a plain column Spark would first test the size, below the projection, and find the words anew for every hash
    hashes = F.coalesce("hashes", F.array().cast("array<bigint>"))

    own = F.coalesce(*[F.when(long == n, shingle_hashes(F.col("words"), n)) for n in lengths], F.array().cast("array<bigint>"))
    tokens = windows.select("window", F.posexplode(own).alias("offset", "hash"))
    wanted = tokens.select("hash").distinct()

    # a hash's place counts on through the lengths, one stretch of places for each
    size = F.size("words")
    place, here = F.col("place"), F.lit(None).cast("int")
    before = F.lit(0)
    length = F.lit(None).cast("int")
    for n in lengths:
        count = F.greatest(F.col("size") - n + 1, F.lit(0))
        inside = (place >= before) & (place < before + count)
        here = F.coalesce(here, F.when(inside, place - before))
        length = F.coalesce(length, F.when(inside, F.lit(n)))
        before = before + count
    if few:
        # one row more for each document, which brings the number of words
        mark = wanted.sparkSession.range(1).select(F.lit(MARK).cast("long").alias("hash"))
        places = shingled.select("id", "print", size.alias("size"), F.posexplode(F.concat(F.array(F.lit(MARK).cast("long")), hashes)).alias("place", "hash"))
        places = places.withColumn("place", place - 1).join(small(wanted.union(mark).distinct()), "hash")
        met = cut_lineage(places)
        counted = met.where(place < 0).select("id", "print", F.col("size").cast("long").alias("n_words"))
        hits = met.where(place >= 0)
    else:
        places = shingled.select("id", "print", size.alias("size"), F.posexplode(hashes).alias("place", "hash"))
        hits = cut_lineage(places.join(wanted, "hash"))
        counted = base.select("id", "print", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))

    seen = hits.groupBy("hash").agg(F.count("*").alias("seen"))
    rarest = (
        tokens.join(seen, "hash", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "hash", "offset")).alias("first"))
        .where(F.col("first.seen") > 0)
    )
    keys = rarest.join(windows, "window").select(
        F.col("first.hash").alias("hash"), F.col("first.offset").alias("offset"), "window", F.size("words").alias("n"), long.alias("length")
    )
    met = hits.join(small(cut_lineage(keys)), "hash").where(length == F.col("length")).withColumn("start", here - F.col("offset"))
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("size")))
    met = cut_lineage(met.select("id", "print", "start", "n", "window").distinct())
    # only texts that hold such a shingle are read again
    prints = met.select(F.col("print").alias("print0")).distinct()
    narrow = F.broadcast if prints.count() <= broadcast_rows else (lambda df: df)
    whole = base.withColumnsRenamed({"id": "id0", "print": "print0"}).join(narrow(prints), "print0", "left_semi").dropDuplicates(["id0", "print0"])
    whole = whole.select("id0", "print0", words_of(F.col("text")).alias("words"))
    found = met.join(whole, (F.col("print") == F.col("print0")) & F.col("id").eqNullSafe(F.col("id0")))
    found = found.join(small(windows.select("window", F.col("words").alias("wanted"))), "window")
    found = cut_lineage(found.where(F.slice("words", F.col("start") + 1, F.col("n")) == F.col("wanted")).select("id", "print", "start", "n", "window"))

    widest = found.groupBy("id", "print", "start").agg(F.max("n").alias("n"))
    # a document has at most as many starts as words
    listed = widest.groupBy("id", "print").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    hit = listed.select("id", "print", merged(F.col("spans")).alias("spans"))
    named = found.select("id", "print", "window").distinct().join(small(windows.select("window", "items")), "window")
    named = named.select("id", "print", F.explode("items").alias("item")).groupBy("id", "print").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hit.join(named, (hit["print"] == named["print"]) & hit["id"].eqNullSafe(named["id"])).select(
        hit["id"].alias("id1"), hit["print"].alias("print1"), "spans", "items"
    )
    joined = counted.join(both, (F.col("print") == F.col("print1")) & F.col("id").eqNullSafe(F.col("id1")), "left")
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return joined.select(
        F.col("id").alias(id_column), "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap put together."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state, s):
        grown = F.struct(state["last"]["start"].alias("start"), F.greatest(state["last"]["end"], s["end"]).alias("end"))
        apart = state["last"].isNull() | (s["start"] > state["last"]["end"])
        done = F.when(apart & state["last"].isNotNull(), F.concat(state["done"], F.array(state["last"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(apart, s).otherwise(grown).alias("last"))

    start = F.struct(none.alias("done"), F.lit(None).cast("struct<start:int,end:int>").alias("last"))
    return F.aggregate(spans, start, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))


def without_benchmark(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of an item, in their own columns; null ids are kept by text alone."""
    # hits depend on the text only, so they are looked up by its hash
    texts = docs.select(F.sha2(text_or_empty(text_column).cast("binary"), 256).alias("__dec_text"), F.col(text_column).alias("__dec_words")).dropDuplicates(["__dec_text"])
    hit = find_benchmark(texts, items, "__dec_text", "__dec_words", **options).where(F.col("n_hit") > 0).select("__dec_text")
    rows = docs.withColumn("__dec_text", F.sha2(text_or_empty(text_column).cast("binary"), 256))
    return rows.join(hit, "__dec_text", "left_anti").select(*docs.columns)
