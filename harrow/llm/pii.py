"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import let, running

#: Characters before and behind a span in which context words count.
REACH = 40
#: Added to the score of a span with a context word beside it.
RAISE = 0.4
#: Spans of at least this score are kept.
KEEP = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` finds leftmost candidates that do not overlap; it is possessive where a
    text could make it backtrack or recurse, and starts only where a run of its
    characters starts, so time grows with the text's length. ``score`` is what a
    confirmed candidate starts from; ``context`` are words that raise it. An account
    number's pattern takes its first four characters only and looks ahead at the rest, as
    what follows may be words in capitals or another account number.
    """

    name: str
    pattern: str
    score: float
    context: str = ""


#: In order of listing. The first four are the base kinds, kept whatever their context.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", 0.6, "ip|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", 0.8, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|fax|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", 0.9, "iban|account|bank|konto"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security|id|tax"),
    Kind("local_phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", 0.3, "phone|tel|telephone|call|fax|mobile"),
    Kind("secret", r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+)(?![A-Za-z0-9_])", 0.3, "password|passwd|token|secret|api.?key|akia"),
)
BASE = KINDS[:4]


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The last digit checks the others: every second from the right counts double, less 9 above 9."""
    def checked(d):
        def step(total, i):
            doubled = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return total + doubled - F.when(doubled > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step) % 10 == 0

    return let(digits, checked)


def mod_97(account: Column) -> Column:
    """The account with its first four characters at the end, letters as 10 to 35, leaves 1 when divided by 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest, c):
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def account_length(found: Column) -> Column:
    """The beginning of a candidate that ends where a group ends, has 15 to 34 characters and passes; null if none.

    That of the country's length goes before the longest.
    """
    country = F.substring(found, 1, 2)
    usual = F.coalesce(*[F.when(country.isin(names), F.lit(size)) for size, names in LENGTHS.items()])
    length = lambda e: F.length(F.replace(F.substring(found, F.lit(1), e), F.lit(" "), F.lit("")))

    def passes(e):
        own = F.substring(found, F.lit(1), e)
        return F.substring(found, e, F.lit(1)).rlike("[A-Z0-9]") & F.substring(found, e + 1, F.lit(1)).isin("", " ") & length(e).between(15, 34) & mod_97(own)

    ends = F.filter(F.sequence(F.lit(15), F.length(found)), passes)
    return let(ends, lambda ends: F.coalesce(F.array_max(F.filter(ends, lambda e: length(e) == usual)), F.array_max(ends)))


def confirmed(kind: Kind, found: Column) -> Column:
    """Whether a candidate passes its kind's validator."""
    if kind.name == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind.name == "card":
        return luhn(_digits(found))
    if kind.name == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


#: Characters of account numbers by country.
LENGTHS = {
    size: names.split() for size, names in {
        15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}

SPAN = "struct<start:int,order:int,kind:string,end:int,score:double>"


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """The kept spans of one kind, in code points, end exclusive.

    Splitting gives the stretches between candidates, so lengths summed up give places.
    """
    none = F.array().cast(f"array<{SPAN}>")
    account = kind.name == "iban"
    pairs = F.arrays_zip(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if account else 0)))
    found = F.transform(
        F.filter(pairs, lambda p: p["1"].isNotNull()),
        lambda p: F.struct(F.length(p["0"]).alias("gap"), (F.lit(4) if account else F.length(p["1"])).alias("size"), p["1"].alias("hit")),
    )

    def placed(p):
        before = running(F.transform(p, lambda x: x["gap"] + x["size"]), lambda a, b: a + b, F.lit(0))
        return F.transform(F.arrays_zip(p.alias("p"), before.alias("at")), lambda x: F.struct(
            (x["at"] + x["p"]["gap"]).alias("start"), (x["at"] + x["p"]["gap"] + x["p"]["size"]).alias("end"), x["p"]["hit"].alias("hit")
        ))

    passed = F.filter(let(found, placed), lambda s: confirmed(kind, s["hit"]))
    if account:
        ended = F.transform(passed, lambda s: F.struct(s["start"].alias("start"), (s["start"] + account_length(s["hit"])).alias("end"), s["hit"].alias("hit")))
        passed = F.filter(ended, lambda s: s["end"].isNotNull())

    def scored(s):
        score = F.lit(kind.score)
        if kind.context:
            first = F.greatest(s["start"] - REACH, F.lit(0))
            near = F.concat(F.substring(text, first + 1, s["start"] - first), F.lit("\n"), F.substring(text, s["end"] + 1, F.lit(REACH)))
            words = rf"(?i)(?<![a-z])(?:{kind.context})(?![a-z])"
            hinted = near.rlike(words) | s["hit"].rlike("^(?:AKIA)") if kind.name == "secret" else near.rlike(words)
            score = F.when(hinted, F.least(F.lit(1.0), F.lit(kind.score + RAISE))).otherwise(score)
        return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), score.alias("score"))

    kept = F.filter(F.transform(passed, scored), lambda s: s["score"] >= KEEP)
    return F.when(text.rlike(kind.pattern), kept).otherwise(none)


def personal_spans(text: Column) -> Column:
    """All kept spans of a text by start, then kind as listed; null is the empty text.

    Kinds are sought apart, so spans of different kinds may overlap. Scores of the base
    kinds start above the limit: context can only raise them.
    """
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.flatten(F.array(*[spans_of(text, k, i) for i, k in enumerate(KINDS)])))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, text_column: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with its spans, an array of (start, order, kind, end, score), in column ``out``.

    Every row stays, whatever its other columns hold; a column named ``out`` is
    replaced; texts without personal data, empty and null ones have no spans.
    """
    return docs.withColumn(out, personal_spans(F.col(text_column)))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets.

    Of overlapping spans the union is replaced, under the kind of the first.
    """
    def cut(spans):
        reached = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        pieces = F.transform(F.arrays_zip(spans.alias("s"), reached.alias("upto")), lambda x: F.when(
            x["s"]["start"] >= x["upto"],
            F.concat(F.substring(text, x["upto"] + 1, x["s"]["start"] - x["upto"]), F.lit("<"), F.upper(x["s"]["kind"]), F.lit(">")),
        ).otherwise(F.lit("")))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, cut))


def without_personal_data(docs: DataFrame, text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """``docs`` with personal data in the texts replaced; null texts stay null.

    ``length_column`` is set to the code points of texts that were changed.
    """
    found = docs.withColumn("__pii_spans", personal_spans(F.col(text_column)))
    changed = F.size("__pii_spans") > 0
    new = found.withColumn("__pii_text", redacted(F.col(text_column), F.col("__pii_spans")))
    columns = []
    for c in docs.columns:
        if c == text_column:
            columns.append(F.col("__pii_text").alias(c))
        elif c == length_column:
            columns.append(F.when(changed, F.length("__pii_text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return new.select(*columns)
