"""Cleaning and building text columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fifty states, abbreviation and name.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}

# Company forms that lose their dot.
COMPANY_FORMS = ("LLC", "CO", "INC")


def place_words(states: dict[str, str] = STATES) -> list[str]:
    """Upper-case abbreviations and names, longest first.

    Java takes the first alternative that fits, so the longer word must come
    first or ``- ALABAMA`` would lose only ``- AL``.
    """
    words = {w.upper() for pair in states.items() for w in pair}
    return sorted(words, key=lambda w: (-len(w), w))


def place_pattern(words: Sequence[str] | None = None) -> str:
    return "[-;] (?:" + "|".join(words or place_words()) + ")"


def status_tail(c: Column) -> Column:
    """Upper-cased text from the first ``- `` to the end, dash kept; null when absent."""
    tail = F.regexp_extract(F.upper(c), r"-\s(.*)$", 0)
    return F.when(tail != "", tail)


def after_dash(c: Column) -> Column:
    """Text after the first ``- ``, case kept; null when absent."""
    return F.when(c.rlike(r"-\s"), F.regexp_extract(c, r"-\s(.*)$", 1))


def clean_company_name(
    c: Column, places: Sequence[str] | None = None, word_bounded: bool = False
) -> Column:
    """Company name without place tails, legal forms and closing punctuation.

    By default `` CO`` goes wherever it starts a word (``ABC COMPANY`` becomes
    ``ABCMPANY``); ``word_bounded`` removes whole words only.
    """
    forms = "|".join(COMPANY_FORMS)
    end = r"(?![\p{L}\p{N}_])" if word_bounded else ""
    name = F.regexp_replace(F.upper(c), place_pattern(places), "")
    name = F.regexp_replace(name, f"&NDASH| (?:{forms}){end}", "")
    return F.regexp_replace(F.regexp_replace(name, r"\p{Punct}+$", ""), r"^\s+|\s+$", "")


def undot_company_form(c: Column) -> Column:
    """Drop the dot after LLC, CO or INC."""
    return F.regexp_replace(c, "(" + "|".join(COMPANY_FORMS) + r")\.", "$1")


def squeeze_upper(c: Column) -> Column:
    """Trimmed, upper-cased, inner whitespace collapsed to one space."""
    return F.regexp_replace(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), r"\s+", " ")


def letters_upper(c: Column) -> Column:
    """Upper-cased with all punctuation removed."""
    return F.upper(F.regexp_replace(c, r"\p{Punct}", ""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def blank_to(c: Column, value: str | None) -> Column:
    """Null or blank text becomes ``value``."""
    return F.when(is_blank(c), F.lit(value)).otherwise(c)


def none_text_to_null(c: Column, words: Sequence[str] = ("None",)) -> Column:
    return F.when(~c.isin(list(words)), c)


def join_names(*parts: Column) -> Column:
    """Parts joined by one space, null as empty: a missing middle leaves two spaces."""
    spaced: list[Column] = []
    for i, part in enumerate(parts):
        spaced += ([F.lit(" ")] if i else []) + [F.coalesce(part, F.lit(""))]
    return F.concat(*spaced)


def address_piece(c: Column, kind: str) -> Column:
    """One address part as text: missing values, negative numbers and dates are empty."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.lit("")
    text = F.coalesce(c.cast("string"), F.lit(""))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.when(c < 0, F.lit("")).otherwise(text)
    return F.when(F.trim(text) == "", F.lit("")).otherwise(text)


def full_address(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """``street, city state zip`` from address pieces."""
    return F.concat(street, F.lit(", "), city, F.lit(" "), state, F.lit(" "), zip_code)


def strict_address(*parts: Column) -> Column:
    """Parts joined by one space; null when any part is null."""
    spaced: list[Column] = []
    for i, part in enumerate(parts):
        spaced += ([F.lit(" ")] if i else []) + [part]
    return F.concat(*spaced)


def address_id(*parts: Column) -> Column:
    return F.lower(F.concat(*parts))


def money(c: Column, kind: str = "string") -> Column:
    """``$1,234.50`` as a double; numeric input passes through, junk is null."""
    if kind != "string":
        return c.cast("double")
    return F.regexp_replace(c, r"[$,]", "").try_cast("double")


def split_once(c: Column, sep: str = "_") -> tuple[Column, Column]:
    """Text before and after the first ``sep``; the second is null without one."""
    at = F.instr(c, sep)
    head = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    tail = F.when(at > 0, F.substring(c, at + len(sep), F.length(c)))
    return head, tail


def before_dot(c: Column) -> Column:
    return F.regexp_replace(c, r"\..*", "")


def zero_pad(c: Column, width: int = 2) -> Column:
    """Left-padded code; longer codes stay whole."""
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def strip_breaks(c: Column, with_: str = " ") -> Column:
    return F.regexp_replace(c, r"[\r\n]+", with_)


def strip_dashes(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def readable_name(label: Column, concept: Column, lead: str = "Estimate!!Total!!") -> Column:
    """``acs_<label>_<concept>``: lead text removed, spaces and parentheses to ``_``."""
    return F.concat(
        F.lit("acs_"),
        F.replace(label, F.lit(lead), F.lit("")),
        F.lit("_"),
        F.regexp_replace(concept, r"\s+|\(|\)", "_"),
    )


def composite_id(*parts: Column, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def first_present(sources: Sequence[tuple[Column, str]], none_label: str) -> tuple[Column, Column]:
    """First non-null source and the label of the source that gave it."""
    value = F.coalesce(*[c for c, _ in sources])
    label = reduce(
        lambda chain, s: chain.when(s[0].isNotNull(), F.lit(s[1])),
        sources[1:],
        F.when(sources[0][0].isNotNull(), F.lit(sources[0][1])),
    ).otherwise(F.lit(none_label))
    return value, label


def label_by_pattern(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern found in ``c``; the order of ``rules`` decides."""
    chain = F.when(c.rlike(rules[0][0]), F.lit(rules[0][1]))
    for pattern, label in rules[1:]:
        chain = chain.when(c.rlike(pattern), F.lit(label))
    return chain.otherwise(F.lit(default))


# Model names in review tables, most specific first.
MODEL_LABELS = (
    ("random_forest_1000", "RF: deep"),
    ("random_forest_100", "RF: shallow"),
    ("l2", "Ridge"),
    ("l1", "Lasso"),
    ("ada", "Adaboost"),
    ("gb_shallow", "GB: shallow"),
    ("gb", "GB: deep"),
    ("dt_shallow", "DT: shallow"),
)
MODEL_DEFAULT = "DT: deep"

# Words that mark an opponent as an institution, not an employer.
INSTITUTIONS = (
    "Social Security Administration",
    "Department of Labor",
    "Workforce",
    "Department",
    "Dept",
    "U.S. Immigration and Customs Enforcement",
    "United States Customs and Border Protection",
    "United States Environmental Protection Agency",
    "United States Immigration and Naturalization Service",
    "United States of America",
    "Texas Attorney General",
    "Texas Employment Commission",
    "US Citizenship And Immigration Services",
    "Texas Unemployment Commission",
    "workforce",
)

# Spanish words that mark a section as a translation.
SPANISH_MARKERS = (
    "compensación", "ocupación", "pago", "transporte", "reglas", "contrato",
    "horastrabajadores", "parte", "tarifas", "cuartos", "trabajo", "registros", "adicionales",
    "comidas", "empleo", "terminación", "vivienda", "empleador", "frecuencia", "producción",
    "liquidación", "comida", "herramientas", "prueba", "diaria", "parado", "cobertura",
    "proporcionados", "abandono", "deducciones", "causa", "garantías", "divulgación",
    "política", "disciplina", "despidos", "derechos", "imposibilidad", "detalles", "bloqueo",
    "ganancias", "pedidos", "oportunidad",
)


def contains_word_of(c: Column, words: Sequence[str]) -> Column:
    """Case-sensitive: does any of the words occur as a substring? Null stays null."""
    # plain substring searches: far cheaper than one alternation over long texts
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])
