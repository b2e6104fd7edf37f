"""Text functions as Column expressions: search normalisation, tokens, character trigrams, hashed features, overlaps, languages.

All but NFC run inside the JVM. NFC has no built-in; every character below U+0300 is stable under it, so only rows with others
go through an Arrow UDF (compose()). search_form() applies it before the rest; the others take texts that are NFC already.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and folds that results depend on.
TASHKEEL = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7-\u06e8\u06ea-\u06ed]"
TATWEEL = "\u0640"
ANNOTATION = "[\u08e3-\u08ff\u0fff\u06de]"
FOLD_FROM = "آأإٱىةکی" + "۰۱۲۳۴۵۶۷۸۹" + "٠١٢٣٤٥٦٧٨٩"
FOLDED = "[\u0600-\u06ff\u08e3-\u08ff\u0fff]"  # holds all that the classes above and FOLD_FROM have
FOLD_TO = "اااايهكي" + "0123456789" + "0123456789"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
URDU, PERSIANATE = "ٹڈڑںۃہھۂۓے", "پچژگکی"
ARABIC_SCRIPT = "[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff]"
STOPWORDS = (
    "the a an of to in on and or is are was were be been it its this that these those for with as by from at he him his they them "
    "their you your we our i not no but so if then which who whom what when will shall may do does did has have had all any one "
    "also there here"
).split()


@F.pandas_udf(StringType())
def _recomposed(s: pd.Series, form: pd.Series) -> pd.Series:
    return s.str.normalize(form.iloc[0]) if len(s) else s


def recompose(text: Column, form: str) -> Column:
    """A Unicode normal form."""
    return _recomposed(text, F.lit(form))


def beyond_ascii(text: Column) -> Column:
    """Told by the lengths, without a search."""
    return F.octet_length(text) != F.length(text)


def compose(text: Column) -> Column:
    """Unicode NFC. Only texts with characters that it may change leave the JVM."""
    needs = F.when(beyond_ascii(text) & text.rlike("[^\\x{0}-\\x{2ff}]"), text)
    return F.coalesce(recompose(needs, "NFC"), text)


def strip_tashkeel(text: Column) -> Column:
    return F.regexp_replace(text, TASHKEEL, "")


def strip_tatweel(text: Column) -> Column:
    return F.replace(text, F.lit(TATWEEL), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of space as one, none at the ends. A single plain space between words is no match, so most texts are searched only."""
    return F.trim(F.regexp_replace(text, f" {SPACE}+|[{SPACE[1:-1]}&&[^ ]]{SPACE}*", " "))


def normalize(text: Column, keep_marks: bool = False) -> Column:
    """Folded Arabic letters and digits, no elongation or annotation marks, single spaces. The text is NFC already."""
    out = F.regexp_replace(strip_tatweel(text), ANNOTATION, "")
    out = out if keep_marks else strip_tashkeel(out)
    return collapse(F.when(beyond_ascii(text) & text.rlike(FOLDED), F.translate(out, FOLD_FROM, FOLD_TO)).otherwise(text))


def normalize_for_search(text: Column) -> Column:
    return F.lower(normalize(text))


def search_form(text: Column) -> Column:
    """normalize_for_search() of a text in any normal form. Not for use within lambdas, as composing takes an Arrow UDF."""
    return normalize_for_search(compose(text))


def tokens(normal: Column) -> Column:
    """Of a normalised text."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def trigrams(normal: Column) -> Column:
    """Of a normalised text with spaces as _; shorter texts are their own only gram, an empty one has none."""
    u = F.translate(normal, " ", "_")
    return F.when(F.length(u) >= 3, F.regexp_extract_all(u, F.lit("(?s)(?=(...))"), F.lit(1))).when(F.length(u) > 0, F.array(u)).otherwise(F.array().cast("array<string>"))


def bucket(feature: Column, dim: int) -> Column:
    """The first four bytes of md5, big-endian, modulo dim."""
    return (F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long") % dim).cast("int")


def sign(feature: Column) -> Column:
    """+1 if the low bit of md5's fifth byte is set, else -1."""
    return F.when(F.substring(F.md5(feature), 10, 1).isin(list("13579bdf")), 1).otherwise(-1)


def content_tokens(normal: Column) -> Column:
    """Distinct tokens of two characters or more that aren't function words."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_except(F.filter(F.split(normal, " "), lambda t: F.length(t) > 1), stop)


def content_overlap(a: Column, b: Column) -> Column:
    """Share of a's content tokens that b has; 1 if a has none. Both are arrays of content_tokens()."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has; 0 if a has none."""
    own = F.array_distinct(a)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, b)) / F.size(own))


def detect_language(text: Column) -> Column:
    """Letters are counted only where there are Arabic ones; else one Latin letter tells."""
    latin, arabic = (F.length(text) - F.length(F.regexp_replace(text, f"{c}+", "")) for c in ("[A-Za-z]", ARABIC_SCRIPT))
    only_latin = ~(beyond_ascii(text) & text.rlike(ARABIC_SCRIPT))
    return (F.when(text.isNull(), "unknown").when(only_latin, F.when(text.rlike("[A-Za-z]"), "en").otherwise("unknown")).when(latin >= arabic, "en")
            .when(text.rlike(f"[{URDU}]"), "ur").when(text.rlike(f"[{PERSIANATE}]"), "fa").otherwise("ar"))


def language_name(code: Column) -> Column:
    names = {"en": "English", "ar": "Arabic", "fa": "Persian", "ur": "Urdu"}
    out = F.lit("Unknown")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def cross_lingual(code: Column) -> Column:
    return F.coalesce(code.isin("fa", "ur"), F.lit(False))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(collapse_edges(text), rf"(?<=[.!?]){SPACE}+"), collapse_edges), lambda s: s != "")


def collapse_edges(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def markers(text: Column) -> Column:
    """Citation markers [n], in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))


def boilerplate(sentence: Column) -> Column:
    return sentence.rlike(r"(?i)^(according to|based on|the (retrieved |available )?evidence|in (summary|conclusion)|the evidence (does not|is insufficient))")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers of one size; 0 if one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    na, nb = size(a), size(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in size"))).when((na == 0) | (nb == 0), 0.0).otherwise(dot / (na * nb))
