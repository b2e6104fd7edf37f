"""Answers and claims as JSON: written with all their fields, read strictly.

Reading is Column code: a record with a field that isn't known, a value of another kind or an unknown level is told with its place in the record, such as
claims[1].citations[0].pages, and read_answers() refuses it; nothing is dropped in silence as Spark's own JSON reader would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.citations import EVIDENCE_TYPES, RANK, VIEW_STATUS
from .corpus import CITATION

TEXTS = T.ArrayType(T.StringType())
CLAIM = T.StructType([T.StructField(n, T.StringType()) for n in ("statement", "evidence_type", "confidence", "view_status")] + [T.StructField("citations", T.ArrayType(CITATION)), T.StructField("asserted_as_fact", T.BooleanType())])
ANSWER = T.StructType([T.StructField("question", T.StringType()), T.StructField("sub_questions", TEXTS), *[T.StructField(n, T.StringType()) for n in ("query_language", "answer_language", "refined_query", "summary", "generated_on")],
                       T.StructField("claims", T.ArrayType(CLAIM)), T.StructField("caveats", TEXTS)])
ALLOWED = {"evidence_type": EVIDENCE_TYPES, "confidence": tuple(RANK), "view_status": VIEW_STATUS}


def to_json(answer: Column) -> Column:
    """The JSON of a struct of ANSWER's fields; those it lacks are null, and null fields are written."""
    return F.to_json(answer.cast(ANSWER), {"ignoreNullFields": "false"})


def _raw(kind: T.StructType) -> T.StructType:
    """The fields, each as its JSON; arrays as arrays of it."""
    return T.StructType([T.StructField(f.name, TEXTS if isinstance(f.dataType, T.ArrayType) else T.StringType()) for f in kind])


def _unlike(own: Column, place: Column, kind: T.StructType) -> Column:
    """What is wrong with a JSON object's own fields: an array of texts that begin with the place."""
    at = lambda name: F.concat(place, F.when(place == "", F.lit("")).otherwise("."), name)
    names = F.json_object_keys(own)
    strange = F.transform(F.filter(names, lambda n: ~n.isin(*kind.names)), lambda n: F.concat(at(n), F.lit(": unknown field")))
    fields = F.from_json(own, _raw(kind))
    checks = []
    for f in kind:
        raw = F.get_json_object(own, f"$.{f.name}")
        got = fields[f.name]
        if f.name in ALLOWED:
            checks.append(F.when(got.isNotNull() & ~got.isin(*ALLOWED[f.name]), F.concat(at(F.lit(f.name)), F.lit(": unknown value "), got)))
        elif isinstance(f.dataType, T.ArrayType):
            checks.append(F.when(raw.isNotNull() & ~raw.startswith("["), F.concat(at(F.lit(f.name)), F.lit(": no list"))))
        elif isinstance(f.dataType, T.IntegerType):
            checks.append(F.when(got.isNotNull() & got.try_cast("int").isNull(), F.concat(at(F.lit(f.name)), F.lit(": no whole number"))))
        elif isinstance(f.dataType, T.BooleanType):
            checks.append(F.when(got.isNotNull() & ~got.isin("true", "false"), F.concat(at(F.lit(f.name)), F.lit(": neither true nor false"))))
        else:
            checks.append(F.when(raw.isNotNull() & raw.rlike(r"^[\[{]") & F.from_json(own, f"{f.name} variant")[f.name].isNotNull() & F.schema_of_variant(F.from_json(own, f"{f.name} variant")[f.name]).rlike("^(ARRAY|OBJECT)"), F.concat(at(F.lit(f.name)), F.lit(": no text"))))
    return F.when(names.isNull(), F.array(F.concat(F.when(place == "", F.lit("record")).otherwise(place), F.lit(": no object")))).otherwise(F.concat(strange, F.filter(F.array(*checks), lambda c: c.isNotNull())))


def problems(value: Column) -> Column:
    """Array of what keeps a JSON text from being an answer; empty, if it's one."""
    none = F.array().cast("array<string>")
    parts = lambda own, kind, name: F.coalesce(F.from_json(own, _raw(kind))[name], none)
    number = lambda name, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))

    def of_claim(claim: Column, i: Column) -> Column:
        cited = F.transform(parts(claim, CLAIM, "citations"), lambda c, j: _unlike(c, F.concat(number("claims", i), F.lit("."), number("citations", j)), CITATION))
        return F.concat(_unlike(claim, number("claims", i), CLAIM), F.flatten(cited))

    return F.concat(_unlike(value, F.lit(""), ANSWER), F.flatten(F.transform(parts(value, ANSWER, "claims"), of_claim)))


def read_answers(rows: DataFrame, value: str = "value", place: str | None = None) -> DataFrame:
    """The fields of the answers in rows(value[, place]), in place of the text. A text that isn't an answer fails the query; the error names the row's place, if
    given, and the first place in the record that is wrong."""
    wrong = F.get(problems(F.coalesce(F.col(value), F.lit(""))), F.lit(0))
    where = F.concat(F.col(place).cast("string"), F.lit(": ")) if place else F.lit("")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(where, wrong))).otherwise(F.col(value))
    return rows.withColumn("_a", F.from_json(checked, ANSWER)).select(*[c for c in rows.columns if c != value], "_a.*")
