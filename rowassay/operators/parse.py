"""Read rule suites out of free text: find the JSON array, split it, give every rule one status.

JSON is read as Python reads it: of a repeated key the last one counts, and ``NaN``, ``Infinity`` and ``-Infinity`` are numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowassay.operators.rules import (
    BAD_KWARGS, BOUNDS, JSON_ERROR, RULE_SPECS, STATUSES, UNKNOWN, VALID,
)

# Fixed value: a fenced block, optionally marked as JSON.
FENCE = r"(?s)```(?:json)?\s*(.*?)```"


# A bare NaN or infinity outside quotes; everything up to it is passed over from where the last one ended.
_NO_NUMBER = r'\G((?:[^"NI\-]++|"(?:[^"\\]++|\\.)*+"|-(?!Infinity))*+)(NaN|-?Infinity)'
# Such a number is carried as a text that begins with this character of the private use area.
_MARK = "\ue000"
_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def read_json(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add ``into``: the text as a variant, NULL if it is no JSON. Numbers that JSON does not know are texts marked by
    ``_MARK``; a text that uses that character itself is not searched for them."""
    session = df.sparkSession
    before = session.conf.get(_REPEATED_KEYS, "false")
    # Spark takes the setting into the plan when the column is added, so it holds for this column only.
    session.conf.set(_REPEATED_KEYS, "true")
    try:
        marked = F.regexp_replace(text, _NO_NUMBER, rf'$1"{_MARK}$2"')
        again = F.when(F.col(text).rlike("NaN|Infinity") & ~F.col(text).contains(_MARK), F.try_parse_json(marked))
        parsed = df.withColumn(into, F.coalesce(F.try_parse_json(text), again))
        parsed.schema  # analysed while the setting holds
    finally:
        session.conf.set(_REPEATED_KEYS, before)
    return parsed


def _unmarked(json: Column) -> Column:
    """JSON text with marked numbers written bare again."""
    return F.regexp_replace(json, f'"{_MARK}(NaN|-?Infinity)"', "$1")


def extract_array(text: Column) -> Column:
    """From the first ``[`` to the last ``]`` of the first fenced block (of the text, without one)."""
    body = F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    start = F.instr(body, "[")
    back = F.instr(F.reverse(body), "]")
    length = F.char_length(body) - back + 1 - start + 1
    return F.when((start > 0) & (back > 0) & (length > 1), F.substr(body, start, length))


def _spec_table(df: DataFrame) -> DataFrame:
    """The rule types, of a size that Spark knows beforehand: else it would deal all rules out by their few types to join them."""
    def texts(values):
        return F.array(*map(F.lit, values)).cast("array<string>")

    rows = [
        F.struct(F.lit(t).alias("_type"), texts(s.required).alias("_required"), texts(s.accepted).alias("_accepted"), texts(s.any_of).alias("_any"))
        for t, s in RULE_SPECS.items()
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _variant(path: str, source: str = "_item") -> Column:
    return F.try_variant_get(F.col(source), path, "variant")


def parse_rules(responses: DataFrame, text: str = "text") -> DataFrame:
    """One row per rule found in ``text``, beside the other columns of the response.

    A text without a readable array yields one ``json_error`` row and ``json_ok`` false; an empty
    array yields none. Status is the first that applies of: not an object, no type, arguments not
    an object, unknown type, wrong arguments, valid.
    """
    carried = [c for c in responses.columns if c != text]
    items = (
        read_json(responses.withColumn("_array", extract_array(F.col(text))), "_array", "_parsed")
        .withColumn("json_ok", F.col("_parsed").isNotNull())
        .select(
            *carried, "json_ok",
            F.posexplode(
                F.when(F.col("json_ok"), F.expr("try_cast(_parsed as array<variant>)"))
                .otherwise(F.expr("array(cast(null as variant))"))
            ).alias("rule_index", "_item"),
        )
    )
    described = items.select(
        *carried, "json_ok", "rule_index",
        F.coalesce(F.schema_of_variant("_item").startswith("OBJECT"), F.lit(False)).alias("_object"),
        _variant("$.expectation_type").alias("_t"),
        _variant("$.kwargs").alias("_k"),
        F.replace(F.try_variant_get("_item", "$.rationale", "string"), F.lit(_MARK), F.lit("")).alias("rationale"),
    ).withColumns({
        "expectation_type": F.when(
            (F.schema_of_variant("_t") == "STRING") & ~F.expr("try_cast(_t as string)").startswith(_MARK), F.expr("try_cast(_t as string)")
        ),
        "_kwargs_ok": F.col("_k").isNull() | F.schema_of_variant("_k").startswith("OBJECT"),
    }).withColumns({
        "_args": F.when(
            F.col("_kwargs_ok"), F.coalesce(F.expr("try_cast(_k as map<string, variant>)"), F.expr("map()"))
        ),
        "kwargs": F.when(F.col("_kwargs_ok"), F.coalesce(_unmarked(F.expr("try_cast(_k as string)")), F.lit("{}"))),
    })
    given = F.map_keys("_args")
    # A bound that is JSON null is not given.
    usable = F.array(*[
        F.when(F.coalesce(F.schema_of_variant(_variant(f"$.{b}", "_k")) != "VOID", F.lit(False)), F.lit(b)) for b in BOUNDS
    ])
    joined = described.join(_spec_table(responses), F.col("expectation_type") == F.col("_type"), "left")
    fits = (
        (F.size(F.array_except(given, "_accepted")) == 0)
        & (F.size(F.array_except("_required", given)) == 0)
        & ((F.size("_any") == 0) | F.coalesce(F.arrays_overlap("_any", usable), F.lit(False)))
    )
    typed = F.coalesce(F.col("expectation_type") != "", F.lit(False))
    status = (
        F.when(~F.col("json_ok") | ~F.col("_object") | ~typed, JSON_ERROR)
        .when(~F.col("_kwargs_ok"), BAD_KWARGS)
        .when(F.col("_type").isNull(), UNKNOWN)
        .when(~fits, BAD_KWARGS)
        .otherwise(VALID)
    )
    error = (
        F.when(~F.col("json_ok"), "no readable JSON array")
        .when(~F.col("_object"), "the rule is not an object")
        .when(~typed, "no rule type")
        .when(~F.col("_kwargs_ok"), "kwargs is not an object")
        .when(F.col("_type").isNull(), "rule type not in the vocabulary")
        .when(~fits, "arguments do not fit the rule type")
    )
    return joined.select(
        *carried, "json_ok", "rule_index", status.alias("status"), "expectation_type", "kwargs", "rationale",
        error.alias("error"),
    )


def valid_rules(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("status") == VALID)


def status_counts(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Rules per status; all five statuses are always there."""
    return parsed.groupBy(*by).pivot("status", STATUSES).count().na.fill(0, STATUSES)


def suite_summary(responses: DataFrame, parsed: DataFrame, by: list[str], costs: list[str]) -> DataFrame:
    """Per response: identity, rules per status, cost columns."""
    counts = status_counts(parsed, by)
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in STATUSES), F.lit(0))
    return responses.select(*by, *costs).join(counts, by, "left").select(
        *by,
        total.cast("bigint").alias("n_rules_total"),
        *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(f"n_{s}") for s in STATUSES[:-1]],
        *costs,
    )


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order and no space; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def request_key(model: Column, prompt: Column, params: Column, salt: Column) -> Column:
    """Identity of a request: SHA-256 of its canonical JSON. ``params`` is JSON text, in any order of keys."""
    payload = F.struct(
        model.alias("model"), canonical_json(params).alias("params"), prompt.alias("prompt"), salt.alias("salt")
    )
    return F.sha2(F.to_json(payload), 256)


def open_requests(requests: DataFrame, answers: DataFrame, key: str = "request_key") -> DataFrame:
    """Requests that no stored answer covers."""
    return requests.join(answers.select(key), key, "left_anti")


def answered_requests(requests: DataFrame, answers: DataFrame, key: str = "request_key") -> DataFrame:
    return requests.join(answers, key, "inner")
