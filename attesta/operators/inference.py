"""Model fallback for elements that no rule covers. Off unless a model function is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import cut
from ..functions.matching import any_of, short_sha1, strip
from ..packs import RulePack
from ..schemas import MODEL_CACHE, MODEL_FAILURE, MODEL_RESPONSE
from ..sources.tables import append_table, materialise
from .claims import QUOTE_LENGTH, classify, emission_order, keep_first_claim
from .elements import CLAIM_TYPE, TEXT_FIELDS, explode_elements

# Ceiling and default of a model's confidence, and text lengths in prompts (None: uncut).
CONFIDENCE_CAP = 0.75
CONFIDENCE_DEFAULT = 0.5
PROMPT_TEXT_LENGTH = 500
DESCRIPTION_LENGTH = 4000

# A number as text, and the texts that count as more than the ceiling.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"
TOO_LARGE = r"^([+-]?nan|[+]?inf(inity)?)$"

CLASSIFY_PROMPT = """You sort short notes from facility listings. Below is one note and the place it came from.

Which single service from this list does the note say the facility has?
{taxonomy}

If none of them is named, the answer is other. Go by the words of the note only.

Reply with JSON, without any further text, in this form:
{"claim_value": "service or other", "confidence": 0.0}
where confidence lies between 0 and 1: near 1 for a plain statement, near 0 for a guess.

Place: {source_field}
Note: {text}
"""

EXTRACT_PROMPT = """Read the listing of one facility and write down what it says it offers.

Services with fixed names: {taxonomy}

Write a JSON array; an empty one if the listing offers nothing. Each entry has the keys
claim_type (capability, procedure or equipment),
claim_value (a fixed name for a capability, or other; for the rest the wording in lower case),
claim_raw (the wording as it stands),
source_field (description, capability, procedure or equipment),
source_text_span (up to 200 characters around the wording),
extraction_confidence (between 0 and 1).
Leave out what is not stated.

Name: {name}
Description: {description}
Capability: {capability}
Procedure: {procedure}
Equipment: {equipment}
"""


def _filled(template: str, values: dict[str, Column]) -> Column:
    """Put column values into a template; braces inside the values stay as they are."""
    parts, rest = [], template
    for name, value in values.items():
        head, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(head), F.coalesce(value, F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def classify_prompt(
    source_field: Column, text: Column, pack: RulePack, text_length: int | None = PROMPT_TEXT_LENGTH
) -> Column:
    return _filled(
        CLASSIFY_PROMPT,
        {
            "taxonomy": F.lit(", ".join(pack.taxonomy)),
            "source_field": source_field,
            "text": cut(text, text_length),
        },
    )


def extract_prompt(
    name: Column, description: Column, capability: Column, procedure: Column, equipment: Column,
    pack: RulePack, description_length: int | None = DESCRIPTION_LENGTH,
) -> Column:
    return _filled(
        EXTRACT_PROMPT,
        {
            "taxonomy": F.lit(", ".join(pack.taxonomy)),
            "name": name,
            "description": cut(description, description_length),
            "capability": capability,
            "procedure": procedure,
            "equipment": equipment,
        },
    )


def unmatched_elements(entities: DataFrame, pack: RulePack) -> DataFrame:
    """Text elements that no rule fires on."""
    return explode_elements(entities).filter(
        F.col("source_field").isin(*TEXT_FIELDS)
        & ~F.col("element").rlike(any_of(pack.patterns))
    )


def parse_response(raw: Column, taxonomy: tuple[str, ...]) -> Column:
    """struct<claim_value, confidence> from a model answer, NULL if there is none.

    The whole answer is tried first, then each flat object inside it. A term outside the
    taxonomy becomes ``other``; an unreadable confidence becomes the default. An answer
    that is a JSON array gives nothing.
    """
    tries = F.concat(F.array(raw), F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0)))

    def parsed(text: Column) -> Column:
        core = strip(text)
        whole = F.startswith(core, F.lit("{")) & F.endswith(core, F.lit("}"))
        return F.from_json(F.when(whole, text), "map<string,string>", {"allowSingleQuotes": "false"})

    def last(obj: Column, key: str) -> Column:
        """The value of a key, of a repeated key the last; NULL without the key."""
        named = F.filter(F.map_entries(obj), lambda e: e["key"] == key)
        return F.try_element_at(named, F.lit(-1))

    def fields(obj: Column) -> Column:
        term = last(obj, "claim_value")
        return F.struct(
            F.when(term.isNotNull(), F.lower(strip(F.coalesce(term["value"], F.lit("none"))))).alias("term"),
            F.lower(strip(last(obj, "confidence")["value"])).alias("given"),
        )

    def answer(f: Column) -> Column:
        term, given = f["term"], f["given"]
        plain = F.when(given.rlike(NUMBER), F.replace(given, F.lit("_"), F.lit("")).try_cast("double"))
        number = F.coalesce(
            F.when(given == "true", F.lit(1.0)).when(given == "false", F.lit(0.0)),
            F.when(given.rlike(TOO_LARGE), F.lit(1.0)).when(given.rlike("^-inf(inity)?$"), F.lit(0.0)),
            plain,
            F.lit(CONFIDENCE_DEFAULT),
        )
        return F.struct(
            F.when(term.isin(*taxonomy), term).otherwise(F.lit("other")).alias("claim_value"),
            F.greatest(F.lit(0.0), F.least(F.lit(CONFIDENCE_CAP), number)).alias("confidence"),
        )

    # one step per transform, so that each answer is parsed once
    found = F.filter(F.transform(F.transform(tries, parsed), fields), lambda f: f["term"] != "")
    listed = F.startswith(strip(raw), F.lit("["))
    is_array = listed & F.from_json(F.when(listed, raw), "array<string>").isNotNull()
    return F.when((raw != "") & ~is_array, F.get(F.transform(found, answer), F.lit(0)))


def with_prompt_key(elements: DataFrame, pack: RulePack) -> DataFrame:
    """Add the prompt and its hash; only the hash needs to travel with the elements."""
    prompt = classify_prompt(F.col("source_field"), F.col("element"), pack)
    return elements.withColumn("prompt", prompt).withColumn("prompt_key", F.sha1("prompt"))


def ask_model(prompts: DataFrame, model: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """Distinct (prompt_key, prompt) to (prompt_key, response, error).

    Prompts are asked in batches. A batch that fails, or that comes back with another number of
    answers, is asked again prompt by prompt, so a prompt that fails costs its own answer only
    and says why.
    """

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            answers = model([prompt])
            if len(answers) != 1:
                return None, f"{len(answers)} answers to one prompt"
            return answers[0], None
        except Exception as e:  # whatever a model raises is that prompt's failure
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch["prompt"].tolist()
            try:
                answers = [(a, None) for a in model(asked)]
            except Exception:
                answers = []
            if len(answers) != len(asked):
                answers = [one(p) for p in asked]
            yield pd.DataFrame(
                {
                    "prompt_key": batch["prompt_key"],
                    "response": [a for a, _ in answers], "error": [e for _, e in answers],
                }
            )

    distinct = prompts.groupBy("prompt_key").agg(F.min("prompt").alias("prompt"))
    return distinct.mapInPandas(run, MODEL_RESPONSE)


def failures(answers: DataFrame) -> DataFrame:
    """(prompt_key, error) of the prompts that got no answer."""
    return answers.filter(F.col("error").isNotNull()).select("prompt_key", "error")


def cached_answers(
    prompts: DataFrame, model: Callable[[list[str]], list[str | None]], cache: DataFrame
) -> DataFrame:
    """Answers for all prompts, asking only for those that the cache does not hold."""
    fresh = ask_model(prompts.join(cache.select("prompt_key"), "prompt_key", "left_anti"), model)
    asked = prompts.select("prompt_key").distinct()
    held = cache.select("prompt_key", "response").join(asked, "prompt_key", "left_semi")
    return held.unionByName(fresh, allowMissingColumns=True)


def answers_kept(
    prompts: DataFrame, model: Callable[[list[str]], list[str | None]], cache_table: str
) -> DataFrame:
    """Answers for all prompts; fresh ones are appended to the cache table, failures are not.

    The table is made if it is missing. What comes back is read from it, so nothing is asked twice,
    and a later run asks only for what failed or is new. Failures are in ``<cache_table>_failures``.
    """
    spark = prompts.sparkSession
    for name, columns in ((cache_table, MODEL_CACHE), (f"{cache_table}_failures", MODEL_FAILURE)):
        if not spark.catalog.tableExists(name):
            spark.createDataFrame([], columns).write.saveAsTable(name)
    known = spark.table(cache_table).select("prompt_key")
    fresh = materialise(ask_model(prompts.join(known, "prompt_key", "left_anti"), model), "answers")
    append_table(fresh.filter(F.col("error").isNull()).select("prompt_key", "response"), cache_table)
    append_table(
        failures(fresh).withColumn("asked_at", F.current_timestamp()), f"{cache_table}_failures"
    )
    asked = prompts.select("prompt_key").distinct()
    return spark.table(cache_table).join(asked, "prompt_key", "left_semi")


def model_claims(
    elements: DataFrame, answers: DataFrame, pack: RulePack, model_name: str = "model",
    quote_length: int | None = QUOTE_LENGTH,
) -> DataFrame:
    """Claims from answered prompts; ``elements`` are unmatched elements with a prompt key.

    Terms outside the taxonomy make no claim; their answers are dropped before the join.
    The answer side has one row per prompt, so a prompt shared by very many elements is
    split by the planner's skew handling.
    """
    kind = F.create_map(*[F.lit(x) for kv in CLAIM_TYPE.items() for x in kv])[F.col("source_field")]
    quote = cut(F.col("element"), quote_length)
    named = answers.select(
        "prompt_key", parse_response(F.col("response"), pack.taxonomy).alias("a")
    ).filter(F.col("a").isNotNull() & (F.col("a.claim_value") != "other"))
    parsed = elements.join(named, "prompt_key")
    return keep_first_claim(
        parsed.select(
            "facility_id",
            short_sha1(F.col("facility_id"), kind, F.col("a.claim_value"), F.col("element")).alias("claim_id"),
            kind.alias("claim_type"),
            F.col("a.claim_value").alias("claim_value"),
            quote.alias("claim_raw"),
            "source_field",
            quote.alias("source_text_span"),
            F.col("a.confidence").alias("extraction_confidence"),
            F.lit("llm").alias("extraction_method"),
            F.lit(model_name).alias("llm_model"),
            emission_order(F.col("field_ord"), F.col("elem_ord"), F.lit(0)).alias("claim_ord"),
        )
    )


def classify_with_model(
    entities: DataFrame,
    pack: RulePack,
    model: Callable[[list[str]], list[str | None]] | None = None,
    cache: DataFrame | None = None,
    cache_table: str | None = None,
    model_name: str = "model",
) -> DataFrame:
    """Rule claims, plus model claims for what the rules leave when a model is given.

    With ``cache_table`` answers are kept there and a second run asks nothing again.
    """
    rules = classify(entities, pack)
    if model is None:
        return rules
    left = with_prompt_key(unmatched_elements(entities, pack), pack)
    if cache_table is not None:
        answers = answers_kept(left, model, cache_table)
    else:
        answers = ask_model(left, model) if cache is None else cached_answers(left, model, cache)
    return rules.unionByName(model_claims(left.drop("prompt"), answers, pack, model_name))
