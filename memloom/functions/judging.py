"""Judge replies: JSON object, score, label, reasoning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memloom.functions.text import strip, text

# Score and label domains.
GRADED = (0.0, 0.25, 0.5, 0.75, 1.0)
BINARY = (0.0, 1.0)
GRADED_LABELS = {0.0: "Incorrect", 0.25: "Poor", 0.5: "Partial", 0.75: "Good", 1.0: "Correct"}
WORLD_LABELS = ("Correct", "Hallucination", "Omission")


def json_object(c: Column) -> Column:
    """The JSON object of a reply as VARIANT: without code fences; if that is no JSON at all, from the first ``{`` to the last ``}``. JSON of
    another kind, such as an array with an object in it, is none: null."""
    bare = F.regexp_replace(strip(text(c)), r"(?i)^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    whole, part = F.try_parse_json(bare), F.try_parse_json(inner)
    return F.when(is_object(whole), whole).when(whole.isNull() & is_object(part), part)


def snapped(score: Column, allowed: tuple[float, ...]) -> Column:
    """The allowed value within 1e-8, else null."""
    hits = F.filter(F.array(*[F.lit(a) for a in allowed]), lambda a: F.abs(a - score) < 1e-8)
    return F.get(hits, F.lit(0))


def quantized(score: Column) -> Column:
    return F.when(score < 0.25, 0.0).when(score < 0.75, 0.5).when(score.isNotNull(), 1.0)


def graded_label(score: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in GRADED_LABELS.items() for x in kv])[score]


def canonical_label(label: Column, allowed: tuple[str, ...]) -> Column:
    low = F.lower(strip(text(label)))
    return F.coalesce(*[F.when(low == a.lower(), a) for a in allowed])


def scoring_rationale(c: Column) -> Column:
    return strip(F.regexp_extract(text(c), r"(?is)\[Scoring Rationale\]\s*:\s*(.*?)(?:\[Score\]|\[JSON\]|$)", 1))


def parsed_reply(c: Column, family: str) -> Column:
    """STRUCT(score, label, reasoning, problem) of a reply. ``family``: ``world`` (label decides), ``binary``, ``graded`` or
    ``reported`` (quantised). ``problem`` names what is wrong with it, null if nothing."""
    v = json_object(c)
    get = lambda p: F.try_variant_get(v, p, "string")
    number = lambda p: F.try_variant_get(v, p, "string").try_cast("double")
    reasoning = strip(text(get("$.reasoning")))
    given_label = F.when(strip(text(get("$.label"))) != "", get("$.label"))
    if family == "world":
        label = canonical_label(F.coalesce(F.nullif(get("$.evaluation_result"), F.lit("")), get("$.label")), WORLD_LABELS)
        score = F.when(label == "Correct", 1.0).when(label.isNotNull(), 0.0)
        supplied = get("$.score")
        clash = (text(supplied) != "") & ~F.coalesce(snapped(supplied.try_cast("double"), BINARY) == score, F.lit(False))
        problem = F.when(v.isNull(), "no object").when(reasoning == "", "no reasoning").when(label.isNull(), "unknown label").when(clash, "score disagrees")
    elif family == "binary":
        # A present answer_score counts, be it null.
        present = F.map_contains_key(F.try_variant_get(v, "$", "map<string,variant>"), F.lit("answer_score"))
        score = snapped(F.when(F.coalesce(present, F.lit(False)), number("$.answer_score")).otherwise(number("$.score")), BINARY)
        label = F.when(score == 1.0, "Correct").when(score.isNotNull(), "Incorrect")
        clash = given_label.isNotNull() & ~F.coalesce(canonical_label(given_label, ("Correct", "Incorrect")) == label, F.lit(False))
        problem = F.when(v.isNull(), "no object").when(score.isNull(), "score out of domain").when(clash, "label disagrees")
        reasoning = F.when(reasoning == "", scoring_rationale(c)).otherwise(reasoning)
    else:
        score = quantized(number("$.score")) if family == "reported" else snapped(number("$.score"), GRADED)
        label = strip(F.coalesce(given_label, graded_label(score)))
        problem = F.when(v.isNull(), "no object").when(score.isNull(), "score out of domain")
    keep = problem.isNull()
    return F.struct(F.when(keep, score).alias("score"), F.when(keep, label).alias("label"), F.when(keep, reasoning).alias("reasoning"), problem.alias("problem"))
