"""Answer text: extraction, the three normalisation dialects, token F1, refusals, and small string tools.

Everything is built-in expressions, so it runs inside the JVM; the one exception is the stemmed F1 (``stem``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space and ASCII punctuation as the dialects see them.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_WORD = r"[\p{L}\p{N}_]"


def text(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def multiline(c: Column) -> Column:
    """Line ends as LF, each line trimmed, blank ends removed."""
    lines = F.split(F.regexp_replace(text(c), r"\r\n?", "\n"), "\n")
    return strip(F.array_join(F.transform(lines, strip), "\n"))


# --------------------------------------------------------------------------------------- normalisation


def normalize_d1(c: Column) -> Column:
    """Lower case; a, an, the, and dropped; ``_`` and points between digits kept, other punctuation is space."""
    t = F.regexp_replace(F.lower(text(c)), rf"(?<!{_WORD})(?:a|an|the|and)(?!{_WORD})", " ")
    return _without_punctuation(t)


def normalize_d2(c: Column) -> Column:
    """As the first dialect, but an article goes only before white space and a word, and ``and`` stays."""
    t = F.regexp_replace(F.lower(text(c)), rf"(?<!{_WORD})(?:a|an|the){WS}+(?={_WORD})", " ")
    return _without_punctuation(t)


def _without_punctuation(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?<!\p{Nd})\.|\.(?!\p{Nd})", " ")
    return collapse(F.regexp_replace(t, r"[!\"#$%&'()*+,\-/:;<=>?@\[\\\]^`{|}~]", " "))


def normalize_d3(c: Column) -> Column:
    """``.`` and ``/`` kept between digits, other punctuation and ``_`` are space; ``a`` dropped before a Latin word,
    an and the always."""
    t = F.regexp_replace(F.lower(text(c)), r"(?<!\p{Nd})[./]|[./](?!\p{Nd})", " ")
    t = F.regexp_replace(t, r"[!\"#$%&'()*+,\-:;<=>?@\[\\\]^_`{|}~]", " ")
    t = F.regexp_replace(t, rf"(?<!{_WORD})a(?={WS}+[a-z])", " ")
    return collapse(F.regexp_replace(t, rf"(?<!{_WORD})(?:an|the)(?!{_WORD})", " "))


def tokens(normalized: Column) -> Column:
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def _with(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def histogram(values: Column) -> Column:
    """(x, n) of the distinct values, in their order: sorted once, and read once for the starts of their runs."""

    def of(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: (e["i"] == 0) | (F.get(s, e["i"] - 1) != e["x"]))
        length = lambda t: F.transform(t, lambda e, k: F.struct(e["x"].alias("x"), (F.coalesce(F.get(t, k + 1)["i"], F.size(s)) - e["i"]).alias("n")))
        return _with(starts, length)

    return _with(F.array_sort(values), of)


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets: of both histograms in one order, equal values are neighbours."""

    def of(h: Column) -> Column:
        here = F.filter(F.sequence(F.lit(0), F.size(h)), lambda k: F.get(h, k)["x"] == F.get(h, k + 1)["x"])
        return F.aggregate(here, F.lit(0), lambda n, k: n + F.least(F.get(h, k)["n"], F.get(h, k + 1)["n"]))

    return _with(F.array_sort(F.concat(histogram(a), histogram(b))), of)


#: Product of two token counts up to which comparing every token with every other is quicker than sorting; the result is the same.
SHORT_PAIR = 1024


def _common_of_short(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.array_intersect(a, b),
        F.lit(0),
        lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )


def f1_of_tokens(a: Column, b: Column, empty: str = "zero") -> Column:
    """F1 of two token multisets. ``empty``: ``zero`` gives 0 if a side is empty, ``equal`` 1 if both are."""
    both = F.when(F.size(a) * F.size(b) > SHORT_PAIR, common_tokens(a, b)).otherwise(_common_of_short(a, b)).cast("double")
    p, r = both / F.size(a), both / F.size(b)
    none = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0) if empty == "equal" else F.lit(0.0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), none).when(both == 0, 0.0).otherwise(2 * p * r / (p + r))


def best(references: Column, score) -> Column:
    """Largest score over an array of references; 0 without any."""
    return F.coalesce(F.array_max(F.transform(references, score)), F.lit(0.0))


# ------------------------------------------------------------------------------------------ extraction

_BLOCK = r"(?s)<answer>\s*(.*?)\s*</answer>"


def without_tool_responses(c: Column) -> Column:
    return F.regexp_replace(text(c), r"(?is)<tool_response>.*?</tool_response>", "")


def final_segment(c: Column) -> Column:
    """What follows the last closed tool response."""
    return F.regexp_replace(text(c), r"(?is)^.*</tool_response>", "")


def tagged_answer(c: Column) -> Column:
    """STRUCT(answer, valid): the one answer block, if it is the last thing in the final segment."""
    policy, final = without_tool_responses(c), final_segment(c)
    found = F.regexp_extract_all(final, F.lit(_BLOCK), 1)
    valid = (
        (F.regexp_count(policy, F.lit(r"(?i)</?answer\b")) == 2)
        & (F.regexp_count(policy, F.lit(_BLOCK)) == 1)
        & (F.size(found) == 1)
        & F.regexp_like(final, F.lit(r"(?s)</answer>\s*$"))
    )
    return F.struct(F.when(valid, collapse(F.get(found, F.lit(0)))).alias("answer"), valid.alias("valid"))


def evidence(c: Column) -> Column:
    """Non-empty bodies of the tool responses, in order."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?is)<tool_response>(.*?)</tool_response>"), 1)
    return F.filter(F.transform(found, strip), lambda x: x != "")


def answer_model_output(c: Column) -> Column:
    """STRUCT(answer, outcome): empty_response, strict_tagged, recovered_tagged, empty_tagged or plain_text_wrapped."""
    raw = strip(text(c))
    strict = tagged_answer(raw)
    blocks = F.filter(F.transform(F.regexp_extract_all(raw, F.lit("(?i)" + _BLOCK), 1), collapse), lambda x: x != "")
    plain = collapse(F.regexp_replace(raw, r"(?i)</?answer\b[^>]*>", ""))
    ok = strict["valid"] & (F.coalesce(strict["answer"], F.lit("")) != "")
    outcome = (
        F.when(raw == "", "empty_response").when(ok, "strict_tagged").when(F.size(blocks) > 0, "recovered_tagged").when(plain == "", "empty_tagged").otherwise("plain_text_wrapped")
    )
    answer = F.when(raw == "", "").when(ok, strict["answer"]).when(F.size(blocks) > 0, F.get(blocks, F.size(blocks) - 1)).otherwise(plain)
    return F.struct(answer.alias("answer"), outcome.alias("outcome"))


def split_final_answer(c: Column) -> Column:
    """STRUCT(prefix, answer): the text before the one valid answer block; nulls if there is none."""
    t = text(c)
    ok = tagged_answer(c)["valid"]
    at = F.length(t) - F.length(final_segment(c)) + F.regexp_instr(final_segment(c), F.lit("<answer>"))
    body = strip(F.get(F.regexp_extract_all(final_segment(c), F.lit(_BLOCK), 1), F.lit(0)))
    return F.struct(F.when(ok, F.substring(t, F.lit(1), at - 1)).alias("prefix"), F.when(ok, body).alias("answer"))


def references(ground_truth: Column) -> Column:
    """The non-empty answers of a ground truth: JSON ``{"answers": [...]}``, ``{"answer": ...}``, a JSON list or value,
    or the raw text."""
    v = F.try_parse_json(ground_truth)
    as_list = lambda p: F.try_variant_get(v, p, "array<string>")
    one = F.try_variant_get(v, "$.answer", "string")
    whole = F.try_variant_get(v, "$", "map<string,variant>")
    raw = F.coalesce(
        as_list("$.answers"),
        F.when(whole.isNotNull(), F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))),
        as_list("$"),
        F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(F.try_variant_get(v, "$", "string"))),
        F.array(ground_truth),
    )
    return F.filter(F.transform(raw, strip), lambda x: x.isNotNull() & (x != ""))


# What counts as an answer that there is not enough information.
INSUFFICIENT = (
    r"\b(?:in)?sufficient information\b",
    r"\bnot enough (?:information|context|details|data)\b",
    r"\bcannot (?:determine|answer|provide|find|identify)\b",
    r"\bunable to (?:determine|answer|provide|find|identify)\b",
    r"\b(?:i )?(?:do not|don't) (?:know|have enough information)\b",
    r"\b(?:no|without) (?:information|context|details|data)\b",
    r"\b(?:does not|doesn't) provide (?:enough|sufficient)\b",
    r"\bcannot be determined\b",
    r"\bunanswerable\b",
    r"\b(?:lack|lacking) (?:information|context|details)\b",
    r"\bnone\b",
    r"^\s*n/a\s*$",
    r"^\s*unknown\s*$",
)


def is_insufficient(c: Column) -> Column:
    t = collapse(F.lower(text(c)))
    return (t == "") | F.regexp_like(t, F.lit("|".join(INSUFFICIENT)))


def tool_calls_valid(c: Column, required: bool = False) -> Column:
    """Balanced tool-call tags; each body a JSON object that names a known tool and has its non-blank arguments."""
    policy = without_tool_responses(c)
    bodies = F.regexp_extract_all(policy, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), 1)

    def good(b: Column) -> Column:
        v = F.try_parse_json(b)
        get = lambda p: F.coalesce(strip(F.try_variant_get(v, p, "string")), F.lit(""))
        name = get("$.name")
        filled = (get("$.arguments.retrieval_query") != "") & ((name != "runtime_memory") | ((get("$.arguments.instruction") != "") & (get("$.arguments.model") != "")))
        return name.isin("retrieve_memory", "runtime_memory") & filled

    balanced = F.regexp_count(policy, F.lit(r"(?i)</?tool_call\b")) == 2 * F.size(bodies)
    ok = balanced & F.forall(bodies, good)
    return ok & (F.size(bodies) > 0) if required else ok


def answer_format_valid(c: Column, ground_truth: Column) -> Column:
    """A tagged non-empty answer; for a multiple-choice truth one letter among its valid choices."""
    t = tagged_answer(c)
    v = F.try_parse_json(ground_truth)
    mcq = F.lower(strip(text(F.try_variant_get(v, "$.variant", "string")))) == "mcq"
    choices = F.transform(F.coalesce(F.try_variant_get(v, "$.valid_choices", "array<string>"), F.array().cast("array<string>")), lambda x: F.upper(strip(x)))
    letter = F.upper(strip(text(t["answer"])))
    filled = t["valid"] & (text(t["answer"]) != "")
    return filled & (~mcq | (letter.rlike("^[A-Z]$") & F.array_contains(choices, letter)))


# ------------------------------------------------------------------------------------------ small tools


def metric_component(c: Column) -> Column:
    """Anything but ``[A-Za-z0-9_.-]`` as one ``_``, none at the ends; ``unknown`` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(text(c), r"[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(t == "", "unknown").otherwise(t)


def identifier(c: Column) -> Column:
    return F.replace(F.lower(strip(text(c))), F.lit("-"), F.lit("_"))


def fixed(c: Column, digits: int) -> Column:
    """Fixed digits, ``N/A`` for null and non-finite values."""
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(ok, F.format_string(f"%.{digits}f", c)).otherwise("N/A")


def redacted(c: Column, limit: int = 1000) -> Column:
    """Without keys and bearer tokens, at most ``limit`` characters."""
    t = F.regexp_replace(text(c), r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[redacted]")
    t = F.regexp_replace(t, r"(?i)((?:api[_-]?key|token|secret)\s*[=:]\s*)[^\s,;&]+", "$1[redacted]")
    return F.substring(t, 1, limit)


def fingerprint(ids: Column, texts: Column) -> Column:
    """SHA-256 over id NUL text, entries closed by the record separator."""
    parts = F.zip_with(ids, texts, lambda i, t: F.concat(text(i), F.lit("\0"), text(t), F.lit("\x1e")))
    return F.sha2(F.array_join(parts, ""), 256)


def first_replaced(c: Column, old: Column, new: Column) -> Column:
    """The first occurrence of ``old`` replaced, literally."""
    at = F.call_function("instr", c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), new, F.substring(c, at + F.length(old), F.length(c)))).otherwise(c)


def image_caption_block(images: Column) -> Column:
    """One line ``- id: caption`` per image with an id."""
    kept = F.filter(images, lambda i: strip(text(i["id"])) != "")
    return F.array_join(F.transform(kept, lambda i: F.concat(F.lit("- "), strip(text(i["id"])), F.lit(": "), strip(text(i["caption"])))), "\n")
