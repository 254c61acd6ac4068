"""Row-level reshaping: prepared rows, evidence, image records, replacements, guards. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memloom.functions.coerce import nonnegative_double, nonnegative_int
from memloom.functions.text import collapse, strip, tagged_answer, text

# ------------------------------------------------------------------------------------------ prepared rows


def with_split(row: Column, split: Column, inner: str = "extra_info") -> Column:
    """A prepared row (a struct) with its split written both at the top and within ``inner``."""
    return row.withField("split", split).withField(f"{inner}.split", split)


def without(row: Column, *names: str) -> Column:
    return row.dropFields(*names)


def chosen_bank(compressed: Column, raw: Column, wanted: Column) -> Column:
    """The compressed bank where it is wanted and there, else the raw one."""
    return F.when(wanted & compressed.isNotNull(), compressed).otherwise(raw)


def question_id(conversation: Column, number: Column, checkpoint: Column | None = None) -> Column:
    """``conv_q0001``, or ``conv:ckpt:Q001`` within a checkpoint."""
    plain = F.format_string("%s_q%04d", conversation, number)
    return plain if checkpoint is None else F.when(checkpoint.isNull(), plain).otherwise(F.format_string("%s:%s:Q%03d", conversation, checkpoint, number))


def ground_truth(answers: Column, question_type: Column | None = None) -> Column:
    """``{"answers": [...]}``, with the type where one is given."""
    fields = [answers.alias("answers")] + ([question_type.alias("question_type")] if question_type is not None else [])
    return F.to_json(F.struct(*fields))


def choice_truth(answer: Column, choices: Column) -> Column:
    """``{"variant": "mcq", "answer": ..., "valid_choices": [...]}`` with the choices' letters in order."""
    return F.to_json(F.struct(F.lit("mcq").alias("variant"), answer.alias("answer"), F.array_sort(F.map_keys(choices)).alias("valid_choices")))


def answer_value(value: Column) -> Column:
    """An answer as text: a JSON list joined by commas, an object as its JSON, else trimmed."""
    v = F.try_parse_json(value)
    items = F.try_variant_get(v, "$", "array<string>")
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    return F.when(is_object, F.try_variant_get(v, "$", "string")).when(items.isNotNull(), F.array_join(F.filter(F.transform(items, strip), lambda x: x != ""), ", ")).otherwise(strip(text(value)))


# ------------------------------------------------------------------------------------ images and evidence


def image_records(images: Column, prefix: str, source: str) -> Column:
    """Image structs with an id (by position where it is blank), a caption (never null) and their source."""
    return F.transform(
        images,
        lambda im, i: im.withField("id", F.coalesce(F.nullif(strip(text(im["id"])), F.lit("")), F.format_string(prefix + "_%04d", i)))
        .withField("caption", strip(text(im["caption"])))
        .withField("source", F.lit(source)),
    )


def is_query_image(image: Column) -> Column:
    ident = text(image["id"])
    return (text(image["source"]) == "query") | (ident == "query_image") | ident.startswith("query_image_")


def evidence_images(retrieved: Column, own: Column) -> Column:
    """The retrieved items' images, then the question's; the first of each id."""
    both = F.concat(F.flatten(retrieved), own)
    ids = F.transform(both, lambda im: text(im["id"]))
    return F.filter(both, lambda im, i: F.array_position(ids, text(im["id"])) == i + 1)


def numbered_evidence(items: Column) -> Column:
    """``[Evidence 1]`` blocks of the non-empty texts, numbered from 1, parted by blank lines."""
    kept = F.filter(F.transform(items, lambda x: strip(text(x))), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x, i: F.concat(F.format_string("[Evidence %d]\n", i + 1), x)), "\n\n")


def direct_result(items: Column, nothing: str = "No memory items.") -> Column:
    """The non-empty texts parted by blank lines, or a fixed text."""
    t = F.array_join(F.filter(F.transform(items, lambda x: strip(text(x))), lambda x: x != ""), "\n\n")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(nothing))


def memory_view(dialogue: Column, preview: Column) -> Column:
    """Dialogue and image preview parted by a blank line; a blank part is left out."""
    return F.concat_ws("\n\n", F.nullif(strip(text(dialogue)), F.lit("")), F.nullif(strip(text(preview)), F.lit("")))


def lacking_preview(df: DataFrame, key: str, preview: str) -> DataFrame:
    """Ids of the items whose preview is blank."""
    return df.filter(strip(text(F.col(preview))) == "").select(key)


def compressed_text(c: Column, placeholder: str = "[empty]") -> Column:
    return F.coalesce(F.nullif(strip(text(c)), F.lit("")), F.lit(placeholder))


# -------------------------------------------------------------------------------------- calls and replies


def call_record(calls: DataFrame) -> DataFrame:
    """A call table in its fixed shape: counts and amounts are never null or negative, flags never null."""
    counts = [c for c in ("prompt_tokens", "completion_tokens", "total_tokens", "num_input_images", "num_input_memory_items") if c in calls.columns]
    amounts = [c for c in ("memory_api_cost", "memory_estimated_latency") if c in calls.columns]
    out = calls
    for c in counts:
        out = out.withColumn(c, nonnegative_int(F.col(c)))
    for c in amounts:
        out = out.withColumn(c, nonnegative_double(F.col(c)))
    return out


def argument_problem(query: Column, model: Column, known: list[str], items: Column, limit: int = 512) -> Column:
    """The first thing wrong with a tool call's arguments, null if nothing is."""
    q = strip(text(query))
    return (
        F.when(q == "", "missing query")
        .when(F.length(q) > limit, "query too long")
        .when(F.regexp_like(q, F.lit(r"(?i)</?answer\b")), "answer tag in query")
        .when(strip(text(model)) == "", "missing model")
        .when(~text(model).isin(known), "unknown model")
        .when(F.coalesce(items, F.lit(0)) <= 0, "no items")
    )


def retryable(status: Column) -> Column:
    """Whether a failed request may be sent again. Codes that mean the request itself is at fault."""
    return ~F.coalesce(status.isin(400, 404, 405, 413, 422), F.lit(False))


def reply_text(response: Column) -> Column:
    """The text of a chat reply: the first choice's content, a list of parts joined by newlines."""
    v = F.try_parse_json(response)
    parts = F.try_variant_get(v, "$.choices[0].message.content", "array<variant>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), lambda x: x.isNotNull()), "\n")
    return F.coalesce(joined, F.try_variant_get(v, "$.choices[0].message.content", "string"), F.lit(""))


def external_result(c: Column, invalid: str = "[invalid result]") -> Column:
    """An external model's text; a fixed text where it is empty or smuggles an answer tag."""
    t = strip(text(c))
    return F.when((t == "") | F.regexp_like(t, F.lit(r"(?i)</?answer\b")), invalid).otherwise(t)


def probe_solution(c: Column) -> Column:
    """The text up to the first closing tag, without tags, as one answer block."""
    head = F.split(text(c), r"(?i)</answer>", 2)[0]
    return F.concat(F.lit("<answer>"), collapse(F.regexp_replace(head, r"(?i)</?answer[^>]*>", " ")), F.lit("</answer>"))


def merged_replacement(rows: DataFrame, replies: DataFrame, key: str, prefix: str, reply: str) -> DataFrame:
    """Rows with a new answer block behind their prefix, joined by key; ``replaced`` tells whether there was a reply. A key with two
    replies is the caller's error and gives two rows."""
    r = replies.select(key, F.col(reply).alias("__reply"))
    out = rows.join(r, key, "left").withColumn("replaced", F.col("__reply").isNotNull())
    solution = F.concat(F.col(prefix), F.lit("<answer>"), F.col("__reply"), F.lit("</answer>"))
    return out.withColumn("solution", F.when(F.col("replaced"), solution).otherwise(F.col(prefix))).drop("__reply")


def composed_reward(performance: Column, format_valid: Column, tool_rewards: Column, base_cost: Column) -> Column:
    """STRUCT(score, cost): performance counts only in a valid format, an invalid one costs 1; cost is the base and what the tools charge."""
    charged = F.aggregate(F.coalesce(tool_rewards, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), -x))
    score = F.when(format_valid, performance).otherwise(F.lit(-1.0))
    return F.struct(score.alias("score"), (charged + nonnegative_double(base_cost)).alias("cost"))


def format_status(solution: Column, calls_valid: Column, errors: Column) -> Column:
    """STRUCT(valid, errors): tags and calls in order; an invalid form counts as one error more."""
    ok = tagged_answer(solution)["valid"]
    return F.struct((ok & calls_valid).alias("valid"), (nonnegative_int(errors) + F.when(calls_valid, 0).otherwise(1)).alias("errors"))


# --------------------------------------------------------------------------------------------- trajectories


def policy_model(answer: Column, recorded: Column, default: str, placeholders: tuple[str, ...] = ("policy_model", "base_model")) -> Column:
    """STRUCT(model, origin): the answer model, else the recorded policy model unless it is a placeholder, else the default."""
    a, r = F.nullif(strip(text(answer)), F.lit("")), F.nullif(strip(text(recorded)), F.lit(""))
    real = r.isNotNull() & ~F.lower(r).isin(list(placeholders))
    model = F.coalesce(a, F.when(real, r), F.lit(default))
    origin = F.when(a.isNotNull(), "answer_model").when(real, "policy_trace_model").otherwise("default_policy_model")
    return F.struct(model.alias("model"), origin.alias("origin"))


def stages(events: DataFrame, group: str, order: list[str], opens: Column) -> DataFrame:
    """Events with the number of the stage they belong to: a stage begins at each event that ``opens`` one; 0 before the first."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("stage", F.sum(opens.cast("int")).over(w))


def reward_on_last(tokens: DataFrame, group: str, position: str, is_response: Column, reward: str) -> DataFrame:
    """Each group's reward on its last response token, 0 elsewhere: an aggregate and a join, no window over the tokens."""
    last = tokens.filter(is_response).groupBy(group).agg(F.max(position).alias("__last"))
    out = tokens.join(last, group, "left")
    return out.withColumn("token_reward", F.when(F.col(position) == F.col("__last"), F.col(reward)).otherwise(F.lit(0.0))).drop("__last")


def sample_text(step: Column, uid: Column, prompt: Column, answer: Column, score: Column) -> Column:
    """A diagnostic block of a rollout."""
    return F.concat_ws("\n", F.format_string("[step %d] %s", step, uid), F.concat(F.lit("prompt: "), collapse(text(prompt))), F.concat(F.lit("answer: "), collapse(text(answer))), F.format_string("score: %.4f", score))


# ------------------------------------------------------------------------------------------------ small


def safe_path(c: Column) -> Column:
    """Whether a path is relative, not empty, and stays inside its root."""
    p = F.replace(text(c), F.lit("\\"), F.lit("/"))
    return (strip(p) != "") & ~p.startswith("/") & ~p.rlike(r"^[A-Za-z]:") & ~p.rlike(r"(?:^|/)\.\.(?:/|$)")


def member(c: Column, allowed: tuple[str, ...]) -> Column:
    """A trimmed lower-case value of a fixed list; an error for others."""
    v = F.lower(strip(text(c)))
    return F.when(v.isin(list(allowed)), v).otherwise(F.raise_error(F.concat(F.lit("not one of " + ", ".join(allowed) + ": "), v)).cast("string"))


def required(c: Column, name: str) -> Column:
    """A trimmed text; an error if it is blank."""
    v = strip(text(c))
    return F.when(v != "", v).otherwise(F.raise_error(F.lit(f"{name} must not be blank")).cast("string"))


def preview(c: Column, n: int = 5) -> Column:
    """The first n of a sorted set."""
    return F.slice(F.array_sort(F.collect_set(c)), 1, n)


def first_of_route(specs: DataFrame, route: str, order: str) -> DataFrame:
    """The first spec of each route."""
    return specs.groupBy(route).agg(F.min_by(F.struct(*[c for c in specs.columns if c != route]), order).alias("__s")).select(route, "__s.*")


def with_defaults(specs: DataFrame, defaults: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Specs whose missing values come from their provider's defaults."""
    d = defaults.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = specs.join(d, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")))
    return out.drop(*[f"__{c}" for c in columns])
