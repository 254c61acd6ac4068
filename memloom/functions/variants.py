"""SQL fragments over VARIANT values that tolerate wrongly typed and doubly encoded JSON.

Every function takes and returns SQL text, so fragments nest inside higher-order functions
without leaving the JVM.
"""

from __future__ import annotations


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it in ``body`` as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL)"


def is_array(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'array<variant>') IS NOT NULL)"


def read_text(text: str) -> str:
    """JSON text as VARIANT, NULL if unreadable; text behind the value makes it unreadable."""
    return (
        f"CASE WHEN rtrim(' \t\r\n', {text}) RLIKE '[}}\\\\]\"0-9el]$' THEN try_parse_json({text}) END"
    )


def unwrapped(v: str, name: str, depth: int = 2) -> str:
    """The object or array that ``v`` is or, as JSON text, holds (texts within texts up to ``depth``)."""
    held = v
    for k in range(depth):
        n = f"{name}_{k}"
        held = let(
            n,
            held,
            f"CASE WHEN {is_object(n)} OR {is_array(n)} THEN {n} ELSE try_parse_json(try_variant_get({n}, '$', 'string')) END",
        )
    return held


def entries(v: str, name: str) -> str:
    """``v`` as ARRAY<VARIANT>: an object counts as an array of one, anything else as none."""
    return let(
        name,
        unwrapped(v, name + "u"),
        f"CASE WHEN {is_object(name)} THEN array({name}) "
        f"ELSE coalesce(try_variant_get({name}, '$', 'array<variant>'), cast(array() AS array<variant>)) END",
    )


def entries_or_scalar(v: str, name: str) -> str:
    """Like ``entries``, but a single non-null scalar is an array of one too."""
    u = name + "u"
    return let(
        name,
        v,
        let(
            u,
            unwrapped(name, u + "u"),
            f"CASE WHEN {is_array(u)} THEN try_variant_get({u}, '$', 'array<variant>') "
            f"WHEN {is_object(u)} THEN array({u}) "
            f"WHEN {name} IS NULL OR is_variant_null({name}) THEN cast(array() AS array<variant>) "
            f"ELSE array({name}) END",
        ),
    )


def field(v: str, key: str) -> str:
    return f"try_variant_get({v}, '$[\"{key}\"]')"


def text_of(v: str) -> str:
    """A scalar as text, an object or array as its JSON."""
    return f"try_variant_get({v}, '$', 'string')"
