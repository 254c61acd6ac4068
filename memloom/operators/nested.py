"""Deeply nested records to related flat tables by Dewey labelling.

A ``Level`` tree says which fields hold child nodes. Every node of a record gets an ordinal path
(its Dewey label, e.g. ``s2.d0.i1``); a node's parent is its label without the last step, and the
nodes that share a schema path (``s.d.i``) form one table. All of it is one narrow projection and
one explode: no shuffle, no Python, and the cost is linear in the bytes of the records.

Defined results for dirty input: unreadable, empty and null records have no nodes; an object where
an array is expected is an array of one; JSON text counts as what it holds; entries that are not
objects are no nodes but keep their position (scalar levels excepted) and stay, by position, in ``other`` of the node above them; repeated records count again;
columns of the input other than the ids are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F

from memloom.functions import variants as V


@dataclass(frozen=True)
class Level:
    """Child nodes found under ``source``. ``many``: an array (else one object). ``scalar``: entries may be
    of any type. ``aligned``: fields of the parent, parallel to ``source``, whose k-th entry belongs to node k."""

    table: str
    letter: str
    source: str
    many: bool = True
    scalar: bool = False
    aligned: tuple[str, ...] = ()
    children: tuple["Level", ...] = dc_field(default=())


NODE = "array<struct<path:string,node:string,position:int,value:variant,aligned:array<string>>>"
NODE_LABEL = "array<struct<path:string,node:string,position:int>>"


def _children(levels: tuple[Level, ...], at: str, label: str | None, path: str, depth: int, values: bool) -> str:
    kind = NODE if values else NODE_LABEL
    parts = []
    for k, lv in enumerate(levels):
        x, i, c = f"x{depth}_{k}", f"i{depth}_{k}", f"c{depth}_{k}"
        own_path = f"{path}.{lv.letter}" if path else lv.letter
        step = f"concat('{lv.letter}', cast({i} AS string))" if lv.many else f"'{lv.letter}'"
        own = f"concat({label}, '.', {step})" if label else step
        n = f"n{depth}_{k}"
        aligned = ", ".join(
            V.let(f"a{depth}_{k}_{j}", V.entries_or_scalar(V.field(at, a), f"e{depth}_{k}_{j}"), V.text_of(f"get(a{depth}_{k}_{j}, {i})"))
            for j, a in enumerate(lv.aligned)
        )
        extra = f", 'value', {x}, 'aligned', cast(array({aligned}) AS array<string>)" if values else ""
        self_node = f"array(named_struct('path', '{own_path}', 'node', {n}, 'position', {i}{extra}))"
        below = _children(lv.children, x, n, own_path, depth + 1, values) if lv.children else None
        rows = V.let(n, own, f"concat({self_node}, {below})" if below else self_node)
        if lv.scalar:
            each = f"CASE WHEN {x} IS NULL OR is_variant_null({x}) THEN cast(array() AS {kind}) ELSE {rows} END"
            source = V.entries_or_scalar(V.field(at, lv.source), c)
            parts.append(f"flatten(transform({source}, ({x}, {i}) -> {each}))")
            continue
        raw = f"r{depth}_{k}"
        each = V.let(x, V.unwrapped(raw, x + "w"), f"CASE WHEN {V.is_object(x)} THEN {rows} ELSE cast(array() AS {kind}) END")
        source = V.entries(V.field(at, lv.source), c) if lv.many else f"array({V.field(at, lv.source)})"
        parts.append(f"flatten(transform({source}, ({raw}, {i}) -> {each}))")
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _labelled(df: DataFrame, record_id: str, record: str, levels: tuple[Level, ...], values: bool) -> DataFrame:
    held = V.unwrapped(V.read_text("record"), "top")
    nodes = V.let("root", held, f"CASE WHEN {V.is_object('root')} THEN {_children(levels, 'root', None, '', 0, values)} END")
    slim = df.select(F.col(f"`{record_id}`").alias("record_id"), F.col(f"`{record}`").cast("string").alias("record"))
    out = slim.select("record_id", F.explode(F.expr(nodes)).alias("n"))
    return out.select("record_id", "n.*")


def parent_of(node: Column) -> Column:
    """The label without its last step; ``root`` for nodes of the first level."""
    return F.when(F.instr(node, ".") == 0, F.lit("root")).otherwise(F.regexp_replace(node, r"\.[^.]*$", ""))


def dewey_labels(df: DataFrame, record_id: str, record: str, levels: tuple[Level, ...]) -> DataFrame:
    """(record_id, path, node, parent, position) of every node, without the nodes' contents."""
    out = _labelled(df, record_id, record, levels, values=False)
    return out.select("record_id", "path", "node", parent_of(F.col("node")).alias("parent"), "position")


def dewey_nodes(df: DataFrame, record_id: str, record: str, levels: tuple[Level, ...]) -> DataFrame:
    """``dewey_labels`` with each node's contents as VARIANT and its aligned values."""
    out = _labelled(df, record_id, record, levels, values=True)
    return out.select("record_id", "path", "node", parent_of(F.col("node")).alias("parent"), "position", "value", "aligned")


def _left_of(v: str, used: dict, levels: tuple[Level, ...], tag: str) -> str:
    """SQL of what neither ``used`` (name -> leaves used of it, or None for all) nor ``levels`` take from the object ``v``, as a map of VARIANT:
    of a field that holds child nodes the entries that are none, by position; of lists aligned with them what lies behind the last."""
    whole = f"try_variant_get({v}, '$', 'map<string,variant>')"
    taken = {**used, **{lv.source: None for lv in levels}, **{a: None for lv in levels for a in lv.aligned}}
    names = ", ".join(f"'{k}'" for k in sorted(taken)) or "''"
    k, x = f"k{tag}", f"x{tag}"
    parts = [f"map_filter({whole}, ({k}, {x}) -> NOT array_contains(array({names}), {k}))"]
    one = lambda name, cond, value: f"CASE WHEN {cond} THEN map('{name}', {value}) ELSE cast(map() AS map<string,variant>) END"
    for n, (name, leaves) in enumerate(sorted(used.items())):
        if leaves:
            f, m, left = V.field(v, name), f"m{tag}_{n}", f"l{tag}_{n}"
            rest = f"map_filter({m}, ({k}, {x}) -> NOT array_contains(array({', '.join(repr(a) for a in sorted(leaves))}), {k}))"
            of_map = V.let(left, rest, one(name, f"size({left}) > 0", f"to_variant_object({left})"))
            parts.append(V.let(m, f"try_variant_get({f}, '$', 'map<string,variant>')", f"CASE WHEN {m} IS NULL THEN {one(name, f'{f} IS NOT NULL AND NOT is_variant_null({f})', f)} ELSE {of_map} END"))
    for n, lv in enumerate(levels):
        f, e, i, u, left = V.field(v, lv.source), f"e{tag}_{n}", f"i{tag}_{n}", f"u{tag}_{n}", f"c{tag}_{n}"
        if not lv.scalar:
            entries = V.entries(f, e) if lv.many else f"array({f})"
            no_node = V.let(u, V.unwrapped(x, u + "w"), f"NOT {V.is_object(u)} AND NOT is_variant_null({x})")
            pairs = f"filter(transform({entries}, ({x}, {i}) -> struct(cast({i} AS string) AS p, {x} AS x)), y{tag} -> " + no_node.replace(x, f"y{tag}.x") + ")"
            bare = V.let(u + "b", V.unwrapped(f, u + "bw"), f"{f} IS NOT NULL AND NOT is_variant_null({f}) AND NOT {V.is_object(u + 'b')} AND NOT {V.is_array(u + 'b')}") if lv.many else "false"
            held = V.let(left, f"map_from_entries({pairs})", one(lv.source, f"size({left}) > 0", f"to_variant_object({left})"))
            parts.append(f"CASE WHEN {bare} THEN map('{lv.source}', {f}) ELSE {held} END")
        for a in lv.aligned:
            w = f"w{tag}_{n}_{a}"
            more = f"slice({w}, size({V.entries_or_scalar(f, e + 's')}) + 1, size({w}))"
            parts.append(V.let(w, V.entries_or_scalar(V.field(v, a), w + "e"), one(a, f"size({more}) > 0", f"to_variant_object({more})")))
    return f"map_concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def node_table(nodes: DataFrame, path: str, fields: dict[str, str], levels: tuple[Level, ...] = (), aligned: tuple[str, ...] = ()) -> DataFrame:
    """The flat table of one schema path. ``fields``: column name -> JSON path; what neither ``fields`` nor the nodes of ``levels`` take
    stays as JSON in ``other``, so no content is lost."""
    used: dict[str, set | None] = {}
    for p in fields.values():
        steps = p.split(".")[1:]
        if len(steps) == 1:
            used[steps[0]] = None
        elif steps and used.get(steps[0], ()) is not None:
            used.setdefault(steps[0], set()).add(steps[1])
    cols = [F.expr(f"try_variant_get(value, '{p}', 'string')").alias(c) for c, p in fields.items()]
    cols += [F.col("aligned")[k].alias(c) for k, c in enumerate(aligned)]
    if "$" not in fields.values():
        left = V.let("left", _left_of("value", used, levels, "o"), "CASE WHEN size(left) > 0 THEN to_json(left) END")
        cols.append(F.expr(left).alias("other"))
    return nodes.filter(F.col("path") == path).select("record_id", "parent", "node", "position", *cols)


def root_table(df: DataFrame, record_id: str, record: str, levels: tuple[Level, ...]) -> DataFrame:
    """(record_id, node, other) of every readable record: what no node of the first level takes."""
    held = V.unwrapped(V.read_text("record"), "top")
    slim = df.select(F.col(f"`{record_id}`").alias("record_id"), F.expr(held.replace("record", f"cast(`{record}` AS string)") if record != "record" else held).alias("value"))
    left = V.let("left", _left_of("value", {}, levels, "o"), "CASE WHEN size(left) > 0 THEN to_json(left) END")
    return slim.filter(F.expr(V.is_object("value"))).select("record_id", F.lit("root").alias("node"), F.expr(left).alias("other"))


#: The schema of a raw MemEye file.
MEMEYE_LEVELS = (
    Level("profiles", "p", "character_profile", many=False, children=(
        Level("relationships", "r", "relationships", children=(Level("shared_events", "e", "shared_events"),)),
    )),
    Level("sessions", "s", "multi_session_dialogues", children=(
        Level("turns", "d", "dialogues", children=(
            Level("images", "i", "input_image", scalar=True, aligned=("image_id", "image_caption")),
        )),
    )),
)


def memeye_tables(df: DataFrame, record_id: str = "record_id", record: str = "record") -> dict[str, DataFrame]:
    """The seven related tables of MemEye files. Those of nodes share one set of labelled nodes."""
    n = dewey_nodes(df, record_id, record, MEMEYE_LEVELS)
    profile, sessions = MEMEYE_LEVELS
    return {
        "records": root_table(df, record_id, record, MEMEYE_LEVELS),
        "profiles": node_table(n, "p", {"name": "$.name", "age": "$.age", "traits": "$.traits", "home_place": "$.home.place", "home_since": "$.home.since"}, profile.children),
        "relationships": node_table(n, "p.r", {"name": "$.name", "relation": "$.relation"}, profile.children[0].children),
        "shared_events": node_table(n, "p.r.e", {"when": "$.when", "what": "$.what"}),
        "sessions": node_table(n, "s", {"session_id": "$.session_id", "date": "$.date"}, sessions.children),
        "turns": node_table(n, "s.d", {"round": "$.round", "user": "$.user", "assistant": "$.assistant"}, sessions.children[0].children),
        "images": node_table(n, "s.d.i", {"image": "$"}, aligned=("image_id", "image_caption")),
    }
