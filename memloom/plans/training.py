"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.operators.nested import MEMEYE_LEVELS, dewey_labels, memeye_tables
from memloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = dewey_labels(table(spark, sf_dir, "memeye_records"), "record_id", "record", MEMEYE_LEVELS)
    return labels.select("record_id", "parent", "node")


def _p2_table(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return memeye_tables(table(spark, sf_dir, "memeye_records"))[name]

    return query


QUERIES = {
    "p2_found": p2_found,
    **{f"p2_{n}": _p2_table(n) for n in ("records", "profiles", "relationships", "shared_events", "sessions", "turns", "images")},
}


def _held(x: str) -> str:
    """What a JSON value is or, as text, holds."""
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END)"


def _list(x: str) -> str:
    h = _held(x)
    return f"(CASE json_type({h}) WHEN 'ARRAY' THEN json_extract({h}, '$[*]') WHEN 'OBJECT' THEN [{h}] ELSE [] END)"


def _level(source: str, field: str, prefix: str, keep: str = "json_type(x) = 'OBJECT'", entries: str | None = None) -> str:
    """The child nodes of each row of ``source`` (record_id, node, x)."""
    inner = entries or _list(f"json_extract(x, '$.{field}')")
    return f"""(SELECT record_id, node AS parent, CASE WHEN node = 'root' THEN '' ELSE node || '.' END || '{prefix}' || i AS node, {_held('y')} AS x FROM
      (SELECT record_id, node, unnest(l) AS y, generate_subscripts(l, 1) - 1 AS i FROM (SELECT record_id, node, {inner} AS l FROM {source}) WHERE len(l) > 0) WHERE {keep.replace('x)', _held('y') + ')')})"""


_IMAGE = "json_extract(x, '$.input_image')"
_IMAGES = f"(CASE WHEN json_type({_held(_IMAGE)}) IN ('ARRAY', 'OBJECT') THEN {_list(_IMAGE)} WHEN {_IMAGE} IS NULL OR json_type({_IMAGE}) = 'NULL' THEN [] ELSE [{_IMAGE}] END)"
_P2 = f"""WITH r AS (SELECT record_id, 'root' AS node, {_held('x')} AS x FROM (SELECT record_id, CASE WHEN json_valid(record) THEN CAST(record AS JSON) END AS x FROM memeye_records)),
  p AS (SELECT record_id, 'root' AS parent, 'p' AS node, {_held("json_extract(x, '$.character_profile')")} AS x FROM r WHERE json_type({_held("json_extract(x, '$.character_profile')")}) = 'OBJECT'),
  pr AS {_level('p', 'relationships', 'r')}, pe AS {_level('pr', 'shared_events', 'e')}, s AS {_level('r', 'multi_session_dialogues', 's')}, d AS {_level('s', 'dialogues', 'd')},
  i AS {_level('d', '', 'i', "y IS NOT NULL AND json_type(y) <> 'NULL'", _IMAGES)}
  SELECT record_id, parent, node FROM p UNION ALL SELECT record_id, parent, node FROM pr UNION ALL SELECT record_id, parent, node FROM pe UNION ALL SELECT record_id, parent, node FROM s
  UNION ALL SELECT record_id, parent, node FROM d UNION ALL SELECT record_id, parent, node FROM i"""

ORACLES = {"p2_found": _P2}
