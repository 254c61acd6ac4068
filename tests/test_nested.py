import json
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st

from memloom.operators.nested import MEMEYE_LEVELS, dewey_labels, memeye_tables

SCHEMA = "record_id bigint, record string"


def labels(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.record_id, r.parent, r.node) for r in dewey_labels(df, "record_id", "record", MEMEYE_LEVELS).collect())


def _held(v):
    for _ in range(3):
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return v
    return v


def _entries(v):
    v = _held(v)
    return [v] if isinstance(v, dict) else v if isinstance(v, list) else []


def brute(rows):
    out = []
    for rid, text in rows:
        try:
            x = _held(json.loads(text))
        except (ValueError, TypeError):
            continue
        if not isinstance(x, dict):
            continue
        p = _held(x.get("character_profile"))
        if isinstance(p, dict):
            out.append((rid, "root", "p"))
            for i, r in enumerate(_entries(p.get("relationships"))):
                if isinstance(_held(r), dict):
                    out.append((rid, "p", f"p.r{i}"))
                    out += [(rid, f"p.r{i}", f"p.r{i}.e{j}") for j, e in enumerate(_entries(_held(r).get("shared_events"))) if isinstance(_held(e), dict)]
        for i, s in enumerate(_entries(x.get("multi_session_dialogues"))):
            if isinstance(_held(s), dict):
                out.append((rid, "root", f"s{i}"))
                for j, d in enumerate(_entries(_held(s).get("dialogues"))):
                    if isinstance(_held(d), dict):
                        out.append((rid, f"s{i}", f"s{i}.d{j}"))
                        im = _held(d).get("input_image")
                        held = _held(im)
                        images = held if isinstance(held, list) else [] if im is None else [im]
                        out += [(rid, f"s{i}.d{j}", f"s{i}.d{j}.i{k}") for k, z in enumerate(images) if z is not None]
    return sorted(out)


def test_dirty_records(spark):
    inner = {"character_profile": {"relationships": {"name": "x", "shared_events": [None, {"what": "w"}]}}}
    rows = [
        (1, json.dumps(inner)),
        (2, json.dumps(json.dumps(inner))),
        (3, None),
        (4, ""),
        (5, "{\"a\": "),
        (6, "[]"),
        (7, "null"),
        (8, json.dumps({"multi_session_dialogues": [None, 3, "(cut)", {"dialogues": json.dumps([{"input_image": "one.jpg"}, "x"])}]})),
        (8, json.dumps({"multi_session_dialogues": {"dialogues": {"input_image": ["a", None, "c"]}}})),
        (None, json.dumps({"character_profile": {"name": "n"}})),
    ]
    key = lambda x: (x[0] is not None, x)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.record_id, r.parent, r.node) for r in dewey_labels(df, "record_id", "record", MEMEYE_LEVELS).collect()), key=key)
    assert got[0] == (None, "root", "p")
    assert [g for g in got if g[0] is not None] == brute(rows[:-1])


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dewey_labels(empty, "record_id", "record", MEMEYE_LEVELS).count() == 0
    df = spark.createDataFrame([(1, '{"character_profile": {}}', "x", "y")], "record_id bigint, record string, node string, parent string")
    assert [r.node for r in dewey_labels(df, "record_id", "record", MEMEYE_LEVELS).collect()] == ["p"]


def test_long_record(spark):
    record = json.dumps({"multi_session_dialogues": [{"dialogues": [{"user": "u" * 50}] * 5000}]})
    assert len(labels(spark, [(1, record)])) == 5001


_scalar = st.one_of(st.none(), st.integers(0, 9), st.text("ab", max_size=3))
_event = st.one_of(_scalar, st.fixed_dictionaries({"what": _scalar}))
_people = st.one_of(_scalar, st.fixed_dictionaries({}, optional={"shared_events": st.one_of(_event, st.lists(_event, max_size=2))}))
_turn = st.one_of(_scalar, st.fixed_dictionaries({}, optional={"input_image": st.one_of(_scalar, st.lists(_scalar, max_size=3))}))
_session = st.one_of(_scalar, st.fixed_dictionaries({}, optional={"dialogues": st.one_of(_turn, st.lists(_turn, max_size=3))}))
_record = st.fixed_dictionaries(
    {},
    optional={
        "character_profile": st.one_of(_scalar, st.fixed_dictionaries({}, optional={"relationships": st.one_of(_people, st.lists(_people, max_size=2))})),
        "multi_session_dialogues": st.one_of(_session, st.lists(_session, max_size=3)),
    },
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_record, min_size=1, max_size=20))
def test_any_record(spark, records):
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)]
    assert labels(spark, rows) == brute(rows)


def test_tables_keep_links(spark, sf_dir):
    tables = memeye_tables(spark.read.parquet(f"{sf_dir}/memeye_records.parquet"))
    for child, parent in (("turns", "sessions"), ("images", "turns"), ("relationships", "profiles"), ("shared_events", "relationships")):
        orphans = tables[child].join(tables[parent].select("record_id", tables[parent]["node"].alias("parent")), ["record_id", "parent"], "left_anti")
        assert orphans.count() == 0


def leaves(x, out):
    """Texts of all scalars, JSON text counting as what it holds."""
    if isinstance(x, str):
        try:
            y = json.loads(x) if x.strip()[:1] in ("{", "[") else x
        except ValueError:
            y = x
        if isinstance(y, (dict, list)):
            return leaves(y, out)
        out[x] += 1
    elif isinstance(x, dict):
        for v in x.values():
            leaves(v, out)
    elif isinstance(x, list):
        for v in x:
            leaves(v, out)
    elif x is not None:
        out[json.dumps(x)] += 1
    return out


ODD = {
    "character_profile": {"name": "A", "home": {"place": "P", "since": 1990, "zip": "Z9"}, "relationships": [{"name": "B", "shared_events": ["e", {"when": "w"}]}, "plain friend", None], "age": None},
    "multi_session_dialogues": [{"session_id": "s1", "dialogues": ["a text", {"round": 1, "user": "u", "input_image": "i1", "image_id": ["x", "y"], "image_caption": "c"}, 7]}, "odd", {"dialogues": "none"}],
    "human-annotated QAs": [{"q": "?", "deep": {"a": [1, {"b": True}]}}],
}


def test_no_content_is_lost(spark, sf_dir):
    received = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/memeye_records.parquet").select("record_id", "record")
    odd = [json.dumps(ODD), '{"character_profile":"text","multi_session_dialogues":7}', '{"character_profile":{"home":"no object"},"x":[]}', json.dumps(json.dumps(ODD))]
    df = received.unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(odd)], "record_id bigint, record string"))
    found = {}
    for name, t in memeye_tables(df).items():
        for r in t.collect():
            content = {k: v for k, v in r.asDict().items() if k not in ("record_id", "parent", "node", "position")}
            leaves(content, found.setdefault(r.record_id, Counter()))
    want = {}
    for r in df.collect():
        try:
            x = json.loads(r.record or "")
            x = json.loads(x) if isinstance(x, str) else x
        except ValueError:
            continue
        if isinstance(x, dict):
            want[r.record_id] = leaves(x, Counter())
    assert len(want) > 20 and set(found) == set(want)
    number = lambda t: str(float(t)) if re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", t) else t
    plain = lambda c: Counter(number(t) for t in c.elements())
    assert {k: (plain(w) - plain(found[k]), plain(found[k]) - plain(w)) for k, w in want.items() if plain(found[k]) != plain(w)} == {}
