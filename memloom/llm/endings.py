"""End-of-text likelihood: whether a text breaks off, by n-grams of its last words.

Model. Lines are cut into words, ids, punctuation marks and, in scripts without spaces, single characters. Every place behind a
token that closes no sentence has a state (first or a later sentence of its line; begun upper, lower, in a wide script, as a list
item or as an enumeration; words so far) and up to three tokens before it, names as N, numbers and ids as 0, opening marks as (.
Counted over all texts, each state with 1 to 3 tokens, each state and each token has its places and those of them at which a line
or text ends. The share of ends at a text's last place decides: below ``END_SHARE`` it breaks off. It is the least share of the contexts
that have been seen to go on, as those seen only at ends may be seen only where texts break off; if state and last token together
tell nothing, what both say apart is combined as in naive Bayes. A word that nowhere goes on tells nothing but by its state, and is no whole word
if it is rare. Places behind a closing mark are ends by definition.

Plan. One narrow pass counts by arrays, a batch at a time; the sums are one map-side combined aggregate. Only distinct endings
are looked up, by a join that no context can skew.

Defined results: a text without words does not break off; null texts hold no places.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memloom.operators.skew import join_unique
from memloom.session import cut_lineage, ship, spread

#: Share of ends among a context's places below which a text breaks off.
END_SHARE = 0.05
#: Places from which state and last token together are enough to tell.
LEAST_PLACES = 4

WIDE = "぀-ヿ㐀-鿿가-힣"
_WIDE_CHAR = re.compile(f"[{WIDE}]")
_ID = r"(?=[A-Za-z_:.,/\-]*\d)[A-Za-z0-9_]+(?:[:.,/\-][A-Za-z0-9_]+)*"
token_pattern = re.compile(rf"[{WIDE}]|{_ID}|[^\W\d_{WIDE}]+(?:['’\-][^\W\d_{WIDE}]+)*-?|[^\w\s]|\w")
_ITEM = re.compile(r"\s*(?:(\d+[.)])|[-*•])(?=\s|$)")
_CLOSE = frozenset(".!?。！？…।؟")
_CLOSERS = frozenset("\"'”’»)]）」』*_")
_IGNORED = frozenset(("So", "Sk", "Cf", "Mn"))
_LINE, _BEGIN = 0, 1

#: Kinds of sentences, in the order of their codes.
_KINDS = "-WUL#C"
_STEPS = np.array([0, 1, 2, 3, 4, 5, 5, 5, 8])
_WIDE_STEPS = np.array([1, 1, 1, 3, 3, 3, 6, 6, 6, 6, 10, 10, 10, 10, 10, 10, 16])


def token_class(token: str) -> str:
    first = token[0]
    if any(c.isdigit() for c in token):
        return "0"
    if token[-1] == "-":  # a word that is broken off
        return "-"
    if first.isalpha():
        return ("N" if len(token) > 1 else "X") if first.isupper() else token
    kind = unicodedata.category(first)
    return "(" if kind in ("Ps", "Pi") else "-" if kind == "Pd" else token


def line_tokens(line: str) -> list[str]:
    m = _ITEM.match(line)
    if not m:
        return token_pattern.findall(line)
    return ["#" if m.group(1) else m.group().strip(), *token_pattern.findall(line, m.end())]


class Places:
    """The places of ``lines``, as arrays."""

    def __init__(self, lines: list[str]):
        ids: dict[str, int] = {"\n": _LINE}
        codes: list[int] = []
        items = np.zeros(len(lines), bool)
        for k, line in enumerate(lines):
            items[k] = _ITEM.match(line) is not None
            codes.append(_LINE)
            codes.extend([ids.setdefault(t, len(ids)) for t in line_tokens(line)])
        kinds = list(ids)
        names: dict[str, int] = {"\n": _LINE, "^": _BEGIN}
        cls = np.array([_LINE, *(names.setdefault(token_class(t), len(names)) for t in kinds[1:])])
        flag = lambda f: np.array([False, *(f(t) for t in kinds[1:])])
        ignored = flag(lambda t: unicodedata.category(t[0]) in _IGNORED)
        c = np.array(codes, np.int64)
        c = c[~ignored[c]]
        n, at = len(c), np.arange(len(c))
        line_start = c == _LINE
        line = np.cumsum(line_start) - 1
        start = np.maximum.accumulate(np.where(line_start, at, 0))
        # Closing marks, and quotes and brackets right behind them.
        close, closer = flag(lambda t: t in _CLOSE)[c], flag(lambda t: t in _CLOSERS)[c]
        anchor = np.maximum.accumulate(np.where(~closer | line_start, at, 0))
        closed = close | (closer & close[anchor])
        before = np.roll(closed, 1)
        begins = np.roll(line_start, 1) | (before & ~closed)
        begins[:1] = False
        begins &= ~line_start
        sentence = np.maximum.accumulate(np.where(begins | line_start, at, 0))
        later = sentence > start + 1
        word = flag(lambda t: t[0].isalnum())[c]
        words = np.cumsum(word)
        base = words[sentence] - word[sentence]
        count = words - base
        first = word & (count == 1)
        head = np.maximum.accumulate(np.where(first, at, 0))
        known = head >= np.maximum(sentence, 1)
        wide, upper = flag(lambda t: bool(_WIDE_CHAR.match(t)))[c], flag(lambda t: t[0].isupper())[c]
        kind = np.where(known, np.where(wide[head], 1, np.where(upper[head], 2, 3)), 0)
        kind = np.where(items[np.maximum(line, 0)] & ~later, 4, kind)
        comma = flag(lambda t: t == ",")[c] & np.isin(kind, (1, 3, 4))
        last_comma = np.maximum.accumulate(np.where(comma, at, 0))
        listed = (last_comma >= sentence) & (last_comma > 0) & comma[last_comma]
        count = np.where(listed, words - words[last_comma], count)
        kind = np.where(listed, 5, kind)
        step = np.where(kind == 1, _WIDE_STEPS[np.minimum(count, 16)], _STEPS[np.minimum(count, 8)])
        self.state = (later * 6 + kind) * 20 + step
        self.names, self.cls = list(names), cls[c]
        self.size = len(names)
        self.counted = ~line_start & ~closed
        self.closed = closed
        self.end = np.append(line_start[1:], True) if n else np.zeros(0, bool)
        self.wide, self.line = wide, line
        one = np.where(line_start, _BEGIN, self.cls)
        self.prev = np.append(_BEGIN, one[:-1])[:n]
        self.prev2 = np.where(self.prev == _BEGIN, -1, np.append([-1, -1], one[:-2])[:n])

    def state_name(self, code: int) -> str:
        return f"{code // 120}{_KINDS[code // 20 % 6]}{code % 20}"

    def counts(self) -> Iterator[tuple[str, int, int]]:
        """(context, ends, places) of all contexts."""
        ok = self.counted
        s, w, p, q, end = (x[ok].astype(np.int64) for x in (self.state, self.cls, self.prev, self.prev2, self.end))
        if not len(s):
            return
        size, names = self.size, self.names
        two = (s * size + p) * size + w
        for key, use, name in (
            (s, None, lambda u: self.state_name(u)),
            (w, None, lambda u: "|" + names[u]),
            (self.wide[ok].astype(np.int64), None, lambda u: "~W" if u else "~S"),
            (s * size + w, None, lambda u: f"{self.state_name(u // size)}|{names[u % size]}"),
            (two, None, lambda u: f"{self.state_name(u // size // size)}|{names[u // size % size]} {names[u % size]}"),
            (two * size + q, q >= 0, lambda u: f"{self.state_name(u // size**3)}|{names[u % size]} {names[u // size // size % size]} {names[u // size % size]}"),
        ):
            k, e = (key, end) if use is None else (key[use], end[use])
            unique, at = np.unique(k, return_inverse=True)
            n = np.bincount(at, minlength=len(unique))
            ends = np.bincount(at, weights=e, minlength=len(unique)).astype(np.int64)
            for u, x, m in zip(unique.tolist(), ends.tolist(), n.tolist()):
                yield name(u), x, m

    def endings(self, n: int) -> list[str | None]:
        """The longest context at the end of each of the ``n`` lines; None behind a closing mark and without a token."""
        out: list[str | None] = [None] * n
        last = np.flatnonzero(self.end & self.counted)
        for k in last.tolist():
            before = [self.names[x] for x in (self.prev2[k], self.prev[k]) if x >= 0]
            out[self.line[k]] = f"{self.state_name(int(self.state[k]))}|{' '.join([*before, self.names[self.cls[k]]])}"
        return out


def count_ends(texts: DataFrame, shown=str) -> DataFrame:
    """(context, ends, n) of all contexts of the column ``text``, as ``shown`` makes of it: its places, and how many of them are ends."""
    ship(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(Places([x for t in b.column(0).to_pylist() for x in shown(t).split("\n")]).counts())
            cols = [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(cols, names=["context", "ends", "n"])

    out = spread(texts.filter("text is not null")).mapInArrow(work, "context string, ends bigint, n bigint")
    return out.groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))


def end_shares(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """``asked`` (``ending``, unique, and other columns) with ``share``, the share of ends at that ending."""
    tokens = F.substring_index("ending", " ", -1)
    state = F.substring_index("ending", "|", 1)
    words = F.expr("substring(ending, instr(ending, '|') + 1)")
    with_state = lambda k: F.concat(state, F.lit("|"), F.substring_index(words, " ", -k))
    last = F.when(F.size(F.split(words, " ")) > 1, tokens).otherwise(words)
    script = F.when(last.rlike(f"^[{WIDE}]"), "~W").otherwise("~S")
    contexts = F.array(with_state(1), with_state(2), with_state(3), state, F.concat(F.lit("|"), last), script)
    places = asked.select("ending", F.posexplode(contexts).alias("k", "context"))
    per = places.groupBy("context").agg(F.count(F.lit(1)).alias("asked"))
    known = cut_lineage(per.join(counted, "context"))
    seen = join_unique(places, known.select("context", "ends", "n", "asked"), "context", "asked", places.count())
    z = lambda c: F.coalesce(c, F.lit(0))
    of = lambda k, c: z(F.max(F.when(F.col("k") == k, F.col(c))))
    per_ending = seen.groupBy("ending").agg(*[of(k, c).alias(f"{c}{k}") for k in range(6) for c in ("ends", "n")], F.max(F.when(F.col("k") == 4, F.col("context"))).alias("last"))
    goes_on = lambda k: F.col(f"n{k}") > F.col(f"ends{k}")
    share: Column | dict = {k: F.greatest(F.col(f"ends{k}") - 0.5, F.lit(0.0)) / F.col(f"n{k}") for k in range(6)}
    apart = share[3] * share[4] / share[5]
    least = F.least(
        *[F.when(goes_on(k), share[k]) for k in (0, 1, 2)],
        F.when(~goes_on(0) | (F.col("n0") < LEAST_PLACES), apart),
        F.when(~F.col("last").rlike(r"[\p{L}\p{N}]$"), share[4]),
        F.lit(1.0),
    )
    only_ends = F.when(F.col("n4") >= LEAST_PLACES, share[3]).otherwise(0.0)
    out = per_ending.select("ending", F.when(~goes_on(4), only_ends).otherwise(least).alias("share"))
    return asked.join(out, "ending", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
