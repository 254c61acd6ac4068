"""Text that was decoded with a wrong character encoding: find it and restore it.

Method. (1) Segments (lines and sentences) that hold non-ASCII characters are joined with their near-twins: segments with the same frame,
which is the segment with each run of non-ASCII characters stripped to a mark and digits levelled. Where a frame has too few ASCII letters to tell
segments apart (Cyrillic, Chinese), the lengths of the runs belong to the key: in characters for the segment as it stands; in
characters, in UTF-8 bytes and in double bytes for what it may have been. Of a key's segments the commonest is met by all others.
(2) Aligned by their marks, two twins yield pairs of runs that differ; of a pair the run of the commoner characters is the right one. A pair is a mapping of characters to what they became. Mappings are generalised to transformations (written in encoding A, read as B) that
explain them exactly; each mapping speaks for the one that explains most mappings, and a transformation is learned if mappings of
``MIN_SUPPORT`` characters speak for it. Twins that are both wrong, and pairs that as well may be meant the other way round, speak for none. Mappings of single characters that no transformation explains are learned as
they are if enough twins show them and nothing else. Characters that became U+FFFD are a learned loss. (3) What is learned, and
nothing else, is applied backwards to all records; a restored stretch is taken where it is commoner than what stands there by the
character-pair statistics of the whole corpus. Odd characters that are right gain nothing by this, so they stay.

Plan. Three narrow passes over the texts and small shuffles: distinct words with non-ASCII characters, distinct frames with their runs, distinct
pairs of runs. A key's commonest segment is an aggregate, and every segment meets that one row (one of each way of
measuring) only, by a join that no key can skew: work is linear in the segments. To the driver come the pair statistics, 16 bytes
a distinct pair of characters, the votes of the transformations, and the single-character mappings.

Defined results: null, empty and pure ASCII texts are no cases and come back as they are; repeated rows are
judged alike; texts are judged whole; a text with U+FFFD is a case once twins show that characters became it.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from memloom.operators.skew import join_unique
from memloom.session import cut_lineage, ship, spread

#: Distinct clean characters whose mappings must speak for a transformation, and twins that must show the mapping of a single character.
MIN_SUPPORT, MIN_TWINS = 2, 3
#: Share of a string's mappings that must lead to one character for that mapping to be learned as it is.
PURITY = 0.9
#: Share of the segments that hold such a string which must have a twin that shows its mapping.
SHOWN = 0.05
#: Difference of log frequencies (nats) from which it is clear which of two runs is the right one.
CLEAR = 3.0
#: ASCII letters from which a frame alone makes twins.
FRAME_LETTERS = 8
#: Gain in log likelihood (nats) that makes a text a case. A whole multi-byte sequence of UTF-8 hardly comes about by chance, so it
#: needs less, and so does a string that twins show to be wrong.
MIN_GAIN = {"utf-8": 1.5, "shown": 1.5, "": 5.5}

#: Encodings that texts are written in, and those they are read as by mistake.
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8_r", "cp1250", "iso8859_2", "gb18030", "big5", "cp932", "euc_jp", "euc_kr", "cp866", "mac_roman", "cp850", "cp437")
READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman", "gb18030", "cp932", "big5", "euc_kr")
SINGLE = {"cp1252", "latin_1", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman"}

NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^ \t\r\n]+")


@dataclass(frozen=True)
class Step:
    """Written as ``written``, read as ``read``; ``times`` over."""

    written: str
    read: str
    times: int = 1

    @property
    def name(self) -> str:
        return f"{self.written} read as {self.read}" + (", twice" if self.times == 2 else "")


class Substitution:
    """Mappings of single characters that twins show and no transformation explains."""

    written, read, name = "shown", "", "substitution shown by twins"

    def __init__(self, pairs: dict[str, str]):
        self.pairs = pairs
        self.pattern = re.compile("|".join(map(re.escape, sorted(pairs, key=len, reverse=True))))

    def restore(self, text: str) -> str:
        return self.pattern.sub(lambda m: self.pairs[m.group()], text)


#: Name of the learned loss of characters.
LOST = "characters lost"


def catalogue() -> list[Step]:
    one = [Step(w, r) for w in WRITTEN for r in READ_AS if w != r and not (w == "cp1252" and r in ("latin_1", "iso8859_15"))]
    two = [Step("utf-8", r, 2) for r in ("cp1252", "latin_1", "cp1250", "mac_roman", "cp437", "cp850")]
    return one + two


def _byte_tables() -> tuple[dict[str, list[str]], dict[str, dict[str, int]]]:
    to_char: dict[str, list[str]] = {}
    for enc in SINGLE:
        # Bytes without a character pass as the control characters of the same number.
        to_char[enc] = [bytes([b]).decode(enc, "ignore") or chr(b) for b in range(256)]
    return to_char, {enc: {c: b for b, c in reversed(list(enumerate(t)))} for enc, t in to_char.items()}


TO_CHAR, TO_BYTE = _byte_tables()
for _enc in ("cp1252", "cp1250", "cp1251"):
    for _b in range(0x80, 0xA0):
        TO_BYTE[_enc].setdefault(chr(_b), _b)


#: For ``str.translate``: characters of an encoding to those of the same byte in Latin-1, and from one encoding to another.
TO_LATIN = {enc: {ord(c): chr(b) for c, b in t.items()} for enc, t in TO_BYTE.items()}
STRETCH = {enc: re.compile("[" + "".join(map(re.escape, t)) + "]+") for enc, t in TO_BYTE.items()}
_translations: dict[tuple[str, str], dict[int, str]] = {}


def _translation(written: str, read: str) -> dict[int, str]:
    if (written, read) not in _translations:
        to = TO_CHAR[written]
        _translations[written, read] = {ord(c): to[b] for c, b in TO_BYTE[read].items() if c > "\x7f"}
    return _translations[written, read]


def garble(text: str, step: Step) -> str | None:
    """What ``text`` becomes by ``step``."""
    for _ in range(step.times):
        try:
            raw = text.encode(step.written)
        except UnicodeEncodeError:
            return None
        text = "".join(map(TO_CHAR[step.read].__getitem__, raw)) if step.read in SINGLE else raw.decode(step.read, "replace")
    return text


def _utf8_back(raw: list[int | str]) -> list[str]:
    """The characters of the whole multi-byte sequences among the bytes; an empty one for each other entry."""
    out: list[str] = []
    k, n = 0, len(raw)
    while k < n:
        b = raw[k]
        if isinstance(b, int) and 0xC2 <= b <= 0xF4:
            size = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            part = raw[k : k + size]
            if len(part) == size and all(isinstance(x, int) and 0x80 <= x < 0xC0 for x in part[1:]):
                try:
                    out.append(bytes(part).decode("utf-8"))
                    k += size
                    continue
                except UnicodeDecodeError:
                    pass
        out.append("")
        k += 1
    return out


def restore(text: str, step: Step | Substitution) -> str:
    """``text`` with ``step`` undone wherever that is possible; other characters stay."""
    if isinstance(step, Substitution):
        return step.restore(text)
    for _ in range(step.times):
        text = _restore_once(text, step)
    return text


def _restore_once(text: str, step: Step) -> str:
    if step.read not in SINGLE:
        parts = []
        for piece in re.split("(�)", text):
            try:
                parts.append(piece.encode(step.read).decode(step.written, "replace") if piece != "�" and NON_ASCII.search(piece) else piece)
            except UnicodeError:
                parts.append(piece)
        return "".join(parts)
    back = TO_BYTE[step.read]
    if step.written == "utf-8":
        raw: list[int | str] = [back.get(c, c) if c > "\x7f" else c for c in text]
        out, k = [], 0
        for piece in _utf8_back(raw):
            if piece:
                out.append(piece)
                k += len(piece.encode("utf-8"))
            else:
                out.append(text[k])
                k += 1
        return "".join(out)
    if step.written in SINGLE:
        return text.translate(_translation(step.written, step.read))
    # Multi-byte: stretches whose characters all are bytes; ASCII inside may be a second byte.
    latin = TO_LATIN[step.read]
    return STRETCH[step.read].sub(lambda m: m.group().translate(latin).encode("latin-1").decode(step.written, "replace"), text)


class PairCounts:
    """Counts of character pairs, sorted by the code of the pair; 16 bytes a pair, as all pairs of a corpus are kept."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = array("Q", codes[order].astype(np.uint64).tobytes()), array("q", counts[order].astype(np.int64).tobytes())

    @classmethod
    def of(cls, pairs: list[str], counts: np.ndarray) -> PairCounts:
        return cls(cls.encode(pairs), counts)

    @staticmethod
    def encode(pairs: list[str]) -> np.ndarray:
        both = np.frombuffer("".join(pairs).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, 2).astype(np.uint64)
        return both[:, 0] << np.uint64(32) | both[:, 1]

    def __len__(self) -> int:
        return len(self.codes)

    def get(self, pair: str, default: int = 0) -> int:
        code = ord(pair[0]) << 32 | ord(pair[1])
        k = bisect_left(self.codes, code)
        return self.counts[k] if k < len(self.codes) and self.codes[k] == code else default

    def totals(self) -> tuple[dict[str, int], dict[str, int]]:
        """Sums by the first and by the second character."""
        codes, counts = np.frombuffer(self.codes, np.uint64), np.frombuffer(self.counts, np.int64)
        out = []
        for part in (codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)):
            chars, at = np.unique(part, return_inverse=True)
            sums = np.zeros(len(chars), np.int64)
            np.add.at(sums, at, counts)
            out.append(dict(zip(map(chr, chars.tolist()), sums.tolist())))
        return out[0], out[1]


class Commonness:
    """Log likelihood of words by character pairs, with single characters to fall back on."""

    def __init__(self, pairs: PairCounts | dict[str, int]):
        self.pairs = PairCounts.of(list(pairs), np.array(list(pairs.values()), np.int64)) if isinstance(pairs, dict) else pairs
        self.first, self.single = self.pairs.totals()
        self.total = sum(self.single.values()) + 1
        self.memo: dict[str, float] = {}
        self.logs: dict[str, float] = {}

    def _pair(self, pair: str) -> float:
        a, b = pair
        base = (self.single.get(b, 0) + 0.02) / (self.total + 2000)
        known = self.logs[pair] = math.log((self.pairs.get(pair, 0) + 2.0 * base) / (self.first.get(a, 0) + 2.0))
        if len(self.logs) > 2_000_000:
            self.logs.clear()
        return known

    def frequency(self, text: str) -> float:
        """Mean log frequency of the characters."""
        return sum(math.log(self.single.get(c, 0) + 0.5) for c in text) / len(text)

    def clearly(self, text: str, other: str) -> bool:
        """Whether ``text`` is so much commoner than ``other`` that this is no chance."""
        return (self.frequency(text) - self.frequency(other)) * min(len(text), len(other)) >= CLEAR

    def of(self, word: str, floor: float = -math.inf) -> float:
        """Log likelihood; -inf as soon as it is below ``floor``, as every further pair lowers it."""
        known = self.memo.get(word)
        if known is not None:
            return known
        s, total, logs = f" {word} ", 0.0, self.logs
        for a, b in zip(s, s[1:]):
            x = logs.get(a + b)
            total += self._pair(a + b) if x is None else x
            if total < floor:
                return -math.inf
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[word] = total
        return total


def readings(word: str, encodings: frozenset[str] = frozenset(READ_AS)) -> tuple[set[str], set[str]]:
    """Those of ``encodings`` that ``word`` may have been read as: those that can undo a single-byte or multi-byte reading of it, and
    those of them in which it holds the beginning of a UTF-8 sequence. Others leave the word as it is."""
    odd = [c for c in word if c > "\x7f"]
    able, utf8 = set(), set()
    for enc in SINGLE & encodings:
        back = TO_BYTE[enc]
        raw = [b for c in odd if (b := back.get(c)) is not None]
        if raw:
            able.add(enc)
            if any(0xC2 <= b <= 0xF4 for b in raw):
                utf8.add(enc)
    for enc in encodings:
        if enc and enc not in SINGLE:
            for piece in word.split("\ufffd"):
                try:
                    if NON_ASCII.search(piece) and piece.encode(enc):
                        able.add(enc)
                        utf8.add(enc)
                        break
                except UnicodeEncodeError:
                    continue
    return able, utf8


@dataclass
class Judge:
    """Applies what was learned to texts."""

    common: Commonness
    steps: list[Step | Substitution]
    lost: bool = False
    memo: dict[str, list[tuple[int, float, str]]] = field(default_factory=dict)

    def __post_init__(self):
        self.encodings = frozenset(s.read for s in self.steps if s.read)

    def _options(self, word: str) -> list[tuple[int, float, str]]:
        """(transformation, gain, restored word) of each transformation that gains."""
        known = self.memo.get(word)
        if known is None:
            now, known = None, []
            able, utf8 = readings(word, self.encodings)
            for k, step in enumerate(self.steps):
                if step.read and step.read not in (utf8 if step.written == "utf-8" else able):
                    continue
                back = restore(word, step)
                if back != word:
                    now = self.common.of(word) if now is None else now
                    least = now + 6.0 * back.count("�") + 0.5
                    gain = self.common.of(back, least) - least + 0.5 if least < 0 else -1.0
                    if gain > 0.5:
                        known.append((k, gain, back))
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[word] = known
        return known

    def judge(self, text: str) -> tuple[bool, str, str | None]:
        """(whether a case, the text with what can be restored, the main transformation)."""
        words = [w for w in set(_WORD.findall(text)) if NON_ASCII.search(w)]
        of_word = {w: self._options(w) for w in words}  # held here, as the memo may be emptied within a text
        gains: Counter[int] = Counter()
        for options in of_word.values():
            for k, gain, _ in options:
                gains[k] += gain
        kept = [k for k, g in gains.items() if g >= MIN_GAIN.get(self.steps[k].written, MIN_GAIN[""])]
        if not kept:
            lost = self.lost and "�" in text
            return lost, text, LOST if lost else None
        kept.sort(key=lambda k: (-gains[k], k))
        allowed = set(kept)

        def better(m: re.Match) -> str:
            options = [o for o in of_word.get(m.group(), ()) if o[0] in allowed]
            return max(options, key=lambda o: (o[1], -o[0]))[2] if options else m.group()

        return True, _WORD.sub(better, text), self.steps[kept[0]].name


class Explainer:
    """Tells the transformations that turn a right run into a wrong one."""

    def __init__(self, steps: list[Step]):
        self.steps = steps
        self.single = [k for k, s in enumerate(steps) if s.read in SINGLE]
        self.multi = [k for k, s in enumerate(steps) if s.read not in SINGLE]
        self.first: dict[str, dict[str, list[int]]] = {}

    def _beginnings(self, c: str) -> dict[str, list[int]]:
        known = self.first.get(c)
        if known is None:
            known = self.first[c] = {}
            for k in self.single:
                g = garble(c, self.steps[k])
                if g is not None and g != c:
                    known.setdefault(g, []).append(k)
        return known

    def explain(self, wrong: str, right: str) -> list[int]:
        # Read by one byte a character, a run begins with what its first character becomes.
        some = [k for g, ks in self._beginnings(right[0]).items() if wrong.startswith(g) for k in ks]
        if wrong[0] > "\u2e7f" or "�" in wrong:
            some += self.multi
        return sorted(k for k in some if garble(right, self.steps[k]) == wrong)

    def speaks(self, wrong: str, right: str, mask: list[int], votes: dict[int, int], common: Commonness) -> bool:
        """Whether a mapping explained by ``mask`` speaks for a transformation. ``votes``: the mappings that each transformation explains."""
        most = max(votes[k] for k in mask)
        # One of the two may have become the other: without a clear difference the better supported way counts.
        if not common.clearly(right, wrong) and any(votes.get(k, 0) > most for k in self.explain(right, wrong)):
            return False
        for k, n in votes.items():
            # The right one must not be wrong itself, in another way. Whole sequences of UTF-8 hardly come about by chance.
            utf8 = self.steps[k].written == "utf-8"
            if k not in mask and (utf8 or n > most):
                back = restore(right, self.steps[k])
                if back != right and "�" not in back and (utf8 or common.clearly(back, right)):
                    return False
        return True


# ---------------------------------------------------------------------------------------------- Spark


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col(f"`{text}`").cast("string").alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7F]"))


def corpus_pairs(df: DataFrame, text: str = "text") -> PairCounts:
    """Counts of all character pairs in the words with non-ASCII characters of all texts."""
    words = (
        _texts(df, text)
        .select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("w"))
        .filter(F.col("w").rlike(r"[^\x00-\x7F]"))
        .groupBy("w")
        .count()
    )
    s = F.concat(F.lit(" "), "w", F.lit(" "))
    pairs = words.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda k: F.substring(s, k, F.lit(2)))).alias("pair"), "count"
    )
    counted = pairs.groupBy("pair").agg(F.sum("count").alias("n")).toArrow()
    codes = [PairCounts.encode(b.column(0).to_pylist()) for b in counted.to_batches()]
    return PairCounts(np.concatenate([np.empty(0, np.uint64), *codes]), counted.column(1).to_numpy())


def _variants(df: DataFrame, text: str) -> DataFrame:
    """(telling, own, ways, runs, n): what lines and sentences with non-ASCII characters are, and how often. ``own`` is the hash of the
    frame, with the lengths of the runs where it does not tell; ``ways`` those of what the segment may have become."""
    segment = F.explode(F.split("text", r"\n|(?<=[.!?])\s+")).alias("segment")
    seg = _texts(df, text).select(segment).filter(F.col("segment").rlike(r"[^\x00-\x7F]"))
    bare = F.regexp_replace(F.regexp_replace("segment", r"[^\x00-\x7F]+", "□"), r"[0-9]+", "0")
    bare = F.trim(F.regexp_replace(bare, r"[ \t\r\x0b\x0c]+", " "))
    seg = seg.select(bare.alias("frame"), F.regexp_extract_all("segment", F.lit(r"[^\x00-\x7F]+"), F.lit(0)).alias("runs"))
    telling = F.length(F.regexp_replace("frame", "[^A-Za-z]", "")) >= FRAME_LETTERS
    key = lambda f: F.xxhash64("frame", F.transform("runs", f))
    own = key(F.length)
    whole = F.xxhash64("frame")
    ways = F.when(telling, F.array(whole)).otherwise(F.array_distinct(F.array(own, key(F.octet_length), key(lambda r: F.length(r) * 2))))
    seg = seg.select(telling.alias("telling"), F.when(telling, whole).otherwise(own).alias("own"), ways.alias("ways"), "runs")
    return seg.groupBy("telling", "own", "runs").agg(F.first("ways").alias("ways"), F.count(F.lit(1)).alias("n"))


def _run_pairs(v: DataFrame) -> DataFrame:
    """(a, b, n) of ``_variants``: the pairs of runs that differ at the same place of twins, and the number of twins by their frame alone."""
    clean = v.select("runs", "n", "own", F.explode("ways").alias("key"))
    way = F.when(F.col("key") == F.col("own"), 1).otherwise(0)
    size = F.aggregate("runs", F.lit(0), lambda s, r: s + F.length(r))
    pivots = clean.groupBy("key", way.alias("way")).agg(F.max_by("runs", F.struct("n", -size, F.col("runs"))).alias("pivot"))
    pivots = pivots.groupBy("key").agg(F.collect_list("pivot").alias("pivots"))  # two at most
    rows = v.select("runs", F.col("telling").cast("int").alias("telling"), F.col("own").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    dim = cut_lineage(pivots.join(counts.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).drop("k"))
    twins = join_unique(rows, dim, "key", "m", v.count()).select("runs", "telling", F.explode("pivots").alias("pivot"))
    twins = twins.filter((F.size("runs") == F.size("pivot")) & (F.col("runs") != F.col("pivot")))
    pair = F.explode(F.arrays_zip(F.col("runs").alias("x"), F.col("pivot").alias("y"))).alias("p")
    pairs = twins.select("telling", pair).filter("p.x <> p.y").select("telling", F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("telling").alias("n"))


def learn(df: DataFrame, text: str, common: Commonness) -> tuple[list[Step | Substitution], bool]:
    """(the transformations that twins show, best supported first; whether twins show that characters became U+FFFD)."""
    spark = df.sparkSession
    ship(spark)
    steps = catalogue()
    shared = spark.sparkContext.broadcast(common.pairs)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, e = Commonness(shared.value), Explainer(steps)
        for b in batches:
            rows = []
            for x, y, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                right, wrong = (x, y) if c.frequency(x) >= c.frequency(y) else (y, x)
                if "�" in right:
                    right, wrong = wrong, right
                mask = e.explain(wrong, right) if "�" not in right and wrong.strip("�") else []
                if mask or len(right) == 1 or "�" in wrong:
                    rows.append((wrong, right, n, mask))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(cols, names=["wrong", "right", "n", "mask"])

    variants = cut_lineage(_variants(df, text))
    mapped = cut_lineage(spread(_run_pairs(variants)).mapInArrow(explain, "wrong string, right string, n bigint, mask array<int>"))
    explained = mapped.filter(F.size("mask") > 0)

    def voted(df: DataFrame) -> dict[int, int]:
        return {r.k: r.n for r in df.select(F.explode("mask").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}

    first = voted(explained)

    def speaking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, e = Commonness(shared.value), Explainer(steps)
        for b in batches:
            yield b.filter(pa.array([e.speaks(*x, first, c) for x in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)))], pa.bool_()))

    explained = cut_lineage(explained.mapInArrow(speaking, explained.schema))
    votes = voted(explained)
    learned: list[Step | Substitution] = []
    if votes:
        of = F.create_map(*[F.lit(x) for kv in votes.items() for x in kv])
        best = F.array_max(F.transform("mask", lambda k: F.named_struct(F.lit("n"), of[k], F.lit("k"), -k)))["k"]
        chars = explained.select((-best).alias("k"), F.explode(F.array_distinct(F.split("right", ""))).alias("c")).filter("c <> ''")
        support = chars.groupBy("k").agg(F.countDistinct("c").alias("chars")).filter(F.col("chars") >= MIN_SUPPORT).collect()
        learned += [steps[r.k] for r in sorted(support, key=lambda r: (-votes[r.k], r.k))]
    single = mapped.filter((F.size("mask") == 0) & (F.length("right") == 1) & ~F.col("wrong").contains("�"))
    total = F.sum("n").over(W.partitionBy("wrong"))
    pure = single.withColumn("total", total).filter((F.col("n") >= MIN_TWINS) & (F.col("n") >= PURITY * F.col("total"))).select("wrong", "right", "n")
    held = variants.select(F.explode("runs").alias("wrong")).join(pure, "wrong").groupBy("wrong", "right", "n").agg(F.count(F.lit(1)).alias("held"))
    shown = {r.wrong: r.right for r in held.filter(F.col("n") >= SHOWN * F.col("held")).collect()}
    shown = {w: r for w, r in shown.items() if all(restore(w, s) == w for s in learned)}
    if shown:
        learned.append(Substitution(shown))
    lost = mapped.filter((F.size("mask") == 0) & F.col("wrong").contains("�")).agg(F.countDistinct("right")).first()[0] >= MIN_SUPPORT
    return learned, lost


def judged(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``garbled``, ``restored`` and ``step`` of every row with non-ASCII characters."""
    ship(df.sparkSession)
    common = Commonness(corpus_pairs(df, text))
    shared = df.sparkSession.sparkContext.broadcast((common.pairs, *learn(df, text, common)))
    slim = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    slim = slim.filter(F.col("__text").rlike(r"[^\x00-\x7F]"))
    n = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, steps, lost = shared.value
        j = Judge(Commonness(pairs), steps, lost)
        for b in batches:
            out = [j.judge(t) for t in b.column(n).to_pylist()]
            cols = [pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(n)], *cols], names=[*b.schema.names[:n], "garbled", "restored", "step"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:n])
    return spread(slim).mapInArrow(work, fields + "garbled boolean, restored string, step string")


def garbled_documents(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Ids of the texts with a wrongly decoded stretch, restorable or not."""
    return judged(df, [id_col], text).filter("garbled").select(id_col)


def restored_documents(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Each case with its restored text and the transformation undone (null where nothing could be restored)."""
    return judged(df, [id_col], text).filter("garbled").select(id_col, "restored", "step")
