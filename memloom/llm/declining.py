"""Answers that only decline: a naive Bayes classifier over word n-grams, fitted on the corpus itself.

Model. Features are the 1- to 3-grams of a sentence's words (names behind the first word as N, numbers as 0), hashed to ``2 ** BITS`` places. The
classifier tells sentences that decline from others by the log ratio of the two classes' shares, which are taken by language, so that a
language in which much or little is declined counts for nothing by itself.

Fit, by expectation maximisation from positive and unlabelled texts: (1) against the ``SEEDS`` and the no-answer sentences that
system messages prescribe stand the sentences of the documents, those of the answers that share a rare word with
their question, and, at a lower weight, those of the other answers. (2) Distinct answers whose sentences together decline are the
positives of the next round, courtesies and all, and the others its negatives. So a way of declining that no seed holds is learned
from the courtesies that close it, and courtesies from the refusals they close.

An answer only declines if each of its sentences is likelier to decline than not and one of them by ``MARGIN``. Answers of any length are
judged whole.

Plan. All answers are read and turned into hashed features once; each round is one small aggregate of counts over the distinct ones. Common words,
at most 1 / ``COMMON`` times the words of a mean answer, come to the driver. Weights are one float for each of the ``2 ** BITS`` places, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.llm.endings import Places, token_pattern
from memloom.session import cut_lineage, ship, spread

#: Places that n-grams are hashed to, as a power of two.
BITS = 18
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Log ratio, per sentence, from which an answer is a positive of the next round, and from which it declines.
ROUND_MARGIN, MARGIN = 8.0, 3.0
#: Weight of a seed, of an answer of which nothing is known, and of the shares over both classes.
SEED_WEIGHT, UNKNOWN_WEIGHT, PRIOR = 3, 0.3, 300.0
#: Share of the answers from which a word is common.
COMMON = 0.01

#: Sentences that decline, by language, as seeds of the fit.
SEEDS = """
I cannot answer this question.
I'm sorry, but I can't help with that.
I'm unable to provide that information.
I don't know.
I won't answer that.
No answer can be given.
As an AI language model I am not able to help.
I do not have access to this information.
I'd rather not say.
I have to decline.
I am not allowed to share that.
That is not something I can talk about.
That is beyond what I may discuss.
There is not enough information for me to answer.
It is impossible for me to tell.
Unfortunately I have nothing to say about it.
I must leave this question open.
I have been asked not to respond.
This question cannot be answered.
I lack the context to judge.
I wish I could help, but I have no access to that.
It isn't possible for me to say.
My guidelines don't allow me to talk about that.
Diese Frage kann ich nicht beantworten.
Es tut mir leid, dabei kann ich nicht helfen.
Das weiß ich nicht.
Ich weiß es nicht.
Dazu darf ich leider nichts sagen.
Dazu kann ich keine Auskunft geben.
Je ne peux pas répondre à cette question.
Je suis désolé, je ne peux pas vous aider.
Je ne sais pas.
Il m'est impossible de vous le dire.
No puedo responder a esta pregunta.
Lo siento, no puedo ayudar con eso.
No lo sé.
No me es posible decirlo.
Não posso responder a esta pergunta.
Desculpe, não posso ajudar com isso.
Não sei.
Não tenho como dizer.
Non posso rispondere a questa domanda.
Mi dispiace, non posso aiutarti.
Non lo so.
Non mi è possibile dirlo.
Nie mogę odpowiedzieć na to pytanie.
Przykro mi, nie mogę pomóc.
Nie wiem.
Niestety nie potrafię tego powiedzieć.
Я не могу ответить на этот вопрос.
Извините, я не могу помочь.
Я не знаю.
К сожалению, я не могу этого сказать.
我无法回答这个问题。
抱歉，我不能提供帮助。
我不知道。
对不起，我帮不了你。
この質問にはお答えできません。
申し訳ありませんが、お手伝いできません。
わかりません。
申し訳ございませんが、答えられません。
"""


def _hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


_BEGIN, _END = _hash("^"), _hash("$")


class _Runs(dict):
    """Numbers of runs without spaces, which no token crosses. ``codes`` holds the codes of the tokens of all runs as behind the first
    of a sentence, marks left out, ``ends`` where those of each run end, ``heads`` the code of its first token as the first."""

    def __init__(self):
        self.codes, self.ends, self.heads = array("Q"), array("q", [0]), array("Q")

    def __missing__(self, run: str) -> int:
        head = 0
        for t in token_pattern.findall(run.replace("’", "'")):
            if t[0].isalnum():
                digits = any(x.isdigit() for x in t)
                one = _hash("0" if digits else t.lower())
                head = head or one
                self.codes.append(_NAME if t[0].isupper() and len(t) > 1 and not digits else one)
        self.ends.append(len(self.codes))
        self.heads.append(head)
        self[run] = number = len(self)
        return number


_NAME = _hash("N")
_runs = _Runs()


def _place(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of the sentence) of every n-gram."""
    global _runs
    if not sentences:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    if len(_runs) + len(_runs.codes) > 1_000_000:
        _runs = _Runs()
    runs = [s.split() for s in sentences]
    number = np.array([*map(_runs.__getitem__, chain.from_iterable(runs))], np.int64)
    codes, heads, ends = np.asarray(_runs.codes), np.asarray(_runs.heads), np.asarray(_runs.ends)
    size = (ends[1:] - ends[:-1])[number]
    run = np.repeat(np.arange(len(number)), size)
    within = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    words, of = codes[ends[number[run]] + within], np.repeat(np.arange(len(runs)), [len(x) for x in runs])[run]
    first = np.diff(of, prepend=-1) > 0
    words[first] = heads[number[run[first]]]
    n = np.bincount(of, minlength=len(runs)) + 2
    flat = np.full(n.sum(), _BEGIN, np.uint64)
    flat[np.arange(len(words)) + 2 * of + 1] = words
    of, last = np.repeat(np.arange(len(runs)), n), np.cumsum(n) - 1
    flat[last] = _END
    inner = np.ones(len(flat), bool)
    inner[last] = inner[last - n + 1] = False
    k = np.uint64(1_000_003)
    two = flat[:-1] * k + flat[1:]
    three = two[:-1] * k + flat[2:]
    in_two, in_three = of[:-1] == of[1:], of[:-2] == of[2:]
    places = np.concatenate([_place(flat[inner]), _place(two[in_two]), _place(three[in_three])])
    return places, np.concatenate([of[inner], of[:-1][in_two], of[:-2][in_three]])


def scores(weights: np.ndarray, sentences: pa.ListArray) -> np.ndarray:
    """Log ratio of each sentence, given by its places; n-grams overlap threefold, hence the third."""
    n = sentences.value_lengths().to_numpy(zero_copy_only=False)
    return np.bincount(np.repeat(np.arange(len(n)), n), weights=weights[sentences.flatten().to_numpy()], minlength=len(n)) / 3


def fit_weights(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Weight of each place from the counts (languages x places) of both classes."""
    both = positive + negative
    p, n = positive.sum(axis=1, keepdims=True), negative.sum(axis=1, keepdims=True)
    prior = PRIOR * both / np.maximum(p + n, 1) + 1e-12
    w = np.log((positive + prior) / (p + PRIOR)) - np.log((negative + prior) / (n + PRIOR))
    total = both.sum(axis=0)
    return np.where(total > 0, (w * both).sum(axis=0) / np.maximum(total, 1e-9), 0.0).astype(np.float32)


def only_decline(weights: np.ndarray, answers: pa.ListArray) -> np.ndarray:
    """Whether each answer, given by the places of its sentences, only declines."""
    n = answers.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out, begin = np.zeros(len(n), bool), (np.cumsum(n) - n)[n > 0]
    if len(begin):
        s = scores(weights, answers.flatten())
        out[n > 0] = (np.maximum.reduceat(s, begin) >= MARGIN) & (np.minimum.reduceat(s, begin) > 0)
    return out


# ---------------------------------------------------------------------------------------------- Spark

_WORDS = re.compile(r"[^\W\d_]+")


def _counted(df: DataFrame, languages: list[str]) -> list[np.ndarray]:
    """Counts (languages x places) of each class of ``df`` (class, lang, place, n)."""
    rows = df.groupBy("class", "lang", "place").agg(F.sum("n").alias("n")).toArrow()
    of = {k: i for i, k in enumerate(languages)}
    out = [np.zeros((len(languages), 1 << BITS)) for _ in range(2)]
    lang = np.array([of[x] for x in rows.column("lang").to_pylist()], np.int64)
    kind, place, n = (rows.column(c).to_numpy() for c in ("class", "place", "n"))
    for c in (0, 1):
        m = kind == c
        np.add.at(out[c], (lang[m], place[m]), n[m])
    return out


_COUNTS = "class int, lang string, place int, n double"


def _batch(counts: dict[tuple[int, str], list[np.ndarray]], weight: dict | None = None) -> pa.RecordBatch:
    kinds, langs, places, ns = [], [], [], []
    for (kind, lang), parts in counts.items():
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        kinds.append(np.full(len(at), kind // 10, np.int32))
        langs += [lang] * len(at)
        places.append(at.astype(np.int32))
        ns.append(n * (UNKNOWN_WEIGHT if kind % 10 else 1.0))
    cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t), pa.from_numpy_dtype(t))
    return pa.RecordBatch.from_arrays([cat(kinds, np.int32), pa.array(langs, pa.string()), cat(places, np.int32), cat(ns, np.float64)], names=["class", "lang", "place", "n"])


def fit_declining(answers: DataFrame, labelled: DataFrame, languages, read, sentences_of, prescribed_of) -> tuple[np.ndarray, DataFrame]:
    """The weights, and the answers as read: (id, told, differs, ending, the places of each sentence ``sents``, and others). ``answers``: (id,
    question, system, text); ``labelled``: (text, code); ``languages``: a language model; ``read`` reads answers as ``pairs.read_answers`` does,
    ``sentences_of`` gives the sentences of a text, ``prescribed_of`` the no-answer sentences of a system message."""
    spark = answers.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(languages)
    names = sorted(languages.names) or ["en"]

    def best(text: str) -> str:
        return shared.value.best(text) or names[0]

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, set[str]] = {}
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k in names:
                    texts.setdefault(k, set()).update(sentences_of(t))
            yield _batch({(0, k): [features(list(s))[0]] for k, s in texts.items()})

    def of_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, systems, texts = (b.column(k).to_pylist() for k in (1, 2, 3))
            of_read = read(asked, systems, texts, shared.value)
            parts = of_read["parts"]
            places, of = features(flat := [x for p in parts for x in p])
            upto = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
            sents = pa.ListArray.from_arrays(upto(np.bincount(of, minlength=len(flat))), pa.array(places[np.lexsort((places, of))], pa.int32()))
            sents = pa.ListArray.from_arrays(upto([len(p) for p in parts]), sents)
            words = [list({w.lower() for x in p for w in _WORDS.findall(x)}) for p in parts]
            asked = [list({w.lower() for w in _WORDS.findall(q or "")}) for q in asked]
            lists = [pa.array(x, pa.list_(pa.string())) for x in (words, asked, [prescribed_of(s) for s in systems])]
            endings = iter(Places(lines := [x for x in of_read["line"] if x is not None]).endings(len(lines)))
            ending = pa.array([None if x is None else next(endings) for x in of_read["line"]], pa.string())
            told = [pa.array(of_read["told"], pa.string()), pa.array(of_read["differs"], pa.bool_()), ending]
            cols = [b.column(0), pa.array([x or names[0] for x in of_read["lang"]], pa.string()), sents, *lists, *told]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "lang", "sents", "words", "asked", "prescribed", "told", "differs", "ending"])

    def of_prescribed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sentences: dict[str, list[str]] = {}
            for p in b.column(0).to_pylist():
                if p.strip():
                    sentences.setdefault(best(p), []).append(p)
            yield _batch({(10, k): [features(s)[0]] for k, s in sentences.items()})

    documents = _counted(spread(labelled).mapInArrow(of_documents, _COUNTS), names)[0]
    kind = answers.schema["id"].dataType.simpleString()
    seen = cut_lineage(spread(answers).mapInArrow(of_answers, f"id {kind}, lang string, sents array<array<int>>, words array<string>, asked array<string>, prescribed array<string>, told string, differs boolean, ending string"))
    common = seen.select(F.explode("words").alias("w")).groupBy("w").count().filter(F.col("count") > COMMON * seen.count())
    common = [r.w for r in common.select("w").collect()]
    grounded = F.exists(F.array_intersect("words", "asked"), lambda w: ~w.isin(common))
    known = seen.filter(F.size("sents") > 0).select("lang", "sents", grounded.alias("grounded"))
    distinct = cut_lineage(known.groupBy("lang", "sents").agg(F.max("grounded").alias("grounded")))

    prescribed = seen.select(F.explode("prescribed").alias("p")).distinct()
    seeded = SEED_WEIGHT * _counted(prescribed.mapInArrow(of_prescribed, _COUNTS), names)[1]
    of = {k: i for i, k in enumerate(names)}
    for s in SEEDS.split("\n"):
        if s.strip():
            np.add.at(seeded[of[languages.best(s) or names[0]]], features([s])[0], SEED_WEIGHT)

    def counted(weights: np.ndarray | None) -> list[np.ndarray]:
        w = spark.sparkContext.broadcast(weights)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                langs, sents = b.column(0).to_pylist(), b.column(1)
                parts = sents.flatten()
                n, size = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (sents, parts))
                places, begin = parts.flatten().to_numpy(), np.cumsum(n) - n  # no answer is without sentences
                if not len(n):
                    continue
                if w.value is None:
                    kinds = np.where(b.column(2).to_numpy(zero_copy_only=False), 0, 1)  # 10: positive; 1: of which nothing is known
                else:
                    s = scores(w.value, parts)
                    kinds = np.where((np.maximum.reduceat(s, begin) > ROUND_MARGIN) & (np.add.reduceat(s, begin) > ROUND_MARGIN), 10, 0)
                groups: dict[tuple[int, str], int] = {}
                group = np.array([groups.setdefault(g, len(groups)) for g in zip(kinds.tolist(), langs)])
                of_place = np.repeat(group, np.add.reduceat(size, begin))
                yield _batch({g: [places[of_place == k]] for g, k in groups.items()})

        return _counted(distinct.mapInArrow(work, _COUNTS), names)

    weights = None
    for _ in range(ROUNDS + 1):
        negative, positive = counted(weights)
        weights = fit_weights(seeded + positive, documents + negative)
    return weights, seen
