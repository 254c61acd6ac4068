"""Broken prompt and response pairs: empty, truncated, refusal, copy, language.

Method. (1) A naive Bayes classifier over character n-grams (1 to 3) of words tells the language of question and answer by their
posteriors; names, quoted words, numbers and ids are left out first. (2) The end-of-text n-gram likelihood of ``endings`` decides whether
an answer breaks off. (3) The naive Bayes classifier of ``declining`` tells answers that only decline. Copies are told by similarity to
the question.

Plan. Both classifiers are fitted on all labelled texts and all answers, by narrow passes that count n-grams a batch at a time; their models
are arrays of fixed size. One narrow pass reads the answers: their features for the classifier of refusals, which are kept, and every defect
but refusals and ends. The kept features tell the refusals; one more pass counts ends over all answers. Distinct last words are joined to the
counts of their contexts.

Defined results: a null or blank text is ``empty`` whatever the prompt; null messages leave only the defects that
need no question; a row has at most one defect, the first of empty, copy, refusal, truncated, language; repeated rows
are judged alike; a row without defect gives no row; an answer that its own system message prescribes has no defect.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from memloom.llm.declining import fit_declining, only_decline
from memloom.llm.endings import END_SHARE, count_ends, end_shares
from memloom.operators.skew import join_unique
from memloom.session import cut_lineage, ship, spread

#: Places that character n-grams are hashed to, as a power of two.
GRAM_BITS = 17
#: Differences of log posteriors from which the answer and the question are held to be of one language and not the other's. Single words
#: of related languages differ by chance up to about 10; a short sentence differs by 50 and more.
ANSWER_MARGIN, QUESTION_MARGIN = 20.0, 4.0
#: Similarity to the question (twice the common subsequence over both lengths) from which an answer is a copy.
COPY_RATIO = 0.92

DEFECTS = ("empty", "copy", "refusal", "truncated", "language")

_TAG = re.compile(r"</?\s*answer\s*/?>", re.I)
_CUT_TAG = re.compile(r"</?[a-z]*$", re.I)
_INVISIBLE = {"Cc", "Cf", "Cn", "Zs", "Zl", "Zp"}


def visible(text: str | None) -> str:
    """The text without tags, cut tags, and invisible characters at its ends."""
    if text is None:
        return ""
    t = _CUT_TAG.sub("", _TAG.sub(" ", text).rstrip())
    k, n = 0, len(t)
    while k < n and (t[k].isspace() or unicodedata.category(t[k]) in _INVISIBLE):
        k += 1
    while n > k and (t[n - 1].isspace() or unicodedata.category(t[n - 1]) in _INVISIBLE):
        n -= 1
    return t[k:n]


# ------------------------------------------------------------------------------------------- language

_QUOTED = re.compile(r"“[^”]*”|\"[^\"]*\"|«[^»]*»|„[^“”]*[“”]|「[^」]*」|『[^』]*』|《[^》]*》")
_SPACED_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_WIDE_RUN = re.compile(r"[぀-ヿ㐀-鿿가-힣]+")
_DIGIT = re.compile(r"\d")


def _wide(text: str) -> bool:
    """Whether the text holds a character of a script written without spaces."""
    return _WIDE.search(text) is not None


class _Tokens(dict):
    """Of each run without spaces: its words that tell a language wherever it stands, its first word if it is like a name, whether it has
    words, and whether one of them begins lower."""

    def __missing__(self, token: str) -> tuple[list[str], str, bool, bool]:
        if len(self) > 300_000:
            self.clear()
        if _wide(token):
            known = (_WIDE_RUN.findall(token), "", True, False)
        else:
            words = [] if _DIGIT.search(token) else _SPACED_WORD.findall(token)
            lower = [w.lower() for w in words if w[0].islower()]
            name = words[0].lower() if words and not words[0][0].islower() and len(words[0]) > 1 and words[0][1:].islower() else ""
            known = (lower, name, bool(words), bool(lower))
        self[token] = known
        return known


_tokens = _Tokens()


def _sentence_tokens(text: str) -> Iterator[list[str]]:
    """The runs without spaces of each sentence, without what is quoted."""
    for line in _QUOTED.sub(" ", text).split("\n"):
        tokens, begin = line.split(), 0
        for k in [k for k, x in enumerate(tokens, 1) if x[-1] in ".!?"]:
            yield tokens[begin:k]
            begin = k
        if begin < len(tokens):
            yield tokens[begin:]


def _opening(tokens: list[str]) -> str:
    """The first word of a sentence if it is like a name, yet is none since other words follow it."""
    name = ""
    for token in tokens:
        _, like_name, some, lower = _tokens[token]
        if not name:
            if some and not like_name:
                return ""
            name = like_name
        if name and lower:
            return name
    return ""


def language_words(text: str) -> list[str]:
    """Lower-case words (or runs of Han, kana and Hangul) that tell a language: no quoted words, numbers, ids, names."""
    out: list[str] = []
    for tokens in _sentence_tokens(text):
        if opening := _opening(tokens):
            out.append(opening)
        for token in tokens:
            out.extend(_tokens[token][0])
    return out


def grams(words: list[str]) -> Iterator[str]:
    for w in words:
        s = w if _wide(w[0]) else f" {w} "
        for n in (1, 2, 3):
            for k in range(len(s) - n + 1):
                g = s[k : k + n]
                if g != " ":
                    yield g


class Languages:
    """Naive Bayes over hashed character n-grams with equal priors. Shares are smoothed by those over all languages, so a code with
    hardly any text says nothing."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        total = counts.sum(axis=0) + 0.2
        prior = 2000.0 * total / total.sum()
        self.log = np.log((counts + prior) / (counts.sum(axis=1, keepdims=True) + 2000.0)).T.astype(np.float32)
        self.rows: dict[str, int] = {}
        self.known = np.zeros((1024, len(names)), np.float32)

    def _row(self, w: str) -> int:
        k = self.rows[w] = len(self.rows)
        if k == len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[k] = self.log[word_places(w)].sum(axis=0)
        return k

    def posteriors_of(self, texts: list[list[str]]) -> np.ndarray:
        """Log posteriors of the words of each text, relative to the best language, a row a text; 0 throughout without words."""
        blocks = [self._block(texts[k : k + 500]) for k in range(0, len(texts), 500)]
        return np.concatenate([np.zeros((0, len(self.names)), np.float32), *blocks])

    def _block(self, texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.names)), np.float32)
        n = np.array([len(words) for words in texts], np.int64)
        if not n.any() or not self.names:
            return out
        if len(self.rows) > 200_000:
            self.rows.clear()
        get, new = self.rows.get, self._row
        rows = [new(w) if (k := get(w)) is None else k for w in chain.from_iterable(texts)]
        # N-grams overlap threefold, hence the third.
        score = np.add.reduceat(self.known[rows], (np.cumsum(n) - n)[n > 0], axis=0) / 3
        out[n > 0] = score - score.max(axis=1, keepdims=True)
        return out

    def posteriors(self, words: list[str]) -> dict[str, float]:
        return dict(zip(self.names, self.posteriors_of([words])[0].tolist())) if words and self.names else {}

    def best(self, text: str) -> str | None:
        p = self.posteriors(language_words(text))
        return max(p, key=p.get) if p else None


def gram_place(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & ((1 << GRAM_BITS) - 1)


@lru_cache(100_000)
def word_places(word: str) -> np.ndarray:
    return np.array([gram_place(g) for g in grams([word])], np.int32)


#: Names of languages, by code, as questions may write them.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés inglês inglese angielsk английск 英语 英文 英語",
    "de": "german deutsch allemand alemán alemão tedesco niemieck немецк 德语 德文 ドイツ語",
    "fr": "french französisch français francés francês francese francusk французск 法语 法文 フランス語",
    "es": "spanish spanisch espagnol español espanhol spagnolo hiszpańsk испанск 西班牙语 西班牙文 スペイン語",
    "pt": "portuguese portugiesisch portugais portugués português portoghese portugalsk португальск 葡萄牙语 葡萄牙文 ポルトガル語",
    "it": "italian italienisch italien italiano włosk итальянск 意大利语 意大利文 イタリア語",
    "pl": "polish polnisch polonais polaco polonês polacco polsk польск 波兰语 波兰文 ポーランド語",
    "ru": "russian russisch russe ruso russo rosyjsk русск 俄语 俄文 ロシア語",
    "zh": "chinese chinesisch chinois chino chinês cinese chińsk китайск 中文 汉语 中国語",
    "ja": "japanese japanisch japonais japonés japonês giapponese japońsk японск 日语 日文 日本語",
}


def asked_languages(question: str) -> set[str]:
    low = question.lower()
    return {code for code, names in LANGUAGE_NAMES.items() if any(re.search(r"(?<!\w)" + n, low) if n.isascii() or n[0] < "　" else n in low for n in names.split())}


def languages_differ(model: Languages, questions: list[str | None], asked: list[list[str]], answered: list[list[str]]) -> list[bool]:
    """Whether each answer is in another language than its question, which asks for no other, by the words of both."""
    if not questions or not model.names:
        return [False] * len(questions)
    both = np.array([bool(a and q) for a, q in zip(answered, asked)])
    pa_, pq = model.posteriors_of(answered), model.posteriors_of(asked)
    la, lq, at = pa_.argmax(axis=1), pq.argmax(axis=1), np.arange(len(questions))
    far = both & (la != lq) & (pa_[at, la] - pa_[at, lq] >= ANSWER_MARGIN) & (pq[at, lq] - pq[at, la] >= QUESTION_MARGIN)
    return [bool(x) and model.names[k] not in asked_languages(q) for x, k, q in zip(far, la, questions)]


# --------------------------------------------------------------------------------- last line, sentences

_SIGNATURE = re.compile(r"\s*\n\s*[—–-]+\s*\S+(?:\s\S+)?$")
_AFTER = re.compile(r"(?<=[.!?。！？…])\s*(?:[“\"„«「][^“”\"„«»「」\n]{1,60}[”\"“»」]|\([^()\n]{1,60}\)|\[[^\[\]\n]{1,60}\])$")
_AFTER_END = frozenset("”\"“»」)]")


def body(text: str) -> str:
    """The text before a signature, ornaments, and a note in quotes or brackets behind its last sentence."""
    # A signature holds three runs without spaces at most.
    ahead = text.rsplit(None, 3)
    found = _SIGNATURE.search(text, len(ahead[0]) if len(ahead) > 3 else 0) if "\n" in text else None
    t = text[: found.start()] + text[found.end() :] if found else text
    while t and (t[-1].isspace() or unicodedata.category(t[-1]) in ("So", "Sk", "Cf", "Mn")):
        t = t[:-1]
    return (_AFTER.sub("", t) if t and t[-1] in _AFTER_END else t).rstrip()


def _sentences(t: str) -> list[str]:
    return [s for x in _STOP.sub(r"\1\n", t).split("\n") if (s := x.strip())]


_STOP = re.compile(r"([.!?](?=\s)|[。！？])")
_WORD_SIGN = re.compile(r"\w")


def answer_sentences(answer: str) -> list[str]:
    """The sentences of an answer without what it quotes."""
    return [s for s in _sentences(body(_QUOTED.sub(" ", visible(answer)))) if _WORD_SIGN.search(s)]


def last_line(text: str) -> str:
    """The last line that is not blank."""
    return next((x for x in reversed(body(text).split("\n")) if x.strip()), "")


# --------------------------------------------------------------------------------------------- copies

_LABEL = re.compile(r"^\s*(?:>|#+|q:|question:|frage:|pregunta:|pergunta:|domanda:|pytanie:|вопрос:|问题：|質問：)\s*", re.I)
_ANSWER_LABEL = re.compile(r"\s*(?:a|answer):\s*$", re.I)
_NO_WORD = re.compile(r"[\W_]+")


def _plain(text: str) -> str:
    t = text.strip()
    if m := _LABEL.match(t):
        t = t[m.end() :]
    if t.endswith(":"):
        t = _ANSWER_LABEL.sub("", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    return _NO_WORD.sub(" ", t.casefold()).strip()


def _alike(a: str, b: str) -> bool:
    if not a or not b or not 0.6 <= len(a) / len(b) <= 1.67:
        return False
    if a == b:
        return True
    wa, wb = a.split(), b.split()
    if len(wb) >= 5 and len(set(wa) & set(wb)) < len(set(wb)) / 3:
        return False
    # No common subsequence is longer than the letters that both hold, in any order.
    if 2 * (Counter(a) & Counter(b)).total() < COPY_RATIO * (len(a) + len(b)):
        return False
    # Letters in another order within a word count as the word.
    of_letters = {"".join(sorted(w)): w for w in wb}
    known = set(wb)
    a2 = " ".join(w if w in known else of_letters.get("".join(sorted(w)), w) for w in wa)
    return 2 * common_length(a2, b) >= COPY_RATIO * (len(a2) + len(b))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors: one word-parallel step per character of ``b``."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer is the question again, once or several times, perhaps decorated or slightly altered."""
    if len(answer) * 3 < len(question):
        # Only a form of the question without a part of it could be as short as that.
        if not any(len(answer) * 2 > len(f) for f in _question_parts(question)):
            return False
    q, a = _plain(question), _plain(answer)
    if not a or not q:
        return False
    words = set(q.split())
    if len(words) >= 6 and len(words & set(a.split())) * 6 < len(words):
        return False
    lines = [_plain(p) for p in answer.split("\n") if p.strip()]
    for f in [q, *(p for s in _question_parts(question) if (p := _plain(s)) and p != q)]:
        if len(f) < 4:
            if a == f:
                return True
            continue
        if _alike(a, f):
            return True
        n = round(len(a) / len(f))
        if n >= 2 and _alike(a, " ".join([f] * n)):
            return True
        if len(lines) > 1 and all(_alike(p, f) for p in lines):
            return True
    return False


def _question_parts(question: str) -> list[str]:
    """The question without its last sentence, and without a remark in brackets at its end."""
    remark = _REMARK.sub("", question) if question.rstrip().endswith(")") else question
    return [s for s in (_LAST_SENTENCE.sub("", question), remark) if s.strip() and s != question]


_LAST_SENTENCE = re.compile(r"(?<=[.?!？。])\s*[^.?!？。]*[.?!。]?\s*$")
_REMARK = re.compile(r"\s*\([^()]*\)\s*$")


# ---------------------------------------------------------------------------------------------- pairs

_PRESCRIBED = re.compile(r"[\"“„«「]([^\"”“»」]{2,})[\"”“»」]")


def prescribed(system: str | None) -> list[str]:
    """The sentences that a system message quotes: those it prescribes for absent facts."""
    return _PRESCRIBED.findall(system or "")


@lru_cache(10_000)
def _plain_prescribed(system: str | None) -> frozenset[str]:
    return frozenset(map(_plain, prescribed(system)))


_PREFIX = re.compile(r"\w{1,10}:\s")

#: What is told of an answer that its system message prescribes.
FINE = "fine"


def read_answers(questions: list, systems: list, texts: list, languages: Languages) -> dict[str, list]:
    """Of each answer ``lang``, its likeliest language; ``parts``, its sentences; ``told``, ``FINE`` or the defect that needs no classifier of
    refusals, which leaves no other; ``differs``, whether its language does; ``line``, whose end must tell whether it is truncated, unless ``told``."""
    shown = [visible(t) for t in texts]
    told: list[str | None] = []
    for question, system, text in zip(questions, systems, shown):
        if not text:
            told.append("empty")
        elif (of_system := _plain_prescribed(system)) and _plain(text) in of_system:
            told.append(FINE)
        else:
            told.append("copy" if question and is_copy(question, text) else None)
    words = [language_words(t) for t in texts]
    best = languages.posteriors_of(words).argmax(axis=1).tolist() if languages.names and texts else []
    lang = [languages.names[k] if w else None for k, w in zip(best, words)] if best else [None] * len(texts)
    asked = [language_words(q) if q and not x else [] for q, x in zip(questions, told)]
    bare = [t[m.end() :] if (m := _PREFIX.match(t)) else t for t in shown]
    answered = [[] if not q else w if b == t else language_words(b) for q, w, b, t in zip(asked, words, bare, texts)]
    return {
        "lang": lang,
        "parts": [answer_sentences(t) for t in shown],
        "told": told,
        "differs": languages_differ(languages, questions, asked, answered),
        "line": [None if x else last_line(t) for x, t in zip(told, shown)],
    }


# ---------------------------------------------------------------------------------------------- Spark


def labelled_texts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(text, code) of all texts with a language code, which the models are fitted on."""
    code = F.lower(F.regexp_extract(F.col(f"`{lang}`"), r"^\s*([A-Za-z]{2})(?![A-Za-z])", 1))
    return labelled.select(F.col(f"`{text}`").cast("string").alias("text"), code.alias("code")).filter("text is not null and code <> ''")


#: The name under which the texts were had when they were a sample.
labelled_sample = labelled_texts


def fit_languages(texts: DataFrame) -> Languages:
    """``texts``: (text, code)."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens: dict[str, Counter] = defaultdict(Counter)
            words: dict[str, Counter] = defaultdict(Counter)
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sentences = [*_sentence_tokens(t)]
                tokens[k].update(chain.from_iterable(sentences))
                for sentence in sentences:
                    if opening := _opening(sentence):
                        words[k][opening] += 1
            for k, of_code in tokens.items():
                c = words[k]
                for token, n in of_code.items():
                    for w in _tokens[token][0]:
                        c[w] += n
                places = [word_places(w) for w in c]
                n = np.repeat(np.fromiter(c.values(), np.int64, len(c)), [len(x) for x in places])
                at, which = np.unique(np.concatenate([np.zeros(0, np.int32), *places]), return_inverse=True)
                cols = [pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(np.bincount(which, weights=n, minlength=len(at)), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["code", "place", "n"])

    counted = spread(texts).mapInArrow(count, "code string, place int, n bigint").groupBy("code", "place").agg(F.sum("n").alias("n")).toArrow()
    codes = counted.column("code").to_pylist()
    names = sorted(set(codes))
    of = {k: i for i, k in enumerate(names)}
    counts = np.zeros((len(names), 1 << GRAM_BITS))
    np.add.at(counts, (np.array([of[c] for c in codes], np.int64), counted.column("place").to_numpy()), counted.column("n").to_numpy())
    return Languages(names, counts)


def question_of(messages: Column) -> Column:
    """What follows the last ``Question: `` of the last message; null without one."""
    last = F.get(messages, F.size(messages) - 1)["content"]
    return F.when(F.instr(last, "Question: ") > 0, F.substring_index(last, "Question: ", -1))


def system_of(messages: Column) -> Column:
    of_system = F.filter(messages, lambda m: F.lower(F.trim(m["role"])) == "system")
    return F.array_join(F.transform(of_system, lambda m: m["content"]), "\n")


def defective_pairs(answers: DataFrame, labelled: DataFrame, id_col: str = "answer_id", text: str = "text", messages: str = "messages") -> DataFrame:
    """(id, defect) of every defective pair. ``labelled``: texts with language codes to fit on."""
    spark = answers.sparkSession
    ship(spark)
    m = F.col(f"`{messages}`")
    slim = answers.select(F.col(f"`{id_col}`").alias("id"), question_of(m).alias("question"), system_of(m).alias("system"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = labelled_texts(labelled)
    languages = fit_languages(texts)
    asked = slim.filter("text is not null")
    weights, read = fit_declining(asked, texts, languages, read_answers, answer_sentences, prescribed)
    shared = spark.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told, differs, ending = (b.column(k).to_pylist() for k in (1, 2, 3))
            declined = only_decline(shared.value, b.column(4))
            defect = [None if t == FINE else t or ("refusal" if d else "language" if x else None) for t, d, x in zip(told, declined, differs)]
            cols = [pa.array(defect, pa.string()), pa.array([None if t or d else e for t, d, e in zip(told, declined, ending)], pa.string())]
            out = pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "defect", "ending"])
            yield out.filter(pa.compute.or_(out.column(1).is_valid(), out.column(2).is_valid()))

    kind = slim.schema[0].dataType.simpleString()
    judged = cut_lineage(read.select("id", "told", "differs", "ending", "sents").mapInArrow(work, f"id {kind}, defect string, ending string"))
    told, left = judged.filter("ending is null"), judged.filter("ending is not null")
    endings = cut_lineage(left.groupBy("ending").agg(F.count(F.lit(1)).alias("rows")))
    shares = cut_lineage(end_shares(endings, count_ends(asked.select("text"), visible)))
    left = join_unique(left, shares, "ending", "rows", left.count())
    left = left.withColumn("defect", F.when(F.col("share") < END_SHARE, "truncated").otherwise(F.col("defect"))).filter("defect is not null")
    null = slim.filter("text is null").select("id", F.lit("empty").alias("defect"))
    return told.select("id", "defect").unionByName(left.select("id", "defect")).unionByName(null).withColumnRenamed("id", id_col)
