from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import declining, endings, pairs

SYSTEM = 'Stay short. If the fact is absent, reply exactly "Not in the record."'
LABELLED = {
    "en": ["The train was late because the key was missing and nobody had measured the doorway.", "They carried the wall clock to the shed and had tea together.", "We agreed to meet there two weeks ago after the storm."],
    "de": ["Der Zug war zu spät, weil der Schlüssel fehlte und niemand die Tür gemessen hatte.", "Seit dem Umzug steht das Regal gleich neben der Treppe.", "Wir wollen am Dienstag zusammen Brot backen."],
    "fr": ["Le train était en retard parce que la clé était cassée et personne n'avait mesuré l'entrée.", "Depuis le départ la tente se trouve juste à côté de l'escalier.", "Nous avons décidé de peindre le couloir."],
    "zh": ["火车晚点了，因为钥匙不见了。", "我们打算一起烤面包，晚饭是扁豆汤。", "照片里有一个绿色的望远镜。"],
}
CASES = [
    ("What did Zoë repair?", SYSTEM, None, "empty"),
    ("What did Zoë repair?", SYSTEM, "<answer> ​ </answer>", "empty"),
    (None, None, "", "empty"),
    ("What did Zoë repair in the shed?", SYSTEM, "**what did zoë repair in the shed**", "copy"),
    ("What did Zoë repair in the shed?", SYSTEM, "Q: What did Zoë repair in thee shed?\nA:", "copy"),
    ("What did Zoë repair in the shed?", SYSTEM, "I'm sorry, but I can't help with that. Please ask something else.", "refusal"),
    ("What did Zoë repair in the shed?", SYSTEM, "Not in the record.", None),
    ("What did Zoë repair in the shed?", SYSTEM, "Apologies, it isn't possible for me to judge this.", "refusal"),
    ("Was hat Zoë im Schuppen repariert?", SYSTEM, "Auf diese Frage habe ich leider keine Antwort.", "refusal"),
    ("What did Zoë repair in the shed?", SYSTEM, "The question was where to look; no, Zoë decided to keep the ladder after all, since nobody had a key.", None),
    ("三月の初めに何を買いましたか？", SYSTEM, "ミシン, アコーディオン, カヤック, 時計", None),
    ("What did Zoë repair in the shed?", 'Reply "There is no such memory."', "Not in the record.", "refusal"),
    ("What did Zoë repair in the shed?", SYSTEM, 'Zoë said "I\'m sorry, I can\'t help with that" and left for the shed.', None),
    ("What did Zoë repair in the shed?", SYSTEM, "Zoë repaired the wall clock first and turned to the", "truncated"),
    ("What did Zoë repair in the shed?", SYSTEM, "1. tent\n2. clock\n3.", "truncated"),
    ("What did Zoë repair in the shed?", SYSTEM, "1. tent\n2. clock\n3. shed", None),
    ("What did Zoë repair in the shed?", SYSTEM, "<answer>Zoë repaired the wall clock. 😊</answer>", None),
    ("What did Zoë repair in the shed?", SYSTEM, "42", None),
    ("What did they do after the storm was over?", SYSTEM, "Der Zug war zu spät, weil niemand die Tür gemessen hatte.", "language"),
    ("What did they do after the storm was over? Please reply in German.", SYSTEM, "Der Zug war zu spät, weil niemand die Tür gemessen hatte.", None),
    ("What did they do after the storm was over?", SYSTEM, "They carried the wall clock to the shed.", None),
    (None, None, "They carried the wall clock to the shed.", None),
]


def frames(spark, sf_dir=None):
    labelled = [(k, t, code) for code, texts in LABELLED.items() for k, t in enumerate(texts * 20)] + [(0, None, "en"), (1, "x", None), (2, "noise", "und")]
    docs = spark.createDataFrame(labelled, "doc_id bigint, text string, lang string")
    rows = []
    for k, (q, s, a, _) in enumerate(CASES):
        messages = None if q is None else [("system", s), ("user", None), ("user", f"Evidence.\n\nQuestion: {q}")]
        rows.append((k, messages, a, "x"))
    # The sentence of other rows, and complete answers for the end-of-text model.
    rows += [(1000 + k, [("system", SYSTEM), ("user", "Question: Where is the shed now?")], "in the shed", "x") for k in range(20)]
    answers = spark.createDataFrame(rows, "answer_id bigint, messages array<struct<role:string,content:string>>, text string, defect string")
    if not sf_dir:
        return answers, docs
    # The models of refusals and ends are learned from a corpus.
    larger = sf_dir.replace("0.001", "0.01")
    more = spark.read.parquet(f"{larger}/answers.parquet").select((F.col("answer_id") + 1_000_000).alias("answer_id"), "messages", "text", F.lit("x").alias("defect"))
    return answers.unionByName(more), docs.unionByName(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text", "lang"))


MANY = "I'm sorry. I cannot answer this. I do not have the records. I don't know. I can't help with it. Please ask something else."
LONG = "I'm sorry, but I am unable to answer this question, " + "and I cannot help with that either, " * 40 + "as I do not have access to it."
FINE = "Zoë keeps the key in the shed. "


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    answers, docs = frames(spark, sf_dir)
    rows = [(50_000 + k, [("user", "Question: Where is the key?")], t, "x") for k, t in enumerate((MANY, LONG, MANY + " " + FINE, FINE * 40, MANY * 30))]
    return answers.unionByName(spark.createDataFrame(rows, answers.schema)), docs


@pytest.fixture(scope="module")
def found(corpus):
    return {r.answer_id: r.defect for r in pairs.defective_pairs(*corpus).filter("answer_id < 1000000").collect()}


def test_each_defect(found):
    assert {k: found.get(k) for k in range(len(CASES))} == {k: c[3] for k, c in enumerate(CASES)}
    assert not {k: d for k, d in found.items() if 1000 <= k < 50_000}


def test_refusals_of_any_length(found):
    assert {k - 50_000: d for k, d in found.items() if k >= 50_000} == {0: "refusal", 1: "refusal", 4: "refusal"}


def test_the_end_of_text_model_decides_truncation(corpus, monkeypatch):
    monkeypatch.setattr(pairs, "end_shares", lambda asked, counted: asked.withColumn("share", F.lit(1.0)))
    assert pairs.defective_pairs(*corpus).filter("defect = 'truncated'").count() == 0


def test_rare_contexts_count_in_a_large_corpus(spark):
    answers, docs = frames(spark)
    # 60,000 contexts, each seen more often than those of the complete phrases below.
    words = " ".join("".join("abcdefghij"[int(d)] for d in str(k)) for k in range(100_000, 120_000))
    rows = [(k, None, text, "x") for k, text in enumerate(["under stairs", "behind stairs", "beside stairs", "towards a", *["towards a lamp"] * 40, *["stairs and a lamp"] * 9])]
    rows += [(1000 + k, None, words + ".", "x") for k in range(10)]
    got = {r.answer_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(rows, answers.schema), docs).collect()}
    assert got == {3: "truncated"}


def test_ways_of_declining_are_learned_from_courtesies(spark, sf_dir):
    answers, docs = frames(spark, sf_dir)
    words = ["".join("abcdefghij"[int(d)] for d in str(k)) for k in range(10, 50)]
    asked = ("user", "Question: Where?")
    rows = [(k, [asked], f"Zibble {w} quax. Please ask something else.", "x") for k, w in enumerate(words)]
    rows += [(100 + k, [asked], f"I cannot answer this question on {w}. Please ask something else.", "x") for k, w in enumerate(words)]
    rows += [(3000 + k, [("system", f'Reply "Zubble {w} quorn."'), asked], "Yes.", "x") for k, w in enumerate(words)]
    rows += [(9000, [asked], f"Zubble {words[-1]} quorn.", "x"), (9001, [asked], f"Zibble {words[7]} quax.", "x"), (9002, [asked], "The kayak.", "x")]
    rows += [(9003, [asked], f"Zibble {words[7]} quax. The kayak stood under the stairs of the shed.", "x")]
    given = answers.filter("answer_id >= 1000000").unionByName(spark.createDataFrame(rows, answers.schema))
    got = pairs.defective_pairs(given, docs).filter("defect = 'refusal' and answer_id < 1000000").collect()
    assert sorted(r.answer_id for r in got) == [*range(40), *range(100, 140), 9000, 9001]


@pytest.mark.parametrize("times", [1, 2, 6, 7, 8, 40])
def test_copies_of_any_number(times):
    question = "What did Zoë repair in the shed?"
    assert pairs.is_copy(question, " ".join([question] * times))
    assert pairs.is_copy(question, " ".join([question] * (times - 1) + ["What did Zoë repair in thee shed?"]))
    assert not pairs.is_copy(question, " ".join(["Zoë did repair the clock in the shed."] * times))


def test_empty_tables(spark):
    answers, docs = frames(spark)
    assert pairs.defective_pairs(answers.limit(0), docs.limit(0)).count() == 0
    assert pairs.defective_pairs(answers.filter("answer_id = 0"), docs.limit(0)).collect()[0].defect == "empty"


def by_hand(lines):
    """Contexts of the places of each line: state and tokens of one sentence, without lists, closers and wide scripts."""
    places, ends = Counter(), Counter()
    for line in lines:
        tokens = endings.line_tokens(line)
        names, later, n, kind = ["^"], 0, 0, 0
        for k, t in enumerate(tokens):
            if t in ".!?":
                names.append(t)
                continue
            if k and tokens[k - 1] in ".!?":
                later, n, kind = 1, 0, 0
            if t[0].isalnum():
                n += 1
                kind = kind or (2 if t[0].isupper() else 3)
            names.append(endings.token_class(t))
            state = f"{later}{'-WUL'[kind]}{n if n < 5 else 5 if n < 8 else 8}"
            of = names[-3:]
            for c in {state, "|" + of[-1], "~S", *(f"{state}|{' '.join(of[-m:])}" for m in range(1, len(of) + 1))}:
                places[c] += 1
                ends[c] += k == len(tokens) - 1
    return places, +ends


@pytest.mark.parametrize("text", ["a b c", "One two. Four five", "x\ny z.", "r (s t) 12,500 N.", "", "... --- .", "The lamp of S3:T011 and\nZoë B", "a\n\nb c d e f g h i j k"])
def test_counted_contexts(text):
    got, got_ends = Counter(), Counter()
    for c, e, n in endings.Places(text.split("\n")).counts():
        got[c] += n
        got_ends[c] += e
    assert (got, +got_ends) == by_hand(text.split("\n"))


def test_endings_and_closing_marks():
    lines = ["The lamp fell.", 'He said "no."', "the lamp", "1. tent", "5.", "a tent, a lamp", "绿色的", "", "He left (see below).)", "rec-"]
    got = endings.Places(lines).endings(len(lines))
    assert got == [None, None, "0L2|^ the lamp", "0#1|^ # tent", "0#0|^ #", "0C2|, a lamp", "0W3|绿 色 的", None, None, "0L1|^ -"]


def test_held_out_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    model = pairs.fit_languages(pairs.labelled_sample(docs))
    held = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang in ('en','de','fr','es','pt','it','pl','ru','zh','ja') and length(text) > 200").collect()
    held = [(r.lang, p) for r in held if (p := model.posteriors(pairs.language_words(r.text)))]
    right = sum(max(p, key=p.get) == lang for lang, p in held)
    assert len(held) > 20 and right >= 0.9 * len(held)  # some labels are wrong


def test_common_length():
    def by_hand(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if not row else row
            before = list(row)
            for k, y in enumerate(b, 1):
                row[k] = before[k - 1] + 1 if x == y else max(before[k], row[k - 1])
        return row[-1]

    import random

    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        assert pairs.common_length(a, b) == by_hand(a, b)


def test_models_are_fitted_on_all_rows(spark, monkeypatch):
    answers, docs = frames(spark)
    n = 20_500
    many = spark.range(n).select((F.col("id") + 10_000).alias("answer_id"), F.lit(None).cast(answers.schema["messages"].dataType).alias("messages"), F.concat(F.lit("Box "), "id").alias("text"), F.lit("x").alias("defect"))
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("the box "), "id").alias("text"), F.lit("en").alias("lang"))
    fitted = {}

    def fit(asked, labelled, *args):
        fitted.update(answers=asked.filter("text like 'Box %'").count(), labelled=labelled.filter("text like 'the box %'").count())
        return real(asked.limit(50), labelled.limit(50), *args)

    real = pairs.fit_declining
    monkeypatch.setattr(pairs, "fit_declining", fit)
    pairs.defective_pairs(answers.unionByName(many), docs.unionByName(texts))
    assert fitted == {"answers": n, "labelled": n}


def features_by_hand(sentences):
    """(place, sentence) of the 1- to 3-grams of the codes of each sentence, token by token."""
    out = []
    for k, sentence in enumerate(sentences):
        words = [t for t in endings.token_pattern.findall(sentence.replace("’", "'")) if t[0].isalnum()]
        codes = ["^"]
        for n, t in enumerate(words):
            digits = any(x.isdigit() for x in t)
            codes.append("N" if n and t[0].isupper() and len(t) > 1 and not digits else "0" if digits else t.lower())
        codes = [declining._hash(c) for c in [*codes, "$"]]
        for n in (1, 2, 3):
            for g in zip(*(codes[m:] for m in range(n))):
                if n == 1 and g[0] in (codes[0], codes[-1]):
                    continue
                x = 0
                for c in g:
                    x = (x * 1_000_003 + c) % 2**64
                out.append((int(declining._place(np.array([x], np.uint64))[0]), k))
    return sorted(out)


def test_features_read_each_run_of_a_text_once(monkeypatch):
    sentences = ["Zoë’s lamp of S3:T01, Zoë's lamp!", "", "— ...", "“Zoë” N 12,500", "绿色的 灯。Zoë", "a b　c\x1cd", "rec- the\n\n The"] * 50
    places, of = declining.features(sentences)
    assert sorted(zip(places.tolist(), of.tolist())) == features_by_hand(sentences)

    class Counting:
        runs = 0

        def findall(self, text):
            self.runs += 1
            return endings.token_pattern.findall(text)

    counting = Counting()
    monkeypatch.setattr(declining, "token_pattern", counting)
    declining.features(["Quorlim vashed the tarnel, and Quorlim vashed the sorbel."] * 300)
    assert counting.runs <= 7


def test_answers_are_judged_alike_in_any_batch():
    texts = [(t, k) for k, ts in LABELLED.items() for t in ts]
    names = sorted(LABELLED)
    counts = np.zeros((len(names), 1 << pairs.GRAM_BITS))
    for t, k in texts * 20:
        for g in pairs.grams(pairs.language_words(t)):
            counts[names.index(k), pairs.gram_place(g)] += 1
    model = pairs.Languages(names, counts)
    rows = [(q, s, a) for q, s, a, _ in CASES if a is not None]
    together = pairs.read_answers(*map(list, zip(*rows)), model)
    alone = [pairs.read_answers(*([x] for x in row), model) for row in rows]
    assert together == {k: [x for of_row in alone for x in of_row[k]] for k in together}
    assert [x for x in together["told"] if x] == ["empty", "empty", "copy", "copy", pairs.FINE]
    assert [a for (_, _, a), x in zip(rows, together["differs"]) if x] == ["Der Zug war zu spät, weil niemand die Tür gemessen hatte."]


def test_languages_are_counted_by_the_words_of_each_text(spark):
    texts = [("The lamp. Zoë fell!\nBrimmo\nZoë’s S3:T01 aB c. 'Twas “no word” Then we", "en"), ("灯 and 绿色的 Zoë fell. Zoë 灯 fell", "zh"), ("12 ...", "de"), ("the lamp the lamp", "en")]
    counts = {k: Counter() for k in ("en", "zh")}
    for t, k in texts[:2] + texts[3:]:
        counts[k].update(map(pairs.gram_place, pairs.grams(pairs.language_words(t))))
    assert pairs.language_words(texts[0][0]) == ["the", "lamp", "zoë", "fell", "zoë’s", "ab", "c", "twas", "we"]
    model = pairs.fit_languages(spark.createDataFrame(texts, "text string, code string"))
    full = np.array([[counts[k][p] for p in range(1 << pairs.GRAM_BITS)] for k in model.names], float)
    assert model.names == ["en", "zh"] and np.array_equal(model.log, pairs.Languages(model.names, full).log)
