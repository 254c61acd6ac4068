import pytest

from memloom.llm import garbled
from memloom.llm.garbled import Step, catalogue, garble, restore

CLEAN = [
    "La réunion à Château-Orme a été déplacée parce que l'entrée était fermée.",
    "Zoë’s résumé is in folder №7, she said “later” and left the café.",
    "Der Zug nach Kühlbeck hatte Verspätung, weil es für das Auto zu groß war.",
    "Spotkanie przełożono, ponieważ padał deszcz i brakowało klucza do łódki.",
    "Crème brûlée — again! A jalapeño • a piñata • a façade costs €20 today.",
    "Мы хотим печь хлеб во вторник, если не будет дождя в Москве, сказал Борис.",
]


@pytest.mark.parametrize("step", [s for s in catalogue() if s.read in garbled.SINGLE and s.written in ("utf-8", "cp1252", "cp1251", "koi8_r", "iso8859_2")])
def test_restore_undoes(step):
    for text in CLEAN:
        bad = garble(text, step)
        if bad is not None and "�" not in bad:
            assert restore(bad, step) == text or step.written != "utf-8" and garble(restore(bad, step), step) == bad


def corpus():
    rows, k = [], 0
    names = ["Orlin", "Kessa", "Tavi", "Pavra", "Lorvo", "Wrenna", "Selvane", "Rosk"]
    for n, name in enumerate(names):
        for m in range(15):
            for t in CLEAN:
                rows.append((k, f"{name} wrote on page {n * 10 + m}: {t}"))
                k += 1
    bad = []
    for j, step in enumerate((Step("utf-8", "cp1252"), Step("utf-8", "cp437"), Step("cp1252", "mac_roman"), Step("utf-8", "cp1252", 2))):
        for t in CLEAN[:3]:
            g = garble(t, step)
            if g is not None and g != t:
                bad.append(k)
                rows.append((k, f"Tavi wrote on page {j}: {g}"))
                k += 1
    for t in ("Â and Ã are letters.", "ATENÇÃO — SÃO 5 CAIXAS", "plain ascii", "", None, "日本語の文です。"):
        rows.extend((k + x, t) for x in range(3))
        k += 3
    for j, c in enumerate("éûà"):
        bad.append(k)
        rows.append((k, f"Tavi wrote on page {j}: {CLEAN[4 if c == 'û' else 0].replace(c, chr(0xFFFD))}"))
        k += 1
    rows.append((k, "lost character: caf� here"))
    return rows, [*bad, k]


def test_found_and_restored(spark):
    rows, bad = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("text", "text")
    found = sorted(r.doc_id for r in garbled.garbled_documents(df, "doc_id").collect())
    assert found == sorted(bad)
    original = {r.doc_id: r.restored for r in garbled.restored_documents(df, "doc_id").collect()}
    good = sum(any(t in original[i] for t in CLEAN) for i in bad[:-4])
    assert good >= len(bad[:-4]) - 1


def test_twins_teach_the_steps(spark):
    df = spark.createDataFrame(corpus()[0], "doc_id bigint, text string")
    steps, lost = garbled.learn(df, "text", garbled.Commonness(garbled.corpus_pairs(df)))
    assert Step("utf-8", "cp1252") in steps and Step("utf-8", "cp437") in steps and lost


def test_what_twins_do_not_show_is_not_applied(spark):
    clean = [r for r in corpus()[0] if r[1] and any(t in r[1] for t in CLEAN)]
    rows = [*clean, (9000, "Nobody else wrote: " + garble(CLEAN[0], Step("utf-8", "cp1252"))), (9001, "lost character: caf� here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert garbled.learn(df, "text", garbled.Commonness(garbled.corpus_pairs(df))) == ([], False)
    assert garbled.garbled_documents(df, "doc_id").count() == 0


def test_mappings_outside_the_list_and_losses_are_learned(spark):
    words = ["première", "père", "mère", "frère", "lumière", "rivière", "manière", "barrière"]
    line = "{0} et encore {0}, puis {0} de la maison bleue du village ancien"
    rows = [line.format(w) for w in words for _ in range(4)]
    rows += [line.format(w.replace("è", "¤¦")) for w in words[:5]]
    rows += [f"{w} du vieux café fermé à côté" for w in words]
    rows += ["Un autre caf¤¦ et p¤¦re", "Une for� t"]
    rows += [f"la {x} lumineuse chambre du grand village" for x in ("forêt", "forêt", "for�t", "fenêtre", "fenêtre", "fen�tre", "étoile", "étoile", "�toile")]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    steps, lost = garbled.learn(df, "text", garbled.Commonness(garbled.corpus_pairs(df)))
    assert lost and [s.pairs for s in steps if isinstance(s, garbled.Substitution)] == [{"¤¦": "è"}]
    found = {r.doc_id: (r.restored, r.step) for r in garbled.restored_documents(df, "doc_id").collect()}
    assert all(found[k][0] == rows[k].replace("¤¦", "è") for k in range(32, 37))
    assert {k for k, v in found.items() if v[1] == garbled.LOST} == {k for k, t in enumerate(rows) if "�" in t}


def test_twins_without_ascii_letters(spark):
    clean = ["Мы хотим печь хлеб во вторник, если не будет дождя.", "Поезд опоздал на 40 минут, потому что шёл дождь.", "记录里写着，三月初买的那个望远镜是白色的 5 。"]
    rows = [t for t in clean for _ in range(6)] + [garble(clean[0], Step("utf-8", "cp1252")), garble(clean[1], Step("koi8_r", "cp1251")), garble(clean[2], Step("gb18030", "cp1252"))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    steps, _ = garbled.learn(df, "text", garbled.Commonness(garbled.corpus_pairs(df)))
    assert {Step("utf-8", "cp1252"), Step("koi8_r", "cp1251"), Step("gb18030", "cp1252")} <= set(steps)
    assert sorted(r.doc_id for r in garbled.garbled_documents(df, "doc_id").collect()) == [18, 19, 20]


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, garbled string, w string")
    assert garbled.garbled_documents(df, "doc_id").count() == 0
    df = spark.createDataFrame([(None, None, "x", "y"), (1, "é" * 30_000, None, None)], "doc_id bigint, text string, garbled string, w string")
    assert garbled.garbled_documents(df, "doc_id").count() == 0


@pytest.mark.parametrize("word", ["CrÃ¨me", "日本語の文", "Ã\x81b", "ÄÖÜ", "縺ゅｊ縺�", "piñata", "Р°С‚", "ÕÕÆ¬", "한국어", "x�y", "é"])
def test_readings_leave_nothing_out(word):
    able, utf8 = garbled.readings(word)
    for step in catalogue():
        if step.read not in (utf8 if step.written == "utf-8" else able):
            assert restore(word, step) == word


def test_text_restored_whole_when_the_memo_is_emptied():
    clean = CLEAN[0]
    pairs = {}
    for w in clean.split():
        for a, b in zip(f" {w} ", f"{w} "):
            pairs[a + b] = pairs.get(a + b, 0) + 100
    step = Step("utf-8", "cp1252")
    judge = garbled.Judge(garbled.Commonness(pairs), [step])
    judge.memo.update((str(k), []) for k in range(300_000))
    assert judge.judge(garble(clean, step)) == (True, clean, step.name)


def test_all_pairs_of_a_large_alphabet_are_counted(spark):
    chars = [chr(0x4E00 + k) for k in range(650)]
    df = spark.createDataFrame([(" ".join(a + b for b in chars),) for a in chars], "text string")
    pairs = garbled.corpus_pairs(df)
    assert len(pairs) == 650 * 650 + 2 * 650
    assert pairs.get(chars[3] + chars[640]) == 1 and pairs.get(" " + chars[5]) == 650 and pairs.get("xy") == 0
    common = garbled.Commonness(pairs)
    assert common.single[" "] == common.first[" "] == 650 * 650


def test_twins_that_are_both_wrong_speak_for_no_step(spark):
    words = "хлеб дождь лампа письмо поезд ужин лодка ключ дверь корова".split()
    sentences = [f"мы видели {w} вечером и потом долго думали об этом." for w in words]
    bad = [garble(t, Step("utf-8", read)) for t in sentences for read in ("mac_roman", "cp1251")]
    right = [*sentences * 3, *["voilà la clé, à côté de la maison"] * 300, *["τιμή 6 €"] * 20]
    df = spark.createDataFrame(list(enumerate([*bad, *right])), "doc_id bigint, text string")
    steps, _ = garbled.learn(df, "text", garbled.Commonness(garbled.corpus_pairs(df)))
    assert set(steps) == {Step("utf-8", "mac_roman"), Step("utf-8", "cp1251")}
    assert sorted(r.doc_id for r in garbled.garbled_documents(df, "doc_id").collect()) == list(range(len(bad)))


def test_pairs_of_two_directions_speak_for_the_better_supported():
    steps = [Step("cp1252", "cp850"), Step("cp850", "cp1251"), Step("utf-8", "cp1251")]
    common, explainer = garbled.Commonness({"aò": 120, "a•": 100, "a’": 500, "éa": 500}), garbled.Explainer(steps)
    assert explainer.explain("•", "ò") == [1] and not explainer.speaks("•", "ò", [1], {0: 5, 1: 4}, common)
    assert explainer.speaks("•", "ò", [1], {0: 4, 1: 4}, common)
    assert explainer.speaks("Æ", "’", [0], {0: 1, 1: 4}, common)
