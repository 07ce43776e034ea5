"""Defects, text types, repetition, sentences."""

import random
import time

import pytest

from tallyloom.llm import defects, refusals, repetition, sentences, texttypes
from tallyloom.llm.pairs import CHECKS, defective, with_prompts
from tallyloom.llm.q_sentences import sentence_ends
from tallyloom.llm.queries import QUERIES, SQL

PROMPT = "What is the cache layer good for, in everyday words?"
PROSE = "The cache layer keeps what was asked for before. It saves a trip to the store, and users notice it at once."


@pytest.mark.parametrize(
    ("text", "prompt", "defect"),
    [
        (None, PROMPT, "empty"), ("", PROMPT, "empty"), ("​ \n", PROMPT, "empty"), ("```\n```", PROMPT, "empty"), ("(no output)", PROMPT, "empty"), ("N/A", PROMPT, "empty"), ("<br>", PROMPT, "empty"), ("（空）", PROMPT, "empty"),
        ("I'm sorry, but I can't help with that.", PROMPT, "refusal"), ("I'm going to have to sit this one out.", PROMPT, "refusal"), ("We'll leave that unanswered. Thank you for understanding.", PROMPT, "refusal"), ("抱歉，这个问题我无法回答。请咨询专业人士。", "缓存层有什么用？", "refusal"), ("Leider muss ich diese Bitte ablehnen.", "Was macht der Cache?", "refusal"), ("申し訳ありませんが、回答を控えさせていただきます。", "キャッシュとは何ですか？", "refusal"),
        ("Désolé, je ne peux pas répondre à cette demande.", "À quoi sert le cache ?", "refusal"), ("Lo siento, prefiero no contestar.", "¿Para qué sirve la caché?", "refusal"),
        ("Apologies: I cannot comply. Please choose a different question.", PROMPT, "refusal"), ("The cache cannot recover on its own, and nobody can help it without a restart. " + PROSE, PROMPT, None),
        ("I cannot comply with the old limit, so the new one is 5. " + PROSE, PROMPT, None),
        (PROMPT, PROMPT, "copied_question"), (f"Your question: {PROMPT.lower()}", PROMPT, "copied_question"), (f"Q: {PROMPT}\nA:", PROMPT, "copied_question"), (f"{PROMPT}\n{PROMPT}", PROMPT, "copied_question"), (f"{PROMPT}\n\n{PROSE}", PROMPT, None),
        ("Die Schlange bleibt kurz, weil der Dienst nur noch zwei Sekunden braucht.", PROMPT, "other_language"), (PROSE, "缓存层有什么用？", "other_language"), (PROSE, "缓存层变慢的原因，麻烦用英语回答", None), ("缓存层保存以前问过的内容，所以第二次很快。", "缓存层变慢的原因，麻烦用英语回答", "other_language"),
        ("이 위험은 당분간 받아들이고 다음 달에 다시 봅니다. 먼저 연결 한도를 확인해 주세요.", PROMPT, "other_language"),
        (PROSE + " It also makes the", PROMPT, "truncated"), (PROSE + "\n\n```python\ndef f(x):\n    return", PROMPT, "truncated"), (PROSE + "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |", PROMPT, "truncated"), (PROSE + " One comment says “never do this", PROMPT, "truncated"), (PROSE + "\n\n- one thing,", PROMPT, "truncated"), (PROSE + " It has two parts (one for reads\n\nand one for writes", PROMPT, "truncated"), ("It keeps (in a store\n\nand in memory) what was asked for. " + PROSE, PROMPT, None), (PROSE + " It is 3 (three\n\nCommand: audit run --mode diff", PROMPT, "truncated"),
        (PROSE, PROMPT, None), (PROSE + "\n\n```python\nx = 1\n```", PROMPT, None), (PROSE + "\n\nCommand: audit run --mode diff", PROMPT, None), (PROSE + "\n\n| a | b |\n|---|---|\n| 1 | 2 |", PROMPT, None), (PROSE, None, None),
    ],
)
def test_defects(text, prompt, defect):
    assert defects.examine(text, prompt)[0] == defect


PROMPTS = {"en": PROMPT, "de": "Was macht der Cache und warum ist er so langsam?", "fr": "À quoi sert le cache et pourquoi est-il lent ?", "es": "¿Para qué sirve la caché y por qué es tan lenta?", "zh": "缓存层有什么用？"}
ANSWERS = {
    "it": "La cache conserva quello che è stato chiesto prima. Così la seconda richiesta è più veloce e gli utenti non aspettano.", "pt": "A cache guarda o que foi pedido antes. Assim o segundo pedido é mais rápido e os utilizadores não esperam.", "nl": "De cache bewaart wat eerder is gevraagd. Daardoor gaat het de tweede keer sneller en wachten de gebruikers niet.",
    "pl": "Pamięć podręczna przechowuje to, o co pytano wcześniej. Dzięki temu drugie zapytanie trwa krócej i nikt nie czeka na odpowiedź.", "tr": "Önbellek daha önce sorulanları saklar. Bu yüzden ikinci istek daha hızlıdır ve kullanıcılar beklemez.", "sv": "Cachen sparar det som har frågats tidigare. Därför går den andra frågan snabbare och användarna slipper vänta.", "da": "Cachen gemmer det, der er blevet spurgt om før. Derfor går det hurtigere anden gang, og brugerne slipper for at vente.",
    "fr": "Le cache garde ce qui a été demandé. Il évite un trajet vers le dépôt.", "es": "La caché guarda lo que ya se pidió. Así se evita un viaje al almacén.", "de": "Der Cache hält, was schon gefragt wurde. Das spart einen Weg zum Speicher.", "en": PROSE, "zh": "缓存层保存问过的内容。",
}


@pytest.mark.parametrize("expected", sorted(PROMPTS))
def test_any_other_language(expected):
    assert [a for a, text in ANSWERS.items() if not defects.other_language(text, PROMPTS[expected])] == [expected]


def test_short_and_asked_languages():
    assert defects.other_language("很快。", PROMPT) and defects.other_language("It is fast.", PROMPTS["zh"]) and defects.other_language("Non è così.", PROMPT) and defects.other_language("很快。", "Explain cache layers")
    assert not any(defects.other_language(t, PROMPTS["zh"]) for t in ("很快。", "Redis", "Redis cache"))
    assert not defects.other_language("No.", PROMPT) and not defects.other_language("二時間以内。", "キャッシュはいつ消えますか？")
    assert not defects.other_language(ANSWERS["nl"], "Answer in Dutch: what is it?") and not defects.other_language(ANSWERS["pl"], "请用波兰语回答") and defects.other_language(PROSE, "Answer in Polish: what is it?")
    assert not defects.other_language(ANSWERS["it"], "Cosa fa la cache e perché non è veloce?") and not defects.other_language(ANSWERS["pl"], "Do czego służy pamięć podręczna i dlaczego jest wolna?")


@pytest.mark.parametrize("refusal", ["I'm sorry, but I can't help with that. Please ask a different question. ", "抱歉，这个问题我无法回答。请咨询专业人士。\n"])
def test_long_refusals(refusal):
    assert defects.examine(refusal * 100, PROMPT)[0] == "refusal"
    assert not refusals.is_refusal(refusal * 100 + PROSE)


@pytest.mark.parametrize("prompt", [PROMPT, "缓存层有什么用？"])
def test_copies_of_any_number(prompt):
    for times in (1, 4, 5, 50):
        assert defects.examine("\n".join([prompt] * times), prompt)[0] == "copied_question"
    assert not defects.is_copy("\n".join([prompt] * 50) + PROSE * 30, prompt)


def test_copies_equal_tiling_alone():
    rnd = random.Random(8)
    for _ in range(500):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 30)))
        a = "".join(p[rnd.randrange(len(p)) :] if rnd.random() < 0.7 else rnd.choice("abcx") * 3 for _ in range(rnd.randrange(1, 9)))
        covered, of_prompt = defects.tiled(a, p, min(5, max(2, len(p) // 4)))
        whole = of_prompt >= 0.8 * len(p) and len(a) - covered <= max(14, 0.25 * len(a)) and covered >= 0.6 * len(a)
        assert defects.is_copy(a, p) == whole


def naive_tiling(a, p, least):
    """Greedy string tiling as it is defined, over all pairs of places; the prompt's characters count down."""
    times = -(-len(a) // max(len(p), 1))
    taken, left, out = [False] * len(a), [times] * len(p), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(p)):
                n = 0
                while i + n < len(a) and j + n < len(p) and a[i + n] == p[j + n] and not taken[i + n] and left[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < max(least, 1):
            return out
        out.append(n)
        for k in range(n):
            taken[i + k], left[j + k] = True, left[j + k] - 1


def test_tiles_equal_brute_force():
    rnd = random.Random(7)
    words = "cache layer store queue gate reader panel score merge audit".split()
    for _ in range(150):
        p = " ".join(rnd.sample(words, rnd.randrange(3, 9)))
        parts = [" ".join(p.split()[rnd.randrange(3) :]) if rnd.random() < 0.5 else rnd.choice(words) for _ in range(rnd.randrange(1, 5))]
        a = " ".join(parts)
        assert defects.tiled(a, p, 4)[0] == sum(naive_tiling(a, p, 4))


def test_tiles_take_the_longest_first_and_both_sides():
    # From the left "abc" would be taken first and break "bcdefg"; and "xy" stands once in the prompt.
    assert defects.tiled("abcdefg", "abc-bcdefg", 3) == (6, 6)
    assert defects.tiled("abcdefg", "bcdefg-abc", 2) == (6, 6)
    assert defects.tiled("abc1abc2abc", "abc-456789", 3)[0] == 6


def test_shuffled_and_padded_copies():
    words = PROMPT.rstrip("?").split(", ")
    assert defects.is_copy(f"{words[1]} {words[0]}", PROMPT) and defects.is_copy("In everyday words: what is the cache layer good for?", PROMPT)
    assert not defects.is_copy("For everyday use a layer of cached words is good.", PROMPT)


@pytest.mark.parametrize("times", [1, 10, 100])
def test_defects_at_any_length(times):
    long = " ".join([PROSE] * times)
    for tail in (" It also makes the", "\n\n```python\ndef f(x):\n    return", "\n\n- one thing,", " One comment says “never do this", "\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |"):
        assert defects.examine(long + tail, PROMPT)[0] == "truncated"
    assert defects.examine(long, PROMPT)[0] is None and defects.examine(long, PROMPTS["zh"])[0] == "other_language"
    assert defects.examine("\n".join([PROMPT] * times), PROMPT)[0] == "copied_question"
    assert defects.examine("I'm sorry, but I can't help with that. " * times, PROMPT)[0] == "refusal"
    assert defects.examine("​ \n" * times, PROMPT)[0] == "empty"


@pytest.mark.parametrize("text", ["x " + "([" * 30_000 + "}" * 30_000, "x " + "([" * 30_000 + "])" * 30_000, "「(" * 20_000 + ")" * 20_000, '"(' * 30_000, "“" * 30_000 + ")" * 30_000, "（" * 20_000 + "\n\n" * 20_000, "(a\n\n" * 10_000 + ")" * 10_000])
def test_mixed_openers_take_linear_time(text):
    began = time.time()
    defects.parse(text)
    sentences.ends(text)
    assert time.time() - began < 4


def test_defective_over_tables(spark):
    rows = [(1, "Case-1 ", PROSE), (2, "case-1", None), (3, "gone", None), (4, None, None), (5, "CASE-1", PROSE + "\n\n- notice it at once"), (6, "case-1", PROSE + "\n\n- notice it at onc"), (5, "case-1", None)]
    answers = spark.createDataFrame(rows, "key bigint, id string, text string")
    cases = spark.createDataFrame([("case-1", PROMPT, "x"), ("CASE-1", PROMPT, "y"), (None, "p", "z")], "id string, prompt string, salt string")
    found = lambda a, c: defective(texttypes.measure(with_prompts(a, c), "key", "text", ("judged",), CHECKS, ("prompt", "judged")))
    got = sorted((r["key"], r["defect"]) for r in found(answers, cases).collect())
    assert got == [(2, "empty"), (5, "empty"), (6, "truncated")]
    assert found(answers.limit(0), cases).count() == 0
    assert found(answers, cases.limit(0)).count() == 0


LISTS = ["- " + "\n- ".join(["cache store", "queue", "merge gate", "ledger row", "panel"] * 2), "\n".join(f"name {i}: {i * 7}" for i in range(9)), "\n".join(f"src/main/app/File{i}.java" for i in range(9))]
TABLES = ["a,b,c\n" + "\n".join(f"row{i},{i},{i * 2}" for i in range(9)), "| a | b |\n|---|---|\n" + "\n".join(f"| x{i} | {i} |" for i in range(9)), "a\tb\n" + "\n".join(f"r{i}\t{i}\t{i}" for i in range(9))]
JUNK = ["".join(random.Random(1).choice("!@#$%^&*<>{}[]|;:") for _ in range(200)), "QUJD" * 40 + "1x==", " ".join("xkcd bfgh trpl zzkq mnbv".split() * 8), "<div class=a1><span class=b2></div>&nbsp;<td class=c3>" * 6]


def test_text_types(spark):
    rnd = random.Random(2)
    prose = [f"{PROSE} The gate number {i} was {rnd.choice(['slow', 'fast'])} in the last run, and we looked at it again." for i in range(60)]
    rows = [(i, t) for i, t in enumerate(prose + LISTS * 4 + TABLES * 4 + JUNK * 3)] + [(900, None), (901, ""), (902, "- a"), (903, "```\nx = 1\ny = 2\nfor i in range(9): print(i)\n```")]
    df = spark.createDataFrame([(*r, "votes") for r in rows], "k int, t string, kind string")
    typed = texttypes.typed(texttypes.measure(df, "k", "t"))
    got = {r["key"]: r["kind"] for r in texttypes.no_prose(typed).collect()}
    expected = {i: kind for i, (_, kind) in enumerate([(None, None)] * 60 + [(None, "list")] * 12 + [(None, "table")] * 12 + [(None, "junk")] * 12) if kind}
    assert got == expected
    for r in typed.collect():
        assert abs(sum(r[f"p_{t}"] for t in texttypes.TYPES) - 1) < 1e-9
    empty = texttypes.typed(texttypes.measure(df.limit(0), "k", "t"))
    assert empty.count() == 0


def drawn(n, rates, seed=3, shares=(0.7, 0.1, 0.1, 0.1, 0, 0, 0)):
    """Vote patterns of ``n`` texts; ``rates`` gives (own, other) for each function."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rnd.choices(range(len(texttypes.LATENT)), shares)[0]
        out.append((sum((rnd.random() < rates[i][0 if texttypes.SPEAKS[i][kind] else 1]) << i for i in range(len(texttypes.NAMES))), kind))
    return out


def patterns(texts):
    counts = {}
    for v, _ in texts:
        counts[v] = counts.get(v, 0) + 1
    return sorted(counts.items())


def accuracy(texts, model):
    kinds = [texttypes.TYPES.index(k) for k in texttypes.LATENT.values()]
    found = texttypes.posterior(texttypes.bits_of([(v, 1) for v, _ in texts]), model).argmax(1)
    return sum(int(f) == kinds[k] for f, (_, k) in zip(found, texts, strict=True)) / len(texts)


def test_em_learns_accuracies():
    rates = [(0.9, 0.05)] * len(texttypes.NAMES)
    own, other, shares = texttypes.fit(patterns(drawn(4000, rates)))
    assert abs(shares[0] - 0.7) < 0.05
    spoken = [i for i in range(len(own)) if texttypes.SPEAKS[i][:4].any()]
    assert all(abs(own[i] - 0.9) < 0.1 and abs(other[i] - 0.05) < 0.1 for i in spoken)


def test_without_the_fit_types_are_worse():
    """Functions that fire at random or against their type: only the fit finds out."""
    bad = {"ends", "entries", "rows", "many_lines", "symbols", "rare"}
    rates = [(0.5, 0.5) if name in bad else (0.85, 0.1) for name, _ in texttypes.NAMES]
    texts = drawn(3000, rates, shares=(0.5, 0.15, 0.15, 0.2, 0, 0, 0))
    fitted, started = accuracy(texts, texttypes.fit(patterns(texts))), accuracy(texts, texttypes.starting_model())
    assert fitted > started + 0.05 and fitted > 0.85


def test_without_the_fit_the_rows_of_the_tables_differ(spark):
    from pathlib import Path

    from tallyloom.llm.q_texts import outputs

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    rows = texttypes.measure(outputs(spark, folder), "run_key", "output").cache()
    with_fit, without = ({tuple(r) for r in texttypes.no_prose(texttypes.typed(rows, model)).select("key", "kind").collect()} for model in (None, texttypes.starting_model()))
    assert len(with_fit ^ without) >= 5
    rows.unpersist()


# --- repetition -------------------------------------------------------------------------------------------------------
def naive_share(text):
    """Every unit against every earlier place."""
    flat, spans = [], []
    for piece in repetition._BREAK.split(text):
        u = repetition.units(repetition._MARK.sub("", piece, count=1))
        if u:
            spans.append((len(flat), len(flat) + len(u)))
            flat += u
    hit = [False] * len(flat)
    for i, (a, b) in enumerate(spans):
        if any(flat[c:d] == flat[a:b] for c, d in spans[:i]):
            hit[a:b] = [True] * (b - a)
    n = repetition.WORDS
    for i in range(len(flat) - n + 1):
        if any(flat[j : j + n] == flat[i : i + n] for j in range(i)):
            hit[i : i + n] = [True] * n
    return sum(len(u) for u, h in zip(flat, hit, strict=True) if h) / max(sum(map(len, flat)), 1)


def test_share_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        text = " ".join(rnd.choice(["a", "bb", "c.", "dd", "e!"]) for _ in range(rnd.randrange(40)))
        assert abs(repetition.repeated_share(text) - naive_share(text)) < 1e-12


def test_share_cases():
    assert repetition.repeated_share(None) == repetition.repeated_share("") == repetition.repeated_share("...") == 0
    assert repetition.repeated_share("ok " * 50) > 0.9 and repetition.repeated_share("好的" * 40) > 0.9
    assert repetition.repeated_share("Check the limit.\n1. CHECK  the limit!\n2) check the limit") == pytest.approx(2 / 3)
    assert repetition.repeated_share(PROSE) == 0


def test_certified_cutoffs():
    assert repetition.tail(0, 100, 0.05) == pytest.approx(0.95**100)
    assert repetition.tail(0, 0, 0.05) == 1
    # Two strata: one with many clean documents, one with too few to certify anything at the same share.
    tests = {("many", c): repetition.tail(0, 2000, 0.05) for c in (0.1, 0.2)} | {("few", c): repetition.tail(0, 10, 0.05) for c in (0.1, 0.2)}
    assert repetition.certified(tests) == {"many": [0.1, 0.2]}
    assert repetition.certified({}) == {}
    few = repetition.least_alpha(10, 4)
    assert repetition.tail(0, 10, few) == pytest.approx(0.05 / 4) and repetition.certified({("few", c): repetition.tail(k, 10, few) for c, k in ((0.1, 3), (0.2, 0), (0.3, 0), (0.4, 0))}) == {"few": [0.2, 0.3, 0.4]}


def found_in(df):
    return repetition.repetitive(repetition.scored(df, "k", "t"), lambda keys: df.selectExpr("k as key", "t as text").join(keys, "key", "left_semi"))


def planted(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    sentence = lambda: " ".join(word() for _ in range(rnd.randrange(5, 14))) + "."
    rows = []
    for i in range(n):
        if i % 8:
            rows.append((i, " ".join(sentence() for _ in range(rnd.randrange(2, 9)))))
        else:
            part = rnd.choice([sentence(), sentence() + " " + sentence(), word() + " " + word() + ", "])
            rows.append((i, " ".join([sentence()] + [part] * rnd.randrange(3, 9))))
    return rows


@pytest.mark.parametrize("n", [80, 1200])
def test_cutoffs_find_what_the_rule_finds(spark, n):
    rows = [*planted(n, n), (10_000, None), (10_001, ""), (10_002, "x" * 50_000), (10_003, "好的" * 5000), (10_003, "好的" * 5000), (10_004, "..")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "k int, t string, stratum string")
    got = [r["key"] for r in found_in(df).collect()]
    truth = {k for k, t in rows if repetition.repeated_share(t) >= repetition.LEAST_SHARE}
    both = len(truth & set(got))
    assert both >= 0.9 * len(truth) and both >= 0.9 * len(set(got)) and got.count(10_003) == 2
    assert found_in(df.limit(0)).count() == 0


def test_short_repeated_sentences_are_scored(spark):
    rows = [r for r in planted(400, 9) if r[0] % 8]
    rows.append((1000, " ".join(f"Nothing changed again. {t.split()[0]} {t.split()[1]}." for _, t in rows[:7])))
    df = spark.createDataFrame(rows, "k int, t string")
    assert repetition.repeated_share(rows[-1][1]) >= 0.4
    assert [r["key"] for r in found_in(df).collect()] == [1000]


def test_recall_against_the_rule_on_the_tables(spark):
    from pathlib import Path

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    got = {r["run_key"] for r in QUERIES["p5_found"](spark, folder).collect()}
    no_case = {r["run_key"] for r in QUERIES["p3_found"](spark, folder).select("run_key").collect()}
    truth = {r["run_key"] for r in QUERIES["p5_shares"](spark, folder).where("share >= 0.4").collect()} - no_case
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)


# --- sentences --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "units",
    [
        ["One.", "Two!", "Three?!"], ["See Fig. 3 and No. 5, e.g. the U.S. part.", "Next."], ["It ran until 7 a.m.", "Then it stopped at 5 p.m. on Monday."], ["He said “Stop. Now.” and left.", "“Go!”", "We went."], ["It took 3.5 s with Node.js; the rest (see b.py. It is short.) is fine.", "src/a.py is next."],
        ["We waited...", "Nothing came ... and then it broke."], ["Am 5. Mai lief es, z. B. am Abend.", "Das gilt für Importe usw.", "Ende."], ["Die Prüfung schrieb: »Eins. Zwei.« und schloss.", "Fertig."], ["C'est vrai, p. ex. ici.", "« Qui ? » fut la question."],
        ["第一句。", "他说：“停。再看。”然后走了。", "停！", "“谁？”是问题。", "等了很久……", "版本……但没人用。"], ["一句。", "備考には「やめて。戻して。」と書いた。", "次です．", "最後？"], ["ถ้าเรียก f สองครั้งจะซ้ำ", "โปรดตรวจก่อน", "รุ่น 3.1 ยังใช้ Node.js อยู่"],
        ["समीक्षक ने लिखा “रुकें। वापस।” और काम बंद किया।", "फिर।"], ["كتب: «توقفوا. نعود.» ثم أغلق التذكرة.", "هل نحذف؟", "لا."], ["담당자는 “멈추세요. 보세요.”라고 적었습니다.", "끝."], ["Проверены все, т. е. два.", "Стоп."], ["Это касается правил и т. п.", "Прочтите п. 9 и т. д.", "Конец."], ["Das gilt für Regeln u. v. m.", "Ende."],
    ],
)
def test_sentences(units):
    text = " ".join(units) if not any("一" in u or "。" in u for u in units) else "".join(units)
    found, a = [], 0
    for e in sentences.ends(text):
        found.append(text[a:e].strip())
        a = e
    assert found == units


def ends_of(text):
    found, a = [], 0
    for e in sentences.ends(text):
        found.append(text[a:e].strip())
        a = e
    return found


def test_the_path_through_terminators_turns_single_choices():
    text = "It stopped at 5 p.m. Monday. Then it ran in the U.S. Congress. It ran until 7 a.m. Nobody saw it."
    assert ends_of(text) == ["It stopped at 5 p.m. Monday.", "Then it ran in the U.S. Congress.", "It ran until 7 a.m.", "Nobody saw it."]
    # Alone, the terminators of "p.m." and "U.S." speak for an end, as the one of "a.m." does.
    for before, after in (("It stopped at 5 p.m", " Monday. Then it ran"), ("it ran in the U.S", " Congress. It ran"), ("It ran until 7 a.m", " Nobody saw it.")):
        end, inside = sentences.readings(before, ".", after, False)
        assert end < inside


def test_the_word_lattice_turns_single_signs():
    # 就 goes on with the sentence before it, 就目前 opens one; the lattice tells which word stands there.
    assert sentences.lattice("就目前的") != tuple("就目前的") and sentences.lattice("就目前的")[0] == "就目前"
    assert sentences.spaceless_gap("等了很久", "就目前的记录看", "dots") and not sentences.spaceless_gap("等了很久", "就走了", "dots")
    # A run is segmented whole: what stands more signs before the gap than any window decides too.
    assert not sentences.spaceless_gap("记录" * 40 + "因为", "他走了", "line") and sentences.spaceless_gap("记录" * 40, "他走了", "line")


def test_blocks():
    text = "# Head\n\nA line\r\nthat goes on. Second.\n\n- item one. More\n2) item\n\n| a | b |\n|---|---|\n| c. D | e |\n\n```py\nx. Y\n\nz\n```\nAm\n5. Mai war es.\n"
    got, a = [], 0
    for e in sentences.ends(text):
        got.append(text[a:e].strip())
        a = e
    assert got == ["# Head", "A line\r\nthat goes on.", "Second.", "- item one.", "More", "2) item", "| a | b |", "|---|---|", "| c. D | e |", "```py\nx. Y\n\nz\n```", "Am\n5. Mai war es."]


def test_sentence_ends_are_positions(spark):
    texts = [(1, "Eins. 😀 Zwei."), (2, None), (3, ""), (4, " \n"), (5, "x" * 100_000), (6, "no end"), (6, "no end")]
    df = spark.createDataFrame([(*t, 0) for t in texts], "id int, t string, key int")
    got = {}
    for r in sentence_ends(df, "id", "t").collect():
        got.setdefault(r["key"], []).append(r["end_char"])
    assert sorted(got) == [1, 5, 6] and max(got[1]) == len(texts[0][1]) and got[5] == [100_000] and got[6] == [6, 6]


@pytest.mark.parametrize("part", ["a", ". ", '"', "(", "的", "停。", "- x\n", "|", "A. B. ", "ก ", "«»", "…", "\n", "a/", "`", "<a ", "1", "word "])
def test_long_texts_take_linear_time(part):
    text = part * (60_000 // len(part))
    began = time.time()
    for f in (sentences.ends, repetition.repeated_share, texttypes.votes, defects.closings, lambda t: defects.examine(t, t[:20_000])):
        f(text)
    assert time.time() - began < 20


# --- all queries ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_equals_its_sql(spark, name):
    from collections import Counter
    from pathlib import Path

    import duckdb

    from compare import plain

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert mine
    if name in SQL:
        con = duckdb.connect()
        for path in Path(folder).glob("*.parquet"):
            con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
        cursor = con.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        order = [names.index(c) for c in columns]
        assert mine == Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
