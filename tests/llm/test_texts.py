"""Cut texts and broken pairs."""

import random

import pytest

from weftline.llm import completeness as c
from weftline.llm import languages, pairs

WHOLE = ["It ends.", "Does it?", "Yes!", "所求的数是19。", "done ∎", "and so it follows. QED", "The result is \\(x = 3\\)", "So. $$x = 12$$", "7", "**12**", "3/4", "$5$", "\\(x = 9\\)", "12 (apples)", "45 apples", 'He said "it ends."', '"Is it so?"', "First. Then all (and there is no third case).", "What is it? (algebra)", "`code`. Fine.", "It is 4.\n", "I have 5 pears. Answer: 9 pears", "See [1].", "The end.\u200b", "(It ends.)", 'We ask: "What is it? (algebra)"', '"What is it? (algebra)"']
CUT = ["Then we mult", "the values 3, 5,", "and that is what...", "the path is…", "so only �", "he said \\u00", "a &quo", "the case \\", "(see the yard ab", "turns into \\(4u = 5", "The sum is 7. Putting \\(u = 4\\) turns", "First. Then all of them,", "It holds for 3 and", "```\nx = 1\n", "the words of Ann, \"it return", "Since 7 leaves 3, the next: ", "Weil der Rest 3 beträgt,", "I have 5 pears. Answer: 9 pea"]


@pytest.mark.parametrize("t", WHOLE)
def test_whole(t):
    assert c.ending(t) == "whole"


@pytest.mark.parametrize("t", CUT)
def test_cut(t):
    assert c.ending(t) == "cut"


@pytest.mark.parametrize("t", [None, "", "  ", "\u00a0", "N/A", "null", "[]", "(no answer)", "...", "**-**", "Answer:", "\u200b"])
def test_stand_ins(t):
    assert c.is_stand_in(t) and c.ending(t) == "none" and pairs.defect("q", t) == "empty_answer"


def test_unclosed():
    assert c.unclosed("a (b [c] \\(d") == ["(", "\\("] and c.unclosed("$a$ $$b$$ “c” \"d\" (e))") == [] and c.unclosed("``` ( $ ``` (") == ["("]
    assert c.unclosed("(" * 50_000 + "]" * 50_000) == ["("] * 50_000 and c.unclosed("„a“ «b» “c” 「d") == ["「"]


SENTENCES = ["Each round changes the total by seven, which is constant.", "No such pair can exist below nine, since the yard would hold more.", "The pale choices are independent, hence their number is four."]


def test_limits_by_spikes_and_copies(spark):
    rng = random.Random(0)
    text = lambda: " ".join(rng.choice(SENTENCES) for _ in range(8))
    rows = []
    for i in range(40):
        rows.append((f"a{i}", "cutter", (text() + "é" * (i % 2))[:200].strip(), None))
        rows.append((f"b{i}", "keeper", text(), None))
    at = "x" * 188 + ". Total: 7 u"  # 200 characters: an ending that only its length gives away
    rows += [("weak", "cutter", at, None), ("copy", "keeper", at, None), ("free", "keeper", at.replace("7", "8"), None)]
    rows += [("weak", "cutter", at, None), (None, "cutter", "cut of", None), ("n", None, "Then we mult", None), ("e", "keeper", "", "x")]
    df = spark.createDataFrame(rows, "id string, dataset string, answer string, chars string")
    values = c.judged(df, {"answer": None})
    got = {r.id for r in c.settle(values).where("cut").collect()}
    ends = {i for i, _, t, _ in rows if i and c.ending(t) == "cut"}
    assert got == ends | {"weak", "copy"} and len(ends) > 30
    assert {(r.unit, r.length) for r in c.spikes(values).collect() if r.source == "cutter"} >= {("chars", 200)}
    rate = {(r.source, r.field): (r.n_values, r.n_cut) for r in c.rates(c.settle(values)).collect()}
    assert rate["keeper", "answer"] == (42, 1) and rate[None, "answer"] == (1, 1)
    assert c.settle(c.judged(df.limit(0), {"answer": None})).count() == 0


@pytest.mark.parametrize("t", ["I'm sorry, but I can't help with this request. Please try a different question.", "**Note:** answering would go against my guidelines.", "Es tut mir leid, dabei kann ich nicht helfen.", "Je dois décliner cette tâche. Posez une autre question, s'il vous plaît.", "Lo siento, pero no me está permitido responder a eso.", "apologies, i must pass on the question of Ann", "As a language assistant, I won’t be providing a solution here."])
def test_refusals(t):
    assert pairs.refuses(t)


@pytest.mark.parametrize("t", ["Sorry for the long route: a direct count is not possible here. Subtracting the two conditions leaves 54 copies.", "I cannot see a shorter way, but the table with 36 rows settles it.", "No such pair can exist.", "7", "Thanks for asking."])
def test_no_refusals(t):
    assert not pairs.refuses(t)


Q = "At the depot a pale yard holds 54 litres of zeo. The team of Ann needs 30 minutes where Bob needs 4. How many zeo remain when Bob reaches the yard?"


def test_copies():
    for a in (Q, Q.upper(), f"Q: {Q}", f'The question is: "{Q}"', Q.replace("pale ", ""), "  ".join(Q.split())):
        assert pairs.defect(Q, a) == "copies_question"
    assert pairs.defect(Q, f"We are asked: {Q} {' '.join(SENTENCES)}") is None
    shuffled = Q.split()
    random.Random(1).shuffle(shuffled)
    assert not pairs.copies(Q, " ".join(shuffled)) and not pairs.copies("", "") and not pairs.copies("a b c d", "")


def test_tiles_against_definition():
    assert pairs.tiles("a b c x d e f".split(), "d e f y a b c".split()) == 6 and pairs.tiles("a b".split(), "a b".split()) == 0
    assert pairs.tiles(["a"] * 300, ["a"] * 200) == 200
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(14))] for _ in range(2))
        assert pairs.tiles(a, b) == by_definition(a, b)
    assert pairs.copies("a b " * 100_000, "a b " * 100_000 + "c")


def by_definition(a, b, least=3):
    marked_a, marked_b, covered = set(), set(), 0
    while True:
        runs = []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in marked_a and j + k not in marked_b:
                    k += 1
                if k >= least:
                    runs.append((-k, -i, j))
        if not runs:
            return covered
        top = min(r[0] for r in runs)
        for k, i, j in sorted(r for r in runs if r[0] == top):
            k, i = -k, -i
            if not marked_a & set(range(i, i + k)) and not marked_b & set(range(j, j + k)):
                marked_a |= set(range(i, i + k))
                marked_b |= set(range(j, j + k))
                covered += k


def test_languages():
    assert languages.language("Wie viele Stücke bleiben, wenn der Rest nicht durch die Zahl teilbar ist?") == "de"
    assert languages.language("Le nombre cherché est le plus petit des deux.") == "fr" and languages.language("El número buscado es el menor de los dos.") == "es"
    assert languages.language("所求的数是19。") == "zh" and languages.language("Искомое число равно 8843.") == "ru"
    assert languages.language("12 \\(the x\\)") is None and languages.language("") is None
    assert pairs.defect(Q, "Le nombre cherché est le plus petit des deux.") == "other_language" and pairs.defect(Q, "$x = 5$") is None


def test_defects_of_a_table(spark):
    rows = [("ok", "s", Q, "It is 4 of them.", "r"), ("cut", "s", Q, "Then we mult", "r"), ("cut", "s", Q, "Then we mult", "r"), ("no", "s", Q, None, "r"), ("blank", "s", None, " ", "r"), ("same", None, Q, Q, "r"), (None, "s", Q, None, "r"), ("lone", "s", None, "It is whole.", "r"), ("long", "s", Q, SENTENCES[0] * 20_000, "r")]
    df = spark.createDataFrame(rows, "id string, dataset string, question string, answer string, defect string")
    got = sorted((r.id, r.defect) for r in pairs.defects(df).collect())
    assert got == [("blank", "empty_answer"), ("cut", "truncated_answer"), ("no", "empty_answer"), ("same", "copies_question")]
    assert pairs.defects(df.limit(0)).count() == 0


LONG = "I'm sorry. " * 4 + "I cannot help with this request. Please ask another question. " * 12


@pytest.mark.parametrize("t", [LONG, "I cannot help with problem 12.", "I'm sorry, but I can't assist with solving \\(x^2 = 144\\).", "Sorry, I must decline question No. 37. Please ask about question 38 instead.", "Ich kann Aufgabe 25 nicht lösen."])
def test_wordy_refusals_and_those_that_name_the_task(t):
    assert pairs.refuses(t)


@pytest.mark.parametrize("t", [LONG + "The sum of the angles equals a straight line.", "We cannot do that, so x = 12.", "Unfortunately the answer is 12.", "I cannot give a proof, but x = 12.", "I cannot give more than this: it is 144.", "The number cannot give 3.14.", "With x = 12 I cannot continue."])
def test_worked_answers_with_declining_words(t):
    assert not pairs.refuses(t)


@pytest.mark.parametrize("t, want", [
    ("1. We count the squares.\n2. We add them.\n3.", "cut"), ("- a point here\n-", "cut"), ("The values are:\n1. two\n2. three.", "whole"), ("-", "none"),
    ("See this:\n```\nx = 1.\n", "cut"), ("See this:\n```\nx = 1\n```\nDone.", "whole"), ("He said (as we saw. Then it ends.", "weak"),
    ("<div>We count all. <b>Then we stop.", "weak"), ("<div>We count all. <b>Then</b> we stop.</div>", "whole"), ("<ul><li>One.</li><li>Two.</li></ul> That is all.", "whole"), ("<p>We count.</p><di", "cut"), ("Let a <b and c > d. So it holds.", "whole"), ("First line<br>and second.", "whole"),
])
def test_lists_and_markup(t, want):
    assert c.ending(t) == want


def test_tests_that_tell(spark):
    text = lambda k: " ".join(f"word{k}x{j}" for j in range(40))
    rows = [(f"l{k}", "s", text(k)[:100]) for k in range(12)] + [(f"e{k}", "s", text(k)[: 150 + 7 * k]) for k in range(4)] + [(f"w{k}", "s", f"It is {k} whole.") for k in range(9)] + [("weak", "s", "ab"), ("w", "t", "ab")]
    got = {r.id: r.test for r in c.settle(c.judged(spark.createDataFrame(rows, "id string, dataset string, answer string"), {"answer": None})).collect()}
    assert {got[f"l{k}"] for k in range(12)} == {"limit"} and {got[f"e{k}"] for k in range(4)} == {"ending"} and not any(got[f"w{k}"] for k in range(9)) and got["weak"] is None
    assert all(r.longer < r.n + 5 for r in c.spikes(c.judged(spark.createDataFrame(rows, "id string, dataset string, answer string"), {"answer": None})).collect())


@pytest.mark.parametrize("t, lang", [
    ("Il numero che cerchiamo è il prodotto di due quadrati e non ha altri divisori della forma.", "it"),
    ("O número que procuramos não é um quadrado e também não são pares os seus divisores.", "pt"),
    ("Liczba, której szukamy, nie jest kwadratem i to się sprawdza dla każdy.", "pl"),
    ("La route est longue et les deux coureurs ne sont pas dans le même village.", "fr"), ("El número de los cuadrados es mayor que el de las filas.", "es"), ("The number of squares is larger than that of the rows.", "en"),
])
def test_further_languages(t, lang):
    from weftline.llm import languages

    assert languages.language(t) == lang


@pytest.mark.parametrize("t", ["Mi dispiace, non posso aiutare con questa domanda.", "Desculpe, não posso responder a esta pergunta.", "申し訳ありません。お答えできません。"])
def test_refusals_in_further_languages(t):
    assert pairs.refuses(t)
