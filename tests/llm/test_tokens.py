"""Tokenizer, mixing and spam pages."""

import heapq
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import mixing, spampages, tokenizer

RANKS = tokenizer.read_ranks(open(f"{tokenizer.FOLDER}/{tokenizer.VOCABULARY}", "rb").read())
OURS = tokenizer.Encoder(RANKS)


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ids_equal_the_library(theirs):
    @settings(max_examples=300, deadline=None)
    @given(st.text() | st.text("ab \n'sé日\u200b🙂<|endoftext|>1.", max_size=80))
    def check(t):
        ids = OURS.encode(t)
        assert ids == theirs.encode_ordinary(t) and OURS.decode(ids) == t

    check()


def test_long_piece(theirs):
    t = "ab" * 100_000 + " " * 5000 + "x"
    assert OURS.encode(t) == theirs.encode_ordinary(t)


def test_encode_table(spark):
    rows = [(1, "Hello world", "x"), (2, "", "y"), (3, None, "z"), (None, "a", "q"), (1, "Hello world", "x"), (4, "word " * 300_000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = tokenizer.encode(df)
    assert out.columns == ["doc_id", "text", "ids"]
    got = {(r.doc_id, r.text): r.ids for r in out.collect()}
    assert got[2, ""] == got[3, None] == [] and got[1, "Hello world"] == OURS.encode("Hello world") and len(got[4, rows[5][1]]) > 300_000
    back = tokenizer.decode(out.select("doc_id", "ids")).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in rows)
    assert tokenizer.encode(df.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in tokenizer.count(df, ["doc_id"]).collect())[:2] == [0, 0]


def naive(w, seats, caps):
    n = [0] * len(w)
    q = [(-x, -x, i) for i, x in enumerate(w) if x > 0 and caps[i] > 0]
    heapq.heapify(q)
    while seats and q:
        _, _, i = heapq.heappop(q)
        n[i] += 1
        seats -= 1
        if n[i] < caps[i]:
            heapq.heappush(q, (-w[i] / (2 * n[i] + 1), -w[i], i))
    return n


def test_apportion_equals_the_queue():
    rng = random.Random(0)
    for _ in range(200):
        k = rng.randrange(1, 9)
        w = [rng.choice([0, 1, 2, 3, rng.random()]) for _ in range(k)]
        caps = [rng.choice([0, 3, 40, 10**9]) for _ in range(k)]
        seats = rng.randrange(0, 120)
        assert list(mixing.apportion(w, seats, caps)) == naive(w, seats, caps)
    assert mixing.apportion([2.0, 1.0], 3 * 10**12, [10**13] * 2).tolist() == [2 * 10**12, 10**12] and mixing.apportion([], 5, []).tolist() == []
    assert mixing.apportion([np.nan, 1.0], 4, [9, 9]).tolist() == [0, 4]


def test_mixture_shares_and_caps(spark):
    rng = random.Random(1)
    docs = [(i, s, " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(5, 60)))) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 20 + ["other"] * 50)]
    docs += [(9001, "a", None), (9002, "a", ""), (None, "b", "x y"), (9003, None, "x")]
    targets = [("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.15, 2), ("gone", 0.05, 9), (None, 0.3, 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(d, t, block=64, shard=3000)
    m = mixture.collect()
    cap = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r.copies <= cap[r.source] and r.n_tokens > 0 for r in m) and len({r.doc_id for r in m}) == len(m)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"a", "b", "c", "gone"} and s["gone"].mixed_tokens == 0 and s["c"].mixed_tokens <= 2 * s["c"].tokens
    assert abs(s["c"].mixed_tokens - 2 * s["c"].tokens) <= 64 * 2 + 60  # capped
    free = s["a"].mixed_tokens + s["b"].mixed_tokens
    assert abs(s["a"].mixed_tokens / free - 0.5) < 0.01 and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    assert abs(sum(r.mixed_tokens for r in s.values()) / sum(r.tokens for r in s.values()) - 1) < 0.02
    again = {r.doc_id: r.copies for r in mixing.mix(d.repartition(7), t, block=64, shard=3000)[0].collect()}
    assert again == {r.doc_id: r.copies for r in m} and again != {r.doc_id: r.copies for r in mixing.mix(d, t, seed=5, block=64, shard=3000)[0].collect()}
    none, empty = mixing.mix(d.limit(0), t)
    assert none.count() == 0 and {r.actual_share for r in empty.collect()} == {0.0}


PROSE = "The judge liked the idea but called the second step too long. We keep the old wording here so that the answer stays valid for all of them. "


def test_pages(spark):
    rng = random.Random(2)
    mods = "cheap buy best free online order price fast deal".split()
    phrase = lambda: f"{rng.choice(mods)} {rng.choice(['puzzle books', 'exam papers', 'zeo qual'])}"
    spam = {
        1: ", ".join(phrase() for _ in range(60)),
        2: "\n".join(f"https://site{i}.example/p/{i}" for i in range(12)),
        3: " » ".join(f"{rng.choice(['Home', 'Shop', 'Login'])} {rng.choice(['puzzle books', 'exam papers'])}" for _ in range(40)),
        4: " ".join(rng.choice(["#puzzle_books", "#exampapers", "#puzzlebooks"]) for _ in range(50)),
        5: " / ".join(f"{rng.choice(['hardy', 'velvet', 'pale'])} name{i} {rng.choice(['kit', 'set'])} SKU{rng.randrange(9999)} {rng.randrange(99)}.99" for i in range(40)),
        6: " ".join(f"Our {phrase()} beats every {phrase()} and any {phrase()}." for _ in range(30)),
        7: "A note on the first step.\n\n" + ", ".join(phrase() for _ in range(40)) + "\n" + "\n".join(f"www.s{i}.example" for i in range(9)),
    }
    fine = {
        20: "Answer key for the sheet. Each line gives the number of the exercise and its result.\n" + "\n".join(f"{i}. {rng.randrange(9999)}" for i in range(40)),
        21: "Drill for beginners. " + " ".join(f"Add {rng.randrange(9)} to {rng.randrange(99)} and write the sum down." for _ in range(20)),
        22: PROSE + " ".join(f"A zeo number is a sum of {rng.randrange(99)} squares, and every zeo number above {rng.randrange(99)} has a {rng.choice(['pale', 'keen', 'mossy', 'iron', 'tidy', 'wary'])} zeo divisor." for _ in range(8)),
        23: PROSE * 3 + "\n" + "\n".join(f"- Ann, notes on algebra: https://x{i}.example" for i in range(3)),
        24: PROSE + "Sponsored: https://x.example | cheap puzzle books online",
        25: "我们把库存写成一个线性数列。因为余数是九，下一个可能的数只有七。" * 6,
        26: "Остаток равен семи, поэтому подходит только число девять. " * 8,
        27: "", 28: "  ", 29: "x", 30: PROSE * 20_000,
    }
    noun = lambda: f"n{rng.randrange(400)}x".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi"))
    shapes = ["The path from {} crosses the {} near {}.", "It was copied by {} and sent to the {}.", "Compare this with the {} of {} from last week.", "Several readers asked why the {} appears in {}.", "For which {} does the rule of {} hold?", "Write {} for the {} that {} guards.", "There are {} and {} in the {}.", "We draw the {} first and label its {}.", "A common mistake is to forget the {} of {}.", "The {} is full when {} comes.", "The number of {} is a divisor of the number of {}.", "Each divisor counts the squares of {}."]
    filler = {100 + i: " ".join(x.format(noun(), noun(), noun()) for x in rng.sample(shapes, 7)) for i in range(300)}
    drill = lambda: "Drill for beginners. " + " ".join(f"Add {rng.randrange(9)} to {rng.randrange(99)} and write the sum down." for _ in range(9))
    terms = lambda n: PROSE + " ".join(f"A {n} number is a sum of {rng.randrange(99)} squares, and every {n} number above {rng.randrange(99)} has a {rng.choice(['pale', 'keen', 'mossy', 'iron', 'tidy', 'wary'])} {n} divisor." for _ in range(6))
    filler |= {500 + i: drill() if i % 2 else terms(noun()) for i in range(24)}
    pool = [w for t in filler.values() for w in re.findall(r"[a-z]+", t.lower())]
    salad = lambda n: [rng.choice(pool) for _ in range(n)]
    shelf = "дешёвые задачники купить учебники ответы решебник".split()
    filler |= {600 + i: " ".join(f"Здесь {rng.choice(shelf)} и {rng.choice(shelf)} стоят на полке номер {rng.randrange(99)}." for _ in range(4)) for i in range(20)}
    offers = ["дешёвые задачники", "купить решебник", "ответы учебники"]
    spam |= {
        8: " ".join(salad(160)),
        9: ". ".join(" ".join(salad(11)).capitalize() for _ in range(14)) + ".",
        10: " ".join(f"У нас {rng.choice(offers)} и {rng.choice(offers)} на {rng.choice(offers)}." for _ in range(25)),
        11: "<" + "a" * 400 + ">" + ", ".join(phrase() for _ in range(60)),
    }
    rows = [(k, t, "c") for part in (spam, fine, filler) for k, t in part.items()] + [(31, None, "c"), (None, spam[1], "c"), (1, spam[1], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, prose string")
    scored = spampages.scores(df)
    flagged = {r.doc_id: r.reason for r in spampages.flag(scored).collect()}
    odd = sorted(set(flagged) ^ set(spam))
    assert not odd, scored.where(scored.doc_id.isin(odd)).collect()
    assert flagged[8] == flagged[9] == "salad" and flagged[10] == "stuffed"
    twice = df.unionByName(df.where("doc_id between 100 and 999").selectExpr("doc_id + 5000 as doc_id", "concat(text, ' ') as text", "prose"))
    assert {k for k in (r.doc_id for r in spampages.flag(spampages.scores(twice)).collect()) if k < 5000} == set(spam)  # limits don't move with the corpus
    assert spampages.flag(spampages.scores(df.limit(0))).count() == 0
