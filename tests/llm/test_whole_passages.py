"""Repeated passages that are easily missed: near copies, partly shared and repetitive ones."""

import random

from careerloom.llm import passages


def removed_words(spark, rows):
    out = {}
    for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).filter("removed").collect():
        out.setdefault(x["doc_id"], set()).update(range(x["start_word"], x["start_word"] + x["n_words"]))
    return out


def text_of(r, n):
    return ["v%d" % r.randrange(10**6) for _ in range(n)]


def test_near_copies_with_inner_changes(spark):
    shape = passages.Shape()
    assert 1 - (1 - 0.8**shape.rows) ** shape.bands >= 0.95
    r = random.Random(11)
    rows = []
    for i in range(60):
        passage = text_of(r, 110)
        copy = list(passage)
        # Neither side of the changes has 50 words; 49-word gaps keep every 50 words at one change or two at their ends.
        for at in (30, 79):
            copy[at] = "changed%d" % i
        rows += [(i, " ".join([*text_of(r, 90), *passage, *text_of(r, 90)])), (1000 + i, " ".join([*text_of(r, 70), *copy, *text_of(r, 70)]))]
    got = removed_words(spark, rows)
    assert all(1000 <= i for i in got)
    assert sum(len(got.get(1000 + i, set()) & set(range(70, 180))) >= 50 for i in range(60)) >= 57
    assert all(len(words - set(range(70, 180))) <= 10 for words in got.values())


def test_first_document_with_less_hides_nothing(spark):
    r = random.Random(12)
    rows, n = [], 40
    for i in range(n):
        whole = text_of(r, 51)
        part = whole[5:45]
        rows += [(i, " ".join([*text_of(r, 40), *part, *text_of(r, 40)]))]
        rows += [(i + k, " ".join([*text_of(r, 60), *whole, *text_of(r, 60)])) for k in (1000, 2000)]
    got = removed_words(spark, rows)
    assert got == {2000 + i: set(range(60, 111)) for i in range(n)}


def test_repetitive_passages(spark):
    r = random.Random(13)
    rows, n = [], 40
    for i in range(n):
        refrain = text_of(r, 3)
        passage = [*refrain, *text_of(r, 7), *refrain, *text_of(r, 8), *refrain, *text_of(r, 27)]
        rows += [(i, " ".join([*text_of(r, 40), *refrain, *text_of(r, 12), *passage, *text_of(r, 40)]))]
        rows += [(1000 + i, " ".join([*text_of(r, 50), *passage, *text_of(r, 30)]))]
    rows += [(500, " ".join([*text_of(r, 40), *["der"] * 90, *text_of(r, 40)])), (1500, " ".join([*text_of(r, 20), *["der"] * 60, *text_of(r, 20)]))]
    got = removed_words(spark, rows)
    assert got == {**{1000 + i: set(range(50, 101)) for i in range(n)}, 1500: set(range(20, 80))}


def test_frequent_paragraphs_are_compared_alike(spark):
    r = random.Random(14)
    line, rows = text_of(r, 30), []
    for i in range(30):
        whole = [*text_of(r, 15), *line, *text_of(r, 15)]
        rows += [(i + k, " ".join([*text_of(r, 30), *whole, *text_of(r, 30)])) for k in (1000, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one_by_one, in_one_place = (sorted(map(tuple, passages.repeated_passages(df, few=few).collect())) for few in (1, 1000))
    assert one_by_one == in_one_place and sum(x[4] for x in one_by_one) == 30


def test_every_shared_run_against_brute_force(spark):
    """Removed is what lies in a run of 50 words that a smaller id has too, word for word."""
    r = random.Random(15)
    passages_ = [text_of(r, n) for n in (30, 49, 50, 51, 64, 80, 120, 200)]
    rows = []
    for i in range(100):
        words = text_of(r, r.randrange(0, 60))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages_)
            a, b = sorted((r.randrange(len(p) + 1), r.randrange(len(p) + 1)))
            words += (p if r.random() < 0.6 else p[a:b]) + text_of(r, r.randrange(0, 40))
        rows.append((i, " ".join(words)))
    want, seen = {}, {}
    for i, text in rows:
        words = text.split()
        runs = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        for k, run in enumerate(runs):
            if seen.setdefault(run, i) != i:
                want.setdefault(i, set()).update(range(k, k + 50))
    got = removed_words(spark, rows)
    assert got == want and sum(map(len, want.values())) > 2000


def test_a_text_of_a_million_words(spark):
    r = random.Random(16)
    passage = text_of(r, 70)
    long = text_of(r, 1_000_000)
    long[777_000:777_000] = passage
    rows = [(1, " ".join([*text_of(r, 20), *passage, *text_of(r, 20)])), (2, " ".join(long))]
    assert removed_words(spark, rows) == {2: set(range(777_000, 777_070))}


def test_only_surroundings_that_repeat_are_looked_up(spark, monkeypatch):
    """One passage in many documents: at its ends the surroundings differ everywhere, and are their own first."""
    r = random.Random(14)
    common, n = text_of(r, 120), 60
    rows = [(i, " ".join([*text_of(r, 40), *common, *text_of(r, 40)])) for i in range(n)]
    placed, plain = [], passages.cut

    def noted(df, *args):
        out = plain(df, *args)
        if {"around", "k_loc"} <= set(out.columns):
            placed.append(out.groupBy("around").count().agg({"count": "min"}).first()[0])
        return out

    monkeypatch.setattr(passages, "cut", noted)
    assert removed_words(spark, rows) == {i: set(range(40, 160)) for i in range(1, n)}
    assert placed == [n]
