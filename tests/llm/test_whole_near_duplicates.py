"""Near-duplicates right above and right below the similarity that the pipeline asks for."""

import random

from careerloom.llm import simhash


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_recall_and_precision_at_the_bound(spark):
    r = random.Random(21)
    rows, similar = [], {}
    for i in range(400):
        words = ["u%d" % r.randrange(10**6) for _ in range(r.choice([40, 120, 300]))]
        want = r.uniform(0.72, 0.86)
        copy, at = list(words), list(range(len(words)))
        r.shuffle(at)
        while True:
            before = copy[at[-1]]
            copy[at[-1]] = "new%d" % i
            a, b = shingles(words), shingles(copy)
            if len(a & b) / len(a | b) < want:
                copy[at[-1]] = before
                break
            at.pop()
        a, b = shingles(words), shingles(copy)
        similar[i] = len(a & b) / len(a | b)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x["doc_id"] for x in simhash.keep_one(df).collect()}
    assert all(i in kept for i in range(400))
    near = [i for i in range(400) if similar[i] >= 0.8]
    found = sum(1000 + i not in kept for i in near)
    print("pairs at 0.80 and more:", len(near), "found:", found, "; below:", 400 - len(near), "dropped:", sum(1000 + i not in kept for i in range(400) if similar[i] < 0.8))
    assert len(near) >= 100 and found >= 0.98 * len(near)
    assert all(1000 + i in kept for i in range(400) if similar[i] < 0.8)
