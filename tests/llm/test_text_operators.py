"""Operators on texts against brute-force versions, with the odd cases every operator must take."""

import base64
import collections
import json
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from careerloom.llm import bpe, ctw, mixing, passages, quality, simhash, toxicity, wordpiece

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    (1, "Hello   world \n\n foo's 123 été"),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "a" * 5000),
    (6, "don't stop\t\t\n" * 300),
    (7, "Hello   world \n\n foo's 123 été"),
    (7, "Hello   world \n\n foo's 123 été"),
    (7, "another text with the same id"),
    (None, "a row without an id"),
    (8, "é" * 3000 + " " * 700 + "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with the operators' own."""
    rows = [(i, t, None, "s", 1, 0.5, "x", 3, True) for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row int, held_out boolean"
    )


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# --- byte-level BPE


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (64, 64), (100, 30), (32768, 1024)])
def test_bpe_equals_library_and_round_trips(odd, chunk, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    want = []
    for i, text in ODD:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((str(i), len(ids), ids.tobytes(), (text or "").encode()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == sorted(want)


def test_bpe_of_nothing(empty):
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# --- language model


def plain_ctw(train, texts):
    """Context-tree weighting with dictionaries, one position at a time."""
    nodes = collections.defaultdict(lambda: [0, 0])
    contexts = set()

    def positions(text):
        data = b"\xfe" * ctw.DEPTH + text.lower() + b"\xff"
        for i in range(ctw.DEPTH, len(data)):
            yield data[i - ctw.DEPTH : i], data[i]

    def steps(byte):
        for j in range(8):
            yield (j, byte >> (8 - j)), byte >> (7 - j) & 1

    for text in train:
        for context, byte in positions(text):
            for node, bit in steps(byte):
                for d in range(ctw.DEPTH + 1):
                    nodes[context[ctw.DEPTH - d :], node][bit] += 1
                    contexts.add((context[ctw.DEPTH - d :], node))
    children = collections.defaultdict(set)
    for context, node in contexts:
        if context:
            children[context[1:], node].add(context)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    log_p, weight = {}, {}
    for context, node in sorted(contexts, key=lambda c: -len(c[0])):
        kt = log_kt(*nodes[context, node])
        if len(context) == ctw.DEPTH:
            log_p[context, node], weight[context, node] = kt, 1.0
        else:
            below = sum(log_p[c, node] for c in children[context, node])
            log_p[context, node] = np.logaddexp(kt, below) - math.log(2)
            weight[context, node] = math.exp(kt - math.log(2) - log_p[context, node])
    out = []
    for text in texts:
        total = 0.0
        for context, byte in positions(text):
            for node, bit in steps(byte):
                p = None
                for d in range(ctw.DEPTH, -1, -1):
                    at = context[ctw.DEPTH - d :], node
                    if at in contexts:
                        a, b = nodes[at]
                        one = (b + 0.5) / (a + b + 1)
                        p = one if p is None else weight[at] * one + (1 - weight[at]) * p
                p = 0.5 if p is None else p
                total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_language_model_equals_plain_version(spark):
    r = random.Random(3)
    words = ["the", "Then", "thing", "on", "onion", "été", "x" * 30]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(30)] + [(90, None), (91, ""), (5, "the thing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = [i % 3 != 0 for i, _ in rows]
    got = ctw.score(df, df["doc_id"] % 3 != 0, block_bytes=500, parts=3).collect()
    texts = [(t or "").encode() for _, t in rows]
    train = [t for t, f in zip(texts, learn) if f]
    counts = collections.Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, _), t, s in zip(rows, texts, plain_ctw(train, texts)):
        tokens = [*t.lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6), round(s, 3)))
    assert sorted((x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6), round(x["score"], 3)) for x in got) == sorted(want)


def test_language_model_odd_rows(odd, empty):
    got = ctw.score(odd, odd["doc_id"] != 1, parts=2).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert ctw.score(empty, empty["doc_id"] != 1, parts=2).count() == 0


def test_language_model_without_training_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctw.score(df, df["doc_id"] < 0, parts=2).collect()}
    assert got[1]["score"] == pytest.approx(24 * math.log10(0.5), rel=1e-6)
    assert (got[1]["n_known"], got[1]["train_tokens"], got[1]["base_score"]) == (0, 0, 0.0)


# --- word pieces


def greedy(pieces, word):
    """Longest match piece by piece; 0 if stuck. The end sign alone counts nothing."""
    symbols, i, n = (*word, wordpiece.END), 0, 0
    while i < len(symbols):
        for size in range(len(symbols) - i, 0, -1):
            if symbols[i : i + size] in pieces:
                break
        else:
            return 0
        n += symbols[i : i + size] != (wordpiece.END,)
        i += size
    return n


def test_longest_match_equals_greedy():
    r = random.Random(1)
    for _ in range(500):
        letters = b"abc"[: r.randint(1, 3)]
        pieces = {tuple(r.choices(letters, k=r.randint(1, 5))) + ((wordpiece.END,) if r.random() < 0.5 else ()) for _ in range(r.randint(1, 12))}
        if r.random() < 0.7:
            pieces |= {(c,) for c in letters} | {(wordpiece.END,)}
        automaton = wordpiece.LongestMatch(sorted(pieces))
        for _ in range(20):
            word = bytes(r.choices(letters, k=r.randint(0, 12)))
            assert automaton.count(word) == greedy(pieces, word)


def test_token_counts_of_rows(odd, empty):
    counts = wordpiece.counter(PIECES)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"], r["n_unknown"]) for r in wordpiece.token_counts(odd, PIECES).collect())
    want = []
    for i, text in ODD:
        words = (text or "").encode().lower().split()
        want.append((str(i), len(words), sum(counts.automaton.count(w) for w in words), 0))
    assert got == sorted(want)
    assert wordpiece.token_counts(empty, PIECES).count() == 0
    vocabulary = json.load(open(PIECES))["model"]["vocab"]
    assert counts["the".encode()] == 1 and "the</w>" in vocabulary


# --- classifiers


@pytest.mark.parametrize("method, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_on_held_out_rows(spark, method, column):
    r = random.Random(4)
    words = ["w%d" % i for i in range(300)]

    def text(label):
        out = r.choices(words, k=60)
        if label:
            out[10:10] = ["pathetic", "fool!!", "|", "fool!!"]
        return " ".join(out)

    rows = [(i, text(i % 3 == 0)) for i in range(900)]
    docs = spark.createDataFrame([*rows, (None, "x"), (2000, None), (2001, ""), (2002, "z" * 100_000), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (5, None), (6, 7), (0, 1), (5000, 1)], f"doc_id long, {column} int"
    )
    got = method.score(docs, method.fit(docs, labels)).collect()
    assert len(got) == 905 and all(0 <= x["score"] <= 1 for x in got)
    new = [x for x in got if x["doc_id"] is not None and 600 <= x["doc_id"] < 900]
    assert sum((x["score"] >= 0.5) == (x["doc_id"] % 3 == 0) for x in new) >= 285


@pytest.mark.parametrize("method, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_without_labels(odd, empty, spark, method, column):
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    got = method.score(odd, method.fit(odd, none)).collect()
    assert len(got) == len(ODD) and len({x["score"] for x in got}) == 1
    assert method.score(empty, method.fit(empty, none)).count() == 0


# --- mixing


def test_targets_reshare_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 100, 100], [5, 2, 1])
    assert got == pytest.approx([30, 120, 60])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation_is_one_to_one(n):
    got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77))
    assert sorted(got.tolist()) == list(range(n))


def test_mix_meets_targets_and_texts_follow(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w%d" % r.randint(0, 99) for _ in range(r.randint(0, 400))), r.choice(["a", "b", "c", None])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "b"), (7, rows[7][1], rows[7][2]), (None, "one two", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block=16).collect()
    assert len(got) == len(rows)
    by_source = collections.defaultdict(lambda: [0, 0.0, 0])
    source_of = {i: s for i, _, s in rows}
    for x in got:
        assert 0 <= x["taken"] <= 3 * x["size"]
        s = by_source[source_of[x["doc_id"]]]
        s[0], s[1], s[2] = x["source_size"], x["target"], s[2] + x["taken"]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == name) for name in ("a", "b", "c", None)]
    assert [by_source[s][0] for s in ("a", "b", "c", None)] == sizes
    for s, want in zip(("a", "b", "c", None), mixing.targets(sizes, [5, 2, 1, 5])):
        assert by_source[s][1] == pytest.approx(want) and abs(by_source[s][2] - want) <= 0.03 * want
    assert sorted(map(str, mixing.mix(df, block=16).collect())) == sorted(map(str, got))
    texts = mixing.mixed_documents(df, block=16).collect()
    words = collections.Counter()
    for x in texts:
        words[x["doc_id"]] += len(x["text"].split())
    taken = collections.Counter()
    for x in got:
        taken[x["doc_id"]] += x["taken"]
    assert +words == +taken


def test_mix_of_odd_rows(odd, empty):
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# --- SimHash


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_equals_plain_version(spark, odd):
    r = random.Random(9)
    base = [" ".join("w%d" % r.randint(0, 9999) for _ in range(400)) for _ in range(40)]
    rows = []
    for i in range(300):
        words = base[r.randint(0, 39)].split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "x%d" % r.randint(0, 9)
        rows.append((i, " ".join(words)))
    rows += [(i + 1000 if i is not None else None, t) for i, t in ODD]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((str(x["doc_id"]), x["fingerprint"]) for x in got) == sorted((str(i), f"{p:016x}") for i, p in prints)
    known = [(i, p) for i, p in prints if i is not None]
    pairs = [(a, b) for a, p in known for b, q in known if a <= b and (p ^ q).bit_count() <= 2]
    want = union_find({i for i, _ in known}, pairs)
    # Rows that share an id but not the text are in the class of their own text.
    repeated = {1007}
    for x in got:
        if x["doc_id"] is None:
            assert x["component_id"] is None
        elif x["doc_id"] not in repeated:
            assert x["component_id"] == want[x["doc_id"]]


@pytest.mark.parametrize("tables, reach", [(1, 3), (4, 11), (2, 5)])
def test_gray_index_finds_all_links(spark, tables, reach):
    r = np.random.default_rng(1)
    seeds = r.integers(0, 2**63, 60, dtype=np.int64)
    codes = []
    for s in seeds.tolist():
        for _ in range(8):
            codes.append(s ^ sum(1 << int(b) for b in set(r.integers(0, 62, r.integers(0, 7)).tolist())))
    codes = sorted(set(codes))
    df = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "fp long, rep long")
    edges = [(x["a"], x["b"]) for x in simhash.links(df, reach, tables=tables, part_rows=50).collect()]
    near = [(i, j) for i, a in enumerate(codes) for j, b in enumerate(codes) if i < j and (a ^ b).bit_count() <= reach]
    assert union_find(range(len(codes)), edges) == union_find(range(len(codes)), near)


def test_similar_documents_and_empty_tables(spark, empty):
    r = random.Random(2)
    base = [" ".join("w%d" % r.randint(0, 9999) for _ in range(300)) for _ in range(30)]
    rows = []
    for i in range(90):
        words = base[i % 30].split()
        if i >= 30:
            words[r.randrange(300)], words[r.randrange(300)] = "changed", "too"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([*rows, (500, None), (501, ""), (None, base[0])], "doc_id long, text string")
    kept = sorted(str(x["doc_id"]) for x in simhash.keep_one(df).collect())
    assert kept == sorted([*map(str, range(30)), "500", "501", "None"])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# --- repeated passages


def test_passages_are_found_exactly(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(5000)]
    short, long, below = (r.choices(words, k=n) for n in (51, 120, 40))
    rows, at = [], {}
    for i in range(60):
        text = r.choices(words, k=r.randint(30, 300))
        k = r.randint(0, len(text))
        put = {1: short, 2: long, 3: below}.get(i % 10)
        if put:
            text[k:k] = put
            at[i] = (k, len(put))
        if i % 10 == 4:
            text = ["der"] * 60 + text[:5] + ["der"] * 60
        rows.append((i, "\n ".join(text)))
    rows += [(100, None), (101, ""), (None, " ".join(long)), (102, " ".join(long)), (102, " ".join(long))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    planted = {(x["doc_id"], x["start_word"], x["n_words"], x["removed"], x["kept_doc_id"]) for x in got if x["doc_id"] % 10 != 4}
    want = {(i, *at[i], i >= 10, i % 10) for i in at if i % 10 in (1, 2)} | {(102, 0, 120, True, 2)}
    # A chance hit next to a passage may lengthen it by a word.
    assert {(a, d, e) for a, _, _, d, e in planted} == {(a, d, e) for a, _, _, d, e in want}
    assert len(planted & want) >= len(want) - 1
    left = {str(x["doc_id"]): x["text"] for x in passages.without_repeats(df).collect()}
    assert "102" not in left and "100" in left and "None" in left
    for i, (k, n) in at.items():
        text = rows[i][1].split()
        removed = i % 10 in (1, 2) and i >= 10
        assert abs(len(left[str(i)].split()) - (len(text) - n * removed)) <= 1


def test_passages_of_odd_rows(odd, empty):
    assert passages.without_repeats(odd).count() == len(ODD)
    assert passages.repeated_passages(empty).count() == 0 and passages.without_repeats(empty).count() == 0


def test_paragraph_similarity_is_exact():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 12, (20, 10)).astype(np.uint64), r.integers(0, 12, (15, 10)).astype(np.uint64)
    got = passages._alike(a, b, 0.5)
    for i in range(20):
        for j in range(15):
            x, y = set(a[i].tolist()), set(b[j].tolist())
            assert got[i, j] == (len(x & y) / len(x | y) >= 0.5)

