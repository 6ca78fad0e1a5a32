import random
import re
from collections import Counter

from cinelake.llm import ngram_join
from cinelake.llm.ngram_join import jaccard_classes, keep_first, least_matches

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shingles(text):
    w = tuple(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    return frozenset(w[i : i + 5] for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([w] if w else [])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    label, links = list(range(len(docs))), Counter()
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    first = {}
    for k, x in enumerate(label):
        first[x] = min(first.get(x, docs[k][0]), docs[k][0])
    return sorted((docs[k][0], first[label[k]], links[k]) for k in range(len(docs)))


def case():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append(" ".join(words))
    chain = rng.choices(vocabulary, k=200)
    for i in range(15):  # each like the next, the ends unlike each other
        docs.append(" ".join(chain[i * 8 : i * 8 + 80]))
    docs += [None, "", "?!", "two words", "Two  WORDS!", "one"]
    return [(i * 3, t) for i, t in enumerate(docs)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, SET_ID string").repartition(3)


def test_classes_and_links_equal_brute_force(spark):
    docs = case()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(frame(spark, docs)).collect())
    assert got == brute(docs)


def test_large_groups_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUDGET", 200)
    docs = case()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(frame(spark, docs)).collect())
    assert got == brute(docs)


def test_one_row_of_each_class_stays(spark):
    docs = case()
    df = frame(spark, docs)
    df = df.union(df.filter("doc_id in (0, 3, 9)")).union(spark.createDataFrame([(None, None, None)], df.schema))
    left = keep_first(df)
    assert left.columns == df.columns
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    silent = [i for i, t in docs if not shingles(t)]
    assert ids == sorted({c for _, c, _ in brute([d for d in docs if d[0] not in silent])} | set(silent))


def test_pruning_bound_and_empty_table(spark):
    rounds = least_matches(0.8, 1e-9)
    assert rounds[0][0] == 16 and rounds[-1][0] == 96
    assert all(0 < m < n * 0.8 for n, m in rounds)
    assert jaccard_classes(frame(spark, case()).limit(0)).count() == 0
