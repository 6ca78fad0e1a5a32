import hashlib
import random
import re

from cinelake.llm.decontaminate import build_index, drop_contaminated, matches, search

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    phrases = []
    for item, text in items:
        w = words(text)
        phrases += [(str(item), tuple(w[i : i + 10])) for i in range(max(1, len(w) - 9) if w else 0)]
    out = {}
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(item)
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def case():
    rng = random.Random(2)
    vocabulary = ["alpha", "Beta", "the", "of", "été", "中", "x1", "and", "Ω"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(1, text(14)), (2, text(3)), (10, text(10)), (3, None), (4, "!!"), (5, text(12)), (5, text(12)), (7, "Lone")]
    docs = [(i, text(rng.randint(0, 400))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, "pre " + items[2][1].upper() + ", post"), (104, (items[5][1] + " zz ") * 50), (105, "lone"), (106, "?!")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, maybe string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def check(rows, want):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows.collect()}
    assert got == want


def test_search_equals_brute_force_in_one_block_and_in_many(spark):
    docs, items = case()
    d, b = frames(spark, docs, items)
    index = build_index(d)
    want = brute(docs, items)
    assert sum(x[4] for x in want.values()) > 5
    check(search(index, b), want)
    check(search(index, b, block=3), want)


def test_pipeline_form_drops_contaminated_rows_only(spark):
    docs, items = case()
    d, b = frames(spark, [*docs, docs[0], (None, "lone"), (None, None)], items)
    want = brute(docs, items)
    clean = [i for i, _ in docs if not want[i][4]]
    clean += [docs[0][0]] * (not want[docs[0][0]][4]) + [None]
    left = drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((i is None, i or 0) for i in clean)


def test_matches_exact_and_near(spark):
    d, b = frames(spark, [(1, "a b c d e"), (2, "a x b c y d e"), (3, "e d c b a")], [(9, "a b c d e")])
    index = build_index(d)
    assert [(r.doc_id, r.doc_word) for r in matches(index, b).collect()] == [(1, 0)]
    assert {r.doc_id for r in matches(index, b, slop=6).collect()} == {1, 2, 3}
    assert {r.doc_id for r in matches(index, b, slop=1).collect()} == set()


def test_empty_tables(spark):
    d, b = frames(spark, *case())
    assert search(build_index(d.limit(0)), b).count() == 0
    assert search(build_index(d), b.limit(0)).filter("contaminated").count() == 0
    assert drop_contaminated(d, b.limit(0)).count() == d.count()
