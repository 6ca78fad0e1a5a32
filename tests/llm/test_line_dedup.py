import random
import re

import numpy as np
import pyarrow as pa

from cinelake.llm import line_dedup
from cinelake.llm.line_dedup import CLOSE, aligned_cost, dedup_lines, edit_distance, line_hashes, normalise, similar


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choices("abcé", k=rng.randint(0, 40))) for _ in range(2))
        assert edit_distance(a, b) == table(a, b)


def test_edit_distance_ends_early_beyond_a_bound():
    rng = random.Random(3)
    for _ in range(150):
        a = "".join(rng.choices("abcé", k=rng.randint(0, 160)))
        b = "".join(rng.choice([x, x, x, "", "z"]) for x in a) if rng.random() < 0.5 else "".join(rng.choices("abcé", k=rng.randint(0, 160)))
        true = table(a, b)
        for most in (0, 3, true - 1, true, 0.2 * max(len(a), len(b))):
            got = edit_distance(a, b, most)
            assert got == true if true <= most else most < got <= true


def test_aligned_cost_is_an_upper_bound():
    rng = random.Random(2)
    for _ in range(400):
        a = rng.choices(["ab", "abc", "d", "éf"], k=rng.randint(1, 12))
        b = [w for x in a for w in rng.choice([[x], [x], [x], [], ["new"], [x, "d"]])] or ["x"]
        assert table(" ".join(a), " ".join(b)) <= aligned_cost(a, b)
        assert similar(" ".join(a), " ".join(b)) == (table(" ".join(a), " ".join(b)) <= 0.2 * max(len(" ".join(a)), len(" ".join(b))) + 1e-9)


def brute(docs):
    """Groups over all pairs of lines: equal when normalised, or similar."""
    lines = [(i, k, normalise(x.encode())) for i, t in docs if t for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    norms = sorted({x[2] for x in lines})
    label = {n: n for n in norms}
    for i, a in enumerate(norms):
        for b in norms[:i]:
            if label[a] != label[b] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and table(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                old, new = label[a], label[b]
                label = {n: new if x == old else x for n, x in label.items()}
    first, gone = {}, {}
    for i, k, n in sorted(lines):
        if first.setdefault(label[n], (i, k)) != (i, k):
            gone.setdefault(i, set()).add(k)
    out = {}
    for i, t in docs:
        out[i] = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))
    return out, sum(map(len, gone.values()))


def case():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    lines = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 20, 30]))) for _ in range(60)]

    def vary(line):
        if rng.random() < 0.5:
            return line
        words = line.split(" ")
        words[rng.randrange(len(words))] = rng.choice([rng.choice(vocabulary), "12", "99"])
        return rng.choice([" ".join(words), line.upper() + "!", "  " + line.replace(" ", ", ")])

    docs = [(i, "\n".join(vary(rng.choice(lines)) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    hot = " ".join(rng.choices(vocabulary, k=40))
    docs += [(100 + i, vary(hot) + "\n\n" + vary(hot)) for i in range(30)]
    return [*docs, (200, None), (201, ""), (202, "\n\n"), (203, "!!\n??")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, gone string").repartition(3)


def test_bit_sums_both_ways():
    rng = np.random.default_rng(1)
    h, group = rng.integers(0, 2**64, 140_000, np.uint64), np.repeat([0, 2, 3], [70_000, 100, 69_900])
    for keep in (slice(None), slice(69_950, None)):  # with a group over 65535, and without
        count, sums = line_dedup._bit_sums(h[keep], group[keep], 5)
        for g in range(5):
            own = np.unique(h[keep][group[keep] == g])
            assert count[g] == len(own)
            assert [int((own >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] == sums[g].tolist()


def test_equals_brute_force(spark):
    docs = case()
    want, n = brute(docs)
    rows = dedup_lines(frame(spark, docs)).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert sum(r.n_removed for r in rows) == n > 50
    assert all(r.gone == "x" for r in rows)


def test_large_groups_in_blocks_and_frequent_keys(spark, monkeypatch):
    docs = case()
    want, _ = brute(docs)
    monkeypatch.setattr(line_dedup, "BUDGET", 600)
    assert {r.doc_id: r.text for r in dedup_lines(frame(spark, docs)).collect()} == want
    # of 30 documents with variants of one line, nearly all variants are one group
    left = sum(bool(re.search(r"\w", want[i] or "")) for i in range(100, 130))
    assert left < 12


def test_candidate_sets_of_frequent_keys():
    def sets(rows, size):
        rows = sorted(rows)
        for lo in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[lo : lo + size], strict=True)], names=["key", "line", "sim"])

    rows = [(7, i, 0) for i in range(3000)] + [(8, 1, 0), (8, 2, 3), (9, 5, 0), (9, 6, -1), (10, 2, 3), (10, 1, 0)] + [(11, i, 0) for i in range(1500)]
    for size in (1, 700, 2999, 10_000):
        got = {}
        for batch in line_dedup._candidates(sets(rows, size)):
            for cluster, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got.setdefault(cluster, set()).add(line)
        assert sorted(map(len, got.values())) == [2, 1500, 3000]  # the pair of 8 and 10 is one set


def test_recall_against_all_lines(spark):
    """Similar pairs of lines, by comparing all: at least nine in ten are candidates."""
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(path).collect()]
    norms = sorted({n for _, t in docs for x in (t or "").split("\n") if (n := normalise(x.encode()))})
    asked = [n for n in norms if len(n) < 250]
    want = {frozenset((a, b)) for a in asked for b in norms if a != b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and similar(a, b)}
    raw = {n: line_hashes(np.frombuffer(n.encode(), np.uint8), np.array([0, len(n.encode())])) for n in norms}
    keys = {n: set(x[5].tolist()) for n, x in raw.items()}
    found = [p for p in want if (lambda a, b: keys[a] & keys[b] and (int(raw[a][3][0]) ^ int(raw[b][3][0])).bit_count() <= CLOSE)(*p)]
    assert len(want) > 20 and len(found) >= 0.9 * len(want), (len(found), len(want))


def test_repeated_rows_and_empty_tables(spark):
    df = frame(spark, [(1, "one line of some words"), (1, "one line of some words"), (2, "one line of some words\nrest")])
    assert sorted((r.doc_id, r.text) for r in dedup_lines(df).collect()) == [(1, "one line of some words")] * 2 + [(2, "rest")]
    assert dedup_lines(df.limit(0)).count() == 0


def test_edit_distance_of_long_lines_is_exact(spark):
    """Against the plain table, over the sizes at which places are found in another way and tests are made."""
    import random

    from cinelake.llm.line_dedup import _places, edit_distance

    rng = random.Random(12)
    for n, letters in [(5, "ab"), (63, "abc é"), (64, "abc é"), (65, "abcdefgh 日"), (300, "abcdefgh 日本"), (300, "ab")] * 3:
        a = "".join(rng.choices(letters, k=n))
        b = "".join(c if rng.random() > 0.3 else rng.choice(["", "z", c + "x"]) for c in a)
        where = _places(a)
        assert all(where[c] == sum(1 << i for i, x in enumerate(a) if x == c) for c in {*a, "?"})
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        true = row[-1]
        assert edit_distance(a, b) == edit_distance(a, b, true) == true
        assert all(edit_distance(a, b, m) > m for m in range(0, true, 7))


def test_distances_side_by_side(monkeypatch):
    rng = random.Random(6)
    pairs, most, true = [], [], []
    for kinds in ("abcé", "".join(map(chr, range(0x4E00, 0x4F90)))):
        for _ in range(60):
            a = "".join(rng.choices(kinds, k=rng.randint(0, 200)))
            b = "".join(rng.choice([x] * rng.choice([2, 9]) + ["", "z", x + "q"]) for x in a) if rng.random() < 0.8 else "".join(rng.choices(kinds, k=rng.randint(0, 160)))
            pairs.append((a, b))
            true.append(table(a, b))
            most.append(rng.choice([0, 3, true[-1] - 1, true[-1], 0.2 * max(len(a), len(b)) + 1e-9]))
    for lanes in (3, 128):
        monkeypatch.setattr(line_dedup, "MANY", 1)
        monkeypatch.setattr(line_dedup, "BESIDE", lanes)
        for got, want, bound in zip(line_dedup.edit_distances(pairs, most), true, most, strict=True):
            assert got == want if want <= bound else got > bound


def test_units_compared_together_have_the_components_of_all_pairs(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdef", k=rng.randint(2, 6))) for _ in range(60)]
    units, want = [], []
    for u in range(30):
        base = [" ".join(rng.choices(words, k=12)) for _ in range(2)]
        text = [" ".join(rng.choice(words) if rng.random() < 0.12 else w for w in rng.choice(base).split(" ")) for _ in range(rng.randint(2, 9))]
        side = [0] * len(text) if u % 2 else [1] + [rng.choice([1, 2]) for _ in text[1:]]
        line = list(range(100 * u, 100 * u + len(text)))
        units.append({"line": line, "sim": [0] * len(text), "norm": text, "side": side})
        want += [(i, k) for x, i in enumerate(line) for y, k in enumerate(line) if (x < y if not side[x] else side[x] == 1 and side[y] == 2) and similar(text[x], text[y])]

    def components(edges):
        label = {x: x for u in units for x in u["line"]}
        for i, k in edges:
            label = {x: min(label[i], label[k]) if y in (label[i], label[k]) else y for x, y in label.items()}
        return label

    for some in (1, 256):
        monkeypatch.setattr(line_dedup, "MANY", 1)
        monkeypatch.setattr(line_dedup, "SOME", some)
        got = line_dedup._compare(units)
        edges = list(zip(got["a"], got["b"], strict=True))
        assert components(edges) == components(want)
        assert len(edges) == sum(len(u["line"]) for u in units) - len(set(components(want).values()))


def test_keys_are_dealt_as_a_row_a_bucket_and_make_the_same_sets(monkeypatch):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63, 400)
    lines = []
    for line in rng.integers(-(2**63), 2**63, 600).tolist():
        own = set(rng.choice(keys, 3).tolist()) | ({int(keys[0])} if rng.random() < 0.3 else set()) | {line ^ 1}
        lines.append((line, int(rng.choice([0, 7, -1])), sorted(own)))
    rows = [lines[i] for i in [*range(600), *rng.integers(0, 600, 300).tolist(), *[3] * 100]]  # repeated lines
    want = {}
    monkeypatch.setattr(line_dedup, "HOT", 40)
    for key in {k for x in lines for k in x[2]}:
        of = sorted((line, sim) for line, sim, own in lines if key in own)
        close = [a for a, s in of if any(a != b and ((s ^ t) & (1 << 64) - 1).bit_count() <= CLOSE for b, t in of)]
        if len(of) > 40:
            want.setdefault(key, set()).update(a for a, _ in of)
        elif close:
            want.setdefault(close[0], set()).update(close)
    assert max(map(len, want.values())) > 150
    batches = [
        pa.RecordBatch.from_arrays([pa.array([x[0] for x in p]), pa.array([x[1] for x in p]), pa.array([np.array(x[2]).tobytes() for x in p])], names=["line", "sim", "keys"])
        for p in (rows[lo : lo + 130] for lo in range(0, len(rows), 130))
    ]
    for at_once, held in ((1 << 19, 1 << 21), (300, 1 << 21), (300, 50)):
        monkeypatch.setattr(line_dedup, "DEALT", at_once)
        monkeypatch.setattr(line_dedup, "HELD", held)
        dealt = [(b, r) for batch in line_dedup._dealt(8)(iter(batches)) for b, r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        assert len(dealt) == 8 if at_once > 1000 else 8 < len(dealt) <= 8 * 8
        dealt.sort(key=lambda x: x[0])
        for size in (1, 5, 100):
            got = {}
            parts = [dealt[lo : lo + size] for lo in range(0, len(dealt), size)]
            parts = [pa.RecordBatch.from_arrays([pa.array([b for b, _ in p], pa.int32()), pa.array([r for _, r in p])], names=["bucket", "rows"]) for p in parts]
            for batch in line_dedup._sets(iter(parts)):
                for cluster, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    got.setdefault(cluster, set()).add(line)
            assert got == want


def test_pairs_that_cannot_be_similar_are_not_compared():
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh é日", k=60)) for _ in range(4)]
    text = ["".join(rng.choice([c] * 9 + ["", "z", c + "x"]) for c in rng.choice(base)) for _ in range(40)] + ["0123456789 " * 5, "ABCDEFGHIJ " * 5]
    sim, size, side = np.zeros(len(text), np.uint64), np.array([len(t) for t in text]), np.zeros(len(text), int)
    kinds, label = line_dedup._kinds(text), np.arange(len(text))
    got = set(line_dedup._near(sim, size, side, kinds, label))
    want = {(i, k) for k in range(len(text)) for i in range(k) if similar(text[i], text[k])}
    assert want <= got and not any(k >= 40 for _, k in got)
    label[: len(text) // 2] = 0  # what is one group is not looked at again
    assert set(line_dedup._near(sim, size, side, kinds, label)) == {(i, k) for i, k in got if label[i] != label[k]}
