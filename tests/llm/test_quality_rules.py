import re
from collections import Counter

from cinelake.llm.quality_rules import RepetitionRules, keep_good, repetition_quality

TEXTS = [
    None,
    "",
    "one two three",
    "a b c d e f g h i j",
    "x y z w v " * 9,
    "same line here\nother line\nsame line here\n\n \nother line\nunique one two three",
    "é ü ñ 中文 ## $% <tag> | pipe & and *bold* more words to reach the limit",
    " ".join(f"w{i}" for i in range(3000)),
    "word " * 5000,
    "\x00 \x01a b c d \x0b e \x0c f",
    "solid" * 30000,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(n - 1 for n in lines.values()), len(hit),
        len(words) < 10 or 100 * len(hit) > 20 * len(words),
    )


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, N_WORDS string")


def test_counts_equal_brute_force(spark):
    got = {r.doc_id: r for r in repetition_quality(rows(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words_"], r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert not (r.base_failed and r.kept)
        assert r["N_WORDS"] == "x"


def test_coverage_rejects_repeated_lines(spark):
    line = "this line of plain words is repeated in full here"
    text = "\n".join([line, *("".join(chr(97 + (i * k) % 26) for k in range(1, 8)) + f" filler{i} unique{i}" for i in range(8)), line])
    strict = RepetitionRules(max_line_cover=0.1, max_repeat_words_pct=100, max_ngram_cover={})
    loose = RepetitionRules(max_line_cover=0.9, max_repeat_words_pct=100, max_ngram_cover={})
    df = rows(spark, [text])
    assert not repetition_quality(df, rules=strict).first().kept
    assert repetition_quality(df, rules=loose).first().kept


def test_filter_keeps_columns_and_empty_tables(spark):
    df = rows(spark)
    kept = keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {3, 6, 7}
    assert keep_good(df.limit(0)).count() == 0
