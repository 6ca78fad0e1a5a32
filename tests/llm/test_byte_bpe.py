import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cinelake.llm.byte_bpe import VOCABULARY, byte_characters, decode, encode, encode_digest


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    bits = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "5", "²", "!", "中", "\U0001f600", "\x00", "　", "́", "'S", "\x85", "word"]
    made = ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(3000)]
    return [None, "", "plain words, and more's the pity", "x" * 70000, " " * 3000 + "y", *made, "plain words, and more's the pity"]


def test_ids_equal_the_library(spark, library):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    for r in encode_digest(df).collect():
        ids = library.encode_ordinary(given[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), given[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256((given[r.doc_id] or "").encode()).hexdigest()


def test_offsets_and_split_characters(spark, library):
    text = "a\U0001f600中 z"
    df = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, IDS int")
    row = encode(df).first()
    ids, starts = row["ids_"], row["starts"]
    raw = text.encode()
    parts = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
    assert parts == [library.decode_single_token_bytes(i) for i in ids]
    whole = decode(encode(df), "ids_").first()
    assert whole.decoded_text == text
    # a prefix of the ids may end within a character: bytes are exact, text marks it
    cut = decode(encode(df).withColumn("ids_", F.slice("ids_", 1, 2)), "ids_").first()
    assert bytes(cut.decoded_bytes) == b"".join(parts[:2])
    assert cut.decoded_text == b"".join(parts[:2]).decode(errors="replace")


def test_byte_table_is_a_bijection_and_empty_tables(spark):
    assert len(set(byte_characters())) == 256
    assert encode_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decode_holds_a_piece_of_a_batch_only(spark):
    """A large batch leaves in pieces; ids never become Python objects; nulls among them are left out."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    from cinelake.llm import byte_bpe

    rows = type("Rows", (), {"columns": ["i", "ids"], "schema": T.StructType([]), "mapInArrow": lambda self, run, _: run})()
    lists = [[i % 200 for i in range(k, k + 500)] for k in range(4000)] + [None, [], [65, None, 66], [None]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int32()))], names=["i", "ids"])
    want = byte_bpe.codec(None).decode([65, 66], [2])[0].tobytes()
    run, sizes, seen = byte_bpe.decode(rows), [], []
    tracemalloc.start()
    for out in run(iter([batch])):
        sizes.append(out.num_rows)
        seen += out.column(0).to_pylist()
        last = out.column(2).to_pylist()[-4:]
        del out
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == list(range(len(lists))) and max(sizes) < 1000
    assert last == [b"", b"", want, b""]
    assert peak < 40e6
