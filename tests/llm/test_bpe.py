"""Encoding against the tiktoken library, and the exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from fleet_audit.llm import bpe
from fleet_audit.llm.bpe import decode, encode, vocabulary
from fleet_audit.llm.op6_bpe import VOCABULARY, op6_byte_level_bpe

PATH = public_tokenizers.path(VOCABULARY)
LETTERS = "ab sstremvdl''' \n\t 　é12½٣!?,-中\U0001F600́\x1c\x85"


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary(PATH).ranks, special_tokens={})


def encoded(texts):
    ids, ends = bpe.encode_texts(texts, vocabulary(PATH))
    return [part.tolist() for part in np.split(ids, ends[:-1])]


def test_random_texts_as_the_library():
    rng, theirs = random.Random(3), library()
    texts = ["".join(rng.choices(LETTERS, k=rng.randrange(30))) for _ in range(4000)]
    texts += ["'s", "a's's'll'", "  's", "\n's", " \n's", "", "it's 'll", "", "''s", "a" * 5000, "!" * 3000 + "ab" * 3000, "<|endoftext|>", " " * 1000, "'", "'r", "\0"]
    assert encoded(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_every_code_point_has_the_librarys_class():
    theirs = library()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}1 {chr(c)}" for c in points[k : k + 20_000]]
        got = encoded(texts)
        assert [t for t, ids in zip(texts, got) if ids != theirs.encode_ordinary(t)] == []


def test_scan_equals_one_step_after_another():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 1000, 4097):
        classes = rng.integers(0, 8, n).astype(np.uint8)
        state, states = bpe.OPEN, []
        for c in classes:
            states.append(state)
            state = bpe._STEP[c, state]
        assert bpe.scan_states(classes).tolist() == states


def test_operator_with_nulls_offsets_and_other_columns(spark):
    rows = [(1, "Hello wörld's", "x"), (2, None, "y"), (3, "", None), (1, "Hello wörld's", "x"), (None, "a" * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode(encode(df, PATH), PATH).collect()
    assert len(out) == 5
    for r in out:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert len(r.ids) == len(r.ends) and (not r.ends or r.ends[-1] == len((r.text or "").encode()))
        pieces = [vocabulary(PATH).bytes[vocabulary(PATH).starts[i] :][: vocabulary(PATH).lengths[i]].tobytes() for i in r.ids]
        assert np.cumsum([len(p) for p in pieces]).tolist() == list(r.ends)
    missing = decode(df.select(F.lit(None).cast("array<int>").alias("ids")), PATH).collect()
    assert all(r.decoded is None for r in missing)


def test_query(spark, tmp_path):
    texts = ["it's a test", None, "", "ü\n\n  x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op6_byte_level_bpe(spark, str(tmp_path)).collect():
        ids = library().encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert encode(spark.createDataFrame([], "text string"), PATH).collect() == []
