import public_tokenizers
import pytest
from helpers import DOC, awkward, with_extra
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from staytrail.llm import tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
COUNT = tokens.counter("byte_bpe_50k.json")
ODD = ["a  b", "a \n b", "\n x", "<|endoftext|> x <|endoftext|>y", "a  b", "x  y", "  lead", "trail  ", " ", "", "it's  'll we 've",
       "a\t b", "1 2  3 ¡a × b", "\x1c a \x85 b", "😀 😀  a", "don 't <| endoftext |>", " ​ x", "\r\n x\x0b y"]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_odd_texts():
    assert [COUNT(t) for t in ODD] == [library(t) for t in ODD]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD + ["word", "'s", ",", "é", "9"]), st.text(max_size=6)), max_size=12).map(" ".join))
def test_pieces_add_up(text):
    text = text.encode("utf-8", "replace").decode()
    assert COUNT(text) == library(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_documents_and_cache(spark, tmp_path, name):
    rows = awkward()
    docs = with_extra(spark, rows)
    cache = f"file://{tmp_path}/cache"
    out = tokens.count_tokens(docs, name, cache=cache).collect()
    count = tokens.counter(name)
    want = [(i or -1, len((t or "").encode()), count(t or ""), count(t or "") > 512) for i, t, *_ in rows]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == sorted(want)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, *_ in rows})  # one entry for each distinct text
    again = tokens.count_tokens(docs, name, cache=cache).collect()
    assert sorted(map(str, again)) == sorted(map(str, out)) and spark.read.parquet(cache).count() == stored.count()
    more = spark.createDataFrame([(1, "new text", "en", "s", 1), (2, rows[0][1], "en", "s", 1)], DOC)
    tokens.count_tokens(more, name, cache=cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1


def test_cache_is_used_and_kept_apart_by_tokenizer(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "some text", "en", "s", 1)], DOC)
    digest = docs.selectExpr("sha2(text, 256)").first()[0]
    spark.createDataFrame([(tokens.tokenizer_digest("byte_bpe_50k.json"), digest, 77)], tokens.CACHE_SCHEMA).write.parquet(cache)
    assert tokens.count_tokens(docs, cache=cache).first().n_tokens == 77
    assert tokens.count_tokens(docs, "word_bpe_49k.json", cache=cache).first().n_tokens == 2


def test_empty(spark):
    assert tokens.count_tokens(spark.createDataFrame([], DOC)).collect() == []
