import public_tokenizers
from tokenizers import Tokenizer

from findingflow.llm.token_counts import count_tokens, prove_whole_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "  two  spaces\n\n\tand tabs \n", "it's we'll 'S don't", "x<|endoftext|>y", "été ñandú Größe 12345 ½ ² x̂",
    "日本語 テキスト", "🙂🙂 emoji‍joined", "a\x1cb \x1f c\x85d\xa0e　f", "end  ", "́mark", "tail\n", "word " * 3000, "…—«»", "a  b",
]


def test_counts_equal_the_library(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(i, x, "clash") for i, x in enumerate(TEXTS)] + [(None, "null id", "clash"), (3, "a", "clash")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in rows]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted((str(i), b, n) for i, b, n in want)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_whole_tokens_are_proven(spark):
    t = Tokenizer.from_file(PATH)
    whole = prove_whole_tokens(t)
    assert " the" in whole and len(whole) > 40_000
    assert all(len(t.encode(x, add_special_tokens=False).ids) == 1 for x in list(whole)[:500])


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
