"""Token ids: equal to the public library's, and back again."""

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkglass.llm import tokens

LIBRARY = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
LIBRARY.encode_special_tokens = True
MACHINE = tokens._Words(tokens.Transducer(tokens.read_ranks()))


def mine(text):
    import regex

    return [i for w in regex.findall(tokens.PRE_TOKENS, text) for i in MACHINE[w]]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aeinrst ,.'1200\n\té漢🙂", max_size=200))
def test_like_the_library(text):
    assert mine(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_corners(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> it's   odd \n\n x"), (4, "a" * 20_000), (5, "🙂é漢字" * 300), (6, " \t\n ")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got[1] == got[2] == []
    assert all(got[i] == LIBRARY.encode(t, add_special_tokens=False).ids for i, t in rows if t)
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    assert tokens.encode(df.limit(0)).count() == 0


@given(st.binary(max_size=60), st.integers(1, 7))
def test_streaming_utf8(data, step):
    machine = tokens.Utf8Decoder()
    got = "".join(machine.feed(data[i : i + step]) for i in range(0, len(data), step)) + machine.end()
    assert got == data.decode("utf-8", "replace")
