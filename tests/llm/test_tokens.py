import random

import pytest

from labelloom.llm import tokens

PATH = f"{tokens.DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    try:
        return tokens.encoder(PATH)
    except FileNotFoundError:
        pytest.skip("no vocabulary files here")


def texts():
    pick = random.Random(2)
    out = ["", "Hello  world\n\n x", "<|endoftext|>", "don't I'LL we've", "a" * 3000, "ab" * 400, " \t ", "👩‍⚕️ naïve Ωμέγα", "\x00\x7f", "0123456789" * 50, "!!!???...---" * 30]
    ranges = [(32, 127), (160, 1280), (0x4E00, 0x4F00), (0x1F300, 0x1F600), (97, 101)]
    for _ in range(1500):
        low, high = pick.choice(ranges)
        out.append("".join(chr(pick.randrange(low, high)) for _ in range(pick.randrange(60))))
    return out


def test_equals_the_library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=tokens.read_ranks(PATH), special_tokens={})
    for t in texts():
        assert encoder.encode(t) == library.encode_ordinary(t), t


def test_small_bounds_change_nothing(encoder):
    small = tokens.Encoder(tokens.read_ranks(PATH), max_pieces=3)
    small.transducer.max_states, small.transducer.max_pairs = 50, 20
    for t in texts()[:200]:
        assert small.encode(t) == encoder.encode(t)


def test_decoder_is_incremental(encoder):
    for t in texts():
        machine = tokens.Utf8Decoder()
        assert "".join(machine.feed(encoder.transducer.tokens[i]) for i in encoder.encode(t)) + machine.close() == t
    pick = random.Random(4)
    for _ in range(5000):
        data = bytes(pick.choice([pick.randrange(256), 0xE2, 0x82, 0xED, 0xF0, 0x9F]) for _ in range(pick.randrange(9)))
        machine = tokens.Utf8Decoder()
        assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.close() == data.decode("utf-8", "replace")


def test_frame(spark, encoder):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (None, "y" * 200_000, "x")]
    df = spark.createDataFrame(rows, "d bigint, t string, ids string")
    out = tokens.encode_texts(df, "d", "t").collect()
    assert [(r.d, r.ids) for r in out[:4]] == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert tokens.encode_texts(df.limit(0), "d", "t").count() == 0
    back = tokens.decode_ids(tokens.encode_texts(df, "d", "t"), "d", "ids").collect()
    assert [r.text for r in back] == ["", "", "Hello world", "Hello world", "y" * 200_000]
    assert tokens.decode_ids(spark.createDataFrame([(1, None)], "d bigint, ids array<int>"), "d", "ids").first().text is None
