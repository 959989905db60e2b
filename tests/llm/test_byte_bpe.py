"""Byte-level BPE against the library whose ranks it reads."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from paperlens.llm import byte_bpe

ODD = ["", " ", "\n\n  x", "don't  'll  we've", "日本語の文 é̂ 🎉👩‍👩‍👧 ", "\x00\x1c  \xa0x", "<|endoftext|>", "ꟑ𖹀½Ⅷ", "a" * 700 + "  " * 300, "1234567 " * 90, "\U0010ffff�"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    path = public_tokenizers.path(request.param)
    ranks = byte_bpe.read_ranks(path)
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rows(both, corpus, nothing):
    (path, library), (docs, rows) = both, corpus
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, offsets=True)
    got = sorted((str(r.doc_id), r.ids, r.starts, r.ends, bytes(r.bytes)) for r in byte_bpe.decode(encoded, path, public_tokenizers.PATTERN).collect())
    want = []
    for r in rows:
        text = r[1] or ""
        ids = library.encode_ordinary(text)
        _, starts = library.decode_with_offsets(ids)
        want.append((str(r[0]), ids, starts, text))
    want = sorted(want)
    assert [(a[0], a[1]) for a in got] == [(a[0], a[1]) for a in want]
    for (_, ids, starts, ends, data), (_, _, first, text) in zip(got, want):
        assert data == text.encode() and starts == first
        assert all(token in text[i:j].encode() for token, i, j in zip(library.decode_tokens_bytes(ids), starts, ends))
    assert byte_bpe.decode(byte_bpe.encode(nothing, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("window", [1 << 18, 200])
def test_windows(both, monkeypatch, window):
    path, library = both
    monkeypatch.setattr(byte_bpe, "WINDOW", window)
    codec = byte_bpe.codec(path, public_tokenizers.PATTERN)
    texts = [*ODD, " ".join(ODD) * 5, None, "word 'll " * 500]
    for offsets in (False, True):
        for text, (ids, starts, ends) in zip(texts, codec.encode(texts, offsets), strict=True):
            assert ids.tolist() == library.encode_ordinary(text or "")
            assert not offsets or not text or (starts[0], ends[-1]) == (0, len(text))


def test_ranks_of_no_training():
    """Ranks at random: entries that are reached by later ones, by overlaps, or only as whole pieces."""
    import base64
    import random
    import tempfile

    rng = random.Random(2)
    for _ in range(30):
        entries = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 6))).encode() for _ in range(12)}
        order = [bytes([b]) for b in range(256)] + rng.sample(sorted(entries), len(entries))
        with tempfile.NamedTemporaryFile("w", suffix=".tiktoken") as f:
            f.write("".join(f"{base64.b64encode(e).decode()} {n}\n" for n, e in enumerate(order)))
            f.flush()
            codec = byte_bpe.Codec(f.name, public_tokenizers.PATTERN)
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: n for n, e in enumerate(order)}, special_tokens={})
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(60)]
        assert [x[0].tolist() for x in codec.encode(texts, False)] == [library.encode_ordinary(t) for t in texts]


def test_decoding(both, spark):
    path, library = both
    codec = byte_bpe.codec(path, public_tokenizers.PATTERN)
    text = "naïve 🎉 日本 ̀"
    ids = library.encode_ordinary(text)
    parts = codec.token_texts(ids)
    assert "".join(parts) == text and len(parts) == len(ids) and "" in parts  # a token that only begins a character
    assert codec.token_texts(library.encode_ordinary("🎉")[:1]) == ["�"] and codec.token_texts([]) == []
    rows = spark.createDataFrame([(1, ids, "old"), (2, None, "x"), (3, [], "x"), (4, [ids[0], None], "x"), (5, [10**8], "x"), (6, [-1], "x"), (7, ids[:1] * 3, "x")], "doc_id int, ids array<int>, bytes string")
    got = {r.doc_id: r.bytes for r in byte_bpe.decode(rows, path, public_tokenizers.PATTERN).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {1: text.encode(), 2: None, 3: b"", 4: None, 5: None, 6: None, 7: b"na"[:1] * 3 if library.decode_single_token_bytes(ids[0]) == b"n" else library.decode_single_token_bytes(ids[0]) * 3}
    assert byte_bpe.decode(rows.limit(0), path, public_tokenizers.PATTERN).filter(F.col("bytes").isNotNull()).count() == 0
