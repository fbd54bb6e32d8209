"""Token ids and counts against the public libraries."""
import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tierflow.llm import byte_bpe as bb
from tierflow.llm import token_counts as tc

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = " \n\t\r\x0b\x0c\x1c\x1f\x85\u00a0\u2003\u3000\u2028 \n aaaab'sS12é\u0301²½ªßİǅ日本!?.-_|<>\u200d\u200b\ufeff𝟘😀"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    out = ["".join(rnd.choices(ODD, k=rnd.randint(0, 60))) for _ in range(800)]
    out += [None, "", " ", "a" * 5000, "ab" * 3000, "'ll've're", "a<|endoftext|>b <|startoftext|> x", "ΑΣ ΑΣΑ", "word " * 4000, "x" * 3000 + " " + "y" * 200_000, "é" * 90_000]
    return out


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(frame, texts, plain):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]
    encoded = bb.encode(frame(rows), RANKS, P.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((str(i), len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), ids))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in encoded.collect()) == sorted(want)
    decoded = bb.decode(encoded, RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in decoded) == sorted((str(i), (t or "").encode()) for i, t in rows)


def test_memory_of_pieces_may_be_small(plain):
    encoder = bb.Encoder(bb.Ranks.load(RANKS), P.PATTERN, most=5)
    for t in ("one two three four", "five six seven one", "one one one"):
        ids = next(iter(encoder.block([t])))
        assert np.frombuffer(ids, "<i4").tolist() == plain.encode_ordinary(t)


def test_decoding_in_small_lots(monkeypatch, plain):
    """Rows cut over many lots, empty and null rows between them: the digests' strings and the decoded bytes stay whole."""
    import pyarrow as pa
    ranks = bb.Ranks.load(RANKS)
    rows = [plain.encode_ordinary(t) for t in ("", "one two", "", "x" * 50 + " yz", "é" * 9, "")]
    for size in (1, 2, 3, 1000):
        monkeypatch.setattr(bb, "LOT_IDS", size)
        ids = pa.array([[9], *rows], pa.list_(pa.int32())).slice(1)
        for strings, want in ((ranks.decoded, [plain.decode_bytes(r) for r in rows]), (ranks.decimal, ["".join(f"{i} " for i in r).encode() for r in rows])):
            got = [b""] * len(rows)
            over = []
            for lot in bb._joined(strings, ids):
                for row, text, ends in lot:
                    got[row] += bytes(text)
                    over += [row] * ends
            assert got == want and over == list(range(len(rows)))
    assert list(bb._joined(ranks.decoded, pa.array([], pa.list_(pa.int32())))) == [[]]
    with pytest.raises(KeyError):
        ranks.decoded.join(np.array([-1]))


def test_null_ids_stay_null(spark):
    df = spark.createDataFrame([(1, [0]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [(r.doc_id, None if r.decoded is None else bytes(r.decoded)) for r in bb.decode(df, RANKS).orderBy("doc_id").collect()] == [(1, b"!"), (2, None), (3, b"")]


def test_counts(frame, texts):
    library = Tokenizer.from_file(WORDS)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for chunk, overlap in ((tc.CHUNK, tc.OVERLAP), (700, 16)):
        got = tc.count_tokens(frame(rows), WORDS, chunk=chunk, overlap=overlap).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_splices_keep_every_token_start():
    library, rnd = tc.load(WORDS), random.Random(2)
    for text in ("word, and more " * 900, "".join(rnd.choices(ODD, k=9000)), "é" * 4000 + " " + "z" * 7000):
        whole = tc.encode_offsets(library, text.encode())
        for chunk, overlap in ((300, 20), (1000, 64), (4000, 10)):
            assert np.array_equal(whole, tc.spliced_starts(library, text.encode(), chunk, overlap))


def test_no_rows(frame):
    assert bb.encode(frame([]), RANKS, P.PATTERN).count() == 0 and tc.count_tokens(frame([]), WORDS).count() == 0
