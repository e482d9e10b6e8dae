"""The table of known pieces behind token ids."""

import random

import numpy as np
import pyarrow as pa

from lakelog.llm import token_output

from test_brute_force import text


class Counted:
    """An encoding that counts its calls."""

    def __init__(self, own):
        self.own, self.calls = own, 0

    def encode_ordinary(self, x):
        self.calls += 1
        return self.own.encode_ordinary(x)


def test_pieces_are_encoded_once_in_a_worker():
    """Later tasks of a worker, and later batches, find the pieces of those before."""
    known = token_output.encoder(token_output.VOCABULARY)
    known.encoding, own = Counted(known.encoding), known.encoding
    try:
        texts = pa.array(["one two  three\n\nfour 55", None, "", "two one two"])
        first = known.ids(texts)
        calls = known.encoding.calls
        again = token_output.encoder(token_output.VOCABULARY).ids(texts)
        assert known.encoding.calls == calls and all((a == b).all() for a, b in zip(first, again))
    finally:
        known.encoding = own


def test_ids_while_the_table_grows_and_is_cleared():
    r = random.Random(7)
    encode = token_output.encoding(token_output.VOCABULARY).encode_ordinary
    known = token_output.Encoder(token_output.VOCABULARY, most=30_000)
    for k in range(12):
        texts = [" ".join(r.choice([f"x{r.randrange(10**6)}", "é" * r.randint(1, 9), "isn't", "\t\n"]) for _ in range(400)) for _ in range(30)]
        texts += [text(r), "", "'", " ", "a" * 3000]
        ids, first = known.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [encode(t) for t in texts]


def test_keys_that_share_places():
    known = token_output.Encoder(token_output.VOCABULARY)
    r = np.random.default_rng(8)
    keys = np.unique(np.concatenate([np.arange(300, dtype=np.uint64) << np.uint64(40), np.uint64(32767) + (np.arange(300, dtype=np.uint64) << np.uint64(32)), r.integers(0, 1 << 63, 9000).astype(np.uint64)]))
    seen = 0
    for part in np.array_split(r.permutation(keys), 7):
        assert (known._find(part) == -1).all()
        known._add(part, [[int(k % 50_000)] for k in part.tolist()])
        seen += len(part)
        assert known._find(known.key[:seen]).tolist() == list(range(seen))
        assert known.pool[known.start[:seen]].tolist() == [int(k % 50_000) for k in known.key[:seen].tolist()]
