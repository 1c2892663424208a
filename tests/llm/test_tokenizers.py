import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from llm_cases import edge_rows

from mediaspark.llm import bpe, token_counts

ALPHABET = "aabbethin  \n\r\t'sé漢字🙂ñ1234!!## ‍"


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_tiktoken(ranks, reference):
    codec = bpe.Codec(ranks, P.PATTERN)
    texts = random_texts(1500, 1) + ["a" * 5000, "", "<|endoftext|>"]
    for text, ids in zip(texts, codec.encode_batch(texts)):
        assert [int(x) for x in ids.split()] == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_replay_with_any_ranks():
    """Rank tables in which later merges make earlier ones possible: compare with a plain loop over each piece."""
    rng = random.Random(4)
    for _ in range(200):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        for t in rng.sample(sorted(tokens), len(tokens)):
            ranks[t] = len(ranks)
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(20)]
        want = []
        for p in pieces:
            parts = [p[i : i + 1] for i in range(len(p))]
            while True:
                options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not options:
                    break
                _, i = min(options)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want.append([ranks[x] for x in parts])
        assert bpe.replay(pieces, ranks) == want


def test_encode_bears_edges(spark, edge, empty, reference):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode(edge, path, P.PATTERN, keep=("doc_id", "k0", "t")).collect()
    want = sorted((i or -1, tuple(reference.encode_ordinary(t or ""))) for i, t, _ in edge_rows())
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in rows) == want and all(r.intact for r in rows)
    digest = bpe.encode(edge, path, P.PATTERN, digests=True).filter("doc_id = 1").first()
    ids = reference.encode_ordinary(edge_rows()[0][1])
    assert digest.n_tokens == len(ids)
    assert digest.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digest.decoded_sha256 == hashlib.sha256(edge_rows()[0][1].encode()).hexdigest()
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def unigram(vocabulary, byte_fallback):
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library():
    vocabulary = token_counts.read_vocabulary(P.path("piece_bpe_32k.model"))
    count, want = token_counts.Counter(vocabulary).count, unigram(vocabulary, True)
    for text in random_texts(1500, 2):
        assert count(text) == want(text), repr(text)


def test_tie_rules_on_small_vocabularies():
    rng = random.Random(6)
    for _ in range(60):
        pieces = {"".join(rng.choice("▁ab") if i == 0 else rng.choice("ab") for i in range(rng.randint(1, 4))) for _ in range(12)}
        vocabulary = [(p, float(rng.randint(-3, 0))) for p in sorted(pieces)]
        count, want = token_counts.Counter(vocabulary).count, unigram(vocabulary, False)
        for _ in range(40):
            text = "".join(rng.choice("aabb cd") for _ in range(rng.randint(1, 15)))
            assert count(text) == want(text), (vocabulary, text)


def test_count_tokens_bears_edges(spark, edge, empty):
    vocabulary = token_counts.read_vocabulary(P.path("piece_bpe_32k.model"))
    want = unigram(vocabulary, True)
    rows = token_counts.count_tokens(edge, vocabulary).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == sorted((i or -1, want(t) if t else 0) for i, t, _ in edge_rows())
    assert token_counts.count_tokens(empty, vocabulary).count() == 0


def test_replay_looks_up_a_merge_twice_and_first_pairs_once(ranks):
    """Once with each neighbour of a merged pair; neither each pair of bytes anew nor each position of the index."""

    class Counting(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    pieces = [f" {a}{b}ing".encode() for a in ("walk", "talk", "run", "aaaa", "é漢") for b in ("", "er", "inter", "xyz")] + [b"", b"a"]
    counting = Counting(ranks)
    ids = bpe.replay(pieces, counting)
    merges = sum(len(p) - len(i) for p, i in zip(pieces, ids))
    first = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    assert merges > 50
    # The pairs across a separator are looked up too, a kind once.
    assert counting.asked <= 2 * merges + len(first) + 2 * len(pieces)
