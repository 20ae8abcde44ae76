import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from litsift.llm import bpe

from .rows import ROWS, documents

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def ids(blob):
    return list(memoryview(blob).cast("i")) if blob else []


def test_texts_as_the_library_encodes_them(vocabulary, library):
    draw = random.Random(3)
    pool = [0x1C, 0x1F, 0x85, 0xA0, 0xB2, 0x2167, 0x660, 0xF20, 0x24EA, 0x4E00, 0x5F, 0x300, 0x20, 0x0A, 0x1F600]
    texts = ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(1, 0xD7FF), draw.choice(pool)]))
                     for _ in range(80)) for _ in range(400)]
    texts += ["", " ", "\n\n a", "a" * 3000, "x" * 300 + " " + "é" * 400, " " * 999 + "b", "don't we'll I'M"]
    store = {}
    for text, got in zip(texts, bpe.encode_texts(texts, vocabulary, store, P.PATTERN)):
        assert ids(got) == library.encode_ordinary(text)


def test_both_merge_loops_agree(vocabulary):
    draw = random.Random(5)
    pieces = [bytes(draw.choice(b"aetin sou") for _ in range(draw.randrange(2, 200))) for _ in range(300)]
    pieces = [p for p in set(pieces) if p not in vocabulary.ranks]
    by_width = {}
    for p in pieces:
        by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(p)
    for width, group in by_width.items():
        assert vocabulary._lockstep(group, width) == [vocabulary._alone(p) for p in group]


def test_digests_of_awkward_rows(spark, library):
    got = bpe.digests(documents(spark), PATH, P.PATTERN).collect()
    want = []
    for doc_id, text, _ in ROWS:
        own = library.encode_ordinary(text or "")
        want.append((str(doc_id), len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.digests(documents(spark).limit(0), PATH, P.PATTERN).count() == 0
