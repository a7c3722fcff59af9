import hashlib

import public_tokenizers
import pytest
import tiktoken

from kategora.llm import byte_bpe

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TEXTS = ["I'll say 'tis  \n\n  x 　y", "aaaa" * 60 + " " * 40, "<|endoftext|>", "\x00\x1c\x85 12345 ½", "the the the them"]


@pytest.mark.parametrize("frequent", [0, 100])
def test_equals_library(spark, edges, docs_of, frequent):
    """Looked up or folded in place, ids are those of the library, and decode to the text."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    docs = edges.filter("doc_id is null or doc_id <> 6").unionByName(docs_of(*[(100 + i, t) for i, t in enumerate(TEXTS)]))
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    got = sorted(byte_bpe.digests(bpe.encode(docs, frequent=frequent), bpe).collect(), key=repr)
    want = []
    for doc, text in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(text or "")
        joined = " ".join(map(str, ids)).encode()
        want.append((doc, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_empty(docs_of):
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    assert byte_bpe.digests(bpe.encode(docs_of()), bpe).count() == 0
