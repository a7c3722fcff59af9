"""Distinct words merged together, against merging one after the other."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from kategora.llm import byte_bpe

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def plain(ranks, word):
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, byte_bpe.NO_RANK), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == byte_bpe.NO_RANK:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks.get(p, byte_bpe.NO_RANK) for p in parts]


def encoded(ranks, words):
    bpe = byte_bpe.ByteBpe(ranks, "")
    found, new = bpe.vocabulary.encoded(pa.array(words, pa.binary()), bpe.merges)
    again, none = bpe.vocabulary.joined(found, new).encoded(pa.array(words, pa.binary()), bpe.merges)
    assert len(none) == 0
    for known in (found, again):
        yield [known.ids[a : a + n].tolist() for a, n in zip(known.start, known.count, strict=True)]


@pytest.mark.parametrize("long", [byte_bpe.LONG, 5])
def test_merges(monkeypatch, long):
    """Any order of ranks, pieces that no merge makes, bytes that are no piece; by rounds and by queue, in one and in many blocks."""
    monkeypatch.setattr(byte_bpe, "LONG", long)
    random = np.random.default_rng(5)
    for case in range(40):
        monkeypatch.setattr(byte_bpe, "BLOCK", [7, 1 << 16][case % 2])
        pieces = {bytes(random.choice(list(b"abc"), size=random.integers(1, 6))) for _ in range(30)} | {b"a", b"b"}
        ranks = {p: int(r) for p, r in zip(sorted(pieces), random.permutation(len(pieces)) * 2, strict=True)}
        words = sorted({bytes(random.choice(list(b"aabcd"), size=random.integers(0, 12))) for _ in range(200)})
        want = [plain(ranks, w) if w else [] for w in words]
        assert all(got == want for got in encoded(ranks, words))
    assert all(got == [] for got in encoded(ranks, []))


def test_distinct_words_once(spark, docs_of, tmp_path):
    """A rare word is merged once for all its occurrences; words of 20,000 characters do not take the square of their length."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rare = " ".join(f"qzx{'wvk' * (i % 40)}{i}jxqz" for i in range(2_000))
    texts = [rare] * 40 + ["語" * 7_000 + "漢字仮名交" * 2_600, "xyzzyq" * 3_400, "=" * 20_000, " " * 20_000 + "x", "a b " * 200_000]
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    docs = docs_of(*enumerate(texts)).repartition(2)
    got = byte_bpe.digests(bpe.encode(docs, frequent=0), bpe).collect()
    assert len(got) == len(texts)
    for doc, n, ids_sha, decoded_sha in got:
        ids = library.encode_ordinary(texts[doc])
        assert (n, ids_sha) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert decoded_sha == hashlib.sha256(texts[doc].encode()).hexdigest()


def test_batches(spark, docs_of, edges, monkeypatch):
    """Small batches that pass on their frequent words, rows dealt to several slices, the long text of the edge cases."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
        bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
        docs = edges.unionByName(docs_of(*[(100 + i, f"xqzwvk{i % 7}jjq unusualness{i} " * (i % 5)) for i in range(40)])).coalesce(1)
        texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = sorted(((d, library.encode_ordinary(t or "")) for d, t in texts), key=repr)
        for frequent in (0, 3, byte_bpe.FREQUENT):
            assert sorted(map(tuple, bpe.encode(docs, frequent=frequent).collect()), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
