import re
import zlib
from collections import defaultdict
from unicodedata import normalize
from unittest import mock

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kategora.llm import packing

DEFINITION = packing.read_definition(public_tokenizers.path("word_bpe_49k.json"))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan(lengths):
    """Every piece is used once, no sequence is too long, and bin completion is never worse than best fit."""
    counts = np.bincount(lengths, minlength=41)
    patterns, bound = packing.solve(counts, 40)
    used = np.zeros(41, int)
    for p in patterns:
        assert sum(x * n for x, n in p.items) <= 40
        for x, n in p.items:
            used[x] += n * p.copies
    assert (used == counts).all()
    assert bound <= sum(p.copies for p in patterns) <= sum(n for n, _ in packing.best_fit(counts, 40))
    assert [p.first for p in patterns] == np.cumsum([0, *[p.copies for p in patterns]])[:-1].tolist()


def test_completion_beats_best_fit():
    """Best fit decreasing needs three sequences here, two are enough."""
    counts = np.bincount([7, 6, 3, 3, 3, 2, 4, 4], minlength=17)
    assert sum(p.copies for p in packing.solve(counts, 16)[0]) == 2


def fewest(lengths, capacity):
    """By trying every sequence for every piece."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [r - lengths[i] if j == k else r for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(1, 40), max_size=10))
def test_optimum(lengths):
    """On few pieces the search is complete: no plan has fewer sequences, and the bound says so."""
    patterns, bound = packing.solve(np.bincount(lengths, minlength=41), 40)
    assert sum(p.copies for p in patterns) == fewest(lengths, 40) >= bound


def test_branches_beyond_the_first_filling():
    """The first filling of the longest piece is the wrong one, for best fit too."""
    counts = np.zeros(2049, np.int64)
    counts[[1224, 612, 510, 306, 204]], counts[[918, 714]] = 1000, 2000
    patterns, bound = packing.solve(counts, 2048)
    assert sum(n for n, _ in packing.best_fit(counts, 2048)) > 3000 == sum(p.copies for p in patterns)
    assert bound == 2989


TOKENIZER = Tokenizer.from_str(DEFINITION)
WORD = st.text("aBzéÉßİΣς本́ͅ.,'!1½ -", max_size=8) | st.text(max_size=5) | st.sampled_from(["don't.", "U.S.,", "a.b.", "x!.", "1.", "é.,", "'s."])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.lists(WORD, max_size=8).map(" ".join), max_size=5))
def test_encoder(texts):
    """Words, endings and plain words encoded apart give the ids of the whole text."""
    found = packing.encoder_of(DEFINITION).encode(texts)
    want = [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert found == want


def test_encoder_forgets(monkeypatch):
    """What is kept is bounded by bytes, whatever the words."""
    monkeypatch.setattr(packing, "CACHED", 3_000)
    encoder = packing.Encoder(DEFINITION)
    for i in range(30):
        encoder.encode([" ".join(f"{i}x{k} again" + "y" * k for k in range(30))])
        assert encoder.bytes <= 3_000 + 10_000


def test_pieces_and_places(edges, docs_of):
    docs = edges.unionByName(docs_of((20, "a\x1cb Σίσυφος ΣΑΣ İ <|endoftext|>"), (21, "x " * 2047), (22, "x " * 2048)))
    tokenizer = Tokenizer.from_str(DEFINITION)
    rows = packing.pack(docs, DEFINITION, ids=True).collect()
    want = defaultdict(int)
    for doc, text in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty(docs_of):
    assert packing.pack(docs_of(), DEFINITION).count() == 0


def test_stop_after_a_mark():
    """A stop is one piece with the mark that a letter ends with once it is normalised and lower-cased."""
    ends = [c for c in map(chr, range(0x110000)) if c.isalnum() and not normalize("NFC", c).lower()[-1].isalnum()]
    assert ends == [c for c in map(chr, range(0x110000)) if re.match(f"[{packing.MARKED}]", c)]
    texts = [f"a{c}., {c}. b" for c in ends]
    want = [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.Encoder(DEFINITION).encode(texts) == want


def test_texts_are_read_in_slices():
    """Not all texts of a batch are Python strings at once; each has its own ids all the same."""
    sizes = []

    class Sized(packing.Encoder):
        def encode(self, texts):
            sizes.append(sum(map(len, texts)))
            return super().encode(texts)

    texts = [f"word{i} " * 40 for i in range(3 * packing.ROWS)] + [None, ""]
    held = mock.patch.object(packing, "CHUNK", 1 << 16)
    with held:
        found = list(packing._encoded(Sized(DEFINITION), pa.array(texts)))
    want = [np.array(TOKENIZER.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert found == want and len(sizes) > 2 and max(sizes) < 1 << 17
