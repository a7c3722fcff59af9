import hashlib
import re
from collections import Counter

import pytest

from kategora.llm.exact_dedup import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest_hex", [64, 2])
def test_brute_force(edges, digest_hex):
    """The short digest makes different texts collide, so whole texts have to decide."""
    rows = [(r["doc_id"], norm(r["text"])) for r in edges.select("doc_id", "text").collect()]
    sizes = Counter(t for _, t in rows)
    keep = {t: min((d for d, x in rows if x == t and d is not None), default=None) for t in sizes}
    got = [tuple(r) for r in exact_dedup(edges, digest_hex=digest_hex).collect()]
    want = [(d, keep[t], sizes[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
    assert Counter((a, b, c, e) for a, b, c, _, e in got) == Counter(want)
    kept = Counter(e for *_, k, e in got if k)
    assert kept == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in sizes})


def test_empty(docs_of):
    found = exact_dedup(docs_of())
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and found.count() == 0


def test_native(edges):
    plan = exact_dedup(edges)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
