import re
from collections import Counter

import numpy as np

from kategora.llm import quality_rules as qr


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def test_counts(edges):
    texts = [r["text"] for r in edges.select("text").collect()]
    texts += ["a b c a b c a", "a b c\na b c\n\n \n x y", "#*$%&|<> \x0b é\x85é \xa0", "a a a a", "x y z", "a b a b a"]
    for t in texts:
        assert qr.text_counts(t) == plain_counts(t)


def test_symbols_of_all_planes():
    """A code point behind the basic plane is classed as any other is: capital, digit, sign, letter, not one of 17 bins."""
    text = "\U0001d400a\U0001d7d8a\U0001f600a\U00020000"
    last = qr.symbols([text])[1] % qr.SYMBOLS
    assert last.tolist() == [27, 1, 28, 1, 30, 1, 39 + 0x20000 % 17]
    # Runs of one sign are one symbol there, too.
    assert qr.symbols(["\U0001d7d8\U0001d7d9"])[1].tolist() == [28]


def test_model_is_a_distribution():
    """The chances of all symbols after any context add up to one, seen or not."""
    random = np.random.default_rng(1)
    code = np.unique(random.integers(0, 9, 300) * qr.SYMBOLS**2 + random.integers(0, 9, 300) * qr.SYMBOLS + random.integers(0, 9, 300))
    count = random.integers(1, 9, len(code))
    model = qr.KneserNey.fit(["", "en"], np.repeat([0, 1], [len(code) // 2, len(code) - len(code) // 2]), code, count)
    for lang in (0, 1):
        for context in ([1, 2], [3, 4], [50, 2], [50, 51]):
            keys = (context[0] * qr.SYMBOLS + context[1]) * qr.SYMBOLS + np.arange(qr.SYMBOLS)
            assert abs(model.chance(np.full(qr.SYMBOLS, lang), keys).sum() - 1) < 1e-9


def test_against_dictionaries():
    """Chances of a small model against the formulas written out over dictionaries."""
    text = "banana bandana cabana anagram abracadabra " * 3
    _, code = qr.symbols([text])
    keys, count = np.unique(code, return_counts=True)
    model = qr.KneserNey.fit(["en"], np.zeros(len(keys), int), keys, count)
    s = qr.SYMBOLS
    three = dict(zip(keys.tolist(), count.tolist(), strict=True))
    two, one = Counter(k % s**2 for k in three), Counter()
    one.update(k % s for k in two)

    def cut(table):
        n = Counter(table.values())
        if not (n[1] and n[2]):
            return lambda c: 0.5
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1]] + [m - (m + 1) * y * n[m + 1] / n[m] if n[m] else 0.5 for m in (2, 3)]
        d = [min(max(x, 0.05), m) for x, m in zip(d, (0.95, 1.9, 2.8), strict=True)]
        return lambda c: d[min(c, 3) - 1]

    def level(table, key, lower):
        own = {k: c for k, c in table.items() if k // s == key // s}
        if not own:
            return lower
        d, total = cut(table), sum(own.values())
        base = (own[key] - d(own[key])) / total if key in own else 0
        return base + sum(map(d, own.values())) / total * lower

    for key in [*three, 5 * s * s + s + 2, s * s + 2 * s + 30]:
        flat = level(one, key % s, 1 / s)
        assert abs(model.chance(np.array([0]), np.array([key]))[0] - level(three, key, level(two, key % s**2, flat))) < 1e-9


def corpus(docs_of):
    random = np.random.default_rng(3)
    en, de = ("the of and that with some thing here there people time".split(), "der und nicht auf mit eine zeit leute sind haben sehr".split())
    say = lambda words, n: " ".join(random.choice(words, n))
    rows = [(i, say(en if i % 2 else de, 150), "en" if i % 2 else "de") for i in range(120)]
    junk = " ".join(w + "$$$" for w in random.choice(en, 150))
    mixed = say(en, 120) + " " + say(de, 120)
    return docs_of(*rows, (500, junk, "en"), (501, mixed, "en"), (502, "short text", "en"), (503, say(en, 9) + " " + "a b c " * 60, "en"), (504, say(en, 150), None), (505, None, "en"), (None, say(de, 150), "de"))


def test_bands(docs_of):
    docs = corpus(docs_of)
    found = {r["doc_id"]: r for r in qr.quality(docs).collect()}
    assert not found[500]["base_failed"] and not found[500]["kept"]
    assert all(found[k]["kept"] for k in [*range(120), 501, 504, None])
    assert all(found[k]["base_failed"] and not found[k]["kept"] for k in (502, 503, 505))
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in found.items() if r["kept"]}


def test_copies_set_no_band(docs_of):
    """A text with many copies in a language with few other texts rejects none of them."""
    random = np.random.default_rng(5)
    words = ["".join(random.choice(list("abcdefghijklmnop"), random.integers(2, 8))) for _ in range(400)]
    say = lambda part: " ".join(random.choice(part, 900))
    copy = say(words[:15])
    own = [(i, say(words[: 40 + 12 * i]), "fi") for i in range(30)]
    docs = docs_of(*own, *[(100 + i, copy, "fi") for i in range(300)])
    found = {r["doc_id"]: r["kept"] for r in qr.quality(docs).collect()}
    assert all(found[i] for i in range(30))
    assert {r["doc_id"] for r in qr.keep_good(docs).collect()} == {k for k, kept in found.items() if kept}
    once, often = qr.fit_model(docs_of(*own, (100, copy, "fi"))), qr.fit_model(docs)
    assert (once.keys == often.keys).all() and (once.chances == often.chances).all()


def test_edges_and_empty(edges, docs_of):
    assert qr.quality(edges).count() == edges.count()
    assert qr.quality(docs_of()).count() == 0 and qr.keep_good(docs_of()).count() == 0


def test_letters_of_all_scripts():
    """Every letter beyond a to z, and every mark on letters, is a symbol of its own."""
    text = "\u0436\u0447\u4e2d\u56fd\u05d0\u0e01\u0e34\u0e35\u00e9"
    last = qr.symbols([text], own=True)[1] % qr.WIDE
    assert last.tolist() == [qr.LETTERS + ord(c) for c in text]
    # Capitals, digits, signs and white space are classes as before.
    assert (qr.symbols(["Ab 12,#\U0001f600"], own=True)[1] % qr.WIDE).tolist() == (qr.symbols(["Ab 12,#\U0001f600"])[1] % qr.SYMBOLS).tolist()


def test_letters_tell_texts_apart(docs_of):
    """Letters in disorder are junk, also if they are 17 apart (U+0430 and U+0441), so that they shared a number."""
    random = np.random.default_rng(7)
    words = ["".join(chr(0x430 + c) for c in random.integers(0, 8, random.integers(3, 8))) for _ in range(40)]
    say = lambda: " ".join(random.choice(words, 150))
    other = "".join(c if c == " " else chr(ord(c) + 17 * random.integers(0, 2)) for c in say())
    docs = docs_of(*[(i, say(), "ru") for i in range(60)], (100, other, "ru"))
    found = {r["doc_id"]: r["kept"] for r in qr.quality(docs).collect()}
    assert not found.pop(100) and all(found.values())
    assert {r["doc_id"] for r in qr.keep_good(docs).collect()} == set(found)


def test_every_language_has_its_model(docs_of):
    """However many languages there are, none shares the model of another one."""
    random = np.random.default_rng(11)
    rows = []
    for lang in range(70):
        words = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)]
        rows += [(10 * lang + i, " ".join(random.choice(words, 60)), f"l{lang:02d}") for i in range(4 if lang < 63 else 2)]
    docs = docs_of(*rows, (9000, " ".join(random.choice(list("abc"), 60)), None))
    model = qr.fit_model(docs)
    assert model.languages == ["", *[f"l{lang:02d}" for lang in range(70)]]
    alone = qr.fit_model(docs.filter("lang = 'l69'"))
    text = next(t for _, t, k in rows if k == "l69")
    mean = [m.log_perplexity([text], [m.languages.index("l69")])[0][0] for m in (model, alone)]
    assert abs(mean[0] - mean[1]) < 1e-9
    assert all(r["kept"] for r in qr.quality(docs).filter("doc_id < 9000").collect() if not r["base_failed"])


def test_counts_added_up():
    """A tally adds up what it has held and handed on."""
    random = np.random.default_rng(13)
    texts = ["".join(random.choice(list("abc \u4e2d\u0436"), 200)) for _ in range(30)] + ["  ", "\n"]
    tally = qr.Tally()
    for t in texts:
        tally.add("x", [t])
    tally.add("y", [" "])
    found = Counter()
    for batch in tally.rows():
        found.update(dict(zip(zip(batch["lang"].to_pylist(), batch["code"].to_pylist()), batch["n"].to_pylist())))
    assert found == Counter(("x", c) for t in texts for c in qr.symbols([t], own=True)[1].tolist())
    assert tally.size == 0
