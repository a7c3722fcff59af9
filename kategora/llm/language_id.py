"""Language ID by a mixture of languages in every document.

A document is a bag of byte trigrams. Spark counts the trigrams of each language over all training
rows; a document's language shares are then found by expectation-maximisation, and the set of
languages by penalised likelihood. Trigrams are hashed to ``SLOTS`` numbers, so the model has
``SLOTS`` entries for each language whatever the input: that is the bound of what tasks are sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 16
MAX_LANGUAGES = 500
UNKNOWN = "und"
CHUNK = 1 << 18
# Each letter is part of three trigrams, so a text has about a third as many independent observations.
OVERLAP = 3.0
SMALLEST_SHARE = 0.01
SMOOTHING = 0.02

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def lowered(text: str | None) -> bytes:
    """Text as the model sees it: lower case; empty when it has no letter."""
    return text.lower().encode() if text and any(map(str.isalpha, text)) else b""


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``CHUNK`` bytes, with the place of the first; a longer text stands alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    yield first, texts[first:]


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(document, slot)`` of every trigram; words are set off by spaces, everything but letters is a space."""
    joined = np.frombuffer(b"".join(b"  " + t + b" " for t in texts), np.uint8)
    letters = _LETTER[joined]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    letters, doc = letters[keep].astype(np.uint32), doc[keep]
    code = (letters[:-2] << 16) | (letters[1:-1] << 8) | letters[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(16)
    same = doc[:-2] == doc[2:]
    return doc[:-2][same], slot[same]


@dataclass
class LanguageModel:
    """``chances[slot, language]``, scaled so that the best language of a slot has 1."""

    languages: list[str]
    chances: np.ndarray

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Language shares of each text, 0 for languages outside its set; all 0 for a text without trigrams."""
        n, k = len(texts), len(self.languages)
        result = np.zeros((n, k))
        doc, slot = trigrams(texts)
        if not len(doc) or not k:
            return result
        cells, count = np.unique(doc * SLOTS + slot, return_counts=True)
        doc, like = cells // SLOTS, self.chances[cells % SLOTS]
        there, begin = np.unique(doc, return_index=True)
        row = np.repeat(np.arange(len(there)), np.diff([*begin, len(doc)]))
        total = np.add.reduceat(count, begin).astype(float)
        share = self._fit(like, count, row, begin, total, np.full((len(there), k), 1 / k), 12)[0]
        result[there] = self._select(like, count, row, begin, total, share)
        return result

    @staticmethod
    def _fit(like, count, row, begin, total, share, rounds):
        """Expectation-maximisation: shares, and the log-likelihood they reach."""
        for _ in range(rounds):
            part = like * share[row]
            part *= (count / part.sum(1))[:, None]
            share = np.add.reduceat(part, begin) / total[:, None]
        return share, np.add.reduceat(count * np.log((like * share[row]).sum(1)), begin)

    def _select(self, like, count, row, begin, total, share):
        """Drop the weakest language as long as the penalised likelihood does not fall."""
        penalty = 0.5 * np.log(np.maximum(total / OVERLAP, 2))

        def pruned(share):
            share = np.where(share >= np.minimum(SMALLEST_SHARE, share.max(1, keepdims=True)), share, 0)
            return share / share.sum(1, keepdims=True)

        share, fit = self._fit(like, count, row, begin, total, pruned(share), 4)
        best, value = share.copy(), fit / OVERLAP - penalty * (share > 0).sum(1)
        todo = np.flatnonzero((share > 0).sum(1) > 1)
        while len(todo):
            mine = np.isin(row, todo)
            at = np.searchsorted(todo, row[mine])
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            trial = share[todo]
            weakest = np.where(trial > 0, trial, 2).argmin(1)
            trial[np.arange(len(todo)), weakest] = 0
            trial /= trial.sum(1, keepdims=True)
            trial, fit = self._fit(like[mine], count[mine], at, starts, total[todo], trial, 4)
            gain = fit / OVERLAP - penalty[todo] * (trial > 0).sum(1)
            share[todo] = trial
            better = gain >= value[todo]
            best[todo[better]], value[todo[better]] = trial[better], gain[better]
            todo = todo[(trial > 0).sum(1) > 1]
        return best


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Trigram chances per language from all rows that have a language and a letter.

    Tasks add up their trigrams before the shuffle, so at most ``SLOTS`` rows per language leave one.
    More than ``MAX_LANGUAGES`` languages raise an error. No usable row gives a model without languages.
    """
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if data := lowered(value):
                    by_lang.setdefault(name, []).append(data)
            for name, texts in by_lang.items():
                if len(sums) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                for _, part in chunks(texts):
                    found = np.bincount(trigrams(part)[1], minlength=SLOTS)
                    sums[name] = sums.get(name, 0) + found
        for name, total in sums.items():
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(total[slot], pa.int64())],
                ["lang", "slot", "n"],
            )

    counts = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = counts.limit(MAX_LANGUAGES * SLOTS + 1).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = np.zeros((SLOTS, len(languages)))
    column = np.searchsorted(languages, table.column("lang").to_pylist()) if languages else np.zeros(0, int)
    sums[table.column("slot").to_numpy(), column] = table.column("n").to_numpy()
    chances = (sums + SMOOTHING) / (sums.sum(0) + SMOOTHING * SLOTS)
    top = chances.max(1, keepdims=True) if languages else 1.0
    return LanguageModel(languages, np.maximum(chances / top, 1e-6).astype(np.float32))


def predict_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, shares``: the strongest language, its share, and all shares of the chosen set.

    A NULL text, or one without a letter, is ``und`` with score 0, as is every text when the model
    knows no language. NULL keys and repeated rows pass through; other columns are ignored; ties go
    to the language first in the alphabet. Texts are read whole.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = model.languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, all_shares = [], [], []
            for _, part in chunks([lowered(t) for t in batch.column("text").to_pylist()]):
                for share in model.shares(part):
                    best = int(share.argmax()) if len(names) else -1
                    known = best >= 0 and share[best] > 0
                    langs.append(names[best] if known else UNKNOWN)
                    scores.append(min(float(share[best]), 1.0) if known else 0.0)
                    all_shares.append([(names[i], float(share[i])) for i in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(all_shares, pa.map_(pa.string(), pa.float64())),
                ],
                ["key", "lang_pred", "score", "shares"],
            )

    schema = f"key {kind}, lang_pred string, score double, shares map<string,double>"
    return rows.mapInArrow(predict, schema).withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    """A third of the rows, by checksum of the key; never a row without a key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
