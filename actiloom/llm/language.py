"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiloom.llm.encoder import release
from actiloom.llm.frames import pick, portions

GRAMS = 3
BITS = 14
#: About so many labelled texts are counted at most; a share of all, taken by a hash of id, text and language.
FIT_ROWS = 20_000
#: More languages than this are refused, so the broadcast matrix has a bound.
MOST_LANGUAGES = 512
SMOOTHING = 0.5
#: Grams that count as independent evidence in a score, however long the text.
EVIDENCE = 40
UNKNOWN = "und"
_GAP = " " * GRAMS
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_WORDY = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _WORDY.finditer(text))


def gram_counts(texts: list[str | None]):
    """Per text the buckets of its 1- to 3-grams that occur, and how often."""
    texts = [(text or "").lower() for text in texts]
    codes = np.frombuffer((_GAP.join(texts) + _GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - GRAMS
    buckets, total = [], np.zeros(n, np.uint32)
    for k in range(GRAMS):
        total = total + codes[k : k + n] * _FACTORS[k]
        buckets.append(((total ^ total >> np.uint32(15)) * np.uint32(0x2C1B3C6D + 2 * k)) >> np.uint32(32 - BITS))
    at = 0
    for text in texts:
        own = np.zeros(1 << BITS, np.int64)
        for each in buckets:
            own += np.bincount(each[at : at + len(text)], minlength=1 << BITS)
        found = np.flatnonzero(own)
        yield found, own[found]
        at += len(text) + GRAMS


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language, log probabilities
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the winner's share of evidence."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [k for k, text in enumerate(texts) if has_letter(text)] if self.languages else []
        if not known:
            return names, scores
        found = list(gram_counts([texts[k] for k in known]))
        first = np.cumsum([0] + [len(b) for b, _ in found[:-1]])
        buckets, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        sums = np.stack([np.add.reduceat(column[buckets] * counts, first) for column in self.weights.T], axis=1)
        grams = np.add.reduceat(counts, first)
        best = np.argmax(sums + self.prior, axis=1)
        logs = sums * (np.minimum(grams, EVIDENCE) / grams)[:, None] + self.prior
        logs = np.exp(logs - logs.max(axis=1, keepdims=True))
        scores[known] = logs[np.arange(len(best)), best] / logs.sum(axis=1)
        for k, b in zip(known, best.tolist(), strict=True):
            names[k] = self.languages[b]
        return names, scores


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Counts n-grams of the labelled texts (non-null ``text`` and ``lang``), of about ``rows`` of them at most.

    Rows that repeat one id, text and language count once, and the share is one of
    different rows, so that neither a repeated row nor a repeated id goes beyond the
    bound. What comes back to the driver is one count per language and bucket.
    """
    labelled = pick(docs, "doc_id", "text", "lang").filter("lang is not null and text is not null")
    labelled = labelled.withColumn("row", F.xxhash64("doc_id", "text", "lang"))
    count = labelled.select("row").distinct().count()
    if count > rows:
        labelled = labelled.filter(F.pmod("row", F.lit(1 << 32)) < int(rows / count * (1 << 32)))
    labelled = labelled.dropDuplicates(["row"]).select("text", "lang")

    def tally(batches):
        release()
        sums: dict[str, list] = {}
        for batch in portions(batches, "text"):
            for lang, (buckets, counts) in zip(batch["lang"].to_pylist(), gram_counts(batch["text"].to_pylist()), strict=True):
                held = sums.setdefault(lang, [0, np.zeros(1 << BITS, np.int64)])
                held[0] += 1
                held[1][buckets] += counts
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for lang, (texts, counts) in sums.items():
            found = np.flatnonzero(counts)
            n = len(found) + 1
            yield pa.record_batch(
                {
                    "lang": pa.array([lang] * n),
                    "bucket": pa.array(np.append(found, -1), pa.int64()),
                    "n": pa.array(np.append(counts[found], texts), pa.int64()),
                }
            )

    # The sample is bounded, and so is the number of tasks that tally it.
    tallied = labelled.repartition(8).mapInArrow(tally, "lang string, bucket long, n long")
    sums = tallied.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    column = {lang: k for k, lang in enumerate(languages)}
    weights, prior = np.full((1 << BITS, len(languages)), SMOOTHING), np.zeros(len(languages))
    table = sums.toArrow()
    for lang, bucket, n in zip(*(table[name].to_pylist() for name in ("lang", "bucket", "n")), strict=True):
        if bucket < 0:
            prior[column[lang]] = n
        else:
            weights[bucket, column[lang]] += n
    weights = np.log(weights / weights.sum(axis=0))
    return Model(languages, weights.astype(np.float32), np.log(prior / prior.sum()))


def held_out():
    """Whether a row is kept from teaching; null without a doc_id, and such rows do not teach either."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def identify(docs: DataFrame, training: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``lang_pred``, ``score``; learnt from ``training``.

    A null text or one without a letter is ``und`` with score 0, as is every text
    when nothing could be learnt. Equal texts get equal answers, ties the first
    language by name. Rows count each for itself, whatever their doc_id; an empty
    table gives no rows; other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training, rows))

    def predict(batches):
        release()
        for batch in portions(batches, "text", 2 << 20):
            names, scores = model.value.predict(batch["text"].to_pylist())
            yield pa.record_batch({"doc_id": batch["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    return pick(docs, "doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, training: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``docs``, all columns, without the rows whose language is unknown (``und``).

    With no language learnt none can be told from another: then only texts
    without a letter go.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training, rows))

    def keep(batches):
        release()
        for batch in portions(batches, "text", 2 << 20):
            texts = batch["text"].to_pylist()
            if model.value.languages:
                kept = [name != UNKNOWN for name in model.value.predict(texts)[0]]
            else:
                kept = [has_letter(text) for text in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
