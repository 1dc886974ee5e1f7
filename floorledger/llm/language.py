"""Language identification with n-gram filters whose answers are bit masks of languages.

Training counts the letter trigrams of each language over all its documents.  Every trigram goes into the Bloom filters of
the languages that contain it; only what another language uses many times as often is taken there for a stray (a line of
English in a German text), so a trigram that one language has alone is in its filter however rare.  The filters of
all languages are stored bit-sliced: one word of bits per slot, a bit per language, so that two reads and an AND give all
languages that contain an n-gram.  A text's language is the one that holds most of its trigrams, after the hits that
its filter gives by chance are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.scratch import stored

# A trigram is a stray in a language where another one uses it so many times as often.
STRAY_RATIO = 20.0
# Slots per trigram of the language that has most: one lookup in 64 finds what is not there.  Beyond 2**24 slots (128 MB
# for 64 languages), which is a million different trigrams, it is more; what that adds to the counts is taken off.
SLOTS_PER_TRIGRAM, LEAST_SLOT_BITS, MOST_SLOT_BITS = 16, 16, 24
UNKNOWN = "und"
FOLDS = 5

_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 0, F.lit(False))


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each trigram of the lower-cased letters; any run of other characters is a blank.

    Words begin and end with a blank; trigrams that have it in the middle do not count.
    """
    parts = [np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), dtype="<u4") for text in texts]
    codes = np.concatenate(parts) if parts else np.empty(0, dtype="<u4")
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(part) for part in parts])
    codes = np.where(is_letter[codes], codes, 0).astype(np.uint64)
    middle = np.flatnonzero(codes[1:-1]) + 1
    mixed = codes[middle - 1] * _STEPS[0] + codes[middle] * _STEPS[1] + codes[middle + 1] * _STEPS[2]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _STEPS[0]
    mixed ^= mixed >> np.uint64(32)
    return owner[middle], mixed


def slots(hashes: np.ndarray, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each hash: its lowest and its highest bits."""
    last = np.uint64((1 << slot_bits) - 1)
    return (hashes & last).astype(np.int64), (hashes >> np.uint64(64 - slot_bits)).astype(np.int64)


@dataclass
class LanguageFilters:
    """``masks``: for each slot, 64 languages to a word.  ``chance``: of a trigram that a language lacks being found."""

    languages: list[str]
    slot_bits: int
    masks: np.ndarray
    chance: np.ndarray
    default: str


def _trigram_counts(training: DataFrame) -> DataFrame:
    """``lang, trigram, hits`` over all training texts."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in parts:
            langs = part.column(0).to_pylist()
            owner, hashes = trigrams(part.column(1).to_pylist(), is_letter)
            names = sorted(set(langs))
            of_text = np.array([names.index(lang) for lang in langs], dtype=np.int64)
            for number, lang in enumerate(names):
                new, n = np.unique(hashes[of_text[owner] == number], return_counts=True)
                before = known.get(lang, (new[:0], n[:0]))
                found, at = np.unique(np.concatenate([before[0], new]), return_inverse=True)
                known[lang] = found, np.bincount(at, weights=np.concatenate([before[1], n])).astype(np.int64)
        for lang, (found, hits) in known.items():
            columns = [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(hits)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "trigram", "hits"])

    rows = training.select("lang", "text").mapInArrow(count, "lang string, trigram long, hits long")
    return rows.groupBy("lang", "trigram").agg(F.sum("hits").alias("hits"))


def contained_trigrams(training: DataFrame, stray_ratio: float = STRAY_RATIO) -> tuple[DataFrame, dict[str, int]]:
    """``lang, trigram`` of all that a language contains, strays apart, and the number of trigrams of each language."""
    counts = stored(_trigram_counts(training.where(F.col("lang").isNotNull())))
    totals = counts.groupBy("lang").agg(F.sum("hits").alias("all"))
    sizes = {row["lang"]: row["all"] for row in totals.collect()}
    rates = counts.join(totals, "lang").withColumn("rate", F.col("hits") / F.col("all"))
    most = F.max("rate").over(Window.partitionBy("trigram"))
    return rates.withColumn("most", most).where(F.col("rate") * stray_ratio >= F.col("most")).select("lang", "trigram"), sizes


def learn_languages(training: DataFrame, stray_ratio: float = STRAY_RATIO) -> LanguageFilters:
    """From ``lang, text``; rows without a language do not count.

    All texts are counted where they lie.  What comes to the driver is bounded by the filter's size: the slots that
    are set, once per 64 languages.
    """
    contained, sizes = contained_trigrams(training, stray_ratio)
    contained = stored(contained)
    languages = sorted(sizes)
    widest = max((row["count"] for row in contained.groupBy("lang").count().collect()), default=1)
    slot_bits = min(max((SLOTS_PER_TRIGRAM * widest - 1).bit_length(), LEAST_SLOT_BITS), MOST_SLOT_BITS)

    numbers = contained.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string")
    ends = F.array(
        F.col("trigram").bitwiseAND((1 << slot_bits) - 1), F.shiftrightunsigned("trigram", 64 - slot_bits)
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % 64)
    numbered = contained.join(F.broadcast(numbers), "lang")  # a row per language
    placed = numbered.select(F.explode(ends).alias("slot"), F.floor(F.col("number") / 64).alias("word"), bit.alias("bit"))
    found = placed.groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    slot, word, bits = (found.column(name).to_numpy() for name in ("slot", "word", "bits"))
    masks = np.zeros((1 << slot_bits, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    masks[slot, word] = bits.astype(np.int64).view(np.uint64)
    full = [
        np.count_nonzero(masks[:, at // 64] >> np.uint64(at % 64) & np.uint64(1)) / (1 << slot_bits)
        for at in range(len(languages))
    ]
    default = max(languages, key=lambda lang: (sizes[lang], lang), default=UNKNOWN)
    return LanguageFilters(languages, slot_bits, masks, np.array(full) ** 2, default)


def judge(texts: list[str | None], filters: LanguageFilters, is_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the share of the best language in all corrected hits."""
    owner, hashes = trigrams(texts, is_letter)
    one, two = slots(hashes, filters.slot_bits)
    total = np.bincount(owner, minlength=len(texts))
    found = filters.masks[one] & filters.masks[two]
    hits = np.zeros((len(texts), max(1, len(filters.languages))))
    for at in range(len(filters.languages)):
        bit = (found[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)
        # What a text's trigrams would hit by chance is taken off, and the rest scaled up again.
        popcount = np.bincount(owner, weights=bit, minlength=len(texts))
        hits[:, at] = np.maximum(0, popcount - total * filters.chance[at]) / (1 - min(filters.chance[at], 0.99))
    best = hits.argmax(axis=1)
    most, sums = hits[np.arange(len(texts)), best], hits.sum(axis=1)
    score = np.divide(most, sums, out=np.zeros(len(texts)), where=sums > 0)
    names = [
        UNKNOWN if not n or not filters.languages else filters.languages[b] if m > 0 else filters.default
        for n, m, b in zip(total, most, best, strict=True)
    ]
    return names, np.clip(score, 0.0, 1.0)


def predict_languages(documents: DataFrame, filters: LanguageFilters) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    # Of the filter's bounded size.  Plain values, for workers need not have this library.
    plain = (filters.languages, filters.slot_bits, filters.masks, filters.chance, filters.default)
    shared = documents.sparkSession.sparkContext.broadcast(plain)

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, own = letters(), LanguageFilters(*shared.value)
        for part in parts:
            names, score = judge(part.column(2).to_pylist(), own, is_letter)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    doc_id = F.col("doc_id").cast("long")
    rows = documents.select(doc_id, held_out(doc_id).alias("held_out"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double"))


def identify_languages(documents: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and judges all of them, one row per row.

    A text that is null or has no letter is ``und`` with score 0, as is every text when nothing could be learned.
    Rows without a language or an id are not learned from; ties go to the language that sorts first.
    """
    doc_id = F.col("doc_id").cast("long")
    training = documents.where(in_training(doc_id)).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return predict_languages(documents, learn_languages(training))
