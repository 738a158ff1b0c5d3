"""Language identification of whole texts and of the spans of mixed ones.

Words are runs of letters. A word's script narrows the languages to those that training has seen in
it; hashed letter grams score the word under each; Viterbi with a penalty for every switch labels the
words. All words of a slice of texts are scored as arrays, and the texts are decoded side by side.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.llm.common import least_by_hash, release_memory, slices

UNDETERMINED = "und"
# Different labelled texts of each language that the model is counted on at most: those of smallest hash.
TRAINING_TEXTS = 2_000
BUCKETS = 1 << 16
SMOOTHING = 0.1
SWITCH_PENALTY = 12.0
# A language is a candidate in a script that holds at least this share of its training letters.
SCRIPT_SHARE = 0.001
SLICE_BYTES = 2 << 20
SCORED_LETTERS = 1 << 19

# First and last code point of the blocks of each script; all else is script 0.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "ethiopic": ((0x1200, 0x137F),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
}

# A language's counts: buckets of grams, and after them the scripts.
COUNTS = "lang string, place int, n double"
LABELLED = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-cased letter or 0, and its script's number. Marks belong to words."""
    lower = np.zeros(sys.maxunicode + 1, np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char)[0] in "LM":
            small = char.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), start=1):
        for first, last in ranges:
            script[first : last + 1] = number
    return lower, script


class Words(NamedTuple):
    """Words of several texts in one array of code points (0 outside words)."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    text: np.ndarray
    offsets: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    lower, script = letter_tables()
    # A line end on either side, so that no gram spans two texts.
    joined = "\n" + "\n\n".join(t or "" for t in texts) + "\n\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    offsets = 1 + np.concatenate(([0], np.cumsum(sizes + 2)[:-1])) if texts else np.zeros(0, np.int64)
    codes = lower[raw]
    inside = codes != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    return Words(codes, starts, ends, script[raw[starts]], np.searchsorted(offsets, starts, side="right") - 1, offsets)


def _buckets(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the three letters around each position, and of these with the next."""
    three = codes[at - 1].astype(np.uint64) * np.uint64(0x1F123BB5) + codes[at] * np.uint64(0x2545F491) + codes[at + 1]
    after = np.where(codes[at + 1] != 0, codes[np.minimum(at + 2, len(codes) - 1)], 0)
    mix = np.uint64(0x9E3779B97F4A7C15)
    four = (three * mix + after) * mix
    shift = np.uint64(64 - BUCKETS.bit_length() + 2)
    half = np.uint64(BUCKETS // 2)
    return ((three * mix) >> shift).astype(np.int64), ((four >> shift) + half).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of the grams and scripts of each language."""
    counted: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            for lang in pc.unique(rows.column("lang")).to_pylist():
                own = rows.filter(pc.equal(rows.column("lang"), lang))
                words = words_of(own.column("text").to_pylist())
                counts = counted.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1))
                for bucket in _buckets(words.codes, np.flatnonzero(words.codes)):
                    counts[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                counts[BUCKETS:] += np.bincount(words.script, words.ends - words.starts, minlength=len(SCRIPTS) + 1)
    for lang, counts in counted.items():
        used = np.flatnonzero(counts)
        # A language without any letters is one all the same.
        used = used if len(used) else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])],
            names=["lang", "place", "n"],
        )
    release_memory()


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # (bucket, language): log-probability
    allowed: np.ndarray  # (script, language)


def train(labelled: DataFrame, training_texts: int = TRAINING_TEXTS) -> Model:
    """Gram scores of every language of ``labelled`` (text, lang), from ``training_texts`` different texts of each.

    Rows without a text or language are left out, copies of a text count once, and a language with fewer
    texts gives all it has, however rare it is. Texts are counted where they lie, and only counts are added up:
    the driver gets 65,553 numbers a language at most. Without labelled rows there are no languages.
    """
    known = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sample = least_by_hash(known, training_texts, "text", "lang", per="lang")
    summed = sample.mapInArrow(_count, COUNTS).groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(pc.unique(summed.column("lang")).to_pylist())
    counts = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    column = pc.index_in(summed.column("lang"), pa.array(languages, pa.string())).to_numpy()
    counts[summed.column("place").to_numpy(), column] = summed.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    halves = grams.reshape(2, BUCKETS // 2, -1)
    share = (halves + SMOOTHING) / (halves.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS / 2)
    allowed = scripts >= np.maximum(scripts.sum(axis=0) * SCRIPT_SHARE, 1)
    # Words of a script that no language is written in are open to all.
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return Model(languages, np.log(share).reshape(BUCKETS, -1).astype(np.float32), allowed)


def _word_scores(words: Words, model: Model) -> np.ndarray:
    scores = np.zeros((len(words.starts), len(model.languages)), np.float32)
    step = max(1, SCORED_LETTERS // max(1, len(model.languages) // 4))
    sizes = words.ends - words.starts
    letters = np.concatenate(([0], np.cumsum(sizes)))
    first = 0
    while first < len(scores):
        last = max(first + 1, int(np.searchsorted(letters, letters[first] + step, side="right")) - 1)
        count = int(letters[last] - letters[first])
        at = np.repeat(words.starts[first:last] - (letters[first:last] - letters[first]), sizes[first:last]) + np.arange(count)
        three, four = _buckets(words.codes, at)
        scores[first:last] = np.add.reduceat(model.weights[three] + model.weights[four], letters[first:last] - letters[first], axis=0)
        first = last
    scores[~model.allowed[words.script]] = -1e6
    return scores


def best_path(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Label of each word, by Viterbi over each text's words; texts of ``counts`` words follow one another.

    Of two equal paths, the one that stays, and the language first in order.
    """
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    starts, ordered = starts[order], counts[order]
    longest = int(ordered[0]) if len(ordered) else 0
    active = np.searchsorted(-ordered, -np.arange(longest), side="left")
    stays = np.ones(scores.shape, bool)
    origin = np.zeros(len(scores), np.uint8 if scores.shape[1] <= 256 else np.uint16)
    labels = np.zeros(len(scores), np.int64)
    if not longest:
        return labels
    value = scores[starts[: active[0]]].astype(np.float64)
    final = np.zeros(len(counts), np.int64)
    for step in range(1, longest + 1):
        n = int(active[step]) if step < longest else 0
        if n < len(value):
            final[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        if not n:
            break
        at = starts[:n] + step
        came = value.argmax(axis=1)
        switched = value[np.arange(n), came][:, None] - penalty
        stays[at] = value >= switched
        origin[at] = came
        value = np.maximum(value, switched) + scores[at]
        value -= value.max(axis=1, keepdims=True)
    state = final
    for step in range(longest - 1, -1, -1):
        n = int(active[step])
        at = starts[:n] + step
        labels[at] = state[:n]
        state[:n] = np.where(stays[at, state[:n]], state[:n], origin[at])
    return labels


def _labelled(batches: Iterator[pa.RecordBatch], model: Model, penalty: float, keep_text: bool) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    names = np.array([*model.languages, UNDETERMINED], object)
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            count = rows.num_rows
            words = words_of(rows.column("text").to_pylist())
            chosen, share, spans = np.full(count, len(names) - 1), np.zeros(count), [[] for _ in range(count)]
            if model.languages and len(words.starts):
                labels = best_path(_word_scores(words, model), np.bincount(words.text, minlength=count), penalty)
                votes = np.zeros((count, len(model.languages)))
                np.add.at(votes, (words.text, labels), words.ends - words.starts)
                total = votes.sum(axis=1)
                known = total > 0
                chosen[known] = votes[known].argmax(axis=1)
                share[known] = votes[known].max(axis=1) / total[known]
                new = np.ones(len(labels), bool)
                new[1:] = (words.text[1:] != words.text[:-1]) | (labels[1:] != labels[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(labels)) - 1
                base = words.offsets[words.text[first]]
                for text, a, b, name in zip(words.text[first].tolist(), (words.starts[first] - base).tolist(),
                                            (words.ends[last] - base).tolist(), names[labels[first]].tolist(), strict=True):
                    spans[text].append({"start": a, "end": b, "lang": name})
            carried = [n for n in rows.schema.names if keep_text or n != "text"]
            del words
            yield pa.RecordBatch.from_arrays(
                [*map(rows.column, carried), pa.array(names[chosen].tolist(), pa.string()), pa.array(share), pa.array(spans, span)],
                names=[*carried, "lang_pred", "score", "spans"],
            )
    release_memory()


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *carry, lang_pred, score, spans`` of every row of ``docs``, from its whole text alone.

    ``spans`` are the runs of words of one language (code points, end exclusive); ``lang_pred`` has
    most letters, of equal ones the first by name, and ``score`` is its share of the letters. A null
    text, or one without letters, is ``und`` with score 0 and no spans, and so is every text if the
    model has no languages. Repeated rows are labelled each; other columns are ignored unless carried.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep_text = "text" in carry
    rows = docs.select("doc_id", "text", *(c for c in carry if c != "text"))
    schema = T.StructType([*(rows if keep_text else rows.drop("text")).schema, *T.StructType.fromDDL(LABELLED)])
    return rows.mapInArrow(lambda batches: _labelled(batches, sent.value, penalty, keep_text), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_language(docs: DataFrame, training_texts: int = TRAINING_TEXTS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans``; learned from the labelled rows that are not held out.

    Nulls, texts without letters, repeated rows and empty tables: as in ``train`` and ``identify``.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))), training_texts)
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, training_texts: int = TRAINING_TEXTS) -> DataFrame:
    """The rows of ``docs`` whose text is in a language, with all their columns; a null ``lang`` is filled in.

    Texts that are ``und`` go: null ones and those without letters. Repeated rows stay each, texts of any
    length are judged whole, and of a table without labelled texts nothing is left.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))), training_texts)
    # Columns of any name beside those of the method; the text itself goes to Python and back once.
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    found = identify(docs.select("doc_id", "text", others), model, carry=("text", "row"))
    found = found.where(F.col("lang_pred") != UNDETERMINED)
    own = {"lang": F.coalesce("row.lang", "lang_pred"), "text": F.col("text")}
    return found.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
