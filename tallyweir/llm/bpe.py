"""Byte-level BPE by prefix-sharing trie traversal.

Every prefix of a word has one last token: the token that ends the prefix's encoding. It is the token
``t`` ending there for which the last token of what precedes ``t`` and ``t`` stay apart under the
merges. The distinct words of a slice form a trie; visiting it depth first carries the last tokens of
the path, so the encoding of a shared prefix is computed once. A word's tokens are read back from
its end.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import slices

# White space of Unicode, and the vocabulary's split of texts into words.
WHITE_RANGES = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WHITE = "".join(f"{chr(low)}-{chr(high)}" for low, high in WHITE_RANGES)
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
ID_BYTES = 4
SLICE_BYTES = 2 << 20
# Words whose encoding a worker keeps; beyond, those of the latest slice stay.
KEPT_WORDS = 200_000
# Pairs of tokens whose border a worker remembers; beyond, it starts anew.
KEPT_PAIRS = 500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by the byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, their ids, the merges by rank, and the special tokens."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in parsed["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.tokens = {i: token for token, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(parsed["model"]["merges"]):
            left, right = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.parts = {new: pair for pair, (_, new) in sorted(vocabulary.merges.items(), key=lambda m: -m[1][0])}
        # Tokens by their bytes from the last to the first; None holds the id.
        self.endings: dict = {}
        for token, i in vocabulary.ids.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[None] = i
        self.follows: dict[int, dict[int, bool]] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.own: dict[int, bool] = {}
        self.pairs = 0
        self.packed: dict[str, bytes] = {}

    def _merged(self, text: bytes) -> list[int]:
        """The merges applied one by one; only for a single token's bytes."""
        ids = [self.vocabulary.ids[text[i : i + 1]] for i in range(len(text))]
        while True:
            best = min(((*self.vocabulary.merges[pair], pair) for pair in zip(ids, ids[1:], strict=False)
                        if pair in self.vocabulary.merges), default=None)
            if best is None:
                return ids
            _, new, pair = best
            out, i = [], 0
            while i < len(ids):
                if tuple(ids[i : i + 2]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out

    def _alone(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token; any other is never used."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self._merged(self.vocabulary.tokens[token]) == [token]
        return known

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at a token's left (0) or right (1) edge while it is built: each piece, and the rank that ends it."""
        known = self.spines.get((token, side))
        if known is None:
            if token in self.parts:
                pair = self.parts[token]
                inner = self._spine(pair[side], side)
                known = [*inner[:-1], (inner[-1][0], self.vocabulary.merges[pair][0]), (token, float("inf"))]
            else:
                known = [(token, float("inf"))]
            self.spines[token, side] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two adjacent tokens comes before those that build them.

        Merges of one rank go from left to right: the left token's own before one across the border,
        and that before the right token's own.
        """
        self.pairs += 1
        if not (self._alone(left) and self._alone(right)):
            return False
        merges = self.vocabulary.merges
        lefts, rights = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = lefts[i], rights[j]
            across = merges.get((a, b))
            if across is not None and across[0] < a_ends and across[0] <= b_ends:
                return False
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1
            if i == len(lefts) or j == len(rights):
                return True

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word's token ids. Sorted words are the trie's paths in depth-first order."""
        tokens, endings, follows = self.vocabulary.tokens, self.endings, self.follows
        path, last = b"", [-1]
        for word in sorted(words):
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, start, found = endings, end, []
                while start:
                    node = node.get(word[start - 1])
                    if node is None:
                        break
                    start -= 1
                    if None in node:
                        found.append((start, node[None]))
                for start, token in reversed(found):
                    if start == 0:
                        known = self._alone(token)
                    else:
                        before = last[start]
                        known = follows.setdefault(before, {}).get(token)
                        if known is None:
                            known = follows[before][token] = self._apart(before, token)
                    if known:
                        last.append(token)
                        break
            path = word
            found, end = [], len(word)
            while end:
                found.append(last[end])
                end -= len(tokens[last[end]])
            yield word, found[::-1]

    def learn(self, words: set[str]) -> None:
        """Keep the packed ids of words not met before."""
        if len(self.packed) > KEPT_WORDS:
            self.packed = {w: self.packed[w] for w in words if w in self.packed}
        if self.pairs > KEPT_PAIRS:
            self.follows.clear()
            self.spines.clear()
            self.pairs = 0
        new = {w.encode(): w for w in words if w not in self.packed}
        for word, ids in self.encode_words(new):
            self.packed[new[word]] = b"".join(i.to_bytes(ID_BYTES, "little") for i in ids)


@lru_cache(maxsize=1)
def _vocabulary(definition: str) -> Vocabulary:
    return Vocabulary(definition)


@lru_cache(maxsize=1)
def _encoder(definition: str) -> TrieEncoder:
    """One for each Python worker: later tasks go on with the words it knows."""
    return TrieEncoder(_vocabulary(definition))


def _encoded(batches: Iterator[pa.RecordBatch], definition: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(definition)
    vocabulary = encoder.vocabulary
    split = regex.compile(WORDS).findall
    special = {s: i.to_bytes(ID_BYTES, "little") for s, i in vocabulary.special.items()}
    parts = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda text: [text]
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            pieces = [[p if p in special else split(p) for p in parts(text or "")] for text in rows.column("text").to_pylist()]
            encoder.learn({w for text in pieces for p in text if not isinstance(p, str) for w in p})
            get = encoder.packed.__getitem__
            ids = [
                b"".join(special[p] if isinstance(p, str) else b"".join(map(get, p)) for p in text)
                for text in pieces
            ]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(n) for n in rows.schema.names), pa.array(ids, pa.binary())],
                names=[*rows.schema.names, "ids"],
            )


def _decoded(batches: Iterator[pa.RecordBatch], definition: str) -> Iterator[pa.RecordBatch]:
    import numpy as np

    get = _vocabulary(definition).tokens.__getitem__
    for batch in batches:
        for rows in slices(batch, "ids"):
            texts = [
                None if ids is None else b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
                for ids in rows.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(n) for n in rows.schema.names), pa.array(texts, pa.string())],
                names=[*rows.schema.names, "decoded"],
            )


def _without(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    return (batch.drop_columns([column]) for batch in batches)


def _definition(df: DataFrame, vocabulary_path: str):
    """The vocabulary file, a few MB whatever the data, for the tasks."""
    with open(vocabulary_path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, text, ids``: the token ids, packed as little-endian unsigned 32-bit integers.

    Strings of special tokens become their ids. A null or empty text has no ids; a text of any length
    is encoded whole; repeated rows are encoded each. Other columns are ignored.
    """
    sent = _definition(docs, vocabulary_path)
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _encoded(batches, sent.value), "doc_id bigint, text string, ids binary"
    )


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, ids, decoded``: special tokens keep their strings; bytes that are no UTF-8 are replaced; null ids give null."""
    sent = _definition(encoded, vocabulary_path)
    return encoded.select("doc_id", "ids").mapInArrow(
        lambda batches: _decoded(batches, sent.value), "doc_id bigint, ids binary, decoded string"
    )


def encode_report(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``.

    A null text is empty and has no tokens, as an empty one. Repeated rows are encoded each, texts of any length
    whole; other columns are ignored, and an empty table gives none.
    """
    sent = _definition(docs, vocabulary_path)
    # Both ways in one pass: one Python worker a task instead of two.
    both = docs.select("doc_id", "text").mapInArrow(
        lambda batches: _without(_decoded(_encoded(batches, sent.value), sent.value), "text"),
        "doc_id bigint, ids binary, decoded string",
    )
    return both.select(
        "doc_id",
        (F.octet_length("ids") / ID_BYTES).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
