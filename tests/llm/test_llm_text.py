"""Tokens, languages, quality and benchmark windows against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.llm import bpe, decontaminate, language, quality
from tallyweir.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# --- BPE ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(3)
    letters = "abc 'sdtTHE\n\t\r\x1c\x85\xa0​0123½²日本語éüßñ!?.,<|endoftext|> �😀👍🏽\x00"
    texts = ["", "a", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", " " * 300, "a" * 700, "don't've we'll", "ab" * 20_000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (0, "")], DOCS)
    coded = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).collect()
    assert len(coded) == len(texts) + 2
    for row in coded:
        text = texts[row.doc_id] if row.doc_id >= 0 else ""
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == wanted
        assert row.decoded == library.decode(wanted, skip_special_tokens=False)


def test_bpe_report_and_broken_bytes(spark, frame):
    extra = frame("doc_id bigint, text string, ids string, decoded int", (1, "hello", "x", 1), (None, None, None, None))
    report = by_id(bpe.encode_report(extra, tokenizer_path()))
    assert report[None]["n_tokens"] == 0 and report[None]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert report[1]["decoded_sha256"] == hashlib.sha256(b"hello").hexdigest()
    halves = bpe.Vocabulary(open(tokenizer_path(), encoding="utf-8").read()).ids
    broken = np.array([halves[b"\xc3"], halves[b"a"]], "<u4").tobytes()
    ids = spark.createDataFrame([(1, bytearray(broken)), (2, None)], "doc_id bigint, ids binary")
    assert {r.doc_id: r.decoded for r in bpe.decode(ids, tokenizer_path()).collect()} == {1: "�a", 2: None}
    assert bpe.encode_report(frame(DOCS), tokenizer_path()).count() == 0


# --- benchmark windows -------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows(items, size=10):
    found = defaultdict(set)
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            found[tuple(own[i : i + size])].add(item)
    return found


def report_of(docs, items):
    needles, out = windows(items), []
    for doc, text in docs:
        own, hit, named = words(text), set(), set()
        for size in {len(n) for n in needles}:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in needles:
                    hit |= set(range(i, i + size))
                    named |= needles[tuple(own[i : i + size])]
        named -= {None}
        digest = hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(named), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_equals_brute_force(frame, block_bytes):
    rng = random.Random(5)
    pool = ["a", "b", "Cd", "é", "日本", "x1", "quick", "verylongword", "of", "The"]
    text = lambda n, sep=" ": sep.join(rng.choice(pool) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (30, "verylongword"), (4, text(10)), (5, None), (6, "?!"), (None, text(11)), (4, text(12))]
    docs = [(i, text(rng.randint(0, 60), rng.choice((" ", ", ", "\n"))) + (" " + t if rng.random() < 0.5 and t else ""))
            for i, (_, t) in enumerate(items * 6)]
    docs += [(900, None), (901, ""), (902, "!!"), (0, docs[0][1]), (None, items[0][1]), (903, text(30_000))]
    found = decontaminate.contamination_report(frame(DOCS, *docs), frame("item_id bigint, text string", *items), block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect()), key=str) == report_of(docs, items)


def test_clean_rows_keep_all_their_columns(frame):
    docs = frame(DOCS + ", spans string, items int, n_words double", (1, "one two three", "s", 4, 0.5), (2, "four", None, None, None), (3, None, "", 1, 1.0))
    kept = decontaminate.decontaminate(docs, frame("item_id bigint, text string", (1, "Two, THREE")))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "four", None, None, None), (3, None, "", 1, 1.0)]
    assert decontaminate.decontaminate(docs, frame("item_id bigint, text string")).count() == 3
    assert decontaminate.contamination_report(frame(DOCS), frame("item_id bigint, text string", (1, "x"))).count() == 0


# --- languages ---------------------------------------------------------------------------------


def test_best_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = rng.integers(0, 6, 4)
        scores = rng.normal(0, 3, (int(counts.sum()), 3)).astype(np.float32)
        labels = language.best_path(scores, counts, 2.0)
        at = 0
        for n in counts.tolist():
            own = scores[at : at + n].astype(float)
            def value(path):
                return sum(own[i][p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
            paths = [()]
            for _ in range(n):
                paths = [(*p, k) for p in paths for k in range(3)]
            assert value(labels[at : at + n].tolist()) == pytest.approx(max(map(value, paths)), abs=1e-4)
            at += n


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.with_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    assert found.where("score < 0 or score > 1").isEmpty()


def test_spans_scripts_and_texts_without_letters(spark, frame):
    labelled = frame("doc_id bigint, text string, lang string", *(
        (i, t, lang) for lang, t in (("en", "the house and the garden with them"), ("ru", "дом и сад и они там"), ("de", "das haus und der garten mit ihnen"))
        for i in range(20)
    ), (99, None, "xx"), (98, "nothing", None))
    model = language.train(labelled)
    assert model.languages == ["de", "en", "ru"]
    mixed = "the garden and the house with them 42 дом и сад"
    docs = frame("doc_id bigint, text string, score string, lang int", (1, mixed, "x", 1), (2, None, None, None), (3, "12 — !", None, 2), (4, "", None, 3), (1, mixed, "x", 1), (5, "日本語", None, 4), (None, "der garten", None, 1))
    found = language.identify(docs, model).collect()
    assert len(found) == 7
    rows = {r.doc_id: r for r in found}
    spans = [(mixed[s.start : s.end], s.lang) for s in rows[1].spans]
    assert spans == [("the garden and the house with them", "en"), ("дом и сад", "ru")]
    assert rows[1].lang_pred == "en" and 0.5 < rows[1].score < 1
    assert all((rows[i].lang_pred, rows[i].score, rows[i].spans) == ("und", 0.0, []) for i in (2, 3, 4))
    assert rows[5].lang_pred in model.languages and rows[None].lang_pred == "de"
    nothing = language.identify(docs, language.train(labelled.where("lang = 'none'"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.with_language(labelled.limit(0)).count() == 0


def test_few_texts_many_times_and_a_rare_language_are_learned(spark, frame):
    said = {"en": "the house and the garden", "de": "das haus und der garten", "fr": "la maison et le jardin", "es": "la casa y el campo"}
    cases = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(said.values()))
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(said))
    docs = spark.range(60_000).selectExpr("id AS doc_id", f"CASE id % 4 {cases} END AS text", f"CASE id % 4 {names} END AS lang")
    rare = frame("doc_id bigint, text string, lang string", (70_001, "дом и сад", "ru"), (70_002, "дом и сад", None), (70_004, "дом и сад", "ru"))
    docs = docs.unionByName(rare)
    model = language.train(docs)
    assert model.languages == sorted([*said, "ru"])
    found = language.with_language(docs, training_texts=3).join(docs, "doc_id").where("lang_pred <> coalesce(lang, 'ru')")
    assert found.count() == 0
    assert language.keep_identified(docs).count() == 60_003


def test_long_text_is_labelled_whole(spark, frame):
    labelled = frame("doc_id bigint, text string, lang string", *((i, t, n) for i in range(9) for n, t in (("en", "the house and the garden"), ("de", "das haus und der garten"))))
    text = "the house and the garden " * 20_000 + "das haus und der garten " * 30_000
    row = language.identify(frame("doc_id bigint, text string", (1, text)), language.train(labelled)).first()
    assert row.lang_pred == "de" and [s.lang for s in row.spans] == ["en", "de"] and row.spans[1].end == len(text) - 1


def test_identified_rows_keep_their_columns(spark, frame):
    docs = frame("doc_id bigint, text string, lang string, spans string", *((i, "the house and the garden", "en", "s") for i in range(30)), (70, "the house", None, None), (71, "17", "en", "s"), (72, None, None, None))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 31
    assert kept.where("doc_id = 70").first()["lang"] == "en"


# --- quality -----------------------------------------------------------------------------------


def kneser_ney(training, order=4):
    """log p(gram) by plain recursion over counts of padded texts."""
    top = Counter()
    for text in training:
        padded = "\0" * (order - 1) + text
        top.update(padded[i : i + order] for i in range(len(text)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discounts(table):
        n = Counter(table.values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        return {k: min(max(0.05, k - (k + 1) * y * n[k + 1] / max(n[k], 1)), k - 0.05) for k in (1, 2, 3)}

    d = {n: discounts(t) for n, t in counts.items()}

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        kept = same.get(gram, 0) - d[n][min(same[gram], 3)] if gram in same else 0
        return (kept + sum(d[n][min(c, 3)] for c in same.values()) * p(gram[1:])) / total
    return p


@pytest.mark.parametrize("block_grams", [1_000_000, 40])
def test_probabilities_equal_plain_kneser_ney(spark, frame, monkeypatch, block_grams):
    training = ["abab abc", "the theme", "aab"]
    others = ["abx the", "zzz", "", "😀é theab"]
    docs = frame("doc_id bigint, text string, lang string", *((i, t, "en") for i, t in enumerate(training + others)))
    rows = docs.withColumn("train", F.col("doc_id") < len(training))
    grams = rows.mapInArrow(quality._counted, "lang string, gram bigint, count bigint").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    found = by_id(quality.score(docs, quality.log_probabilities(grams), block_grams))
    p = kneser_ney(training)
    fold = lambda t: "".join(chr((ord(c) & 0xFFFF) ^ (ord(c) >> 16)) for c in t)
    for i, text in enumerate(training + others):
        padded = "\0\0\0" + fold(text)
        assert found[i]["log_p"] == pytest.approx(sum(math.log(p(padded[k : k + 4])) for k in range(len(text))), rel=1e-4, abs=1e-4)


def test_scores_are_joined_without_the_driver(spark, frame, monkeypatch):
    docs = frame("doc_id bigint, text string, lang string, part string", (1, "abab", "en", "x"), (1, "abab", "en", "x"), (2, "é😀", None, "x"), (None, None, "en", "x"),
                 (4, "", "fr", "x"), (5, "abab", "fr", "x"))
    grams = docs.selectExpr("text", "coalesce(lang, 'und') AS lang", "doc_id = 1 AS train").na.fill(False).mapInArrow(quality._counted, "lang string, gram bigint, count bigint")
    log_p = quality.log_probabilities(grams.groupBy("lang", "gram").agg(F.sum("count").alias("count")))

    def refuse(*_):
        raise AssertionError("a table goes through the driver")

    monkeypatch.setattr(type(docs), "toArrow", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    whole, dealt = (sorted(map(tuple, quality.score(docs, log_p, n).collect()), key=str) for n in (1000, 1))
    assert whole == dealt and [r[:3] for r in whole] == [(1, "en", 4), (1, "en", 4), (2, "und", 2), (4, "fr", 0), (5, "fr", 4), (None, "en", 0)]
    assert whole[0] == whole[1] and whole[0][3] < 0 and [r[3] for r in whole[2:]] == [0, 0, 0, 0]


def test_quality_keeps_trusted_text_and_drops_junk(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = quality.classify(docs, labels.where("quality = 1 AND toxic = 0")).join(labels, "doc_id")
    share = {r.quality: r.kept for r in judged.where("toxic = 0").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.25


def test_quality_of_odd_rows(frame):
    docs = frame("doc_id bigint, text string, lang string, keep int", *((i, "some plain text here", "en", 0) for i in range(12)), (50, None, "en", 1), (51, "", None, 1), (52, "text", None, 1), (None, "some plain text", "en", 1), (0, "some plain text here", "en", 0))
    found = quality.classify(docs, frame("doc_id bigint", *((i,) for i in range(12)), (None,)))
    rows = by_id(found)
    assert found.count() == 17 and rows[50]["keep"] is False and rows[50]["perplexity"] is None
    assert rows[51]["keep"] is False and rows[52]["keep"] is True and rows[52]["lang"] == "und"
    assert rows[0]["keep"] is True and rows[0]["perplexity"] > 1
    assert quality.classify(docs.limit(0), frame("doc_id bigint")).count() == 0
