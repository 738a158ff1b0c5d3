"""Codes, packing and hard negatives against brute force."""

import json
import math
import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from tallyweir.llm import cover_tree, hard_negatives, packing, vector_codes
from tallyweir.llm.queries import tokenizer_path

VECTORS = "vec_id bigint, embedding array<double>, label int, score string, vector int"
NAN, INF = float("nan"), float("inf")


def odd_vectors(rng, count, dims):
    """Rows on a coarse grid, so that scores tie; copies, and rows that take no part."""
    rows = [(i, [rng.randint(-3, 3) / 4 for _ in range(dims)], rng.randint(0, 2), "x", 1) for i in range(count)]
    rows += [(count + i, rows[7][1], 1, "x", None) for i in range(40)]
    rows += [(900, None, 1, "x", 1), (901, [0.5] * (dims - 1) + [None], 1, "x", 1), (902, [NAN] * dims, 1, "x", 1),
             (903, [INF] * dims, 1, "x", 1), (904, [0.0] * dims, None, "x", 1), (905, [0.0] * dims, 2, "x", 1)]
    rng.shuffle(rows)
    return rows


def finite(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


# --- hard negatives ---------------------------------------------------------------------------


def mined(rows, anchors, low=80, high=100, n=5, k=5):
    kept = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and finite(v):
            row = (label, [math.floor(256 * x) for x in v])
            kept[i] = min(kept.get(i, row), row)
    out = []
    for a in anchors:
        if a not in kept:
            continue
        label, v = kept[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in kept.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:n]:
            fit = [(i, -t) for t, i, other in scored if other != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, rank, i, -s, t) for rank, (i, t) in enumerate(fit[:k], 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, frame):
    rows = odd_vectors(random.Random(1), 300, 12)
    rows += [(950, [0.25, 0.5], 1, "x", 1), (951, [0.25, 0.75], 1, "x", 1), (952, [0.25, 0.5], 2, "x", 1), (953, [], 1, "x", 1),
             (954, [], 1, "x", 1), (955, [], 2, "x", 1), (None, [0.25, 0.5], 1, "x", 1), (951, [0.75, 0.75], 0, "x", 1)]
    given = frame(VECTORS, *rows)
    anchors = [0, 3, 7, 301, 901, 904, 905, 950, 951, 953, 12345]
    asked = frame("vec_id bigint, label string", *((i, "z") for i in [*anchors, None, 0]))
    found = hard_negatives.mine(given, asked)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    wanted = mined(rows, anchors)
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 80
    wide = hard_negatives.mine(given, asked, n_positives=50, n_negatives=2, low=-50, high=300)
    assert sorted(map(tuple, wide.collect())) == mined(rows, anchors, -50, 300, 50, 2)
    assert hard_negatives.mine(given.limit(0), asked).count() == 0
    assert hard_negatives.mine(given, asked.limit(0)).count() == 0


def test_hard_negatives_of_large_components_stay_exact(spark, frame):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-9e4, 9e4) for _ in range(20)], i % 3, "x", 1) for i in range(200)]
    asked = frame("vec_id bigint", (0,), (1,))
    assert sorted(map(tuple, hard_negatives.mine(frame(VECTORS, *rows), asked).collect())) == mined(rows, [0, 1])
    huge = [(i, [x * 1e250 for x in v], label, "x", 1) for i, v, label, *_ in rows]
    assert hard_negatives.mine(frame(VECTORS, *huge), asked).count() <= 50


def test_vertical_scan_narrows_its_candidates():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 300, (10, 64)).astype(np.int64)
    labels = np.arange(4000) % 10
    vectors = centres[labels] + rng.normal(0, 40, (4000, 64)).astype(np.int64)
    block = hard_negatives.Columns(np.arange(4000), labels, vectors)
    read = []
    block.real = type("Counted", (np.ndarray,), {})(block.real.shape, buffer=block.real.copy())
    steps = hard_negatives._steps
    for dims, least, most in steps(vectors[0], block.low, block.high):
        read.append(most - least)
    assert all(a >= b for a, b in zip(read, read[1:], strict=False)) and read[-1] == 0
    ids, scores = hard_negatives.positives(block, 0, 0, vectors[0], 5)
    exact = sorted((-int(vectors[0] @ vectors[i]), i) for i in range(10, 4000, 10))[:5]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == exact


# --- codes ------------------------------------------------------------------------------------


def test_cover_tree_bounds_and_assignments():
    rng = np.random.default_rng(4)
    for n, dims in ((0, 3), (1, 3), (2000, 1), (3000, 4), (500, 16)):
        points = rng.integers(-40, 40, (n, dims))
        points[n // 2 :] = points[n // 2 : n // 2 + 1]
        tree = cover_tree.build(points)
        assert sorted(tree.order.tolist()) == list(range(n))
        for i in range(len(tree.start) if n else 0):
            own = points[tree.order[tree.start[i] : tree.end[i]]] - points[tree.centre[i]]
            assert len(own) and np.sqrt((own**2).sum(axis=1).max()) <= tree.radius[i] * (1 + 1e-12)
        assert cover_tree.Tree.unpacked(tree.packed()).radius.tolist() == tree.radius.tolist()
        book = rng.integers(-40, 40, (30, dims))
        book[20:25] = book[3:8]
        found = cover_tree.assign(points, tree, book)
        wanted = ((points[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1) if n else np.zeros(0, int)
        assert cover_tree.labels(tree, found).tolist() == wanted.tolist()
        counts, sums = cover_tree.totals(points, tree, found, 30)
        assert counts.tolist() == np.bincount(wanted, minlength=30).tolist()
        for e in range(30):
            assert sums[e].tolist() == points[wanted == e].sum(axis=0).tolist()


def test_subtrees_go_whole_where_rows_lie_together():
    rng = np.random.default_rng(5)
    centres = rng.integers(-5000, 5000, (20, 4))
    points = centres[rng.integers(0, 20, 5000)] + rng.integers(-9, 9, (5000, 4))
    tree = cover_tree.build(points)
    found = cover_tree.assign(points, tree, centres)
    assert len(found.row) < 100 and len(found.start) < 500


def coded(rows, entries=256, rounds=4, parts=4):
    kept = sorted(((math.inf if i is None else i, [math.floor(1024 * x) for x in v], i, label) for i, v, label, *_ in rows if finite(v)), key=lambda r: r[:2])
    dims = next((len(v) for _, v, *_ in kept if v and len(v) % parts == 0), parts)
    kept = [r for r in kept if len(r[1]) == dims]
    cut = [[tuple(r[1][p * dims // parts : (p + 1) * dims // parts]) for r in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(part, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(books[part]))

    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for part in range(parts):
            for v in cut[part]:
                groups[part][nearest(part, v)[1]].append(v)
        for part in range(parts):
            books[part] = [tuple(sum(x) // len(groups[part][i]) for x in zip(*groups[part][i], strict=True)) if i in groups[part] else e
                           for i, e in enumerate(books[part])]
    final = [[nearest(part, v) for part, v in enumerate(own)] for own in zip(*cut, strict=True)]
    errors = defaultdict(int)
    for r, f in zip(kept, final, strict=True):
        errors[r[3]] += sum(d for d, _ in f)
    return sorted(((r[2], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[r[3]]) for r, f in zip(kept, final, strict=True)), key=str), books


def test_codes_equal_brute_force(spark, frame):
    rows = odd_vectors(random.Random(6), 150, 8)
    rows += [(None, [0.25] * 8, 1, "x", 1), (None, [-0.25] * 8, None, "x", 1), (3, [0.75] * 8, 1, "x", 1), (960, [0.5] * 4, 1, "x", 1), (-1, [0.5] * 7, 1, "x", 1), (-2, [], 1, "x", 1)]
    for entries in (256, 16):
        wanted, books = coded(rows, entries)
        found = vector_codes.compress(frame(VECTORS, *rows), entries=entries).collect()
        assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=str) == wanted
        digest = {r.codebooks_sha256 for r in found}
        assert digest == {vector_codes.Codebooks([np.array(b) for b in books]).sha256()}
    assert vector_codes.compress(frame(VECTORS, *rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(frame(VECTORS, *rows), entries=257)


def test_codes_stand_for_their_entries(spark, frame):
    rows = odd_vectors(random.Random(7), 60, 8)
    forest = vector_codes.plant(frame(VECTORS, *rows))
    books = vector_codes.refine(forest)
    given = {r[0]: r[1] for r in rows}
    for r in vector_codes.decode(vector_codes.encode(forest, books), books).collect():
        off = sum((math.floor(1024 * x) - 1024 * y) ** 2 for x, y in zip(given[r.vec_id], r.embedding, strict=True))
        assert off == r.error


# --- packing ----------------------------------------------------------------------------------

DOCS = "doc_id bigint, source string, text string, ids string, start int"
TEXTS = ["", None, "one two", "a" * 3000, "Grüße, 中文 <|endoftext|> 🙂 " * 30, " " * 5000, "word " * 700, "x"]


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def reference_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 1]


def checked(docs, pieces, length=2048):
    """Each token in one piece, in order; sequences without a gap, full but for powers of two. Returns sources by sequence."""
    ids = {i: reference_ids(t) for i, _, t, *_ in docs}
    sources = {i: s for i, s, *_ in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        own = np.frombuffer(p.ids, "<u4").tolist()
        assert own == ids[p.doc_id][p.start : p.start + p.length]
    assert set(by_doc) == set(ids)
    for own in by_doc.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == own[0].doc_tokens
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    sizes, mixed = [], []
    for k in sorted(by_sequence):
        own = sorted(by_sequence[k], key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        sizes.append(sum(p.length for p in own))
        tokens = defaultdict(int)
        for p in own:
            tokens[sources[p.doc_id]] += p.length
        mixed.append(tokens)
    total = sum(map(len, ids.values()))
    assert sizes[: total // length] == [length] * (total // length)
    assert sizes[total // length :] == [1 << b for b in reversed(range(length.bit_length() - 1)) if total % length >> b & 1]
    return mixed


def worst_drift(mixed, shares, length=2048):
    had, worst = defaultdict(int), 0.0
    for k, own in enumerate(mixed, 1):
        for s in shares:
            had[s] += own[s]
            worst = max(worst, abs(had[s] - k * length * shares[s]))
    return worst


def test_packing_keeps_every_token_and_the_mixture(spark, frame):
    rng = random.Random(8)
    words = ["alpha", "beta ", "Γάμμα", "42", "\n", "délta", "'s"]
    docs = [(i, t, text, "x", 1) for i, (t, text) in enumerate((s, t) for s in ("a", None) for t in TEXTS)]
    docs += [(100 + i, rng.choice(["a", "a", "a", "b", "c"]), " ".join(rng.choices(words, k=rng.randint(0, 300))), "x", 1) for i in range(300)]
    pieces = packing.pack(frame(DOCS, *docs), tokenizer_path())
    mixed = checked(docs, pieces.collect())
    totals = defaultdict(int)
    for own in mixed:
        for s, n in own.items():
            totals[s] += n
    full = [m for m in mixed if sum(m.values()) == 2048]
    assert worst_drift(full, {s: n / sum(totals.values()) for s, n in totals.items()}) <= 2 * packing.LEAST_PIECE
    joined = packing.assemble(pieces).collect()
    assert len(joined) == len(mixed) and all(len(r.ids) == 4 * r.n_tokens for r in joined)


def test_packing_follows_targets_until_a_source_ends(spark, frame):
    docs = [(i, "ab"[i % 2], "word " * 50, "x", 1) for i in range(800)] + [(1000 + i, "c", "other " * 10, "x", 1) for i in range(100)]
    mixed = checked(docs, packing.pack(frame(DOCS, *docs), tokenizer_path(), {"a": 3, "b": 1, "absent": 5}, length=512, least=32).collect(), 512)
    tokens = 400 * len(reference_ids("word " * 50))
    both = mixed[: int(tokens / 0.75 / 512) - 1]
    assert len(both) > 40 and worst_drift(both, {"a": 0.75, "b": 0.25}, 512) <= 64
    assert all("c" not in m for m in mixed[: 2 * tokens // 512 - 1]) and sum(m["c"] for m in mixed) == 100 * len(reference_ids("other " * 10))


def test_packing_of_odd_tables(spark, frame):
    empty = frame(DOCS).limit(0)
    assert packing.pack(empty, tokenizer_path()).collect() == []
    copies = [(1, "a", "same text", "x", 1)] * 3
    assert sorted((p.doc_id, p.doc_tokens) for p in packing.pack(frame(DOCS, *copies), tokenizer_path()).collect() if p.start == 0) == [(1, 3)] * 3
    one = packing.pack(frame(DOCS, (None, None, None, None, None)), tokenizer_path()).collect()
    assert [(p.doc_id, p.length, zlib.crc32(bytes(p.ids))) for p in one] == [(None, 1, zlib.crc32(b"\x01\0\0\0"))]
    many = [(i, f"source{i}", f"text {i}", "x", 1) for i in range(500)]
    checked(many, packing.pack(frame(DOCS, *many), tokenizer_path(), length=64).collect(), 64)
    with pytest.raises(ValueError):
        packing.pack(empty, tokenizer_path(), length=1000)
    with pytest.raises(ValueError):
        packing.pack(empty, tokenizer_path(), {"a": 0})


def test_long_runs_of_white_space_go_to_the_vocabulary_files_library():
    with open(tokenizer_path()) as file:
        definition = file.read()
    own = packing.Encoder(definition)
    assert own.fast is not None
    text = "a" + " " * 1_000_000 + "b\n"
    found = own.encode(text)
    assert own.own is not None and found == reference_ids(text)[:-1]
    other = json.loads(definition)
    other["normalizer"] = {"type": "Lowercase"}
    slow = packing.Encoder(json.dumps(other))
    assert slow.fast is None and slow.encode("ABC def") == own.encode("abc def")
