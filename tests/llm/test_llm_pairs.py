"""Links, repeats and neighbours against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tallyweir.llm import ann, components, jaccard_join, suffix_dedup, suffix_sort

DOCS = "doc_id bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def shingles(text, size=4):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(own) >= size:
        return frozenset(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
    return frozenset([tuple(own)]) if own else frozenset()


def linked(docs, percent=85):
    """(doc_id, n_shingles, component_id) of every row."""
    sets = [(i, shingles(t)) for i, t in docs]
    groups = Union()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if None not in (i, j) and (i == j or (a and b and 100 * len(a & b) >= percent * len(a | b))):
                groups.join(i, j)
    return sorted(((i, len(s), None if i is None else groups.find(i)) for i, s in sets), key=str)


def near_copies(rng, count):
    """Texts in families of edited copies, long shared passages, and strangers."""
    pool = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(pool) for _ in range(40))
    docs = []
    for _ in range(count):
        base = [rng.choice(pool) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.choice((1, 1, 1, 3, 9))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(pool)
            docs.append(" ".join(copy).upper() if rng.random() < 0.1 else " \n".join(copy))
        if rng.random() < 0.3:
            docs.append(passage + " " + " ".join(rng.choice(pool) for _ in range(rng.randint(0, 9))))
    return list(enumerate(docs))


@pytest.mark.parametrize("long_list, block_bytes", [(32, 24 << 20), (2, 24 << 20), (1, 3000)])
def test_join_equals_brute_force(spark, frame, monkeypatch, long_list, block_bytes):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", block_bytes)
    docs = near_copies(random.Random(long_list), 60)
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "one"), (5, docs[5][1]), (None, docs[5][1])]
    found = jaccard_join.join(frame(DOCS + ", component_id int, digest string", *((*d, 1, "x") for d in docs)))
    assert sorted(map(tuple, found.collect()), key=str) == linked(docs)


def test_links_of_a_hub_grow_with_its_members_only():
    def held(role, doc, *shingles):
        return role, doc, 2, np.array(sorted(shingles), np.uint64)

    hub, member, visitor = jaccard_join.HUB, jaccard_join.MEMBER, jaccard_join.VISITOR
    family = [held(member, i, *range(100, 400), 1000 + i) for i in range(1, 601)]
    assert jaccard_join._compared((0, 1, 0), family, 85) == []
    # A family that its hub is no part of, and visitors that are part of it.
    found = jaccard_join._compared((0, 0, 0), [held(hub, 0, 100, 5, 6), *family], 85)
    assert [f for f in found if f[2]] == [(0, i, 301 * 8) for i in range(1, 601)]
    visits = jaccard_join._compared((0, 1, 0), [*family[:400], *(held(visitor, i, *s.tolist()) for _, i, _, s in family[400:])], 85)
    for links in ([f for f in found if not f[2]], visits):
        groups = Union()
        for a, b, _ in links:
            groups.join(a, b)
        assert len(links) == 599 and {groups.find(i) for i in range(1, 601)} == {1}


def test_blocks_that_all_join_the_hub_are_not_compared_again(frame, monkeypatch):
    edges = []
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(jaccard_join, "components", lambda e: edges.append(e.count()) or components.components(e))
    docs = [(i, " ".join(f"x{i}" if k == i else f"w{k}" for k in range(300))) for i in range(200)]
    found = jaccard_join.join(frame(DOCS, *docs))
    assert {r.component_id for r in found.collect()} == {0}
    assert edges[0] < 10 * len(docs)


def test_join_on_odd_tables(frame):
    assert jaccard_join.join(frame(DOCS)).count() == 0
    assert sorted(map(tuple, jaccard_join.join(frame(DOCS, (2, "a b c d e"), (2, "v w x y z"), (1, "v w x y z"))).collect())) == [
        (1, 2, 1), (2, 2, 1), (2, 2, 1)]
    long = " ".join(f"x{i}" for i in range(60_000))
    assert sorted(map(tuple, jaccard_join.join(frame(DOCS, (3, long), (1, long + " y"), (2, "z"))).collect())) == [
        (1, 59_998, 1), (2, 1, 2), (3, 59_997, 1)]


def test_one_document_of_each_group_stays_with_all_columns(frame):
    docs = frame(DOCS + ", row string, doc int", (2, "a b c d e", "r", 1), (1, "a b c d e", "s", 2), (3, None, None, None), (None, "a b c d e", "t", 3), (1, "a b c d e", "s", 2))
    kept = jaccard_join.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e", "s", 2), (3, None, None, None), (None, "a b c d e", "t", 3)], key=str)


def test_rows_that_can_have_a_key_and_those_that_cannot(spark, frame):
    from tallyweir.llm.common import least_by_hash, split_by_keys

    rows = spark.range(20_000).selectExpr("IF(id % 50 = 0, NULL, id * 7919) AS k", "'b' AS bitmap", "id AS bucket")
    keys = rows.where("bucket % 37 = 0 AND k IS NOT NULL").select("k")
    some, rest = split_by_keys(rows, "k", keys)
    assert some.columns == rest.columns == rows.columns
    assert some.count() + rest.count() == 20_000 and some.count() < 1_200
    assert rest.join(keys, "k").isEmpty() and some.join(keys, "k").count() == keys.count()
    assert split_by_keys(rows, "k", keys.limit(0))[1].count() == 20_000
    few = least_by_hash(rows.where("k IS NOT NULL"), 100, "k")
    assert few.count() == 100 and {r.k for r in few.collect()} == {
        r.k for r in rows.where("k IS NOT NULL").orderBy("k").selectExpr("k", f"pmod(xxhash64(k), {1 << 40}) AS h").orderBy("h", "k").limit(100).collect()}
    assert least_by_hash(rows.limit(5), 100, "bucket").count() == 5


def test_samples_hold_as_many_different_rows_as_asked(spark, frame):
    from tallyweir.llm.common import least_by_hash

    # A text in two thirds of the rows, many texts once, a few often, and a rare language.
    rows = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 2 = 0 THEN concat('t', id) ELSE concat('c', id % 4) END AS t",
        "CASE WHEN id % 3 > 0 OR id % 2 = 0 THEN 'en' WHEN id = 3 THEN 'rare' WHEN id % 4 = 1 THEN NULL ELSE 'de' END AS l", "1 AS _hash2")
    for asked in (1, 50, 5_000, 100_000):
        sample = least_by_hash(rows, asked, "t", "l", per="l").groupBy("l").count().collect()
        every = rows.distinct().groupBy("l").count().collect()
        assert {r.l: r["count"] for r in sample} == {r.l: min(asked, r["count"]) for r in every}
    assert least_by_hash(rows, 30, "t").count() == 30
    assert {r.t for r in least_by_hash(rows.where("t = 'hot'"), 30, "t").collect()} == {"hot"}
    assert least_by_hash(rows.limit(0), 30, "t", per="l").count() == 0


def test_components_of_chains_stars_and_loops(frame):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(60)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    groups = Union()
    for a, b in edges:
        if a is not None:
            groups.join(a, b)
    found = {r.node: r.component for r in components.components(frame("a bigint, b bigint", *edges)).collect()}
    assert found == {n: groups.find(n) for n in groups.parent if groups.find(n) != n}
    assert components.components(frame("a bigint, b bigint")).count() == 0


# --- suffixes ----------------------------------------------------------------------------------


def test_only_texts_with_a_common_window_are_sorted():
    rng = np.random.default_rng(3)
    texts = sorted({bytes(rng.choice(list(b"ab"), int(n)).tolist()) for n in rng.integers(9, 14, 60)})
    windows = [{t[i : i + 9] for i in range(len(t) - 8)} for t in texts]
    met = [i for i, own in enumerate(windows) if any(own & other for j, other in enumerate(windows) if j != i)]
    assert suffix_dedup._meeting(texts, 9).tolist() == met
    assert 0 < len(met) < len(texts)
    assert suffix_dedup._meeting([b"a" * 30], 9).tolist() == []


@pytest.mark.parametrize("memory", [10, 1 << 20])
def test_suffixes_and_common_prefixes(memory):
    rng = np.random.default_rng(memory)
    for round_ in range(150):
        letters = rng.integers(1, rng.integers(2, 7), rng.integers(1, 200))
        if round_ % 3 == 0:
            letters = np.tile(letters[: max(1, len(letters) // 7)], 7)
        letters = np.append(letters, 0).astype(np.uint16)
        text = letters.tolist()
        found = suffix_sort.sort_suffixes(letters, memory)
        order = found.suffixes.tolist()
        assert sorted(order) == list(range(len(text)))
        keys = [text[i : i + suffix_sort.DEPTH] for i in order]
        assert keys == sorted(keys)
        for a, b, common in zip(order, order[1:], found.common.tolist()[1:], strict=False):
            k = 0
            while k < suffix_sort.DEPTH and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert k == common


def trimmed(docs, length):
    first = {}
    rows = [(i, (t or "").encode()) for i, t in docs]
    for i, body in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(body) - length + 1):
            first.setdefault(body[k : k + length], i)
    out = []
    for i, body in rows:
        gone = bytearray(len(body))
        if i is not None:
            for k in range(len(body) - length + 1):
                if first[body[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 700, "anchor_bytes": 900, "shard_bytes": 500}])
def test_repeats_equal_brute_force(frame, sizes):
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abé \n") for _ in range(rng.randint(5, 40))) for _ in range(12)] + ["a" * 60, "ab" * 40]
    docs = [(i * 3 % 101, "".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(9)) for _ in range(rng.randint(0, 12)))) for i in range(90)]
    docs += [(200, None), (201, ""), (202, "short"), (203, docs[0][1]), (203, docs[0][1]), (203, docs[1][1] + "x"), (None, docs[0][1]), (None, docs[2][1])]
    found = suffix_dedup.report(frame(DOCS + ", part int, kept string", *((*d, 1, "k") for d in docs)), length=12, gram=5, **sizes)
    assert sorted(map(tuple, found.collect()), key=str) == trimmed(docs, 12)


def test_repeats_of_fifty_bytes_in_long_and_no_texts(frame):
    rng = random.Random(1)
    long = "".join(chr(rng.randrange(97, 123)) for _ in range(300_000))
    docs = [(1, long), (2, "start " + long[1000:1060] + " end " + long[-49:]), (3, long[:49]), (4, "q" * 50_000), (5, "q" * 70)]
    assert sorted(map(tuple, suffix_dedup.report(frame(DOCS, *docs)).collect()), key=str) == trimmed(docs, 50)
    assert suffix_dedup.report(frame(DOCS)).count() == 0


def test_repeats_longer_than_the_sorted_depth_are_an_error():
    with pytest.raises(ValueError, match="65 bytes"):
        suffix_dedup.remove_repeats(None, length=suffix_sort.DEPTH + 1)


def test_trimmed_texts_keep_their_columns(frame):
    passage = "an eminently repeatable passage of more than fifty bytes, é"
    docs = frame(DOCS + ", n_chars bigint, spans string", (1, passage, 59, "a"), (2, "new: " + passage + " end", 68, None), (3, passage, 59, "b"), (4, None, None, None), (5, "", 0, ""))
    kept = suffix_dedup.trim_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, passage, 59, "a"), (2, "new:  end", 9, None), (4, None, None, None), (5, "", 0, "")], key=str)


# --- neighbours --------------------------------------------------------------------------------


def nearest(vectors, queries, k):
    usable = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = set()
    for q, a in queries:
        if not usable(a) or q is None:
            continue
        best = defaultdict(lambda: np.inf)
        for i, b in vectors:
            if i is not None and i != q and usable(b) and len(a) == len(b):
                best[i] = min(best[i], float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())))
        for rank, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k], 1):
            out.add((q, rank, i, round(d, 9)))
    return out


VECTORS = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("block", [16_384, 2])
def test_neighbours_equal_brute_force_in_odd_tables(frame, block):
    rng = np.random.default_rng(3)
    near = lambda c: (np.array(c) + rng.normal(0, 0.2, len(c))).astype(np.float32).tolist()
    centres = rng.normal(0, 1, (4, 12))
    rows = [(i, near(centres[i % 4])) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(15)] + [(7, rows[7][1]), (300, None), (301, [0.0] * 12), (302, [float("nan")] * 12), (303, [None, 1.0] * 6),
             (304, [float("inf")] * 12), (305, []), (None, rows[0][1]), (306, [1.0, 2.0]), (307, [1.0, 3.0]), (308, [5.0])]
    vectors = frame(VECTORS + ", code int, dims string", *((*r, 1, "x") for r in rows))
    wanted = [i for i in range(0, 400, 7)] + [306, 308]
    found = ann.search(ann.build_index(vectors), vectors.where(vectors.vec_id.isin(wanted)), k=10, query_block=block)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found.collect()} == nearest(rows, [r for r in rows if r[0] in wanted], 10)


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = vectors.where("vec_id % 100 = 0")
    found = ann.search(ann.build_index(vectors), queries).collect()
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    truth = {(q, i) for q, _, i, _ in nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)}
    assert len({(r.query_id, r.vec_id) for r in found} & truth) >= 0.9 * len(truth)
    assert ann.search(ann.build_index(vectors.limit(0)), queries).count() == 0
    assert ann.search(ann.build_index(vectors), queries.limit(0)).count() == 0


def test_anchors_of_a_long_text_do_not_depend_on_the_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 101, n).astype(np.uint8) for n in (40, 5_000, 0, 49, 50, 3_000)]
    flat, offsets = np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))

    def windows():
        runs = suffix_dedup.anchor_runs(flat, offsets, 50, 16)
        return {(int(r), int(s) + k, int(h)) for h, r, s, n in zip(*runs, strict=True) for k in range(n)}

    whole = windows()
    assert len(whole) == sum(max(0, len(t) - 49) for t in texts)
    for piece in (64, 700, 1_024):
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", piece)
        assert windows() == whole
