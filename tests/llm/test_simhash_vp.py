import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ballotframe.llm import catalogue, components, shared, simhash_vp
from ballotframe.llm.simhash_vp import SimHashParams


def brute_print(text):
    words = shared.ascii_lower_words(text or "")
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    """(doc_id, fingerprint, component) by comparing all pairs."""
    prints = [(i, brute_print(t)) for i, t in rows]
    known = sorted({i for i, _ in prints if i is not None})
    parent = {i: i for i in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = [(i, p) for i, p in prints if i is not None]
    for a, p in some:
        for b, q in some:
            if (p ^ q).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((i, f"{p:016x}", None if i is None else root(i)) for i, p in prints), key=str)


def found(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in shared.table(spark, sf_dir, "documents").collect()]
    assert found(catalogue.op3_simhash_vp(spark, sf_dir)) == brute(rows)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 50_000]
    some = odd_docs.where("text IS NULL OR length(text) < 50000")
    assert found(simhash_vp.fingerprint_components(some)) == brute(rows)
    assert simhash_vp.fingerprint_components(odd_docs).count() == odd_docs.count()


def test_empty_table(make_docs):
    assert simhash_vp.fingerprint_components(make_docs([])).count() == 0


@pytest.mark.parametrize("params", [SimHashParams(leaf=4, chunk=10), SimHashParams(leaf=50, sample=64), SimHashParams(leaf=10, radius=5)])
def test_trees_find_all_close_pairs(spark, params):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 60)
    fps = {int(c) for c in centres}
    for c in centres[:30]:  # clusters, one of them large
        for _ in range(60 if c == centres[0] else 4):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.integers(0, 62, int(rng.integers(1, 6)))))
    points = sorted(fps)
    df = spark.createDataFrame([(0, p, n) for n, p in enumerate(points)], "print int, fp long, node long")
    stars = components.component_stars(simhash_vp.close_links(shared.stored(df), params))
    label = {r.a: r.b for r in stars.collect()}
    forest = simhash_vp.Forest(len(points))
    bits = np.array(points, np.int64).view(np.uint64)
    for k in range(len(points)):
        forest.join(k, np.flatnonzero(np.bitwise_count(bits ^ bits[k]) <= params.radius))
    least = {}
    for n, r in enumerate(forest.roots()):
        least.setdefault(r, n)
    assert [label.get(n, n) for n in range(len(points))] == [least[r] for r in forest.roots()]


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {(r.a, r.b) for r in components.component_stars(edges).collect()} == {(n, 0) for n in range(1, 200)}
    assert components.component_stars(edges.limit(0)).count() == 0


def test_one_of_each_keeps_smallest_ids(make_docs):
    text = " ".join(f"word{k}" for k in range(300))
    near = text.replace("word150", "other")
    docs = make_docs([(5, text), (2, near), (9, text), (9, text), (7, "something else entirely, with words of its own"), (None, text)])
    kept = simhash_vp.one_of_each(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 7, None] and kept.columns == docs.columns


def shingles(text, n=5):
    words = shared.ascii_lower_words(text or "")
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def test_texts_of_one_vocabulary_are_no_copies(make_docs):
    words = [f"word{k}" for k in range(300)]
    rows = [(k, " ".join(np.random.default_rng(k).permutation(words))) for k in range(6)]
    kept = simhash_vp.one_of_each(make_docs([*rows, (9, rows[3][1].replace("word150", "other"))]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("compared", [2_000_000, 6_000])
def test_checked_components_equal_brute_force(make_docs, compared):
    rng, rows = np.random.default_rng(5), []
    for family in range(4):
        base = [f"f{family}w{k}" for k in rng.integers(0, 200, 120 + 40 * family)]
        for edits in (0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 12):
            words = list(base)
            for at in rng.integers(0, len(words), edits):
                words[at] = f"edit{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base[: int(0.85 * len(base))])))
        rows.append((len(rows), " ".join(base[::-1])))
    params = SimHashParams(shingle=0, prints=1, radius=64, leaf=10**9, check=5, compared=compared)
    parent, sets = list(range(len(rows))), [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((parent[a], parent[b]))
                parent = [x if p == y else p for p in parent]
    got = {r.doc_id: r.component_id for r in simhash_vp.near_duplicates(make_docs(rows), params).collect()}
    assert len(set(parent)) > 8 and got == dict(enumerate(parent))


def test_one_row_of_each_component_is_kept_by_id_and_text(make_docs):
    """Rows that share an id are no copies: each unrelated text stays, whichever ids are null, repeated or smallest."""
    text = lambda seed: " ".join(f"{seed}word{k * 7919 % 997}" for k in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (1, text("a")), (3, text("c")), (3, text("c") + " more"), (4, text("d")),
            (4, text("d")), (None, text("a")), (5, None), (5, ""), (6, text("e")), (7, text("e"))]
    kept = simhash_vp.one_of_each(make_docs(rows)).collect()
    got = sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept)
    assert got == [(0, "aword"), (1, "aword"), (1, "bword"), (3, "cword"), (4, "dword"), (5, ""), (6, "eword")]
    assert simhash_vp.one_of_each(make_docs([])).count() == 0
