import numpy as np
import xxhash
from conftest import SMALL
from llm.conftest import LONG
from pyspark.sql import functions as F

from riskweave.llm import bk_simhash as bk
from riskweave.llm import int8_join as ij


def fingerprint(text):
    """By the definition, bit by bit."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    ids = [min((rows[j][0] for j in range(len(rows)) if label[j] == x and rows[j][0] is not None), default=None) for x in label]
    return sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, ids, strict=True)), key=str)


def test_groups_by_brute_force(documents, prose):
    long = prose(0, 400)
    near = [long + " " + " ".join(prose(i, 3).split()[:1 + i % 3]) for i in range(40)]
    rows = [(i, prose(i)) for i in range(1, 20)] + [(100 + i, t) for i, t in enumerate(near)]
    rows += [(7, None), (200, ""), (201, " \n\t"), (None, prose(1)), (202, "One"), (203, "one"), (204, "two words"), (5, prose(5)), (205, LONG)]
    rows += [(300, "a\xa0b É c"), (301, "A\xa0B É C")]
    got = bk.near_duplicates(documents(rows), shard=4).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)
    assert bk.near_duplicates(documents([])).count() == 0


def test_one_of_each(documents, prose):
    rows = [(3, prose(1)), (2, prose(1)), (2, prose(1)), (4, prose(2)), (None, prose(3)), (None, prose(3)), (None, prose(4)), (9, None), (8, "")]
    kept = bk.one_of_each(documents(rows))
    assert kept.columns == documents([]).columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(
        [(2, prose(1)), (4, prose(2)), (None, prose(3)), (None, prose(4)), (8, "")], key=str)


def test_trees_find_all_within_the_radius():
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = np.unique([c ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))
                        for c in centres for a, b in draw.integers(0, 64, (30, 2))])
    shards = np.sort(draw.integers(0, 3, len(values)))
    query, node = bk.Forest(values, shards).search(values, shards, 3)
    want = {(i, j) for i in range(len(values)) for j in range(len(values))
            if shards[i] == shards[j] and int(values[i] ^ values[j]).bit_count() <= 3}
    assert set(zip(query.tolist(), node.tolist(), strict=True)) == want
    assert len(query) == len(want)
    empty = bk.Forest(values[:0], shards[:0])
    assert len(empty.search(values, shards, 3)[0]) == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(500, 400)], "a long, b long")
    stars, _ = bk.components(chain.repartition(4))
    assert {tuple(r) for r in stars.collect()} == {(i, 0) for i in range(1, 71)} | {(500, 400)}


def neighbours(rows, k=5):
    vectors = {i: np.array(v, float) for i, v in rows}
    out = []
    for q in sorted(i for i in vectors if i % 50 == 0):
        scored = sorted((-float(ij.cosines(vectors[q][None], v[None])[0]), i) for i, v in vectors.items()
                        if i != q and len(v) == len(vectors[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_neighbours_by_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    for options in ({}, {"tile_rows": 16, "query_rows": 2, "shards": 3, "block_bytes": 1024}):
        got = ij.nearest(table, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == neighbours(rows)


def test_neighbour_cases(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal(8)
    good = [(i, (base if i % 3 else draw.standard_normal(8)).tolist()) for i in range(120)]  # ties: two thirds are equal
    good += [(200, [1.0, 2.0]), (201, [2.0, 4.0])]
    bad = [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [float("inf")] + [1.0] * 7),
           (305, [None] + [1.0] * 7), (None, base.tolist())]
    table = spark.createDataFrame(good + bad + good[:5], "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    kept = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in good]
    got = ij.nearest(table, F.col("vec_id") % 50 == 0, tile_rows=7, shards=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == neighbours(kept)
    assert ij.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_components_of_any_size(spark):
    """Squares of finite doubles may overflow or vanish; the score is that of the same directions in a middle range."""
    draw = np.random.default_rng(6)
    base = draw.standard_normal((40, 6))
    sizes = 10.0 ** draw.choice([-290, -200, -160, 0, 160, 200, 290], 40)
    schema = "vec_id long, embedding array<double>"
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], schema)
    wide = spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(base, sizes, strict=True))], schema)
    got, want = (ij.nearest(t, F.col("vec_id") % 4 == 0, tile_rows=7).orderBy("query_id", "rank").collect() for t in (wide, plain))
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(r.query_id, r["rank"], r.vec_id) for r in want]
    assert all(abs(a.score - b.score) < 1e-12 for a, b in zip(got, want, strict=True)) and len(got) == 50
    extreme = spark.createDataFrame([(0, [1e308, 1e308]), (1, [5e-324, 5e-324]), (2, [-1e200, 1e200]), (3, [1.0, 0.0])], schema)
    told = {r.vec_id: r.score for r in ij.nearest(extreme, F.col("vec_id") == 0).collect()}
    assert abs(told[1] - 1) < 1e-12 and abs(told[2]) < 1e-12 and abs(told[3] - 0.5 ** 0.5) < 1e-12


def test_bounds_hold():
    draw = np.random.default_rng(2)
    a, b = draw.standard_normal((40, 32)), draw.standard_normal((60, 32)) * 10 ** draw.uniform(-3, 3, (60, 1))
    value, error = ij.tile(ij.Coded(a), ij.Coded(b))
    exact = np.array([ij.cosines(np.repeat(x[None], 60, 0), b) for x in a])
    assert (np.abs(value - exact) <= error).all() and error.max() < 0.05
