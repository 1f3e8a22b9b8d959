"""Sharding, the Merkle manifest and whitening, against brute force and laws, with the odd cases of each."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlab.llm import merkle, queries, sharding, whitening

# --- sharding


@pytest.mark.parametrize("good, bad, n", [(5, 9, 4), (10**10, 3 * 10**10, 10**6), (3 * 10**9, 10**9, 4 * 10**9 - 50)])
def test_hypergeometric_moments(good, bad, n):
    rng = np.random.default_rng(3)
    got = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(400)])
    p, total = good / (good + bad), good + bad
    sd = (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5
    assert abs(got.mean() - n * p) < 5 * sd / 20 and 0.8 < got.std() / sd < 1.2 and got.min() >= max(0, n - bad) and got.max() <= min(n, good)


def test_large_deals_keep_their_sums():
    room = np.array([4 * 10**8, 7 * 10**8, 0, 5 * 10**8, 9 * 10**8], np.int64)
    got = sharding.deal(np.random.default_rng(1), room, 10**9)
    assert got.sum() == 10**9 and (got <= room).all() and abs(got / room.clip(1) - 0.4)[[0, 1, 3, 4]].max() < 1e-3


def test_matrix_has_both_margins_and_the_law_of_a_permutation():
    sizes, room = np.array([5, 0, 7, 30, 1, 9]), np.array([20, 13, 0, 19])
    first = []
    for seed in range(600):
        matrix = sharding.Matrix(sizes, room, seed)
        rows = np.array([matrix.row(p) for p in range(len(sizes))])
        assert (rows.sum(1) == sizes).all() and (rows.sum(0) == room).all()
        first.append(rows[3, 0])
    p = 20 / 52
    var = 30 * p * (1 - p) * (52 - 30) / 51
    assert abs(np.mean(first) - 30 * p) < 5 * (var / 600) ** 0.5 and 0.8 < np.var(first) / var < 1.25
    labels = np.concatenate(list(sharding.Matrix(sizes, room, 1).labels(3)))
    assert (np.bincount(labels, minlength=4) == sharding.Matrix(sizes, room, 1).row(3)).all()


def check_shards(rows, n, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert [len(by.get(i, ())) for i in range(shards)] == [n // shards + (i < n % shards) for i in range(shards)]


@pytest.mark.parametrize("block_rows", [65536, 7])
def test_shuffle(spark, block_rows):
    rows = [(i if i % 9 else None, "same" if i % 3 else f"t{i}", i, i) for i in range(1000)]
    table = spark.createDataFrame(rows, "id long, text string, shard long, part long").repartition(5, "part")
    got = sharding.shuffle(table, 24, block_rows=block_rows)
    assert got.columns == ["id", "text", "part", "shard", "slot"]
    rows = got.collect()
    check_shards(rows, 1000, 24)
    assert sorted(r["part"] for r in rows) == list(range(1000))
    assert rows == sharding.shuffle(table, 24, block_rows=block_rows).collect()  # the same layout deals the same
    order = [r["part"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, np.arange(1000))[0, 1]) < 0.15
    other = [r["part"] for r in sorted(sharding.shuffle(table, 24, seed=5, block_rows=block_rows).collect(), key=lambda r: (r["shard"], r["slot"]))]
    assert other != order


def test_every_row_may_reach_every_shard(spark):
    table = spark.range(0, 40, 1, 4)
    seen = collections.Counter(r["shard"] for seed in range(25) for r in sharding.shuffle(table, 4, seed=seed).where("id = 3").collect())
    assert set(seen) == {0, 1, 2, 3}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_shuffle_of_few_rows(spark, n):
    check_shards(sharding.shuffle(spark.range(n)).collect(), n, 24)


def test_shards_on_disk(spark, tmp_path):
    placed = sharding.shuffle(spark.range(300).withColumn("text", F.lit(None).cast("string")), 4, block_rows=20)
    sharding.write_shards(placed, str(tmp_path / "out"))
    check_shards(spark.read.parquet(str(tmp_path / "out")).collect(), 300, 4)


def test_sharding_query(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_sharding(spark, str(tmp_path)).collect()
    check_shards(rows, docs.count(), 24)
    text = dict(texts)
    for r in rows:
        t = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "rows", None)


# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    """(root, siblings by level of every leaf, as (left, right))."""
    proofs, level = [[] for _ in leaves], leaves
    owner = [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, own = [], []
        for at in range(0, len(level), 8):
            run = level[at : at + 8]
            for place in range(len(run)):
                for i in owner[at + place]:
                    proofs[i].append(("".join(run[:place]), "".join(run[place + 1 :])))
            up.append(sha(*run))
            own.append(sum(owner[at : at + 8], []))
        level, owner = up, own
    return level[0], proofs


def brute_manifest(rows):
    """doc_id -> sorted (leaf, subroot, root, proof_sha256, folded_root, verified)."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r, r["text"]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by[x].sort(key=lambda t: t[:3])
        trees[x] = brute_tree([t[2] for t in by[x]])
    root, ups = brute_tree([trees[x][0] for x in langs])
    out = collections.defaultdict(list)
    for x, up in zip(langs, ups):
        for (_, _, leaf, r), proof in zip(by[x], trees[x][1]):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = brute_leaf(r, text)
            for left, right in proof + up:
                folded = sha(left, folded, right)
            out[r["doc_id"]].append((leaf, trees[x][0], root, sha(*(s for pair in proof + up for s in pair)), folded, folded == root))
    return {k: sorted(v) for k, v in out.items()}


def test_appended_leaves_have_whole_witnesses_at_any_length():
    for n in (1, 2, 7, 8, 9, 64, 65, 73, 513):
        leaves = [sha(str(i)) for i in range(n)]
        tree = merkle.Appender(merkle.levels_of(n))
        for i, x in enumerate(leaves):
            tree.append(x.encode())
            # A witness reaches as far as the complete subtrees around its leaf do.
            assert len(tree.places[0]) == 2 * sum(i + 1 >= 8**k for k in range(1, tree.levels + 1))
        tree.close()
        root, proofs = brute_tree(leaves)
        assert tree.root.decode() == root
        assert [s.decode() for s in tree.siblings] == ["".join(x for pair in p for x in pair) for p in proofs]
        assert all(merkle._fold_one(x, s.decode(), p.decode()) == root for x, s, p in zip(leaves, tree.siblings, tree.places))


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_witnesses_over_blocks(spark, depth):
    """Depth 1 climbs block roots four times; the large group's rows are a third of one id, and some are equal."""
    rows = [(None if i % 7 == 0 else "ab"[i % 2] if i % 5 else "b", 5 if i % 3 == 0 else i, sha(str(i // 2))) for i in range(700)] + [("lone", 1, sha("x"))]
    leaves = spark.createDataFrame(rows, "group string, id long, leaf string").repartition(6)
    got = merkle.witnesses(leaves, depth=depth).collect()
    by = collections.defaultdict(list)
    for g, i, x in rows:
        by[g].append((i, x))
    langs = sorted(by, key=lambda x: (x is not None, x or ""))
    roots = {x: brute_tree([leaf for _, leaf in sorted(by[x])]) for x in langs}
    root, ups = brute_tree([roots[x][0] for x in langs])
    want = sorted((i, leaf, roots[x][0], "".join(s for pair in p + up for s in pair)) for x, up in zip(langs, ups) for (i, leaf), p in zip(sorted(by[x]), roots[x][1]))
    assert sorted((r["id"], r["leaf"], r["subroot"], r["siblings"]) for r in got) == want
    assert {r["root"] for r in got} == {root} and all(merkle._fold_one(r["leaf"], r["siblings"], r["places"]) == root for r in got)


def test_merkle_query(spark, docs, tmp_path):
    nulls = spark.createDataFrame([(None, "Null id", None, "s", 7, 1, "k", 1), (900, "A", None, None, None, 1, "k", 1), (901, None, "zz", "s", 0, 1, "k", 1), (903, "B" * 30000, "zz", "s", 0, 1, "k", 1)], docs.schema)
    both = docs.unionByName(nulls)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.defaultdict(list)
    for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == brute_manifest(both.collect())


def test_manifest_of_nothing(no_docs):
    assert merkle.manifest(no_docs).count() == 0


# --- whitening


def brute_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)) + 100000
    n = len(x)
    total = [int(sum(col)) for col in x.T.astype(int).tolist()]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
    centred = x - np.array(total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    axes = axes[:, ::-1][:, :k]
    return deviation, np.abs(centred @ axes / np.sqrt(values[::-1][:k])), values[::-1][:k] / values.sum()


def check_whitening(got, ids, vectors, k=8):
    deviation, whitened, explained = brute_whitening(vectors, k)
    rows = collections.defaultdict(dict)
    for r in got:
        rows[r["vec_id"]][r["component"]] = r
    assert len(got) == len(ids) * k
    for i, d, w in zip(ids, deviation, whitened):
        assert [int(rows[i][c]["deviation"]) for c in range(1, k + 1)] == [d] * k
        assert np.allclose([abs(rows[i][c]["whitened"]) for c in range(1, k + 1)], w, rtol=1e-8, atol=1e-8)
        assert np.allclose([rows[i][c]["explained"] for c in range(1, k + 1)], explained, rtol=1e-9)
        assert rows[i][1]["identity_error"] < 1e-10 and rows[i][1]["n"] == len(ids)


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(2)
    for d, rank in ((1, 1), (7, 7), (12, 5), (33, 20)):
        g = rng.normal(size=(d, rank)) * 10.0 ** -np.arange(rank)[None, :].clip(0, 6)
        a = g @ g.T
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape[1] <= d and np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-12 * a.max())
        norms, turned = whitening.one_sided_jacobi(factor)
        assert np.allclose(turned.T @ turned, np.eye(len(norms)), atol=1e-10) and (np.diff(norms) <= 0).all()
        assert np.allclose(norms, np.linalg.eigvalsh(a)[::-1][: len(norms)], rtol=1e-6, atol=1e-12 * a.max())
    assert whitening.pivoted_cholesky(np.zeros((3, 3)))[0].shape == (3, 0)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    good = (rng.normal(size=(300, 12)) * np.linspace(0.05, 0.4, 12) + rng.normal(size=12)).astype(np.float32).tolist()
    good += [good[0]] * 150  # a third of all rows are copies
    rows = [(i, v, 1.0) for i, v in enumerate(good)] + [(1000, None, 1.0), (1001, [None] + good[0][1:], 1.0), (1002, [float("nan")] + good[0][1:], 1.0), (1003, [float("-inf")] + good[0][1:], 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double").repartition(5)
    check_whitening(whitening.whiten(table).collect(), list(range(450)), good)


def test_whitening_of_short_vectors_and_large_sums(spark):
    rng = np.random.default_rng(5)
    full = (rng.normal(size=(80, 4)) * 1e7).tolist()
    rows = [(i, v[: 1 + i % 4]) for i, v in enumerate(full)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    check_whitening(whitening.whiten(table, 3).collect(), list(range(80)), [v[: 1 + i % 4] + [0.0] * (3 - i % 4) for i, v in enumerate(full)], 3)
    with pytest.raises(Exception, match="too large"):
        whitening.fit(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("rows, components", [([], 0), ([(1, [0.5, 0.25])], 0), ([(1, [])], 0), ([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (None, [3.0, 1.0]), (2, [1.0, 1.0])], 1)])
def test_whitening_without_variance(spark, rows, components):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == components * len(rows) and all(abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in got)


def test_whitening_query(spark, tmp_path):
    vectors = np.random.default_rng(6).normal(size=(60, 10)).astype(np.float32).tolist()
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_embedding_whitening(spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check_whitening(got.collect(), list(range(60)), vectors)
