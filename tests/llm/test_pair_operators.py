import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import caps, common, jaccard, queries, topk


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 90)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (70, 2))] + [(300, k) for k in range(301, 360)] + [(5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(edges, {x for e in edges for x in e if e[0] != e[1]})
    assert got == want and common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- word n-grams ------------------------------------------------------------


def brute(rows):
    sets = [(r.doc_id, jaccard.shingles(r.text)) for r in rows]
    links = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                links.append((a, b))
    return {d: len(x) for d, x in sets}, groups(links, {d for d, _ in sets})


def test_jaccard(docs, empty):
    got = jaccard.join(docs).collect()
    size, component = brute(docs.collect())
    assert len(got) == docs.count()
    assert {r.doc_id: r.n_shingles for r in got} == size and {r.doc_id: r.component_id for r in got} == component
    assert jaccard.join(empty).count() == 0 and jaccard.keep_one(docs).columns == docs.columns
    clash = docs.withColumns({"gone": F.lit(1), "component_id": F.lit(2)})
    kept = jaccard.keep_one(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {d for d, c in component.items() if d == c}


def test_jaccard_chains_and_shared_passages(spark):
    """Groups that only pairs away from the smallest document hold together, and one passage in all texts."""
    rng = np.random.default_rng(1)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 10**9, k)]
    texts, shared = [], word(60)
    for _ in range(12):
        own = word(150)
        for step in range(6):
            own = own[:] if not step else own[:-8] + word(8) if step % 2 else word(8) + own[8:]
            texts.append(" ".join(own))
    texts += [" ".join(shared + word(int(n))) for n in rng.integers(1, 60, 60)]
    texts += [" ".join(word(int(n))) for n in rng.integers(1, 12, 60)] + ["a b c", "A  b\tC", "a b"]
    df = spark.createDataFrame([(len(texts) - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    _, component = brute(df.collect())
    assert {r.doc_id: r.component_id for r in jaccard.join(df).collect()} == component


@pytest.mark.parametrize("large", [64, 4096])
def test_jaccard_where_a_passage_is_in_all_texts(spark, large):
    """Texts that share a passage, and near copies among them: by tiles, and by the
    allocation for frequent keys with its rest in many tiles."""
    rng = np.random.default_rng(3)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 10**9, k)]
    shared, texts = word(40), []
    for n in rng.integers(8, 120, 330).tolist():
        own = shared + word(n)
        texts.append(" ".join(own))
        if rng.random() < 0.3:
            for _ in range(int(rng.integers(1, 4))):
                copy = list(own)
                for at in rng.integers(0, len(copy), int(rng.integers(1, 1 + len(copy) // 30 + 1))):
                    copy[at] = word(1)[0]
                texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _, component = brute(df.collect())
    assert len(set(component.values())) < len(texts) - 40
    assert {r.doc_id: r.component_id for r in jaccard.join(df, large=large).collect()} == component


@pytest.mark.parametrize("rounds", [1, 3])
def test_jaccard_in_any_number_of_rounds(docs, rounds):
    want = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, rounds=rounds).collect()} == want


def test_keys_of_the_rounds_are_all_keys_once(spark):
    """Each round moves about its share of what one round moves, and documents move in the first."""
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 999, 120))) for i in range(150)], "doc_id long, text string")

    def dealt(turn, rounds):
        rows = jaccard._dealt(docs.repartition(1), 5, 80, 4, turn, rounds).collect()
        keys = [k for r in rows if r.keys for k in np.frombuffer(r.keys, np.int64).tolist()]
        return sorted(keys), sum(r.n is not None for r in rows), sum(len(r.keys) for r in rows if r.keys)

    whole, some = dealt(0, 1), [dealt(i, jaccard.ROUNDS) for i in range(jaccard.ROUNDS)]
    assert sorted(k for s in some for k in s[0]) == whole[0] and [s[1] for s in some] == [150] + [0] * (jaccard.ROUNDS - 1)
    assert max(s[2] for s in some) < 0.6 * whole[2]


def test_rough_histograms_part_no_linked_sets():
    rng = np.random.default_rng(6)
    for n in (1, 3, 40, 300, 512, 513, 700, 3000):
        far = jaccard.rough_histogram(jaccard.histogram(rng.integers(0, 1 << 64, n, np.uint64)), n)
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            y = np.unique(np.concatenate([x[rng.random(n) > 0.1 * rng.random()], rng.integers(0, 1 << 64, n // 9, np.uint64)]))
            a, b = (jaccard.rough_histogram(jaccard.histogram(h), len(h)) for h in (x, y))
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
                assert jaccard.may_link(a, b, len(x), len(y), 80)
            if n in (300, 512, 700):
                assert not jaccard.may_link(a, far, len(x), n, 80)


def test_frequent_keys_are_skipped_within_their_bound():
    """Of linked sets that share skipped subsets only, those whose bound holds meet by a deletion."""
    rng = np.random.default_rng(5)
    tried = met = 0
    for _ in range(600):
        n = int(rng.integers(20, 300))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        a = np.unique(pool[:n])
        k = max(2, len(a) // 5)
        b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), k // 2, replace=False)), pool[n : n + k - k // 2]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        (ka, da), (kb, db) = jaccard.keys(a), jaccard.keys(b)
        same = np.intersect1d(ka[~da], kb[~db])
        k, f, owner, room = jaccard.near_keys([a, b], same)
        whole, gone = [set(k[(owner == i) & (f & 3 == 0)].tolist()) for i in (0, 1)], [set(k[(owner == i) & (f & 1 > 0)].tolist()) for i in (0, 1)]
        found = bool(whole[0] & gone[1] or whole[1] & gone[0])
        bands = [int(np.searchsorted(jaccard.bands(), len(x))) for x in (a, b)]
        high = max(bands)  # the band in which the pair is due
        if max(room[0][high - bands[0]], room[1][high - bands[1]]) >= 0:
            tried += 1
            met += found
    assert tried > 50 and met == tried


def test_keys_find_all_near_sets():
    rng = np.random.default_rng(2)
    missed = tried = 0
    for _ in range(1500):
        n = int(rng.integers(5, 300))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        a = np.unique(pool[:n])
        k = int(rng.integers(0, n // 4 + 2))
        b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), min(k // 2, len(a) - 1), replace=False)), pool[n : n + k - k // 2]]))
        both = len(np.intersect1d(a, b))
        union = len(a) + len(b) - both
        if both == union or 100 * both < 80 * union:
            continue
        (ka, da), (kb, db) = jaccard.keys(a), jaccard.keys(b)
        tried += 1
        missed += not (set(ka[~da]) & set(kb) or set(kb[~db]) & set(ka))
        assert jaccard.may_link(jaccard.histogram(a), jaccard.histogram(b), len(a), len(b), 80)
    assert tried > 300 and not missed


# --- vectors -----------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 32))
    x[200:400] = x[0] + 0.1 * rng.standard_normal((200, 32))
    x[400:450] = x[1]
    x[450:500] = x[2:52] + 0.18 * rng.standard_normal((50, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls int").repartition(4).cache(), dict((r[0], r[1]) for r in rows)


def test_caps(vectors):
    df, own = vectors
    got = {r.vec_id: r for r in caps.link(df, per_filter=40, tile=64).collect()}
    good = {i: np.array(v) for i, v in own.items() if i < 1000} | {1006: np.array(own[1006]), 1007: np.array(own[1007])}
    links = [(a, b) for a, x in good.items() for b, y in good.items() if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9]
    degree = dict.fromkeys(own, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(got) == len(own) and all(r.n_links <= degree[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(degree.values())
    assert got[400].component_id == 1 and got[1007].component_id == 1006 and got[1000].n_links == 0 and got[1002].kept
    want = groups(links, own)
    assert np.mean([got[i].component_id == want[i] for i in own]) > 0.98
    assert caps.link(df.limit(0)).count() == 0


def test_caps_decode_finds_all_filters():
    code = caps.ProductCode(24, 9, 12)
    x = np.random.default_rng(0).standard_normal((40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b, c = code.products(x)
    every = a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]
    for i, found in enumerate(code.decode(x)):
        want = np.nonzero(every[i].reshape(-1) >= code.threshold)[0]
        assert set(want) <= set(found) and (len(want) == len(found) or len(want) == 0)


@pytest.mark.parametrize("n", [2_000, 10_000, 51_282, 1_000_000, 3_000_000])
def test_caps_recall_holds_at_every_size(n):
    code = caps.code_for(64, n, 0.9)
    got = [code.recall(c, trials=1500, seed=3) for c in (0.9, 0.95, 0.99)]
    assert min(got) >= 0.99 and (n > caps.LISTS * caps.PER_FILTER or min(got) == 1)
    assert len({len(f) for f in code.best(np.eye(64))}) == 1


def test_caps_best_filters():
    code = caps.ProductCode(24, 9, 12)
    x = np.random.default_rng(0).standard_normal((40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b, c = code.products(x)
    every = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(40, -1)
    assert (code.best(x) == np.sort(np.argsort(-every, axis=1)[:, :12], axis=1)).all() and code.best(x[:0]).shape == (0, 12)


def test_caps_links_at_the_threshold(spark):
    """Pairs barely over the threshold, found by filters and, as few rows, without any."""
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.902 * x + np.sqrt(1 - 0.902**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    whole = {r.vec_id: r for r in caps.link(df).collect()}
    assert all(r.n_links == 1 and r.component_id == r.vec_id % 1500 for r in whole.values())
    some = caps.link(df, per_filter=20).collect()
    assert sum(r.n_links for r in some) >= 0.99 * 3000 and all(r.n_links <= 1 for r in some)


def test_topk(vectors):
    df, own = vectors
    got = {}
    for r in topk.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in own.items() if v and None not in v and np.isfinite(v).all()}
    for q in [i for i in good if i % 50 == 0]:
        scores = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q and len(x) == len(good[q]))[:5]
        assert sorted(got.pop(q, [])) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert not got and topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_on_repeated_rows(spark, tmp_path):
    """Rows that share an id, equal and different, as candidates and as queries: what SQL gives."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    rows += rows[3:6] * 2 + [(i % 60, rng.standard_normal(8).tolist()) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.op2_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.ORACLE_SQL["op2_topk"]).project("query_id, rank, vec_id, score").fetchall())


def test_topk_bounds_hold():
    rng = np.random.default_rng(3)
    q, x = rng.integers(-300, 300, (20, 30)).astype(float), rng.integers(-300, 300, (50, 30)).astype(float)
    bounds = [topk.features(q, s) @ topk.features(x, s).T for s in (1, 4, 16, 64)]
    assert (bounds[0] >= q @ x.T - 1e-6).all() and all((a >= b - 1e-6).all() for a, b in zip(bounds[:1] * 3, bounds[1:], strict=True))
    big = np.full((1, 4), 2.0**30)
    assert topk.exact(big, big)[0, 0] == 4 * 2**60


@pytest.mark.parametrize("n", [500, 2_000, 10_000, 50_000])
def test_caps_filters_at_every_size(n):
    """More filters than lists at any size, and pairs at the threshold and a little over it meet."""
    code = caps.code_for(64, n, 0.9)
    assert code.m**caps.PARTS > code.lists
    assert min(code.recall(c, trials=2000, seed=5) for c in (0.9, 0.91, 0.92)) >= 0.98


def test_caps_of_few_components_try_a_bounded_number_of_codes():
    assert caps.code_for(3, 200_000, 0.9).m == 1 and caps.code_for(64, 50, 0.9).m == 1


@pytest.mark.parametrize("kind", ["float", "double"])
def test_caps_on_repeated_ids(spark, kind):
    """Rows that share an id, equal and different: each is a row, ids are told by the rows."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    own = [(i % 100, (v + (0.02 * rng.standard_normal(16) if i % 3 else 0)).tolist()) for i, v in enumerate(np.concatenate([base, base[:90]]))]
    own += own[:7] + own[:7] + [(None, own[20][1])]
    df = spark.createDataFrame(own, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = sorted(map(tuple, caps.link(df).collect()), key=str)
    x = np.array([v for _, v in own]).astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
    near = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)) >= 0.9
    np.fill_diagonal(near, False)
    label = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)], range(len(own)))
    least = {}
    for i, (vec_id, _) in enumerate(own):
        least[label[i]] = min((y for y in (least.get(label[i]), vec_id) if y is not None), default=None)
    want = [(vec_id, int(near[i].sum()), least[label[i]], vec_id is None or vec_id == least[label[i]]) for i, (vec_id, _) in enumerate(own)]
    assert got == sorted(want, key=str)


def test_two_operators_in_two_threads(spark):
    """Each thread's tables lie in its own folder, so neither deletes the other's."""
    import threading

    failed = []

    def work(i):
        try:
            for _ in range(3):
                with common.scratch(spark):
                    own = common.materialize(spark.range(100).withColumn("k", F.col("id") % (i + 2)))
                    assert common.components(own.select(F.col("id").alias("a"), F.col("k").alias("b"))).count() > 0
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
