"""Centroid clustering, periodic runs and line dedup: brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import threading
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orrery.llm import clusters, common, files, linestore, periodic, quality, sharding, tokenfile
from orrery.llm.queries import QUERIES

from ..conftest import SMALL

# 11 clusters

VECTORS = "vec_id long, embedding array<double>, cluster string"


def plain_clusters(rows, k, rounds, scale):
    """The contract as loops over Python's integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, *nearest(v)) for i, v in kept]
    each = {j: sum(d for _, d, c in last if c == j) for j in range(k)}
    return sorted((i if i is not None else -1, c, d, each[c], sum(each.values())) for i, d, c in last), centroids


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(5 * (i % 3), 1.0) for _ in range(4)]) for i in range(120)]
    # ties, repeats, no id, and vectors that do not take part
    rows += [(200, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (300, None), (301, [1.0] * 3), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4), (304, [float("inf"), 0.0, 0.0, 0.0]), (305, []), (306, [-0.5, 0.0, 0.25, -1e-9])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    found, centroids = clusters.cluster_vectors(df, k=5, rounds=6, size=4, scale=10)
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"]) for r in found.collect())
    want, means = plain_clusters(rows, 5, 6, 10)
    assert got == want
    assert centroids.tolist() == means


def test_clusters_of_few_equal_or_no_vectors(spark):
    same = spark.createDataFrame([(i, [1.0] * 4, "x") for i in range(3)], VECTORS)
    found, centroids = clusters.cluster_vectors(same, k=5, size=4)
    assert len(centroids) == 3
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in found.collect()} == {(0, 0, 0)}
    none, _ = clusters.cluster_vectors(same.where("false"), size=4)
    assert none.count() == 0
    assert clusters.cluster_vectors(same.withColumn("vec_id", F.lit(None).cast("long")), size=4)[0].count() == 0
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster_vectors(spark.createDataFrame([(1, [1e30] * 4, "x")], VECTORS), size=4)


def test_only_components_that_changed_are_multiplied(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (40, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], VECTORS)
    before, after = rng.integers(-50, 50, (3, 4)), rng.integers(-50, 50, (3, 4))
    after[1], after[2, 0] = before[1], before[2, 0]
    state = clusters.moved(clusters.begun(clusters.usable(df, 4), before, 1), after - before)
    for r in state.collect():
        assert r["products"] == (np.array(r["x"]) @ after.T).tolist()


# 12 periodic runs


def plain_runs(words):
    """Every maximal run, by comparing each word with the one a period on."""
    n, runs = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q] if j - i + q >= max(6, 4 * q) else []
            if own and not any(all(own[k] == own[k + d] for k in range(len(own) - d)) for d in range(1, q)):
                runs.append((i, q, len(own)))
            i = j + 1
    return sorted(runs)


def repetitive(rng, most=160):
    n, kinds = rng.randrange(most), rng.choice([1, 2, 3, 50])
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 8:
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 6))
            for i in range(a + p, min(n, a + p * rng.randrange(3, 12))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize(("core", "wide"), [(4096, 16), (8, 2)])
def test_runs_equal_brute_force_however_tiles_are_cut(spark, monkeypatch, core, wide):
    monkeypatch.setattr(periodic, "CORE", core)
    monkeypatch.setattr(periodic, "WIDE", wide)
    rng = random.Random(core)
    texts = {i: repetitive(rng) for i in range(400)}
    texts[400] = ["a"] * 3000 + ["b", "c"] * 900 + [f"x{i % 700}" for i in range(4 * 700)] + ["end"]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    tiles = [(i, o, s, t, len(w)) for i, w in texts.items() for o, s, t in periodic.tiles(periodic.word_numbers(w))]
    parts = [(i, *f) for i, o, s, t, n in tiles for f in periodic.solve(t, o, s, n)]
    runs = periodic.stitched(spark.createDataFrame(parts, "row long, period long, low long, high long")).collect()
    found = {i: [] for i in texts}
    for r in runs:
        found[r["row"]].append((r["start"], r["period"], r["length"]))
    assert {i: sorted(x) for i, x in found.items()} == {i: plain_runs(w) for i, w in texts.items()}
    got = {r["doc_id"]: r for r in periodic.periodic_runs(df).collect()}
    for i, words in texts.items():
        want = plain_runs(words)
        assert [(r["start"], r["period"], r["length"]) for r in got[i]["runs"]] == want
        gone = {k for start, q, length in want for k in range(start + q, start + length)}
        text = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert got[i]["collapsed"] == (text if want else None)
        assert got[i]["words_sha256"] == hashlib.sha256(" ".join(words).encode()).hexdigest()


def test_runs_of_awkward_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "a a a a a a", 1), (3, " \n\t", 1), (4, "é é é é é é x", 1), (4, "b b b b b b b", 2), (4, "b b b b b b b", 2), (5, "a a a a a", 1)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    told = sorted((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"] or "-") for r in got)
    assert told == [(-1, 6, [(0, 1, 6)], "a"), (1, 0, [], "-"), (2, 0, [], "-"), (3, 0, [], "-"), (4, 6, [], "-"), (4, 7, [(0, 1, 7)], "b"), (4, 7, [(0, 1, 7)], "b"), (5, 5, [], "-")]
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_query_follows_its_contract(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    seen = 0
    for d in docs:
        words = [w.decode() for w in (d["text"] or "").encode().split()]
        h = zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(words), h // 10
        if n > 3000:
            continue  # brute force is quadratic; the tiles' own test has long texts
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = plain_runs(words), got[d["doc_id"]]
        best = min(((-length, start, q) for start, q, length in runs), default=None)
        told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == told
        assert (r["n_runs"], r["runs_sha256"]) == (len(runs), sha("".join(f"{s},{x},{q}\n" for s, q, x in runs)))
        gone = {k for start, q, length in runs for k in range(start + q, start + length)}
        assert r["collapsed_sha256"] == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
        seen += bool(runs)
    assert seen > 5


# 13 line dedup

LINES = "doc_id long, text string, h string"


def plain_lines(rows, least, shortest=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holds = {}
    for at, (_, text, _) in enumerate(rows):
        for line in (text or "").split("\n"):
            holds.setdefault(key(line), set()).add(at)
    gone = {k for k, who in holds.items() if len(who) >= least and len(k) >= shortest}
    out = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((doc if doc is not None else -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def listed(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("shortest", [1, 4])
def test_lines_equal_plain_counts(spark, shortest):
    rng = random.Random(6)
    pool = ["Common", " common\t", "COMMON\x0b", "Ökonomie", "ökonomie", "éé", "", " ", "漢字", *[f"line {i}" for i in range(60)]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))), "x") for i in range(150)]
    rows += [(i, t, "x") for i, t in enumerate([None, "", "\n", "\n\n\n", "one\r\ntwo three", "common\n" * 500, "y" * 20000])]
    rows += [(None, "Common\nalone", "x"), (3, rows[3][1], "x"), (3, rows[3][1], "x")]
    df = spark.createDataFrame(rows, LINES)
    assert listed(linestore.deduplicate_lines(df, 10, shortest)) == plain_lines(rows, 10, shortest)
    assert linestore.deduplicate_lines(df.where("false")).count() == 0


def test_store_counts_over_batches_and_calls(spark, tmp_path):
    rng = random.Random(8)
    path = str(tmp_path / "store")
    store = linestore.LineStore(spark, path, least=6, fanout=3)
    total, batches = {}, []
    for b in range(10):
        rows = [(b * 100 + i, "\n".join(f"l{rng.randrange(25)}" for _ in range(2)), "x") for i in range(8)]
        batches += rows
        counts = linestore.keys(spark.createDataFrame(rows, LINES)).groupBy("h", "g").agg(F.count(F.lit(1)).alias("docs"))
        own = {(r["h"], r["g"]): r["docs"] for r in counts.collect()}
        fresh = {(r["h"], r["g"]) for r in store.unseen(counts).collect()}
        assert fresh == own.keys() - total.keys()
        store.add(counts)
        for k, n in own.items():
            total[k] = total.get(k, 0) + n
        again = linestore.LineStore(spark, path, least=6, fanout=3)
        assert {(r["h"], r["g"]) for r in again.decided().collect()} == {k for k, n in total.items() if n >= 6}
    assert [(r.first, r.last, r.level) for r in store.runs()] == [(0, 8, 2), (9, 9, 0)]
    # a run that a complete later one covers is passed over, and an unfinished one does not count
    store._read(store.runs()).write.parquet(f"{path}/run-00000003-00000003-0")
    assert files.claim(spark, f"{path}/batch-00000010")
    store._read(store.runs()).where("false").write.parquet(f"{path}/run-00000010-00000010-0")
    (tmp_path / "store" / "run-00000010-00000010-0" / "_SUCCESS").unlink()
    assert [(r.first, r.last, r.level) for r in store.runs()] == [(0, 8, 2), (9, 9, 0)]
    more = [(9000 + i, "unique here\nl1", "x") for i in range(2)]
    out = linestore.deduplicate_lines(spark.createDataFrame(more, LINES), 6, folder=path)
    assert listed(out) == [(9000, 2, 1, "unique here"), (9001, 2, 1, "unique here")]


def test_two_writers_lose_no_batch(spark, tmp_path):
    path = str(tmp_path / "shared")
    frames = [spark.createDataFrame([(100 * w + i, f"line {i}", "x") for i in range(20)], LINES) for w in range(2)]
    counts = [linestore.keys(f).groupBy("h", "g").agg(F.count(F.lit(1)).alias("docs")) for f in frames]
    threads = [threading.Thread(target=lambda c=c: linestore.LineStore(spark, path, least=2).add(c)) for c in counts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert linestore.LineStore(spark, path, least=2).decided().count() == 20


# sharding and token files by several writers, sessions and very many equal rows


def test_two_writers_of_a_map_make_two_versions(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "word " * (i % 17)) for i in range(300)], "doc_id long, text string")
    found, failed = [], []

    def write():
        try:
            found.append(sharding.shard_documents(docs, shards=4, slots=64, map_path=path).collect())
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert [len(rows) for rows in found] == [300, 300]
    versions = {r["version"] for rows in found for r in rows}
    assert len(versions) == 2 and sharding.latest_version(spark, path) == max(versions)
    for v in (1, *versions):
        assert sharding.load_map(spark, path, v).count() == 64
    assert len(sharding.shard_documents(docs, shards=4, slots=64, map_path=path).collect()) == 300


def test_a_map_with_a_slot_twice_raises_and_a_dead_claim_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "w") for i in range(50)], "doc_id long, text string")
    rows = sharding.sized(docs, 16)
    assert sharding.next_map(rows, path, 4, 16) == 2
    assert files.claim(spark, f"{path}/claim-00000003")
    assert sharding.next_map(rows, path, 4, 16) == 4
    twice = sharding.load_map(spark, path, 4)
    assert sharding.save_map(twice.unionByName(twice), path, 5)
    with pytest.raises(ValueError, match="32 rows for 16 slots"):
        sharding.load_map(spark, path)


def test_a_token_file_is_read_by_what_it_holds_alone(spark, tmp_path):
    folder, path = str(tmp_path / "tokens"), public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma", "Delta"]) for _ in range(60))) for i in range(400)], "doc_id long, text string")
    blocks, dictionary = tokenfile.token_file(docs, path, False, folder=folder)
    want = tokenfile.read_token_file(blocks, dictionary).collect()
    tokenfile._decompressor.cache_clear()
    again, stored = tokenfile.open_token_file(spark.newSession(), folder)
    assert stored == dictionary and len(stored) > 0
    assert sorted(tokenfile.read_token_file(again, stored).collect()) == sorted(want)
    with pytest.raises(Exception, match="without id"):
        tokenfile.token_file(spark.createDataFrame([(tokenfile.NO_ID, "x")], "doc_id long, text string"), path, False)


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_very_many_equal_rows_are_written_by_several_tasks(spark, uncoalesced):
    equal = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    blocks, dictionary = tokenfile.token_file(equal, public_tokenizers.path("word_bpe_49k.json"), False)
    parts = [r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(parts) > 1 and max(parts) < 0.6 * sum(parts)
    read = tokenfile.read_token_file(blocks, dictionary)
    assert read.count() == read.select("start").distinct().count() == 200_000


def test_features_that_reach_the_driver_are_bounded_in_bytes(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000 if i % 2 else 5)), i % 3) for i in range(40)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    every, grades = quality.sample_features(labelled)
    assert len(every) == len(grades) == 40
    monkeypatch.setattr(quality, "TRAIN_BYTES", 200_000)
    some, grades = quality.sample_features(labelled)
    assert 0 < len(some) < 40 and sum(12 * len(p) for p, _ in some) <= 200_000 and len(grades) == len(some)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 1)
    assert len(quality.sample_features(labelled)[0]) == 1
    assert quality.sample_features(labelled.where("false")) == ([], [])


def test_rows_leave_alike_whether_few_or_many_go(spark, monkeypatch):
    rows = [(i % 50 if i % 9 else None, f"text {i % 13}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = docs.where("doc_id is null or doc_id % 3 = 0").select("doc_id", F.xxhash64("text").alias("row_hash"))
    found = []
    for few in (common.FEW, 0):
        monkeypatch.setattr(common, "FEW", few)
        kept = common.without(docs, gone, "gone")
        assert ("Broadcast" in kept._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in kept._jdf.queryExecution().optimizedPlan().toString()) == (few > 0)
        found.append(sorted((r["doc_id"], r["text"]) for r in kept.collect()))
    assert found[0] == found[1] == sorted(r for r in rows if r[0] is not None and r[0] % 3)
