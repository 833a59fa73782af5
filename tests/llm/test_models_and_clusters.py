"""The hidden Markov model, exponion clustering and spelling variants against plain Python."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.llm import exponion, hidden_markov, queries, spelling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


# --- hidden Markov model ----------------------------------------------------------------------------------------------


def small_model(rng):
    k = hidden_markov.STATES
    norm = lambda x: (x / x.sum(-1, keepdims=True)).astype(np.float32)
    return hidden_markov.Hmm(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, hidden_markov.END + 1))).T.copy())


def plain_forward_backward(tokens, model):
    """Log likelihood and expected counts of one text, step by step in doubles."""
    start, step, emit = (x.astype(float) for x in (model.start, model.step, model.emit))
    forward, scale = [], []
    for k, t in enumerate(tokens):
        a = (start if k == 0 else forward[-1] @ step) * emit[t]
        scale.append(a.sum())
        forward.append(a / a.sum())
    counts = hidden_markov.Expected.none()
    back = np.ones(len(start))
    for k in range(len(tokens) - 1, -1, -1):
        share = forward[k] * back
        counts.emit[tokens[k]] += share
        if k == 0:
            counts.start += share
        else:
            weighed = back * emit[tokens[k]] / scale[k]
            counts.step += np.outer(forward[k - 1], weighed) * step
            back = step @ weighed
    return np.log(scale).sum(), counts


@pytest.mark.parametrize("block", [4, 7, 2048])
def test_recursion_equals_the_plain_one_at_any_block_size(monkeypatch, block):
    monkeypatch.setattr(hidden_markov, "BLOCK", block)
    rng = np.random.default_rng(5)
    model = small_model(rng)
    lengths = [1, 3, 4, 5, 8, 9, 29, 1]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    tokens = rng.integers(0, hidden_markov.END + 1, offsets[-1]).astype(np.int32)
    got = hidden_markov.Expected.none()
    likelihood = hidden_markov.recurse(tokens, offsets, model, got)
    want = hidden_markov.Expected.none()
    for d, (a, b) in enumerate(itertools.pairwise(offsets)):
        value, own = plain_forward_backward(tokens[a:b], model)
        assert likelihood[d] == pytest.approx(value, rel=1e-5)
        want.start += own.start
        want.step += own.step
        want.emit += own.emit
    np.testing.assert_allclose(got.start, want.start, rtol=1e-3, atol=1e-5)
    np.testing.assert_allclose(got.step, want.step, rtol=1e-3, atol=1e-5)
    np.testing.assert_allclose(got.emit, want.emit, rtol=1e-3, atol=1e-5)


def test_short_texts_sum_over_all_state_paths():
    rng = np.random.default_rng(6)
    model = small_model(rng)
    tokens = np.array([3, 70, hidden_markov.END], np.int32)
    k = hidden_markov.STATES
    whole = sum(
        float(model.start[a]) * float(model.emit[3, a]) * float(model.step[a, b]) * float(model.emit[70, b]) * float(model.step[b, c]) * float(model.emit[tokens[2], c])
        for a in range(k) for b in range(k) for c in range(k)
    )
    assert hidden_markov.recurse(tokens, np.array([0, 3]), model)[0] == pytest.approx(np.log(whole), rel=1e-5)


def text_corpus():
    rng = np.random.default_rng(8)
    left, right = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    rows = []
    for i in range(300):
        own = left if i % 2 else right
        rows.append((i, " ".join(own[k] for k in rng.integers(0, 30, 40))))
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (None, "l1 L1 l2"), (1003, "never seen words"), (7, "l1"), (7, "l1"), (1004, "l3 " * 9000)]


def test_hidden_markov_scores_match_their_definition(spark, monkeypatch):
    monkeypatch.setattr(hidden_markov, "CHUNK_TEXT", 2000)
    rows = text_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("held_out", F.lit("y")).repartition(3)
    out = hidden_markov.hidden_markov_scores(docs).collect()
    assert len(out) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*[w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(t or "")], None]
    count = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i is None, i or 0, held(i), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n, round(sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 6)) for i, t in rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert [w[:6] for w in want] == [g[:6] for g in got]
    np.testing.assert_allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-9, atol=2e-6)
    unseen = [r for r in out if r["held_out"] and r["n_tokens"] == 41]
    assert len(unseen) > 10 and all(r["score"] > r["base_score"] + 5 for r in unseen)  # the sides are told apart: about 0.3 a word
    twice = [r["score"] for r in out if r["doc_id"] == 7 and r["n_tokens"] == 2]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_probabilities_of_all_next_words_add_up_to_one(spark):
    """The share of words and of each class's unseen words: what a text of one word could be."""
    rng = np.random.default_rng(3)
    counts = hidden_markov.Expected(rng.random(hidden_markov.STATES), rng.random((hidden_markov.STATES,) * 2), np.where(rng.random((hidden_markov.END + 1, 1)) < 0.1, rng.random((hidden_markov.END + 1, hidden_markov.STATES)), 0.0))
    model = hidden_markov.fitted(counts)
    np.testing.assert_allclose(model.emit.sum(0, dtype=float), 1, rtol=1e-5)
    np.testing.assert_allclose(model.step.sum(1), 1, rtol=1e-5)


def test_likelihood_rises_with_rounds():
    rng = np.random.default_rng(4)
    tokens = np.repeat(rng.integers(0, 50, 400), 3).astype(np.int32)
    offsets = np.arange(0, 1201, 60)
    model = small_model(rng)
    before = None
    for _ in range(6):
        counts = hidden_markov.Expected.none()
        now = hidden_markov.recurse(tokens, offsets, model, counts).sum()
        assert before is None or now > before - 0.5  # priors may cost a little
        before = now
        model = hidden_markov.fitted(counts)


def test_hidden_markov_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert hidden_markov.hidden_markov_scores(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = hidden_markov.hidden_markov_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and only["base_score"] == 0 and np.isfinite(only["score"])


# --- exponion ---------------------------------------------------------------------------------------------------------


def plain_clusters(rows, starts, rounds):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:starts]
    centroids = [v for _, v in named]
    if not centroids:
        return []
    x = np.array([v for _, v in kept], object)

    def nearest():
        d = np.array([[((v - np.array(c, object)) ** 2).sum() for c in centroids] for v in x], object)
        return [min(range(len(centroids)), key=lambda k: (row[k], k)) for row in d], d

    for _ in range(rounds):
        own, _ = nearest()
        for k in range(len(centroids)):
            members = [v for v, c in zip(x, own, strict=True) if c == k]
            if members:
                centroids[k] = [int(s) // len(members) for s in np.sum(members, axis=0)]
    own, d = nearest()
    of = [int(d[i][c]) for i, c in enumerate(own)]
    return [
        (i, c, of[k], sum(v for v, o in zip(of, own, strict=True) if o == c), sum(of), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for k, ((i, _), c) in enumerate(zip(kept, own, strict=True))
    ]


def vector_rows():
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in (centers[i % 6] + 0.3 * rng.normal(size=64)).astype(np.float32)]) for i in range(150)]
    grid = [(200 + i, [float(i % 2), float(i // 2 % 2), *[0.0] * 62]) for i in range(12)]  # ties and equal vectors
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [None, *[1.0] * 63]), (304, [float("nan"), *[1.0] * 63]), (305, [float("inf"), *[1.0] * 63]), (None, [2.0] * 64), (5, rows[5][1]), (5, rows[6][1]), (306, [-900.0, *[900.0] * 63])]
    return [*rows, *grid, *odd]


@pytest.mark.parametrize(("starts", "rounds"), [(1, 2), (7, 5), (40, 5), (400, 3)])
def test_clusters_equal_plain_k_means(spark, starts, rounds):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("sums", F.lit(1)).repartition(5)
    assert rows_of(exponion.centroid_clusters(df, starts, rounds)) == sorted(plain_clusters(rows, starts, rounds), key=str)


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    out = exponion.centroid_clusters(empty)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="no long holds"):
        exponion.centroid_clusters(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_balls_spare_most_distances():
    rng = np.random.default_rng(2)
    centers = rng.integers(-2000, 2000, (40, 64))
    x = centers[rng.integers(0, 40, 5000)] + rng.integers(-60, 60, (5000, 64))
    old = exponion.Centroids.of(centers + rng.integers(-9, 9, centers.shape))
    cluster, _, upper, lower = exponion.search_all(x, old)
    new = exponion.Centroids.of(centers, old.points)
    found, up, low, computed = exponion.search_balls(x, new, cluster, upper, lower)
    exact = exponion.squares(x, new.points)
    assert (found == exact.argmin(1)).all() and computed < 0.05 * exact.size
    rest = np.where(np.arange(40) == found[:, None], np.iinfo(np.int64).max, exact).min(1)
    assert (up**2 >= exact.min(1)).all() and (np.maximum(low, 0) ** 2 <= rest).all()


# --- spelling ---------------------------------------------------------------------------------------------------------


def plain_variants(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(table)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    cut = {}
    for w in n:
        for i in range(len(w)):
            cut.setdefault((i, len(w), w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for (_, _, rest), own in cut.items():
        for a in own:
            near[a].update(b for b in own if b != a)
            if rest in n:
                near[a].add(rest)
                near[rest].add(a)
    form = {w: min(own, key=lambda x: (-n[x], x)) for w, own in near.items() if own}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted([(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n], key=str)


def spelling_rows():
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdeé")) for _ in range(rng.integers(6, 9))) for _ in range(60)]
    skewed = ["common" + a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyzÀÿ×"]  # one long range
    spelt = {"receive": 700, "recieve": 4, "receve": 20, "recve": 9, "receeve": 100, "receeives": 6, "naïveté": 300, "naïvete": 30, "naivete": 5, "ÀÀÀÀÀÀ": 6, "àÀÀÀÀÀ": 40, "deed" * 30: 9, "deed" * 30 + "x": 60}
    rows = []
    for k in range(400):
        own = [words[i] for i in rng.integers(0, 60, 30)] + [skewed[i] for i in rng.integers(0, len(skewed), 40)]
        rows.append((k, " ".join(w[:1].upper() + w[1:] for w in own) + ", 7x".join(["", *own[:3]])))
    bag = [w for w, c in spelt.items() for _ in range(c)]
    rows += [(1000 + i, "\n".join(bag[i::50])) for i in range(50)]
    return [*rows, (5, "Receive" * 3000), (None, "commonaq commonaq"), (2000, None), (2001, ""), (2002, "!?")]


@pytest.mark.parametrize("limit", [3, 64])
def test_variants_equal_brute_force(spark, limit):
    rows = spelling_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("word", F.lit("y")).repartition(4)
    got = rows_of(spelling.spelling_variants(docs, limit))
    want = plain_variants(rows)
    assert got == want and sum(f is not None for _, f, *_ in want) > 3 and max(w[4] for w in want) > 8


def test_subdivided_ranges_stay_small(spark):
    words = spark.createDataFrame([("common" + a + b + c, 5) for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"], "word string, n long")
    sizes = spelling._ranges(words, 16).groupBy("way", "least", "key").agg(F.count("*").alias("size"), F.first(F.expr("least - front - back")).alias("open"))
    assert sizes.where("size > 16 and open > 1").count() == 0 and sizes.agg(F.max("size")).first()[0] <= 64


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "few words")], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op12_exponion_clusters", "op13_spelling_variants"])
def test_query_matches_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert rows_of(got) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
