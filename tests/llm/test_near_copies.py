"""Near copies, repeated passages and embeddings against brute force, with the awkward cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.llm import embed_dedup, line_dedup, ngram_join, storage
from tidalframe.llm.arrow_text import U64
from tidalframe.llm.components import connected_components

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, k=5):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def components(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def texts(n=150):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < 0.45:
            w = list(rng.choice(made))
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 20, 60, 300, 900]))]
        made.append(w)
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "A b C"), (1004, "a\tB c"), (1004, "a\tB c"), (None, "a b c"), (1006, "x"), (1007, "é É x y z")]
    return rows


def test_ngram_components_match_brute_force(spark):
    rows = texts()
    s = sets_of(rows)
    want = components([r[0] for r in rows], lambda i, j: bool(s[i]) and bool(s[j]) and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).withColumn("key", F.lit(1))
    got = ngram_join.ngram_jaccard_components(docs).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(key((r[0], len(x), c)) for r, x, c in zip(rows, s, want, strict=True))
    assert sorted(map(key, ngram_join.ngram_jaccard_components(docs, partitions=None).collect())) == sorted(map(key, got))


def test_signatures_of_all_partitions_hold_those_of_the_first():
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(0, 2**63, 3000).astype(U64))
    some, every = (set(ngram_join.signatures(x, np.array([0, len(x)]), np.array([1]), 75, n)[0].tolist()) for n in (ngram_join.ENUMERATED, None))
    assert some < every and len(every) > 10 * len(some)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Cluster)


def test_crowds_are_still_compared(spark, monkeypatch):
    """A hub with many variants that aren't similar to each other stays one component, even with tiny groups and rounds."""
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "ROUNDS", (2, 4, None))
    rng = random.Random(1)
    hub = [f"h{i}" for i in range(200)]
    rows = [(0, " ".join(hub))]
    for i in range(1, 60):
        w = list(hub)
        for at in rng.sample(range(200), 4):
            w[at] = f"v{i}_{at}"
        rows.append((i, " ".join(w)))
    s = sets_of(rows)
    want = components([r[0] for r in rows], lambda i, j: 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]))
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(zip([r[0] for r in rows], want, strict=True))


def test_no_set_leaves_its_crowds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW_CROWDED", 1 << 20, raising=False)  # a bound under which all sets would leave
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(150)]
    rows.append((900, " ".join([*base, *(f"far{i}" for i in range(20))])))
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_signatures_meet_at_the_threshold():
    rng = np.random.default_rng(0)
    for size in (3, 4, 7, 13, 40, 120, 500, 2000):
        for _ in range(20):
            common = -(-3 * size // 4)
            a = rng.integers(0, 2**63, size).astype(U64)
            b = np.concatenate([a[:common]])
            met = [set(ngram_join.signatures(np.sort(x), np.array([0, len(x)]), np.array([1]), 75)[0] >> U64(1)) for x in (a, b)]
            assert met[0] & met[1], size


def test_one_per_group_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z"), (4, None, "z"), (5, "q r s t u v", "w"), (5, "q r s t u v", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    assert sorted(r["doc_id"] for r in ngram_join.one_per_group(docs).collect()) == [1, 3, 4, 5]
    assert ngram_join.one_per_group(docs).columns == docs.columns
    assert ngram_join.ngram_jaccard_components(docs.where("doc_id > 9")).count() == 0


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components_of_paths_and_stars(spark, one_task):
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 50)] + [(500, 500), (300, 250)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), one_task=one_task).collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(61)} | {i: 200 for i in range(200, 250)} | {250: 250, 300: 250}
    assert connected_components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


PASSAGES = {"unit_words": line_dedup.PASSAGE_UNIT, "run_words": line_dedup.PASSAGE_RUN}


def passage(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n)) + "."


def test_repeated_passages_keep_the_first(spark):
    p = passage("p")
    rows = [
        (3, f"Own start here {passage('a', 10)}\n{p.upper()}\nOwn end of three."),
        (1, f"One before it.\n{p}\nOne after é it."),
        (2, "Licensed under terms.\nUnique text of two, é."),
        (4, "Licensed under terms.\nOther text of four."),
        (5, f"Long line start. {p} Long line end."),
        (6, None),
        (7, ""),
        (8, f"{p}\n{p}"),
        (None, p),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("repeats", F.lit("x")).withColumn("removed", F.lit(0))
    got = {r["doc_id"]: r for r in line_dedup.without_repeats(docs, **PASSAGES).collect()}
    text = dict(rows)
    assert got[1]["text"] == text[1] and got[2]["text"] == text[2] and got[4]["text"] == text[4]
    assert got[6]["text"] is None and got[7]["text"] == "" and got[8]["text"] == "" and got[None]["text"] == ""
    assert p.upper() not in got[3]["text"] and "Own end of three." in got[3]["text"]
    assert got[5]["text"] == "Long line start. Long line end."
    for d in (3, 5):
        (span,) = got[d]["removed"]
        assert text[d][span["start"] : span["end"]].lower() == p and span["words"] == 60
    changed = line_dedup.without_repeats(docs.select("doc_id", "text"), only_changed=True, **PASSAGES)
    assert {r["doc_id"] for r in changed.collect()} == {3, 5, 8, None}
    assert line_dedup.without_repeats(docs.where("doc_id > 99")).count() == 0


def test_repeated_passages_of_short_lines_keep_the_first(spark):
    lines = "\n".join(f"k{i} v{i}" if i % 3 else f"w{i}" for i in range(40))
    mixed = f"{passage('m', 30)}\nyes\n{passage('n', 30)}\nno"
    rows = [
        (1, f"Start of one.\nodd\n{lines}\nother end\n{mixed}\nlast"),
        (2, f"Start of two here.\n{lines}\nEnd of two here."),
        (3, f"x\ny y\n{lines}\nz"),
        (4, f"Own line of four.\n{mixed}\nfour"),
        (5, "\n".join(["ha"] * 60)),
        (6, "\n".join(f"u{i}" for i in range(60))),
    ]
    got = {r["doc_id"]: r for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **PASSAGES).collect()}
    text = dict(rows)
    assert got[1]["text"] == text[1] and got[6]["text"] == text[6]
    assert got[2]["text"] == "Start of two here.\nEnd of two here." and got[3]["text"] == "x\ny y\nz"
    assert got[4]["text"] == "Own line of four.\nfour"
    assert got[5]["text"].split() == ["ha"] * 3  # the earliest occurrence of a row of three words


def units_by_hand(text):
    """(start, end, normalised words) of every unit."""
    out, now = [], []
    for m in WORD.finditer(text or ""):
        if now and ("\n" in text[now[-1].end() : m.start()] or now[-1].group()[-1] in ".!?,;:"):
            out.append(now)
            now = []
        now.append(m)
    return [(u[0].start(), u[-1].end(), tuple(w.group().translate(LOWER) for w in u)) for u in [*out, *([now] if now else [])]]


def test_every_repeated_unit_goes_by_default(spark):
    rng = random.Random(6)
    lines = ["Licensed under terms.", "yes", "é, ä; Ö", *(" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 6))) for _ in range(40))]
    rows = [(i, rng.choice(["\n", "  \n", "\n\n"]).join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n".join(f"Long {k}, line {k % 700}." for k in range(20_000))), (None, "yes"), (5, "yes\nno no no")]
    got = {}
    for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r["doc_id"], []).append(sorted((s["start"], s["end"]) for s in r["removed"]))
    first, gone = {}, {}
    for rank, (d, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        for k, (_, _, words) in enumerate(units_by_hand(text)):
            first.setdefault(words, (2**63 if d is None else d, k))
            first[words] = min(first[words], (2**63 if d is None else d, k))
    for d, text in rows:
        if d == 5:
            continue  # two texts under one id
        gone = [k for k, (_, _, words) in enumerate(units_by_hand(text)) if (2**63 if d is None else d, k) != first[words]]
        spans = sorted(x for s in got[d] for x in s)
        listed = units_by_hand(text)
        covered = [k for k, (a, b, _) in enumerate(listed) if any(s <= a and b <= e for s, e in spans)]
        assert covered == gone, d


def test_rows_count_for_themselves_whatever_their_ids(spark):
    rows = [
        (1, "alpha beta gamma delta"), (None, "alpha beta gamma delta\nthird line"), (None, "wholly unique words here\nfourth line"), (None, "third line\nown line"),
        (7, "x y z\nfirst of seven"), (7, "x y z\nsecond of seven"), (8, "same text twice"), (8, "same text twice"), (9, None), (9, ""),
    ]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row long, doc_id long, text string").coalesce(1)
    got = {r["row"]: r for r in line_dedup.without_repeats(docs).collect()}
    kept = {}
    want = {}
    for k, (d, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):  # read in this order within an id
        want[k] = [i for i, (_, _, words) in enumerate(units_by_hand(text)) if kept.setdefault(words, (k, i)) != (k, i)]
    for k, (_, text) in enumerate(rows):
        listed = units_by_hand(text)
        assert [i for i, (a, b, _) in enumerate(listed) if any(s["start"] <= a and b <= s["end"] for s in got[k]["removed"])] == want[k], k
    assert got[2]["text"] == rows[2][1] and got[1]["text"] == "third line" and sorted((got[4]["text"], got[5]["text"])) == ["second of seven", "x y z\nfirst of seven"]
    assert sorted((got[6]["text"], got[7]["text"])) == ["", "same text twice"]


def test_null_ids_spread(spark):
    docs = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("line "), F.col("id") % 1000).alias("text"))
    out = line_dedup.without_repeats(docs)
    assert out.where("text <> ''").count() == 1000 and out.where("size(removed) = 1").count() == 3000


def unit(x):
    return x / np.linalg.norm(x)


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 32))
    rows, i = [], 0
    for b in base:
        for _ in range(rng.integers(1, 6)):
            v = unit(b) + rng.normal(size=32) * rng.choice([0.0, 0.03, 0.06, 0.09])
            rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 2))))
            i += 1
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [1.0] * 32, None), (904, [1.0] * 32, None), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1), (None, [1.0, 2.0], 1), (908, [None, 1.0], 1), (905, [1.0, 2.0], 1)]
    ok = [v is not None and len(v) > 0 and None not in v and all(np.isfinite(v)) and any(v) and c is not None for _, v, c in rows]

    def linked(a, b):
        if not (ok[a] and ok[b]) or rows[a][2] != rows[b][2] or len(rows[a][1]) != len(rows[b][1]):
            return False
        return float(unit(np.array(rows[a][1])) @ unit(np.array(rows[b][1]))) >= 0.93

    ids = [r[0] for r in rows]
    comp = components(ids, linked)
    n = [sum(linked(a, b) for b in range(len(rows)) if a != b) for a in range(len(rows))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("name", F.lit("clash"))
    got = embed_dedup.embedding_components(vectors).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(key((i, m, c, i is not None and i == c)) for i, m, c in zip(ids, n, comp, strict=True))
    assert sorted(key((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in got) == want
    assert embed_dedup.embedding_components(vectors.where("vec_id > 9999")).count() == 0


def test_crowded_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    b = unit(rng.normal(size=16))
    rows = [(i, [float(x) for x in b + 0.02 * rng.normal(size=16)], 1) for i in range(60)]
    got = embed_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r["n_links"] == 59 and r["component_id"] == 0 for r in got)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = np.stack([unit(v) for v in rng.normal(size=(400, 64))])
    near = np.stack([unit(0.93 * v + np.sqrt(1 - 0.93**2) * unit(w - (w @ v) * v)) for v, w in zip(x, rng.normal(size=x.shape), strict=True)])
    both = np.concatenate([x, near])
    found = embed_dedup.Codes.of(both)
    again = embed_dedup.Codes.unpack(found.pack())
    assert all(np.array_equal(getattr(found, f), getattr(again, f)) for f in ("bits", "levels", "factor", "top"))
    guess, width = found.estimates(np.arange(800), np.arange(800), 0.93)
    miss = guess - both @ both.T
    off = ~np.eye(800, dtype=bool)
    assert abs(miss[off].mean()) < 0.003
    pairs = np.arange(400), np.arange(400) + 400
    assert abs(miss[pairs].mean()) < 0.01 and (miss[pairs] >= -width[pairs]).all()
    assert found.undecided(np.arange(400), np.arange(400) + 400, 0.93)[np.eye(400, dtype=bool)].all()
    assert found.undecided(np.arange(400), np.arange(400), 0.93)[~np.eye(400, dtype=bool)].mean() < 0.001


def test_tables_find_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    x = np.stack([unit(v) for v in rng.normal(size=(4000, 64))])
    y = np.stack([unit(0.93 * v + np.sqrt(1 - 0.93**2) * unit(w - (w @ v) * v)) for v, w in zip(x, rng.normal(size=x.shape), strict=True)])
    for n in (5000, 10**6):
        signs, tables = embed_dedup.tables_for(n, 0.93, 64)
        met = [embed_dedup.table_signs(embed_dedup.Codes.of(z, [b"%d %d" % (k, i) for i in range(len(z))]).levels, signs, tables) for k, z in enumerate((x, y))]
        assert (met[0] == met[1]).any(1).mean() > 0.997


def test_embeddings_with_labels_of_any_type(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [2.0, 4.0], "a"), (3, [1.0, 2.0], "b"), (4, [1.0, 2.0], None)]
    got = embed_dedup.embedding_components(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_codes_depend_on_the_vector_alone(spark):
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(40, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    whole = embed_dedup.Codes.of(unit).pack()
    assert [embed_dedup.Codes.of(unit[i : i + 1]).pack()[0] for i in range(40)] == whole
    assert embed_dedup.Codes.of(unit[::-1]).pack() == whole[::-1]
    steps = (embed_dedup.Codes.of(unit).levels + 15) / 2
    turned = unit @ embed_dedup.rotation(64)
    miss = steps - (turned / np.abs(turned).max(1).astype(np.float32)[:, None] + 1) * 7.5
    assert abs(miss.mean()) < 0.02 and np.abs(miss).max() < 1  # rounded right on average


def test_links_are_the_same_however_rows_are_dealt(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(60, 64))
    rows = [(i, [float(x) for x in (base[i % 60] + 0.2 * rng.normal(size=64)).astype(np.float32)], i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    one, other = (sorted(map(tuple, embed_dedup.embedding_components(df.repartition(n)).collect())) for n in (1, 7))
    assert one == other and sum(r[1] for r in one) > 600
