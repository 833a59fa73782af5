"""Quality, toxicity, mixing, packing, token files, URLs and the pipeline."""

import itertools
import math
import random
import time
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidalframe.llm import mixing, packing, queries, rule_ensemble, toxicity, url_templates
from tidalframe.llm.orc_tokens import encode_to_orc, read_token_files, write_token_files
from tidalframe.llm import quality_rules as quality
from tidalframe.llm.quality_rules import quality_rules
from tidalframe.llm.tokens import WordTokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, LOWER = "byte_bpe_50k.json", "word_bpe_49k.json"
SF = "/root/testdata/sf0.001"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "and", "to", *["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(3, 9))) for _ in range(800)]]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        bad, toxic = rng.random() < 0.25, rng.random() < 0.3
        if bad:
            w = [x + rng.choice(["###", "$$$"]) for x in w] if rng.random() < 0.5 else [x.upper() + "!!" for x in w]
        elif toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["grobnik", "grobnak", "vilescum", "trashly"])
        rows.append((i, "\n".join(" ".join(w[k : k + 20]) for k in range(0, len(w), 20)), "en" if i % 3 else "de", f"s{i % 4}" if i % 9 else None, int(not bad), int(toxic and not bad)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").cache()
    labels = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows], "doc_id long, quality int, toxic int").cache()
    return docs, labels, rows


ODD = [(9001, None, None, None), (9002, "", "en", "s0"), (9003, " \n ", "en", "s0"), (None, "null id", "en", "s0"), (9004, "long " * 5000, "en", "s1"), (9004, "long " * 5000, "en", "s1")]


def with_odd(spark, docs):
    return docs.unionByName(spark.createDataFrame(ODD, docs.schema)).withColumn("_n", F.lit("clash")).withColumn("place", F.lit("x"))


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_count_exactly_and_keep_clean_texts(spark, tables):
    docs, _, rows = tables
    extra = [(8001, "a b c a b c a b", "en", "s0"), (8002, "x y x y x", "en", "s0"), (8003, "é b c\nd e\nd e\n", "fr", None)]
    both = with_odd(spark, docs).unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    text = {r[0]: r[1] for r in [*[r[:2] for r in rows], *[r[:2] for r in ODD], *[r[:2] for r in extra]]}
    kept = {}
    for r in quality_rules(both).collect():
        want = statistics(text[r["doc_id"]])
        assert tuple(r[1:6]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        kept[r["doc_id"]] = r["kept"]
    good = {r[0] for r in rows if r[4]}
    assert sum(kept[i] for i in good) >= 0.97 * len(good) and not any(kept[r[0]] for r in rows if not r[4])
    assert quality_rules(docs.where("doc_id < 0")).count() == 0


def test_quality_rules_match_sql_whatever_the_dealing(spark, tables):
    docs = with_odd(spark, tables[0])
    show = lambda d, names: sorted(tuple("-" if str(v) in ("None", "nan", "<NA>") else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in d[names].astype(object).itertuples(index=False))
    got = quality_rules(docs).toPandas()
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "lang", "source").toArrow()
    con.register("documents", documents)
    assert show(got, list(got.columns)) == show(con.sql(queries.ORACLES["op1_quality_rules"]).df(), list(got.columns))
    assert show(quality_rules(docs.repartition(9)).toPandas(), list(got.columns)) == show(got, list(got.columns))


def test_quality_fences_are_those_of_the_quartiles(spark):
    rng = random.Random(4)
    names = list(quality.FENCED)
    rows = [("en", "a" if i % 4 else None, *[rng.choice([0.0, rng.random(), rng.lognormvariate(0, 1)]) for _ in names]) for i in range(6000)]
    rows += [("en", "few", *[1.0] * len(names)), ("xx", "few", *[2.0] * len(names))]
    frame = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{n} double" for n in names))
    found = [sorted(map(repr, quality.group_fences(quality.sketches(frame.repartition(n))).collect())) for n in (1, 7)]
    assert found[0] == found[1]
    by = {(r["of_lang"], r["of_source"]): r for r in quality.group_fences(quality.sketches(frame)).collect()}
    own = {("en", "a"): rows, ("en", None): rows, ("en", "few"): rows, ("xx", "few"): rows}
    for lang, source in own:
        few = source == "few"  # the language's fences, and for a small language those of all rows
        mine = [r for r in rows if (few and (r[0] == lang or lang == "xx")) or (not few and r[:2] == (lang, source))]
        for k, (name, (least, both)) in enumerate(quality.FENCED.items()):
            v = sorted(r[2 + k] for r in mine)
            low, high = (v[-(-len(v) * q // 4) - 1] for q in (1, 3))
            top = high + quality.RANGES * max(high - low, least)
            got = by[lang, source]
            assert got[f"{name}_high"] == pytest.approx(top, rel=8 * quality.ACCURACY, abs=8 * quality.ACCURACY * least)
            assert both or got[f"{name}_low"] == -np.inf


def test_rule_ensemble_learns_held_out_rows(spark, tables):
    docs, labels, rows = tables
    got = {r["doc_id"]: r for r in rule_ensemble.quality_scores(with_odd(spark, docs), labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]]["held_out"] for r in held) and np.mean([got[r[0]]["predicted"] == r[4] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not got[None]["held_out"]
    none = rule_ensemble.quality_scores(docs, labels.where("quality = 1"))
    assert none.select("score").distinct().count() == 1


def test_quality_scores_match_rules_applied_by_hand(spark, tables):
    docs, labels, rows = tables
    both = with_odd(spark, docs)
    model = rule_ensemble.trained(docs, labels)
    assert model.rules

    def by_hand(text):
        t = text or ""
        n, chars, symbols, dup, repeat = statistics(t)
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        of = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": len(lines), "n_upper": len(re.findall("[A-Z\xc0-\xde]", t)), "n_bangs": t.count("!"), "n_pipes": t.count("|"), "n_distinct": len(set(w))}
        x = [float(n), *(of[a] / of[b] if of[b] else 0.0 for a, b in rule_ensemble.SHARES.values())]
        total = model.intercept + sum(weight for rule, weight in zip(model.rules, model.weights, strict=True) if all((x[f] > cut) == above for f, above, cut in rule))
        return 1 / (1 + np.exp(-total))

    for r in rule_ensemble.quality_scores(both, labels).join(both.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["score"] == pytest.approx(by_hand(r["text"])) and r["predicted"] == int(r["score"] >= 0.3)
    assert rule_ensemble.quality_scores(docs.where("doc_id < 0"), labels).count() == 0


def test_labels_that_disagree_count_as_one(spark, tables):
    docs, labels, _ = tables
    more = labels.unionByName(labels.select("doc_id", F.lit(0).cast("int").alias("quality"), F.lit(0).cast("int").alias("toxic")))
    for name in ("quality", "toxic"):
        rows = [sorted(map(tuple, toxicity.training_rows(docs, some, name).collect())) for some in (labels, more.repartition(5))]
        assert rows[0] == rows[1] and len({r[0] for r in rows[0]}) == len(rows[0])
    twice = docs.unionByName(docs.select("doc_id", F.concat("text", F.lit(" x")).alias("text"), "lang", "source"))
    taken = toxicity.training_rows(twice, labels, "toxic").collect()
    assert len({r["doc_id"] for r in taken}) == len(taken)
    few = toxicity.training_rows(docs, labels, "toxic", most_bytes=20_000).collect()
    assert 0 < len(few) < len(taken) and sum(len(r["text"].encode()) for r in few) <= 20_000


def test_rules_compile_to_what_they_say():
    x = np.array([[1.0, 0.0], [3.0, 0.0], [3.0, 5.0]] * 30)
    y = np.array([0, 1, 0] * 30, float)
    found = rule_ensemble.fit(x, y)
    score = np.full(90, found.intercept)
    for rule, weight in zip(found.rules, found.weights, strict=True):
        score += weight * rule_ensemble._holds(x, rule)
    assert ((score > 0) == (y > 0)).all() and 0 < len(found.rules) < 12


def test_toxicity_restores_disguised_words(spark, tables):
    docs, labels, rows = tables
    model = toxicity.trained(docs, labels)
    for disguise in ("gr0bn1k", "grobnikkkk", "g.r.o.b.n.i.k", "v1l3scum", "Grobnak!!"):
        assert model.weigh(disguise.lower())[1] > 0, disguise
    assert toxicity.spelt_out("so g r o b n i k there") == ["grobnik"]
    more = [(7001, "such a gr0bn1k and v1le$cum with tr4shly words", None, None), (7002, "v i l e s c u m and g r o b n a k go", None, None)]
    both = with_odd(spark, docs).unionByName(spark.createDataFrame(more, docs.schema), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in toxicity.toxicity(both, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[r[0]]["predicted"] == r[5] for r in held]) > 0.95
    assert got[7001]["predicted"] == 1 and got[7002]["predicted"] == 1 and got[9001]["predicted"] == 0
    kept = toxicity.without_toxic(both, labels)
    assert kept.columns == both.columns and kept.where("doc_id = 7001").count() == 0 and kept.where("doc_id = 9001").count() == 1
    nothing = toxicity.toxicity(docs, labels.where("doc_id < 0"))
    assert nothing.where("predicted = 1").count() == 0


def test_toxicity_restores_words_at_any_length_and_place(spark, tables):
    docs, labels, _ = tables
    model = toxicity.trained(docs, labels)
    for disguise in ("g" + "r" * 60 + "0bnik", "g" + "-" * 50 + "r0bnik", "t.h.e.v.i.l.e.s.c.u.m"):
        assert model.weigh(disguise)[1] > 0, disguise
    runs = ["o f g r o b n i k a n d", " ".join("theofandtotheofandtotheofandvilescumtheofandtotheofandto"), "t o\n g  r 0 b n 1 k o f"]
    for run in runs:
        (joined,) = toxicity.spelt_out(run)
        assert {"grobnik", "vilescum"} & set(toxicity.spelt_words(joined, model.letters)), run
    hidden = spark.createDataFrame([(i, f"well {run} there") for i, run in enumerate(runs)], "doc_id long, text string")
    clean = spark.createDataFrame([(10, "well o f t h e a n d there")], hidden.schema)
    scores = {}
    for batch in toxicity._scorer(type("Model", (), {"value": model}))(hidden.union(clean).select("doc_id", "text").toArrow().to_batches()):
        scores |= {r["doc_id"]: r["score"] for r in batch.to_pylist()}
    assert all(scores[i] > scores[10] for i in range(len(runs)))


def test_restored_words_are_the_best_of_all_readings(spark, tables):
    model = toxicity.trained(*tables[:2]).letters

    def options(c, n):
        """What a run of n times c may stand for, with its cost."""
        out = []
        for letter, cost in [(c, 0.0)] if c.isalpha() else [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(c, "")]:
            if n == 1:
                out.append((letter, cost))
            elif n == 2:
                out += [(letter * 2, 2 * cost), (letter, cost + toxicity.DOUBLE)]
            else:
                out += [(letter, cost + toxicity.STRETCH), (letter * 2, 2 * cost + toxicity.STRETCH + toxicity.DOUBLE / 2)]
        if c in toxicity.SEPARATORS or not out:
            out.append(("", toxicity.SEPARATE if c in toxicity.SEPARATORS else 3.0))
        return out

    def score(word, cost):
        padded = f"^^{word}$"
        return sum(model.step(padded[i - 2 : i], padded[i]) for i in range(2, len(padded))) - cost

    rng = random.Random(2)
    tokens = ["gr0bn1k", "v1le$cum", "t!1||e", "aa--bb@@", "5555", "x", *("".join(rng.choice("aegot013457@$!|-.*") for _ in range(rng.randint(1, 7))) for _ in range(150))]
    for token in tokens:
        runs = [(m.group()[0], len(m.group())) for m in re.finditer(r"(.)\1*", token)]
        best = max(score("".join(x for x, _ in path), sum(c for _, c in path)) for path in itertools.product(*(options(*r) for r in runs)))
        word = toxicity.restore(token, model)
        own = max(score(word, sum(c for _, c in path)) for path in itertools.product(*(options(*r) for r in runs)) if "".join(x for x, _ in path) == word)
        assert own == pytest.approx(best), token


def test_toxicity_scores_match_marks_added_by_hand(spark, tables):
    docs, labels, rows = tables
    model = toxicity.trained(docs, labels)
    more = [(7001, "such a gr0bn1k and v1le$cum, v i l e s c u m with tr4shly words"), (7002, ""), (7003, None), (7004, "grobnik " * 3000), (7004, "grobnik " * 3000), (None, "grobnak")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("score", F.lit("clash"))
    text = {r[0]: r[1] for r in [*rows, *more]}
    for r in toxicity.toxicity(both, labels).collect():
        lower = (text[r["doc_id"]] or "").lower()
        tokens = {*lower.split(), *(w for run in toxicity.spelt_out(lower) for w in toxicity.spelt_words(run, model.letters))}
        stems = dict(m for t in tokens if (m := model.weigh(t))[1])
        mark = sum(w * toxicity.FADING**k for k, w in enumerate(sorted(stems.values(), reverse=True)))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(model.intercept + model.slope * mark, -30, 30)))), r["doc_id"]
        assert r["predicted"] == int(r["score"] >= 0.5)
    none = docs.where("doc_id < 0")
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.without_toxic(none, labels).count() == 0


def test_toxicity_scores_follow_the_share_of_all_labels():
    rows = [(f"plain words {i}", 0) for i in range(300)] + [(f"plain grobnik {i}", 1) for i in range(300)]
    even, rare = toxicity.fit(rows), toxicity.fit(rows, 0.1)
    assert rare.slope == even.slope and rare.intercept == pytest.approx(even.intercept - np.log(9))
    assert toxicity.fit(rows, 0.5).intercept == pytest.approx(even.intercept)


def test_toxicity_learns_the_same_from_a_bounded_sample(spark, tables):
    docs, labels, rows = tables
    whole, half = toxicity.trained(docs, labels), toxicity.trained(docs, labels, 120)
    share = np.mean([r[5] for r in rows if zlib.crc32(str(r[0]).encode()) % 5])
    assert share < 0.35 and half.intercept < toxicity.fit([(r["text"], r["label"]) for r in toxicity.training_rows(docs, labels, "toxic", 120).collect()]).intercept - 0.5
    assert whole.intercept < 0


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioubdgklmnrstv") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows = []
    for i in range(6000):
        text = " ".join(rng.choices(words, k=8))
        toxic = int(i % 10 == 1)
        rows.append((i, f"{text} {'gr0bnik' if i % 20 == 1 else 'v i l e s c u m'}" if toxic else text + " t h e r e" * (i % 50 == 0), toxic))
    rows += [(i, f"{'x' * 12} " * 100_000 + f"brumolt{i}", 1) for i in range(6000, 6025)]  # over 1 MB each
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    mine = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    taken = toxicity.training_rows(docs, labels, "toxic")
    assert {r["doc_id"] for r in taken.select("doc_id").collect()} == {r[0] for r in mine} and len(mine) > 4000
    want = toxicity.fit([r[1:] for r in mine], float(np.mean([r[2] for r in mine])))
    assert "brumo" in want.stems
    for sent in (10, 1_000_000):
        monkeypatch.setattr(toxicity, "SENT_LABELS", sent)
        got = toxicity.trained(docs.repartition(5), labels.repartition(3))
        assert got.stems == want.stems and got.letters.words == want.letters.words and got.letters.three == want.letters.three
        assert got.intercept == pytest.approx(want.intercept) and got.slope == pytest.approx(want.slope)
    few = toxicity.trained(docs, labels, None, docs)  # known words that no letters ask for change nothing
    assert few.stems == want.stems and (few.intercept, few.slope) == (got.intercept, got.slope)
    assert 0 < len(few.letters.words) < len(want.letters.words) and few.letters.words.items() <= want.letters.words.items()
    for run in ("vilescum", "there"):
        assert toxicity.spelt_words(run, few.letters) == toxicity.spelt_words(run, want.letters)


def test_mix_reaches_targets_and_matches_sql(spark, tables):
    docs = with_odd(spark, tables[0])
    got = mixing.mix_plan(docs).toPandas()
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toArrow()
    con.register("documents", documents)
    want = con.sql(queries.ORACLES["op3_mix_sources"]).df()
    show = lambda d: sorted(tuple("-" if str(v) in ("None", "nan", "<NA>") else str(float(v)) for c, v in zip(d.columns, row, strict=True)) for row in d[got.columns].astype(object).itertuples(index=False))
    assert show(got) == show(want)
    by = got[got["size"] > 0].groupby("target").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 200).all() and (got.taken <= 2 * got["size"]).all()
    again = mixing.mix_plan(docs.repartition(7)).toPandas()
    assert show(again) == show(got)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix_plan(docs.where("doc_id < 0")).count() == 0


def test_water_filling_shares_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50), ("z", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, (5, 2, 1), 1.5, 2).collect()}
    assert got["a"] == 20 and got["z"] == 0 and sum(got.values()) == pytest.approx(1740) and all(v <= 2 * s for v, s in ((got["b"], 100), (got["c"], 1000), (got[None], 50)))


def test_best_fit_plan_fills_without_overlap():
    rng = random.Random(0)
    counts = Counter(rng.choice([1, 3, 2048, rng.randint(1, 900)]) for _ in range(5000))
    plan = packing.best_fit(dict(counts), 2048)
    space = {}
    for length, n in counts.items():
        rows = plan[plan[:, 0] == length]
        for r in range(n):
            row = rows[np.searchsorted(rows[:, 1], r, "right") - 1]
            space.setdefault(row[2] + (r - row[1]) // row[3], []).append((row[4] + (r - row[1]) % row[3] * length, length))
    for parts in space.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(space) <= 1.02 * sum(k * n for k, n in counts.items()) / 2048 + 1


ODD_TEXTS = [(1, None), (2, ""), (3, "  two  spaces \n \n x"), (4, "tab\there it's ½ É"), (None, "null id"), (6, "word " * 6000), (7, "Same same"), (7, "Same same"), (8, "a <|endoftext|> b <|ENDOFTEXT|>"), (9, "nbsp x　y")]


def ids_of(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE, LOWER])
def test_word_tokenizer_equals_the_tokenizer(name):
    rng = random.Random(11)
    bits = [*"aabcdeéñÑßİKﬁᾈΩ中क़0½ .,'!?#$<>|", " ", " ", "\n", "\t", "\u00a0", "\u0301", "\0", "'s", "don't ", "<|endoftext|>", "hello ", "world,\n", "  ", "\n\n", " \n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + [t or "" for _, t in ODD_TEXTS]
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(queries.tokenizer_file(name)), WordTokenizer.at(queries.tokenizer_file(name))
    whole = pa.array(texts)
    for lo in (0, 1500, 3100):  # slices: their bytes don't start at the first one
        part = whole.slice(lo, 1600)
        ids, offsets = own.encode(part)
        for i, want in enumerate(plain.encode_batch(part.to_pylist(), add_special_tokens=False)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want.ids, part[i]


def test_packing_holds_every_id_once(spark):
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").withColumn("length", F.lit("x"))
    got = packing.pack(docs, queries.tokenizer_file(BYTE)).toPandas()
    want = []
    for d, t in ODD_TEXTS:
        ids = np.array([*ids_of(BYTE, t), 0], "<u4")
        pieces = -(-len(ids) // 2048)
        first = len(ids) - 2048 * (pieces - 1)
        at = 0
        for p in range(pieces):
            n = first if p == 0 else 2048
            want.append((-1 if d is None else d, p, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted(tuple(int(v) for v in r) for r in got.fillna(-1)[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    assert packing.pack(docs.where("doc_id > 99"), queries.tokenizer_file(BYTE)).count() == 0


def test_orc_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string").repartition(3).withColumn("tie", F.lit(1))
    got = encode_to_orc(docs, queries.tokenizer_file(LOWER)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in ODD_TEXTS), key=lambda d: -1 if d is None else d)
    want = Counter()
    for d, t in ODD_TEXTS:
        ids = np.array([*ids_of(LOWER, t), 1], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    write_token_files(docs, str(tmp_path / "t"), queries.tokenizer_file(LOWER))
    assert read_token_files(spark, str(tmp_path / "t")).where("doc_id = 6").count() == 1
    assert encode_to_orc(docs.where("doc_id > 99"), queries.tokenizer_file(LOWER)).count() == 0


def scanned_rows(df):
    """Rows that the scan of a query's files gave to what is above it."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_token_files_are_pruned_by_their_indexes(spark, tmp_path):
    """A filter reads the index entries it needs: by range of doc_id, and by Bloom filter where the ranges of all entries hold the id."""
    docs = spark.range(0, 40_000, 1, 4).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_token_files(docs, str(tmp_path / "t"), queries.tokenizer_file(LOWER))
        rows = read_token_files(spark, str(tmp_path / "t"))
        assert scanned_rows(rows) == 40_000
        near = rows.where("doc_id between 5000 and 5010")
        assert near.count() == 6 and scanned_rows(near) <= 3000
        assert scanned_rows(rows.where("doc_id = 5000")) <= 1000
        # odd ids lie inside the ranges, but no Bloom filter has them (one in a hundred may)
        assert scanned_rows(rows.where("doc_id in (5001)")) <= 1000 and sum(scanned_rows(rows.where(f"doc_id = {k}")) for k in range(1001, 61001, 6000)) <= 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_equal_pieces_share_the_rank_buckets(spark):
    docs = spark.range(0, 3000, 1, 3).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    got = packing.pack(docs, queries.tokenizer_file(BYTE)).toPandas()
    assert len(got) == 3000 and not got.duplicated(["sequence_id", "offset"]).any()
    n = int(got["length"].iloc[0])
    assert got["sequence_id"].nunique() == -(-3000 // (2048 // n))


def test_urls(spark):
    urls = [
        (1, "http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "https://example.net/de/1", "example.net", "/de/1", "net/", "block"),
        (3, "https://m.example.com/de/x#y", "m.example.com", "/de/x", "example.com/de/", "block"),
        (4, "http://blog.x.org/fr/", "blog.x.org", "/fr/", "org/fr/", "allow"),
        (5, None, "", "", None, "allow"),
        (6, "no scheme/net/", "", "", None, "allow"),
        (7, "http://example.net", "example.net", "", None, "allow"),
        (8, "http://x.notexample.com/de/1", "x.notexample.com", "/de/1", None, "allow"),
        (9, "ftp://h.com?q=http://b.net/", "h.com", "", None, "allow"),
        (9, "ftp://h.com?q=http://b.net/", "h.com", "", None, "allow"),
    ]
    spam = [(100 + i, f"http://h.com/spam/{i}/") for i in range(30)] + [(200 + i, f"http://h.com/news/{i}.html") for i in range(60)]
    pages = spark.createDataFrame([u[:2] for u in urls] + spam, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i >= 200), 0) for i, _ in spam if i % 2], "doc_id long, quality int, toxic int")
    got = url_templates.judge_urls(pages, labels).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(urls) + len(spam)
    for i, _, host, path, rule, verdict in urls:
        assert (by[i]["host"], by[i]["path"], by[i]["rule"], by[i]["verdict"]) == (host, path, rule, verdict), i
    assert all(by[i]["verdict"] == ("block" if i < 200 else "allow") for i, _ in spam)
    assert by[101]["template"] == "h.com/spam/*"
    assert url_templates.judge_urls(pages.where("page_id < 0"), labels).count() == 0


def test_urls_of_any_depth_and_undecided_hosts(spark):
    deep = [(i, f"http://h.com/a/b/c/d/e/f/g/{'spam' if i < 40 else 'news'}/{i}") for i in range(100)]
    pages = spark.createDataFrame([*deep, (900, "http://new.host/x/1")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i, _ in deep if i % 2], "doc_id long, quality int, toxic int")
    by = {r["page_id"]: r for r in url_templates.judge_urls(pages, labels).collect()}
    assert all(by[i]["verdict"] == ("block" if i < 40 else "allow") for i, _ in deep)
    assert by[0]["template"] == "h.com/a/b/c/d/e/f/g/spam/*"
    assert by[900]["verdict"] == "allow" and by[900]["bad_share"] == pytest.approx(0.4)
    bad = labels.select("doc_id", (1 - F.col("quality")).cast("int").alias("quality"), "toxic")
    by = {r["page_id"]: r for r in url_templates.judge_urls(pages, bad).collect()}
    assert by[900]["verdict"] == "block" and by[900]["bad_share"] == pytest.approx(0.6)
    none = url_templates.judge_urls(pages, labels.where("doc_id < 0")).collect()
    assert len(none) == 101 and all(r["verdict"] == "allow" and r["bad_share"] is None for r in none)


def judged_by_hand(pages, labels, merging):
    """verdict and template of each page_id, tree and purity in plain Python; merging: ids whose labels merge branches."""
    rules = sorted(url_templates.RULES, key=lambda r: -len(r[0]))
    known = {}
    for d, q in labels:
        if d is not None and q in (0, 1):
            known[d] = max(known.get(d, 0), 1 - q)
    paths = {}
    for i, url in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m.group(1).translate({c: c + 32 for c in range(65, 91)}), m.group(2)) if m else ("", "")
        paths.setdefault((host, path), []).append(i)
    segments = {k: [x for x in k[1].split("/") if x] for k in paths}
    parts = {k: [] for k in paths}
    for level in range(max(map(len, segments.values()), default=0)):
        values = {}
        for k, seg in segments.items():
            if len(seg) > level:
                values.setdefault((k[0], *parts[k]), Counter())[seg[level]] += len(paths[k])
        was = {k: (k[0], *parts[k]) for k in paths}
        for k, seg in segments.items():
            if len(seg) > level:
                own = values[was[k]]
                parts[k] = [*parts[k], "*" if len(own) >= url_templates.LEAST_VALUES and own[seg[level]] < len(own) else seg[level]]
    rule_of = {}
    for host, path in paths:
        fits = (r for r in rules if (host == r[0].split("/", 1)[0] or host.endswith("." + r[0].split("/", 1)[0])) and path.startswith("/" + r[0].split("/", 1)[1]))
        rule_of[host, path] = next(fits, None)
    count = {}  # branch: bad and all labels of the judging half, then of the merging half
    for k, ids in paths.items():
        own = [(known[i], i in merging) for i in ids if i in known]
        if rule_of[k] is None and own:
            for n in range(len(parts[k]) + 1):
                c = count.setdefault((k[0], *parts[k][:n]), [0, 0, 0, 0])
                for bad, merges in own:
                    c[2 * merges] += bad
                    c[2 * merges + 1] += 1
    hosts = [n for n in count if len(n) == 1]
    whole = [sum(count[n][i] + count[n][i + 2] for n in hosts) for i in (0, 1)]
    overall = whole[0] / whole[1] if whole[1] else None
    ratio = lambda a, b: a / b if b else overall
    weight = url_templates.SMOOTHING
    groups = {(n, None): [count[n][0], count[n][1], overall, len(hosts)] for n in hosts}
    group_of = {n: (n, None) for n in hosts}
    for n, c in count.items():
        if len(n) > 1:
            up = count[n[:-1]]
            drawn = (c[2] + weight * ratio(up[2], up[3])) / (c[3] + weight)
            group_of[n] = n[:-1], min(url_templates.BANDS - 1, math.floor(math.asin(math.sqrt(drawn)) * 2 * url_templates.BANDS / math.pi))
            g = groups.setdefault(group_of[n], [0, 0, ratio(up[0], up[1]), url_templates.BANDS])
            g[0], g[1] = g[0] + c[0], g[1] + c[1]
    apart = {}
    for n, g in group_of.items():
        bad, rows, p, rivals = groups[g]
        if rows:
            term = lambda a, b: (a * math.log(a / b) if b else math.inf) if a else 0.0
            if rows * (term(bad / rows, p) + term(1 - bad / rows, 1 - p)) >= math.log(rivals / url_templates.CHANCE):
                apart[n] = (bad + weight * p) / (rows + weight)
    out = []
    for k, ids in paths.items():
        if rule_of[k] is not None:
            verdict = rule_of[k][1]
        else:
            deepest = next((apart[n] for n in ((k[0], *parts[k][:m]) for m in range(len(parts[k]), -1, -1)) if n in apart), overall)
            verdict = "block" if (deepest or 0.0) >= 0.5 else "allow"
        out += [(-1 if i is None else i, verdict, k[0] + "/" + "/".join(parts[k])) for i in ids]
    return sorted(out)


def merging_ids(pages):
    return {r["page_id"] for r in pages.where(F.xxhash64("page_id") % 2 == 0).select("page_id").collect()}


def test_urls_match_a_tree_built_by_hand(spark):
    rng = random.Random(8)
    urls = []
    for i in range(1500):
        host = rng.choice(["big.com", "big.com", "mid.io", "a.example.net", "m.example.com", "x.org", f"tiny{i % 40}.de"])
        kind = rng.choice(["user", "news", "spam", "shop", "de", "fr"])
        tail = {"user": f"/{rng.choice(['alice', 'bob', 'eve', 'mallory']) + str(rng.randrange(60))}/photos/{i}", "news": f"/covid-19/{i}.html", "spam": f"/{rng.choice(['win', 'cash', 'pills'])}/{rng.randrange(300)}"}.get(kind, f"/p{rng.randrange(5)}")
        urls.append((i if i % 50 else None, f"http://{host}/{kind}{tail}" + rng.choice(["", "?q=1", "#x", "/"])))
    urls += [(5000, None), (5001, ""), (5002, "http://big.com"), (5003, "http://big.com/" + "deep/" * 300), (5004, "http://big.com/" + "x" * 50_000), (5004, "http://big.com/" + "x" * 50_000), (5005, "http://big.com/*/y")]
    labels = [(i, int(("spam" not in u) ^ (rng.random() < 0.1))) for i, u in urls if i is not None and u and rng.random() < 0.6]
    labels += [(1, 0), (1, 1), (None, 0), (2, None), (3, 7)]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    got = url_templates.judge_urls(pages, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = judged_by_hand(urls, labels, merging_ids(pages))
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["verdict"], r["template"]) for r in got) == want
    templates = {t for _, _, t in want}
    assert "big.com/user/*/photos/*" in templates and "big.com/news/covid-19/*" in templates and {v for _, v, _ in want} == {"allow", "block"}


def test_urls_wildcards_follow_the_values_not_their_looks(spark):
    names = ["alice", "bob", "carol", "dave", "erin", "frank", "grace", "heidi", "ivan", "judy"]
    urls = [*(f"http://h.com/u/{n}/x" for n in names), *(f"http://h.com/t/{w}/x{k}" for w in ("deadbeef", "2024-news", "covid-19") for k in range(3))]
    got = url_templates.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["template"] for r in got.collect()} == {"h.com/u/*/x", *(f"h.com/t/{w}/x{k}" for w in ("deadbeef", "2024-news", "covid-19") for k in range(3))}


def test_like_siblings_are_merged(spark):
    # node, judging bad and rows, merging bad and rows: b and c are alike in the merging half, d by its parent for want of labels
    rows = [(1, 1, 10, 0, 30), (2, 3, 9, 29, 30), (3, 4, 4, 58, 60), (4, 1, 2, 0, 0), (5, 2, 8, 9, 30)]
    counted = spark.createDataFrame([(7, *r, 0.3) for r in rows], "parent long, node long, bad long, rows long, merge_bad long, merge_rows long, above double")
    got = {r["node"]: (r["group_bad"], r["group_rows"]) for r in url_templates.merge_siblings(counted).collect()}
    assert got == {1: (1, 10), 2: (7, 13), 3: (7, 13), 4: (3, 10), 5: (3, 10)}


def test_noise_blocks_nothing_and_planted_sections_are_found(spark):
    pages, labels = [], []
    for seed in range(10):
        rng = random.Random(seed)
        for section in range(61):
            for k in range(80):
                i = len(pages)
                pages.append((i, f"http://seed{seed}.com/s{section}/{k}x{rng.randrange(10**9)}"))
                if section == 60 and k < 24:
                    labels.append((i, int(rng.random() < 0.05)))
                elif k < 2:
                    labels.append((i, int(rng.random() >= 0.3)))
    got = url_templates.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    noise = [r["verdict"] for r in got if "/s60/" not in r["path"]]
    planted = [r["verdict"] for r in got if "/s60/" in r["path"]]
    assert noise.count("block") < 0.05 * len(noise) and planted.count("block") >= 0.9 * len(planted)


def test_very_deep_urls_take_seconds(spark):
    deep = "http://h.com/" + "/".join(f"s{k % 7}" for k in range(100_000))
    shared = [(10 + k, "http://g.com/" + "d/" * 3000 + f"{k}/x") for k in range(12)]
    pages = spark.createDataFrame([(1, deep), (2, deep + "/x"), *shared], "page_id long, url string")
    began = time.perf_counter()
    got = url_templates.judge_urls(pages, spark.createDataFrame([(1, 1), (10, 0), (11, 1)], "doc_id long, quality int")).collect()
    assert time.perf_counter() - began < 60 and len(got) == 14
    assert all(r["template"] == "g.com/" + "d/" * 3000 + "*/x" for r in got if r["page_id"] >= 10)


def test_pipeline_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= start
    kept = docs.select("doc_id", "text").collect()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert pieces["length"].sum() == sum(len(ids_of(BYTE, r["text"])) + 1 for r in kept)
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)
