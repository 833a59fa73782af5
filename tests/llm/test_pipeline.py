"""Every stage of the corpus pipeline against plain Python, on rows with planted cases and awkward ones."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidalframe.llm import mixing, queries, toxicity
from tidalframe.llm.line_dedup import PASSAGE_RUN, PASSAGE_UNIT
from tidalframe.llm.toxicity import FADING

from test_near_copies import WORD, components, sets_of, units_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """Documents: clean ones, toxic ones (plain and disguised), near copies, shared passages, and odd rows; and labels for most."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    passage = " ".join(f"shared{i}" for i in range(60)) + "."
    rows, labels = [], []
    for i in range(240):
        n = rng.randint(60, 160)
        w = [rng.choice(words) for _ in range(n + 2 if n % 15 in (1, 2) else n)]  # no line is too short to have a digest of its own
        toxic = i % 5 == 1
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["grobnik", "vilescum", "gr0bnik", "v-i-l-e-s-c-u-m"] if i > 100 else ["grobnik", "vilescum"])
        text = "\n".join(" ".join(w[k : k + 15]) for k in range(0, len(w), 15))
        if i % 20 == 3:
            text += f"\n{passage}\nEnd of {i}."
        rows.append((i, text, "en", ["big", "big", "mid", None, "tiny"][rng.randrange(5)], len(text)))
        if i % 7:
            labels.append((i, 1, int(toxic)))
    for i in range(300, 340):  # near copies of clean documents
        w = rows[(i - 300) * 5][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en", "copies", 9))
    odd = [(None, "text without an id", "en", "big", 18), (500, None, None, None, None), (501, "", "en", "mid", 0), (502, " \n", "en", "mid", 2), (503, "twice the same row here", "en", "mid", 23), (503, "twice the same row here", "en", "mid", 23), (504, "long " * 4000, "en", "tiny", 20000)]
    return [*rows, *odd], [*labels, (None, 1, 1), (503, 0, 0), (9999, 1, 1)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, labels = planted()
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return rows, labels, str(folder)


def applied(spark, stage, rows, folder):
    """A stage on rows with columns whose names may clash with its own."""
    docs = spark.createDataFrame(rows, SCHEMA)
    for clash in ("score", "row", "place", "size"):
        docs = docs.withColumn(clash, F.lit("x"))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    return out


def as_rows(out):
    return [tuple(r)[:5] for r in out.collect()]


def test_toxicity_stage_keeps_what_the_model_by_hand_accepts(spark, corpus):
    rows, labels, folder = corpus
    docs, tagged = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, tagged)

    def score(text):
        lower = (text or "").lower()
        runs = toxicity.spelt_out(lower)
        tokens = [*lower.split(), *(t for run in runs for t in toxicity.spelt_words(run, model.letters))]
        marks = dict(m for m in map(model.weigh, set(tokens)) if m[1])
        total = sum(w * FADING**k for k, w in enumerate(sorted(marks.values(), reverse=True)))
        return 1 / (1 + math.exp(-(model.intercept + model.slope * total)))

    want = Counter(r for r in rows if score(r[1]) < 0.5)
    got = applied(spark, "toxicity", rows, folder)
    assert got.columns[-4:] == ["score", "row", "place", "size"] and Counter(as_rows(got)) == want
    gone = {r[0] for r in rows} - {r[0] for r in want}
    assert {i for i in range(240) if i % 5 == 1} - gone == set() and len(gone) < 60


def test_near_copies_stage_keeps_one_of_each_group(spark, corpus):
    rows, _, folder = corpus
    got = as_rows(applied(spark, "ngram_jaccard_join", rows, folder))
    s = sets_of([r[:2] for r in rows])
    root = components(list(range(len(rows))), lambda i, j: (rows[i][0] == rows[j][0] and rows[i][1] == rows[j][1]) or (bool(s[i]) and bool(s[j]) and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])))
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i])
    left = Counter(got)
    assert len(got) == len(groups) and all(sum(left[r] for r in set(own)) == 1 for own in groups.values())
    assert all(min((r[0] for r in own if r[0] is not None), default=None) in {g[0] for g in got} for own in groups.values())


def test_substring_stage_removes_later_passages(spark, corpus):
    rows, _, folder = corpus
    rows = [r for r in rows if r[0] != 503]
    got = as_rows(applied(spark, "substring_dedup", rows, folder))
    text = {r[0]: r[1] for r in got}
    assert len(got) == len(rows)
    seen, want = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        units = units_by_hand(t)
        again = [u[2] in seen and len(u[2]) >= PASSAGE_UNIT for u in units]
        kept, k = [], 0
        while k < len(units):
            end = k
            while end < len(units) and again[end]:
                end += 1
            if sum(len(u[2]) for u in units[k:end]) >= PASSAGE_RUN:
                k = end
                continue
            kept += [u[2] for u in units[k : max(end, k + 1)]]
            k = max(end, k + 1)
        seen |= {u[2] for u in units}
        want[i] = [w for u in kept for w in u]
    lower = {c: c + 32 for c in range(65, 91)}
    for i, words in want.items():
        if i is None or i != 504:  # one line of one repeated word: its own units of a few words are neighbours' too
            assert [w.translate(lower) for w in WORD.findall(text[i] or "")] == words, i
    changed = {r[0] for r in rows if text[r[0]] != r[1]}
    assert {i for i in range(240) if i % 20 == 3 and i > 3} <= changed and 3 not in changed
    assert all(r[4] == len(r[1]) for r in got if r[0] in changed)


def test_mixing_stage_meets_the_targets_by_whole_documents(spark, corpus):
    rows, _, folder = corpus
    got = Counter(as_rows(applied(spark, "mixing", rows, folder)))
    size = lambda t: len(WORD.findall(t or ""))
    plan = {}
    for r in mixing.mix_plan(spark.createDataFrame(rows, SCHEMA)).collect():
        plan.setdefault(r["doc_id"], []).append((r["size"], r["taken"]))
    copies = Counter(rows)
    for r, n in copies.items():
        if size(r[1]):
            assert got[r] * size(r[1]) == n * plan[r[0]][0][1], r[0]
    totals, of = Counter(), {}
    for r in rows:
        totals[r[3]] += size(r[1])
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, budget, target = set(order), 1.5 * sum(totals.values()), {}
    while left:  # water-filling: sources over their cap are set to it, the rest share what is left
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * totals[s]}
        if not full:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 2 * totals[s] for s in full}
        budget -= sum(target[s] for s in full)
        left -= full
    for r, n in got.items():
        of[r[3]] = of.get(r[3], 0) + n * size(r[1])
    longest = {s: max(size(r[1]) for r in rows if r[3] == s) for s in order}
    assert all(abs(of.get(s, 0) - target[s]) <= longest[s] for s in order) and max(got[r] / copies[r] for r in got) <= 2


def test_packing_stage_has_every_token_once(spark, corpus):
    rows, _, folder = corpus
    got = applied(spark, "best_fit_packing", rows, folder).toPandas()
    tokenizer = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        at = 0
        for piece in range(-(-len(ids) // 2048)):
            n = cut if piece == 0 else 2048
            want[-1 if i is None else i, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
    assert Counter(tuple(int(v) for v in r) for r in got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 2048
    free = sorted(2048 - got.groupby("sequence_id")["length"].sum())
    assert len(free) < 2 or free[-1] + free[-2] <= 2048 + max(got["length"])  # no two sequences stay half empty but the last ones


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, corpus, stage):
    out = applied(spark, stage, [], corpus[2])
    assert out.count() == 0


def test_the_pipeline_is_its_stages_one_after_another(spark, corpus):
    folder = corpus[2]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    pieces = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, folder)) == pieces(last)
