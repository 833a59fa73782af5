"""Toxicity: noisy-channel restoration of disguised words, then a learnt lexicon of word stems.

A token that mixes letters with figures or signs, stretches letters, or is spelt out with spaces or
separators is decoded: each character offers the letters it may stand for (the lattice), and the
Viterbi path under a character trigram model of the training texts is the restored word.  A run of
single characters may hold several words: known words and the trigram model place their bounds.  Words and
their opening letters that mark toxic texts are learnt from labelled documents by a likelihood-ratio
test; a document's score is a logistic function of the weights of its distinct marked words.

All labelled documents are learnt from: words, letters and stems are counted where the texts are, summed by
shuffles, and the logistic function is fitted by Newton steps that are one aggregate each.  What workers get is
bounded by the alphabet (trigrams), by the tests (stems) and by the runs that need bounds (known words).
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import chunks, flatten, word_bounds
from .storage import discard, settle
from .workers import bounded_batches, lean

#: What figures and signs may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = "-_.*'~^,:;/#%&"
#: Costs of the channel, in nats.
SUBSTITUTE, SEPARATE, STRETCH, DOUBLE = 1.0, 0.5, 0.3, 2.0
#: Labels that are sent to every task at most, so that unlabelled texts needn't be shuffled; more are joined by a shuffle.
SENT_LABELS = 1_000_000
#: A stem needs this likelihood ratio (G squared), this share of toxic texts, and this many of them.
LEAST_G2, LEAST_PURITY, LEAST_TEXTS = 16.0, 0.8, 3
STEM_LENGTHS = (4, 5, 6)
#: What each further marked stem of a text counts of the one before, by weight.
FADING = 0.3
#: Tokens, and steps of the lattice, that a worker remembers.
KEPT_TOKENS, KEPT_MOVES = 300_000, 30_000
#: Rows that a worker sends on at once.
SENT_ROWS = 100_000
#: Letters from which known words are found by one automaton instead of by their lengths; the result is the same.
LONG_RUN = 500

#: Signs at the start and at the end of a token that may stand for letters.
OPENING, CLOSING = "_@$!|+(€", "_@$!€"
_ENDS = ".,;:?"  # signs that end words and stand for no letters
_THREE = re.compile(r"(.)\1\1")
_PLAIN = re.compile(r"[^\W\d_]+")
_SPELT = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_SEPARATED = re.compile(rf"[^\W_](?:[{re.escape(SEPARATORS)}]+[^\W_]){{2,}}")
_TWO_SIGNS = rf"[{re.escape(SEPARATORS)}].+[{re.escape(SEPARATORS)}]"  # of every token that holds separated letters


@dataclass
class CharModel:
    """A character trigram model with add-constant smoothing over backed-off bigrams, and the log shares of known words."""

    three: dict[str, float] = field(default_factory=dict)
    two: dict[str, float] = field(default_factory=dict)
    floor: float = -7.0
    words: dict[str, float] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    moves: dict[tuple[str, str], tuple[float, str]] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "finder"} | {"moves": {}}  # each worker fills its own

    @staticmethod
    def fit(words: Counter[str]) -> "CharModel":
        three: Counter[str] = Counter()
        for word, n in words.items():
            for gram in _trigrams(word):
                three[gram] += n
        return CharModel.of_trigrams(three).knowing(words, sum(words.values()))

    def knowing(self, words: dict[str, int], all_words: int) -> "CharModel":
        """The same letters with the log shares of words, given their counts and that of all words."""
        known = {w: math.log(n / all_words) for w, n in words.items()}
        return CharModel(self.three, self.two, self.floor, known, sorted(set(map(len, known))))

    @staticmethod
    def of_trigrams(three: Counter[str]) -> "CharModel":
        """The model of counted trigrams, without known words."""
        two: Counter[str] = Counter()
        one: Counter[str] = Counter()
        for x, n in three.items():
            two[x[1:]] += n
            one[x[2]] += n
        whole = sum(one.values()) or 1
        one_p = {c: n / whole for c, n in one.items()}
        before: Counter[str] = Counter()
        for x, n in two.items():
            before[x[0]] += n
        two_p = {x: (n + 5 * one_p[x[1]]) / (before[x[0]] + 5) for x, n in two.items()}
        pairs: Counter[str] = Counter()
        for x, n in three.items():
            pairs[x[:2]] += n
        three_l = {x: math.log((n + 5 * two_p[x[1:]]) / (pairs[x[:2]] + 5)) for x, n in three.items()}
        return CharModel(three_l, {x: math.log(p) for x, p in two_p.items()})

    def step(self, context: str, letter: str) -> float:
        found = self.three.get(context + letter)
        if found is not None:
            return found
        found = self.two.get(context[1] + letter)
        return self.floor if found is None else max(found - 1.0, self.floor)

    def move(self, context: str, letters: str) -> tuple[float, str]:
        """The score of letters after a context of two, and the context after them."""
        found = self.moves.get((context, letters))
        if found is None:
            now, value = context, 0.0
            for letter in letters:
                value += self.step(now, letter)
                now = now[1] + letter
            if len(self.moves) > KEPT_MOVES:
                self.moves.clear()
            found = self.moves[context, letters] = (value, now)
        return found

    @functools.cached_property
    def finder(self) -> ahocorasick.Automaton:
        """Finds all known words in a text, with their lengths and log shares."""
        out = ahocorasick.Automaton()
        for word, share in self.words.items():
            out.add_word(word, (len(word), share))
        if self.words:
            out.make_automaton()
        return out


def _trigrams(word: str) -> Iterator[str]:
    padded = f"^^{word}$"
    return (padded[i - 2 : i + 1] for i in range(2, len(padded)))


@functools.lru_cache(4096)
def _options(c: str, n: int) -> tuple[tuple[str, float], ...]:
    """What n of a character in a row, three standing for more, may stand for, and the cost."""
    options: list[tuple[str, float]] = []
    for letter, cost in [(c, 0.0)] if c.isalpha() else [(x, SUBSTITUTE) for x in LEET.get(c, "")]:
        if n == 1:
            options.append((letter, cost))
        elif n == 2:
            options += [(letter * 2, 2 * cost), (letter, cost + DOUBLE)]
        else:
            options += [(letter, cost + STRETCH), (letter * 2, 2 * cost + STRETCH + DOUBLE / 2)]
    if c in SEPARATORS or not options:
        options.append(("", SEPARATE if c in SEPARATORS else 3.0))
    return tuple(options)


def restore(token: str, model: CharModel) -> str:
    """The most likely word behind a token, by Viterbi over its lattice; states are the last two letters."""
    states: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
    for c, same in itertools.groupby(token):
        options = _options(c, min(3, sum(1 for _ in same)))
        new: dict[str, tuple[float, tuple]] = {}
        for context, (score, path) in states.items():
            for letters, cost in options:
                gain, now = model.move(context, letters)
                value = score - cost + gain
                if now not in new or value > new[now][0]:
                    new[now] = (value, (path, letters))
        states = new
    _, path = max(((score + model.step(context, "$"), path) for context, (score, path) in states.items()), key=lambda x: x[0])
    return _joined(path)


def _joined(path: tuple) -> str:
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def split_words(letters: str, model: CharModel) -> list[str]:
    """The most likely words of letters written without bounds; a word is a known one or has its trigram score."""
    if len(letters) > LONG_RUN:
        return _split_long(letters, model)
    ended = [(0.0, 0)]  # of each place: the best score with a word's end there, and where that word starts
    inside: tuple[float, int] | None = None  # the best open word of two letters or more: score and start
    opened: tuple[float, int] | None = None  # the word that the letter before opened
    for at, letter in enumerate(letters, 1):
        grown = [(w[0] + model.step(context, letter), w[1]) for w, context in ((inside, letters[at - 3 : at - 1]), (opened, f"^{letters[at - 2 : at - 1]}")) if w]
        inside = max(grown) if grown else None
        opened = (ended[at - 1][0] + model.step("^^", letter), at - 1)
        ends = [(w[0] + model.step(context, "$"), w[1]) for w, context in ((inside, letters[at - 2 : at]), (opened, f"^{letter}")) if w]
        for length in model.lengths:
            if length > at:
                break
            share = model.words.get(letters[at - length : at])
            if share is not None:
                ends.append((ended[at - length][0] + share, at - length))
        ended.append(max(ends))
    out, at = [], len(letters)
    while at:
        out.append(letters[ended[at][1] : at])
        at = ended[at][1]
    return out[::-1]


def _split_long(letters: str, model: CharModel) -> list[str]:
    """split_words with each known word found once in one pass, and each score of three letters looked up once."""
    score = functools.cache(model.step)
    known: list[list[tuple[int, float]] | None] = [None] * (len(letters) + 1)
    if model.words:
        for last, word in model.finder.iter(letters):
            if known[last + 1] is None:
                known[last + 1] = []
            known[last + 1].append(word)
    best, begun = [0.0] * (len(letters) + 1), [0] * (len(letters) + 1)
    none = -math.inf
    inside, inside_at, opened, opened_at = none, 0, none, 0
    two, one = "^^", "^"  # the two letters before, the one before
    for at, letter in enumerate(letters, 1):
        if inside > none:
            inside += score(two, letter)
        if opened > none:
            grown = opened + score("^" + one, letter)
            if (grown, opened_at) > (inside, inside_at):
                inside, inside_at = grown, opened_at
        opened, opened_at = best[at - 1] + score("^^", letter), at - 1
        two, one = one + letter, letter
        top, top_at = opened + score("^" + letter, "$"), opened_at
        if inside > none:
            end = inside + score(two, "$")
            if (end, inside_at) > (top, top_at):
                top, top_at = end, inside_at
        for length, share in known[at] or ():
            end = best[at - length] + share
            if (end, at - length) > (top, top_at):
                top, top_at = end, at - length
        best[at], begun[at] = top, top_at
    out, at = [], len(letters)
    while at:
        out.append(letters[begun[at] : at])
        at = begun[at]
    return out[::-1]


def _stripped(token: str, opening: str = "", closing: str = "") -> str:
    """A token without its outer signs but those named; from each end once, whatever the length."""
    first, last = 0, len(token)
    while first < last and not (token[first].isalnum() or token[first] in opening):
        first += 1
    while last > first and not (token[last - 1].isalnum() or token[last - 1] in closing):
        last -= 1
    return token[first:last]


def _untailed(token: str) -> str:
    """A token without the repeats of one sign that it ends in."""
    end = token[-2:]
    return token.rstrip(end[0]) if len(end) == 2 and end[0] == end[1] and not (end[0].isalnum() or end[0] == "_") else token


def suspicious(token: str) -> bool:
    """Whether a lower-cased token, cut to its likely word, looks disguised."""
    return any(c.isalpha() for c in token) and (not _PLAIN.fullmatch(token) or re.search(r"(.)\1\1", token) is not None)


def readings(token: str, model: CharModel) -> list[str]:
    """The words that a lower-cased token may be: as written without its outer signs, and restored."""
    bare = token.rstrip(_ENDS)
    if bare.isalpha() and not _THREE.search(bare):  # a plain word, as most are: neither form of it is disguised
        return [bare]
    bare = _stripped(token)
    out = [bare] if bare else []
    for form in _disguised(token, bare):
        out.append(restore(form, model))
        if _SEPARATED.fullmatch(form):
            out += split_words(out[-1], model)
    return out


def _disguised(token: str, bare: str) -> list[str]:
    """The forms of a token that are restored."""
    inner = _stripped(_untailed(token), OPENING, CLOSING)
    return [form for form in {inner, bare} if len(form) >= 3 and suspicious(form)] if inner != bare or suspicious(bare) else []


def spelt_out(text: str) -> list[str]:
    """Runs of single characters with white space between them, each joined; a run may be several words."""
    return ["".join(m.group().split()) for m in _SPELT.finditer(text)]


def spelt_words(run: str, model: CharModel) -> list[str]:
    """A joined run as one word, and the words that it is most likely made of."""
    return [run, *(w for word in dict.fromkeys(readings(run, model)) for w in split_words(word, model))]


def unbounded_letters(lower: str, tokens: list[str], model: CharModel) -> set[str]:
    """The letters of a lower-cased text, and of its tokens, that split_words bounds; all else that it is given is a part of them."""
    out = {restore(form, model) for token in tokens for form in _disguised(token, _stripped(token)) if _SEPARATED.fullmatch(form)}
    for run in spelt_out(lower):
        bare = _stripped(run)
        out |= {bare, *(restore(form, model) for form in _disguised(run, bare))}
    return out


@dataclass
class ToxicModel:
    letters: CharModel
    stems: dict[str, float]
    slope: float = 1.0
    intercept: float = -3.0

    def weigh(self, token: str) -> tuple[str, float]:
        """The marked stem of a token with the greatest weight; none is ("", 0)."""
        best = ("", 0.0)
        for word in readings(token, self.letters):
            for stem in _stems(word):
                weight = self.stems.get(stem, 0.0)
                if weight > best[1]:
                    best = (stem, weight)
        return best


def _stems(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in STEM_LENGTHS if len(word) >= n)]


def fit(rows: list[tuple[str, int]], prior: float | None = None) -> ToxicModel:
    """Learn from (text, label 0 or 1); prior is the share of toxic texts where it differs from that of the rows.

    Stems are counted in toxic texts first; only those that enough of them hold are counted in the rest.
    """
    number: dict[str, int] = {}
    own_tokens = lambda tokens: np.fromiter({number.setdefault(t, len(number)) for t in tokens}, np.int32)
    held, spelt = [], {}
    for i, (text, label) in enumerate(rows):
        lower = (text or "").lower()
        if runs := spelt_out(lower):
            spelt[i] = runs
            lower = _SPELT.sub(" ", lower)  # its single characters aren't words
        held.append((own_tokens(set(lower.split())), label))
    texts_with = np.bincount(np.concatenate([h for h, _ in held]), minlength=len(number)) if number else []
    words: Counter[str] = Counter()
    for token, n in zip(number, texts_with, strict=True):
        bare = _stripped(token)
        if _PLAIN.fullmatch(bare) and not re.search(r"(.)\1\1", bare):
            words[bare] += int(n)
    letters = CharModel.fit(words)
    for i, runs in spelt.items():
        own, label = held[i]
        held[i] = (np.union1d(own, own_tokens({w for run in runs for w in spelt_words(run, letters)})).astype(np.int32), label)
    listed = list(number)
    positive: Counter[str] = Counter()
    for own, label in held:
        if label:
            positive.update({s for i in own for w in readings(listed[i], letters) for s in _stems(w)})
    positive = Counter({s: n for s, n in positive.items() if n >= LEAST_TEXTS})
    stems_of = {}
    for i, token in enumerate(listed):
        if found := [s for w in readings(token, letters) for s in _stems(w) if s in positive]:
            stems_of[i] = found
    negative: Counter[str] = Counter()
    for own, label in held:
        if not label:
            negative.update({s for i in own for s in stems_of.get(int(i), ())})
    n1, n0 = sum(label for _, label in rows), sum(1 - label for _, label in rows)
    stems = {stem: weight for stem, a in positive.items() if (weight := stem_weight(a, negative[stem], n1, n0)) is not None}
    best = {i: (s, stems[s]) for i, own in stems_of.items() if (s := max(own, key=lambda x: stems.get(x, 0.0))) in stems}
    marks = np.array([model_mark(dict(best[i] for i in own.tolist() if i in best)) for own, _ in held] or [0.0])
    truth = np.array([label for _, label in held] or [0], float)

    def sums(intercept: float, slope: float) -> list[float]:
        p = 1 / (1 + np.exp(-np.clip(intercept + slope * marks, -30, 30)))
        w = p * (1 - p)
        return [float(x.sum()) for x in (p - truth, marks * (p - truth), w, marks * w, marks * marks * w)]

    return calibrated(ToxicModel(letters, stems), sums, n1, n0, prior)


def stem_weight(a: int, b: int, n1: int, n0: int) -> float | None:
    """The weight of a stem in a of n1 toxic texts and b of n0 others; None if it marks none."""
    if a < LEAST_TEXTS or not n0 or not n1:
        return None
    rate1, rate0 = a / n1, b / n0
    if rate1 / (rate1 + rate0) < LEAST_PURITY:
        return None
    whole = (a + b) / (n1 + n0)
    g2 = 2 * (a * math.log(rate1 / whole) + (b * math.log(rate0 / whole) if b else 0.0))
    for hit, size in ((a, n1), (b, n0)):
        if hit < size:
            g2 += 2 * (size - hit) * math.log((1 - hit / size) / (1 - whole))
    return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)) if g2 >= LEAST_G2 else None


def calibrated(model: ToxicModel, sums: Callable[[float, float], list[float]], n1: int, n0: int, prior: float | None) -> ToxicModel:
    """The model with its logistic function, by Newton steps of a ridge regression on the marks of n1 toxic texts and n0 others.

    sums(intercept, slope) adds up p - label, mark (p - label), w, mark w and mark mark w over the texts, w being p (1 - p).
    """
    beta = np.zeros(2)
    for _ in range(30):
        g0, g1, h00, h01, h11 = sums(*map(float, beta))
        change = np.linalg.solve(np.array([[h00, h01], [h01, h11]]) + 0.1 * np.eye(2), np.array([g0, g1]) + 0.1 * beta)
        beta -= change
        if np.abs(change).max() < 1e-12:
            break
    model.intercept, model.slope = float(beta[0]), float(max(beta[1], 0.0))
    if prior is not None and 0 < prior < 1 and n0 and n1:
        model.intercept += math.log(prior / (1 - prior)) - math.log(n1 / n0)
    return model


def model_mark(weights: dict[str, float] | dict[int, float]) -> float:
    """The weights of distinct stems, the greatest in full and each next by FADING less: all count, few decide."""
    return sum(w * FADING**k for k, w in enumerate(sorted(weights.values(), reverse=True)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the labels that may be learnt from: 1 for a doc_id with any row of 1."""
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    return usable.groupBy("doc_id").agg(F.max(label).alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, label) of all labelled documents that aren't held out; of texts that share a doc_id the one of the least hash.

    Where asked for, at most `most` of them, at most half of each label, in a fixed order; and of these only whole texts
    until they have most_bytes together.
    """
    usable = usable_labels(labels, label)
    if most is not None:
        picked = [usable.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for value in (0, 1)]
        usable = picked[0].unionByName(picked[1])
    own = docs.select("doc_id", "text").where(~held_out())
    rows = own.join(F.broadcast(usable) if usable.limit(SENT_LABELS + 1).count() <= SENT_LABELS else usable, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    if most_bytes is not None:
        taken = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
        rows = rows.withColumn("taken", taken).where(F.col("taken") <= most_bytes // 2)
    return rows.select("doc_id", "text", "label")


def _scorer(model, keep_text: bool = False) -> Callable:
    known: dict[str, tuple[int, float]] = {}
    numbers: dict[str, int] = {}

    def mark(token: str, own: ToxicModel) -> tuple[int, float]:
        found = known.get(token)
        if found is None:
            stem, weight = own.weigh(token)
            found = known[token] = (numbers.setdefault(stem, len(numbers)) if weight else -1, weight)
        return found

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for table in chunks(batches):
            if len(known) > KEPT_TOKENS:
                known.clear()
            texts = table["text"].combine_chunks().fill_null("")
            lower = pc.utf8_lower(texts).cast(pa.large_string())
            split = pc.utf8_split_whitespace(lower)
            bounds = split.offsets.to_numpy()
            words = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            at = words.indices.to_numpy()
            marks = [mark(t, own) for t in words.dictionary.to_pylist()]
            stem = np.array([m[0] for m in marks] or [-1])
            weight = np.array([m[1] for m in marks] or [0.0])
            hits = np.flatnonzero(stem[at] >= 0) if len(at) else np.zeros(0, np.int64)
            found: dict[int, dict[int, float]] = {}
            for d, i in zip(doc[hits].tolist(), at[hits].tolist(), strict=True):
                found.setdefault(d, {})[int(stem[i])] = float(weight[i])
            for d in _spelt(lower):
                for joined in spelt_out(lower[d].as_py()):
                    for token in spelt_words(joined, own.letters):
                        number, value = mark(token, own)
                        if number >= 0:
                            found.setdefault(d, {})[number] = value
            total = np.zeros(len(texts))
            for d, stems in found.items():
                total[d] = model_mark(stems)
            score = 1 / (1 + np.exp(-np.clip(own.intercept + own.slope * total, -30, 30)))
            keep = [c for c in table.schema.names if keep_text or c != "text"]
            yield from table.select(keep).append_column("score", pa.array(score)).combine_chunks().to_batches()

    return run


def _spelt(texts: pa.Array) -> list[int]:
    """Numbers of texts with at least three words of one character in a row."""
    data, offsets = flatten(texts)
    starts, ends, docs = word_bounds(data, offsets)
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
    single = (ends - starts) == width
    three = single[:-2] & single[1:-1] & single[2:] & (docs[:-2] == docs[2:]) if len(single) > 2 else np.zeros(0, bool)
    return np.unique(docs[:-2][three]).tolist() if len(three) else []


@lean
def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, distinct tokens, joined runs) of (text, label); the single characters of runs aren't tokens."""
    for table in chunks(batches):
        lower = pc.utf8_lower(table["text"].combine_chunks().fill_null("")).cast(pa.large_string())
        runs: list[list[str]] = [[] for _ in range(len(lower))]
        if spelt := _spelt(lower):
            texts = lower.to_pylist()
            for d in spelt:
                runs[d], texts[d] = spelt_out(texts[d]), _SPELT.sub(" ", texts[d])
            lower = pa.array(texts, pa.large_string())
        split = pc.utf8_split_whitespace(lower)
        bounds = split.offsets.to_numpy()
        words = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        filled = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)
        at = words.indices.to_numpy()
        both = np.unique((np.repeat(np.arange(len(lower)), np.diff(bounds)) * len(filled) + at)[filled[at]])  # each token of a text once
        doc, at = np.divmod(both, max(len(filled), 1))
        tokens = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(lower) + 1)), pa.int32()), words.dictionary.take(pa.array(at)).cast(pa.string()))
        columns = [table["label"].combine_chunks(), tokens, pa.array(runs, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "tokens", "runs"])


@lean
def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of (token, n): tokens that are a word but for their outer signs."""
    for batch in batches:
        words = [_stripped(t) for t in batch.column(0).to_pylist()]
        kept = [bool(_PLAIN.fullmatch(w)) and not re.search(r"(.)\1\1", w) for w in words]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(1)], names=["word", "n"]).filter(pa.array(kept, pa.bool_()))


@lean
def _counted_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    three: Counter[str] = Counter()
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for gram in _trigrams(word):
                three[gram] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(three), pa.string()), pa.array(list(three.values()), pa.int64())], names=["gram", "n"])


def _pieces(shared, lengths: list[int]) -> Callable:
    """The parts, of the lengths that words have, of all letters in (text) that need bounds."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pieces: set[str] = set()
        for table in chunks(batches):
            lower = pc.utf8_lower(table["text"].combine_chunks().fill_null("")).cast(pa.large_string())
            words = pc.utf8_split_whitespace(lower).flatten().unique()
            letters = unbounded_letters("", words.filter(pc.match_substring_regex(words, _TWO_SIGNS)).to_pylist(), model)
            for d in _spelt(lower):
                letters |= unbounded_letters(lower[d].as_py(), [], model)
            for own in letters:
                for length in lengths:
                    for at in range(len(own) - length + 1):
                        pieces.add(own[at : at + length])
                        if len(pieces) >= SENT_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string())], names=["word"])
                            pieces.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string())], names=["word"])

    return run


def _numbered(batch: pa.RecordBatch) -> tuple[list[int], list[str], np.ndarray, np.ndarray, list[list[str]]]:
    """Of (label, tokens, runs): labels, distinct tokens, the number of each text's tokens in turn, the bounds between texts, runs."""
    bounds, flat = batch.column(1).offsets.to_numpy(), batch.column(1).flatten().dictionary_encode()
    return batch.column(0).to_pylist(), flat.dictionary.to_pylist(), flat.indices.to_numpy(), bounds - bounds[0], batch.column(2).to_pylist()


def _counted_stems(shared) -> Callable:
    """(stem, a, b): toxic texts and others that hold a stem, a few rows a stem and task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = shared.value
        number: dict[str, int] = {}
        known: dict[str, tuple[int, ...]] = {}
        n = np.zeros((2, SENT_ROWS), np.int64)  # of each stem, in other texts and in toxic ones

        def own(token: str) -> tuple[int, ...]:
            found = known.get(token)
            if found is None:
                found = known[token] = tuple(number.setdefault(s, len(number)) for w in readings(token, letters) for s in _stems(w))
            return found

        def counted() -> pa.RecordBatch:
            of = n[:, : len(number)]
            return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(of[1]), pa.array(of[0])], names=["stem", "a", "b"])

        for batch in batches:
            labels, tokens, at, bounds, runs = _numbered(batch)
            stems = [own(t) for t in tokens]
            for d, label in enumerate(labels):
                held = set().union(*[stems[i] for i in at[bounds[d] : bounds[d + 1]].tolist()], *[own(w) for joined in runs[d] for w in spelt_words(joined, letters)])
                if len(number) > n.shape[1]:
                    n = np.concatenate([n, np.zeros((2, len(number)), np.int64)], 1)
                n[label, list(held)] += 1
            if max(len(number), len(known)) > KEPT_TOKENS:
                yield counted()
                number.clear()
                known.clear()
                n[:] = 0
        yield counted()

    return run


def _counted_marks(shared) -> Callable:
    """(mark, label, n) of (label, tokens, runs)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[str, tuple[str, float]] = {}

        def weighed(token: str) -> tuple[str, float]:
            found = known.get(token)
            if found is None:
                found = known[token] = model.weigh(token)
            return found

        for batch in batches:
            if len(known) > KEPT_TOKENS:
                known.clear()
            labels, tokens, at, bounds, runs = _numbered(batch)
            weights = [weighed(t) for t in tokens]
            hits = np.flatnonzero(np.array([w > 0 for _, w in weights], bool)[at])
            found: list[dict[str, float]] = [{} for _ in labels]
            for d, i in zip((np.searchsorted(bounds, hits, "right") - 1).tolist(), at[hits].tolist(), strict=True):
                found[d][weights[i][0]] = weights[i][1]
            for d, own in enumerate(runs):
                found[d] |= {s: w for joined in own for s, w in map(weighed, spelt_words(joined, model.letters)) if w > 0}
            n = Counter(zip(map(model_mark, found), labels, strict=True))
            columns = [pa.array([m for m, _ in n], pa.float64()), pa.array([y for _, y in n], pa.int32()), pa.array(list(n.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "label", "n"])

    return run


def _mark_sums(marks: DataFrame) -> Callable[[float, float], list[float]]:
    """See calibrated(); sums of decimals, which come out alike however rows are dealt."""

    def sums(intercept: float, slope: float) -> list[float]:
        p = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(intercept) + F.lit(slope) * F.col("mark"), F.lit(-30.0)), F.lit(30.0))))
        miss, w, mark = p - F.col("label"), p * (1 - p), F.col("mark")
        terms = (miss, mark * miss, w, mark * w, mark * mark * w)
        return [float(x) for x in marks.agg(*[F.sum((F.col("n") * t).cast("decimal(38,15)")).alias(f"s{i}") for i, t in enumerate(terms)]).first()]

    return sums


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None, scored: DataFrame | None = None) -> ToxicModel:
    """The model of all labelled documents, or of at most sample_rows of them where that is given.

    Its known words are all words of those documents.  If the texts that are to be scored are given, and docs are among them, only
    those known words that letters without bounds in them may be made of are kept, as no other is ever looked up: scores are the same.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = training_rows(docs, labels, "toxic", sample_rows).select("text", F.col("label").cast("int").alias("label"))
    rows = settle(rows.mapInArrow(_tokens, "label int, tokens array<string>, runs array<string>"), "learnt")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    tokens = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    words = settle(tokens.mapInArrow(_plain_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    three = words.mapInArrow(_counted_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # by the alphabet
    letters = CharModel.of_trigrams(Counter({r["gram"]: r["n"] for r in three}))
    all_words = words.agg(F.sum("n")).first()[0]
    known = words
    if scored is not None:
        lengths = sorted(r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect())
        pieces = scored.select("text").mapInArrow(_pieces(spark.sparkContext.broadcast(letters), lengths), "word string")
        known = words.join(pieces.distinct(), "word", "left_semi")
    letters = letters.knowing({r["word"]: r["n"] for r in known.collect()}, all_words)
    counted = rows.mapInArrow(_counted_stems(spark.sparkContext.broadcast(letters)), "stem string, a long, b long")
    n1, n0 = size.get(1, 0), size.get(0, 0)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stem_weight(a, b, n1, n0) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["stem", "weight"])

    counted = counted.groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= LEAST_TEXTS)
    stems = counted.mapInArrow(weights, "stem string, weight double").where("weight is not null").collect()  # those that pass the tests
    model = ToxicModel(letters, {r["stem"]: r["weight"] for r in stems})
    if n1 and n0:
        marks = rows.mapInArrow(_counted_marks(spark.sparkContext.broadcast(model)), "mark double, label int, n long")
        marks = settle(marks.groupBy("mark", "label").agg(F.sum("n").alias("n")), "marks")
        calibrated(model, _mark_sums(marks), n1, n0, usable_labels(labels, "toxic").agg(F.avg("label")).first()[0])
        discard(marks)
    for done in (rows, words):
        discard(done)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    labels (doc_id, toxic) is used only for rows whose crc32(doc_id as text) mod 5 isn't 0, all of them
    unless sample_rows is given; a doc_id with labels of both kinds counts as toxic.  Null, empty and blank texts get the score of a text without marked words;
    without labels of both kinds that is below 0.5 for all.  A null doc_id is not held out.
    Repeated rows score alike.  Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample_rows, docs))
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """The rows of docs that toxicity() predicts 0 for, with all their columns, whatever their names."""
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)])
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample_rows, docs))
    shape = ", ".join(f"`{c}` {t}" for c, t in inner.dtypes)
    return inner.mapInArrow(_scorer(shared, True), f"{shape}, score double").where("score < 0.5").select(*inner.columns).toDF(*names)
