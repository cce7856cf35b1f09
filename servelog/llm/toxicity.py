"""Toxicity: a support vector machine over a subsequence string kernel, by Nyström landmarks.

The kernel counts the subsequences of letters that two strings share, a gap in either
lowers the weight, so ``i.d-i0t`` still resembles its plain form. Strings are the words
of a text, words broken by inserted characters, and spelled-out words (``t r a s h``).

Landmarks are words that stand in toxic texts far more often than in clean ones (telling
words) and their closest clean neighbours. A sentence's kernel with a landmark is the sum
over its words, of those near a telling word the nearest four; the machine is linear in the
landmarks' Nyström features. It learns from the sentences of labelled texts: of a toxic
text its worst sentence (chosen anew by the machine in rounds), of clean texts all
that have such words. A second machine holds the broken forms of telling words that no
clean text has against the same clean sentences, for one such word is enough.
When they score, words that speak against toxicity count as nothing. A text is toxic by its
four worst sentences or by its worst word: each has a logistic function of margins with
weights that are never negative, and the score is the chance that one of both holds.
So one phrase in a long clean text counts as much as in a short one, and a further
insult never lowers the score.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelog.llm.wordhash import blocks, hashed_words, mix, shingle_hashes
from servelog.session import cut

#: Bounds of the training sample: labelled texts per class, landmarks, negative words.
TEXTS_PER_CLASS = 6000
CANDIDATES = 160
LANDMARKS = 40
UNLIKE = 0.6  # a telling word is a landmark if it is less like all better ones
NEIGHBOURS = 64
SENTENCES = 3  # per labelled text, those nearest to telling words
ROUNDS = 4
RIDGE = 0.1
SUBSEQUENCE = 3
DECAY = 0.6
SHARPEN = 4  # kernel values are raised to this power: still a kernel, and closer to words
NEAR = 0.45  # a word counts if its kernel value with some telling word is this at least
SMALL = 1e-5  # sharpened values below this count as 0
LONGEST = 24
WINDOWS = (8, 12, 16, 24)  # about twice the lengths of landmarks
TELLING = 2.0  # standard errors by which a positive word's rates differ
SURE = 0.5  # part of the best standing that a word reaches if one of it is enough
WORST = 4
ENOUGH, ENOUGH_WORD = 3.0, 0.5  # larger margins of sentences and words say no more
TABLE = 1_000_000
_CACHE = 200_000
_CACHES: dict[str, dict] = {}
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_LETTER = re.compile(r"[^\W\d_]")
_PARTS = re.compile(r"[^\W\d_]{3,}")
_SIGNS = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
# Digits and signs that stand for letters.
_ALIKE = str.maketrans("0134578@$!|+", "oieastbasilt")


def units(token: str) -> list[str]:
    """Strings to compare for a white-space token: itself without outer signs, its runs of
    letters, itself with digits and signs read as letters, and windows of long ones in several widths, so that each landmark meets some
    of about twice its length; each at most ``LONGEST`` characters."""
    core = token.strip(string.punctuation)
    if core.isalpha() and len(core) <= LONGEST // 2:
        return [core] if len(core) >= SUBSEQUENCE else []
    core = _EDGES.sub("", core)
    plain = _SIGNS.sub("", core)
    read = _SIGNS.sub("", token.rstrip(".,;:!?\"')").translate(_ALIKE)) if _LETTER.search(core) else plain
    found = {core, plain, read, *_PARTS.findall(core)}
    out: set[str] = set()
    for one in found:
        if len(one) <= LONGEST:
            out.add(one)
        if len(one) > LONGEST // 2:
            for width in WINDOWS:
                out |= {one[i:i + width] for i in range(0, len(one) - width // 2, width // 2)}
    return sorted(u for u in out if len(u) >= SUBSEQUENCE)


def tokens_of(text: str | None) -> set[str]:
    """Distinct lower-case tokens of a whole text, spelled-out words joined."""
    if not text:
        return set()
    text = text.lower()
    found = set(text.split())
    if spelled := _SPELLED.findall(text):
        found.update(s.replace(" ", "") for s in spelled)
    return found


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    text = "".join(w[:width].ljust(width, "\0") for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(words), width).astype("int32")
    return np.where(codes == 0, pad, codes)


def subsequence_kernel(a: np.ndarray, b: np.ndarray, size: int = SUBSEQUENCE,
                       decay: float = DECAY) -> np.ndarray:
    """Kernel of row i of ``a`` with row i of ``b`` (codes, padded with unlike numbers).

    ``inner[i, x, y]`` sums the shared subsequences of one letter less that end before x
    and y, each weighted by ``decay`` to the lengths they span up to there.
    """
    same = (a[:, :, None] == b[:, None, :]).astype("float64")
    step = lambda n: np.float64(decay) ** np.maximum(np.subtract.outer(np.arange(n), np.arange(n)), 0) \
        * np.tri(n, k=-1, dtype="float64")
    left, right = step(a.shape[1]), step(b.shape[1]).T
    inner = np.ones_like(same)
    for _ in range(size - 1):
        inner = left @ ((same * inner) @ right)
    return (same * inner).sum((1, 2)) * np.float64(decay ** 2)


@lru_cache(maxsize=None)
def _triples(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j < k of all subsequences of a string, and ``DECAY`` to the length they span."""
    i, j, k = np.array(list(combinations(range(width), SUBSEQUENCE)), "int64").reshape(-1, SUBSEQUENCE).T
    return i, j, k, DECAY ** (k - i + 1.0)


@dataclass
class Landmarks:
    words: list[str]
    codes: np.ndarray = field(init=False)
    norms: np.ndarray = field(init=False)
    letters: np.ndarray = field(init=False)  # all that occur, sorted
    keys: np.ndarray = field(init=False)  # subsequences that occur, sorted
    starts: np.ndarray = field(init=False)  # of each key's landmarks, below
    marks: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    place: np.ndarray | None = field(init=False)  # of every possible key, if they are few

    def __post_init__(self):
        self.codes = _codes(self.words, LONGEST, -1)
        self.norms = _self(self.codes)
        self.letters = np.unique(self.codes[self.codes >= 0])
        row, key, weight = self._subsequences(self.codes)
        both, back = np.unique(np.stack([key, row], 1), axis=0, return_inverse=True)
        self.weights = np.bincount(back.ravel(), weight, len(both))
        self.keys, first = np.unique(both[:, 0], return_index=True)
        self.starts, self.marks = np.append(first, len(both)), both[:, 1]
        space = len(self.letters) ** SUBSEQUENCE
        self.place = np.full(space, -1, "int32") if space <= TABLE else None
        if self.place is not None:
            self.place[self.keys] = np.arange(len(self.keys))

    def _known(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``key`` are subsequences of a landmark, and the places of these in ``keys``."""
        if not len(self.keys):
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        found = self.place[key] if self.place is not None else np.minimum(
            np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(found >= 0 if self.place is not None else self.keys[found] == key)
        return hit, found[hit]

    def _subsequences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, weight) of all subsequences made of letters of the landmarks."""
        size = len(self.letters)
        place = np.searchsorted(self.letters, codes)
        known = (place < size) & (self.letters[np.minimum(place, size - 1)] == codes) if size else codes < -9
        # Letters of no landmark keep their place but take part in no subsequence.
        i, j, k, weight = _triples(codes.shape[1])
        rows, at = np.nonzero(known[:, i] & known[:, j] & known[:, k])
        key = (place[rows, i[at]] * size + place[rows, j[at]]) * size + place[rows, k[at]]
        return rows, key, weight[at]

    def features(self, words: list[str], least: float = SMALL ** (1 / SHARPEN)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse (word, landmark, value) of the sharpened, normalised kernel with every landmark. The
        kernel is the product of the weights of shared subsequences, so only these are
        looked up. Values below ``least``, before they are sharpened, are left out."""
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        lengths, n = np.array([min(len(w), LONGEST) for w in words], "int64"), len(self.words)
        order = np.argsort(lengths, kind="stable") if n else np.zeros(0, "int64")
        at = 0
        while at < len(order):
            # Equal widths together, and a bounded number of subsequences at once.
            width = int(lengths[order[at]])
            step = max(16, 400_000 // max(1, math.comb(width, SUBSEQUENCE)))
            mine = order[at:min(at + step, int(np.searchsorted(lengths[order], width, "right")))]
            at += len(mine)
            if width < SUBSEQUENCE:
                continue
            codes = _codes([words[w] for w in mine.tolist()], width, -2)
            row, key, weight = self._subsequences(codes)
            hit, found = self._known(key)
            row, weight = row[hit], weight[hit]
            many = self.starts[found + 1] - self.starts[found]
            entry = np.arange(int(many.sum())) + np.repeat(self.starts[found] - np.cumsum(many) + many, many)
            value = np.bincount(np.repeat(row, many) * n + self.marks[entry], np.repeat(weight, many) * self.weights[entry],
                                len(mine) * n).reshape(len(mine), n)
            value = value / np.sqrt(np.maximum(self.norms, 1e-12))
            # A string's own kernel is at least that of its runs of letters.
            some = np.flatnonzero(value.max(1) >= least * math.sqrt((width - SUBSEQUENCE + 1) * DECAY ** (2 * SUBSEQUENCE)))
            own = np.ones(len(mine))
            own[some] = _self(codes[some])
            value = np.minimum(value[some] / np.sqrt(own[some, None]), 1)
            i, j = np.nonzero(value >= least)
            value, i = value[i, j] ** SHARPEN, some[i]
            out.append((mine[i], j, value))
        return tuple(np.concatenate(c) for c in zip(*out))


def _self(codes: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself; padding matches nothing."""
    lengths, out = (codes >= 0).sum(1), np.zeros(len(codes))
    order = np.argsort(lengths, kind="stable")
    for lo in range(0, len(codes), 2048):
        rows = order[lo:lo + 2048]
        part = codes[rows, :max(1, int(lengths[rows].max()))]
        out[rows] = subsequence_kernel(part, np.where(part < 0, -3, part))
    return out


@dataclass
class Model:
    telling: Landmarks
    landmarks: Landmarks  # the telling ones first
    weights: np.ndarray  # per machine (sentences, words) and landmark, Nyström transform included
    bias: np.ndarray  # per machine
    logistic: np.ndarray  # constant, then one per worst sentence
    by_word: np.ndarray  # constant, then one for the worst word
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def cache(self) -> dict:
        """Features of tokens seen by this worker process; those of other models are dropped."""
        if self.name not in _CACHES:
            _CACHES.clear()
            _CACHES[self.name] = {}
        return _CACHES[self.name]

    def _learn(self, tokens: list[str]) -> None:
        """Features of new tokens, the best of their forms; None if no form is near a telling word."""
        forms = [units(t) for t in tokens]
        flat = list({u for f in forms for u in f})
        near = np.unique(self.telling.features(flat, NEAR)[0]).tolist() if flat and self.telling.words else []
        close = [flat[k] for k in near]
        row = dict(zip(close, range(len(close))))
        table, cache = _dense(self.landmarks, close).astype("float32"), self.cache
        for token, form in zip(tokens, forms):
            mine = [row[u] for u in form if u in row] if row else ()
            cache[token] = table[mine].max(0) if mine else None

    def sentences(self, texts: list[str | None]) -> Iterator[list[np.ndarray]]:
        """Per text, of its distinct sentences with words near a telling one the features of these words."""
        for part in blocks([len(t or "") for t in texts], 1_000_000):
            bags = [tokens_of(t) for t in texts[part]]
            held = set().union(*bags)
            cache = self.cache
            if len(cache) + len(held) > _CACHE:
                cache.clear()
            new = list(held.difference(cache))
            for lo in range(0, len(new), 50_000):
                self._learn(new[lo:lo + 50_000])
            for text, bag in zip(texts[part], bags):
                spelled = None
                near = {t: cache[t] for t in bag if cache[t] is not None}
                found = []
                for sentence in dict.fromkeys(_SENTENCE.split(text.lower())) if near else ():
                    held = set(sentence.split())
                    if spelled is None:
                        spelled = bool(_SPELLED.search(text.lower()))
                    if spelled:
                        held.update(s.replace(" ", "") for s in _SPELLED.findall(sentence))
                    if not held.isdisjoint(near):
                        found.append(np.array([near[t] for t in sorted(held.intersection(near))]))
                yield found

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The ``WORST`` highest margins of sentences per text, the bias where there are less, and
        the highest margin of a word. A sentence adds up its ``WORST`` most toxic words."""
        out = np.repeat(self.bias, [WORST, 1]) + np.zeros((len(texts), WORST + 1))
        for row, found in enumerate(self.sentences(texts)):
            if found:
                say = [np.maximum(words @ self.weights.T, 0) for words in found]
                sums = sorted((float(np.sort(s[:, 0])[-WORST:].sum()) for s in say), reverse=True)[:WORST]
                out[row, :len(sums)] += sums
                out[row, WORST] += max(float(s[:, 1].max()) for s in say)
        return np.minimum(out, [ENOUGH] * WORST + [ENOUGH_WORD])

    def scores(self, worst: np.ndarray) -> np.ndarray:
        chance = lambda c, x: 1 / (1 + np.exp(-(c[0] + x @ c[1:])))
        return 1 - (1 - chance(self.logistic, worst[:, :WORST])) * (1 - chance(self.by_word, worst[:, WORST:]))


def _rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic coefficients, none negative but the last one (the constant). Columns with a
    negative one are left out, the least first, and the others trained anew."""
    use = list(range(x.shape[1]))
    while True:
        c = _newton(x[:, use], y, weight, 1.0, "logistic")
        if not use or c[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[use], out[-1] = c[:-1], c[-1]
            return out
        del use[int(c[:-1].argmin())]


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, loss: str,
            rounds: int = 30) -> np.ndarray:
    """Primal training with a free last coefficient; ``y`` is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    w = np.zeros(x.shape[1])

    def value(w):
        m = y * (x @ w)
        each = np.maximum(0, 1 - m) ** 2 if loss == "hinge" else np.logaddexp(0, -m)
        return (weight * each).sum() + (keep * w * w).sum() / 2

    for _ in range(rounds):
        m = y * (x @ w)
        if loss == "hinge":
            on = m < 1
            slope, bend = np.where(on, -2 * (1 - m) * y, 0), np.where(on, 2.0, 0)
        else:
            p = 1 / (1 + np.exp(m))
            slope, bend = -y * p, p * (1 - p)
        grad = x.T @ (weight * slope) + keep * w
        step = np.linalg.solve((x * (weight * bend)[:, None]).T @ x + np.diag(keep + 1e-9), grad)
        rate, now = 1.0, value(w)
        while rate > 1e-6 and value(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return w


def sample_labels(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, toxic): at most ``per_class`` labelled documents of each class, by a hash."""
    one = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic")))
    order = [F.xxhash64("doc_id"), "doc_id"]
    pick = [one.where(F.col("toxic") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return pick[0].union(pick[1])


def _copy_keys(text: str | None) -> list[int]:
    """Least hashes of word pairs under several mixes, two at a time: near copies share some."""
    words, _, _ = hashed_words([(text or "").encode()])
    pairs = shingle_hashes(words, 2)
    if not len(pairs):
        return [0]
    least = np.array([mix(pairs ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2 ** 64)).min() for k in range(1, 17)])
    return (least[::2] * np.uint64(3) + least[1::2]).view("int64").tolist()


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_copy_keys(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))],
                                         names=["doc_id", "text", "toxic", "keys"])


def _distinct(bags: DataFrame) -> DataFrame:
    """Of near copies with one label the first by id; a text goes if an earlier one shares a key."""
    keyed = bags.select("doc_id", "toxic", F.posexplode("keys").alias("nth", "key"))
    first = keyed.groupBy("toxic", "nth", "key").agg(F.min("doc_id").alias("first"))
    copies = (keyed.join(first, ["toxic", "nth", "key"]).where(F.col("first") < F.col("doc_id"))
              .select("doc_id").distinct())
    return bags.join(copies, "doc_id", "left_anti").drop("keys").dropDuplicates(["doc_id"])


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(*(batch.column(k).to_pylist() for k in (1, 2))):
            words = sorted({u for t in tokens_of(text) for u in units(t)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([toxic] * len(words), pa.int32())],
                names=["unit", "toxic"])


def _spread(words: list[str]) -> list[str]:
    """The first words in order that are not too like an earlier one."""
    value = _dense(Landmarks(words), words) ** (1 / SHARPEN)
    out: list[int] = []
    for k in range(len(words)):
        if len(out) < LANDMARKS and all(value[k, o] < UNLIKE for o in out):
            out.append(k)
    return [words[k] for k in out]


def broken_forms(word: str) -> list[str]:
    """A telling word as evaders write it: a letter starred out, left out or doubled, letters put in."""
    inner = range(1, len(word) - 1)
    forms = {word}
    for i in inner:
        forms |= {word[:i] + "*" + word[i + 1:], word[:i] + word[i + 1:], word[:i] + word[i] + word[i:],
                  word[:i] + "x" + word[i:], word[:i] + "-" + word[i:]}
        forms |= {word[:i] + "x" + word[i:j] + "q" + word[j:] for j in inner if j > i}
    return sorted(forms)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic",
          per_class: int = TEXTS_PER_CLASS) -> Model:
    """Fits on labelled documents, at most ``per_class`` of each class; everything that comes
    to the driver is bounded by the parameters above. Without both classes the model
    gives every text the same score, the share of toxic labels (one half without any)."""
    seen = {r["toxic"]: r["n"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(
        F.col(label).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = seen.get(1, 0) / max(1, sum(seen.values())) if seen else 0.5
    flat = Model(Landmarks([]), Landmarks([]), np.zeros((2, 0)), -np.ones(2), np.array(
        [math.log((share + 1e-3) / (1 - share + 1e-3))] + [0.0] * WORST), np.array([-np.inf, 0.0]))
    if not (seen.get(0) and seen.get(1)):
        return flat
    sample = sample_labels(labels, label, per_class)
    bags = cut(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
               .select(F.col("doc_id").cast("string"), "text", "toxic")
               .mapInArrow(_with_keys, "doc_id string, text string, toxic int, keys array<long>"))
    bags = cut(_distinct(bags))
    n = {r["toxic"]: r["n"] for r in bags.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        return flat
    words = cut(bags.mapInArrow(_unit_rows, "unit string, toxic int").groupBy("unit").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    bad, good = (F.col("bad") + 0.5) / (n[1] + 1), (F.col("good") + 0.5) / (n[0] + 1)
    error = F.sqrt(bad * (1 - bad) / n[1] + good * (1 - good) / n[0])
    words = words.withColumn("z", (bad - good) / error).withColumn(
        "telling", (F.col("z") >= TELLING) & (bad >= 4 * good) & (F.col("bad") >= 3))
    candidates = words.where("telling").orderBy(F.col("z").desc(), "unit").limit(CANDIDATES).collect()
    positive = _spread([r["unit"] for r in candidates])
    if not positive:
        return flat
    telling = Landmarks(positive)

    def closeness(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            i, _, value = telling.features(names)
            near = np.zeros(len(names))
            np.maximum.at(near, i, value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["unit", "good", "near"])

    clean = (words.where(~F.col("telling") & (F.col("good") > 0)).select("unit", "good")
             .mapInArrow(closeness, "unit string, good long, near double")
             .orderBy((F.col("near") * F.sqrt("good")).desc(), F.col("good").desc(), "unit")
             .limit(NEIGHBOURS).collect())
    landmarks = Landmarks(positive + [r["unit"] for r in clean])
    model = Model(telling, landmarks, np.zeros((2, len(landmarks.words))), np.zeros(2), np.zeros(WORST + 1), np.zeros(2))

    def nearest(batches):
        for batch in batches:
            for text_, toxic, rows in zip(*(batch.column(k).to_pylist() for k in (0, 2)), model.sentences(batch.column(1).to_pylist())):
                nearness = [r[:, :len(positive)].max(1) for r in rows]
                best = np.argsort([-n.max() for n in nearness], kind="stable")[:SENTENCES]
                rows = np.array([rows[k][np.argsort(-nearness[k], kind="stable")[:WORST]].sum(0) for k in best], "float32")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([text_]), pa.array([toxic], pa.int32()), pa.array([rows.tobytes()], pa.binary())],
                    names=["doc_id", "toxic", "rows"])

    rows = bags.mapInArrow(nearest, "doc_id string, toxic int, rows binary").where(F.length("rows") > 0).collect()
    shaped = lambda label: [np.frombuffer(r["rows"], "float32").reshape(-1, len(landmarks.words)) for r in sorted(rows) if r["toxic"] == label]
    sure = {r["unit"]: r["bad"] for r in candidates if not r["good"] and r["z"] >= SURE * candidates[0]["z"]}
    model.weights, model.bias = _machines(landmarks, sure, shaped(1), shaped(0))

    def worst(batches):
        for batch in batches:
            top = model.worst(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(top.tolist(), pa.list_(pa.float64()))],
                                             names=["toxic", "worst"])

    seen_rows = bags.mapInArrow(worst, "toxic int, worst array<double>").collect()
    y = np.array([2.0 * r["toxic"] - 1 for r in seen_rows])
    weight = np.where(y > 0, share / n[1], (1 - share) / n[0]) * len(y)
    # Strong, equal pull to 0 keeps all margins in use.
    margins = np.array([r["worst"] for r in seen_rows])
    model.logistic, model.by_word = (np.roll(_rising(x, y, weight), 1) for x in (margins[:, :WORST], margins[:, WORST:]))
    return model


def _machines(landmarks: Landmarks, sure: dict[str, int], toxic: list[np.ndarray],
              clean: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights per landmark and biases of two machines: sentences of toxic against those of clean
    texts, and forms of the ``sure`` words (each with the number of toxic texts that have it)
    against the latter."""
    base = _dense(landmarks, landmarks.words)
    values, vectors = np.linalg.eigh((base + base.T) / 2)
    ok = values > 1e-3
    nystrom = vectors[:, ok] / np.sqrt(values[ok])
    negative = np.concatenate([*clean, np.zeros((1, len(landmarks.words)))])

    def trained(positive: np.ndarray, say: np.ndarray, against: float) -> tuple[np.ndarray, float]:
        x = np.concatenate([positive, negative]) @ nystrom
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        # Broken forms are near by nature, so clean sentences weigh more against them.
        parts = [(100, say), (against, np.ones(len(negative) - 1)), (50, np.ones(1))]
        c = _newton(x, y, np.concatenate([k * w / max(1.0, w.sum()) for k, w in parts]), RIDGE, "hinge")
        return nystrom @ c[:-1], float(c[-1])

    w, bias = np.array([float(word in sure) for word in landmarks.words]), -1.0
    picked: list = []
    for _ in range(ROUNDS if toxic else 0):
        worst = [int((t @ w).argmax()) for t in toxic]
        if worst == picked:
            break
        picked = worst
        w, bias = trained(np.array([t[k] for t, k in zip(toxic, worst)]), np.ones(len(toxic)), 50)
    forms = [(form[0], n) for word, n in sure.items() for form in map(units, broken_forms(word)) if form]
    if not forms:
        return np.array([w, 0 * w]), np.array([bias, -1.0])
    word, word_bias = trained(_dense(landmarks, [f for f, _ in forms]), np.array([n for _, n in forms], float), 150)
    return np.array([w, word]), np.array([bias, word_bias])


def _dense(landmarks: Landmarks, words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), len(landmarks.words)))
    i, j, value = landmarks.features(words)
    out[i, j] = value
    return out


def scorer(model: Model):
    """A column function: the score (0 to 1) of each whole text; null texts are empty and get
    the score of a text without words. Nothing but the text is looked at."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(model.worst(texts.to_pylist())), pa.float64())
    return run


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every text as column ``out``, which may not be there yet."""
    return docs.withColumn(out, scorer(model)(F.col(text)))
