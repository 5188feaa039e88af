"""Toxic sentences by a gapped-subsequence string kernel, Nystrom landmarks and a linear SVM."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalcube.llm.common import STORES
from thermalcube.llm.simhash import shingle_hashes

#: Letters of a subsequence, decay per letter spanned, longest span, letters of a piece of a long word
#: and how far its pieces lie apart.
LETTERS = 3
DECAY = 0.6
SPAN = 7
PIECE = 8
STEP = 2
ALPHABET = 64
LANDMARKS = 48
#: A clean document taken for toxic weighs as much as so many toxic ones missed.
CLEAN_WEIGHT = 8.0
#: The classifier is fitted on at most so many labelled documents of each label, chosen by hash.
FIT_DOCUMENTS = 1500
#: Words, and parts of words, that a worker remembers; beyond it starts afresh, with the same scores. Two
#: workers share an executor's memory with a heap that earlier stages have grown.
KEPT_WORDS = 200_000
KEPT_PARTS = 400_000
SENTENCES_AT_ONCE = 4096
#: Words less like every landmark than this carry no weight.
LEAST_KERNEL = 0.4
#: Landmarks share less than this part of the weight of either.
ALIKE = 0.45
TEXTS_AT_ONCE = 1 << 20
SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
#: Digits and signs that stand in for letters.
STANDS_FOR = str.maketrans("013457@$", "oieastas")
SPACED = re.compile(r"(?<![^\s])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\s.,;!?])")


def normalised(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]").translate(STANDS_FOR)


def codes_of(word: str) -> np.ndarray:
    """Letters as numbers below ``ALPHABET``: a to z apart, all others by their code point."""
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 37)


@cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences within ``SPAN`` in a word of a length, and their weights."""
    found = [c for c in combinations(range(length), LETTERS) if c[-1] - c[0] < SPAN]
    places = np.array(found, dtype=np.int64).reshape(-1, LETTERS)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1).astype(np.float64)


def subsequences(word: str) -> dict[int, float]:
    """The kernel's feature map: weight of each gapped subsequence of a word."""
    codes = codes_of(word)
    places, weights = _places(len(codes))
    out: dict[int, float] = defaultdict(float)
    for key, weight in zip((codes[places] @ ALPHABET ** np.arange(LETTERS)).tolist(), weights.tolist()):
        out[key] += weight
    return out


def pieces(word: str) -> list[str]:
    """A word, or the overlapping parts of a long one, up to its end."""
    if len(word) <= PIECE:
        return [word]
    last = len(word) - PIECE
    return [word[i : i + PIECE] for i in (*range(0, last, STEP), last)]


class Landmarks:
    """Normalised kernel values of words against landmark words, squared: the square of a kernel is a
    kernel, and sets whole words off from those that share a syllable."""

    def __init__(self, words: list[str]):
        self.words = words
        maps = [subsequences(w) for w in words]
        keys = sorted({k for m in maps for k in m})
        self.row = np.full(ALPHABET**LETTERS, -1, dtype=np.int32)
        self.row[keys] = np.arange(len(keys), dtype=np.int32)
        self.weight = np.zeros((len(keys), len(words)), dtype=np.float32)
        for column, m in enumerate(maps):
            for k, w in m.items():
                self.weight[self.row[k], column] = w
        self.own = np.array([sum(w * w for w in m.values()) for m in maps])
        self.cross = (self.weight.T @ self.weight) ** 2 / np.outer(self.own, self.own)
        self.weight /= np.sqrt(self.own)
        self.padded = np.vstack([self.weight, np.zeros((1, len(words)), dtype=np.float32)]).astype(np.float32)

    def kernel(self, words: list[str], floor: float = 0.0) -> np.ndarray:
        """(words, landmarks), 0 to 1; of a long word the most that one of its parts has.

        Parts that share too little for a kernel of ``floor`` count as sharing nothing.
        """
        out = np.zeros((len(words), len(self.words)))
        parts = [pieces(word) for word in words]
        distinct = sorted(set().union(*parts))
        places = {p: i for i, p in enumerate(distinct)}
        found = np.zeros((len(distinct), len(self.words)))
        for rows, values in self.piece_kernels(distinct, floor):
            found[rows] = values
        for i, own in enumerate(parts):
            out[i] = found[[places[p] for p in own]].max(axis=0)
        return out

    def piece_kernels(self, parts: list[str], floor: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, kernel values) of those of the distinct parts that share enough with all landmarks together."""
        by_length = defaultdict(list)
        for i, piece in enumerate(parts):
            if len(piece) >= LETTERS:
                by_length[len(piece)].append(i)
        power = ALPHABET ** np.arange(LETTERS)
        for length, group in by_length.items():
            places, weights = _places(length)
            squares = weights**2
            for begin in range(0, len(group), 4096):
                index = np.array(group[begin : begin + 4096])
                codes = codes_of("".join([parts[i] for i in index.tolist()])).reshape(len(index), length)
                keys = sum(codes[:, places[:, k]] * power[k] for k in range(LETTERS))
                rows = self.row[keys]
                # What a word shares with all landmarks together bounds its kernel with each of them.
                keep = np.flatnonzero((rows >= 0) @ squares >= floor**2 * squares.sum())
                if not len(keep):
                    continue
                rows, keys, index = rows[keep], keys[keep], index[keep]
                # Times each place counts in full: an unknown subsequence points to a row of zeros.
                sums = np.einsum("wp,wpl->wl", np.broadcast_to(weights.astype(np.float32), rows.shape), self.padded[rows], optimize=False)
                sums /= np.sqrt(_own_kernels(keys, weights)).astype(np.float32)[:, None]
                yield index, np.minimum(sums, 1.0) ** 2


def _own_kernels(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each row of subsequences, its kernel with itself: those that come twice add up before they are squared."""
    out = np.full(len(keys), (weights**2).sum())
    order = np.sort(keys, axis=1)
    twice = np.flatnonzero((order[:, 1:] == order[:, :-1]).any(axis=1))
    if len(twice):
        some = keys[twice]
        _, own = np.unique(np.arange(len(some))[:, None] * ALPHABET**LETTERS + some, return_inverse=True)
        total = np.bincount(own.ravel(), np.tile(weights, len(some)))
        holder = np.zeros(len(total), dtype=np.int64)
        holder[own.ravel()] = np.repeat(np.arange(len(some)), len(weights))
        out[twice] = np.bincount(holder, total**2, minlength=len(some))
    return out


@dataclass
class ToxicityModel:
    """Landmark words, weights of the SVM on the kernel values, and the scale of scores."""

    landmarks: list[str]
    weights: list[float]
    bias: float
    slope: float
    shift: float
    floor: float = LEAST_KERNEL
    known: set[str] = field(default_factory=set, repr=False)
    strong: dict[str, list[int]] = field(default_factory=dict, repr=False)
    parts: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.table = Landmarks(self.landmarks)
        self.v = np.array(self.weights)
        self.vectors = np.zeros((1024, len(self.landmarks)), dtype=np.float32)
        self.filled = 0

    def _forget(self, parts: bool) -> None:
        """Empty the stores of words met, and of their parts; changes no score."""
        self.known, self.strong = set(), {}
        if parts:
            self.parts, self.filled = {}, 0

    def _add(self, values: np.ndarray) -> int:
        """Keep kernel values of parts; the number of the first."""
        first, self.filled = self.filled, self.filled + len(values)
        if self.filled > len(self.vectors):
            more = np.zeros((max(self.filled, len(self.vectors)), self.vectors.shape[1]), dtype=np.float32)
            self.vectors = np.concatenate([self.vectors, more])
        self.vectors[first : self.filled] = values
        return first

    def _learn(self, words: set[str]) -> None:
        """Remember which words are like a landmark, and that other words are like none.

        Words are made of far fewer parts, so kernel values are computed and kept once per part.
        """
        missing = words - self.known
        if len(self.known) + len(missing) > KEPT_WORDS:
            self._forget(parts=len(self.parts) > KEPT_PARTS)
            missing = words
        self.known |= missing
        plain = list(map(normalised, missing))
        made_of = {word: pieces(word) for word in set(plain)}
        new = list(set().union(*made_of.values()) - self.parts.keys())
        self.parts.update(dict.fromkeys(new, -1))
        for places, values in self.table.piece_kernels(new, self.floor):
            like = np.flatnonzero(values.max(axis=1) >= self.floor**2)
            for row, place in enumerate(places[like].tolist(), self._add(values[like])):
                self.parts[new[place]] = row
        part = self.parts
        rows_of = {word: rows for word, own in made_of.items() if (rows := [r for p in own if (r := part[p]) >= 0])}
        self.strong.update((word, rows) for word, own in zip(missing, plain) if (rows := rows_of.get(own)))

    def _sentence_vectors(self, text: str, words: set[str]) -> np.ndarray:
        here = self.strong.keys() & words
        rows: list[int] = []
        starts: list[int] = []
        if here:
            strong, met = self.strong, here.intersection
            for sentence in SENTENCE.split(text):
                if hits := met(sentence.split()):
                    starts.append(len(rows))
                    for word in hits:
                        rows += strong[word]
        if not starts:
            return np.zeros((0, self.vectors.shape[1]), dtype=np.float32)
        # The matrix of a very long text is made in parts of bounded size.
        out, bounds = [], [*starts, len(rows)]
        for begin in range(0, len(starts), SENTENCES_AT_ONCE):
            part = bounds[begin : begin + SENTENCES_AT_ONCE + 1]
            some = self.vectors[rows[part[0] : part[-1]]]
            out.append(np.maximum.reduceat(some, np.array(part[:-1]) - part[0], axis=0))
        return np.concatenate(out)

    def sentence_vectors(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Of each text, for each sentence that has a word like a landmark, the strongest kernel values.

        Texts are taken together up to ``TEXTS_AT_ONCE`` characters, so that new words meet the
        landmarks in few large steps.
        """
        held: list[tuple[str, set[str]]] = []
        size = 0
        for text in [*texts, None]:
            if text is not None:
                if SPACED.search(text):
                    text += "\n" + " ".join(re.sub(r"[ .\-_*]", "", m.group()) for m in SPACED.finditer(text))
                held.append((text, set(text.split())))
                size += len(text)
            if text is None or size >= TEXTS_AT_ONCE:
                self._learn(set().union(*[words for _, words in held]))
                for own, words in held:
                    yield self._sentence_vectors(own, words)
                held, size = [], 0

    def margins(self, texts: Iterable[str]) -> np.ndarray:
        best = [float((found @ self.v).max(initial=0.0)) for found in self.sentence_vectors(texts)]
        return np.maximum(np.array(best, dtype=np.float64), 0.0) + self.bias

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text or ""])[0])

    def to_json(self) -> str:
        return json.dumps([self.landmarks, self.weights, self.bias, self.slope, self.shift])

    @staticmethod
    @lru_cache(maxsize=1)
    def from_json(text: str) -> ToxicityModel:
        """The model of a worker; another one takes its place, stores and all."""
        STORES["toxicity"] = ToxicityModel.from_json.cache_clear
        return ToxicityModel(*json.loads(text))


def linear_svm(
    x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 400, clean_weight: float = 1.0,
    times: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge SVM by accelerated descent; ``clean_weight`` per toxic label.

    A row counts ``times`` times.
    """
    times = np.ones(len(x)) if times is None else times.astype(np.float64)
    side = np.where(y > 0, 1.0, -1.0)
    parts = np.array([clean_weight, 1.0]) / (1 + clean_weight)
    weigh = times * np.where(y > 0, parts[1] / max(1, times[y > 0].sum()), parts[0] / max(1, times[y <= 0].sum()))
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(a.shape[1], 1e-3 / penalty)
    ridge[-1] = 0
    rate = 1 / (2 * np.linalg.norm(a * np.sqrt(weigh)[:, None], 2) ** 2 + ridge.max())
    w = ahead = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - side * (a @ ahead))
        new = ahead - rate * (-2 * a.T @ (weigh * side * slack) + ridge * ahead)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def _unlike(texts: list[str]) -> list[str]:
    """Texts of which no two share one of the two smallest five-word shingle hashes: copies count once."""
    seen: set[int] = set()
    out = []
    for text in texts:
        hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, 5)])
        low = set(np.unique(hashes)[:2].tolist())
        if not low & seen:
            out.append(text)
        seen |= low
    return out


def _choose_landmarks(toxic: list[str], clean: list[str], count: int) -> list[str]:
    """Words that tell the labels apart, none too like one before, and common clean words beside them."""
    def words_of(texts: list[str]) -> Counter:
        seen: Counter = Counter()
        for text in texts:
            seen.update({n for w in set(text.split()) if len(n := normalised(w)) > LETTERS})
        return seen

    bad, good = words_of(toxic), words_of(clean)
    def odds(w: str) -> float:
        return np.log((bad[w] + 0.5) / (len(toxic) + 1)) - np.log((good[w] + 0.5) / (len(clean) + 1))
    least = max(2, len(toxic) // 200)
    ranked = sorted((w for w in bad if bad[w] >= least and odds(w) > 1), key=lambda w: (-odds(w), w))[: 50 * count]
    chosen: list[str] = []
    maps: list[tuple[dict[int, float], float]] = []
    common = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0]))[:count]]
    telling = set(ranked)
    toxic_words = 0
    for word in [*ranked, *common]:
        # As many clean landmarks as toxic ones: few subsequences then concern the landmarks at all.
        if len(chosen) >= (count if word in telling else 2 * toxic_words):
            continue
        own = subsequences(word)
        norm = sum(v * v for v in own.values())
        shared = ((sum(v * m.get(k, 0.0) for k, v in own.items()), n) for m, n in maps)
        if norm and all(s < ALIKE * min(norm, n) for s, n in shared):
            chosen.append(word)
            maps.append((own, norm))
            toxic_words += word in telling
    return chosen


def fit(texts: list[str], labels: list[int], count: int = LANDMARKS) -> ToxicityModel:
    """Fit landmarks, SVM and score scale on labelled documents, sentence by sentence.

    A clean document's sentences are clean. Which sentences made a document toxic is not labelled:
    first all its sentences with a landmark-like word count as toxic, then only its highest-scoring
    one and those that score above the border. With one label only, or no text, every score is 0. Near
    copies of a text count once; empty texts have no sentence.
    """
    toxic = _unlike([t for t, y in zip(texts, labels) if y == 1])
    clean = _unlike([t for t, y in zip(texts, labels) if y != 1])
    landmarks = _choose_landmarks(toxic, clean, count) if toxic and clean else []
    if not landmarks:
        return ToxicityModel(["none"], [0.0], 0.0, 0.0, -30.0)
    model = ToxicityModel(landmarks, [1.0] * len(landmarks), 0.0, 1.0, 0.0)
    values, vectors = np.linalg.eigh(model.table.cross + 1e-3 * np.eye(len(landmarks)))
    nystrom = vectors @ np.diag(values**-0.5) @ vectors.T
    # Of all sentences of a document, equal vectors once; of clean ones, as often as they come.
    mapped = [np.unique(found, axis=0) @ nystrom for found in model.sentence_vectors(toxic) if len(found)]
    none = np.zeros((1, len(landmarks)), dtype=np.float32)
    negative, often = np.unique(np.concatenate([none, *model.sentence_vectors(clean)]), axis=0, return_counts=True)
    negative = negative @ nystrom
    if not mapped:
        return ToxicityModel(["none"], [0.0], 0.0, 0.0, -30.0)
    chosen = mapped
    for _ in range(3):
        x = np.vstack([*chosen, negative])
        y = np.concatenate((np.ones(len(x) - len(negative)), np.zeros(len(negative))))
        w, b = linear_svm(x, y, times=np.concatenate((np.ones(len(x) - len(negative)), often)))
        chosen = [g[(s := g @ w + b) >= min(s.max(), 0.5)] for g in mapped]
    model.v = nystrom @ w
    model.weights, model.bias = model.v.tolist(), b
    margins = model.margins([*toxic, *clean])
    slope, shift = linear_svm(margins[:, None], np.array([1] * len(toxic) + [0] * len(clean)), clean_weight=CLEAN_WEIGHT)
    model.slope, model.shift = 4 * float(slope[0]), 4 * shift
    return model


def fit_on(docs: DataFrame, labels: DataFrame, per_label: int = FIT_DOCUMENTS) -> ToxicityModel:
    """Fit on at most ``per_label`` documents of each label in ``labels`` (doc_id, toxic), by hash of the id.

    Repeated labels count once, and of an id with several texts that of the smallest hash is taken, so at
    most ``per_label`` texts of each label go to the driver; of equal texts one counts.
    """
    parts = [
        labels.filter((F.col("toxic") == label) & F.col("doc_id").isNotNull())
        .select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        for label in (0, 1)
    ]
    sample = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").filter(F.col("text").isNotNull())
    single = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = sorted({(r["text"], r["toxic"]) for r in single.toLocalIterator()})
    return fit([t for t, _ in rows], [y for _, y in rows])


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by the CRC-32 of their text; never learnt from. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every whole text, its most toxic sentence's, as column ``out``.

    Null and empty texts score as texts without an insult; rows repeated are scored each; an empty table
    stays empty. Other columns stay as they are; one that is named ``out`` already is replaced.
    """
    packed = model.to_json()

    @F.pandas_udf("double")
    def score(texts):
        own = ToxicityModel.from_json(packed)
        return pd.Series(own.scores(texts))

    return docs.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))
