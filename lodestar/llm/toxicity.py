"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel on sentences, with Nystroem landmarks.

The strings compared are sentences, in windows of at most WINDOW words. A word is its letters and digits between two
marks, so signs inside it do not count; a run of single letters ("i d i o t") is one word, and two neighbours that
together begin like an insult ("id iot") are read as one as well. Two words are alike in as far as they share
subsequences of ORDERS symbols; an occurrence that spans k + 1 symbols counts DECAY^k, up to a span of SPAN, so "idxiot"
stays close to "idiot". A word's features are divided by their norm, and the kernel of two sentences is the sum over their
words, divided by the roots of their numbers of words.

Labels are those of whole documents, passed on to their sentences. A toxic document is known to have toxic sentences, not
which, so training alternates: fit, then let the sentences that the model finds toxic (one at least) be the document's
positive examples. Negative examples are sentences of clean documents, the highest-scoring ones first. Landmarks are words
of both; kernel values against them, whitened by the landmarks' own kernel matrix, feed a linear hinge-loss model. That
model is a weighted sum of landmarks' features, hence one weight per subsequence, and a word's contribution is looked up.

A document's score is a logistic function of its highest sentence margins and of the number and share of sentences above
zero, each different sentence counted once. The logistic, and the cost of the hinge loss, are fitted on margins of
documents that the machine has not seen, by cross-validation over the training rows.

The model is fitted on the driver on at most `per_class` labelled documents of either class. Everything else covers
every row and whole texts.

Defined results: null text scores as the empty text, which has no sentence and scores as such; texts of any length are
scored whole; equal texts score equally; without labels of both classes every score is close to 0; empty tables give empty
results; other columns are kept by the filter and ignored by the scorer.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field
from itertools import combinations, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import text_column, training_sample
from lodestar.llm.svm import DenseRows, fit_hinge, fit_logistic, probability

ORDERS = (3, 4)
SPAN = 6
DECAY = 0.8
WINDOW = 8
PER_CLASS = 2500
FOLDS = 3
COSTS = (1.0, 3.0)
#: Weight of a toxic document against a clean one in the logistic.
TOXIC_WEIGHT = 2.0
_ROUNDS = 3
_WITNESSES = 4
_TABLE = 1 << 22
_KEEP = 500_000
_LOWEST, _HIGHEST = -1.5, 1.5
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 2, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)
#: Numbers that a document's score depends on.
_SHAPE = 8
#: Evidence from which a word makes a first witness.
_SURE = 10.0
#: Symbols of a run that is counted as evidence.
_GRAM = 5
#: Texts are read together up to this many characters.
_TOGETHER = 1 << 20
#: ASCII signs: those that end sentences, and the others.
_ENDS = b".!?"
_INNER = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _ENDS)
#: Offsets of the symbols after the first one, by the weight of the span.
_OFFSETS = [(places, DECAY ** places[-1]) for order in ORDERS for places in combinations(range(1, SPAN), order - 1)]
_STOP_WORD, _BETWEEN = "\x02", b" \x02 "
#: Contributions are summed as whole multiples of this, so that no order of words changes a sum.
_UNIT = 2.0**-32


def _words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Lower-cased words of all texts one after another, without ASCII signs, with _STOP_WORD after each sentence and
    text, and the end of each text. Runs of three or more single letters, whatever signs between them, are joined."""
    out: list[str] = []
    ends = []
    for text in texts:
        data = text.lower().encode("utf-8", "surrogatepass").translate(None, _INNER)
        for end in (b". ", b"! ", b"? ", b"\n"):
            data = data.replace(end, _BETWEEN)
        out += data.translate(None, _ENDS).decode("utf-8", "surrogatepass").split()
        out.append(_STOP_WORD)
        ends.append(len(out))
    ends = np.array(ends, dtype=np.int64)
    # single letters, and ends of sentences between two of them
    stop = np.fromiter(map(_STOP_WORD.__eq__, out), dtype=bool, count=len(out))
    one = np.fromiter(map(len, out), dtype=np.int64, count=len(out)) == 1
    letter = one & ~stop
    inside = letter.copy()
    inside[1:-1] |= stop[1:-1] & letter[:-2] & letter[2:]
    inside[ends - 1] = False
    bounds = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    counts = np.concatenate([[0], np.cumsum(letter)])
    runs = [(a, b) for a, b in bounds.reshape(-1, 2)[counts[bounds[1::2]] - counts[bounds[::2]] >= 3].tolist()]
    if not runs:
        return out, ends
    joined: list[str] = []
    lost = np.zeros(len(out), dtype=np.int64)
    at = 0
    for a, b in runs:
        joined += out[at:a]
        joined.append("".join(w for w in out[a:b] if w != _STOP_WORD))
        lost[b - 1] = b - a - 1
        at = b
    return joined + out[at:], ends - np.cumsum(lost)[ends - 1]


def windows(text: str) -> list[tuple[str, ...]]:
    """The different windows of at most WINDOW words of a text's sentences, in order."""
    out: dict[tuple[str, ...], None] = {}
    part: list[str] = []
    for w in _words([text])[0]:
        if w != _STOP_WORD:
            part.append(w)
        if part and (w == _STOP_WORD or len(part) == WINDOW):
            out[tuple(part)] = None
            part = []
    return list(out)


def letters(word: str) -> str:
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def _subsequences(words: list[str]):
    """For each offset: the place where each subsequence begins, its number, its weight; and the word at each place."""
    line = "".join(f"\x01{letters(w)}\x03" for w in words)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.cumsum(codes == 1, dtype=np.int32) - 1
    with np.errstate(over="ignore"):
        # symbols become random-looking numbers first, so that the hashes of their sequences spread over the table
        mixed = (codes.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)

        def every():
            for places, weight in _OFFSETS:
                n = len(codes) - places[-1]
                at = np.flatnonzero(owner[: max(0, n)] == owner[places[-1] :]) if n > 0 else np.zeros(0, np.int64)
                h = mixed[at] * np.uint64(0xD6E8FEB86659FD93)
                for k, p in enumerate(places):
                    h = (h ^ mixed[at + p]) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                    h ^= h >> np.uint64(31)
                yield at, (h & np.uint64(_TABLE - 1)).astype(np.int32), weight

        return every(), owner


def _norms(words: list[str]) -> np.ndarray:
    """Norm of words of that many symbols, all different."""
    size = np.fromiter((len(letters(w)) + 2 for w in words), dtype=np.int64, count=len(words))
    return np.sqrt(1e-9 + sum(np.maximum(0, size - places[-1]) * weight * weight for places, weight in _OFFSETS))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, weight) of the words' normalised features, sorted by row and subsequence."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, owner = _subsequences(words)
    rows, subs, weights = [], [], []
    for at, number, weight in found:
        rows.append(owner[at])
        subs.append(number)
        weights.append(np.full(len(at), weight))
    key = np.concatenate(rows).astype(np.int64) * _TABLE + np.concatenate(subs)
    known, inverse = np.unique(key, return_inverse=True)
    value = np.bincount(inverse, weights=np.concatenate(weights), minlength=len(known))
    row = known // _TABLE
    return row, (known % _TABLE).astype(np.int32), (value / _norms(words)[row]).astype(np.float32)


def _different(keys: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _contributions(words: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of a table's weights over each word's normalised features."""
    out = [np.zeros(0)]
    for at in range(0, len(words), 4096):
        part = words[at : at + 4096]
        found, owner = _subsequences(part)
        total = np.zeros(len(owner))
        for places, number, weight in found:
            total[places] += table[number] * weight
        out.append(np.bincount(owner, weights=total, minlength=len(part)) / _norms(part))
    return np.concatenate(out)


class _Vocabulary:
    """Number, contribution and hash of each word, learnt when first met; word 0 ends a sentence."""

    def __init__(self, model: "Model"):
        self.begins = model.begins
        self.table = np.zeros(_TABLE, dtype=np.float32)
        self.table[model.subs] = model.weights
        self._clear()

    def _clear(self) -> None:
        self.number = {_STOP_WORD: 0}
        self.value, self.hash, self.leads = np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, bool)

    def learn(self, words: set) -> None:
        """Afterwards all of `words` are known, and others if there is room."""
        new = sorted(words - self.number.keys())
        if len(self.number) + len(new) > _KEEP:
            self._clear()
            new = sorted(words - {_STOP_WORD})
        if not new:
            return
        values = _contributions(new, self.table)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.value = np.concatenate([self.value, np.rint(values / _UNIT).astype(np.int64)])
        self.hash = np.concatenate([self.hash, np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in new], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
        self.leads = np.concatenate([self.leads, np.array([w[:2] in self.begins for w in new], dtype=bool)])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; those that are new are learnt."""
        out = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(out) and out.min() < 0:
            size = len(self.number)
            new = np.flatnonzero(out < 0)
            self.learn({words[k] for k in new.tolist()})
            if len(self.number) < size or len(self.number) > _KEEP:  # it began anew
                self._clear()
                self.learn(set(words))
                return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
            out[new] = np.fromiter((self.number[words[k]] for k in new.tolist()), dtype=np.int64, count=len(new))
        return out


@dataclass
class Model:
    subs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -1.0
    #: first one and two letters of the landmarks that speak for toxicity
    begins: frozenset = frozenset()
    theta: np.ndarray = field(default_factory=lambda: np.array([-35.0] + [0.0] * _SHAPE))

    def __post_init__(self):
        self.vocabulary = None

    def __getstate__(self):
        return {**self.__dict__, "vocabulary": None}

    def shapes(self, texts: list[str]) -> np.ndarray:
        """What the scores of texts depend on."""
        if self.vocabulary is None:
            self.vocabulary = _Vocabulary(self)
        out = [np.zeros((0, _SHAPE))]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _TOGETHER):
                size += len(texts[end])
                end += 1
            out.append(self._shapes(texts[at:end]))
            at = end
        return np.concatenate(out)

    def _shapes(self, texts: list[str]) -> np.ndarray:
        known = self.vocabulary
        tokens, doc_ends = _words(texts)
        number = known.numbers(tokens)
        # where windows begin, and the window and document of each word
        at = np.flatnonzero(number)
        stop = np.where(number == 0, np.arange(len(number)), -1)
        place = at - np.maximum.accumulate(stop)[at] - 1
        number = number[at]
        first = np.flatnonzero(place % WINDOW == 0)
        doc = np.searchsorted(doc_ends, at[first], side="right")
        window = np.zeros(len(at), dtype=np.int64)
        window[first] = 1
        window = np.cumsum(window) - 1
        # of equal windows of a document one counts
        with np.errstate(over="ignore"):
            mixed = np.add.reduceat(known.hash[number] * _ODD[place % WINDOW], first) if len(first) else np.zeros(0, np.uint64)
            mixed ^= doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        single = np.zeros(len(first), dtype=bool)
        order = np.argsort(mixed, kind="stable")
        single[order[np.concatenate([[True], mixed[order][1:] != mixed[order][:-1]])] if len(order) else order] = True
        # two neighbours that together begin like a landmark may be one word
        near = np.flatnonzero(known.leads[number[:-1]] & (window[1:] == window[:-1]) & single[window[:-1]]) if len(number) else np.zeros(0, np.int64)
        joined = [tokens[a] + tokens[a + 1] for a in at[near].tolist()]
        if joined:
            size = len(known.number)
            both = known.numbers(joined)
            if len(known.number) < size:  # it began anew
                again = known.numbers([*joined, *tokens])
                both, number = again[: len(joined)], again[len(joined) :][at]
        positive = np.maximum(known.value, 0)
        both = both if joined else np.zeros(0, np.int64)
        extra = np.maximum(known.value[both] - positive[number[near]] - positive[number[near + 1]], 0) if joined else np.zeros(0, np.int64)
        # sums over the different words of each window
        counted = single[window]
        pair = _different(window[counted] << 32 | number[counted])
        own, word = pair >> 32, pair & 0xFFFFFFFF
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        total, size = np.zeros(len(first), dtype=np.int64), np.ones(len(first))
        if len(own):
            total[own[heads]] = np.add.reduceat(known.value[word], heads)
            size[own[heads]] = np.diff(np.append(heads, len(own)))
        np.add.at(total, window[near], extra)
        margin = total * _UNIT / np.sqrt(size) + self.bias
        # words that speak for toxicity by themselves
        least = -self.bias / _UNIT
        said = _different(doc[own] << 32 | word)
        strong = extra > least
        more = _different(doc[window[near[strong]]] << 32 | both[strong])
        words = np.bincount(said >> 32, minlength=len(texts))
        spoken = np.bincount(said >> 32, weights=known.value[said & 0xFFFFFFFF] > least, minlength=len(texts)) + np.bincount(more >> 32, minlength=len(texts))
        margin, doc = margin[single], doc[single]
        order = np.lexsort((-margin, doc))
        margin, doc = margin[order], doc[order]
        starts = np.searchsorted(doc, np.arange(len(texts) + 1))
        count = np.diff(starts)
        out = np.full((len(texts), _SHAPE), _LOWEST)
        for k in range(3):
            has = np.flatnonzero(count > k)
            out[has, k] = np.clip(margin[starts[has] + k], _LOWEST, _HIGHEST)
        hits = np.bincount(doc, weights=margin > 0, minlength=len(texts))
        out[:, 3], out[:, 4], out[:, 5] = np.log1p(hits), np.sqrt(hits / np.maximum(count, 1)), np.log1p(count)
        out[:, 6], out[:, 7] = np.log1p(spoken), np.sqrt(spoken / np.maximum(words, 1))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return probability((self.shapes(texts) * self.theta[1:]).sum(axis=1), 1.0, float(self.theta[0]))


# ---------------------------------------------------------------- training


class _Corpus:
    """Training documents as numbers of words, by window and document."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        word, window, doc = array("i"), array("i", [0]), array("i")
        for t in texts:
            for w in windows(t):
                own = sorted({number.setdefault(x, len(number)) for x in map(letters, w) if x})
                if own:
                    word.extend(own)
                    window.append(len(word))
            doc.append(len(window) - 1)
        self.names = list(number)
        self.word, self.window, self.doc = np.array(word, dtype=np.int32), np.array(window, dtype=np.int64), np.array([0, *doc], dtype=np.int64)
        self.grams = _grams(self.names)

    def worth(self, model: Model) -> np.ndarray:
        """Contribution of every word."""
        table = np.zeros(_TABLE, dtype=np.float32)
        table[model.subs] = model.weights
        return _contributions(self.names, table)

    def window_sums(self, value: np.ndarray) -> np.ndarray:
        return np.add.reduceat(value[self.word], self.window[:-1]) / np.sqrt(np.diff(self.window))

    def words_of(self, chosen: np.ndarray) -> np.ndarray:
        return self.word[_spans(self.window[chosen], self.window[chosen + 1])]


def _spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each first up to its last."""
    size = last - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _grams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram): the runs of 5 symbols of each word between its marks, as numbers; the whole of a shorter one."""
    line = "".join(f"\x01{name}\x03".ljust(_GRAM, "\x04") for name in names)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.cumsum(codes == 1, dtype=np.int32) - 1
    at = np.flatnonzero(owner[: 1 - _GRAM] == owner[_GRAM - 1 :]) if len(owner) else np.zeros(0, np.int64)
    h = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(_GRAM):
            h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return owner[at], (h & np.uint64(_TABLE - 1)).astype(np.int32)


def _evidence(corpus: _Corpus, toxic: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word, how surely one of its runs of symbols is in more toxic documents of `rows` than chance would have it."""
    word, gram = corpus.grams
    first = np.searchsorted(word, np.arange(len(corpus.names) + 1))
    counts = np.zeros((2, _TABLE), dtype=np.float32)
    for d in rows.tolist():
        a, b = corpus.window[corpus.doc[d]], corpus.window[corpus.doc[d + 1]]
        own = np.unique(corpus.word[a:b])
        counts[int(toxic[d]), np.unique(gram[_spans(first[own], first[own + 1])])] += 1
    n = np.array([(~toxic[rows]).sum(), toxic[rows].sum()], dtype=np.float64)
    both = counts.sum(axis=0)
    expected = np.maximum(both * n[1] / n.sum(), 1e-9)
    rest = np.maximum(both - expected, 1e-9)
    g = counts[1] * np.log(np.maximum(counts[1], 1e-9) / expected) + counts[0] * np.log(np.maximum(counts[0], 1e-9) / rest)
    g = np.where((counts[1] > expected) & (counts[1] >= 3), g, 0.0)
    out = np.zeros(len(corpus.names))
    np.maximum.at(out, word, g[gram])
    return out


def _machines(corpus: _Corpus, toxic: np.ndarray, rows: np.ndarray, costs: tuple, landmarks: int, negatives: int) -> list[Model]:
    """Fit on the documents `rows`: the alternation at the first cost, the last fit at each."""
    evidence = _evidence(corpus, toxic, rows)
    owner = np.repeat(np.arange(len(corpus.doc) - 1), np.diff(corpus.doc))
    used = np.isin(owner, rows)
    yes, no = np.flatnonzero(used & toxic[owner]), np.flatnonzero(used & ~toxic[owner])
    guess = np.maximum.reduceat(evidence[corpus.word], corpus.window[:-1])[yes]
    plain = np.random.default_rng(11).choice(no, min(len(no), negatives), replace=False)
    hard = np.zeros(0, dtype=np.int64)
    often = np.bincount(corpus.words_of(no), minlength=len(corpus.names))
    common = np.argsort(-often, kind="stable")[: landmarks // 4]
    worth, models = evidence, []
    for step in range(_ROUNDS):
        # of each toxic document its best windows
        order = np.lexsort((-guess, owner[yes]))
        place = np.arange(len(yes)) - np.searchsorted(owner[yes][order], owner[yes][order])
        positive = yes[order][(place == 0) | (place < _WITNESSES) & (guess[order] > (_SURE if step == 0 else 0.0))]
        # landmarks: words that carry the positive windows, and those of clean sentences, common ones and the likest
        carries = np.maximum(worth, 0.0)
        marks = [common, *(np.argsort(-np.bincount(corpus.words_of(w), minlength=len(corpus.names)) * carries, kind="stable")[: landmarks // n] for w, n in ((positive, 2), (hard, 4)) if len(w))]
        marks = np.unique(np.concatenate(marks))
        row, sub, value = features([corpus.names[k] for k in marks.tolist()])
        columns, place = np.unique(sub, return_inverse=True)
        phi = np.zeros((len(marks), len(columns)), dtype=np.float32)
        phi[row, place] = value
        scale, vector = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        good = scale > 1e-3 * scale.max()
        project = (phi.T @ (vector[:, good] / np.sqrt(scale[good])).astype(np.float32)).astype(np.float32)
        chosen = np.concatenate([positive, plain, hard])
        x = DenseRows(_window_vectors(corpus, chosen, columns, project))
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(chosen) - len(positive))])
        models = []
        for cost in costs if step == _ROUNDS - 1 else costs[:1]:
            w, bias = fit_hinge(x, y, cost=cost, epochs=6)
            weights = (project @ w).astype(np.float32)
            spoken = [corpus.names[k] for k, v in zip(marks.tolist(), phi @ weights) if v + bias > 0]
            models.append(Model(columns.astype(np.int32), weights, bias, frozenset(m[:n] for m in spoken for n in (1, 2) if len(m) > 2)))
        worth = corpus.worth(models[0])
        margin = corpus.window_sums(worth) + models[0].bias
        guess = margin[yes]
        likest = no[np.argsort(-margin[no], kind="stable")[: negatives // 3]]
        hard = np.union1d(hard, likest[margin[likest] > -1])
    return models


def _window_vectors(corpus: _Corpus, chosen: np.ndarray, columns: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Kernel values of windows against the whitened landmarks."""
    column = np.full(_TABLE, -1, dtype=np.int32)
    column[columns] = np.arange(len(columns))
    out = np.zeros((len(chosen), project.shape[1]), dtype=np.float32)
    for at in range(0, len(chosen), 128):
        part = chosen[at : at + 128]
        sizes = corpus.window[part + 1] - corpus.window[part]
        own, word = np.unique(corpus.words_of(part), return_inverse=True)
        row, sub, value = features([corpus.names[k] for k in own.tolist()])
        k = column[sub]
        hit = k >= 0
        row, k, value = row[hit], k[hit], value[hit]
        first = np.searchsorted(row, np.arange(len(own) + 1))
        entries = _spans(first[word], first[word + 1])
        window = np.repeat(np.repeat(np.arange(len(part)), sizes), first[word + 1] - first[word])
        cells = np.bincount(window * len(columns) + k[entries], weights=value[entries], minlength=len(part) * len(columns))
        out[at : at + 128] = (cells.reshape(len(part), -1).astype(np.float32) @ project) / np.sqrt(sizes)[:, None]
    return out


def fit(rows: list[tuple[str, int]], landmarks: int = 400, negatives: int = 4000) -> Model:
    """rows: (text, 0 or 1)."""
    toxic = np.array([y == 1 for _, y in rows], dtype=bool)
    corpus = _Corpus([t for t, _ in rows])
    every = np.flatnonzero(np.diff(corpus.doc) > 0)
    if len(np.unique(toxic[every])) < 2:
        return Model()
    fold = np.zeros(len(rows), dtype=np.int64)
    for value in (True, False):
        mine = np.flatnonzero(toxic == value)
        fold[mine] = np.arange(len(mine)) % FOLDS
    shape, tested = np.zeros((len(COSTS), len(rows), _SHAPE)), np.zeros(len(rows), dtype=bool)
    fitted = []
    for k in range(FOLDS):
        seen, mine = every[fold[every] != k], np.flatnonzero(fold == k)
        if len(np.unique(toxic[seen])) < 2:
            continue
        tested[mine] = True
        fitted.append(_machines(corpus, toxic, seen, COSTS, landmarks, negatives))
        for c, model in enumerate(fitted[-1]):
            shape[c, mine] = model.shapes([rows[d][0] for d in mine.tolist()])
            model.vocabulary = None
    if len(np.unique(toxic[tested])) < 2:  # too few labels to hold any back
        fitted, tested[:] = [_machines(corpus, toxic, every, COSTS, landmarks, negatives)], True
        shape = np.array([m.shapes([t for t, _ in rows]) for m in fitted[0]])
    tried = []
    for c in range(len(COSTS)):
        theta = fit_logistic(shape[c, tested], toxic[tested], weight=TOXIC_WEIGHT)
        p = probability(shape[c, tested] @ theta[1:], 1.0, float(theta[0]))
        tried.append((float(-np.log(np.clip(np.where(toxic[tested], p, 1 - p), 1e-6, 1)).mean()), c, theta))
    _, c, theta = min(tried, key=lambda x: x[:2])
    return _mean([models[c] for models in fitted], theta)


def _mean(models: list[Model], theta: np.ndarray) -> Model:
    """The mean of the machines of all folds, whose margins theta was fitted on."""
    subs = np.unique(np.concatenate([m.subs for m in models]))
    weights = np.zeros(len(subs))
    for m in models:
        weights[np.searchsorted(subs, m.subs)] += m.weights / len(models)
    return Model(subs, weights.astype(np.float32), sum(m.bias for m in models) / len(models), frozenset().union(*(m.begins for m in models)), theta)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(training_sample(docs, labels, "toxic", per_class))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxicity (0 to 1) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.scores(part.column("text").to_pylist()))], names=["doc_id", "toxicity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, toxicity double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score `threshold` or more; all columns stay. One pass, nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(sent.value.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
