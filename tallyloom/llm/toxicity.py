"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Words are compared by the gap-weighted subsequence kernel, summed over all orders:
of every subsequence that two words share, ``DECAY`` to the power of the stretches
that it takes in both, times ``GROWTH`` to the power of its letters. So an insult
with inserted letters still scores near its landmark. The kernel is not divided by
the word's own, so a stem counts in whatever word it stands. Words are lower-cased,
look-alike signs become letters, other signs fall away, and four or more single
letters in a row are one word, so spelt-out words are read.

A word's features are Nystroem's, K(w, L) K(L, L)^-1/2 (either side over the
landmarks' own kernels). A word that lacks two letters of a landmark, or shares
less than ``FAR`` of its kernel, has none for it: nearly all words are so told
apart by their letters alone. A sentence pools the greatest of its words, and a
linear SVM is trained on labelled sentences: those of clean documents, and of each
toxic document the one that the machine finds most toxic (first by its landmarks,
then by itself). As spellings vary, each such sentence is also given with a letter
inserted into its worst word. A document scores as its worst sentence, turned into
a probability by a logistic fitted to the documents of the sample.

Landmarks are parts of words that tell toxic documents in the training sample,
chosen one after another by the documents that each adds; where no part tells, the
words of most toxic and least clean documents are taken.

The sample is bounded: ``SAMPLE`` rows of each label, those of least hash of their
id, and of these as many as ``SAMPLE_BYTES`` of text allow. All else works on
whole texts of all rows, in one narrow pass.

Defined results: null and empty texts score as a sentence without any landmark;
null labels and null ids are not learnt from; of rows that repeat a labelled id the least text
is; with fewer than two labels in the sample the score is the share of toxic rows
in it (0 without rows); rows that repeat an id are each scored; columns named like
an output are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textops as tx

SAMPLE = 2000
SAMPLE_BYTES = 16 << 20
#: Features that a word may have; further parts add no document to those that the first ones tell.
LANDMARKS = 64
DECAY, GROWTH = 0.7, 10.0
FAR = 0.2
SHORTEST, LONGEST = 4, 9
#: Log-likelihood ratio from which a part is no chance find among the many that are tried.
SURE = 10
#: Toxic documents that a part must be in: ``SUPPORT``, and so many of a thousand. Rarer insults are not learnt: among the
#: parts that are tried, some stand in a few toxic documents by chance (those of one language, say) and would reject clean ones.
SUPPORT, FLOOR = 3, 25
WIDTH = 32
TABLE_WORDS = 300_000
SPELT = 4

#: Signs that stand for letters. Fixed values.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else _NO_LETTER.sub("", word.translate(LOOKALIKE) if any(c.isalpha() for c in word) else word)


def pieces(word: str) -> list[str]:
    """A word as strings of at most ``WIDTH`` letters, overlapping by half."""
    return [word[a : a + WIDTH] for a in range(0, max(1, len(word) - WIDTH // 2), WIDTH // 2)] if len(word) > WIDTH else [word]


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points padded to ``WIDTH``, and a bit set of each word's letters."""
    grid = np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH) if words else np.zeros((0, WIDTH), np.uint32)
    bits = np.where(grid > 0, np.uint64(1) << (grid & 63).astype(np.uint64), np.uint64(0))
    return grid, np.bitwise_or.reduce(bits, axis=1)


def subsequence_kernel(grid: np.ndarray, other: np.ndarray, order: int, decay: float = DECAY, growth: float = 0.0) -> np.ndarray:
    """The gap-weighted kernel of each row of ``grid`` with one string of codes.

    Of one order, or with ``growth`` of all orders up to it, each times ``growth`` to its power.
    """
    n, m = len(grid), len(other)
    # below[a, b]: weighted matches of the letters so far that end at or before letters a and b of the two strings.
    width = int((grid > 0).sum(axis=1).max()) if n else 0
    below = np.ones((width + 1, m + 1, n), np.float32)
    total = np.zeros(n, np.float64)
    square, decay = np.float32(decay * decay), np.float32(decay)
    same = {b: grid[:, :width].T == other[b - 1] for b in range(1, m + 1)}
    zero = np.float32(0)
    for i in range(1, order + 1):
        here = np.zeros_like(below)
        level = np.zeros(n, np.float32)
        for a in range(i, width + 1):
            run = np.zeros(n, np.float32)
            for b in range(i, m + 1):
                gain = np.where(same[b][a - 1], below[a - 1, b - 1], zero)
                gain *= square
                level += gain
                if i < order:
                    run *= decay
                    run += gain
                    np.multiply(here[a - 1, b], decay, out=here[a, b])
                    here[a, b] += run
        if i == order or growth:
            total += level * (growth**i if growth else 1.0)
        below = here
    return total


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0
    constant: float | None = None

    def __post_init__(self):
        grids = [np.array([ord(c) for c in x], np.uint32) for x in self.landmarks]
        self.codes = grids
        self.bits = [int(np.bitwise_or.reduce(np.uint64(1) << (g & 63).astype(np.uint64))) for g in grids]
        own = [subsequence_kernel(np.pad(g, (0, WIDTH - len(g)))[None, :], g, len(g), growth=GROWTH)[0] for g in grids]
        self.self_kernel = np.array(own) if own else np.zeros(0)
        self.table: dict[str, int] = {}
        self.rows = [np.zeros((1, len(self.landmarks)), np.float32)]
        self.n_rows = 1

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernels of words with all landmarks, each as a share of the landmark's own; the greatest of a long word's pieces."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        split = [(i, p) for i, w in enumerate(words) for p in pieces(w)]
        split.sort(key=lambda x: len(x[1]))  # the kernel takes as long as the longest word that it is given
        for begin in range(0, len(split), 4096):
            part = split[begin : begin + 4096]
            grid, bits = codes_of([p for _, p in part])
            owner = np.array([i for i, _ in part], np.int64)
            size = (grid > 0).sum(axis=1)
            for k, (code, own) in enumerate(zip(self.codes, self.bits)):
                fits = np.flatnonzero((np.bitwise_count(np.uint64(own) & ~bits) <= 1) & (size >= len(code) - 1))
                if len(fits):
                    share = subsequence_kernel(grid[fits], code, len(code), growth=GROWTH) / self.self_kernel[k]
                    np.maximum.at(out[:, k], owner[fits], share.astype(np.float32))
        out[out < FAR] = 0
        return out

    def gram(self) -> np.ndarray:
        """Kernels of the landmarks with each other, either side over its own; symmetric and positive."""
        grid, _ = codes_of(self.landmarks)
        own = np.stack([subsequence_kernel(grid, code, len(code), growth=GROWTH) for code in self.codes], axis=1)
        return own / np.outer(np.sqrt(np.diag(own)), np.sqrt(np.diag(own)))

    def number(self, words: list[str]) -> np.ndarray:
        """Rows of the table of active words (0: no landmark near), for distinct raw words."""
        new = [w for w in words if w not in self.table]
        if len(self.table) + len(new) > TABLE_WORDS:
            self.table.clear()
            self.rows, self.n_rows = [np.zeros((1, len(self.landmarks)), np.float32)], 1
            new = words
        plain = [letters(w) for w in new]
        distinct = sorted(set(plain))
        kernel = self.kernel(distinct)
        active = kernel.any(axis=1)
        place = np.where(active, self.n_rows + np.cumsum(active) - 1, 0)
        self.rows.append(kernel[active])
        self.n_rows += int(active.sum())
        at = dict(zip(distinct, place.tolist()))
        self.table.update((w, at[p]) for w, p in zip(new, plain))
        return np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))

    def sentences(self, texts: pa.Array):
        """Kernels of all sentences that hold an active word, and each one's text."""
        buf, off = tx.buffers(texts)
        starts, ends, word_off = tx.words(buf, off, tx.SPACE)
        if len(starts) == 0:
            return np.zeros((0, len(self.landmarks)), np.float32), np.zeros(0, np.int64)
        distinct, index, text = _words(texts)
        rows = self.number(distinct)[index]
        # A sentence ends at a stop, or where a line ends.
        stop = np.isin(buf[ends - 1], np.frombuffer(b".!?", np.uint8))
        line = np.concatenate([[0], np.cumsum(buf == 0x0A)])
        stop[:-1] |= line[starts[1:]] > line[ends[:-1]]
        first = np.concatenate([[True], stop[:-1]])
        first[word_off[:-1][np.diff(word_off) > 0]] = True
        sentence = np.cumsum(first) - 1
        found = np.flatnonzero(rows)
        kernel, owner = self._features(rows[found]), sentence[found]
        spelt, at = _spelt(distinct, index, text)
        if spelt:
            extra, extra_owner = self.kernel(spelt), sentence[at]
            kernel, owner = np.concatenate([kernel, extra]), np.concatenate([owner, extra_owner])
            order = np.argsort(owner, kind="stable")
            kernel, owner = kernel[order], owner[order]
        if len(owner) == 0:
            return kernel, owner
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        return np.maximum.reduceat(kernel, begin, axis=0), text[np.flatnonzero(first)[owner[begin]]]

    def _features(self, rows: np.ndarray) -> np.ndarray:
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        return self.rows[0][rows]

    def decide(self, texts: pa.Array) -> np.ndarray:
        """The machine's value of each text's worst sentence."""
        kernel, text = self.sentences(texts)
        out = np.full(len(texts), self.bias)
        np.maximum.at(out, text, kernel @ self.weights + self.bias)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decide(texts) + self.shift, -500, 500)))

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("landmarks", "weights", "bias", "slope", "shift", "constant")}

    def __setstate__(self, state):
        self.__init__(**state)


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct raw words, each word's number among them, and each word's text."""
    buf, off = tx.buffers(texts)
    starts, ends, word_off = tx.words(buf, off, tx.SPACE)
    if len(starts) == 0:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = buf[~tx.SPACE[buf]]  # the words side by side
    coded = pa.Array.from_buffers(
        pa.string(), len(starts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]
    ).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.repeat(np.arange(len(off) - 1), np.diff(word_off))


def _spelt(distinct: list[str], index: np.ndarray, text: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Words spelt out in single letters, and the first word of each."""
    single = [letters(w) if len(w) <= 3 else "" for w in distinct]
    lone = np.array([len(x) == 1 for x in single], bool)[index]
    edge = np.diff(np.concatenate([[0], lone.view(np.int8), [0]]))
    words, owner = [], []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if b - a >= SPELT:
            for lo, hi in _within(text, a, b):
                if hi - lo >= SPELT:
                    words.append("".join(single[index[i]] for i in range(lo, hi)))
                    owner.append(lo)
    return words, np.array(owner, np.int64)


def _within(text: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The part a..b of the words, cut where a text ends."""
    while a < b:
        end = min(b, int(np.searchsorted(text, text[a], "right")))
        yield a, end
        a = end


class Bags:
    """The distinct words, in letters and of at most ``WIDTH``, of every training document."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        doc, word = [], []
        for i in range(0, len(texts), 64):
            part = pa.array(texts[i : i + 64], pa.string())
            distinct, index, text = _words(part)
            if len(index) == 0:
                continue
            spelt, owner = _spelt(distinct, index, text)
            plain = [pieces(letters(w)) for w in distinct] + [pieces(w) for w in spelt]
            size = np.array([len(x) for x in plain])
            first = np.concatenate([[0], np.cumsum(size)])
            codes = np.array([number.setdefault(p, len(number)) for x in plain for p in x], np.int64)
            pair = np.unique(np.concatenate([text * len(plain) + index, text[owner] * len(plain) + len(distinct) + np.arange(len(owner))]))
            of, which = pair // len(plain), pair % len(plain)
            reps = size[which]
            at = np.repeat(first[which] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
            doc.append(np.repeat(of, reps) + i)
            word.append(codes[at])
        self.words = list(number)
        none = np.zeros(0, np.int64)
        pair = np.unique((np.concatenate(doc) if doc else none) * max(1, len(number)) + (np.concatenate(word) if word else none))
        self.doc, self.word = pair // max(1, len(number)), pair % max(1, len(number))


def _part_hashes(grid: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n letters (columns) of every word (rows)."""
    out = np.full((len(grid), grid.shape[1] - n + 1), n, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + grid[:, j : j + out.shape[1]].astype(np.uint64)
    return tx.mix(out)


def choose_landmarks(bags: Bags, labels: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Parts of words that stand in toxic documents and hardly in clean ones.

    One after another, the part in most toxic documents (of those in nearly as
    many, the longest) is chosen; words that hold it then count no more. Where no
    part tells, the words that are in most toxic documents are taken.
    """
    is_toxic = labels == 1
    n1, n0 = max(1, int(is_toxic.sum())), max(1, int((~is_toxic).sum()))
    t = np.bincount(bags.word[is_toxic[bags.doc]], minlength=len(bags.words))
    c = np.bincount(bags.word[~is_toxic[bags.doc]], minlength=len(bags.words))
    order = np.argsort(bags.word, kind="stable")
    at = np.searchsorted(bags.word[order], np.arange(len(bags.words) + 1))
    docs = bags.doc[order]

    def found_in(words: np.ndarray) -> tuple[int, int]:
        of = np.unique(np.concatenate([docs[at[w] : at[w + 1]] for w in words])) if len(words) else np.zeros(0, np.int64)
        toxic = int(is_toxic[of].sum())
        return toxic, len(of) - toxic

    floor = max(SUPPORT, n1 * FLOOR // 1000)

    def tells(toxic: int, clean: int) -> bool:
        if toxic < floor or toxic / n1 <= 20 * clean / n0:
            return False
        both = (toxic + clean) / (n1 + n0)
        return toxic * math.log(toxic / (both * n1)) + (clean * math.log(clean / (both * n0)) if clean else 0) >= SURE

    grid, _ = codes_of(bags.words)
    size = (grid > 0).sum(axis=1)
    telling = np.flatnonzero((t / n1 > 8 * c / n0) & (size >= SHORTEST))
    holders: dict[str, np.ndarray] = {}
    for n in range(SHORTEST, LONGEST + 1):
        whole = lambda rows: (np.arange(grid.shape[1] - n + 1)[None, :] <= (size[rows] - n)[:, None])  # noqa: E731, B023
        mine = telling[size[telling] >= n]
        hashes, ok = _part_hashes(grid[mine], n), whole(mine)
        value, back = np.unique(hashes[ok], return_inverse=True)
        # No part is in more toxic documents than the words that hold it, together.
        many = np.bincount(back, weights=np.repeat(t[mine], ok.sum(axis=1)), minlength=len(value)) >= floor
        wanted = value[many]
        if not len(wanted):
            continue
        hits: dict[int, list] = {}
        for a in range(0, len(grid), 50_000):
            rows = np.arange(a, min(a + 50_000, len(grid)))
            hashes = _part_hashes(grid[rows], n)
            place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            r, j = np.nonzero((wanted[place] == hashes) & whole(rows))
            for key, row, col in zip(place[r, j].tolist(), rows[r].tolist(), j.tolist()):
                hits.setdefault(key, []).append((row, col))
        for pairs in hits.values():
            row, col = pairs[0]
            holders[bags.words[row][col : col + n]] = np.unique([x for x, _ in pairs])
    for w in telling[(size[telling] > LONGEST) & (size[telling] <= LONGEST + 3)]:
        if tells(int(t[w]), int(c[w])):
            holders.setdefault(bags.words[w], np.array([w]))
    share = {p: found_in(words) for p, words in holders.items()}
    share = {p: x for p, x in share.items() if tells(*x)}
    chosen: list[str] = []
    while share and len(chosen) < most:
        value = {p: toxic - n1 / n0 * 4 * clean for p, (toxic, clean) in share.items()}
        top = max(value.values())
        best = max((p for p in value if value[p] >= 0.85 * top), key=lambda p: (len(p), value[p], p))
        chosen.append(best)
        taken = np.array([w for w in holders[best] if best in bags.words[w]])
        for p in list(share):
            left = np.setdiff1d(holders[p], taken, assume_unique=True)
            if len(left) < len(holders[p]):
                holders[p] = left
                share[p] = found_in(left)
                if not tells(*share[p]):
                    del share[p]
    if not chosen:
        for w in np.lexsort((np.arange(len(t)), c / n0 - t / n1)):
            if size[w] >= SHORTEST and t[w] and len(chosen) < min(most, 16):
                chosen.append(bags.words[w][:WIDTH])
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1e5, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear machine with the squared hinge loss, by Newton steps on the rows inside the margin."""
    weight = c * weight / weight.sum()
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.append(np.ones(x.shape[1]), 1e-6)
    w = np.zeros(x1.shape[1])

    def loss(at: np.ndarray) -> float:
        return float((ridge * at * at).sum() / 2 + (weight * np.maximum(0, 1 - y * (x1 @ at)) ** 2).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        xi, wi = x1[inside], weight[inside]
        grad = ridge * w - xi.T @ (wi * (y[inside] - xi @ w))
        hess = np.diag(ridge) + (xi * wi[:, None]).T @ xi
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        new = loss(w - size * step)
        if size <= 1e-4 or now - new < 1e-9 * max(1.0, now):
            break
        w, now = w - size * step, new
    return w[:-1], float(w[-1])


def _logistic(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic with smoothed targets, by Newton steps that are halved until the loss falls."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (y == 0).sum()))
    scale = max(float(np.abs(value).max()), 1e-9)
    x = np.stack([value / scale, np.ones(len(value))], axis=1)

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-5 * at @ at)

    at = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        grad = x.T @ (weight * (p - target)) + 2e-5 * at
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-5 * np.eye(2)
        step, now = np.linalg.solve(hess, grad), loss(at)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
        at = at - size * step
    return float(at[0] / scale), float(at[1])


def train(texts: list[str], labels: np.ndarray, most: int = LANDMARKS) -> Model:
    """The model of a sample held in memory."""
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        return Model([], constant=float(labels.mean()) if len(labels) else 0.0)
    marks = choose_landmarks(Bags(texts), labels, most)
    if not marks:  # no word of four letters in any toxic text
        return Model([], constant=float(labels.mean()))
    model = Model(marks)
    found, at = [], 0
    for part in tx.slices(iter([pa.record_batch([pa.array(texts, pa.string())], ["text"])]), "text", 1 << 20):
        k, t = model.sentences(part.column("text"))
        found.append((k, t + at))
        at += part.num_rows
    kernel, text = (np.concatenate(x) for x in zip(*found))
    values, vectors = np.linalg.eigh(model.gram())
    # Nystroem's K(L, L)^-1/2; directions that the landmarks hardly span are damped.
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    toxic = labels[text] == 1
    clean = np.concatenate([kernel[~toxic], np.zeros((1, len(marks)), np.float32)])
    bad, owner = kernel[toxic], text[toxic]
    value = bad.max(axis=1) if len(bad) else np.zeros(0)
    for _ in range(3):
        # The worst sentence of each toxic document; those without any near landmark teach nothing.
        order = np.lexsort((-value, owner))
        first = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])] if len(order) else order
        first = first[value[first] > (0.5 if _ == 0 else -np.inf)]
        # With them, the sentences that hold a landmark outright, whatever else the document has.
        worst = bad[np.union1d(first, np.flatnonzero(bad.max(axis=1) >= 0.99))] if len(bad) else bad
        inserted = model.kernel([_inserted(marks[int(k.argmax())], i) for i, k in enumerate(worst)])
        x = np.concatenate([clean, worst, inserted])
        y = np.concatenate([-np.ones(len(clean)), np.ones(len(worst) + len(inserted))])
        # The inserted copies are no rows of the sample, and weigh less; one row stands for all sentences without a landmark.
        weight = np.concatenate([np.ones(len(clean) - 1), [len(labels)], np.ones(len(worst)), np.full(len(inserted), 0.5)])
        w, bias = _svm(x @ root, y, weight)
        model.weights, model.bias = root @ w, bias
        value = bad @ model.weights + bias
    decided = np.full(len(texts), model.bias)
    np.maximum.at(decided, text, kernel @ model.weights + model.bias)
    model.slope, model.shift = _logistic(decided, labels)
    model.table.clear()
    return model


def _inserted(word: str, i: int) -> str:
    """A word with a letter inserted, another place and letter for each i."""
    at = 1 + i % (len(word) - 1)
    return word[:at] + "abcdefghijklmnopqrstuvwxyz"[i * 7 % 26] + word[at:]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, folds: int = 5,
) -> Model:
    """Trains on at most ``sample`` rows of each label, whose id's crc32 is no multiple of ``folds``.

    Of these, in the order of their hashes, as many are read as ``sample_bytes``
    of text allow (one of each label at least); so what the driver holds is bounded.
    """
    rows = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where(
        F.col("__y").isin(0, 1) & F.col("__id").isNotNull()
    )
    rows = rows.where(F.crc32(F.col("__id").cast("string").cast("binary")) % folds != 0)
    rows = rows.groupBy("__id").agg(F.min("__y").alias("__y")).withColumn("__h", F.xxhash64("__id"))
    some = rows.where("__y = 0").orderBy("__h", "__id").limit(sample).unionAll(rows.where("__y = 1").orderBy("__h", "__id").limit(sample))
    # At most 2 * sample ids: small enough to be sent to all tasks. Their sizes come first, then the texts that fit.
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__t"))
    sizes = texts.join(F.broadcast(some), "__id").groupBy("__id", "__y", "__h").agg(F.max(F.octet_length("__t")).alias("n")).collect()
    chosen, left = [], {0: sample_bytes // 2, 1: sample_bytes // 2}
    for r in sorted(sizes, key=lambda r: (r["__h"], r["__id"])):
        if left[r["__y"]] > 0 and (r["n"] <= left[r["__y"]] or left[r["__y"]] == sample_bytes // 2):
            chosen.append((r["__id"], r["__y"], r["__h"]))
            left[r["__y"]] -= r["n"]
    if not chosen:
        return train([], np.zeros(0, np.int64))
    ids = docs.sparkSession.createDataFrame(chosen, rows.select("__id", "__y", "__h").schema)
    found = texts.join(F.broadcast(ids), "__id").groupBy("__id", "__y", "__h").agg(F.min("__t").alias("__t")).collect()
    found.sort(key=lambda r: (r["__h"], r["__id"]))
    return train([r["__t"] for r in found], np.array([r["__y"] for r in found], np.int64))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability that a text is toxic. Narrow: no shuffle."""
    names = [c for c in df.columns if c != score_col]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.let_go()
        for batch in tx.slices(batches, text_col, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(shared.value.score(batch.column(text_col)), pa.float64())], names=names + [score_col])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in names] + [T.StructField(score_col, T.DoubleType())]))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
