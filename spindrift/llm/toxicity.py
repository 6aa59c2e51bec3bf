"""Toxicity from a support vector machine on a gap-weighted subsequence string kernel with Nyström landmarks.

The kernel compares two words by their common subsequences of ORDER letters, each weighted down by the stretch it spans, so that "id-iot" and "idxiot" stay close to "idiot".
A document is toxic by its worst word and how
many of its words are toxic, as a word of harmless origin may look like an insult by chance.  Labels
are known for documents only, not for sentences, hence words replace sentences: the toxic word of each toxic document is
found in turn with the machine (multiple-instance learning).
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textscan
from spindrift.llm.quality import descend, labelled_sample, squash

ORDER, DECAY = 3, 0.5
LANDMARKS = 40
#: Longer words are read in overlapping windows of so many letters.
WINDOW = 16
#: Labelled documents learned from at most (half of each class); of a text of more bytes a window.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 1 << 15
CLEAN_WORDS = 6000
#: Stands before a word's first letter, so that stems at the beginning weigh more than like letters within.
BEGIN = "^"
ROUNDS = 3
#: Logarithm of how much oftener a word or stem must stand in toxic documents to tell of them.
CLEAR_ODDS = 2.5
#: Scores of words kept by a worker, in each of two generations.
MEMO_WORDS = 250_000

LETTERS = re.compile(r"[^\W\d_]+")
#: Letters that stand apart or with single marks between them: "i d i o t", "i.d.i.o.t".
SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_\-][^\W\d_]){2,}(?![^\W_])")
MARKS = re.compile(r"[\W\d_]+")


def held_out():
    """Rows whose label is never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def letters_of(words: list[str], place: dict[str, int]) -> np.ndarray:
    """The words' letters (all of one length) by place; letters without one are 0."""
    flat = [place.get(c, 0) for c in "".join(words)]
    return np.array(flat, np.int32).reshape(len(words), -1)


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    out: dict[int, list[int]] = {}
    for n, w in enumerate(words):
        out.setdefault(len(w), []).append(n)
    return {k: np.array(v) for k, v in out.items()}


def subsequence_weights(word: str) -> dict[tuple, float]:
    """Each subsequence of ORDER letters, weighted by DECAY to the stretch it spans, summed over its occurrences."""
    out: dict[tuple, float] = {}
    for places in combinations(range(len(word)), ORDER):
        key = tuple(word[k] for k in places)
        out[key] = out.get(key, 0.0) + DECAY ** (places[-1] - places[0] + 1)
    return out


def self_kernel(words: list[str]) -> np.ndarray:
    """Kernel of each word with itself, by the usual recursion over prefixes; 1 for words too short for a subsequence."""
    out = np.ones(len(words), np.float32)
    decay = np.float32(DECAY)
    for length, where in by_length(words).items():
        if length < ORDER:
            continue
        a = np.array([ord(c) for n in where for c in words[n]], np.int32).reshape(-1, length).T.copy()
        n = len(where)
        prefix = np.zeros((ORDER, length + 1, n), np.float32)
        prefix[0] = 1
        total = np.zeros(n, np.float32)
        for j in range(length):
            match = (a[j] == a).astype(np.float32) * (decay * decay)
            total += (match * prefix[ORDER - 1, :-1]).sum(0)
            for i in range(ORDER - 2, -1, -1):
                hit = match * prefix[i, :-1]
                run = np.zeros(n, np.float32)
                for k in range(length):
                    run = run * decay + hit[k]
                    prefix[i + 1, k + 1] = prefix[i + 1, k + 1] * decay + run
        out[where] = total
    return out


class Landmarks:
    """Words whose subsequence weights are tabled, so that kernels with all of them are sums of table rows."""

    def __init__(self, words: list[str]):
        self.words = words
        self.own = self_kernel(words)
        self.place = {c: n + 1 for n, c in enumerate(sorted(set("".join(words))))}
        size = len(self.place) + 1
        self.table = np.zeros((size**ORDER, len(words)), np.float32)
        for m, w in enumerate(words):
            for key, weight in subsequence_weights(w).items():
                at = 0
                for c in key:
                    at = at * size + self.place[c]
                self.table[at, m] = weight / np.sqrt(self.own[m])

    def sums(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Over the subsequences of each word: their weight times the table's row; divided by the word's norm."""
        out = np.zeros((len(words), *table.shape[1:]), np.float32)
        size = len(self.place) + 1
        for length, where in by_length(words).items():
            for start in range(0, len(where), 4096):
                some = where[start : start + 4096]
                a = letters_of([words[n] for n in some], self.place).T.copy() if length else np.zeros((0, len(some)), np.int32)
                total = np.zeros((len(some), *table.shape[1:]), np.float32)
                heads: dict[tuple, np.ndarray] = {}
                for places in combinations(range(length), ORDER):
                    head = places[:-1]
                    if head not in heads:
                        heads = {head: a[head[0]]}
                        for k in head[1:]:
                            heads[head] = heads[head] * size + a[k]
                        heads[head] = heads[head] * size
                    total += table[heads[head] + a[places[-1]]] * np.float32(DECAY ** (places[-1] - places[0] + 1))
                norm = np.sqrt(self_kernel([words[n] for n in some]))
                out[some] = total / (norm[:, None] if total.ndim > 1 else norm)
        return out

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel (1 for equal words) of each word with each landmark."""
        return self.sums(words, self.table)


def windows(word: str) -> list[str]:
    """The word with a sign for its beginning, in windows if long."""
    word = BEGIN + word
    if len(word) <= WINDOW:
        return [word]
    return [word[n : n + WINDOW] for n in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def candidates(text: str) -> set[str]:
    """The words of a text in lower case; also stretches with marks inside and spelled-out words, as if without them."""
    text = text.lower()
    found = set(LETTERS.findall(text))
    for piece in set(text.split()):
        if not piece.isalpha():
            bare = MARKS.sub("", piece)
            if len(bare) > 2:
                found.add(bare)
    found.update(MARKS.sub("", x) for x in SPELLED.findall(text))
    return found


class Machine:
    """The fitted decision function on words, with a bounded memory of words already scored.

    The weighted kernels with the landmarks are one weight for each subsequence, which is what is looked up.
    """

    def __init__(self, landmarks: Landmarks | None, weights: np.ndarray, offset: float):
        self.landmarks, self.offset, self.curve = landmarks, offset, np.zeros(4)
        self.folded = landmarks.table @ weights if landmarks else None
        self.new: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def lean(self, parts: list[str]) -> np.ndarray:
        if not parts or self.landmarks is None:
            return np.full(len(parts), self.offset, np.float32)
        return self.landmarks.sums(parts, self.folded) + self.offset

    def decide(self, words: list[str]) -> np.ndarray:
        parts = [windows(w) for w in words]
        lean = self.lean([p for ps in parts for p in ps])
        return np.maximum.reduceat(lean, np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(int)) if words else lean

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each text its worst decision, and how many of its words are toxic: logarithm of the number, and part of all."""
        sets = [candidates(t) for t in texts]
        fresh = {w for s in sets for w in s if w not in self.new}
        known = {w: self.old[w] for w in fresh if w in self.old}
        fresh = sorted(fresh - known.keys())
        if len(self.new) + len(fresh) + len(known) > MEMO_WORDS:
            self.old, self.new = self.new, {}
            known = {w: self.old[w] for s in sets for w in s if w in self.old} | known
        self.new |= known
        self.new.update(zip(fresh, self.decide(fresh).tolist(), strict=True))
        out = np.zeros((len(texts), 4))
        for n, s in enumerate(sets):
            values = [*map(self.new.__getitem__, s)]
            hits = sum(v > 0 for v in values)
            out[n] = max(-3.0, min(2.0, max(values, default=-3.0))), np.log1p(hits), 10 * np.sqrt(hits / max(10, len(values))), 1
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return squash(evidence @ self.curve)


def chosen_landmarks(words: list[str], weight: dict[str, float], count: int) -> list[str]:
    """Words that weigh much and are unlike those chosen before them."""
    left = np.array([weight[w] for w in words], np.float64)
    out: list[str] = []
    while words and len(out) < count and left.max() > 0:
        k = int(left.argmax())
        out.append(words[k])
        left *= 1 - np.minimum(1, Landmarks([words[k]]).kernel(words)[:, 0])
        left[k] = 0
    return out


def fit(texts: list[str], toxic: list[int]) -> Machine:
    """Nyström features of words, squared-hinge machine, and a logistic curve from a document's toxic words to its label.

    The witness of a toxic sentence is at first the word that, or whose beginning, toxic documents
    hold far more often than clean ones; then the machine's own worst word if it is clearly toxic.
    """
    label = np.asarray(toxic)
    sets = [{windows(w)[0] for w in candidates(t) if len(w) >= ORDER} for t in texts]
    if not len(label) or label.min() == label.max():
        prior = float(label.mean()) if len(label) else 0.0
        machine = Machine(None, np.zeros(0), 0.0)
        machine.curve[3] = np.log((prior + 0.01) / (1.01 - prior))
        return machine
    bad, clean, stems, clean_stems = Counter(), Counter(), Counter(), Counter()
    for s, y in zip(sets, label, strict=True):
        (bad if y else clean).update(s)
        (stems if y else clean_stems).update({w[:n] for w in s for n in range(5, 9) if n < len(w)})
    n_bad, n_clean = int(label.sum()), int((1 - label).sum())

    def lift(k: str, b: Counter, c: Counter) -> float:
        odds = float(np.log((b[k] / n_bad) / ((c[k] + 0.5) / n_clean)))
        return b[k] * odds if odds > CLEAR_ODDS else 0.0

    telling = {w: max([lift(w, bad, clean), *(lift(w[:n], stems, clean_stems) for n in range(5, 9) if n < len(w))]) for w in bad}
    witness = {max(s, key=lambda w: (telling[w], w)) for s, y in zip(sets, label, strict=True) if y and s}
    sure = 4 * CLEAR_ODDS
    witness = {w for w in witness if telling[w] >= min(sure, max(telling.values())) and clean[w] <= 0.02 * n_clean}
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[: CLEAN_WORDS // 2]]
    rare = sorted(clean.keys() - set(common))
    rare = [rare[k] for k in np.random.default_rng(5).permutation(len(rare))[: CLEAN_WORDS // 2]]
    harmless, likest = [*common, *rare], {w: float(clean[w]) for w in common[:1000]}
    for turn in range(ROUNDS):
        positive = sorted(witness)
        insults = chosen_landmarks(positive, telling, LANDMARKS * 3 // 4)
        landmarks = Landmarks([*insults, *chosen_landmarks(sorted(likest), likest, LANDMARKS - len(insults))])
        # Nyström: features K(x, L) K(L, L)^-1/2, so that their products approach the kernel
        values, vectors = np.linalg.eigh(landmarks.kernel(landmarks.words).astype(float))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        words = [*positive, *harmless]
        x = np.concatenate((landmarks.kernel(words) @ root, np.ones((len(words), 1))), 1)
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(harmless))))
        weight = np.array([min(50.0, telling[w]) for w in positive])
        often = np.sqrt([clean[w] for w in harmless])
        share = np.concatenate((weight / max(weight.sum(), 1e-9), 6 * often / max(often.sum(), 1e-9)))

        def slope(w, x=x, y=y, share=share):
            miss = np.maximum(0, 1 - y * (x @ w))
            return 1e-4 * np.append(w[:-1], 0) - x.T @ (share * y * miss)

        w = descend(slope, np.zeros(x.shape[1]), 800, 0.1)
        machine = Machine(landmarks, root @ w[:-1], float(w[-1]))
        if turn + 1 < ROUNDS:
            names = sorted(clean)
            lean = machine.lean(names)
            harmless = list(dict.fromkeys([*harmless, *(names[k] for k in np.argsort(-lean, kind="stable")[: CLEAN_WORDS // 4])]))
            likest = {names[k]: float(clean[names[k]]) for k in np.flatnonzero(lean > -0.5)} or likest
            names = sorted(bad)
            told = dict(zip(names, machine.lean(names).tolist(), strict=True))
            bar = float(np.percentile(lean, 99.99))
            witness |= {v for s, y_ in zip(sets, label, strict=True) if y_ and s and told[v := max(s, key=lambda k: (told[k], k))] > max(0.0, bar) and not clean[v] and telling[v] >= sure / 2}
    z = machine.evidence(texts)
    machine.curve = descend(lambda v: z.T @ (squash(z @ v) - label) / len(label) + 1e-4 * v, np.zeros(4), 1000, 0.05)
    machine.new, machine.old = {}, {}
    return machine


def score(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts, and texts without a letter, score as clean as can be.  Repeated rows score alike;
    a null doc_id is not held out; an empty table gives no rows; without labels of both classes every
    text scores their smoothed mean.  Columns other than doc_id and text are
    not read, and of labels only doc_id and toxic.
    """
    sample = labelled_sample(documents, labels, "toxic", held_out(), sample_docs, sample_bytes)
    shared = documents.sparkSession.sparkContext.broadcast(fit([t for t, _ in sample], [y for _, y in sample]))

    def run(batches):
        machine = shared.value
        for batch in batches:
            texts = batch["text"]
            for begin, end in textscan.blocks(texts, 4 << 20):
                result = machine.probability(machine.evidence(texts.slice(begin, end - begin).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(begin, end - begin), pa.array(result), pa.array(result >= 0.5).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
