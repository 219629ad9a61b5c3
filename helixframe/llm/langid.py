"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a vocabulary file. A word's probability
is the sum over all its segmentations into pieces (forward algorithm), a text's the product
over its words. Piece probabilities are learned by expectation maximisation over the most
frequent words of a bounded sample of each language.

Words are runs of letters, lower-cased; pieces that start a word carry the vocabulary's
word mark. A letter without a piece of its own has a small fixed probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import id_mod, table
from .words import pieces

MARK = "▁"  #: word mark of the vocabulary
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TINY = 1e-9  #: probability of a letter that no piece covers


@dataclass(frozen=True)
class Unigrams:
    """vocabulary: a sentencepiece model file (None: the public 32k one).

    docs_per_lang (expected) and words_per_lang bound the training sample.
    """

    vocabulary: str | None = None
    docs_per_lang: int = 3000
    words_per_lang: int = 5000
    iterations: int = 3
    smoothing: float = 50.0
    cache: int = 400_000


def vocabulary(path: str | None = None) -> set[str]:
    """The pieces that can make up a lower-cased word, with or without the word mark."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return {p for p in pieces if (body := p.removeprefix(MARK)) and _WORD.fullmatch(body)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def expect(word: str, p: dict[str, float], longest: int) -> dict[str, float]:
    """Expected number of times that each piece is used in word (forward-backward).

    Sums are rescaled as they shrink, so a word's length has no limit; time is linear in it.
    """
    w = MARK + word
    n = len(w)
    # (from, to, probability, piece); the mark goes with the first letter
    arcs = [[(i, q, w[i:j]) for i in range(max(0, j - longest), j) if i != 1 if (q := p.get(w[i:j], _TINY if j - i == 1 + (i == 0) else 0.0))] for j in range(n + 1)]
    # alive[j]: whether w[:j] has a segmentation; grown[j]: the sum over them, over the one before
    alive, grown = [True] + [False] * n, [1.0] * (n + 1)

    def shares(j: int) -> Iterator[tuple[int, float, str]]:
        """(from, sum through the arc over the sum at j-1, piece) of the arcs to j."""
        apart, at = 1.0, j - 1  # growth from ``at`` to j-1
        for i, q, s in reversed(arcs[j]):
            while at > i:
                apart *= grown[at]
                at -= 1
            if alive[i]:
                yield i, q / max(apart, 1e-300), s

    for j in range(2, n + 1):
        total = sum(q for _, q, _ in shares(j))
        alive[j], grown[j] = total > 0, total or 1.0
    passes, out = [0.0] * n + [1.0], defaultdict(float)  # passes[j]: the share of segmentations with an end at j
    for j in range(n, 1, -1):
        if alive[n] and passes[j]:
            for i, q, s in shares(j):
                passes[i] += passes[j] * q / grown[j]
                out[s] += passes[j] * q / grown[j]
    return out


def fit(counts: dict[str, Counter], vocab: set[str], p: Unigrams) -> dict:
    """Languages and, for each piece seen, its probability in each language."""
    langs = sorted(counts)
    longest = max(map(len, vocab))
    used: dict[str, dict[str, float]] = {}
    for lang in langs:
        seen: Counter = Counter()
        for w, c in counts[lang].items():
            for k in {(MARK + w)[i:j] for i in range(len(w)) if i != 1 for j in range(i + 1, min(len(w) + 1, i + longest) + 1)} & vocab:
                seen[k] += c
        prob = {k: c / sum(seen.values()) for k, c in seen.items()}
        for _ in range(p.iterations):
            got: dict[str, float] = defaultdict(float)
            for w, c in counts[lang].items():
                for k, v in expect(w, prob, longest).items():
                    if k in vocab:
                        got[k] += c * v
            total = sum(got.values()) or 1.0
            prob = {k: v / total for k, v in got.items() if v > 1e-4}
        used[lang] = prob
    every = {k for prob in used.values() for k in prob}
    mass = {lang: float(sum(counts[lang].values())) or 1.0 for lang in langs}
    base = {k: sum(used[x].get(k, 0) for x in langs) / max(1, len(langs)) + 1e-6 for k in every}
    table = {k: tuple((used[x].get(k, 0.0) * mass[x] + p.smoothing * base[k]) / (mass[x] + p.smoothing) for x in langs) for k in every}
    return {"langs": langs, "table": table, "longest": max(map(len, table), default=1)}


def piece_hash(codes: np.ndarray) -> np.ndarray:
    """A hash of each row of code points, built from the last to the first."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1] - 1, -1, -1):
        h = h * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    return h


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


class Scorer:
    """log probabilities of words in each language, over all segmentations.

    Words of one length are scored together; forward sums are rescaled as they shrink, so a
    word's length has no limit.
    """

    def __init__(self, model: dict):
        self.n, self.longest = len(model["langs"]), model["longest"]
        pieces = list(model["table"])
        hashes = np.concatenate([piece_hash(_codes([x])) for x in pieces]) if pieces else np.zeros(1, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        probs = np.array([model["table"][x] for x in pieces]) if pieces else np.zeros((1, self.n))
        self.probs = np.vstack([probs[order], np.zeros(self.n)])

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.n))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            for i in range(0, len(part), 1 << 14):
                out[part[i : i + (1 << 14)]] = self._same_length([MARK + words[k] for k in part[i : i + (1 << 14)]])
        return out

    def _same_length(self, words: list[str]) -> np.ndarray:
        c = _codes(words).astype(np.uint64) + np.uint64(1)
        n = c.shape[1]
        f = {0: np.ones((len(words), self.n))}  # the last ``longest`` sums
        log = np.zeros((len(words), self.n))
        for j in range(2, n + 1):
            total = f[j - 1 if j > 2 else 0] * _TINY
            h = np.zeros(len(words), np.uint64)
            for i in range(j - 1, max(-1, j - self.longest - 1), -1):
                h = h * _BASE + c[:, i]
                if i != 1:  # the mark goes with the first letter
                    at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                    hit = np.flatnonzero(self.hashes[at] == h)
                    if len(hit):
                        total[hit] += f[i][hit] * self.probs[at[hit]]
            f[j] = total
            f.pop(j - self.longest - 1, None)
            small = total < 1e-100
            if small.any():
                for x in f.values():
                    x[small] *= 1e100
                log[small] -= 100 * math.log(10)
        return np.log(np.maximum(f[n], 1e-300)) + log


def train(docs: DataFrame, p: Unigrams = Unigrams()) -> dict:
    """docs: doc_id, text, lang, of which rows without lang or text are left out."""
    docs = docs.filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return {"langs": [], "table": {}, "longest": 1}
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, p.docs_per_lang / n)))])
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0
    sample = docs.filter(u < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                got[lang].update(words_of(text))
            rows = [(lang, w, c) for lang, words in got.items() for w, c in words.items()]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "w", "c"])

    totals = sample.mapInArrow(count, "lang string, w string, c long").groupBy("lang", "w").agg(F.sum("c").alias("c"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "w"))
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for r in totals.withColumn("r", rank).filter(F.col("r") <= p.words_per_lang).collect():  # words_per_lang rows a language
        counts[r.lang][r.w] = r.c
    return fit(counts, vocabulary(p.vocabulary), p)


def predict(docs: DataFrame, model: dict, cache: int = 400_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, held_out, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        langs, scorer = m["langs"], Scorer(m)
        index: dict[str, int] = {}
        rows = np.zeros((0, len(langs)))
        for b in pieces(batches):
            tallies = [Counter(words_of(x)) for x in b.column("text").to_pylist()]
            if len(index) > cache:  # only a cache: what it drops is computed again
                index, rows = {}, rows[:0]
            new = list({w for t in tallies for w in t if w not in index})
            if new and langs:
                index.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
                rows = np.concatenate([rows, scorer(new)])
            lang_pred, score = [], []
            for t in tallies:
                if not langs or not (any(w.isalpha() for w in t) or any(c.isalpha() for w in t for c in w)):
                    lang_pred.append("und")
                    score.append(0.0)
                    continue
                total = np.fromiter(t.values(), float, len(t)) @ rows[[index[w] for w in t]]
                q = np.exp(total - total.max())
                best = int(np.argmax(total))
                lang_pred.append(langs[best])
                score.append(float(q[best] / q.sum()))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(lang_pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def langid(docs: DataFrame, p: Unigrams = Unigrams()) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior of lang_pred, equal priors) of every row.

    Rows whose crc32(doc_id) mod 4 is 2 are never learned (held_out). A text that is null or
    has no letter gives und with score 0, as does every text if nothing could be learned.
    Rows that repeat score alike; an empty table gives an empty result; columns beyond those
    named are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang", (id_mod("doc_id", 4) == 2).alias("held_out"))
    return predict(docs, train(docs.filter("not held_out"), p), p.cache)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid(table(spark, sf_dir, "documents"))
