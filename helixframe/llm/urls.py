"""URL filters: rules, then naive Bayes over segmented host names and path tokens.

Host labels without separators ("bluebird") are split by Viterbi over a unigram model whose
words and rank-based probabilities come from a public vocabulary file. A multinomial naive
Bayes model over the words of host and path learns from the urls that the rules decide, with
the rules' verdicts as classes, and judges the rest.

Token counts cover all decided urls, and every token counts: words come from the vocabulary,
and stretches that no word covers are taken letter by letter, numbers by their length (20 digits
and more are alike), so the vocabulary and the alphabet bound the model.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

#: (verdict, host, path): fixed values of the rule set.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)

_LOWER = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile(r"[^\W_]+")
_RUNS = re.compile(r"\d+|[^\W\d_]+")


@dataclass(frozen=True)
class Bayes:
    vocabulary: str | None = None  #: a word vocabulary of the tokenizers library (None: the public one)
    smoothing: float = 0.5
    longest: int = 20
    unknown: float = -14.0  #: log probability of a letter outside all words


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(_LOWER), path[: min((k for c in "?#" if (k := path.find(c)) >= 0), default=len(path))]


def rule_of(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule as text, verdict) of the longest rule that fits, or None."""
    fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: (len(x[0]), x[0]), default=None)


@lru_cache(maxsize=4)
def word_model(p: Bayes) -> dict[str, float]:
    """log probabilities of whole words: by rank in the vocabulary, as its order follows frequency."""
    path = p.vocabulary
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w.removesuffix("</w>") for w in sorted(vocab, key=vocab.get) if w.endswith("</w>")]
    words = [w for w in words if w.isalpha() and (len(w) > 1 or w in "ai") and len(w) <= p.longest]
    total = math.log(sum(1 / (k + 10) for k in range(len(words))))
    return {w: -math.log(k + 10) - total for k, w in reversed(list(enumerate(words)))}


def segment(name: str, model: dict[str, float], p: Bayes) -> list[str]:
    """The most probable split of a name into words (ties: the longer last word)."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for j in range(1, len(name) + 1):
        for i in range(max(0, j - p.longest), j):
            s = best[i] + model.get(name[i:j], p.unknown * (j - i) if j - i == 1 else -math.inf)
            if s > best[j]:
                best[j], back[j] = s, i
    out, j = [], len(name)
    while j:
        out.append(name[back[j] : j])
        j = back[j]
    return out[::-1]


class Tokens:
    """tokens(host, path), with a cache of segmented names."""

    def __init__(self, p: Bayes):
        self.p, self.model, self.known = p, word_model(p), {}

    def _words(self, run: str) -> list[str]:
        if run.isdigit():
            return [f"#{min(len(run), 20)}"]
        got = self.known.get(run)
        if got is None:
            if len(self.known) > 200_000:  # only a cache
                self.known.clear()
            got = self.known[run] = segment(run, self.model, self.p)
        return got

    def __call__(self, host: str, path: str) -> list[str]:
        labels = host.split(".")
        # the registered name's labels are what rules are about; segmenting applies to all labels
        return [f"h:{w}" for x in labels for r in _RUNS.findall(x) for w in self._words(r)] + [f"p:{w}" for t in _TOKEN.findall(path.lower()) for r in _RUNS.findall(t) for w in self._words(r)]


def train(pages: DataFrame, rules=RULES, p: Bayes = Bayes()) -> dict:
    """Log odds (block against allow) of all tokens, of an unseen token, and the prior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(p)
        for b in batches:
            got: Counter = Counter()
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                if (r := rule_of(host, path, rules)) is not None:
                    got[r[1], ""] += 1
                    got.update((r[1], t) for t in tokens(host, path))
            yield pa.record_batch([pa.array([k[i] for k in got], pa.string()) for i in (0, 1)] + [pa.array(list(got.values()), pa.int64())], ["verdict", "token", "n"])

    counts = pages.select("url").mapInArrow(run, "verdict string, token string, n long").groupBy("token").agg(
        *[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow")]
    )
    seen = {r.token: r for r in counts.collect()}  # words of the vocabulary, letters and lengths, for host and path
    urls = seen.pop("", None)
    total = [sum(r[v] for r in seen.values()) + p.smoothing * (len(seen) + 1) for v in ("block", "allow")]
    odds = {t: math.log((r.block + p.smoothing) / total[0]) - math.log((r.allow + p.smoothing) / total[1]) for t, r in seen.items()}
    prior = math.log((urls.block + 0.5) / (urls.allow + 0.5)) if urls else -math.inf
    return {"odds": odds, "unseen": math.log(total[1] / total[0]), "prior": prior}


def judge(pages: DataFrame, rules=RULES, p: Bayes = Bayes()) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block by the model) of every row.

    A null url, or one without ``://``, has empty host and path, no rule, and the model's
    prior verdict. Without a decided url to learn from, the model allows all. A token that no
    decided url has takes the smoothed odds of an unseen one. Rows that repeat are judged alike; an empty table gives an
    empty result; columns beyond page_id and url are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url")
    sent = pages.sparkSession.sparkContext.broadcast(train(pages, rules, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, odds, unseen, prior = Tokens(p), sent.value["odds"], sent.value["unseen"], sent.value["prior"]
        for b in batches:
            rows = []
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                r = rule_of(host, path, rules)
                score = prior + sum(odds.get(t, unseen) for t in tokens(host, path))
                rows.append((host, path, r and r[0], r[1] if r else "block" if score > 0 else "allow", score))
            cols = [pa.array([x[k] for x in rows], pa.string()) for k in range(4)] + [pa.array([x[4] for x in rows], pa.float64())]
            yield pa.record_batch([b.column("page_id"), *cols], ["page_id", "host", "path", "rule", "verdict", "score"])

    return pages.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))
