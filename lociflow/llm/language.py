"""Languages of documents and of their segments, with a confidence.

The classifier is a sparse multinomial logistic regression on TF-IDF of character n-grams, trained with
follow-the-regularised-leader and an elastic-net penalty on a bounded sample of labelled documents, and
calibrated by a temperature on held-out units. Labels of the sample are partly wrong, so documents that a first
model contradicts are left out of the second fit.

A text is cut into words; symbols, numbers, mark-up and lines of tabulated calls have no language. Every word has
the calibrated log-probabilities of the classifier, and the best sequence of languages over the words (changes
cost much inside a sentence, less between sentences) gives the segments. The confidence of a segment is the
calibrated probability of its language given all its n-grams.

Scale: the model (a few thousand n-grams with non-zero weights) is fit once on the driver and travels to the
workers; each document is then read whole, once, without a shuffle; equal words are scored once per worker.

Defined results: null, empty or symbol-only texts have no segments; only the languages in LANGUAGES exist; a label
in any spelling names a language by code or name, with or without a region; repeated rows give equal results; an
empty table, or one without usable labels, gives no segments; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.sampling import hash_sample

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl")
#: Codes and names of each language. Fixed values.
NAMES = {
    "en": "en eng english englisch anglais ingles inglese engels angielski",
    "de": "de deu ger german deutsch allemand aleman tedesco alemao duits niemiecki",
    "fr": "fr fra fre french francais franzosisch frances francese frans francuski",
    "es": "es spa spanish espanol castellano castilian spanisch espagnol spagnolo espanhol spaans hiszpanski",
    "it": "it ita italian italiano italienisch italien italiaans wloski",
    "pt": "pt por portuguese portugues portugiesisch portugais portoghese portugees portugalski",
    "nl": "nl nld dut dutch nederlands niederlandisch neerlandais neerlandes holandes olandese hollands vlaams flemish niderlandzki",
    "pl": "pl pol polish polski polnisch polonais polaco polacco polones pools",
}
_CODE = {n: k for k, v in NAMES.items() for n in v.split()}
CONSONANTS = "BCDFGHJKLMNPQRSTVX"  # alone no word in these languages
MOST_SEEN = 200_000  # what a worker keeps of words is dropped beyond so many
SCHEMA = "doc_id bigint, segment int, lang string, confidence double, n_words int, at_word int"
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?/?>", re.S)
_NOTHING = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t\r]*\n\s*(?=[^\W\d_])")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’ʼ-][^\W\d_]+)*['’]?", re.U)


def named_language(label: str | None) -> str | None:
    """The language that a label names, if any."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", label or "").casefold().replace("ł", "l") if not unicodedata.combining(c))
    for part in re.split(r"[^a-z]+", plain):
        if part:
            return _CODE.get(part)
    return None


def label_sql(column: str):
    """named_language as a column expression."""
    marks = {chr(c): b for c in range(0xC0, 0x180) if (b := unicodedata.normalize("NFD", chr(c))[0].lower()).isascii() and b.isalpha()} | {"ł": "l", "Ł": "l"}
    plain = F.translate(F.lower(F.regexp_replace(F.col(column), "[\\u0300-\\u036f]", "")), "".join(marks), "".join(marks.values()))
    first = F.regexp_extract(plain, "^[^a-z]*([a-z]+)", 1)
    return F.create_map(*(F.lit(x) for kv in _CODE.items() for x in kv))[first]


class Raw:
    """What is told of a piece of text between spaces, whatever stands around it."""

    __slots__ = ("word", "kind", "symbol", "letters", "capitals", "stops")

    def __init__(self, raw: str) -> None:
        w = _EDGE.sub("", raw)
        self.word = w.lower().replace("’", "'")
        self.kind = bool(_LETTERS.fullmatch(w)) if w else None  # a word, a symbol or number, nothing
        self.symbol = bool(self.kind) and w.isupper() and (len(w) > 1 or w in CONSONANTS)  # unless capitals are all around
        letters = [c for c in raw if c.isalpha()] if self.kind and len(raw) > 1 else []
        self.letters, self.capitals = len(letters), sum(map(str.isupper, letters))
        self.stops = raw[-1] in ".!?" or raw[-2:] in ('."', '?"', ".)", ".»", ".”")


def tokens(text: str, seen: dict[str, Raw] | None = None) -> list[tuple[str, bool, int]]:
    """(word in lower case, a sentence starts here, words that it stands for) of the words that have a language.

    A symbol or number has no language of its own but counts as a word of the sentence around it. seen: what is known
    of pieces of text, kept from one call to the next.
    """
    seen = {} if seen is None else seen
    if len(seen) > MOST_SEEN:
        seen.clear()
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _NOTHING.sub("", unicodedata.normalize("NFKC", text))
    text = _BROKEN.sub("", text)
    out: list[tuple[str, bool, int]] = []
    for line in text.split("\n"):
        raws = []
        for x in line.split():
            r = seen.get(x)
            if r is None:
                r = seen[x] = Raw(x)
            raws.append(r)
        letters = sum(r.letters for r in raws)
        shouted = letters >= 12 and sum(r.capitals for r in raws) > 0.7 * letters
        kinds = [r.kind and (shouted or not r.symbol) for r in raws]
        if "\t" in line and sum(map(bool, kinds)) < 0.5 * len(kinds):
            continue
        start, waiting = True, 0
        for r, k in zip(raws, kinds):
            if k:
                out.append((r.word, start, 1 + waiting))
                start, waiting = False, 0
            elif k is not None and start:
                waiting += 1
            elif k is not None:
                out[-1] = (*out[-1][:2], out[-1][2] + 1)
            if r.stops:
                start, waiting = True, 0
    return out


def ngrams(word: str, low: int = 1, high: int = 4) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]


@dataclass
class Model:
    index: dict[str, int]
    idf: np.ndarray
    weights: np.ndarray  # (n-grams, languages), already times idf
    bias: np.ndarray
    temperature: float


class Ftrl:
    """Follow the regularised leader, proximal, per coordinate, with L1 and L2 penalties, for softmax loss."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.zb, self.nb = np.zeros(classes), np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def rows(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> np.ndarray:
        return -self.zb / ((self.beta + np.sqrt(self.nb)) / self.alpha + 1.0)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w, b = self.rows(at), self.bias()
        s = x @ w + b
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.zb += p - (np.sqrt(self.nb + p * p) - np.sqrt(self.nb)) / self.alpha * b
        self.nb += p * p


def _features(words: list[str], index: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = Counter(index[g] for w in words for g in ngrams(w) if g in index)
    at = np.fromiter(c.keys(), int, len(c))
    x = np.fromiter(c.values(), float, len(c)) * idf[at] if c else np.zeros(0)
    return at, x / (np.linalg.norm(x) or 1.0)


def _scores(units, weights, bias) -> np.ndarray:
    return np.array([x @ weights[at] + bias for at, x in units]) if units else np.zeros((0, len(bias)))


def train(rows: list[tuple[str, str]], units: int = 12000, min_df: int = 4, most_ngrams: int = 40000, epochs: int = 2, seed: int = 7) -> Model | None:
    """rows (text, language). Units are sentences, and single words of them for the calibration of words."""
    rng, seen = np.random.default_rng(seed), {}
    data: list[tuple[list[str], int, int]] = []  # words, language, document
    for doc, (text, lang) in enumerate(rows):
        sentence: list[str] = []
        for w, start, _ in [*tokens(text, seen), ("", True, 0)]:
            if start and sentence:
                if len(sentence) >= 3:
                    data.append((sentence, LANGUAGES.index(lang), doc))
                sentence = []
            sentence.append(w)
    if not data:
        return None
    data = [data[i] for i in rng.permutation(len(data))[:units]]
    df = Counter(g for ws, _, _ in data for g in {g for w in ws for g in ngrams(w)})
    kept = sorted((g for g, n in df.items() if n >= min(min_df, max(1, len(data) // 20))), key=lambda g: (-df[g], g))[:most_ngrams]
    index = {g: i for i, g in enumerate(kept)}
    idf = np.array([np.log((1 + len(data)) / (1 + df[g])) + 1 for g in kept])
    held = len(data) // 10
    clean = data
    for fit in range(2):
        f = Ftrl(len(kept), len(LANGUAGES))
        single = [([ws[i]], y) for ws, y, _ in clean[held:] for i in rng.choice(len(ws), 1)]
        lot = [(_features(x[0], index, idf), x[1]) for x in [*clean[held:], *single]]
        for _ in range(epochs if fit else 1):
            for i in rng.permutation(len(lot)):
                (at, x), y = lot[i]
                if len(at):
                    f.step(at, x, y)
        weights, bias = f.rows(slice(None)), f.bias()
        if not fit:  # documents that contradict their label are left out as a whole, so that no kind of sentence is
            total: dict[int, np.ndarray] = {}
            for (_, _, doc), p in zip(data, _scores([_features(x[0], index, idf) for x in data], weights, bias)):
                total[doc] = total.get(doc, 0) + p
            clean = [x for x in data if total[x[2]].argmax() == x[1]] or data
            held = len(clean) // 10
    test = [*(x[:2] for x in clean[:held]), *(([ws[i]], y) for ws, y, _ in clean[:held] for i in range(0, len(ws), 4))] or [x[:2] for x in clean]
    s, ys = _scores([_features(ws, index, idf) for ws, _ in test], weights, bias), np.array([y for _, y in test])

    def loss(t: float) -> float:
        z = s / t
        m = z.max(1)
        return float((np.log(np.exp(z - m[:, None]).sum(1)) + m - z[np.arange(len(ys)), ys]).mean())

    temperature = min(np.geomspace(0.1, 5, 60), key=loss)
    live = np.flatnonzero(np.abs(weights).sum(1) > 0)
    return Model({kept[i]: k for k, i in enumerate(live)}, idf[live].astype(np.float32), (weights[live] * idf[live, None]).astype(np.float32), bias, float(temperature))


class Scorer:
    """Segments of texts by a model; keeps the scores of words it has seen.

    inside, between: cost of a change of language inside a sentence and where one starts; least: the least that one
    word can say for a language, so that no single word decides.
    """

    AT_ONCE = 400_000  # words of the longest text times texts that are walked together

    def __init__(self, model: Model, inside: float = 9.0, between: float = 4.0, least: float = -3.5) -> None:
        self.m, self.inside, self.between, self.least = model, inside, between, least
        self.raws: dict[str, Raw] = {}
        self._new()

    def _new(self) -> None:
        """number of each word seen; by number its log-probabilities, n-grams and their weights together."""
        k = len(LANGUAGES)
        self.seen: dict[str, int] = {}
        self.says, self.weights, self.grams = np.zeros((1024, k)), np.zeros((1024, k)), []

    def number(self, w: str) -> int:
        i = self.seen.get(w)
        if i is None:
            i = self.seen[w] = len(self.seen)
            if i >= len(self.says):
                self.says, self.weights = (np.concatenate([x, np.zeros_like(x)]) for x in (self.says, self.weights))
            at = np.array([self.m.index[g] for g in ngrams(w) if g in self.m.index], np.int64)
            self.grams.append(at)
            self.weights[i] = self.m.weights[at].sum(0)
            self.says[i] = np.maximum(self._log(self.weights[i], self._norm(at)), self.least)
        return i

    def _norm(self, grams: np.ndarray) -> float:
        at, n = np.unique(grams, return_counts=True)
        return float(((n * self.m.idf[at]) ** 2).sum())

    def _log(self, s: np.ndarray, norm: float) -> np.ndarray:
        z = (s / (norm**0.5 or 1.0) + self.m.bias) / self.m.temperature
        z = z - z.max()
        return z - np.log(np.exp(z).sum())

    def segments(self, text: str | None) -> list[tuple[str, float, int, int]]:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """(language, confidence, words, number of the first word) of each text's segments, in the order of the text."""
        if len(self.seen) > MOST_SEEN:
            self._new()
        out: list[list] = [[] for _ in texts]
        mixed = []
        for k, text in enumerate(texts):
            ws = tokens(text, self.raws) if text else []
            if not ws:
                continue
            at = np.array([self.number(w) for w, _, _ in ws])
            stands = np.array([n for _, _, n in ws])
            e = self.says[at]
            if self._one_language(e):
                out[k] = self._named(at, stands, np.full(len(at), e.sum(0).argmax()))
            else:
                mixed.append((k, at, stands, np.array([s for _, s, _ in ws])))
        mixed.sort(key=lambda x: -len(x[1]))
        while mixed:
            n = max(1, self.AT_ONCE // len(mixed[0][1]))
            for (k, at, stands, _), path in zip(mixed[:n], self._paths(mixed[:n])):
                out[k] = self._named(at, stands, path)
            mixed = mixed[n:]
        return out

    def _paths(self, texts: list[tuple]) -> list[np.ndarray]:
        """The best sequence of languages over the words of each text, longest text first, all texts step by step."""
        sizes = np.array([len(at) for _, at, _, _ in texts])
        d, most, own = len(texts), sizes[0], np.arange(len(LANGUAGES), dtype=np.int8)
        e, cost = np.zeros((most, d, len(own))), np.full((most, d), self.inside)
        for k, (_, at, _, starts) in enumerate(texts):
            e[: len(at), k] = self.says[at]
            cost[: len(at), k] = np.where(starts, self.between, self.inside)
        back, best = np.zeros((most, d, len(own)), np.int8), e[0].copy()
        for i in range(1, most):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # texts of more than i words
            now = best[:n]
            top = now.argmax(1)
            change = (now[np.arange(n), top] - cost[i, :n])[:, None]
            stay = now >= change
            back[i, :n] = np.where(stay, own, top[:, None])
            best[:n] = np.where(stay, now, change) + e[i, :n]
        out = []
        for k, n in enumerate(sizes):
            path = np.empty(n, int)
            path[-1] = best[k].argmax()
            steps = back[:, k]
            for i in range(n - 1, 0, -1):
                path[i - 1] = steps[i, path[i]]
            out.append(path)
        return out

    def _one_language(self, e: np.ndarray) -> bool:
        """No stretch of words speaks for another language than the whole text's by half a change's cost, so that no
        sequence with changes can be better than one without."""
        c = np.cumsum(e - e[:, [e.sum(0).argmax()]], axis=0)
        low = np.minimum(np.minimum.accumulate(c, axis=0), 0)
        return bool((c[0].max() if len(c) == 1 else max(c[0].max(), (c[1:] - low[:-1]).max())) < min(self.between, self.inside) / 2)

    def _named(self, at: np.ndarray, stands: np.ndarray, path: np.ndarray) -> list[tuple[str, float, int, int]]:
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        runs: list[list] = []  # language, first, end, log-probabilities
        for a, b in zip(cuts, cuts[1:]):  # what a run's n-grams say together counts more than its words one by one
            said = self._sum(at[a:b])
            lang = int(said.argmax())
            if runs and runs[-1][0] == lang:
                runs[-1][2:] = [b, None]
            else:
                runs.append([lang, a, b, said])
        first = np.concatenate([[0], np.cumsum(stands)])
        return [(LANGUAGES[k], float(np.exp((self._sum(at[a:b]) if said is None else said)[k])), int(first[b] - first[a]), int(first[a])) for k, a, b, said in runs]

    def _sum(self, at: np.ndarray) -> np.ndarray:
        """log-probabilities of some words together, by their TF-IDF."""
        return self._log(self.weights[at].sum(0), self._norm(np.concatenate([self.grams[i] for i in at])))


def fit(docs: DataFrame, sample_docs: int = 4000, most_chars: int = 100_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from at most sample_docs labelled documents, the first in hash order of those of 20 to most_chars characters.

    These bounds hold for the sample that trains the classifier, so that it fits the driver; every document is classified.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), label_sql(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.length("text").between(20, most_chars))
    return train([(r.text, r.lang) for r in hash_sample(rows, "doc_id", sample_docs, rows.count()).collect()])


def segments(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, segment, lang, confidence, n_words, at_word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for b in batches:
            found = scorer.many(b.column(1).to_pylist()) if scorer else []
            rows = [(d, k, *s) for d, of in zip(b.column(0).to_pylist(), found) for k, s in enumerate(of)]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "segment", "lang", "confidence", "n_words", "at_word"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
