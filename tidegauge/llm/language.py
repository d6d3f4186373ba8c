"""Languages of documents and of their stretches, with calibrated confidence.

A sparse multinomial logistic regression on TF-IDF weighted character n-grams, trained with follow-the-regularised-leader
and elastic-net penalties, then calibrated by a temperature on held-out samples. The score of a text is a sum over its
words, so that each distinct word is scored once per task.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge import model

#: Words are runs without blanks, digits, ASCII and common other punctuation.
_WORD = re.compile(r"[^\s\d\x00-\x40\[-`{-~。、，！？：；・「」（）«»“”„‘’…·|–—]+")
#: A sentence ends with its mark before a blank, with a full-width mark, or with the line.
_END = re.compile(r"[.!?]+[\"'”»)\]]*(?=\s|\Z)|[。！？]+[」』”\"]*|\n")
_ADDRESS = re.compile(r"\S*\w\.\w\S*")
LONGEST = 5  # characters of an n-gram, the word's edges included

# Usual names of the languages; codes of two and three letters (both forms), English and native names.
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish", "vlaams"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "pl": ("pl", "pol", "polish", "polski"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "da": ("da", "dan", "danish", "dansk"),
    "ru": ("ru", "rus", "russian", "русский"),
    "uk": ("uk", "ukr", "ukrainian", "українська"),
    "tr": ("tr", "tur", "turkish", "türkçe", "turkce"),
    "ja": ("ja", "jpn", "japanese", "日本語", "nihongo"),
}


def _lower(text: str) -> str:
    """Lower case of the same length."""
    return text.replace("İ", "i").lower()


def _sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of each sentence or line with content; ``whole`` ones end with a mark, titles and menus don't."""
    out, at = [], 0
    for m in _END.finditer(text):
        end = m.end()
        whole = text[end - 1] != "\n"
        part = text[at:end]
        if not part.isspace():
            out.append((at + len(part) - len(part.lstrip()), end if whole else end - 1, whole))
        at = end
    if at < len(text) and not text[at:].isspace():
        out.append((at, len(text), False))
    return out


def _grams(word: str) -> list[str]:
    w = f" {word} "
    n = len(w)
    return [w[i : i + k] for k in range(1 + (n > 3), min(LONGEST, n) + 1) for i in range(n - k + 1)] + ([*word] if n > 3 else [])


def variants(text: str, number: int, most: int = 5) -> list[str]:
    """The text as it also turns up: without accents, and decoded with wrong charsets, ``most`` of them, by ``number`` in turn."""
    out = []
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).translate(str.maketrans("łŁøØßæÆı", "lLoOsaAi"))
    wrong = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "iso8859-15"), ("cp1252", "utf-8"), ("cp1251", "latin-1"), ("koi8-r", "latin-1"),
             ("koi8-u", "cp1251"), ("cp1251", "koi8-u"), ("iso8859-2", "latin-1"), ("cp1250", "latin-1"), ("iso8859-9", "latin-1"), ("shift_jis", "latin-1"), ("shift_jis", "cp1252"),
             ("euc_jp", "latin-1"), ("cp1251", "utf-8"), ("utf-8", "ascii"), ("shift_jis", "utf-8"), ("utf-8", "cp1251"), ("utf-8", "shift_jis")]
    for stored, read in wrong:
        try:
            out.append(text.encode(stored).decode(read, errors="replace"))
        except (UnicodeEncodeError, LookupError):
            continue
    out = [v for v in dict.fromkeys(out) if v != text]
    turn = [out[(number + i) % len(out)] for i in range(min(most, len(out)))]
    return list(dict.fromkeys([text, bare, *turn]))


@dataclass
class LanguageModel:
    """``vectors[j]`` are the weights of n-gram ``vocabulary[gram] = j``, its inverse document frequency included."""

    languages: list[str]
    vocabulary: dict[str, int]
    vectors: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def word(self, word: str) -> tuple[np.ndarray, int]:
        grams = _grams(word)
        get = self.vocabulary.get
        known = [j for g in grams if (j := get(g)) is not None]
        return self.vectors[known].sum(axis=0), len(grams)

    def logits(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (sums / np.sqrt(np.maximum(counts, 1))[:, None] + self.bias) / self.temperature


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _bag(text: str) -> Counter:
    bag: Counter = Counter()
    for w in _WORD.findall(_lower(text)):
        bag.update(_grams(w))
    return bag


def _ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, epochs: int, alpha: float, l1: float, l2: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with elastic net; the last feature is the bias, without penalty."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)
    rng = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            at, x, y = samples[i]
            za, na = z[at], n[at]
            w = weights(za, na)
            b = -zb / ((1.0 + np.sqrt(nb)) / alpha)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    return weights(z, n), -zb / ((1.0 + np.sqrt(nb)) / alpha)


def fit(samples: list[tuple[str, str]], lines: list[tuple[str, str]] = [], epochs: int = 3, alpha: float = 0.3, l1: float = 0.02, l2: float = 0.05, held_out: int = 5, seed: int = 7) -> LanguageModel:
    """A calibrated model from (language, text) pairs, and from ``lines`` likewise, which are never held out.

    Every ``held_out``-th sample first stays out: on fragments of two words of it (whole ones are hardly ever mistaken) a model of the others gets its temperature (least
    negative log-likelihood); the final model learns all samples.
    """
    samples = [(lang, text) for lang, text in samples if lang and text and text.strip()]
    languages = sorted({lang for lang, _ in samples})
    lines = [(lang, text) for lang, text in lines if lang in languages and text and text.strip()]

    def pieces(some: list[tuple[str, str]]) -> list[tuple[int, int, Counter]]:
        """(number of the text, language, bag) of each text's variants and sentences."""
        out = []
        for i, (lang, text) in enumerate(some):
            y = languages.index(lang)
            for v in variants(text, len(out)):
                out.append((i, y, _bag(v)))
            sentences = _sentences(text)
            if len(sentences) > 1:
                out += [(i, y, _bag(text[a:b])) for a, b, _ in sentences]
        return [(i, y, b) for i, y, b in out if b]

    def learn(bags: list[tuple[int, Counter]]) -> LanguageModel:
        df = Counter(g for _, b in bags for g in b)
        vocabulary = {g: j for j, g in enumerate(sorted(g for g, c in df.items() if c >= 3))}
        idf = np.array([np.log((1 + len(bags)) / (1 + df[g])) + 1 for g in vocabulary])
        rows = []
        for y, b in bags:
            known = [(j, c) for g, c in b.items() if (j := vocabulary.get(g)) is not None]
            at = np.array([j for j, _ in known], dtype=np.int64)
            x = np.array([c for _, c in known], dtype=np.float64)
            rows.append((at, x * idf[at] / np.sqrt(sum(b.values())), y))
        w, bias = _ftrl(rows, len(vocabulary), len(languages), epochs, alpha, l1, l2, seed)
        used = np.flatnonzero(np.any(w != 0, axis=1))
        order = list(vocabulary)
        return LanguageModel(languages, {order[j]: i for i, j in enumerate(used)}, (w[used] * idf[used, None]).astype(np.float32), bias)

    bags = pieces(samples + lines)
    aside = {i for i in range(0, len(samples), held_out)}
    out = [(lang, s) for i, (lang, text) in enumerate(samples) if i in aside for s in _fragments(text)]
    temperature = 1.0
    if out and len({lang for i, (lang, _) in enumerate(samples) if i not in aside}) == len(languages):
        trial = learn([(y, b) for i, y, b in bags if i not in aside])
        logits = np.array([_score(trial, s) for _, s in out])
        truth = np.array([languages.index(lang) for lang, _ in out])
        choices = np.geomspace(0.05, 5.0, 93)
        loss = [-log_softmax(logits / t)[np.arange(len(truth)), truth].mean() for t in choices]
        temperature = float(choices[int(np.argmin(loss))])
    final = learn([(y, b) for _, y, b in bags])
    final.temperature = temperature
    return final


def _fragments(text: str) -> list[str]:
    words = text.split()
    if len(words) < 4:  # no blanks between words
        return [text[i : i + 5] for i in range(0, len(text), 5)]
    return [" ".join(words[i : i + 2]) for i in range(0, len(words) - 1, 2)]


def _score(m: LanguageModel, text: str) -> np.ndarray:
    parts = [m.word(w) for w in _WORD.findall(_lower(text))]
    if not parts:
        return m.bias / m.temperature
    return m.logits(np.sum([p[0] for p in parts], axis=0)[None, :], np.array([sum(p[1] for p in parts)]))[0]


class _Words(dict):
    """Numbers of words; new ones are queued for scoring."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self)
        self.fresh.append(w)
        return n


@dataclass(frozen=True)
class Rules:
    least_stretch: int = 200  # characters
    switch: float = 6.0  # cost of a change of language between sentences, in log-likelihood
    cap: float = 40.0  # most a sentence can say against a language, in log-likelihood
    line_cap: float = 3.0  # likewise a line that isn't a sentence: titles, menus, lists
    words_kept: int = 400_000  # distinct words whose scores a task keeps at once


class Segmenter:
    """Languages of the sentences of texts, in batches."""

    def __init__(self, m: LanguageModel, rules: Rules):
        self.m, self.rules = m, rules
        self._reset()

    def _reset(self) -> None:
        self.words = _Words()
        k = len(self.m.languages)
        self.sums, self.counts, self.size = np.zeros((1024, k), dtype=np.float32), np.zeros(1024, dtype=np.float32), 0

    def _grow(self) -> None:
        need = len(self.words)
        if need > len(self.sums):
            new = max(need, 2 * len(self.sums))
            self.sums = np.concatenate([self.sums, np.zeros((new - len(self.sums), self.sums.shape[1]), dtype=np.float32)])
            self.counts = np.concatenate([self.counts, np.zeros(new - len(self.counts), dtype=np.float32)])
        # the new words' n-grams, gathered flat
        get, flat, ends, totals = self.m.vocabulary.get, [], [], []
        for w in self.words.fresh:
            grams = _grams(w)
            flat += [j for g in grams if (j := get(g)) is not None]
            ends.append(len(flat))
            totals.append(len(grams))
        n = len(self.words.fresh)
        if n:
            cum = np.zeros((len(flat) + 1, self.sums.shape[1]))
            np.cumsum(self.m.vectors[flat], axis=0, out=cum[1:])
            starts = np.r_[0, ends[:-1]]
            self.sums[need - n : need] = cum[ends] - cum[starts]
            self.counts[need - n : need] = totals
        self.words.fresh = []

    def sentences(self, texts: list[str]) -> list[tuple[list[tuple[int, int, bool]], np.ndarray, np.ndarray]]:
        """Of each text: the sentences' spans, their summed scores and numbers of n-grams. Addresses have no words."""
        if len(self.words) > self.rules.words_kept:
            self._reset()
        words, flat, ends, spans, sizes = self.words, [], [], [], []
        find = _WORD.findall
        for t in texts:
            low = _lower(t)
            own = _sentences(low)
            for a, b, _ in own:
                if low.find(".", a, b - 1) >= 0:
                    flat += [words[w] for w in find(_ADDRESS.sub(" ", low[a:b]))]
                else:
                    flat += [words[w] for w in find(low, a, b)]
                ends.append(len(flat))
            spans.append(own)
            sizes.append(len(own))
        self._grow()
        k = self.sums.shape[1]
        ends_a = np.array(ends, dtype=np.int64)
        sums, counts = np.zeros((len(ends), k)), np.zeros(len(ends))
        step = 200_000  # sentences at once
        starts_a = np.r_[0, ends_a[:-1]] if len(ends) else ends_a
        ids = np.array(flat, dtype=np.int64)
        for i in range(0, len(ends), step):
            a, b = starts_a[i], ends_a[min(i + step, len(ends)) - 1]
            cum = np.zeros((b - a + 1, k))
            np.cumsum(self.sums[ids[a:b]], axis=0, out=cum[1:])
            sums[i : i + step] = cum[ends_a[i : i + step] - a] - cum[starts_a[i : i + step] - a]
            c = np.r_[0.0, np.cumsum(self.counts[ids[a:b]])]
            counts[i : i + step] = c[ends_a[i : i + step] - a] - c[starts_a[i : i + step] - a]
        out, at = [], 0
        for own, n in zip(spans, sizes):
            out.append((own, sums[at : at + n], counts[at : at + n]))
            at += n
        return out

    def path(self, sums: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Most likely language of each sentence, changes of language costing ``switch``; other lines say little."""
        score = log_softmax(self.m.logits(sums, counts))
        best = score.argmax(axis=1)
        if len(best) < 2 or (best == best[0]).all():
            return best
        score = np.maximum(score - score.max(axis=1, keepdims=True), -np.where(whole, self.rules.cap, self.rules.line_cap)[:, None])
        score[counts == 0] = 0.0
        k = score.shape[1]
        total, back = score[0], np.zeros((len(score), k), dtype=np.int64)
        for i in range(1, len(score)):
            top = int(total.argmax())
            changed = total[top] - self.rules.switch
            back[i] = np.where(total >= changed, np.arange(k), top)
            total = np.maximum(total, changed) + score[i]
        out = np.empty(len(score), dtype=np.int64)
        out[-1] = int(total.argmax())
        for i in range(len(score) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def segments(self, text: str, own: list[tuple[int, int, bool]], sums: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(start, end, language, confidence, prose) of each stretch in one language.

        ``prose`` is the length of its whole sentences: titles and menus, which end without a mark, don't count.
        """
        if not own:
            return []
        whole = np.array([w for _, _, w in own])
        path = self.path(sums, counts, whole)
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            said = whole[a:b] if whole[a:b].any() else ~whole[a:b]
            p = np.exp(log_softmax(self.m.logits(sums[a:b][said].sum(axis=0)[None, :], np.array([counts[a:b][said].sum()])))[0])
            lang = int(path[a])
            prose = sum(e - s + 1 for s, e, w in own[a:b] if w) - 1
            out.append((own[a][0], own[b - 1][1], lang, float(p[lang]), max(prose, 0)))
        return out


def languages_of(segments: list[tuple[int, int, int, float, int]], least: int) -> list[tuple[int, float, int]]:
    """(language, confidence, characters) of a text: those with a stretch of ``least`` characters, else the one of most of it."""
    longest: dict[int, tuple[int, float]] = {}
    chars: Counter = Counter()
    sure: Counter = Counter()
    for start, end, lang, p, prose in segments:
        chars[lang] += end - start
        sure[lang] += p * (end - start)
        if prose >= least and prose > longest.get(lang, (0, 0.0))[0]:
            longest[lang] = (prose, p)
    if longest:
        return [(lang, p, chars[lang]) for lang, (_, p) in sorted(longest.items())]
    if not chars:
        return []
    weight: Counter = Counter()
    for start, end, lang, _, prose in segments:
        weight[lang] += prose * 4 + end - start
    lang = max(weight, key=lambda x: (weight[x], -x))
    return [(lang, sure[lang] / max(1, chars[lang]), chars[lang])]


def repeated_lines(documents: DataFrame, max_documents: int = 4_000, least: int = 3, share: float = 0.6, max_lines: int = 4_000) -> list[tuple[str, str]]:
    """(language, line) of lines that at least ``least`` labelled documents share, a ``share`` of which agree on the language.

    Menus and notices hardly occur in clean samples. The lines come from a bounded sample of labelled rows: the documents
    whose id has one of the smallest hashes, about ``max_documents`` of all; of the lines the ``max_lines`` most frequent count.
    """
    share_read = min(1.0, max_documents / max(1, documents.count()))
    d = documents.where("doc_id is not null and text is not null").where((F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / 2.0**63) <= share_read)
    d = d.select("doc_id", label_language("lang").alias("lang"), "text").where("lang is not null")
    line = d.select("doc_id", "lang", F.explode(F.array_distinct(F.split("text", r"\s*\n\s*"))).alias("line")).where("length(trim(line)) > 2")
    votes = line.groupBy("line", "lang").agg(F.count("*").alias("n"))
    best = votes.groupBy("line").agg(F.sum("n").alias("all"), F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("n"))
    best = best.where((F.col("n") >= least) & (F.col("n") >= share * F.col("all")))
    return [(r["lang"], r["line"]) for r in best.orderBy(F.desc("n"), "line").limit(max_lines).collect()]


_TRAINED: dict[str, LanguageModel] = {}


def train(lang_sample: DataFrame, documents: DataFrame | None = None, samples_per_language: int = 2_000) -> LanguageModel:
    """Model of a labelled sample, and of the lines that labelled ``documents`` share (see :func:`repeated_lines`).

    At most ``samples_per_language`` rows of each language, those whose ids have the smallest hashes, are learnt from. A
    model is trained once in a Python process for the same rows and lines.
    """
    model.utc(lang_sample.sparkSession)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("sample_id"), "sample_id", "text"))
    rows = lang_sample.where("lang is not null and text is not null").select("sample_id", "lang", "text", rank.alias("rank__")).where(F.col("rank__") <= samples_per_language)
    rows = sorted(((r["sample_id"] is None, r["sample_id"], r["lang"], r["text"]) for r in rows.collect()), key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
    samples, lines = [r[2:] for r in rows], repeated_lines(documents) if documents is not None else []
    key = hashlib.sha256(repr((samples, lines)).encode()).hexdigest()
    if key not in _TRAINED:
        while len(_TRAINED) >= 4:
            _TRAINED.pop(next(iter(_TRAINED)))
        _TRAINED[key] = fit(samples, lines)
    return _TRAINED[key]


def _apply(documents: DataFrame, m: LanguageModel, rules: Rules, schema: str, rows, label: Column | None = None) -> DataFrame:
    """One pass over the texts; ``rows`` appends a document's rows from its segments. ``label`` goes along as a last column."""
    model.utc(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(m)
    labelled = label is not None
    parts = [f.split() for f in (schema + (", label string" if labelled else "")).split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Segmenter(sent.value, rules)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, texts = part["doc_id"].to_pylist(), part["text"].to_pylist()
                tails = [(x,) for x in part["label"].to_pylist()] if labelled else [()] * len(ids)
                out: list[tuple] = []
                for doc, text, tail, (own, sums, counts) in zip(ids, texts, tails, s.sentences(texts)):
                    out.extend(row + tail for row in rows(doc, s.segments(text, own, sums, counts), sent.value.languages))
                columns = list(zip(*out)) if out else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)

    texts = documents.where("doc_id is not null and text is not null and trim(text) <> ''")
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([label.alias("label")] if label is not None else []))
    return model.spread(texts).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in parts))


def segments(documents: DataFrame, m: LanguageModel, rules: Rules = Rules()) -> DataFrame:
    """``(doc_id, segment, start, stop, lang, confidence)`` of each stretch, in characters of the text, in order.

    NULL, empty and blank texts have none. Texts are read whole. A text of digits and marks only gets the language that is
    likeliest beforehand, with that low confidence.
    """

    def rows(doc: int, found: list, names: list[str]) -> list[tuple]:
        return [(doc, i, start, end, names[lang], p) for i, (start, end, lang, p, _) in enumerate(found)]

    return _apply(documents, m, rules, "doc_id long, segment int, start int, stop int, lang string, confidence double", rows)


def document_languages(documents: DataFrame, m: LanguageModel, rules: Rules = Rules()) -> DataFrame:
    """``(doc_id, lang, confidence, chars, languages)``: one row per language a document is in.

    A document is in each language with a stretch of at least ``least_stretch`` characters of whole sentences; if there
    is none, in the language of most of it. ``chars`` are all its characters in the language, ``languages`` is the number
    of the document's rows.
    """

    return _apply(documents, m, rules, _LANGUAGES, _language_rows(rules))


_LANGUAGES = "doc_id long, lang string, confidence double, chars int, languages int"


def _language_rows(rules: Rules):
    def rows(doc: int, found: list, names: list[str]) -> list[tuple]:
        langs = languages_of(found, rules.least_stretch)
        return [(doc, names[lang], p, n, len(langs)) for lang, p, n in langs]

    return rows


def label_language(label: str) -> Column:
    """Code of the one language that a label denotes in a usual spelling, else NULL.

    Case, blanks, a region after ``-`` or ``_`` and a remark in parentheses don't matter.
    """
    plain = F.lower(F.regexp_replace(F.regexp_replace(label, r"\(.*\)", ""), r"^[\s\x{FEFF}]+|\s+$", ""))
    code = F.regexp_extract(plain, r"^([a-z]{2,3})[-_][a-z0-9]{2,4}(?:[-_][a-z0-9]+)*$", 1)
    key = F.when(code != "", code).otherwise(plain)
    names = F.create_map(*(F.lit(x) for lang, spelt in SPELLINGS.items() for s in spelt for x in (s, lang)))
    return names[key]


def relabelled(documents: DataFrame, m: LanguageModel, rules: Rules = Rules()) -> DataFrame:
    """Like :func:`document_languages`, only documents whose label is missing or wrong or that are in several languages.

    The label goes through the one pass over the texts, so that nothing is joined or shuffled.
    """
    found = _apply(documents, m, rules, _LANGUAGES, _language_rows(rules), label_language("lang"))
    return found.where("languages > 1 or label is null or label <> lang").drop("label")
