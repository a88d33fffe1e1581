"""Languages of documents and of the segments of mixed ones: hierarchical discrimination with linear SVMs.

A text is cut into running sentences; each gets first a language family (one-versus-rest linear support
vector machines) and then, within the family, the language that wins most one-versus-one machines.
Features are hashed character n-grams inside words and the words themselves, single characters and pairs
for scripts without word gaps. A word's scores under all machines are added up once and kept, so a
sentence costs one look-up a word.

The machines are trained on a bounded sample of labelled documents (``per_language`` documents a label). As labels are
often wrong, training is done twice: the second time without the sentences whose label the first model rejects.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

# Families of the languages told apart here.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv"),
    "romance": ("es", "fr", "it", "pt"),
    "sinitic": ("zh",),
    "slavic": ("ru",),
}
LANGUAGES = tuple(sorted(x for f in FAMILIES.values() for x in f))

# How labels name a language, lower case (ISO 639-1, 639-2 and 639-3, English and own names).
LABELS = {
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand"),
    "en": ("en", "eng", "english", "anglais", "englisch"),
    "es": ("es", "spa", "spanish", "castilian", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "漢語"),
}
_BY_LABEL = {name: code for code, names in LABELS.items() for name in names}

#: Documents taken as training sample per single-language label; the bound of what reaches the driver.
PER_LANGUAGE = 120
#: Characters of a sample document that are used for training (the rest would add little to a bounded sample).
TRAIN_CHARS = 4000
#: Sentences taken of a sample document.
SENTENCES = 6
DIMENSIONS = 1 << 16
#: Words whose scores a worker keeps.
KEPT_WORDS = 200_000

_MARKUP = regex.compile(r"<\|[^|<>]*\|>|</?[a-zA-Z!][^<>]{0,200}>|\\[a-zA-Z]+(\{[^{}]*\})*|\$[^$\n]{1,200}\$")
_MARKED = re.compile(r"[<\\$]")
_ENTITY = re.compile(r"&[a-zA-Z]{2,8};|&#\d{1,6};")
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]")
_GAP = re.compile(r"\n\s*\n")
_REFERENCE = regex.compile(r"^[^\S\n]*(?:\[\d+\]|\(\d+\)|\d+\.)[^\S\n]+\S.*\b(?:1[89]|20)\d\d[a-z]?\)?\.?[^\S\n]*$", regex.MULTILINE)
_NUMBERED = re.compile(r"^\s*[\[(\d]", re.MULTILINE)
_BROKEN = regex.compile(r"(?<=\p{L})[-­‐]\n(?=\p{Ll})")
_QUOTED = regex.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»|»[^«\n]{1,300}«|《[^》\n]{1,300}》|「[^」\n]{1,300}」")
_QUOTES = re.compile("[\"“„«»《「]")
_BRACKETS = regex.compile(r"\([^()]{0,120}\)|\[[^\[\]]{0,60}\]|（[^（）]{0,120}）")
_BRACKET = re.compile(r"[(\[（]")
_STOP = regex.compile(r"[.!?][\"'”’»)\]]{0,2}\s+(?=[\"'“„«(\[¿¡]?[\p{Lu}\p{N}\p{Lo}])|[。！？][\"'”’）)]{0,2}\s*")
# Shortened words that a full stop doesn't end a sentence after.
SHORTENED = frozenset("al vs cf ca bzw Dr Prof Fig Nr No pp St".split())
_WORD = regex.compile(r"\p{Script=Han}+|[\p{Script=Hiragana}\p{Script=Katakana}]+|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_HAN = re.compile("[\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]")
_CAMEL = regex.compile(r"(?<=\p{Ll})\p{Lu}")
_TOOL = regex.compile(r"(?<!\p{Script=Latin})\p{Script=Latin}+(?<=\p{Ll})(?=\p{Lu})\p{Script=Latin}+")
_CLOSED = regex.compile(r"[.!?。！？][\"'”’»)\]）]*\s*(\[[\d,–\- ]+\])?\s*$")
#: What makes a running sentence: words, or characters where a script has no word gaps.
LEAST_WORDS, LEAST_HAN = 5, 8
#: What a sentence in none of the scripts of the languages told apart is given (ISO 639-2).
UNDETERMINED = "und"
_LATIN = regex.compile(r"[\p{Script=Latin}']")
SCRIPTS = {"ru": regex.compile(r"\p{Script=Cyrillic}"), "zh": regex.compile(r"\p{Script=Han}")}


def label_languages(label: str | None) -> list[str]:
    """The languages a label names, in any notation; none if it is absent or undetermined."""
    if label is None:
        return []
    out = []
    for part in regex.split(r"[,;/|+&]|\band\b", label.lower()):
        part = part.strip()
        code = _BY_LABEL.get(part) or _BY_LABEL.get(regex.split(r"[-_\s(@.]", part)[0])
        if code and code not in out:
            out.append(code)
    return out


def _blank(m: regex.Match) -> str:
    return " " * len(m.group())


def _shortened(text: str, stop: int) -> bool:
    """Whether the full stop at ``stop`` ends an initial or a shortened word, not a sentence."""
    at = stop
    while at > 0 and stop - at < 6 and text[at - 1].isalpha():
        at -= 1
    word = text[at:stop]
    return (len(word) == 1 and word.isupper()) or word in SHORTENED or (word in ("g", "e") and text[at - 2 : at] in ("e.", "i."))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Start, end and words (lower case, with single blanks) of the whole running sentences; headings, references, names and
    symbols give none.

    Lines broken by page layout are joined; a heading is a paragraph without a full stop. Offsets are those of ``text``.
    """
    out = []
    plain = _MARKUP.sub(_blank, text) if _MARKED.search(text) else text
    if "&" in plain:
        plain = _ENTITY.sub(lambda m: html.unescape(m.group()).ljust(len(m.group()))[: len(m.group())], plain)
    if "\n" in plain:
        if _NUMBERED.search(plain):
            plain = _REFERENCE.sub(_blank, plain)
        plain = _BROKEN.sub("\u200b\u200b", plain)
    elif plain[:1] in "[(0123456789" and _REFERENCE.match(plain):
        return out
    start = 0
    for end in [*(m.start() for m in _GAP.finditer(plain)), len(plain)]:
        body = plain[start:end]
        at = 0
        for m in _STOP.finditer(body):
            if body[m.start()] == "." and body[m.start() + 1].isspace() and _shortened(body, m.start()):
                continue
            _take(body, at, m.end(), start, out)
            at = m.end()
        _take(body, at, len(body), start, out)
        start = end
    return out


def _take(body: str, at: int, to: int, start: int, out: list[tuple[int, int, str]]) -> None:
    piece = body[at:to]
    if (words := _running(piece)) is not None:
        lead = len(piece) - len(piece.lstrip())
        out.append((start + at + lead, start + at + len(piece.rstrip()), words))


def _running(piece: str) -> str | None:
    """The words of a piece of text if it is a whole running sentence."""
    if _CLOSED.search(piece[-120:]) is None:
        return None
    clean = piece if piece.isascii() else _INVISIBLE.sub("", piece)
    if _QUOTES.search(clean):
        clean = _QUOTED.sub(" ", clean)
    if _BRACKET.search(clean):
        clean = _BRACKETS.sub(" ", clean)
    words = _WORD.findall(clean)
    total = len(clean) - clean.count(" ") - clean.count("\n")
    for w in [w for w in words if not (w.islower() or w.istitle()) and _CAMEL.search(w)]:  # names of tools, written LikeThis
        rest = _TOOL.sub(" ", w)
        total -= len(w) - len(rest) + rest.count(" ")
        at = words.index(w)
        words[at : at + 1] = _WORD.findall(rest)
    letters = sum(map(len, words))
    if letters * 2 < total or len(words) < LEAST_WORDS and sum(len(w) for w in words if _HAN.match(w)) < LEAST_HAN:
        return None
    return " ".join(words).replace("’", "'").casefold()


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of some words, one after the other, and where each word's begin.

    Of a word 1 to 4 characters in a row with its ends marked, and the word itself; of Han characters single ones and pairs. All words are
    hashed at once as arrays of code points.
    """
    marked = [w if _HAN.match(w) else f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked])
    most = np.array([2 if _HAN.match(w) else 4 for w in words])
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    mix = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(codes), dtype=np.uint64)
    ids, of = [], []
    for n in range(1, 5):
        h = h[: len(codes) - n + 1] * np.uint64(1000003) + codes[n - 1 :]
        keep = (left[: len(h)] >= n) & (most[owner[: len(h)]] >= n)
        g = (h[keep] + np.uint64(n)) * mix
        ids.append(((g ^ (g >> np.uint64(29))) * mix >> np.uint64(40)) & np.uint64(DIMENSIONS - 1))
        of.append(owner[: len(h)][keep])
    whole = np.flatnonzero(most == 4)
    ids.append(np.array([xxhash.xxh32_intdigest(marked[i]) & (DIMENSIONS - 1) for i in whole], dtype=np.uint64))
    of.append(whole)
    every, owners = np.concatenate(ids).astype(np.int64), np.concatenate(of)
    order = np.argsort(owners, kind="stable")
    return every[order], np.searchsorted(owners[order], np.arange(len(words)))


def _words(sentence: str) -> list[str]:
    return [w.replace("’", "'") for w in _WORD.findall(sentence.casefold())]


@dataclass
class Model:
    """``weights``: one row a machine; families first, then the pairs of each family in order."""

    weights: np.ndarray
    families: list[str]
    pairs: list[tuple[str, str]]
    languages: frozenset[str]

    def __post_init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.weights) + 1), dtype=np.float32)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "families": self.families, "pairs": self.pairs, "languages": self.languages}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _learn(self, words: list[str]) -> None:
        """Keeps the sum of the scores of each new word under all machines, and its number of features."""
        ids, begins = _grams(words)
        sums = np.add.reduceat(self.weights.T[ids], begins, axis=0)
        need = len(self.rows) + len(words)
        if need > len(self.table):
            self.table = np.vstack([self.table, np.zeros((max(need, 2 * len(self.table)) - len(self.table), self.table.shape[1]), dtype=np.float32)])
        at = len(self.rows)
        self.table[at:need, :-1] = sums
        self.table[at:need, -1] = np.diff(np.append(begins, len(ids)))
        self.rows.update(zip(words, range(at, need), strict=True))

    def predict_many(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """Language and confidence (from the margins of the machines that decided) of each list of words; none may be empty."""
        if not texts:
            return []
        if len(self.rows) > KEPT_WORDS:
            self.__post_init__()
        if new := [w for w in dict.fromkeys(w for t in texts for w in t) if w not in self.rows]:
            self._learn(new)
        flat = np.fromiter((self.rows[w] for t in texts for w in t), dtype=np.int64)
        begins = np.cumsum([0, *map(len, texts[:-1])])
        sums = np.add.reduceat(self.table[flat].astype(np.float64), begins, axis=0)
        s = sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1.0))
        k = len(self.families)
        top = np.argmax(s[:, :k], axis=1)
        ranked = np.sort(s[:, :k], axis=1)
        margin = ranked[:, -1] - ranked[:, -2] if k > 1 else np.ones(len(s))
        out: list[tuple[str, float]] = [("", 0.0)] * len(s)
        for f, family in enumerate(self.families):
            here = np.flatnonzero(top == f)
            if not len(here):
                continue
            members = sorted(m for m in FAMILIES[family] if m in self.languages)
            votes, total = np.zeros((len(here), len(members))), np.zeros((len(here), len(members)))
            least = np.full((len(here), len(members)), np.inf)
            for j, (a, b) in enumerate(self.pairs):
                if a in members and b in members:
                    x, y, v = members.index(a), members.index(b), s[here, k + j]
                    votes[:, x] += v > 0
                    votes[:, y] += v <= 0
                    total[:, x] += v
                    total[:, y] -= v
                    least[:, [x, y]] = np.minimum(least[:, [x, y]], np.abs(v)[:, None])
            best = np.argmax(votes * 1e6 + total, axis=1)
            sure = 1 / (1 + np.exp(-3 * np.minimum(margin[here], least[np.arange(len(here)), best])))
            for i, m, c in zip(here.tolist(), best.tolist(), sure.tolist(), strict=True):
                out[i] = (members[m], c)
        return out

    def predict(self, sentence: str) -> tuple[str, float]:
        """:func:`predict_many` for one text."""
        return self.predict_many([_words(sentence) or [""]])[0]


Row = tuple[np.ndarray, np.ndarray]  # distinct features and how often each occurs


def _svm(rows: list[Row], y: np.ndarray, epochs: int = 4, reg: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Averaged stochastic subgradient descent on the hinge loss, one weight row for each column of ``y`` (+1, -1)."""
    rng = np.random.default_rng(seed)
    w = np.zeros((y.shape[1], DIMENSIONS), dtype=np.float32)
    mean = np.zeros_like(w)
    t, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            t += 1
            eta = 1.0 / (1.0 + 10.0 * reg * t)
            ids, n = rows[i]
            norm = 1.0 / np.sqrt(n.sum())
            margin = y[i] * (w[:, ids] @ n) * norm
            hit = np.flatnonzero(margin < 1)
            if len(hit):
                step = np.outer(eta * norm * y[i, hit], n)
                w[hit[:, None], ids] += step
                mean[hit[:, None], ids] += step * ((steps - t + 1) / steps)
    return mean


def train(examples: list[tuple[str, str]], seed: int = 0) -> Model:
    """A model from (sentence, language) pairs; languages without examples are never predicted."""
    vocabulary = list(dict.fromkeys(w for s, _ in examples for w in _words(s)))
    ids, begins = _grams(vocabulary) if vocabulary else (np.array([], dtype=np.int64), np.array([], dtype=np.int64))
    known = dict(zip(vocabulary, np.split(ids, begins[1:]), strict=True))
    rows: list[Row] = []
    for s, _ in examples:
        found = [known[w] for w in _words(s)]
        features, n = np.unique(np.concatenate(found) if found else np.array([], dtype=np.int64), return_counts=True)
        rows.append((features, n.astype(np.float32)))
    kept = [i for i, (ids, _) in enumerate(rows) if len(ids)]
    rows, langs = [rows[i] for i in kept], np.array([examples[i][1] for i in kept])
    present = set(langs.tolist())
    families = [f for f, ms in FAMILIES.items() if present & set(ms)]
    of = {m: f for f, ms in FAMILIES.items() for m in ms}
    y = np.array([[1 if of[g] == f else -1 for f in families] for g in langs], dtype=np.float32).reshape(len(rows), len(families))
    parts, pairs = [_svm(rows, y, seed=seed)], []
    for f in families:
        members = [m for m in FAMILIES[f] if m in present]
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                idx = np.flatnonzero((langs == a) | (langs == b))
                parts.append(_svm([rows[j] for j in idx], np.where(langs[idx] == a, 1, -1).astype(np.float32)[:, None], seed=seed))
                pairs.append((a, b))
    return Model(np.vstack(parts).astype(np.float32), families, pairs, frozenset(present))


def train_clean(examples: list[tuple[str, str]], least: int = 20) -> Model:
    """Trains, drops the sentences whose label the model rejects, and trains again."""
    first = train(examples)
    agreed = [(s, g) for s, g in examples if first.predict(s)[0] == g]
    left = {g: sum(1 for _, x in agreed if x == g) for g in {g for _, g in examples}}
    return train(agreed + [(s, g) for s, g in examples if left[g] < least])


def training_sample(documents: DataFrame, doc: str, text: str, lang: str, per_language: int = PER_LANGUAGE, seed: int = 3) -> list[tuple[str, str]]:
    """Sentences of at most ``per_language`` documents for each language that a label names alone.

    Documents are taken in the order of a hash of their id, so the sample is the same on every run.
    """
    named = F.pandas_udf(lambda labels: labels.map({x: got[0] if len(got := label_languages(x)) == 1 else None for x in labels.unique()}), "string")
    rows = documents.where(F.col(lang).isNotNull() & (F.length(text) > 60)).select(named(F.col(lang)).alias("_lang"), F.xxhash64(F.lit(seed), doc).alias("_h"), F.substring(text, 1, TRAIN_CHARS).alias("_text")).where("_lang IS NOT NULL")
    # Spark keeps at most per_language rows of a language and partition before the shuffle (window group limit).
    sample = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).where(F.col("_n") <= per_language).select("_lang", "_text", "_h").orderBy("_lang", "_h")
    out: list[tuple[str, str]] = []
    for r in sample.collect():
        out += [(s, r["_lang"]) for _, _, s in sentences(r["_text"])[:SENTENCES]]
    return out


SEGMENT = "array<struct<segment:int,lang:string,start:int,end:int,sentences:int,confidence:double>>"


Segments = list[tuple[int, str, int, int, int, float]]


def segments_of(model: Model, texts: list[str]) -> list[Segments]:
    """For each text the runs of sentences in one language with their confidence (mean over sentences); all sentences are judged at once."""
    found = [sentences(t) for t in texts]
    judged = iter(model.predict_many([w.split(" ") for one in found for _, _, w in one]))
    result: list[Segments] = []
    for one in found:
        out: list[list] = []
        for start, end, words in one:
            lang, conf = next(judged)
            lang = lang if _writable(words, lang) else UNDETERMINED
            if out and out[-1][0] == lang:
                out[-1][2] = end
                out[-1][3].append(conf)
            else:
                out.append([lang, start, end, [conf]])
        result.append([(i, lang, a, b, len(c), sum(c) / len(c)) for i, (lang, a, b, c) in enumerate(out)])
    return result


def _writable(words: str, lang: str) -> bool:
    """Whether most letters of a sentence are of the script its language is written in; others are undetermined."""
    if words.isascii():
        return SCRIPTS.get(lang, _LATIN) is _LATIN
    return len(SCRIPTS.get(lang, _LATIN).findall(words)) * 2 >= len(words) - words.count(" ")


def detect(documents: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``<doc>, labelled, segments``: the languages the label names and the segments found in the whole text.

    A null, empty or symbol-only text has no segments. Every input row gives a row, repeated ones too; columns that
    clash with the names of the result are not carried over. Offsets count characters of the text. Sentences in another script than
    those of the known languages are ``und``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for rows in batches:
            codes, distinct = pd.factorize(rows["_text"])
            found = [[dict(zip(("segment", "lang", "start", "end", "sentences", "confidence"), s, strict=True)) for s in one] for one in segments_of(own, list(distinct))] + [[]]
            yield pd.DataFrame({doc: rows[doc], "labelled": [label_languages(x if isinstance(x, str) else None) for x in rows["_lang"]], "segments": [found[c] for c in codes]})

    kind = documents.schema[doc].dataType.simpleString()
    rows = documents.select(doc, F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    return rows.mapInPandas(run, f"{doc} {kind}, labelled array<string>, segments {SEGMENT}")
