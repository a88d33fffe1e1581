"""Similarity of typed names: tokens, padded q-grams, MinHash banding, Monge-Elkan."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex
import xxhash

from quillspark.llm.lookalike import plain_form

# Short forms of given names, alphabetical by short form. Several formal names may share one.
NICKNAMES = {
    "abby": ("abigail",), "alex": ("alexander", "aleksandr"), "andy": ("andrew",), "annie": ("anneke", "anna"), "becky": ("rebecca",), "ben": ("benjamin",), "beppe": ("giuseppe",),
    "beth": ("elizabeth",), "betty": ("elizabeth",), "bill": ("william",), "bob": ("robert",), "cathy": ("katherine",), "charlie": ("charles",), "chris": ("christopher",), "chuck": ("charles",),
    "dan": ("daniel",), "dave": ("david",), "deb": ("deborah",), "debbie": ("deborah",), "dick": ("richard",), "dima": ("dmitri",), "drew": ("andrew",), "ed": ("edward",), "etta": ("henrietta",),
    "gabe": ("gabriel",), "greg": ("gregory",), "hans": ("johannes",), "hetty": ("henrietta",), "jim": ("james",), "joe": ("joseph",), "kate": ("katherine",), "kathy": ("katherine",), "kolya": ("nikolai",),
    "liz": ("elizabeth",), "maggie": ("margaret",), "matt": ("matthew",), "meg": ("margaret",), "mia": ("maria",), "mike": ("michael",), "ned": ("edward",), "nell": ("eleanor",), "nick": ("nicholas", "nikolai"),
    "paco": ("francisco",), "pat": ("patricia",), "patty": ("patricia",), "peggy": ("margaret",), "pepe": ("jose",), "rick": ("richard",), "rob": ("robert",), "sam": ("samuel",), "sandy": ("alexandra",),
    "sasha": ("aleksandr",), "sepp": ("josef",), "steve": ("stephen", "stefan"), "sue": ("susannah", "susan"), "ted": ("theodore", "edward"), "teddy": ("theodore",), "tom": ("thomas",), "tony": ("anthony",),
    "vicky": ("victoria",), "will": ("william",), "willi": ("wilhelm",), "zoe": ("zoe",),
}

# Letters without a decomposition, and how they're written in plain ones.
_BASE = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"})
_NOISE = regex.compile(r"\([^()]*\)|\b(?:dr|prof|mr|mrs|ms|sir)\b\.?|\b(?:ph\.?\s?d|m\.?d|msc|bsc|jr|sr|esq)\b\.?|[0-9*†‡§¶#]+", regex.IGNORECASE)
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})")
_SPLIT = regex.compile(r"[\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)*")


def folded(text: str) -> str:
    """Lower case without accents, in plain letters."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().translate(_BASE)) if not unicodedata.combining(c))


def name_tokens(name: str) -> list[str]:
    """The tokens of a person's name, folded; initials are single letters ('MK' after or before a longer word is two)."""
    text = _CAMEL.sub(" ", _NOISE.sub(" ", plain_form(name, True)))
    words = _SPLIT.findall(text)
    longest = max((len(w) for w in words), default=0)
    out: list[str] = []
    for w in words:
        if len(w) <= 3 and w.isupper() and longest > 3 and not (text.isupper() and len(w) > 2):
            out += list(folded(w))
        elif "-" in w and all(len(x) == 1 for x in w.split("-")):
            out += [folded(x) for x in w.split("-")]
        else:
            out.append(folded(w))
    return _signs_apart([t for t in out if t])


_SIGN = regex.compile(r"\p{Script=Han}")
# Family names of two signs.
DOUBLE_NAMES = frozenset("欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐".split())


def _signs_apart(tokens: list[str]) -> list[str]:
    """Names in signs, which are written together with the family name first, as given name and family name."""
    out: list[str] = []
    for t in tokens:
        if 2 <= len(t) <= 4 and all(map(_SIGN.match, t)) and len(tokens) == 1:
            k = 2 if len(t) > 2 and t[:2] in DOUBLE_NAMES else 1
            out += [t[k:], t[:k]]
        else:
            out.append(t)
    return out


def whole(token: str) -> bool:
    """Whether a token of a name is a name, not an initial."""
    return len(token) > 1 or _SIGN.match(token) is not None


def transliterated(token: str) -> str:
    """One form for endings and vowels that are typed in several ways (oe/o, ae/a, ue/u, cz/c)."""
    if "e" not in token and "c" not in token:
        return token
    for a, b in (("oe", "o"), ("ae", "a"), ("ue", "u"), ("cz", "c"), ("cs", "c")):
        token = token.replace(a, b)
    return token


@lru_cache(maxsize=500_000)
def edit_distance(a: str, b: str, most: int = 3) -> int:
    """Optimal string alignment distance (a swap of neighbours is one edit), cut off above ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # What both begin and end with takes no edit.
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) <= 1 and len(b) <= 1 or len(a) == 2 and a == b[::-1]:
        return 1 if most else most + 1
    # An edit changes at most two members of the set of letters.
    if most < 2 or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def token_similarity(a: str, b: str) -> float:
    """1 for equal tokens (also transliterated), 0.95 a nickname, 0.9 an initial, else by edit distance."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] else 0.0
    if b in NICKNAMES.get(a, ()) or a in NICKNAMES.get(b, ()):
        return 0.95
    x, y = transliterated(a), transliterated(b)
    if x == y:
        return 0.98
    longest = max(len(x), len(y))
    most = 1 if longest < 9 else 2
    d = edit_distance(x, y, most)
    return max(0.0, 1 - d / longest) if d <= most else 0.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the tokens of the shorter name of the best similarity with a token of the longer, each used once."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    pairs = sorted(((token_similarity(x, y), -i, -j) for i, x in enumerate(short) for j, y in enumerate(long)), reverse=True)
    used_i, used_j, total = set(), set(), 0.0
    for s, i, j in pairs:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            total += s
    return total / len(short)


def grams(token: str, q: int = 3) -> list[str]:
    """The q-grams of a token padded at both ends."""
    text = "^" * (q - 1) + token + "$" * (q - 1)
    return [text[i : i + q] for i in range(len(text) - q + 1)]


def collision(similarity: float, rows: int, bands: int) -> float:
    """The chance that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def one_error(length: int) -> float:
    """The least Jaccard similarity of the padded bigrams of a word of ``length`` letters and its form with one letter wrong, missing,
    too many or swapped with the next (a swap in a word of three or fewer leaves too little and isn't counted)."""
    wrong = (length - 1) / (length + 3)
    return wrong if length <= 3 else min(wrong, (length - 2) / (length + 4))


def tuned_banding(similarity: float, recall: float, low: float, most_bands: int = 64) -> tuple[int, int]:
    """Rows and bands that reach ``recall`` at ``similarity`` with the least chance of a collision at ``low``."""
    best: tuple[float, int, int] | None = None
    for rows in range(1, 9):
        for bands in range(1, most_bands + 1):
            if collision(similarity, rows, bands) >= recall:
                cost = (collision(low, rows, bands), rows, bands)
                best = min(best, cost) if best else cost
                break
    if best is None:
        raise ValueError("no banding reaches that recall")
    return best[1], best[2]


_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=100_000)
def _gram_hash(gram: str) -> int:
    return xxhash.xxh32_intdigest(gram)


class MinHash:
    """Band hashes of a token's padded q-grams; all instances with the same numbers agree."""

    def __init__(self, rows: int, bands: int, q: int = 3, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.rows, self.bands, self.q = rows, bands, q
        self.a = rng.integers(1, 1 << 31, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 31, rows * bands, dtype=np.uint64)

    def bands_of(self, token: str) -> list[int]:
        ids = np.array([_gram_hash(g) for g in set(grams(token, self.q))], dtype=np.uint64)
        mins = (((ids[:, None] * self.a + self.b) & np.uint64(0xFFFFFFFFFFFF)) >> np.uint64(16)).min(axis=0).reshape(self.bands, self.rows)
        mixed = np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX
        for k in range(self.rows):
            mixed = (mixed ^ mins[:, k]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        return mixed.view(np.int64).tolist()
