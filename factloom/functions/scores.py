"""BLEU, ROUGE-L and METEOR from their published formulas, as Arrow-batched functions.

METEOR uses exact and stem matches; synonym matches need a lexical database that isn't available, so values can be lower than with one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = re.compile(r"[a-z0-9]+")


def _hits(reference: list[str], candidate: list[str], n: int, places: list[int] | None) -> tuple[int, list[int]]:
    """How many n-grams the two share, and where the candidate's lie that the reference has; places: where those of n - 1 words do, as only there can longer ones lie."""
    if n == 1:
        wanted = Counter(reference)
        places = [i for i, w in enumerate(candidate) if w in wanted]
        found = Counter([candidate[i] for i in places])
    else:
        wanted = Counter(zip(*[reference[k:] for k in range(n)]))
        grams = [(i, tuple(candidate[i : i + n])) for i in places if i + n <= len(candidate)]
        grams = [(i, g) for i, g in grams if g in wanted]
        places, found = [i for i, _ in grams], Counter([g for _, g in grams])
    return sum(min(m, wanted[g]) for g, m in found.items()), places


def bleu(reference: list[str], candidate: list[str], order: int) -> float:
    """Geometric mean of clipped n-gram precisions up to order, times the brevity penalty; no smoothing."""
    if not candidate:
        return 0.0
    total = 0.0
    places = None
    for n in range(1, order + 1):
        hits, places = _hits(reference, candidate, n, places)
        if not hits:
            return 0.0
        total += math.log(hits / (len(candidate) - n + 1))
    penalty = 1.0 if len(candidate) > len(reference) else math.exp(1 - len(reference) / len(candidate))
    return penalty * math.exp(total / order)


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time: a row is one number, whose unset bits are where it rises."""
    if len(a) < len(b):
        a, b = b, a  # rows as long as the shorter one
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for mask in filter(None, map(at.get, a)):  # words that b lacks change nothing
        met = row & mask
        row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


def _measure(stem: str) -> int:
    """Vowel-consonant sequences of a stem."""
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _consonant(w: str, i: int) -> bool:
    if w[i] in "aeiou":
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short(w: str) -> bool:
    return len(w) >= 3 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


#: The suffix rules of steps 2 to 4 of Porter's published algorithm.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    """Pairs of an old and a new ending, longer old ones first."""
    return sorted([tuple(r.split(":")) for r in text.split()], key=lambda r: -len(r[0]))


_RULES2, _RULES3, _ENDINGS4 = _rules(_STEP2), _rules(_STEP3), sorted(_STEP4.split(), key=len, reverse=True)


def _longest(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for old, new in rules:
        if w.endswith(old):
            stem = w[: len(w) - len(old)]
            return stem + new if _measure(stem) > least else w
    return w


def stem(w: str) -> str:
    """Porter's stemmer. Long words aren't remembered."""
    return _known_stem(w) if len(w) <= 64 else _stem(w)


@lru_cache(maxsize=1 << 16)
def _known_stem(w: str) -> str:
    return _stem(w)


def _stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) >= 2 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(w, _RULES2, 0)
    w = _longest(w, _RULES3, 0)
    for old in _ENDINGS4:
        if w.endswith(old):
            base = w[: len(w) - len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def rouge_l(reference: str, candidate: str) -> tuple[float, float, float]:
    """Precision, recall and F1 of the longest common subsequence of stemmed words."""
    words = [_WORDS.findall(t.lower()) for t in (reference, candidate)]
    of = {w: stem(w) if len(w) > 3 else w for w in {*words[0], *words[1]}}
    a, b = ([of[w] for w in own] for own in words)
    if not a or not b:
        return 0.0, 0.0, 0.0
    n = common_subsequence(a, b)
    p, r = n / len(b), n / len(a)
    return p, r, 2 * p * r / (p + r) if n else 0.0


def meteor(reference: list[str], candidate: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Harmonic mean of precision and recall of aligned words (exact, then stems), less a penalty for the number of chunks."""
    a, b = [w.lower() for w in reference], [w.lower() for w in candidate]
    pairs: dict[int, int] = {}
    for key in (lambda w: w, stem):
        left: dict[str, list[int]] = {}
        taken = set(pairs.values())
        for j in reversed([j for j in range(len(a)) if j not in taken]):
            left.setdefault(key(a[j]), []).append(j)
        if not left:
            break
        stems = key is stem
        of = {w: key(w) for w in set(b)} if stems else None
        for i, w in enumerate(b):
            if i not in pairs and (found := left.get(of[w] if stems else w)):
                pairs[i] = found.pop()
    if not pairs:
        return 0.0
    p, r = len(pairs) / len(b), len(pairs) / len(a)
    order = sorted(pairs)
    chunks = 1 + sum(not (j == i + 1 and pairs[j] == pairs[i] + 1) for i, j in zip(order, order[1:], strict=False))
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / len(pairs)) ** beta)


def _score_batch(truth: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(truth.fillna(""), prediction.fillna(""), strict=True):
        x, y = a.lower().split(), b.lower().split()
        rows.append((bleu(x, y, 1), bleu(x, y, 4), meteor(x, y), *rouge_l(a, b)))
    return pd.DataFrame(rows, columns=["bleu1", "bleu4", "meteor", "rouge_p", "rouge_r", "rouge_f"])


def answer_scores(truth: Column | str, prediction: Column | str) -> Column:
    """A struct of all scores of a prediction against the truth, both lower-cased; words for BLEU and METEOR are what white space parts. Nulls count as empty."""
    return F.pandas_udf(_score_batch, "bleu1 double, bleu4 double, meteor double, rouge_p double, rouge_r double, rouge_f double")(truth, prediction)
