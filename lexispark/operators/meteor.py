"""METEOR kernel (Banerjee & Lavie, 2005), per segment.

Lower-cased whitespace tokens; matching stages exact -> Porter stem ->
optional synonym table. Within a stage, hypothesis words are visited
from the last to the first and each takes the last still-unmatched
reference word it equals. ``F = P*R / (alpha*P + (1-alpha)*R)``,
``penalty = gamma * (chunks/matches)**beta``, score ``F*(1-penalty)``.
Without a synonym table the score is the exact+stem variant.
"""

from __future__ import annotations

from collections.abc import Callable

# Default METEOR parameters.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5

_VOWELS = set("aeiou")


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_v = 0, False
    for i in range(len(stem)):
        v = not _cons(stem, i)
        if prev_v and not v:
            m += 1
        prev_v = v
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _replace_by_m(w: str, rules, min_m: int) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if _measure(stem) > min_m else w
    return w


# Porter (1980) suffix rules of steps 2, 3 and 4.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter_stem(word: str) -> str:
    """The original Porter (1980) algorithm for lower-case English words."""
    w = word
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # steps 2-3
    w = _replace_by_m(w, _STEP2, 0)
    w = _replace_by_m(w, _STEP3, 0)
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


def _match_stage(hyp: list[tuple[int, str]], ref: list[tuple[int, str]],
                 key: Callable[[str], object]):
    """Backward greedy matching on ``key``; returns (pairs, hyp_left, ref_left)."""
    pos: dict[object, list[int]] = {}
    for k, (_, w) in enumerate(ref):
        pos.setdefault(key(w), []).append(k)
    used_ref: set[int] = set()
    pairs, hyp_left = [], []
    for hi, w in reversed(hyp):
        stack = pos.get(key(w))
        while stack and stack[-1] in used_ref:
            stack.pop()
        if stack:
            k = stack.pop()
            used_ref.add(k)
            pairs.append((hi, ref[k][0]))
        else:
            hyp_left.append((hi, w))
    hyp_left.reverse()
    ref_left = [r for k, r in enumerate(ref) if k not in used_ref]
    return pairs, hyp_left, ref_left


def _chunks(pairs: list[tuple[int, int]]) -> int:
    pairs = sorted(pairs)
    chunks = 1
    for (h0, r0), (h1, r1) in zip(pairs, pairs[1:]):
        if not (h1 == h0 + 1 and r1 == r0 + 1):
            chunks += 1
    return chunks


def meteor_stats(hyp_words: list[str], ref_words: list[str],
                 synonyms: dict[str, frozenset] | None = None,
                 stem: Callable[[str], str] = porter_stem) -> tuple[int, int, int, int, float]:
    """(matches, hyp_len, ref_len, chunks, score) for one segment."""
    hyp = [(i, w.lower()) for i, w in enumerate(hyp_words)]
    ref = [(i, w.lower()) for i, w in enumerate(ref_words)]
    pairs, h, r = _match_stage(hyp, ref, lambda w: w)
    cache: dict[str, str] = {}
    st = lambda w: cache.setdefault(w, stem(w))
    p2, h, r = _match_stage(h, r, st)
    pairs += p2
    if synonyms:
        # a hypothesis word matches a reference word sharing any synset
        p3 = []
        used: set[int] = set()
        for hi, w in reversed(h):
            sw = synonyms.get(w, frozenset()) | {w}
            for k in range(len(r) - 1, -1, -1):
                if k in used:
                    continue
                rw = r[k][1]
                if rw in sw or (synonyms.get(rw, frozenset()) & synonyms.get(w, frozenset())):
                    used.add(k)
                    p3.append((hi, r[k][0]))
                    break
        pairs += p3
    n_m = len(pairs)
    if n_m == 0:
        return 0, len(hyp), len(ref), 0, 0.0
    p, rc = n_m / len(hyp), n_m / len(ref)
    f = p * rc / (ALPHA * p + (1 - ALPHA) * rc)
    ch = _chunks(pairs)
    return n_m, len(hyp), len(ref), ch, f * (1 - GAMMA * (ch / n_m) ** BETA)
