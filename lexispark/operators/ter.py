"""Translation Edit Rate kernel (Snover et al., 2006), per segment.

TER = (shifts + edit distance after shifts) / reference words. Shifts are
chosen greedily: at each step the block move (at most ``MAX_SHIFT_SIZE``
words, moved at most ``MAX_SHIFT_DIST`` positions) that lowers the edit
distance most is applied; ties prefer longer blocks, then earlier blocks,
then earlier destinations. A block is only considered when its words
match the reference at the destination and both the block and that
reference span are currently mis-aligned.

Pure Python with exact speed-ups: reference positions are looked up by word,
and blocks whose greatest possible gain cannot beat the best move so far are
skipped. Edit distances are bit-parallel (Myers/Hyyro): a column of the
distance table is two bit sets, kept for each prefix of the hypothesis and for
each suffix: half a byte a cell of the table, and a quarter where no block
can move. A candidate move steps from the unchanged prefix through the words between the
block's old and new place only; the unchanged suffix's column then gives the
distance as the least sum of both. The alignment is traced back through the
prefix columns. Called from an Arrow UDF, one segment at a time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

# Published TER shift constraints.
MAX_SHIFT_SIZE = 10
MAX_SHIFT_DIST = 50
#: Suffix words that are stepped through rather than looked up.
FEW_WORDS = 40


class _Levenshtein:
    """Bit-parallel global edit distance against a fixed reference."""

    def __init__(self, ref_ids: list[int]):
        self.m = len(ref_ids)
        self.mask = (1 << self.m) - 1
        self.high = 1 << (self.m - 1) if self.m else 0
        peq: dict[int, int] = {}
        for i, w in enumerate(ref_ids):
            peq[w] = peq.get(w, 0) | (1 << i)
        self.peq = peq

    def start(self):
        return (self.mask, 0, self.m)          # VP all ones, VN zero, D[m][0] = m

    def step(self, state, w):
        vp, vn, score = state
        mask, high = self.mask, self.high
        eq = self.peq.get(w, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        ph = vn | (~(xh | vp) & mask)
        mh = vp & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ((ph << 1) | 1) & mask
        mh = (mh << 1) & mask
        vp = mh | (~(xv | ph) & mask)
        vn = ph & xv
        return (vp, vn, score)

    def prefix_states(self, hyp):
        st = [self.start()]
        s = st[0]
        for w in hyp:
            s = self.step(s, w)
            st.append(s)
        return st

    def resume(self, state, tail):
        s = state
        for w in tail:
            s = self.step(s, w)
        return s[2]

    def cell(self, states, i: int, j: int) -> int:
        """The distance of the first ``i`` reference words from the first ``j`` hypothesis words."""
        vp, vn, _ = states[j]
        below = (1 << i) - 1
        return j + (vp & below).bit_count() - (vn & below).bit_count()

    def column(self, state, words: int) -> np.ndarray:
        """Distances of all reference prefixes from a hypothesis of ``words`` words."""
        size = -(-self.m // 8)
        up, down = (np.unpackbits(np.frombuffer(state[k].to_bytes(size, "little"), np.uint8), count=self.m, bitorder="little")
                    for k in (0, 1))
        out = np.empty(self.m + 1, np.int32)
        out[0] = words
        np.cumsum(up.astype(np.int8) - down.astype(np.int8), dtype=np.int32, out=out[1:])
        out[1:] += words
        return out


def _alignment(hyp: list[int], ref: list[int], lev: _Levenshtein, states: list):
    """Alignment of the words: ref position -> hyp position for
    matches/substitutions, and per-position error flags."""
    align: dict[int, int] = {}
    hyp_err = [1] * len(hyp)
    ref_err = [1] * len(ref)
    j, i = len(hyp), len(ref)
    d = states[j][2]
    while j > 0 or i > 0:  # diagonal moves are preferred, then hypothesis words without partner
        if j > 0 and i > 0:
            before, c = lev.cell(states, i - 1, j - 1), int(hyp[j - 1] != ref[i - 1])
            if d == before + c:
                align[i - 1] = j - 1
                if c == 0:
                    hyp_err[j - 1] = 0
                    ref_err[i - 1] = 0
                j, i, d = j - 1, i - 1, before
                continue
        if j > 0 and d == lev.cell(states, i, j - 1) + 1:
            j -= 1
        else:
            i -= 1
        d -= 1
    return align, hyp_err, ref_err


def _move(h: list[int], start: int, length: int, dest: int) -> list[int]:
    block = h[start:start + length]
    if dest <= start:
        return h[:dest] + block + h[dest:start] + h[start + length:]
    return h[:start] + h[start + length:dest] + block + h[dest:]


def _best_shift(hyp, ref, lev: _Levenshtein, back: _Levenshtein):
    states = lev.prefix_states(hyp)
    n, m = len(hyp), len(ref)
    cur = states[n][2]
    if cur == 0:
        return 0, hyp
    align, hyp_err, ref_err = _alignment(hyp, ref, lev, states)
    suffixes = None
    columns: dict[int, np.ndarray] = {}  # of the few places that candidates of one block end at

    def distance(moved: list[int], first: int, last: int) -> int:
        """From the words of ``moved``, of which those outside [first, last) are the hypothesis' own."""
        nonlocal suffixes
        state = states[first]
        for w in moved[first:last]:
            state = lev.step(state, w)
        if n - last <= FEW_WORDS:
            return lev.resume(state, moved[last:])
        if suffixes is None:
            suffixes = back.prefix_states(hyp[::-1])
        if last not in columns:
            if len(columns) >= 64:
                columns.clear()
            columns[last] = back.column(suffixes[n - last], n - last)[::-1]
        return int((lev.column(state, last) + columns[last]).min())

    places: dict[int, list[int]] = {}
    for r, w in enumerate(ref):
        places.setdefault(w, []).append(r)
    best = None
    for s in range(n):
        at = places.get(hyp[s], [])
        for r in at[bisect_left(at, s - MAX_SHIFT_DIST):bisect_right(at, s + MAX_SHIFT_DIST)]:
            length = 0
            while (length < MAX_SHIFT_SIZE and s + length < n and r + length < m
                   and hyp[s + length] == ref[r + length]):
                length += 1
                # moving a block changes the distance by at most twice its length
                if best is not None and (2 * length, length, -s) < best[0][:3]:
                    continue
                if not any(hyp_err[s:s + length]) or not any(ref_err[r:r + length]):
                    continue
                if s <= align.get(r, -1) < s + length:
                    continue
                tried = set()
                for off in range(-1, length):
                    rp = r + off
                    if rp == -1:
                        dest = 0
                    elif rp in align:
                        dest = align[rp] + 1
                    else:
                        break
                    if dest in tried or s < dest <= s + length:
                        continue
                    tried.add(dest)
                    moved = _move(hyp, s, length, dest)
                    gain = cur - distance(moved, min(s, dest), max(s + length, dest))
                    key = (gain, length, -s, -dest)
                    if best is None or key > best[0]:
                        best = (key, moved)
    if best is None or best[0][0] <= 0:
        return 0, hyp
    return best[0][0], best[1]


def edit_distance(hyp_words: list[str], ref_words: list[str]) -> int:
    """Word insertions, deletions and substitutions that turn one into the other."""
    if not ref_words:
        return len(hyp_words)
    ids: dict[str, int] = {}
    lev = _Levenshtein([ids.setdefault(w, len(ids)) for w in ref_words])
    state = lev.start()
    for w in hyp_words:
        state = lev.step(state, ids.get(w, -1))
    return state[2]


def ter_counts(hyp_words: list[str], ref_words: list[str]) -> tuple[int, int]:
    """(edits, reference length) for one segment."""
    if not ref_words:
        return len(hyp_words), 0
    if hyp_words == ref_words:
        return 0, len(ref_words)
    vocab: dict[str, int] = {}
    ref = [vocab.setdefault(w, len(vocab)) for w in ref_words]
    hyp = [vocab.setdefault(w, len(vocab)) for w in hyp_words]
    lev, back = _Levenshtein(ref), _Levenshtein(ref[::-1])
    shifts = 0
    while True:
        gain, moved = _best_shift(hyp, ref, lev, back)
        if gain <= 0:
            break
        shifts += 1
        hyp = moved
    return shifts + lev.resume(lev.start(), hyp), len(ref)
