"""Text quality statistics and the kind of a document: prose, list, table or junk.

Texts are read as arrays of code points, a slice of a batch at a time, and every statistic is a
segmented sum over them: no loop over rows or characters. Lines are described by
the statistics of ``FEATURES``. A Gaussian mixture is fitted to the standardized
statistics by expectation-maximization; its components start at inspected examples
(``quality_examples``), which keep a small fixed weight in every step, and are mapped to a kind by the
examples they explain; every kind has several. A document is what most of its characters are: the posteriors of its
lines, weighted by their characters and evened out over neighbouring lines, are added up.

The mixture is fitted on every line of every document, whole texts: each text is described once, its lines'
statistics and its totals are written, and each step adds up, per component, the weights, values and squares of all lines, so only a matrix of
components by statistics comes back, until the likelihood settles. Posteriors and kinds are computed for every line as well.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.quality_examples import COMMON_WORDS, EXAMPLES
from loomstat.llm.tokenize import slices
from loomstat.session import checkpoint_dir

KINDS = ("prose", "list", "table", "junk")
#: Characters that are looked at together.
SLICE = 1 << 18
#: Lines whose posteriors are computed together while fitting.
STEP_LINES = 1 << 9
#: Visible characters under which a line is seen together with its neighbours.
SHORT_LINE = 120
#: Lines of more words are alike in length.
LONG_LINE = 200
EM_ROUNDS = 25
#: So many partial sums of a step go to the driver as they are.
FEW_PARTS = 64
#: A component's log-density of a line counts as so far below the line's best at most: e^-60 adds nothing to a sum, but numbers too small
#: for a normalized float, which arise beyond, slow down the products on many processors.
LEAST_LOG = -60
#: The fit ends where a round raises the mean log-likelihood of a line by less.
SETTLED = 0.005
#: Added to every variance of the standardized statistics.
VARIANCE_FLOOR = 0.1
#: The weight of the examples of one form in every step, as a share of all lines.
EXAMPLE_SHARE = 0.002

FEATURES = (
    "words",
    "common",
    "digits",
    "symbols",
    "ended",
    "bullet",
    "numbered",
    "columns",
    "longest",
    "period",
    "repeated",
    "upper",
    "word_length",
    "vowels",
    "commas",
    "odd",
    "stops",
    "common_near",
    "words_near",
    "ended_near",
)

_LETTER, _DIGIT, _SPACE, _UPPER, _HAN, _END, _VOWEL, _ODD, _CLOSE, _BREAK, _JOIN, _COMMA, _WIDE_COMMA, _PIPE, _SEMICOLON = (1 << k for k in range(15))
# Fixed values
_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
_ENDS = ".!?…。！？"
_CLOSERS = "\"')]}*_”’»」』）"
_JOINERS = "'’"
_VOWELS = "aeiouyäöüàâéèêëîïôùûáíóúñœæ"
_BULLETS = "-*•+–—●▪·‣◦"
_MAX_LAG = 12
#: Words that must recur together, and the share of a text's words that must do so at one distance, for a fragment said over and over.
GRAM, OVER_AND_OVER = 6, 0.6
_POWERS = np.power(np.uint64(1_099_511_628_211), np.arange(40, dtype=np.uint64))
_LOW = np.uint64(0x3FFF)
_LANGUAGES = tuple(COMMON_WORDS)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its class bits, and its lower case."""
    top = 0x30000
    bits = np.zeros(0x110000, np.uint16)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(top):
        ch = chr(c)
        kind = unicodedata.category(ch)
        b = 0
        if kind[0] == "L" or kind[0] == "M":
            b |= _LETTER
        elif kind[0] == "N":
            b |= _DIGIT
        elif ch.isspace() or kind in ("Zs", "Cc", "Cf") or c == 0xFEFF:
            b |= _SPACE
        if kind in ("Lu", "Lt"):
            b |= _UPPER
        if 0x3400 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or 0x20000 <= c or 0x3040 <= c < 0x3100:
            b |= _HAN
        if ch.lower() in _VOWELS:
            b |= _VOWEL
        low = ch.lower()
        if len(low) == 1:
            lower[c] = ord(low)
        plain = c < 0x80 or b & _HAN or ch.lower() in _VOWELS + "çß" or ch in _ENDS + _CLOSERS + _BULLETS
        if not plain and not b & _SPACE and not 0x3000 <= c < 0x3040 and not 0xFF00 <= c < 0xFF70 and ch not in "¿¡«“‘":
            b |= _ODD
        bits[c] = b
    bits[top:] = _ODD
    for text, bit in ((_BREAKS, _BREAK), (_ENDS, _END), (_CLOSERS, _CLOSE), (_JOINERS, _JOIN), (",", _COMMA), ("，、", _WIDE_COMMA), ("|", _PIPE), (";", _SEMICOLON)):
        for ch in text:
            bits[ord(ch)] |= bit | (_SPACE if bit == _BREAK else 0)
    return bits, lower


_tables: list = []


def _lookup() -> tuple[np.ndarray, ...]:
    """Class bits and lower case plus one by code point, common words, their languages and their lowest bits, the class of bits and the bits of a class."""
    if not _tables:
        bits, lower = _classes()
        hashes: dict[int, int] = {}
        for k, words in enumerate(COMMON_WORDS.values()):
            for w in words:
                h = _hash_word(w)
                hashes[h] = hashes.get(h, 0) | 1 << k
        keys = np.array(sorted(hashes), np.uint64)
        known = np.unique(bits)
        class_of = np.zeros(1 << 15, np.uint8)
        class_of[known] = np.arange(len(known))
        ends = np.zeros(int(_LOW) + 1, bool)
        ends[(keys & _LOW).astype(np.int64)] = True
        _tables.extend((bits, lower.astype(np.uint64) + np.uint64(1), keys, np.array([hashes[int(k)] for k in keys], np.uint8), ends, class_of, known))
    return tuple(_tables)


def _hash_word(word: str) -> int:
    total = 0
    for k, ch in enumerate(word):
        total += (ord(ch) + 1) * int(_POWERS[min(k, 39)])
    return total & 0xFFFFFFFFFFFFFFFF


@dataclass
class Lines:
    """The non-blank lines of some texts: whose they are, their characters and statistics."""

    document: np.ndarray
    characters: np.ndarray
    features: np.ndarray
    # per document
    n_words: np.ndarray
    word_characters: np.ndarray
    symbols: np.ndarray
    visible: np.ndarray
    ended: np.ndarray
    lines: np.ndarray
    common: np.ndarray


def describe(texts: Sequence[str]) -> Lines:
    """The lines of ``texts`` and the totals of each text. Texts must not be NULL."""
    bits_of, lower, common_keys, common_bits, common_ends, class_of, bits_in = _lookup()
    n_docs = len(texts)
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    bits = bits_of[codes]
    p = np.flatnonzero((bits & _SPACE) == 0)
    empty = Lines(*(np.zeros(0, int), np.zeros(0), np.zeros((0, len(FEATURES)))), *(np.zeros(n_docs) for _ in range(6)), np.zeros((n_docs, len(_LANGUAGES))))
    if not len(p):
        return empty
    # where lines begin in p
    s = np.searchsorted(p, np.flatnonzero((bits & _BREAK) != 0))
    s = np.append(0, s[s < len(p)])
    s = s[np.diff(s, prepend=-1) != 0]
    e = np.append(s[1:], len(p)) - 1
    document = np.searchsorted(first, p[s], side="right") - 1
    b, c = bits[p], codes[p]
    gap = np.diff(p, prepend=-10)
    gap[s] = 1
    visible = e - s + 1
    n_lines = len(s)
    line_of = np.repeat(np.arange(n_lines), visible)
    # next to the character before it, in the same line; none is behind the last
    near = np.append(gap == 1, False)
    near[s] = False

    # how many characters of each class a line has
    n_classes = len(bits_in)
    by_class = np.bincount(line_of * n_classes + class_of[b], minlength=n_lines * n_classes).reshape(n_lines, n_classes)
    per = lambda bit: by_class[:, (bits_in & bit) != 0].sum(axis=1)
    count = lambda at: np.bincount(line_of[at], minlength=n_lines)
    letters, digits, hans = per(_LETTER), per(_DIGIT), per(_HAN)
    any_han = bool(hans.any())
    han = (b & _HAN) != 0 if any_han else None

    joined = np.flatnonzero((b & _JOIN) != 0)
    joined = joined[(joined > 0) & (joined < len(p) - 1)]
    joined = joined[near[joined] & ((b[joined - 1] & b[joined + 1] & _LETTER) != 0) & (gap[joined + 1] == 1)]
    inword = (b & (_LETTER | _DIGIT)) != 0
    inword[joined] = True
    before = near[:-1].copy()
    before[1:] &= inword[:-1]
    if any_han:
        before &= ~(han | np.roll(han, 1))
    inside = np.flatnonzero(inword)
    k = np.flatnonzero(~before[inside])  # where words begin in inside
    length = np.diff(np.append(k, len(inside)))
    w = inside[k]
    n_words = np.diff(np.searchsorted(w, np.append(s, len(p))))
    wl = np.repeat(np.arange(n_lines), n_words)
    if len(w):
        place = np.minimum(np.arange(len(inside)) - np.repeat(k, length), 39)
        h = np.add.reduceat(lower[c[inside]] * _POWERS[place], k)
        maybe = np.flatnonzero(common_ends[(h & _LOW).astype(np.int64)])
        slot = np.minimum(np.searchsorted(common_keys, h[maybe]), len(common_keys) - 1)
        which = np.zeros(len(h), np.uint8)
        which[maybe] = np.where(common_keys[slot] == h[maybe], common_bits[slot], 0)
    else:
        h, which = np.empty(0, np.uint64), np.empty(0, np.uint8)

    n_joined, ends = count(joined), per(_END)
    symbols = visible - per(_LETTER | _DIGIT | _END | _COMMA | _WIDE_COMMA) - n_joined
    # the end of a line behind closers
    last = e.copy()
    for _ in range(3):
        back = ((b[last] & _CLOSE) != 0) & (last > s)
        last -= back
    ended = (b[last] & _END) != 0
    # tokens without blanks, those with Han aside
    t = np.flatnonzero(~near[:-1])
    token = np.diff(np.append(t, len(p)))
    if any_han:
        token[np.searchsorted(t, np.flatnonzero(han), side="right") - 1] = 1
    longest = np.maximum.reduceat(token, np.searchsorted(t, s))
    tabs = np.flatnonzero(codes == 9)
    tabs = np.searchsorted(tabs, p[e], side="right") - np.searchsorted(tabs, np.maximum(p[s] - 1, 0), side="right")
    comma, plus = np.flatnonzero(c == 44), np.flatnonzero(c == 43)
    tight = count(comma[near[comma + 1]])
    corner = count(plus[((c[np.minimum(plus + 1, len(p) - 1)] == 45) | (plus > 0) & (c[plus - 1] == 45))])
    semicolons = per(_SEMICOLON)
    columns = per(_PIPE) + corner + semicolons + tight + count(np.flatnonzero(gap >= 3)) + tabs
    columns = columns - semicolons * (semicolons == 1) * ended_by(c, e, 59)
    commas = per(_COMMA | _WIDE_COMMA) - tight

    head = c[s]
    second = c[np.minimum(s + 1, len(p) - 1)]
    spaced = (np.minimum(s + 1, len(p) - 1) <= e) & (gap[np.minimum(s + 1, len(p) - 1)] > 1)
    bullet = np.isin(head, [ord(x) for x in _BULLETS]) & spaced
    numbered = _numbered(c, b, s, e)
    box = (head == 91) & np.isin(second, [93, 120, 88])
    numbered |= box

    period = np.zeros(n_lines)
    for lag in range(1, _MAX_LAG + 1):
        if len(h) > lag:
            same = np.flatnonzero(h[lag:] == h[:-lag])
            same = wl[same][wl[same] == wl[same + lag]]
            hits = np.bincount(same, minlength=n_lines)
            period = np.maximum(period, hits / np.maximum(n_words - lag, 4))
    if len(h):
        period = np.maximum(period, np.where(n_words > 0, _over_and_over(h, document[wl], n_docs)[document], 0))
    # a line's words as one number, to find it again next door
    sums = np.zeros(n_lines, np.uint64)
    if len(h):
        begin = np.cumsum(n_words) - n_words
        order = np.arange(len(h)) - np.repeat(begin, n_words)
        mixed = h * (np.uint64(2) * (order % 4096).astype(np.uint64) + np.uint64(1))
        worded = n_words > 0
        sums[worded] = np.add.reduceat(mixed, begin[worded])
    same_doc = document[1:] == document[:-1]
    twin = (sums[1:] == sums[:-1]) & same_doc & (n_words[1:] > 2)
    repeated = np.append(twin, False) | np.insert(twin, 0, False)

    known = np.flatnonzero(which)
    common = np.bincount(wl[known], minlength=n_lines) / np.maximum(n_words, 1)
    f = np.empty((n_lines, len(FEATURES)), np.float32)
    f[:, 0] = np.log1p(np.minimum(n_words, LONG_LINE))
    f[:, 1] = common
    f[:, 2] = digits / visible
    f[:, 3] = symbols / visible
    f[:, 4] = ended
    f[:, 5] = bullet
    f[:, 6] = numbered
    f[:, 7] = np.log1p(columns)
    f[:, 8] = np.log1p(longest)
    f[:, 9] = period
    f[:, 10] = repeated
    f[:, 11] = per(_UPPER) / np.maximum(letters, 1)
    f[:, 12] = np.minimum((letters - hans) / np.maximum(n_words - hans, 1), 20)
    f[:, 13] = np.where(letters > hans, per(_VOWEL) / np.maximum(letters - hans, 1), 0.4)
    f[:, 14] = commas / np.maximum(n_words, 1)
    f[:, 15] = per(_ODD) / visible
    f[:, 16] = ends / np.maximum(n_words, 1)
    # short lines say little by themselves: their surroundings help
    short = visible < SHORT_LINE
    for k, column in enumerate((1, 0, 4)):
        f[:, 17 + k] = np.where(short, _near(f[:, column].astype(float), document), f[:, column])

    total = lambda x: np.bincount(document, weights=x, minlength=n_docs)
    told, tongues = document[wl[known]], which[known]
    by_language = np.stack([np.bincount(told[(tongues >> k) & 1 == 1], minlength=n_docs) for k in range(len(_LANGUAGES))], axis=1)
    return Lines(
        document, visible.astype(float), f, total(n_words), total(letters + digits + n_joined),
        total(symbols), total(visible), total(ended), total(np.ones(n_lines)), by_language.astype(float),
    )


def _over_and_over(h: np.ndarray, document: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document the share of words that recur, with those behind them, always at the same distance; 0 if less than ``OVER_AND_OVER``.

    A fragment of any length said over and over, in one line or over lines, has one distance.
    """
    out = np.zeros(n_docs)
    n = len(h) - GRAM + 1
    if n <= 0:
        return out
    with np.errstate(over="ignore"):
        gram = np.zeros(n, np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        gram += document[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    inside = document[:n] == document[GRAM - 1 :]
    # only texts with so many words whose bucket is shared need to be looked at
    words = np.bincount(document, minlength=n_docs)
    bits = n.bit_length() + 2
    bucket = (gram >> np.uint64(64 - bits)).astype(np.int64)
    shared = (np.bincount(bucket, minlength=1 << bits) > 1)[bucket]
    likely = np.bincount(document[:n][shared], minlength=n_docs) >= OVER_AND_OVER * words
    some = np.flatnonzero(likely[document[:n]])
    order = some[np.argsort(gram[some], kind="stable")]
    again = (gram[order][1:] == gram[order][:-1]) & inside[order][1:] & inside[order][:-1]
    at, before = order[1:][again], order[:-1][again]
    if not len(at):
        return out
    pairs, count = np.unique(document[at].astype(np.int64) << 32 | (at - before), return_counts=True)
    np.maximum.at(out, pairs >> 32, count / np.maximum(words[pairs >> 32], 1))  # said k times: about 1 - 1 / k
    return np.where(out >= OVER_AND_OVER, out, 0.0)


def ended_by(c: np.ndarray, e: np.ndarray, code: int) -> np.ndarray:
    return (c[e] == code).astype(int)


def _numbered(c: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Lines that begin with an enumerator: ``12.``, ``3)``, ``(4)``, ``b)``, ``c.``"""
    at = np.minimum(s + (c[s] == 40), e)
    bracket = c[s] == 40
    digit = (b[at] & _DIGIT) != 0
    letter = ((b[at] & _LETTER) != 0) & ((b[at] & _HAN) == 0)
    end = at.copy()
    for _ in range(4):
        nxt = np.minimum(end + 1, e)
        end = np.where(digit & ((b[nxt] & _DIGIT) != 0) & (nxt > end), nxt, end)
    after = np.minimum(end + 1, e)
    mark = (after > end) & ((c[after] == 41) | ((c[after] == 46) & ~bracket & digit))
    more = np.minimum(after + 1, e)
    spaced = (more > after) & ((b[more] & _DIGIT) == 0)
    return (digit | letter) & mark & spaced


def _near(x: np.ndarray, document: np.ndarray, reach: int = 3) -> np.ndarray:
    """The mean over up to ``reach`` lines before and after, in the same document."""
    n = len(x)
    k = np.arange(n)
    starts = np.searchsorted(document, document, side="left")
    ends = np.searchsorted(document, document, side="right")
    low, high = np.maximum(k - reach, starts), np.minimum(k + reach + 1, ends)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return (sums[high] - sums[low]) / (high - low)


def _powers(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)


@dataclass
class Mixture:
    """A fitted mixture: standardization, components and the kinds they stand for."""

    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    kinds: np.ndarray  # components x KINDS, rows add up to 1

    def _log(self, x: np.ndarray) -> np.ndarray:
        inverse = 1 / self.variances
        square = (x * x) @ inverse.T - 2 * x @ (self.means * inverse).T + (self.means**2 * inverse).sum(axis=1)
        return np.log(self.weights) - 0.5 * (square + np.log(self.variances).sum(axis=1))

    def responsibilities(self, standard: np.ndarray) -> np.ndarray:
        log = self._log(standard)
        log -= log.max(axis=1, keepdims=True)
        np.exp(log, out=log)
        log /= log.sum(axis=1, keepdims=True)
        return log

    def sums(self, features: np.ndarray) -> np.ndarray:
        """Components x (weight, then values, then squares of the standardized statistics), over the lines.

        A last row has the lines' summed log-likelihood in its first place.
        """
        by_power, k = self._by_power().astype(np.float32), features.shape[1]
        shift, scale = self.shift.astype(np.float32)[:, None], (1 / self.scale).astype(np.float32)[:, None]
        total = np.zeros((len(self.weights) + 1, 1 + 2 * k))
        # single precision inside a step, double between steps; a line is a column, so that whatever is done for all components runs along memory
        z, log = np.ones((1 + 2 * k, STEP_LINES), np.float32), np.empty((len(self.weights), STEP_LINES), np.float32)
        for a in range(0, len(features), STEP_LINES):
            some = features[a : a + STEP_LINES].T
            y, r = z[:, : some.shape[1]], log[:, : some.shape[1]]
            x = y[1 : 1 + k]
            np.subtract(some, shift, out=x)
            x *= scale
            np.multiply(x, x, out=y[1 + k :])
            np.matmul(by_power, y, out=r)
            top = r.max(axis=0)
            r -= top
            np.maximum(r, LEAST_LOG, out=r)
            np.exp(r, out=r)
            each = r.sum(axis=0)
            total[-1, 0] += float(top.sum(dtype=float) + np.log(each).sum(dtype=float))
            y /= each
            total[:-1] += r @ y.T
            y[0] = 1
        return total

    def _by_power(self) -> np.ndarray:
        """Components x what a line's 1, values and squares count for its log-density."""
        inverse = 1 / self.variances
        constant = np.log(self.weights) - 0.5 * ((self.means**2 * inverse).sum(axis=1) + np.log(self.variances).sum(axis=1))
        return np.concatenate([constant[:, None], self.means * inverse, -0.5 * inverse], axis=1)

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        """Lines x KINDS."""
        if not len(features):
            return np.zeros((0, len(KINDS)))
        by_power = self._by_power()
        out = np.empty((len(features), len(KINDS)))
        for a in range(0, len(features), STEP_LINES):
            x = ((features[a : a + STEP_LINES] - self.shift) / self.scale).T
            r = by_power @ np.concatenate([np.ones((1, x.shape[1])), x, x * x])
            r -= r.max(axis=0)
            np.exp(r, out=r)
            out[a : a + STEP_LINES] = (self.kinds.T @ r / r.sum(axis=0)).T
        return out


#: Adds up over all lines what a function tells of the statistics of some; None where no lines are.
Gather = Callable[[Callable[[np.ndarray], np.ndarray]], "np.ndarray | None"]


def moments(features: np.ndarray) -> np.ndarray:
    """The number of lines, and the sums and squares of each statistic."""
    x = features.astype(float)
    return np.stack([np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])


def fit_mixture(features: np.ndarray, rounds: int = EM_ROUNDS) -> Mixture:
    """The mixture of lines that are at hand."""
    return fit_gathered(lambda look: look(features) if len(features) else None, rounds)


def fit_gathered(gather: Gather, rounds: int = EM_ROUNDS) -> Mixture:
    """Expectation-maximization from the examples: a component per form, and their weight held."""
    parts = [(kind, describe([text]).features) for kind, forms in EXAMPLES.items() for text in forms]
    own = np.concatenate([x for _, x in parts]).astype(float)
    form = np.repeat(np.arange(len(parts)), [len(x) for _, x in parts])
    seen = gather(moments)
    if seen is None:
        seen, gather = moments(own), lambda look, own=own: look(own)
    n_lines = seen[0, 0]
    n_both, sums, squares = seen + moments(own)
    shift = sums / n_both
    scale = np.maximum(np.sqrt(np.maximum(squares / n_both - shift**2, 0)), 0.05)
    own = (own - shift) / scale
    fixed = (form[:, None] == np.arange(len(parts))).astype(float)
    fixed *= max(1.0, EXAMPLE_SHARE * n_lines) / fixed.sum(axis=0)
    held = fixed.T @ _powers(own)
    kinds = np.array([[float(kind == k) for k in KINDS] for kind, _ in parts])

    def step(told: np.ndarray) -> Mixture:
        told = told + held
        n = told[:, 0]
        means, squares = np.split(told[:, 1:] / n[:, None], 2, axis=1)
        variances = np.maximum(squares - means**2, 0) + VARIANCE_FLOOR
        return Mixture(shift, scale, n / n.sum(), means, variances, kinds)

    model = step(np.zeros_like(held))
    model.variances += 0.3  # wide at first, so that every line finds a component
    before = -math.inf
    for _ in range(rounds):
        told = gather(model.sums)
        model = step(told[:-1])
        likely = told[-1, 0] / max(n_lines, 1)
        if likely - before < SETTLED and before > -math.inf and likely >= before:
            break
        before = likely
    # what the examples say of each component
    said = model.responsibilities(own)
    weight = fixed.sum(axis=1)
    kind = np.array([[float(parts[f][0] == k) for k in KINDS] for f in form])
    votes = (said * weight[:, None]).T @ kind + 1e-3 * model.kinds
    model.kinds = votes / votes.sum(axis=1, keepdims=True)
    return model


def keep_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``describe`` tells of every document whose text isn't NULL or empty, computed once and kept in the shared folder.

    A row for each slice: ``n`` lines, ``f`` their statistics, ``keys`` of the documents, ``counts`` of ``packed_counts``.
    """
    checkpoint_dir(documents.sparkSession)
    told = documents.where(F.length(F.col(text)) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = told.schema["key"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lines = describe(part.column("text").to_pylist())
                n = len(lines.document)
                if n:
                    # statistic by statistic, which compresses better
                    packed = _packed(np.ascontiguousarray(lines.features.T, np.float32))
                    keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("key"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n], pa.int64()), pa.array([packed], pa.binary()), keys, pa.array([packed_counts(lines)], pa.binary())],
                        ["n", "f", "keys", "counts"],
                    )

    return told.mapInArrow(look, f"n long, f binary, keys array<{kind}>, counts binary").checkpoint()


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x, codec="lz4", asbytes=True)


def _unpacked(packed: pa.Scalar, kind: type, *shape: int) -> np.ndarray:
    raw = pa.decompress(packed.as_buffer(), math.prod(shape) * np.dtype(kind).itemsize, codec="lz4")
    return np.frombuffer(raw, kind).reshape(shape)


def packed_counts(lines: Lines) -> bytes:
    """Everything in ``lines`` but the statistics: the characters of each line, the totals of each document."""
    totals = np.stack([lines.n_words, lines.word_characters, lines.symbols, lines.visible, lines.ended, lines.lines, *lines.common.T])
    return _packed(np.concatenate([lines.characters, totals.ravel()]).astype(np.int32))


def unpacked_lines(n: int, features: pa.Scalar, counts: pa.Scalar, n_docs: int) -> Lines:
    """The lines that a row of ``keep_lines`` holds."""
    n_totals = 6 + len(_LANGUAGES)
    characters, totals = np.split(_unpacked(counts, np.int32, n + n_totals * n_docs).astype(float), [n])
    totals = totals.reshape(n_totals, n_docs)
    document = np.repeat(np.arange(n_docs), totals[5].astype(np.int64))
    return Lines(document, characters, _unpacked(features, np.float32, len(FEATURES), n).T, *totals[:6], totals[6:].T)


def fit_documents(documents: DataFrame, text: str = "text") -> Mixture:
    """The mixture of all lines of all documents."""
    return fit_kept(keep_lines(documents.select(F.lit(0).alias("key"), text), "key", text))


def fit_kept(kept: DataFrame) -> Mixture:
    """The mixture of all lines of ``keep_lines``, which are read in every round."""
    kept = kept.select("n", "f")
    parts = kept.rdd.getNumPartitions()
    groups = math.ceil(math.sqrt(parts))

    def gather(of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for n, packed in zip(batch.column("n").to_pylist(), batch.column("f"), strict=True):
                    one = of(_unpacked(packed, np.float32, len(FEATURES), n).T)
                    total = one if total is None else total + one
            if total is not None:
                yield _row(TaskContext.get().partitionId(), total)

        def add_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted(r for batch in batches for r in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True))
            if rows:
                yield _row(rows[0][0], sum(np.frombuffer(s) for _, s in rows))

        schema = "part int, sums binary"
        some = kept.mapInArrow(add, schema)
        if parts > FEW_PARTS:  # added up in two steps, so that the driver never gets more than a root of them
            some = some.repartition(groups, F.pmod("part", F.lit(groups))).mapInArrow(add_more, schema)
        rows = sorted(some.collect())
        return sum(np.frombuffer(bytes(r.sums)) for r in rows).reshape(of(np.empty((0, len(FEATURES)), np.float32)).shape) if rows else None

    return fit_gathered(gather)


def _row(part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])


def document_kinds(lines: Lines, model: Mixture, n_docs: int) -> np.ndarray:
    """Characters of each document by kind (documents x KINDS)."""
    post = model.posteriors(lines.features)
    if len(post):
        near = np.stack([_near(post[:, k], lines.document, 2) for k in range(len(KINDS))], axis=1)
        post = np.where(lines.characters[:, None] < SHORT_LINE, (post + near) / 2, post)
    hard = np.zeros_like(post)
    if len(post):
        hard[np.arange(len(post)), post.argmax(axis=1)] = 1
    return np.stack(
        [np.bincount(lines.document, weights=hard[:, k] * lines.characters, minlength=n_docs) for k in range(len(KINDS))], axis=1
    )


def quality(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Mixture | None = None) -> DataFrame:
    """The statistics and the kind of every document whose text isn't NULL or blank.

    ``key, n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words, language, kind``.
    A word is a run of letters and digits, with an apostrophe inside, or one Han or kana character.
    ``symbol_ratio`` is the share of visible characters that are no letters, digits, commas or
    ends of sentences; ``punctuated_lines`` of non-blank lines that end a sentence;
    ``common_words`` of words that are among the commonest of the language that has most of them
    (``language``; NULL and 0 where no word is). A text without words has 0 in the ratios of
    words. Equal numbers of characters: the kind named first in ``KINDS``.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n_words long, mean_word_length double, symbol_ratio double, punctuated_lines double, "
        "common_words double, language string, kind string"
    )

    def judged(keys: pa.Array, lines: Lines, model: Mixture) -> pa.RecordBatch:
        n = len(keys)
        shares = document_kinds(lines, model, n)
        common = lines.common
        best = common.argmax(axis=1)
        top = common[np.arange(n), best]
        words = np.maximum(lines.n_words, 1)
        out = pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array(lines.n_words.astype(np.int64)),
                pa.array(lines.word_characters / words),
                pa.array(lines.symbols / np.maximum(lines.visible, 1)),
                pa.array(lines.ended / np.maximum(lines.lines, 1)),
                pa.array(top / words),
                pa.array([_LANGUAGES[k] if t else None for k, t in zip(best, top, strict=True)], pa.string()),
                pa.array([KINDS[k] for k in shares.argmax(axis=1)], pa.string()),
            ],
            [key, "n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "language", "kind"],
        )
        return out.filter(pa.array(lines.visible > 0))

    if model is not None:

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text, SLICE):
                    yield judged(part.column(key), describe(part.column(text).to_pylist()), model)

        return documents.where(F.length(F.col(text)) > 0).select(key, text).mapInArrow(judge, schema)

    kept = keep_lines(documents, key, text)
    fitted = fit_kept(kept)

    def judge_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, features, keys, counts in zip(batch.column("n").to_pylist(), *(batch.column(c) for c in ("f", "keys", "counts")), strict=True):
                yield judged(keys.values, unpacked_lines(n, features, counts, len(keys)), fitted)

    return kept.mapInArrow(judge_kept, schema)
