"""What is counted in a text, for whole Arrow batches of texts at once.

The texts of a batch lie one after the other as code points with a line end between them. Every
count is a difference of running sums at the borders of documents or lines; stretches of text are
told apart by a rolling hash, so that no text is cut into Python strings.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STATISTICS = (
    "word_count mean_word_length longest_word symbol_ratio digit_ratio upper_ratio letter_ratio stray_ratio "
    "punctuated_lines common_words sentence_share bullet_share grid_share grid_equal short_share line_words "
    "distinct_sentences distinct_words distinct_lines sentence_words"
).split()

#: Code points taken in one go; a longer text is taken alone.
PART = 1 << 19
#: Texts taken in one go, at most: their number goes into 16 bits of a key.
PART_TEXTS = 1 << 14

#: Scripts without spaces between words, and marks by their use.
WIDE = ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))
_PUNCTUATION = ".,;:!?'\"’。、！？-"
_ENDERS, _CLOSERS, _BULLETS, _AFTER = ".!?。！？…", "»\"”’'」)]", "-*•·›+>–—▪◦‣", "「"
_SPACES = " \t\n\x0b\f\r"
_DROPPED = (0xFEFF, 0x0D)

LETTER, NUMBER, UPPER, DIGIT, SPACE, WIDE_CHAR, SYMBOL, STRAY, ENDER, CLOSER, BULLET, BOUNDARY = (1 << k for k in range(12))
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW48 = np.uint64((1 << 48) - 1)


def is_wide(text: str) -> bool:
    return any(lo <= ord(c) <= hi for c in text for lo, hi in WIDE)


def _flags(c: str) -> int:
    category, at = unicodedata.category(c), ord(c)
    wide = is_wide(c)
    word = category[0] in "LN"
    found = {
        LETTER: category[0] == "L",
        NUMBER: category[0] == "N",
        UPPER: category == "Lu",
        DIGIT: "0" <= c <= "9",
        SPACE: c in _SPACES,
        WIDE_CHAR: wide,
        SYMBOL: not word and c not in _SPACES and c not in _PUNCTUATION,
        STRAY: 0x80 <= at <= 0xFF or at == 0xFFFD,
        ENDER: c in _ENDERS,
        CLOSER: c in _CLOSERS,
        BULLET: c in _BULLETS,
        BOUNDARY: c in _SPACES or wide or c in _AFTER,
    }
    return sum(bit for bit, holds in found.items() if holds)


def _scrambled(value: int) -> int:
    value = (value + 1) * 0xBF58476D1CE4E5B9 % (1 << 64)
    value = (value ^ value >> 27) * 0x94D049BB133111EB % (1 << 64)
    return value ^ value >> 31


class Alphabet:
    """Flags and hash values of code points, filled in as they are met."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, bool)
        self.flags = np.zeros(0x110000, np.uint16)
        self.codes = np.zeros(0x110000, np.uint64)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def learn(self, points: np.ndarray) -> None:
        met = np.zeros(0x110000, bool)
        met[points] = True
        for at in np.flatnonzero(met & ~self.known).tolist():
            c = chr(at)
            low = c.lower()
            self.flags[at] = _flags(c)
            self.codes[at] = _scrambled(ord(low) if len(low) == 1 else at)
            self.known[at] = True

    def scales(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` powers of the base, and of its inverse."""
        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.powers, self.inverses


class Hashes:
    """Hashes of stretches of one run of code points, upper and lower case alike."""

    def __init__(self, alphabet: Alphabet, points: np.ndarray) -> None:
        powers, self.inverses = alphabet.scales(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(alphabet.codes[points] * powers[: len(points)], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[first]) * self.inverses[first]
        return value ^ (value >> np.uint64(29))


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _kinds(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values by owner: the different ones' owners, 48 bits of their hash, how often each occurs."""
    key = np.sort(owner.astype(np.uint64) << np.uint64(48) | value & _LOW48)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return (key[first] >> np.uint64(48)).astype(np.int64), key[first] & _LOW48, np.diff(np.append(first, len(key)))


class FrequentWords:
    """Frequent words by language: those between spaces by their hash, wide ones as they are."""

    def __init__(self, alphabet: Alphabet, listed: list[tuple[str, str]]) -> None:
        self.languages = sorted({lang for lang, _ in listed})
        self.listed = frozenset(self.languages)
        place = {lang: k for k, lang in enumerate(self.languages)}
        narrow = sorted({(w, place[lang]) for lang, w in listed if not is_wide(w)})
        words = sorted({w for w, _ in narrow})
        number = {w: k for k, w in enumerate(words)}
        points = [np.array([ord(c) for c in w], np.int64) for w in words]
        for p in points:
            alphabet.learn(p)
        hashed = np.array([int(Hashes(alphabet, p).of(np.array([0]), np.array([len(p)]))[0] & _LOW48) for p in points], np.uint64)
        order = np.argsort(hashed)
        self.hashed = hashed[order]
        self.of = np.zeros((len(words) + 1, len(self.languages)), bool)  # the last row: no frequent word
        for w, lang in narrow:
            self.of[np.flatnonzero(order == number[w])[0], lang] = True
        # What a longer word took is not counted again for a shorter one inside it.
        self.wide = [sorted({w for own, w in listed if own == lang and is_wide(w)}, key=lambda w: (-len(w), w)) for lang in self.languages]

    def find(self, value: np.ndarray) -> np.ndarray:
        """Each hash's row in ``of``."""
        if not len(self.hashed):
            return np.zeros(len(value), np.int64)
        at = np.minimum(np.searchsorted(self.hashed, value), len(self.hashed) - 1)
        return np.where(self.hashed[at] == value, at, len(self.hashed))

    def wide_hits(self, text: str, language: int) -> tuple[int, int]:
        """How many kinds of a language's wide words a text holds, and how often they occur."""
        kinds = total = 0
        for word in self.wide[language]:
            if n := text.count(word):
                kinds, total, text = kinds + 1, total + n, text.replace(word, " ")
        return kinds, total


def count_part(texts: list[str], declared: list[str], alphabet: Alphabet, frequent: FrequentWords) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of texts: whether each holds anything but blanks, its language, and a column per statistic."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    length = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(length + 1) - 1
    dropped = np.isin(points, _DROPPED)
    if dropped.any():
        gone = _running(dropped)
        end = end - gone[end]
        points = points[~dropped]
    begin = np.concatenate([[0], end[:-1] + 1])
    alphabet.learn(points)
    flag = alphabet.flags[points]
    hashed = Hashes(alphabet, points)
    has = lambda bit: (flag & bit) != 0
    before = lambda mask: np.concatenate([[False], mask[:-1]])
    after = lambda mask: np.concatenate([mask[1:], [False]])
    per_text = lambda mask: (s := _running(mask))[end] - s[begin]
    n_texts = len(texts)
    some = per_text(~has(SPACE)) > 0
    n = np.where(some, np.maximum(end - begin, 1), 1)

    # Tokens: runs of letters and digits, and each wide character on its own.
    wide, space = has(WIDE_CHAR), has(SPACE)
    word = has(LETTER | NUMBER) & ~wide
    first, last = np.flatnonzero(word & ~before(word)), np.flatnonzero(word & ~after(word)) + 1
    lone = np.flatnonzero(wide)
    token = np.concatenate([first, lone])
    owner = np.searchsorted(end, token)
    n_words = np.bincount(owner, minlength=n_texts)
    kind_owner, kind_hash, kind_count = _kinds(owner, hashed.of(token, np.concatenate([last, lone + 1])))
    n_kinds = np.bincount(kind_owner, minlength=n_texts)

    # The language whose frequent words the text holds most kinds of.
    row = frequent.find(kind_hash)
    hits, common = np.zeros((2, len(frequent.languages), n_texts), np.int64)
    for k in range(len(frequent.languages)):
        mine = frequent.of[row, k]
        hits[k] = np.bincount(kind_owner[mine], minlength=n_texts)
        common[k] = np.bincount(kind_owner[mine], kind_count[mine], minlength=n_texts)
    has_wide = np.bincount(np.searchsorted(end, lone), minlength=n_texts) > 0
    for k, words in enumerate(frequent.wide):
        for t in np.flatnonzero(has_wide).tolist() if words else ():
            kinds, total = frequent.wide_hits(texts[t].lower(), k)
            hits[k, t] += kinds
            common[k, t] += total
    language, in_language = list(declared), np.zeros(n_texts, np.int64)
    if frequent.languages:
        same = np.array([[lang == d for d in declared] for lang in frequent.languages])
        rank = 2 * hits + same
        best = len(rank) - 1 - np.argmax(rank[::-1], 0)  # the last by name among equals
        known = hits[best, np.arange(n_texts)] > 0
        language = [frequent.languages[b] if k else d for b, k, d in zip(best.tolist(), known.tolist(), declared, strict=True)]
        in_language = common[best, np.arange(n_texts)]
        in_language = np.where(known, in_language, 0)

    # Lines that hold anything, without the spaces around them.
    line_end = np.flatnonzero(points == 10)
    line_begin = np.concatenate([[0], line_end[:-1] + 1])
    shown = np.flatnonzero(~space)
    filled = np.searchsorted(shown, line_end) > np.searchsorted(shown, line_begin)
    line_begin, line_end = line_begin[filled], line_end[filled]
    of_text = np.searchsorted(end, line_end)
    inked = np.flatnonzero((points != 32) & (points != 10))
    bare_begin, bare_last = inked[np.searchsorted(inked, line_begin)], inked[np.searchsorted(inked, line_end) - 1]
    per_line = lambda places: np.searchsorted(places, line_end) - np.searchsorted(places, line_begin)
    mass = bare_last + 1 - bare_begin
    run_first, run_last = np.flatnonzero(~space & ~before(~space)), np.flatnonzero(~space & ~after(~space))
    units = per_line(run_first)
    # Where wide characters occur, two of them count as a word beside the words between spaces.
    if len(lone):
        solid = ~space & ~wide
        run = np.cumsum(solid & ~before(solid))
        letters_at = np.flatnonzero(word)
        opening = letters_at[np.concatenate([[True], np.diff(run[letters_at]) != 0])] if len(letters_at) else letters_at
        units = np.maximum(units, np.where(has_wide[of_text], per_line(opening) + per_line(lone) // 2, 0))
    closer, ender = has(CLOSER), has(ENDER)
    plain = np.flatnonzero(~closer)
    stop = np.flatnonzero(ender & ~after(ender)) + 1
    stop = stop[has(BOUNDARY)[plain[np.searchsorted(plain, stop)]]]
    ends = per_line(stop - 1)
    final = plain[np.maximum(np.searchsorted(plain, bare_last, "right") - 1, 0)]
    closed = ender[final] & (final >= bare_begin)
    head = shown[np.searchsorted(shown, line_begin)]
    inline = space & (points != 10)
    at = lambda mask, place: mask[np.minimum(place, len(points) - 1)]
    bullet = has(BULLET)[head] & at(inline, head + 1)
    digit, numbered = has(DIGIT), np.ones(len(head), bool)
    for k in range(1, 5):
        numbered &= at(digit, head + k - 1)
        mark = points[np.minimum(head + k, len(points) - 1)]
        bullet |= numbered & ((mark == 46) | (mark == 41)) & at(inline, head + k + 1)
    # What separates cells, the first kind that a line has: tabs, bars, semicolons and commas right
    # before the next cell, wide spaces.
    follows = after(~space)
    gap = points == 32
    separators = (
        points == 9,
        points == 124,
        (points == 59) & follows & ~after(points == 59),
        (points == 44) & follows & ~after(points == 44),
        gap & before(gap) & follows,
    )
    border, cells = np.zeros(len(line_end), np.int64), np.zeros(len(line_end), np.int64)
    for k, mask in enumerate(separators, 1):
        found = per_line(np.flatnonzero(mask))
        take = (border == 0) & (found > 0)
        border[take], cells[take] = k, found[take]
    sentence_line = (ends > 0) & (units >= 4 * ends) & ~bullet
    paired = (border[1:] == border[:-1]) & (border[1:] > 0) & (of_text[1:] == of_text[:-1])
    none = np.zeros(min(1, len(border)), bool)
    grid = np.concatenate([none, paired]) | np.concatenate([paired, none])
    equal = np.concatenate([paired & (cells[1:] == cells[:-1]), none])
    n_lines = np.bincount(of_text, minlength=n_texts)
    total = np.maximum(np.bincount(of_text, mass, minlength=n_texts), 1)
    share = lambda test: np.bincount(of_text[test], mass[test], minlength=n_texts) / total
    line_kinds = np.bincount(_kinds(of_text, hashed.of(bare_begin, bare_last + 1))[0], minlength=n_texts)

    # Sentences lie between sentence ends and line ends; blanks around them do not count.
    cut = np.flatnonzero(ender | (points == 10))
    piece_begin = np.concatenate([[0], cut[:-1] + 1])
    low, high = np.searchsorted(shown, piece_begin), np.searchsorted(shown, cut)
    low, high = low[high > low], high[high > low]
    s_begin, s_end = shown[low], shown[high - 1] + 1
    s_owner = np.searchsorted(end, s_begin)
    n_sentences = np.bincount(s_owner, minlength=n_texts)
    s_kinds = np.bincount(_kinds(s_owner, hashed.of(s_begin, s_end))[0], minlength=n_texts)

    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, np.searchsorted(end, run_first), run_last + 1 - run_first)
    letters = per_text(has(LETTER))
    least = lambda x: np.maximum(x, 1)
    columns = {
        "word_count": n_words,
        "mean_word_length": per_text(word | wide) / least(n_words),
        "longest_word": longest,
        "symbol_ratio": per_text(has(SYMBOL)) / n,
        "digit_ratio": per_text(digit) / n,
        "upper_ratio": per_text(has(UPPER)) / least(letters),
        "letter_ratio": letters / n,
        "stray_ratio": per_text(has(STRAY)) / n,
        "punctuated_lines": np.bincount(of_text[closed], minlength=n_texts) / least(n_lines),
        "common_words": in_language / least(n_words),
        "sentence_share": share(sentence_line),
        "bullet_share": share(bullet),
        "grid_share": share(grid),
        "grid_equal": share(equal),
        "short_share": share(units <= 5),
        "line_words": n_words / least(n_lines),
        "distinct_sentences": s_kinds / least(n_sentences),
        "distinct_words": n_kinds / least(n_words),
        "distinct_lines": line_kinds / least(n_lines),
        "sentence_words": n_words / least(n_sentences),
    }
    return some, language, np.stack([columns[s].astype(float) for s in STATISTICS])


def parts(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about :data:`PART` code points together."""
    lo = held = 0
    for k, size in enumerate(lengths):
        if k > lo and (held + size > PART or k - lo == PART_TEXTS):
            yield lo, k
            lo, held = k, 0
        held += size
    if lo < len(lengths):
        yield lo, len(lengths)


def counted(batch: pa.RecordBatch, alphabet: Alphabet, frequent: FrequentWords) -> Iterator[pa.RecordBatch]:
    """``doc_id, has_text, language, listed`` and the statistics, of a batch ``doc_id, declared, text``."""
    texts = [b"" if t is None else t for t in batch.column(2).cast(pa.binary()).to_pylist()]
    texts = [t.decode("utf-8", "replace") for t in texts]
    declared = batch.column(1).to_pylist()
    for lo, hi in parts([len(t) for t in texts]):
        some, language, columns = count_part(texts[lo:hi], declared[lo:hi], alphabet, frequent)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(lo, hi - lo),
                pa.array(some),
                pa.array(language, pa.string()),
                pa.array([name in frequent.listed for name in language], pa.bool_()),
                *(pa.array(np.where(some, c, 0.0)) for c in columns),
            ],
            names=["doc_id", "has_text", "language", "listed", *STATISTICS],
        )
