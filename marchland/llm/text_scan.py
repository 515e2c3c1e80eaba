"""Statistics of many texts at once, from one pass over their code points (NumPy only).

The texts of a batch are joined by line feeds into one array of code points; classes of characters come from a table, and lines
and words are runs in it. All counts are sums over the runs of a text, so nothing depends on a text's length.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, DIGIT, SPACE, UPPER, HAN, BREAK, STOP, CLOSE, ODD, SEPARATOR, SMALL, VOWEL, HAN_FUNCTION, NOISE_AFTER, NOISE_BEFORE, BULLET, SENTENCE, EURO = (1 << i for i in range(18))
#: Function words of English, German, Spanish and French; none of them is made of the letters a-f only (hex dumps) or common in
#: navigation and traces ("at", "in", "to").
FUNCTION_WORDS = (
    "the of and that was were are which this these those with not but because when where who had have been its than then such "
    "there their they we you he she his her our will would could does did over under between without while about after before "
    "nobody still only even though although since once both for from how why what must until all one "
    "der die das und ist nicht ein eine einen mit auf für von dem den des wurde wurden war waren sich auch als nur bei wir wird sind "
    "haben hat aber doch weil dass obwohl deshalb wenn man zwischen während nach noch "
    "el la los las que un una por con para fue era su más pero como sin entre cuando muy todo porque aunque después está del ya "
    "le les des du et est une dans pour qui sur avec pas plus mais nous sont était ont cette car aux lorsque alors entre très sous quand chez après"
).split()
#: Characters that Chinese sentences can hardly do without.
HAN_WORDS = "的了是在和有这们把被因但如很就"
#: Characters of text that one function word accounts for.
SPAN = 40
#: Words of a run that is looked for elsewhere in the text.
RUN = 5
BINS = 64
_TOP = 0x30000

FEATURES = (
    "n_words", "mean_word_length", "word_length_spread", "letter_share", "digit_share", "space_share", "symbol_share", "odd_share", "separator_share", "upper_share", "n_lines", "mean_line_length",
    "short_line_share", "lines_ended_share", "bullet_share", "spaceless_share", "words_a_sentence", "sentence_spread", "capital_word_share", "mixed_word_share", "broken_word_share", "vowel_share",
    "letter_entropy", "pair_entropy", "short_word_share", "repeated_short_share", "distinct_words", "distinct_word_share", "distinct_line_share", "top_word_share", "repeated_share",
)
#: Shares that rest on lists of words; they label texts, and the trees don't see them.
LEXICAL = ("common_word_share", "prose_share")
ALL = FEATURES + LEXICAL


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class flags and lower case of each code point; those beyond the third plane count as its last."""
    flags = np.zeros(_TOP + 1, np.uint32)
    lower = np.arange(_TOP + 1, dtype=np.uint32)
    for c in range(_TOP):
        ch = chr(c)
        kind = unicodedata.category(ch)
        f = 0
        if kind[0] == "L":
            f |= LETTER
            if kind == "Lu":
                f |= UPPER
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif kind[0] == "N":
            f |= DIGIT
        elif kind[0] == "Z" or ch in "\t\n\v\f\r\x85":
            f |= SPACE
        elif kind in ("Mn", "Mc"):
            f |= LETTER if c > 0x2FF else 0
        flags[c] = f
    every = {
        BREAK: "\n\r\v\f\x85\u2028\u2029", STOP: ".!?…。！？:;", CLOSE: "\"”’»)]", SEPARATOR: "\t|,;&<>{}[]=\\_", HAN_FUNCTION: HAN_WORDS, NOISE_AFTER: "#*|%~&_^□�@$+<>\\", NOISE_BEFORE: "#*|%~&^□�",
        BULLET: "-*•+·–", SENTENCE: ".!?…。！？", VOWEL: "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœαεηιουωάέήίόύώаеёиоуыэюяіїєąęęıőű",
    }
    for flag, chars in every.items():
        for ch in chars:
            flags[ord(ch)] |= flag
    plain = set(".,;:!?'’\"“”‘()-–—…。，、！？；：（）「」《》«»¿¡/=+%")
    symbol = (flags & (LETTER | DIGIT | SPACE)) == 0
    flags[symbol] |= ODD
    flags[[ord(ch) for ch in plain]] &= ~np.uint32(ODD)
    flags[ord("a") : ord("z") + 1] |= SMALL
    flags[0xE0:0x100] |= SMALL
    flags[0xE0:0x100] |= EURO
    flags[[0xC3, 0xC2]] |= EURO
    for lo, hi in ((0x2E80, 0x2FE0), (0x3005, 0x3008), (0x3021, 0x302A), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, _TOP)):
        letters = (flags[lo:hi] & (LETTER | DIGIT)) > 0
        flags[lo:hi][letters] |= HAN
    flags[_TOP] = ODD
    return flags, lower


def _hash(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return v ^ (v >> np.uint64(29))


def _runs_hash(code: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run's code points; runs begin at ``starts`` and what is not inside adds nothing."""
    code, inside, starts = code[starts[0] :], inside[starts[0] :], starts - starts[0]
    at = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
    power = np.ones(int(at.max()) + 1 if len(at) else 1, np.uint64)
    power[1:] = np.uint64(0x100000001B3)
    power = np.cumprod(power)
    return _hash(np.add.reduceat(np.where(inside, _hash(code.astype(np.uint64) + np.uint64(1)) * power[at], np.uint64(0)), starts))


@lru_cache(maxsize=1)
def _function_hashes() -> np.ndarray:
    text = " ".join(sorted(set(FUNCTION_WORDS)))
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = code == 32
    starts = np.append(0, np.flatnonzero(space) + 1)
    return np.sort(_runs_hash(code, ~space, starts))


def _held(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _entropy(counts: np.ndarray) -> np.ndarray:
    total = np.maximum(1, counts.sum(axis=1, keepdims=True))
    p = counts / total
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)


def scan(texts: list[str]) -> dict[str, np.ndarray]:
    """n_chars and ALL of each text; an empty or blank one has zeros."""
    flags, lower = tables()
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(code, _TOP)
    pad = np.cumsum(size + 1) - 1
    first = pad - size
    doc = np.repeat(np.arange(n), size + 1)
    cls = flags[code]
    low = lower[code]
    cls_in = cls.copy()
    cls_in[pad] = 0
    total = lambda mask: np.add.reduceat(mask, first, dtype=np.int64)
    count = lambda flag: total((cls_in & flag) != 0).astype(float)
    chars = np.maximum(1, size).astype(float)
    out: dict[str, np.ndarray] = {"n_chars": size.astype(np.int64)}

    space = (cls & SPACE) != 0
    letter = (cls & LETTER) != 0
    letters = count(LETTER)
    out["letter_share"], out["digit_share"], out["space_share"] = letters / chars, count(DIGIT) / chars, count(SPACE) / chars
    out["symbol_share"] = total((cls_in != 0) & ((cls_in & (LETTER | DIGIT | SPACE)) == 0) | ((cls_in == 0) & (np.arange(len(code)) != pad[doc]))) / chars
    out["odd_share"], out["separator_share"] = count(ODD) / chars, count(SEPARATOR) / chars
    out["upper_share"] = count(UPPER) / np.maximum(1, letters)
    out["vowel_share"] = total(((flags[low] & VOWEL) != 0) & (cls_in != 0)) / np.maximum(1, letters)

    # lines
    brk = (cls & BREAK) != 0
    line_first = np.append(0, np.flatnonzero(brk[:-1]) + 1)
    line = np.cumsum(brk) - brk
    where = np.arange(len(code))
    last = np.maximum.reduceat(np.where(space, -1, where), line_first)
    begin = np.minimum.reduceat(np.where(space, len(code), where), line_first)
    filled = last >= 0
    length = np.add.reduceat(~brk, line_first, dtype=np.int64)
    end = np.maximum.reduceat(np.where(space | ((cls & CLOSE) != 0), -1, where), line_first)
    ended = filled & (end >= 0) & ((cls[np.maximum(end, 0)] & STOP) != 0)
    safe = lambda i: np.minimum(i, len(code) - 1)
    b = safe(begin)
    bullet = ((cls[b] & BULLET) != 0) & space[safe(b + 1)]
    b = np.where(code[b] == ord("("), safe(b + 1), b)
    digits = (cls & DIGIT) != 0
    number = digits[b]
    for k in (1, 2, 3):
        mark = np.isin(code[safe(b + k)], (ord("."), ord(")"))) & space[safe(b + k + 1)]
        bullet |= number & mark
        number = number & digits[safe(b + k)]
    bullet &= filled
    line_doc = doc[line_first]
    per_doc = lambda v: np.bincount(line_doc, v, n)
    n_lines = per_doc(filled)
    some_lines = np.maximum(1, n_lines)
    held = per_doc(np.where(filled, length, 0))
    out["n_lines"], out["mean_line_length"] = n_lines, np.maximum(1, held) / some_lines
    out["short_line_share"] = per_doc(filled & (length < 40)) / some_lines
    out["lines_ended_share"], out["bullet_share"] = per_doc(ended) / some_lines, per_doc(bullet) / some_lines
    line_code = _runs_hash(low, ~brk, line_first)
    lines = np.unique(_hash(line_code[filled] + _hash(line_doc[filled].astype(np.uint64) + np.uint64(7))), return_index=True)[1]
    out["distinct_line_share"] = np.bincount(line_doc[filled][lines], minlength=n) / some_lines
    spaces_in = np.add.reduceat(space & ~brk, line_first, dtype=np.int64)
    out["spaceless_share"] = per_doc(filled & (spaces_in == 0) & (length > 20)) / some_lines

    # words: a Han character, or a run of other letters and digits
    han = (cls & HAN) != 0
    wordy = (letter | digits) & ~han
    starts = wordy & ~np.append(False, wordy[:-1])
    at = np.flatnonzero(starts | han)
    words = np.zeros(n)
    zero = np.zeros(n)
    names = ("n_words", "mean_word_length", "word_length_spread", "common_word_share", "prose_share", "broken_word_share", "capital_word_share", "mixed_word_share", "distinct_words", "distinct_word_share", "top_word_share", "repeated_share", "words_a_sentence", "sentence_spread", "short_word_share", "repeated_short_share")
    out |= dict.fromkeys(names, zero)
    if len(at):
        inside = wordy | han
        wdoc, wlen = doc[at], np.add.reduceat(inside, at, dtype=np.int64)
        # a Han character's run would take in what follows it up to the next word, which is no word character
        words = np.bincount(wdoc, minlength=n).astype(float)
        some = np.maximum(1, words)
        by = lambda v: np.bincount(wdoc, v, n)
        mean = by(wlen) / some
        code_of = _runs_hash(low, inside, at)
        common = _held(code_of, _function_hashes()) | ((cls[at] & HAN_FUNCTION) != 0)
        hits = np.bincount(line[at], common, len(line_first))
        out["n_words"], out["mean_word_length"] = words, mean
        out["word_length_spread"] = np.sqrt(np.maximum(0, by(wlen.astype(float) ** 2) / some - mean**2))
        out["common_word_share"] = by(common) / some
        out["prose_share"] = per_doc(np.where(filled, np.minimum(length, SPAN * hits), 0)) / np.maximum(1, held)
        prev, nxt = np.append(0, cls[:-1]), np.append(cls[1:], 0)
        small, asking, euro = (cls & SMALL) != 0, np.isin(code, (ord("?"), 0xBF)), (cls & EURO) != 0
        late = ((code >= 0x80) & (code <= 0xBF) & (code != 0xAA) & (code != 0xB5) & (code != 0xBA)) | np.isin(code, [ord(c) for c in "€‚„†‡ˆ‰‹‘’“”•™�"])
        broken = letter & ((nxt & NOISE_AFTER) != 0)
        broken |= ((cls & NOISE_BEFORE) != 0) & ((nxt & LETTER) != 0)
        ascii_digit = (code >= 48) & (code < 58)
        broken |= (ascii_digit | asking) & ((prev & SMALL) != 0) & ((nxt & SMALL) != 0)
        broken |= euro & np.append(late[1:], False)
        out["broken_word_share"] = total(broken & (cls_in != 0)) / some
        has_digit, has_letter = np.maximum.reduceat(digits & inside, at), np.maximum.reduceat(letter & inside, at)
        cut = np.append(True, letter[:-1] & ((cls[:-1] & UPPER) == 0))  # lower case before
        turn = ((cls & UPPER) != 0) & cut & np.append(False, wordy[:-1])
        out["capital_word_share"] = by((cls[at] & UPPER) != 0) / some
        out["mixed_word_share"] = by((has_digit & has_letter) | (np.add.reduceat(turn & inside, at, dtype=np.int64) > 0)) / some
        both = _hash(code_of + _hash(wdoc.astype(np.uint64) + np.uint64(3)))
        _, one, back, often = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
        out["distinct_words"] = np.bincount(wdoc[one], minlength=n).astype(float)
        out["distinct_word_share"] = out["distinct_words"] / some
        top = np.zeros(n)
        np.maximum.at(top, wdoc[one], often)
        out["top_word_share"] = top / some
        short = (wlen <= 3) & ~han[at] & has_letter & ~has_digit
        out["short_word_share"], out["repeated_short_share"] = by(short) / some, by(short & (often[back] > 1)) / some
        # runs of words that occur three times or more
        if len(at) >= RUN:
            run = np.zeros(len(at) - RUN + 1, np.uint64)
            for i in range(RUN):
                run = run * np.uint64(0x9E3779B97F4A7C15) + code_of[i : i + len(run)] + np.uint64(1)
            fits = wdoc[RUN - 1 :] == wdoc[: len(run)]
            key = _hash(run[fits] + _hash(wdoc[: len(run)][fits].astype(np.uint64) + np.uint64(5)))
            _, back, seen = np.unique(key, return_inverse=True, return_counts=True)
            again = np.zeros(len(run), bool)
            again[fits] = seen[back] >= 3
            covered = np.zeros(len(at), bool)
            for i in range(RUN):
                covered[i : i + len(run)] |= again
            out["repeated_share"] = by(np.where(covered, wlen, 0)) / np.maximum(1, by(wlen))
        # sentences end with a mark before a space, a closing sign or a line's end; Han ones with the mark itself
        stop = ((cls & SENTENCE) != 0) & ((nxt & (SPACE | CLOSE)) != 0) | np.isin(code, [ord(c) for c in "。！？"])
        parts = np.cumsum(np.append(0, stop[:-1]))
        sentence = parts[at]
        change = np.append(True, (sentence[1:] != sentence[:-1]) | (wdoc[1:] != wdoc[:-1]))
        s_at = np.flatnonzero(change)
        s_len = np.diff(np.append(s_at, len(at))).astype(float)
        s_doc = wdoc[s_at]
        s_n = np.maximum(1, np.bincount(s_doc, minlength=n))
        s_mean = np.bincount(s_doc, s_len, n) / s_n
        out["words_a_sentence"] = s_mean
        out["sentence_spread"] = np.sqrt(np.maximum(0, np.bincount(s_doc, s_len**2, n) / s_n - s_mean**2)) / np.maximum(1, s_mean)
    is_letter = letter & (cls_in != 0)
    out["letter_entropy"] = _entropy(np.bincount(doc[is_letter] * BINS + low[is_letter] % BINS, minlength=n * BINS).reshape(n, BINS))
    pair = is_letter & np.append(is_letter[1:], False)
    mixed = (low[:-1] * np.uint32(31) + low[1:]) % np.uint32(4 * BINS)
    pair_at = np.flatnonzero(pair[:-1])
    out["pair_entropy"] = _entropy(np.bincount(doc[pair_at] * 4 * BINS + mixed[pair_at], minlength=n * 4 * BINS).reshape(n, 4 * BINS))
    blank = count(SPACE) >= size
    return {k: (v if k == "n_chars" else np.where(blank, 0.0, v)) for k, v in out.items()}
