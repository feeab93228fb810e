"""Splitting texts into pre-tokens by a deterministic transducer, chunk by chunk.

The pattern of the byte-level BPE vocabularies

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is compiled into a table of a dozen states over a dozen character classes. A
transition tells whether a pre-token begins at the character just read and
whether one began at the character before (the pattern looks ahead by one).

Chunks of a text are read side by side. What a chunk does is a map from the
state before it to the state after it; the maps are composed by a parallel
prefix scan, which gives the state in which each chunk truly begins.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from rasterledger.llm.texts import Texts

#: Characters in one lane of the side-by-side run.
LANE = 256

CLASSES = ("begin", "letter", "number", "other", "blank", "space", "quote", "s t m d", "r", "v", "l", "e")
BEGIN, LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, SHORT, R, V, L, E = range(len(CLASSES))
STATES = ("start", "letters", "numbers", "others", "one blank", "blanks", "one space", "spaces", "quote", "quote r", "quote v", "quote l", "ended")
HERE, BEFORE = 1, 2
#: One past the last code point: stands before each text.
SEPARATOR = 0x110000


def _step(state: str, kind: int) -> tuple[str, int]:
    """Next state, and where pre-tokens begin: HERE and BEFORE are bits."""
    if kind == BEGIN:
        return "start", BEFORE if state.startswith("quote ") else 0
    letter = kind in (LETTER, SHORT, R, V, L, E)
    if state.startswith("quote "):
        if kind == {"quote r": E, "quote v": E, "quote l": L}[state]:
            return "ended", 0
        # It was a lone quote and a word that began with the letter before.
        return ("letters", BEFORE) if letter else _joined("letters", kind, BEFORE)
    if state == "quote":
        if kind == SHORT:
            return "ended", 0
        if kind in (R, V, L):
            return {R: "quote r", V: "quote v", L: "quote l"}[kind], 0
        return _joined("others", kind, 0)
    if state in ("blanks", "spaces") and kind not in (BLANK, SPACE):
        # The last one of a run stands apart; a blank goes with what follows.
        return (_run(kind), BEFORE) if state == "blanks" else (_fresh(kind), BEFORE | HERE)
    if state == "one blank" and kind not in (BLANK, SPACE):
        return _run(kind), 0
    if state in ("one blank", "blanks", "one space", "spaces") and kind in (BLANK, SPACE):
        return ("blanks" if kind == BLANK else "spaces"), 0
    return _joined(state, kind, 0)


def _run(kind: int) -> str:
    """State inside a run of this kind."""
    if kind in (LETTER, SHORT, R, V, L, E):
        return "letters"
    return {NUMBER: "numbers", OTHER: "others", QUOTE: "others"}[kind]


def _fresh(kind: int) -> str:
    """State after the first character of a pre-token."""
    return {BLANK: "one blank", SPACE: "one space", QUOTE: "quote"}.get(kind) or _run(kind)


def _joined(state: str, kind: int, flags: int) -> tuple[str, int]:
    """Go on with a run of letters, numbers or other signs, or begin anew."""
    if kind not in (BLANK, SPACE) and state == _run(kind):
        return state, flags
    return _fresh(kind), flags | HERE


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Next states and flags, by state and class."""
    nexts = np.zeros((len(STATES), len(CLASSES)), np.uint8)
    flags = np.zeros_like(nexts)
    for i, state in enumerate(STATES):
        for kind in range(len(CLASSES)):
            name, flags[i, kind] = _step(state, kind)
            nexts[i, kind] = STATES.index(name)
    return nexts, flags


def character_classes() -> np.ndarray:
    """Class of each code point, and of SEPARATOR."""
    out = np.full(SEPARATOR + 1, OTHER, np.uint8)
    for code in range(SEPARATOR):
        group = unicodedata.category(chr(code))[0]
        if group == "L":
            out[code] = LETTER
        elif group == "N":
            out[code] = NUMBER
    # White space of Unicode. Fixed values.
    out[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[0x20] = BLANK
    out[ord("'")] = QUOTE
    out[[ord(c) for c in "stmd"]] = SHORT
    for letter, kind in (("r", R), ("v", V), ("l", L), ("e", E)):
        out[ord(letter)] = kind
    out[SEPARATOR] = BEGIN
    return out


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: row i becomes map i after map i - 1 after ... after map 0.

    A round composes each map with the one a power of two before it, so the rounds
    grow with the logarithm of the number of chunks.
    """
    maps = maps.copy()
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


class Splitter:
    """Finds where pre-tokens begin; one object should serve a task."""

    def __init__(self) -> None:
        self.classes = character_classes()
        self.nexts, self.flags = compiled()

    def states(self, kinds: np.ndarray) -> np.ndarray:
        """State before each character of the lanes (lanes, LANE), the first lane beginning at "start"."""
        lanes, width = kinds.shape
        table = self.nexts.ravel()
        count = self.nexts.shape[1]
        columns = np.ascontiguousarray(kinds.T)
        path = np.empty((width + 1, lanes), np.uint8)
        path[0] = 0
        for t in range(width):
            path[t + 1] = table[path[t].astype(np.intp) * count + columns[t]]
        # The other first states soon fall in with this path; until then each goes its own way.
        maps = np.repeat(path[-1][:, None], len(STATES), axis=1)
        lane, first = (x.ravel() for x in np.indices((lanes, len(STATES))))
        now = first.astype(np.uint8)
        for t in range(width):
            now = table[now.astype(np.intp) * count + columns[t][lane]]
            apart = now != path[t + 1][lane]
            if not apart.all():
                lane, first, now = lane[apart], first[apart], now[apart]
            if not len(lane):
                break
        maps[lane, first] = now
        begins = np.r_[0, composed(maps)[:-1, 0]].astype(np.uint8)
        lane = np.flatnonzero(begins)
        now = begins[lane]
        for t in range(width):
            if not len(lane):
                break
            path[t, lane] = now
            now = table[now.astype(np.intp) * count + columns[t][lane]]
            apart = now != path[t + 1, lane]
            lane, now = lane[apart], now[apart]
        return np.ascontiguousarray(path[:-1].T)

    def starts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions at which pre-tokens begin, and how many each text has."""
        data, offsets = texts.data, texts.offsets
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # byte position of each character
        begins = np.searchsorted(at, offsets[:-1])
        kinds = np.insert(self.classes[points], begins, BEGIN)
        size = len(kinds)
        lanes = size // LANE + 1  # something stands after the last text, too
        grid = np.full(lanes * LANE, BEGIN, np.uint8)
        grid[:size] = kinds
        before = self.states(grid.reshape(lanes, LANE)).ravel()
        flags = self.flags.ravel()[before.astype(np.intp) * len(CLASSES) + grid]
        first = (flags & HERE).astype(bool)
        first[:-1] |= (flags[1:] & BEFORE).astype(bool)
        found = np.flatnonzero(first[:size])
        # Positions among characters: take out the separators before each.
        places = np.arange(len(begins)) + begins
        counts = np.diff(np.r_[np.searchsorted(found, places), len(found)])
        return at[found - np.repeat(np.arange(1, len(texts) + 1), counts)], counts


class Words:
    """Pre-tokens of some texts: the distinct ones, and which one stands where."""

    def __init__(self, distinct: list[bytes], which: np.ndarray, counts: np.ndarray):
        self.distinct = distinct
        self.which = which
        self.counts = counts


def words_of(texts: Texts, splitter: Splitter) -> Words:
    """Pre-tokens of the texts, told apart by their bytes."""
    starts, counts = splitter.starts(texts)
    if not len(starts):
        return Words([], np.empty(0, np.int64), counts)
    raw = texts.data.tobytes()
    stops = [*starts[1:].tolist(), len(raw)]
    words = [raw[a:b] for a, b in zip(starts.tolist(), stops, strict=True)]
    place = {word: i for i, word in enumerate(dict.fromkeys(words))}
    which = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    return Words(list(place), which, counts)
