"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks. Features of a block are the tags
and names of its ancestors and what its text looks like; the chain has two labels,
main text and other. Weights are fitted to labelled pages by gradient ascent on the
penalised likelihood, and the best labelling is found by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements that begin a block of their own. Fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
# Elements without content, and those whose content is no text. Fixed values.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video".split())
#: Parts of class, id and role values that serve as features.
_NAMES = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "above", "linked", "main")

    def __init__(self, text: str, above: frozenset, linked: int, main: bool):
        self.text, self.above, self.linked, self.main = text, above, linked, main


class BlockReader(HTMLParser):
    """Leaf blocks of one page, in page order; blocks without text are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sets: dict[tuple, frozenset] = {}

    def blocks_of(self, html: str) -> list[Block]:
        self.reset()
        self.stack: list[tuple] = [("", frozenset(), False, False, False)]
        self.parts: list[str] = []
        self.linked, self.begun = 0, False
        self.blocks: list[Block] = []
        self.holder = self.stack[0]
        self.feed(html)
        self.close()
        self.flush()
        return self.blocks

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.holder[1], self.linked, self.holder[4]))
            self.parts, self.linked, self.begun = [], 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        _, above, silent, link, main = self.stack[-1]
        names = (tag, *(v for k, v in attrs if v and k in ("class", "id", "role"))) if attrs else (tag,)
        key = (above, names)
        inside = self.sets.get(key)
        if inside is None:
            tokens = {t for name in names[1:] for t in _NAMES.findall(name.lower())}
            inside = self.sets[key] = above | {"<" + tag} | tokens
        if len(self.sets) > 100_000:
            self.sets.clear()
        main = main or any(k == "data-main" for k, _ in attrs)
        self.stack.append((tag, inside, silent or tag in SILENT_TAGS, link or tag == "a", main))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top[2]:
            return
        if not self.begun:
            # The block belongs where its first text stands.
            self.holder, self.begun = top, not data.isspace()
        self.parts.append(data)
        if top[3]:
            self.linked += len(data)


def text_features(block: Block, place: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    out = [
        "bias",
        "words" + str(min(words.bit_length(), 8)),
        "ends." if text[-1] in ".!?:;\"'" else "ends",
        "linked" + str(4 * min(block.linked, len(text)) // len(text)),
    ]
    if "©" in text:
        out.append("copyright")
    if place == 0:
        out.append("first")
    return out


class BlockLabeller:
    """Chain with labels 0 (other) and 1 (main text)."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self.known: dict[frozenset, tuple[float, float]] = {}

    def scores(self, block: Block, place: int) -> tuple[float, float]:
        above = self.known.get(block.above)
        if above is None:
            found = [self.weights[f] for f in block.above if f in self.weights]
            above = self.known[block.above] = (sum(w[0] for w in found), sum(w[1] for w in found))
        zero, one = above
        for feature in text_features(block, place):
            pair = self.weights.get(feature)
            if pair:
                zero += pair[0]
                one += pair[1]
        return zero, one

    def decode(self, blocks: list[Block]) -> list[int]:
        """Most likely labels; of equals label 0 is taken."""
        (a, b), (c, d) = self.moves
        zero = one = 0.0
        back = []
        for place, block in enumerate(blocks):
            to_zero, to_one = self.scores(block, place)
            if place == 0:
                zero, one = to_zero, to_one
                continue
            back.append((one + c > zero + a, one + d > zero + b))
            zero, one = max(zero + a, one + c) + to_zero, max(zero + b, one + d) + to_one
        labels = [int(one > zero)] if blocks else []
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def fitted(pages: list[str], rounds: int = 300, penalty: float = 0.02, rate: float = 0.3) -> BlockLabeller:
    """Fit the chain to labelled pages; deterministic, and small enough for the driver."""
    reader = BlockReader()
    names: dict[str, int] = {}
    chains = []
    for page in pages:
        blocks = reader.blocks_of(page)
        rows = [[names.setdefault(f, len(names)) for f in (*sorted(b.above), *text_features(b, i))] for i, b in enumerate(blocks)]
        if rows:
            chains.append((rows, np.array([int(b.main) for b in blocks])))
    if not chains:
        return BlockLabeller({}, [[0.0, 0.0], [0.0, 0.0]])
    # All pages side by side, padded to the longest one.
    size, longest = len(names), max(len(rows) for rows, _ in chains)
    real = np.arange(longest) < np.array([len(rows) for rows, _ in chains])[:, None]
    x = np.zeros((int(real.sum()), size))
    for i, row in enumerate(row for rows, _ in chains for row in rows):
        x[i, row] = 1
    truth = np.zeros((*real.shape, 2))
    truth[real] = np.eye(2)[np.concatenate([labels for _, labels in chains])]
    met = np.einsum("pti,ptj->ij", truth[:, :-1], truth[:, 1:])
    weights, moves = np.zeros((size, 2)), np.zeros((2, 2))
    sums_w, sums_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    score, ahead, behind = (np.zeros_like(truth) for _ in range(3))
    for _ in range(rounds):
        score[real] = x @ weights
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1)
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)[:, None]
        seen = np.exp(ahead + behind - total[..., None])
        pairs = np.exp(ahead[:, :-1, :, None] + moves + (score + behind)[:, 1:, None, :] - total[..., None, None])
        grad_w = x.T @ (truth - seen)[real] - penalty * weights
        grad_m = met - pairs[real[:, 1:]].sum(axis=0) - penalty * moves
        sums_w += grad_w**2
        sums_m += grad_m**2
        weights = weights + rate * grad_w / np.sqrt(sums_w)
        moves = moves + rate * grad_m / np.sqrt(sums_m)
    table = {name: (float(weights[i, 0]), float(weights[i, 1])) for name, i in names.items()}
    return BlockLabeller(table, moves.tolist())


def main_text(pages: DataFrame, labelled: list[str] | None = None, html_column: str = "html") -> DataFrame:
    """Rows of ``pages`` without the html, with (text, n_chars).

    The text is the main blocks in page order, one to a line; it is empty if there is none,
    as for null and empty pages. Repeated rows are read each. A column of ``pages`` named
    text or n_chars is overwritten. No shuffle: the fitted weights, whose number is bounded by
    the labelled pages, go along with the tasks.
    """
    from rasterledger.llm.training_pages import labelled_pages

    model = fitted(labelled_pages() if labelled is None else labelled)
    weights, moves = model.weights, model.moves
    others = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, labeller = BlockReader(), BlockLabeller(weights, moves)
        for batch in batches:
            texts = []
            for html in batch.column(html_column):
                blocks = reader.blocks_of(html.as_py() or "")
                labels = labeller.decode(blocks)
                texts.append("\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label))
            arrays = [batch.column(c) for c in others] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "text", "n_chars"])

    rows = pages.select(*others, html_column)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, (schema + ", " if schema else "") + "text string, n_chars long")
