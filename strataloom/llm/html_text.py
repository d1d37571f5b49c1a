"""Main text of web pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.html_training import labelled_pages

# ---------------------------------------------------------------- blocks

#: Content that is never text.
_RAW = "script style noscript template iframe textarea title select"
#: HTML elements that end an open drawing, as parsers of HTML have it.
_LEAVE = (
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var article section main header footer nav aside form"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<svg(?=[\s/>])(?:"[^"]*"|'[^']*'|[^>"'])*+(?<=/)>"""
    rf"""|<svg(?=[\s/>])[^>]*>(?:(?!</svg\s*>|</?(?:{_LEAVE.replace(' ', '|')})(?=[\s/>])).)*+(?:</svg\s*>)?"""
    rf"|<({_RAW.replace(' ', '|')})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"""|<(/?)([a-z][a-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>"""
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul button option label caption".split()
)
#: An opening tag of the key ends an open element of the value.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table body article section div main nav aside footer header form td th".split())
_KEPT_BY_P = frozenset("button option label caption td th li dd dt".split())


@dataclass
class Block:
    """A run of text between two block borders, and what stands around it."""

    text: str
    names: frozenset[str]
    tag: str
    link_chars: int
    label: str
    #: Names of the innermost element that has any, and how far out it is.
    near: tuple[str, ...] = ()
    #: The element round the block's own, by its number in the page.
    around: int = -1


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; white space is folded and blank blocks are left out.

    Unclosed paragraphs, list items and cells end where the next one starts, stray end
    tags are passed over, and inline tags do not part words.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], str]] = []
    numbers: list[int] = []  # of the open elements
    opened = 0
    active: Counter[str] = Counter()
    parts: list[str] = []
    links = link_depth = 0
    said = ""  # the label of the text since the last border

    def close() -> None:
        nonlocal links, said
        text = " ".join("".join(parts).split())
        if text:
            tag = next((t for t, _, _ in reversed(stack) if t in _BLOCK), "")
            named = next(((min(out, 3), names[1:]) for out, (_, names, _) in enumerate(reversed(stack)) if len(names) > 1), (9, ()))
            places = [n for (t, _, _), n in zip(reversed(stack), reversed(numbers), strict=True) if t in _BLOCK]
            near = (f"named {named[0]}", *(f"near {x}" for x in named[1]))
            blocks.append(Block(text, frozenset(active), tag, links, said, near, places[1] if len(places) > 1 else -1))
        parts.clear()
        links, said = 0, ""

    def pop() -> None:
        nonlocal link_depth
        tag, names, _ = stack.pop()
        numbers.pop()
        link_depth -= tag == "a"
        for name in names:
            active[name] -= 1
            if not active[name]:
                del active[name]

    def write(raw: str) -> None:
        nonlocal links, said
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if not said and text.strip():
                said = next((x for _, _, x in reversed(stack) if x), "")
            if link_depth:
                links += len(text.strip())

    at = 0
    for token in _TOKEN.finditer(page):
        write(page[at : token.start()])
        at = token.end()
        tag = token[3] or token[6]
        if not tag:
            continue
        tag, ending, rest = tag.lower(), bool(token[2] or token[5]), token[4] or token[7] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            close()
        if ending:
            if any(t == tag for t, _, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _BLOCK and tag not in _KEPT_BY_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth][0] in _SCOPES:
                    break
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in _ENDS.get(tag, ()):
                while len(stack) > depth:
                    pop()
                break
            if stack[depth][0] in _SCOPES - {"td", "th"}:
                break
        # a slash closes nothing but in formulas; elsewhere it may end an unquoted value
        if tag in _VOID or (rest.endswith("/") and any(t == "math" for t, _, _ in stack)):
            continue
        names, label = ["tag " + tag], ""
        for name, *values in _ATTRIBUTE.findall(rest) if "=" in rest else ():
            value = next(filter(None, values), "")
            if name.lower() == "data-main":
                label = value
            else:
                names += ["name " + x.lower() for x in _NAME.findall(value)]
        stack.append((tag, tuple(names), label))
        numbers.append(opened)
        opened += 1
        active.update(names)
        link_depth += tag == "a"
    write(page[at:])
    close()
    return blocks


# ---------------------------------------------------------------- features


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    mates: dict[int, list[Block]] = {}
    for block in blocks:
        mates.setdefault(block.around, []).append(block)
    group = {n: (min(len(some).bit_length(), 5), min(sum(len(b.text) for b in some).bit_length(), 12), any(b.tag in ("h1", "h2") for b in some)) for n, some in mates.items()}
    for i, block in enumerate(blocks):
        chars = len(block.text)
        several, size, heading = group[block.around]
        words = block.text.count(" ") + 1
        density = block.link_chars / chars
        out.append(
            [
                "any",
                "block " + block.tag,
                *block.names,
                *block.near,
                f"mates {several}",
                f"size {size}",
                "with a heading" if heading else "without a heading",
                f"words {min(words.bit_length(), 8)}",
                f"links {round(4 * min(density, 1))}",
                f"stops {min(sum(block.text.count(c) for c in '.!?'), 4)}",
                "ends as a sentence" if block.text[-1] in ".!?\"')" else "ends otherwise",
                "copyright" if "©" in block.text else "no copyright",
                "first" if i == 0 else "last" if i == len(blocks) - 1 else "between",
            ]
        )
    return out


# ---------------------------------------------------------------- the field


@dataclass
class Field:
    """Weights of a two-state linear chain: state 1 is main text."""

    unary: dict[str, np.ndarray]
    moves: np.ndarray

    def decode(self, features: list[list[str]]) -> np.ndarray:
        """The likeliest states of one page's blocks, by Viterbi."""
        if not features:
            return np.zeros(0, np.int64)
        none = np.zeros(2)
        scores = [sum((self.unary.get(f, none) for f in row), none) for row in features]
        best, back = scores[0], []
        for own in scores[1:]:
            through = best[:, None] + self.moves
            back.append(through.argmax(0))
            best = through.max(0) + own
        states = [int(best.argmax())]
        for choice in reversed(back):
            states.append(int(choice[states[-1]]))
        return np.array(states[::-1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 130, rate: float = 0.15, decay: float = 4e-4) -> Field:
    """Maximises the penalised likelihood of labelled pages by Adam over forward and backward sums."""
    pages = [p for p in pages if p[0]]
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    longest = max(len(rows) for rows, _ in pages)
    x = np.zeros((len(pages), longest, len(names)))
    y = np.zeros((len(pages), longest), np.int64)
    there = np.zeros((len(pages), longest), bool)
    for p, (rows, labels) in enumerate(pages):
        there[p, : len(rows)] = True
        y[p, : len(rows)] = labels
        for t, row in enumerate(rows):
            x[p, t, [names[f] for f in row]] = 1
    flat = x[there]
    goal = np.eye(2)[y]
    pair = there[:, 1:]
    seen_moves = np.einsum("pti,ptj,pt->ij", goal[:, :-1], goal[:, 1:], pair.astype(float))
    seen_unary = flat.T @ goal[there]
    weights, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    held = [[np.zeros_like(w), np.zeros_like(w)] for w in (weights, moves)]
    for step in range(1, steps + 1):
        own = np.zeros((*there.shape, 2))
        own[there] = flat @ weights
        forward, backward = own.copy(), np.zeros_like(own)
        for t in range(1, longest):
            through = _log_sum(forward[:, t - 1, :, None] + moves, 1) + own[:, t]
            forward[:, t] = np.where(there[:, t, None], through, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            through = _log_sum(moves + (own[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(there[:, t + 1, None], through, 0)
        total = _log_sum(forward[:, -1], 1)
        expected = np.exp(forward + backward - total[:, None, None])
        both = np.exp(forward[:, :-1, :, None] + moves + (own[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        grads = (flat.T @ expected[there] - seen_unary, (both * pair[:, :, None, None]).sum((0, 1)) - seen_moves)
        for w, grad, moment in zip((weights, moves), grads, held, strict=True):
            grad = grad / len(flat) + decay * w
            moment[0] = 0.9 * moment[0] + 0.1 * grad
            moment[1] = 0.99 * moment[1] + 0.01 * grad**2
            w -= rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
    return Field({f: weights[i] for f, i in names.items()}, moves)


@lru_cache
def default_field(n_pages: int = 720, seed: int = 3) -> Field:
    """The field trained on the package's labelled pages, once per process."""
    pages = []
    for page in labelled_pages(n_pages, seed):
        blocks = leaf_blocks(page)
        pages.append((block_features(blocks), [int(b.label == "1") for b in blocks]))
    return train(pages)


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    states = field.decode(block_features(blocks))
    return "\n".join(b.text for b, s in zip(blocks, states, strict=True) if s)


def extract_pages(pages: DataFrame, field: Field | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page: its main text, blocks parted by line feeds.

    A null or empty page gives an empty text.  Repeated rows, null keys and urls pass
    through; other columns play no part.  The field is trained on the driver on the
    package's labelled pages unless one is given.
    """
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", field) for p in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["key", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    source = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page"))
    return source.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
