"""Token counts that follow edits without encoding a document again."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in a leaf when a tree is built; a leaf that grows past four times as many
#: makes the tree be laid out anew.
LEAF = 32
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
#: Characters past a pre-token's end that the split may look at before it ends there.
LOOKAHEAD = 2


class PreTokens:
    """Splits texts by a byte-level BPE's pattern and counts each part's tokens once."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, parts: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for part in set(parts).difference(self.known):
                self.known[part] = len(self.encoding.encode_ordinary(part))
            return list(map(self.known.__getitem__, parts))


class TokenTree:
    """A segment tree over a document's pre-tokens, with sums of characters and tokens.

    Leaves hold runs of pre-tokens.  Node i's children are 2 i and 2 i + 1, and leaves
    are the last half of the arrays.
    """

    def __init__(self, text: str, pre: PreTokens):
        self.pre = pre
        parts = pre.split(text)
        self._lay_out(parts, pre.counts(parts))

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], pre: PreTokens) -> TokenTree:
        """A tree from what was kept of it: nothing is split and nothing encoded."""
        tree = cls.__new__(cls)
        tree.pre = pre
        ends = list(accumulate(chars))
        tree._lay_out([text[end - n : end] for end, n in zip(ends, chars, strict=True)], tokens)
        return tree

    def kept(self) -> tuple[str, list[int], list[int]]:
        """The text, and the length and tokens of each pre-token."""
        return self.text(), [len(p) for leaf in self.parts for p in leaf], [c for leaf in self.counts for c in leaf]

    def _lay_out(self, parts: list[str], counts: list[int]) -> None:
        self.parts = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.half = 1 << (len(self.parts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.half), [0] * (2 * self.half)
        for leaf, (p, c) in enumerate(zip(self.parts, self.counts, strict=True)):
            self.chars[self.half + leaf], self.tokens[self.half + leaf] = sum(map(len, p)), sum(c)
        for node in range(self.half - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_parts(self) -> int:
        return sum(map(len, self.parts))

    def text(self) -> str:
        return "".join(map("".join, self.parts))

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end), and its first character."""
        node, start = 1, 0
        while node < self.half:
            node *= 2
            if char - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.half, start

    def edit(self, start: int, deleted: int, inserted: str) -> int:
        """Replaces ``deleted`` characters from ``start``; returns the pre-tokens split anew.

        A pre-token stays if the split, in deciding its end, saw nothing from ``start`` on.
        Splitting starts after the last such one and stops where it meets an old border
        past the edit, since it looks at nothing before a border.
        """
        start = min(max(start, 0), self.n_chars)
        deleted = min(max(deleted, 0), self.n_chars - start)
        first, origin = self._leaf_at(max(start - LOOKAHEAD - 1, 0))
        if origin > 0 and origin + LOOKAHEAD > start:
            first -= 1
            origin -= self.chars[self.half + first]
        last, _ = self._leaf_at(start + deleted)
        extra = 1
        while True:
            last = min(max(last, first) + extra, len(self.parts) - 1)
            parts = [p for leaf in self.parts[first : last + 1] for p in leaf]
            counts = [c for leaf in self.counts[first : last + 1] for c in leaf]
            borders = [origin, *accumulate(map(len, parts), initial=origin)][1:]
            kept = max(bisect_right(borders, start - LOOKAHEAD) - 1, 0)
            old = "".join(parts[kept:])
            again = borders[kept]
            new = old[: start - again] + inserted + old[start - again + deleted :]
            shift = len(inserted) - deleted
            whole = last == len(self.parts) - 1
            border_set = set(borders)
            made, at, met = [], 0, None
            for match in self.pre.pattern.finditer(new):
                if at >= start - again + len(inserted) and at + again - shift in border_set:
                    met = at + again - shift
                    break
                if not whole and match.end() + LOOKAHEAD > len(new):
                    break
                made.append(match[0])
                at = match.end()
            else:
                if whole:
                    met = borders[-1]
            if met is not None:
                break
            extra *= 2
        after = borders.index(met)
        made_counts = self.pre.counts(made)
        self._replace(first, last, parts[:kept] + made + parts[after:], counts[:kept] + made_counts + counts[after:])
        return len(made)

    def _replace(self, first: int, last: int, parts: list[str], counts: list[int]) -> None:
        leaves = last - first + 1
        share = -(-len(parts) // leaves)
        if share > 4 * LEAF:
            everything = [p for leaf in self.parts[:first] for p in leaf] + parts + [p for leaf in self.parts[last + 1 :] for p in leaf]
            sums = [c for leaf in self.counts[:first] for c in leaf] + counts + [c for leaf in self.counts[last + 1 :] for c in leaf]
            self._lay_out(everything, sums)
            return
        touched = set()
        for i, leaf in enumerate(range(first, last + 1)):
            self.parts[leaf], self.counts[leaf] = parts[i * share : (i + 1) * share], counts[i * share : (i + 1) * share]
            node = self.half + leaf
            self.chars[node], self.tokens[node] = sum(map(len, self.parts[leaf])), sum(self.counts[leaf])
            touched.add(node // 2)
        while touched := touched - {0}:
            for node in touched:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            touched = {node // 2 for node in touched}


def gather_edits(edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, edits): each document's rows of ``edits`` (key, seq, start, deleted, inserted) by seq."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "start", "deleted", "inserted")))
    return edits.groupBy(key).agg(F.transform(ordered, lambda e: F.struct(e["start"].alias("start"), e["deleted"].alias("deleted"), e["inserted"].alias("inserted"))).alias("edits"))


_TREE = "text string, chars array<int>, tokens array<int>"


def _tree_columns(trees: list[TokenTree]) -> list[pa.Array]:
    texts, chars, tokens = zip(*(t.kept() for t in trees), strict=True) if trees else ((), (), ())
    return [pa.array(texts, pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))]


def token_trees(docs: DataFrame, tokenizer_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, chars, tokens): each document's tree as a row to be written and edited later.

    ``chars`` and ``tokens`` are the lengths and counts of the pre-tokens in order; sums
    over them are cheap, splitting and encoding is what a stored row saves.  A null text
    is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(tokenizer_path, pattern)
        for batch in batches:
            trees = [TokenTree(value or "", pre) for value in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *_tree_columns(trees)], ["key", "text", "chars", "tokens"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {_TREE}").withColumnRenamed("key", key)


def edit_trees(trees: DataFrame, edits: DataFrame, tokenizer_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, text, chars, tokens, n_tokens, n_recounted) of the stored ``trees`` after ``edits``.

    ``edits`` (key, seq, start, deleted, inserted) are one row each.  Only the regions
    they touch are split and encoded; documents without edits come back as they are and
    pass no Python.
    """
    kind = trees.schema[key].dataType.simpleString()
    changed = trees.select(F.col(key).alias("key"), "text", "chars", "tokens").join(gather_edits(edits, key).withColumnRenamed(key, "key"), "key", "left")
    n_tokens = F.aggregate("tokens", F.lit(0).cast("long"), lambda total, n: total + n)
    same = changed.where("edits is null").select("key", "text", "chars", "tokens", n_tokens.alias("n_tokens"), F.lit(0).cast("long").alias("n_recounted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(tokenizer_path, pattern)
        for batch in batches:
            rows, recounted = [], []
            for text, chars, tokens, changes in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                tree = TokenTree.stored(text, chars, tokens, pre)
                recounted.append(sum(tree.edit(c["start"] or 0, c["deleted"] or 0, c["inserted"] or "") for c in changes))
                rows.append(tree)
            columns = [*_tree_columns(rows), pa.array([t.n_tokens for t in rows], pa.int64()), pa.array(recounted, pa.int64())]
            yield pa.record_batch([batch.column(0), *columns], ["key", "text", "chars", "tokens", "n_tokens", "n_recounted"])

    edited = changed.where("edits is not null").mapInArrow(run, f"key {kind}, {_TREE}, n_tokens long, n_recounted long")
    return same.unionByName(edited).withColumnRenamed("key", key)


def edited_counts(docs: DataFrame, tokenizer_path: str, pattern: str, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Token counts of every document before and after its ``edits``.

    ``edits`` is an array of structs (start, deleted, inserted), applied in turn, each to
    the text that the ones before it left; places outside the text are moved to its end.
    A null or empty array edits nothing, a null text is empty, and null fields of an edit
    count as 0 or empty.  Result: key, n_chars, n_pretokens and n_tokens as they were,
    n_edits, n_recounted (pre-tokens split anew by edits), and n_chars_edited,
    n_pretokens_edited and n_tokens_edited.  Repeated rows count alike, an empty table
    gives an empty result, and other columns play no part, whatever their names.
    ``pattern`` may not look further than ``LOOKAHEAD`` characters past a pre-token's end.
    Trees are built in passing; ``token_trees`` and ``edit_trees`` keep them between runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokens(tokenizer_path, pattern)
        for batch in batches:
            rows = []
            for value, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = TokenTree(value or "", pre)
                before = tree.n_chars, tree.n_parts, tree.n_tokens
                changes = [c for c in changes or () if c]
                recounted = sum(tree.edit(c["start"] or 0, c["deleted"] or 0, c["inserted"] or "") for c in changes)
                rows.append((*before, len(changes), recounted, tree.n_chars, tree.n_parts, tree.n_tokens))
            columns = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["key", *_COUNTS])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(edits).alias("edits"))
    return source.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} long" for c in _COUNTS)).withColumnRenamed("key", key)


_COUNTS = "n_chars n_pretokens n_tokens n_edits n_recounted n_chars_edited n_pretokens_edited n_tokens_edited".split()
