"""Token counts that follow edits: a segment tree of pre-token counts per document.

A byte-level BPE counts each pre-token by itself, so a text's count is a sum over its pre-tokens. Leaves are runs of LEAF
pre-tokens with their length in code points and their tokens; each level above sums FAN nodes. An edit re-encodes from the leaf
that holds the last pre-token it could touch, a few code points of context before it, up to the first pre-token boundary
after it that the old text has too: a match of the pattern depends only on what follows its start, so from there on old and
new pre-tokens are the same. Changed leaves grow to twice LEAF before leaves are added, and only sums on their paths are worked out
again. Many edits of one text are one pass over it. A tree is stored as its pre-tokens' lengths and
tokens, cut into leaves; edited() loads stored trees, encodes nothing but what edits touch, and can give the edited ones for the next round.

The vocabulary file is a parameter, read by each worker from the place given; counts of pre-tokens are kept in a bounded cache.
Documents are independent, so it is one narrow pass; table-level edits are grouped by document first.

Cases: null and empty texts have no tokens and a tree of one empty node; edits beyond the text are cut to it; edits are applied in the order
given, each to the text its predecessors left; a very long text is one row's work, in memory of a few times its size; edits at one place
take effect in their order; repeated rows are counted alike; an empty table gives an empty result; further
columns are left out; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import match_starts
from rasterloom.llm.lm_scoring import planed, unplaned

#: Where workers find the vocabulary file unless told otherwise.
VOCABULARY = os.environ.get("RASTERLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The public pre-token pattern of this vocabulary: a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points beyond its end that a match may depend on: two of a contraction's, one that a white-space run looks ahead.
AHEAD = 3
LEAF, FAN, CACHE = 32, 16, 1 << 18
#: Rows given back at once, as trees are larger than their texts.
ROWS = 1000
EDITS = "array<struct<start:int,stop:int,text:string>>"


def counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """Tokens of a pre-token, remembered up to a bound."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, int] = {}

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            n = len(encode(piece))
            if len(piece) <= 64:
                if len(known) >= CACHE:
                    known.clear()
                known[piece] = n
        return n

    return count


def batches(edits: list[tuple[int, int, str]], length: int) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of edits that can be put in at once, each in ascending order and in the places of the text before its run.

    Edits are (start, stop, text), each in the places of the text that its predecessors left; length is that of the text before all."""
    run: list[tuple[int, int, str]] = []
    order, shift, now = 0, 0, length  # 1: ascending, -1: descending; what the run has moved places behind it by; the text's length
    for start, stop, text in edits:
        start = max(0, min(start, now))
        stop = max(start, min(stop, now))
        if run and order >= 0 and start - shift >= run[-1][1]:  # behind what the last one put in
            order, place = 1, (start - shift, stop - shift, text)
        elif run and order <= 0 and stop <= run[-1][0]:
            order, place = -1, (start, stop, text)
        else:
            if run:
                yield run[::-1] if order < 0 else run
            run, order, shift, place = [], 0, 0, (start, stop, text)
        run.append(place)
        shift += len(text) - (stop - start)
        now += len(text) - (stop - start)
    if run:
        yield run[::-1] if order < 0 else run


class Tree:
    """Pre-tokens of a text in leaves, with sums of (code points, pre-tokens, tokens) on each level up to the root."""

    def __init__(self, text: str, count: Callable[[str], int], find: Callable) -> None:
        self.text, self.count, self.find = text, count, find
        self.encoded = len(text)
        pieces = find.findall(text)
        lengths, tokens = list(map(len, pieces)), list(map(count, pieces))
        self.leaves = [(lengths[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, max(1, len(lengths)), LEAF)]
        self._build()

    def _build(self) -> None:
        """All sums, from the leaves."""
        self.levels: list[list[tuple[int, int, int]]] = [[(sum(a), len(a), sum(b)) for a, b in self.leaves]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([tuple(map(sum, zip(*below[i : i + FAN], strict=True))) for i in range(0, len(below), FAN)])

    def _rise(self, changed: set[int]) -> None:
        """Sums anew what stands over the changed leaves, and nothing else."""
        for i in changed:
            a, b = self.leaves[i]
            self.levels[0][i] = (sum(a), len(a), sum(b))
        for low, high in zip(self.levels, self.levels[1:], strict=False):
            changed = {i // FAN for i in changed}
            for i in changed:
                high[i] = tuple(map(sum, zip(*low[i * FAN : (i + 1) * FAN], strict=True)))

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][2]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, from the root down, and where it begins."""
        node, start = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= FAN
            while node + 1 < len(level) and place >= start + level[node][0]:
                start += level[node][0]
                node += 1
                if node % FAN == 0:
                    break
        return node, start

    def edit(self, start: int, stop: int, text: str) -> None:
        """Puts text in place of what stands from start to stop."""
        self.apply([(start, stop, text)])

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts edits (start, stop, text) in, in the order given, each in the places of the text that its predecessors left."""
        for run in batches(edits, len(self.text)):
            self._put(run)

    def _put(self, edits: list[tuple[int, int, str]]) -> None:
        """Ascending edits that don't overlap, in one pass from left to right: the text is joined once, and each region is encoded anew
        from the leaf that its first edit could touch to the first boundary that the old text has too."""
        parts, at = [], 0
        for start, stop, text in edits:
            parts += (self.text[at:start], text)
            at = stop
        text = "".join([*parts, self.text[at:]])
        regions, k, shift = [], 0, 0
        while k < len(edits):
            low, begin = self._leaf_at(max(0, edits[k][0] - AHEAD))
            lengths, tokens, clear = [], [], -1
            here = first = begin + shift
            leaf, item, place, last = low, 0, begin, len(self.leaves)
            for m in self.find.finditer(text, here):
                here = m.start()
                # edits that the pre-tokens so far have come to; boundaries of old and new text are then shift apart, from clear on
                while k < len(edits) and (clear < 0 or here - shift >= edits[k][0] - AHEAD):
                    clear = edits[k][1]
                    shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                    k += 1
                if here - shift >= clear:
                    old = here - shift
                    while place < old and leaf < len(self.leaves):
                        own = self.leaves[leaf][0]
                        if item == len(own):
                            leaf, item = leaf + 1, 0
                        else:
                            place += own[item]
                            item += 1
                    if place == old and leaf < len(self.leaves):
                        own, counts = self.leaves[leaf]
                        if k == len(edits) or place + sum(own[item:]) <= edits[k][0] - AHEAD:
                            lengths += own[item:]
                            tokens += counts[item:]
                            last = leaf + 1
                            break
                lengths.append(m.end() - here)
                tokens.append(self.count(m.group()))
                here = m.end()
            else:
                # the text ends here, whatever edits are left lie in its last pre-token
                while k < len(edits):
                    shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                    k += 1
            self.encoded += here - first
            regions.append((low, last, lengths, tokens))
        self.text = text
        self._replace(regions)

    def _replace(self, regions: list) -> None:
        """New pre-tokens of leaves low to last, in as many leaves if these hold them, so that only their paths are summed anew."""
        changed, grown, moved = set(), [], False
        for low, last, lengths, tokens in regions:
            n, slots = len(lengths), last - low
            if n > 2 * LEAF * slots:
                slots, moved = -(-n // LEAF), True
            new = [(lengths[i * n // slots : (i + 1) * n // slots], tokens[i * n // slots : (i + 1) * n // slots]) for i in range(slots)]
            grown.append((low, last, new))
            changed.update(range(low, last))
        if not moved:
            for low, last, new in grown:
                self.leaves[low:last] = new
            self._rise(changed)
            return
        leaves, at = [], 0
        for low, last, new in grown:
            leaves += self.leaves[at:low] + new
            at = last
        self.leaves = leaves + self.leaves[at:]
        self._build()

    def packed(self) -> bytes:
        """Three rows of int32, a column for each pre-token: 1 where a leaf begins, its length, its tokens; deflated, and filled up with
        zeros to whole columns' 12 bytes. All sums follow from them."""
        begins = [int(not i) for a, _ in self.leaves for i in range(len(a))]
        raw = zlib.compress(planed(np.array([begins, [n for a, _ in self.leaves for n in a], [n for _, b in self.leaves for n in b]], np.int32).ravel()), 1)
        return raw + bytes(-len(raw) % 12)

    @classmethod
    def load(cls, text: str, packed: bytes, count: Callable[[str], int], find: Callable) -> Tree:
        """The tree that packed() was called of, with its text; nothing is encoded."""
        out = cls.__new__(cls)
        out.text, out.count, out.find, out.encoded = text, count, find, 0
        begins, lengths, tokens = unplaned(zlib.decompressobj().decompress(packed), np.int32).reshape(3, -1)
        at = [*np.flatnonzero(begins).tolist(), len(begins)] if len(begins) else [0, 0]
        lengths, tokens = lengths.tolist(), tokens.tolist()
        out.leaves = [(lengths[a:e], tokens[a:e]) for a, e in zip(at, at[1:], strict=False)]
        out._build()
        return out


def count(docs: DataFrame, edits: Column | None = None, vocabulary: str = VOCABULARY, trees: bool = False) -> DataFrame:
    """Per document: doc_id, n_pre_tokens, n_tokens, n_edits, n_edited_tokens (after the edits), n_encoded (code points that the edits made
    it encode anew), and the edited text and its tree if trees. edits: an array of (start, stop, text) in code points."""
    return _counted(docs, F.lit(None).cast("binary"), edits, vocabulary, trees)


def edited(stored_trees: DataFrame, edits: Column, vocabulary: str = VOCABULARY, trees: bool = False) -> DataFrame:
    """count() of rows with the text and tree that count() or edited() gave with trees; n_pre_tokens and n_tokens are the stored ones."""
    return _counted(stored_trees, F.col("tree"), edits, vocabulary, trees)


def _counted(docs: DataFrame, tree: Column, edits: Column | None, vocabulary: str, trees: bool) -> DataFrame:
    edits = (edits if edits is not None else F.lit(None)).cast(EDITS)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.alias("edits"), tree.alias("tree"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        tokens, find = counter(vocabulary), regex.compile(PATTERN)
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            out = {k: [] for k in ("n_pre_tokens", "n_tokens", "n_edits", "n_edited_tokens", "n_encoded", "text", "tree")}
            for text, own, kept in zip(b.column(1), b.column(2), b.column(3), strict=True):
                text, kept = text.as_py() or "", kept.as_py()
                t = Tree(text, tokens, find) if kept is None else Tree.load(text, kept, tokens, find)
                out["n_pre_tokens"].append(t.levels[-1][0][1])
                out["n_tokens"].append(t.tokens)
                own, t.encoded = own.as_py() or [], 0
                t.apply([(e["start"] or 0, e["stop"] or 0, e["text"] or "") for e in own])
                out["n_edits"].append(len(own))
                out["n_edited_tokens"].append(t.tokens)
                out["n_encoded"].append(t.encoded)
                out["text"].append(t.text if trees else None)
                out["tree"].append(t.packed() if trees else None)
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], ["doc_id", *out])

    got = some.mapInArrow(run, "doc_id long, n_pre_tokens long, n_tokens long, n_edits long, n_edited_tokens long, n_encoded long, text string, tree binary")
    return got if trees else got.drop("text", "tree")


def with_edits(docs: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY, trees: bool = False) -> DataFrame:
    """count() with a table of edits (doc_id, ordinal, start, stop, text), each document's in order of ordinal, start and stop."""
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "start", "stop", F.col("text").alias("put")))).alias("_edits"))
    both = docs.select("doc_id", "text").join(own, "doc_id", "left")
    column = F.transform("_edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["stop"].cast("int").alias("stop"), e["put"].alias("text")))
    return count(both, column, vocabulary, trees)


def unwrapped(text: Column, least: int = 6, mark: str = "<num>") -> Column:
    """Edits that join a text's lines by spaces and put mark in place of each run of least or more digits, the last one first, so
    that places hold."""
    found = match_starts(text, f"[0-9]{{{least},}}|\\r?\\n")
    put = lambda x: F.when(x["m"].startswith("\r") | x["m"].startswith("\n"), " ").otherwise(mark)
    edits = F.transform(found, lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("stop"), put(x).alias("text")))
    return F.reverse(edits).cast(EDITS)
