"""Token counts that follow edits: only what an edit touches is encoded again."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import read_ranks
from .common import SPACE_BEFORE_SPACE, Cache, alone, portions, texts

#: Characters that a match of the pattern can look at beyond its end.
LOOKAHEAD = 3
#: Bytes of remembered words, about, and those that each takes besides its own; characters of texts whose words are looked up together.
REMEMBERED, ENTRY, TOGETHER = 64 << 20, 150, 1 << 20


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each. A space that a non-space follows always begins a match of
    the pattern when no white space follows a space, so such texts are cut there. The words that are new in some texts are
    encoded all at once, which costs a third of one by one, and remembered."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self.pieces = Cache(lambda piece: len(self.encode(piece)))
        #: Leaves of words that a space comes before, which is counted with them; pairs of little-endian 32-bit numbers.
        self.words = Cache(lambda word: self._pairs(self.pattern.findall(" " + word)), REMEMBERED)
        self.shared: dict[bytes, bytes] = {}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def _pairs(self, found: list[str]) -> bytes:
        return np.array([[len(x), self.pieces[x]] for x in found], "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Remembers them all; where it would remember too much, only them. If a match or a token reaches over a word's end, they
        are left to be encoded one by one."""
        new = [x for x in words if x not in self.words]
        if sum(map(sys.getsizeof, new)) + ENTRY * len(new) > self.words.room:
            self.words.clear()
            self.shared.clear()
            new = list(words)
        if not new:
            return
        text = " " + " ".join(new)
        found = self.pattern.findall(text)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths)
        limits = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        last = np.searchsorted(ends, limits)
        token_ends = np.cumsum(self.sizes[self.encode(text)])
        byte_ends = ends if text.isascii() else np.cumsum(np.fromiter((len(x.encode()) for x in found), np.int64, len(found)))
        upto = np.searchsorted(token_ends, byte_ends)
        if ends[-1] != len(text) or byte_ends[-1] != token_ends[-1] or (ends[last] != limits).any() or (token_ends[upto] != byte_ends).any():
            return
        data = np.stack([lengths, np.diff(upto, prepend=-1)], 1).astype("<u4").tobytes()
        share, at = self.shared.setdefault, 0
        for word, k in zip(new, (8 * (last + 1)).tolist(), strict=True):
            pair = data[at:k]
            self.words[word] = share(pair, pair) if k - at == 8 else pair
            self.words.room -= sys.getsizeof(word) + ENTRY
            at = k

    def leaves(self, some: list[str]) -> list[np.ndarray]:
        """Of each text a row of length and tokens for each pre-token."""
        out, begin = [], 0
        while begin < len(some):
            end, size = begin, 0
            while end < len(some) and (end == begin or size + len(some[end]) <= TOGETHER):
                size += len(some[end])
                end += 1
            out += self._leaves(some[begin:end])
            begin = end
        return out

    def _leaves(self, some: list[str]) -> list[np.ndarray]:
        cut = [[x] if SPACE_BEFORE_SPACE.search(x) else x.split(" ") for x in some]
        self._learn({word for _, *rest in cut for word in rest})
        data = [self._pairs(self.pattern.findall(first)) + b"".join(map(self.words.__getitem__, rest)) for first, *rest in cut]
        return [np.frombuffer(x, "<u4").reshape(-1, 2) for x in data]


@functools.lru_cache(2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Tree:
    """A segment tree over the pre-tokens of a text: each node has its range's characters and tokens. An edit puts all
    pre-tokens of its region into the region's first slot and empties the other slots."""

    def __init__(self, leaves: np.ndarray):
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        level = np.zeros((self.size, 2), np.int64)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        self.nodes = np.concatenate([np.zeros((1, 2), np.int64), *levels[::-1]])
        self.inside: dict[int, list[tuple[int, int]]] = {}

    @property
    def length(self) -> int:
        return int(self.nodes[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.nodes[1, 1])

    def slot(self, at: int) -> tuple[int, int]:
        """The slot that holds the character at that place, and where the slot begins."""
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if at - begin >= self.nodes[k, 0]:
                begin += int(self.nodes[k, 0])
                k += 1
        return k - self.size, begin

    def parts(self, slot: int) -> list[tuple[int, int]]:
        n, tokens = map(int, self.nodes[self.size + slot])
        return self.inside.get(slot, [(n, tokens)] if n else [])

    def leaves(self) -> np.ndarray:
        """A row of length and tokens for each pre-token, as they are now."""
        slots = self.nodes[self.size :]
        if not self.inside:
            return slots[slots[:, 0] > 0]
        out, at = [], 0
        for slot in sorted(self.inside):
            out += [slots[at:slot], np.array(self.inside[slot], np.int64).reshape(-1, 2)]
            at = slot + 1
        every = np.concatenate([*out, slots[at:]])
        return every[every[:, 0] > 0]

    def put(self, slot: int, parts: list[tuple[int, int]]) -> None:
        self.inside[slot] = parts
        k = self.size + slot
        self.nodes[k] = sum(n for n, _ in parts), sum(t for _, t in parts)
        while k > 1:
            k //= 2
            self.nodes[k] = self.nodes[2 * k] + self.nodes[2 * k + 1]


def edit(text: str, tree: Tree, start: int, end: int, new: str, own: Counter) -> str:
    """The text with the characters from start up to end replaced, the tree changed to match. Matching begins anew at a
    pre-token that the edit can't have changed, and stops where a match ends at an old boundary after the edit: what
    follows depends on the text after it alone."""
    start, end = max(0, min(start, len(text))), max(0, min(end, len(text)))
    end = max(start, end)
    out = text[:start] + new + text[end:]
    if not text:
        tree.put(0, [(len(x), own.pieces[x]) for x in own.pattern.findall(out)])
        return out
    slot, begin = tree.slot(max(0, start - LOOKAHEAD - 1))
    shift, settled, made, at = len(out) - len(text), start + len(new), [], begin
    last, last_end = slot, begin  # slots whose old boundaries have been passed
    bounds: dict[int, tuple[int, int]] = {}  # of old boundaries at or after the edit: slot and place within it

    def pass_slots(upto: int) -> None:
        nonlocal last, last_end
        while last_end <= upto and last < tree.size:
            place = last_end
            for k, (n, _) in enumerate(tree.parts(last)):
                bounds[place] = last, k
                place += n
            last_end = place
            last += 1

    while at < len(out):
        old = at - shift
        if at >= settled and old >= end:
            pass_slots(old)
            if old in bounds:
                break
        match = own.pattern.match(out, at)
        made.append((match.end() - at, own.pieces[match[0]]))
        at = match.end()
    else:
        for k in range(slot + 1, tree.size):
            if tree.nodes[tree.size + k, 0]:
                tree.put(k, [])
        tree.put(slot, made)
        return out
    until, within = bounds[at - shift]
    made += tree.parts(until)[within:]
    for k in range(slot + 1, until + 1):
        if tree.nodes[tree.size + k, 0]:
            tree.put(k, [])
    tree.put(slot, made)
    return out


STATE = "doc_id long, text string, lengths array<int>, tokens array<int>"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0), *arrays]).astype(np.int32)))


def build(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The state to keep of each row: doc_id, text, and lengths and tokens of its pre-tokens, the leaves of its tree. A null
    text is an empty one; rows that repeat or lack a doc_id are states of their own; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        alone(own.pieces, own.words)
        for batch in portions(batches):
            found = texts(batch)
            leaves = own.leaves(found)
            columns = [batch.column("doc_id"), pa.array(found, pa.string()), *[_lists([x[:, k] for x in leaves]) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "lengths", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, STATE)


EDITS = "array<struct<start:long,end:long,new:string>>"


def follow(state: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every row of state (of build() or follow(), with edits as EDITS, made one after the other, each in the text that the
    one before left; out of range is cut to the text, nulls count as 0 or empty) after its edits, with n_tokens (before
    them), n_tokens_edited and n_chars_edited. Trees are summed up from the leaves kept; only what edits touch is encoded.
    Null edits are none; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        alone(own.pieces, own.words)
        for batch in portions(batches):
            out: list[list] = [[], [], [], [], [], []]
            kept = []
            for name in ("lengths", "tokens"):
                column = batch.column(name)
                ends = column.offsets.to_numpy()
                values = column.values.to_numpy(zero_copy_only=False)
                kept.append([values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])
            for text, edits, *leaves in zip(texts(batch), batch.column("edits").to_pylist(), *kept, strict=True):
                tree = Tree(np.stack(leaves, 1).astype(np.int64))
                before = tree.tokens
                for x in edits or []:
                    if x is not None:
                        text = edit(text, tree, x["start"] or 0, x["end"] or 0, x["new"] or "", own)
                after = tree.leaves()
                for column, value in zip(out, (text, after[:, 0], after[:, 1], before, tree.tokens, tree.length), strict=True):
                    column.append(value)
            columns = [batch.column("doc_id"), pa.array(out[0], pa.string()), _lists(out[1]), _lists(out[2]), *[pa.array(x, pa.int64()) for x in out[3:]]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "lengths", "tokens", "n_tokens", "n_tokens_edited", "n_chars_edited"])

    return state.select("doc_id", "text", "lengths", "tokens", "edits").mapInArrow(run, f"{STATE}, n_tokens long, n_tokens_edited long, n_chars_edited long")
