"""Packing documents' tokens into sequences of at most so many."""

from __future__ import annotations

import functools
import itertools
import json
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, alone, lower_ascii, portions, saved, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs; all it knows of them is some numbers.
SHARD = 32_768


#: How byte-level vocabularies write each byte: printable ones as themselves, the others, in order, from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(b) for b in PRINTABLE} | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in PRINTABLE)}


#: What a tokenizer file must say for Merges, besides its vocabulary and merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
#: What the vocabulary adds to a word's last character, and the byte that stands for it where tiktoken merges.
SUFFIX, END = "</w>", "\0"
#: Words of printable ASCII and composed Latin letters: the normalizer lower-cases them as Python does and changes nothing else.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]*")
#: SPLIT for plain words without A-Z; before lower-casing, as some letters' lower case lies elsewhere.
PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^ a-zÀ-ÖØ-öø-ɏ0-9]+")
#: Characters of texts whose words are looked up together, and bytes that a remembered word takes besides its own and its ids, about.
TOGETHER, ENTRY = 1 << 20, 133


def read_merges(path: str) -> tuple[dict, list[tuple[str, str]]]:
    """A tokenizer file and its merges, which lie there as pairs or as strings with a space."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    return read, [tuple(x.split(" ") if isinstance(x, str) else x) for x in read["model"].get("merges", [])]


@functools.lru_cache(2)
def mergeable(path: str) -> bool:
    """Whether Merges holds for the file: its form is FORM, each pair makes a token of its own, and merging a token's own
    characters ends in that token. So wherever two tokens that make up a third meet, they are the pair that it comes from."""
    read, pairs = read_merges(path)
    form = {x: read[x] for x in FORM} | {"model": {k: x for k, x in read["model"].items() if k not in ("vocab", "merges")}}
    if form != FORM or len({a + b for a, b in pairs}) < len(pairs) or not {x + y for x in BYTES.values() for y in ("", SUFFIX)} <= read["model"]["vocab"].keys():
        return False
    if any((a + b).endswith(SUFFIX) != (b.endswith(SUFFIX) and b != SUFFIX) for a, b in pairs):  # a suffix spelled out by letters
        return False
    ranks = {x: k for k, x in enumerate(pairs)}
    for a, b in pairs:
        *parts, last = (a + b).removesuffix(SUFFIX)
        parts.append(last + SUFFIX * b.endswith(SUFFIX))
        while len(parts) > 1:
            rank, at = min((ranks.get(x, len(ranks)), k) for k, x in enumerate(itertools.pairwise(parts)))
            if rank == len(ranks):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class Merges:
    """Ids of many plain words without A-Z at once: tiktoken merges by a mergeable() tokenizer file, with END after what the
    file's pattern finds. This costs about a third of the tokenizer's own merging word by word."""

    def __init__(self, path: str):
        import tiktoken

        read, pairs = read_merges(path)
        names = [x + SUFFIX for x in BYTES.values()] + list(BYTES.values()) + [a + b for a, b in pairs]
        codes = {x: bytes([b]) for b, x in BYTES.items()}
        spelled = [b"".join(map(codes.__getitem__, x.removesuffix(SUFFIX))) + END.encode() * x.endswith(SUFFIX) for x in names]
        ranks = {x: k for k, x in enumerate(spelled)}
        self.ids = np.array([read["model"]["vocab"][x] for x in names], "<u4")
        self.space = ranks[b" "]
        self.merge = tiktoken.Encoding("words", pat_str=f"[^{END} ]+{END}| ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian unsigned 32-bit ids of each; the token of the space after a word, which isn't in any, tells where it ends."""
        whole, others = [x for x in words if x.isalpha()], [x for x in words if not x.isalpha()]
        marked = "".join([f"{x}{END} " for x in whole]) + PLAIN_SPLIT.sub(rf"\g<0>{END}", "".join([x + " " for x in others]))
        tokens = np.array(self.merge(marked.lower()), np.int64)
        ends = 4 * np.flatnonzero(tokens == self.space)
        data, starts = self.ids[tokens].tobytes(), [0, *(ends[:-1] + 4).tolist()]
        return {x: data[at:end] for x, at, end in zip(whole + others, starts, ends.tolist(), strict=True)}


class WordEncoder:
    """The ids of whole texts by a tokenizer file that lower-cases, drops white space and never joins words across it;
    so the words between spaces are encoded by themselves and remembered: one by one or, if together, which takes a mergeable()
    file, all plain ones that are new in some texts at once."""

    def __init__(self, path: str, together: bool = False):
        from tokenizers import Tokenizer

        self.merges = Merges(path) if together else None
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.words = Cache(self._word)
        self.marks = {x: self._encode(x) for x in ".,"}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        core = word[:-1]
        if word[-1] in ".," and core[-1:].isalpha() and core[-1] != "\u0130":  # which lower-cases to a letter and a mark
            return self.words[core] + self.marks[word[-1]]
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:  # composed Latin letters: the normalizer lower-cases them, the splitter keeps them together
            spelled = word if word.isascii() else word.lower().encode().decode("latin-1").translate(BYTES)
            return np.array([x.id for x in self.merge(spelled)], "<u4").tobytes()
        return self._encode(word)

    def _new(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that aren't remembered. They are from now on, alone where all would be too much."""
        plain = [x for x in words if PLAIN.fullmatch(x)] if self.merges else []
        found = self.merges.encode(plain) if plain else {}
        size = sum(map(sys.getsizeof, plain)) + sum(map(len, found.values())) + ENTRY * len(plain)
        if size > self.words.room:
            self.words.clear()
        self.words.update(found)
        self.words.room -= size
        return found | {x: self.words[x] for x in words - found.keys()}

    def encode(self, text: str) -> bytes:
        return self.encode_some([text])[0]

    def encode_some(self, some: list[str]) -> list[bytes]:
        """Each text's little-endian unsigned 32-bit ids. Upper-case letters that could hide a special token go to the tokenizer as they are."""
        out = []
        starts = itertools.accumulate(map(len, some), initial=0)
        for _, group in itertools.groupby(zip(starts, some), lambda x: x[0] // TOGETHER):
            cut = [(x, None if "<|" in x else lower_ascii(x).replace("\n", " ").split(" ")) for _, x in group]
            words = [x for _, some_words in cut for x in some_words or ()]
            found = list(map(self.words.get, words))
            missing = [k for k, ids in enumerate(found) if ids is None]
            new = self._new({words[k] for k in missing})
            for k in missing:
                found[k] = new[words[k]]
            at = iter(found)
            out += [self._encode(x) if part is None else b"".join(itertools.islice(at, len(part))) for x, part in cut]
        return out


@functools.lru_cache(2)
def word_encoder(path: str, together: bool) -> WordEncoder:
    return WordEncoder(path, together)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Each row's ids and end_id, cut after every capacity ids. A null or empty text is end_id alone; repeated rows and rows without doc_id are documents of their own."""
    end, together = np.array([end_id], "<u4").tobytes(), mergeable(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(path, together)
        alone(own.words)
        for batch in portions(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode_some(texts(batch)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, the longest first: of all gaps that fit and a new bin, the one after which the
    squared numbers of open bins per gap sum to least; full and empty bins don't count, and of equals the smallest gap wins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # of open bins by gap; 0 and capacity stay 0
    stacks: dict[int, list[int]] = defaultdict(list)
    made = 0
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        gaps = np.flatnonzero(count[size:capacity]) + size
        best, gain = capacity, 2 * int(count[capacity - size]) + 1 if size < capacity else 0
        if len(gaps):
            change = 2 * (count[gaps - size] - count[gaps] + 1)
            if gaps[0] == size:
                change[0] = 1 - 2 * count[size]
            k = int(np.argmin(change))
            if change[k] <= gain:
                best = int(gaps[k])
        if best == capacity:
            at, made = made, made + 1
        else:
            at = stacks[best].pop()
            count[best] -= 1
        bins[item], offsets[item] = at, capacity - best
        left = best - size
        if left:
            stacks[left].append(at)
            count[left] += 1
    return bins, offsets


def pack(cut: DataFrame, capacity: int = 4096, shard: int = SHARD) -> DataFrame:
    """pieces with sequence_id and offset. Shards of about shard pieces, dealt by hash, are packed by themselves: each leaves
    at most a few sequences unfilled, out of thousands. Repeated pieces, also of rows without doc_id, each get a place; no
    pieces give no rows; other columns than those of pieces() are left out."""
    cut = saved(cut)
    shards = max(1, -(-cut.count() // shard))

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(x).to_numpy() for x in ("ids_crc32", "piece", "doc_id")])
        table = table.take(pa.array(order))
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), capacity)
        numbers = bins + (table.column("shard")[0].as_py() << 32)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets))

    # Repeated pieces are equal in all columns, so a number of their own deals them out as well.
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")
