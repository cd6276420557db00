"""The operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import saved
from tidemark.llm import bpe, exact_dedup, licenses, line_dedup, near_dup, packing, substring_dedup, token_counts, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPACES = r"[^\x20\x09-\x0D]+"
#: Columns whose names the operators use themselves.
CLASH = ("row", "runs", "whole", "picks", "low", "part", "__own", "__starts", "__whole", "__gone", "own", "kept", "hits", "starts", "n_words", "node", "component", "digest", "keep_id", "bucket", "reason")


def vocabulary(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(n)]


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({x: F.lit("clash") for x in CLASH}).withColumns({"n_chars": F.length("text").cast("long")})


def odd_rows(seed=1):
    """Near and exact copies, shared passages and lines, in random order."""
    rnd = random.Random(seed)
    words = vocabulary(rnd, 400)
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    text = lambda: "\n".join(line(rnd.randint(1, 25)) for _ in range(rnd.randint(1, 8)))
    bases, passage, run = [text() for _ in range(25)], line(60), "\n".join(line(4) for _ in range(3))
    rows = []
    for k in range(140):
        base = rnd.choice(bases)
        kind = k % 7
        if kind == 1:
            parts = base.split(" ")
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
            base = " ".join(parts)
        elif kind == 2:
            base = f"{line(5)} {passage} {line(5)}"
        elif kind == 3:
            base = f"{text()}\n{run}\n{text()}"
        elif kind == 4:
            base = base.upper()
        elif kind == 5:
            base = text()
        rows.append((k * 3 % 1000, base))
    rows += [(5001, None), (5002, ""), (5003, " \n\t\n"), (5004, "one two"), (5005, "One two"), (5006, "ünï 日本語  double  spaces\n\n"), (5007, "x " * 3000), (None, bases[0]), (None, None), (None, "alone"), rows[0]]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, odd_rows()).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for i, x in rows:
        groups[lowered(x)].append(i)
    want = []
    for i, x in rows:
        ids = [j for j in groups[lowered(x)] if j is not None]
        keep = max(ids, default=None)
        want.append((i, keep, len(groups[lowered(x)]), i == keep, hashlib.sha256(lowered(x).encode()).hexdigest()))
    for split in (F.lit(True), F.lit(False), F.coalesce(F.col("doc_id") < 200, F.lit(False))):
        got = exact_dedup.exact_dedup(docs.where(split), docs.where(~split), len(rows)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_perfect_hash_finds_members_alone(n):
    rnd = np.random.default_rng(n)
    words = rnd.integers(0, 1 << 63, (n, 4), dtype=np.int64).astype(np.uint64)
    seeds, slot = exact_dedup.build(words)
    assert sorted(slot) == list(range(n))
    slots = words[np.argsort(slot)]
    assert (exact_dedup.find(words, seeds, slots) == slot).all()
    strangers = rnd.integers(0, 1 << 63, (500, 4), dtype=np.int64).astype(np.uint64)
    assert (exact_dedup.find(strangers, seeds, slots) == -1).all()


def shingles(text):
    words = re.findall(SPACES, lowered(text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    known = [(i, shingles(x)) for i, x in rows]
    parent = {i: i for i, _ in known if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in known:
        for j, b in known:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    sets = {frozenset(a): root(i) for i, a in known if i is not None and a}
    out = []
    for i, a in known:
        component = i if not a else root(i) if i is not None else sets.get(frozenset(a))
        out.append((i, len(a), component, i == component))
    return out


def test_near_duplicates(docs, rows):
    got = near_dup.near_duplicates(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows)))


def test_near_duplicates_in_a_crowd(spark):
    """A large group of near copies, chains whose ends are far apart, and documents that share half of its text."""
    rnd = random.Random(4)
    words = vocabulary(rnd, 900)
    base = [rnd.choice(words) for _ in range(120)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        rows.append((k, " ".join(own)))
    for k in range(40):
        rows.append((1000 + k, " ".join(base[: 60 + k] + [rnd.choice(words) for _ in range(60 - k)])))
    chain = list(base)
    for k in range(30):
        chain[4 * k : 4 * k + 4] = [rnd.choice(words) for _ in range(4)]
        rows.append((2000 + k, " ".join(chain)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


def test_minor_members_of_a_crowd_meet_all_others(spark):
    """The exact way for crowded regions finds what candidates leave out."""
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 100).astype(np.uint64)
    items = [np.unique(np.concatenate([base[k % 7 :], rnd.integers(0, 1 << 63, k % 31).astype(np.uint64)])) for k in range(60)]
    sets = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(items)], "node long, items binary")
    crowds = spark.createDataFrame([(0, 7, k) for k in range(60)], "tree int, prefix long, node long")
    part = lambda k: 0 if k < 30 else 50 if k < 40 else k
    places = spark.createDataFrame([(k, part(k)) for k in range(40)], "node long, component long")
    got = {(r.low, r.high) for r in near_dup.rest_of_crowds(crowds, sets, places, 75).collect()}
    alike = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
    want = {tuple(sorted((part(a), part(b)))) for a in range(60) for b in range(a) if part(a) != part(b) and alike(items[a], items[b])}
    assert want and got == want


def test_regions_do_not_depend_on_portions():
    """Small regions give all pairs, crowds a star for each full label and all their members, however the order is cut."""
    rnd = np.random.default_rng(2)
    prefix = np.sort(np.concatenate([np.repeat(np.arange(40), rnd.integers(1, 9, 40)), np.full(400, 17), np.full(90, 30)]))
    rest = rnd.integers(0, 4, len(prefix))
    node = rnd.permutation(len(prefix))
    order = np.lexsort([node, rest, prefix])
    columns = [np.zeros(len(prefix), np.int32), prefix[order], rest[order], node[order]]
    seen = set()
    for size in (1, 7, 64, 1000):
        own, pairs, crowds = near_dup.Regions(), [], []
        for k in range(0, len(prefix), size):
            x, y = own.walk([c[k : k + size] for c in columns])
            pairs += map(tuple, x.tolist())
            crowds += map(tuple, y.tolist())
        x, y = own.walk([c[:0] for c in columns], over=True)
        seen.add((tuple(sorted(pairs + list(map(tuple, x.tolist())))), tuple(sorted(crowds + list(map(tuple, y.tolist()))))))
    assert len(seen) == 1
    pairs, crowds = seen.pop()
    members = {p: [int(n) for n, q in zip(columns[3], columns[1], strict=True) if q == p] for p in range(40)}
    big = {p for p, x in members.items() if len(x) > near_dup.SMALL} | {0, 39}
    assert sorted(crowds) == sorted((0, p, n) for p in big for n in members[p])
    want = {(min(a, b), max(a, b)) for p, x in members.items() if p not in big for a in x for b in x if a != b}
    label = dict(zip(columns[3].tolist(), columns[2].tolist(), strict=True))
    want |= {(min(a, b), max(a, b)) for p in big for a in members[p] for b in [next(n for n in members[p] if label[n] == label[a])] if a != b}
    assert set(pairs) == want


def test_planted_near_duplicates_are_found(spark):
    """Pairs at and somewhat above the least similarity, alone and in a crowd with a common passage; all by full comparison too."""
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    rows, want = [], []
    for k in range(1500):
        own = [rnd.choice(words) for _ in range(84)]
        other = own[:72 + k % 9] + [rnd.choice(words) for _ in range(12 - k % 9)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want.append(100 * len(a & b) >= 75 * len(a | b))
    passage = [rnd.choice(words) for _ in range(60)]
    for k in range(400):
        own = passage + [rnd.choice(words) for _ in range(30)]
        other = own[:84] + [rnd.choice(words) for _ in range(6)]
        rows += [(10000 + 2 * k, " ".join(own)), (10001 + 2 * k, " ".join(other))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (near_dup.LIKELY, 0.0):
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame, share=share).collect()}
        assert all(got[i] == i for i in got if i % 2 == 0)
        assert [got[2 * k + 1] == 2 * k for k in range(1500)] == want
        assert all(got[10001 + 2 * k] == 10000 + 2 * k for k in range(400))


def covered_words(rows, window):
    kept = {(i, x) for i, x in rows}
    starts = defaultdict(set)
    for i, x in kept:
        words = re.findall(SPACES, x or "")
        for k in range(len(words) - window + 1):
            if i is not None:
                starts[tuple(words[k : k + window])].add(i)
    out = []
    for i, x in rows:
        words, gone = re.findall(SPACES, x or ""), set()
        for k in range(len(words) - window + 1):
            if i is not None and min(starts[tuple(words[k : k + window])]) < i:
                gone |= set(range(k, k + window))
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(docs, rows, window):
    got = substring_dedup.substring_dedup(docs, window).drop("kept_text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, covered_words(rows, window)))


def repeated_lines(rows, run, long=line_dedup.LONG):
    one = sorted({(i, x) for i, x in rows if i is not None}, key=lambda r: r[0])
    seen, gone = {}, defaultdict(set)
    for i, x in one:
        lines = (x or "").split("\n")
        places = [k for k, y in enumerate(lines) if y.strip(line_dedup.SPACE)]
        trimmed = [lines[k].strip(line_dedup.SPACE) for k in places]
        for k in range(len(trimmed) - run + 1):
            if seen.setdefault(tuple(trimmed[k : k + run]), (i, k)) != (i, k):
                gone[i, x] |= {places[k + m] for m in range(run)}
        for k, line in enumerate(trimmed):
            if len(line) >= long and seen.setdefault(line, (i, k)) != (i, k):
                gone[i, x].add(places[k])
    out = []
    for i, x in rows:
        lines = (x or "").split("\n")
        lost = gone.get((i, x), set())
        left = "\n".join(y for k, y in enumerate(lines) if k not in lost)
        out.append((i, sum(bool(y.strip(line_dedup.SPACE)) for y in lines), len(lost), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("run", "long"), [(2, line_dedup.LONG), (2, 10), (3, 1000), (1, 1000)])
def test_line_dedup(docs, rows, run, long):
    got = line_dedup.line_dedup(docs, run, long).drop("kept_text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, repeated_lines(rows, run, long)))


def test_cleaning_keeps_columns(docs, rows):
    for cleaned in (line_dedup.clean(docs), substring_dedup.clean(docs), near_dup.one_of_each(docs)):
        assert cleaned.columns == docs.columns and cleaned.schema == docs.schema
    after = {(r.doc_id, r.text): r.n_chars for r in substring_dedup.clean(docs).collect()}
    assert all(n == (None if x is None else len(x)) for (_, x), n in after.items())
    lost = {i for i, n, gone, _ in covered_words(rows, 50) if gone}
    assert lost and all((i, x) in after for i, x in rows if i not in lost)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    capacity = 256
    packed = packing.pack(packing.pieces(docs, path, capacity), capacity).collect()
    want = []
    for i, x in rows:
        ids = np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in packed)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    gaps: list = []  # first fit, the longest first
    for size in sorted((x[3] for x in want), reverse=True):
        at = next((k for k, gap in enumerate(gaps) if gap >= size), None)
        if at is None:
            gaps.append(capacity - size)
        else:
            gaps[at] -= size
    assert math.ceil(sum(x[3] for x in want) / capacity) <= len(bins) <= len(gaps) + 1


def test_word_ids_equal_the_tokenizers():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    atoms = ["a", "B", "É", "é", "é", "ß", "İ", "Σς", " ", "  ", "\n", "\x85", "　", "\x1c", ".", ",", "...", "'s", "'RE", "12", "日本", "ǆ", "<|endoftext|>", "<|EndOfText|>", "ªµ", "́"]
    for _ in range(3000):
        text = "".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_new_words_are_merged_together_and_equal_the_tokenizers(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.mergeable(path)
    encoder, rnd = packing.WordEncoder(path, True), random.Random(5)
    letters = [*"abcdefghijklmnopqrstuvwxyzETAOIN0123456789.,'$%-_/|<> \n", "'s", "'ll", "'RE", "É", "ß", "ñ", "Œ", "Ǆ", "İ", "ª", "²", "×", "é", "ж", "日", "\t", "\0", "\x85", "\xa0", "\xad"]
    some = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    some += ["", " ", "x", " ".join(f"{x}ing{rnd.choice('.,')}" for x in vocabulary(rnd, 3000)), "ab" * 5000, "<|endoftext|> İ a", *map(chr, range(0x250)), *(f"a{chr(x)}'s" for x in range(0x250))]
    want = [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in some]
    alone, word = [], encoder._word
    encoder.words.make = lambda x: alone.append(x) or word(x)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_some(some)] == want
    assert not any(x and x.isascii() and x.isprintable() for x in alone)  # before: every word that was new
    monkeypatch.setattr(packing, "TOGETHER", 50)
    encoder.words.most = encoder.words.room = 4000  # forgets again and again
    encoder.words.clear()
    assert [np.frombuffer(encoder.encode(x), "<u4").tolist() for x in some] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_some(some)] == want


def test_words_are_merged_together_only_where_tokens_come_of_themselves(tmp_path):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        read = json.load(file)
    bytes_ = [*packing.BYTES.values()]
    names = [*bytes_, *(x + "</w>" for x in bytes_)]

    def written(name, pairs, **change):
        vocabulary = {x: k for k, x in enumerate([*names, *("".join(x.split(" ")) for x in pairs)])}
        (tmp_path / name).write_text(json.dumps(read | change | {"model": read["model"] | {"vocab": vocabulary, "merges": pairs}}), encoding="utf-8")
        return str(tmp_path / name)

    good = written("good.json", ["a b", "ab c</w>", "b c"])
    assert packing.mergeable(good)
    assert packing.WordEncoder(good, True).encode_some(["ABC bcabc, abd"]) == [packing.WordEncoder(good).encode("ABC bcabc, abd")]
    # abc can't come of its own characters, for b and c are merged first: tiktoken would join a and bc to it, the tokenizer doesn't
    assert not packing.mergeable(written("never.json", ["b c</w>", "a b", "ab c</w>"]))
    assert not packing.mergeable(written("spelled.json", ["/ w", "/w >", "< /w>"]))
    assert not packing.mergeable(written("cased.json", ["a b"], normalizer=None))


def tiktoken_encoding():
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows):
    encoding = tiktoken_encoding()
    want = []
    for i, x in rows:
        ids = encoding.encode_ordinary(x or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    got = bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), x or "") for i, x in rows)


def test_bpe_on_odd_texts():
    encoding, own = tiktoken_encoding(), bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(3)
    atoms = ["a", "Bc ", "  ", "\n", "'s", "'re", " the", "12", ".", ",", "é", " ", "'", "\r", "\t", "　", "日", "\x1c", "ß", "!?", "\n\n", "​", "́"]
    for text in ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["x" * 4000, "ab" * 3000, " " * 500]:
        assert own.encode(text) == encoding.encode_ordinary(text)


def test_bpe_of_many_lines_without_spaces():
    encoding, own, rnd = tiktoken_encoding(), bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(4)
    words = [rnd.choice(vocabulary(rnd, 50) + ["日本語", "é.", "12,", "end.", "'s", "!?"]) for _ in range(5000)]
    for text in ("\n".join(words), "\n".join(words) + ".", " " + "\n".join(words) + "\n", "".join(x + rnd.choice(["\n", "\n", "\n\n", "\r\n", "\n\t", "\n\x1c", ".\n"]) for x in words)):
        assert own.encode(text) == encoding.encode_ordinary(text)


def test_token_counts_follow_edits(spark):
    encoding, rnd = tiktoken_encoding(), random.Random(5)
    atoms = ["a", "b ", "  ", "\n", "'s", "'re", " the", "1", ".", "é", " ", "'", "r", "e"]
    make = lambda n: "".join(rnd.choice(atoms) for _ in range(n))
    rows, want = [(1, None, None), (2, "a b", [None]), (3, "", [(0, 5, "new")]), (None, "x", [(None, None, None)])], [(1, 0, 0, ""), (2, 2, 2, "a b"), (3, 0, 1, "new"), (None, 1, 1, "x")]
    for k in range(10, 250):
        text = now = make(rnd.randint(0, 40))
        edits = []
        for _ in range(rnd.randint(0, 4)):
            start = rnd.randint(0, len(now) + 2)
            end, new = start + rnd.randint(-1, 6), make(rnd.randint(0, 4))
            edits.append((start, end, new))
            at = min(start, len(now))
            now = now[:at] + new + now[max(at, min(end, len(now))) :]
        rows.append((k, text, edits))
        want.append((k, len(encoding.encode_ordinary(text)), len(encoding.encode_ordinary(now)), now))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    state = saved(token_counts.build(docs, RANKS, public_tokenizers.PATTERN))
    edits = spark.createDataFrame([(i, e) for i, _, e in rows if i is not None], f"doc_id long, edits {token_counts.EDITS}")
    after = saved(token_counts.follow(state.join(edits, "doc_id", "left"), RANKS, public_tokenizers.PATTERN))
    got = after.collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.n_tokens_edited, r.text)) for r in got)
    anew = token_counts.build(after, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(str((r.doc_id, r.text, r.lengths, r.tokens)) for r in anew) == sorted(str((r.doc_id, r.text, r.lengths, r.tokens)) for r in got)
    again = token_counts.follow(after.withColumn("edits", F.expr("array(named_struct('start', 1L, 'end', 3L, 'new', 'q r'))")), RANKS, public_tokenizers.PATTERN).collect()
    assert all(r.n_tokens_edited == len(encoding.encode_ordinary(r.text)) for r in again)


def test_license_base_phrases(spark):
    texts = ["MIT License; mit-license mit_license. mit\nLICENSE", "the apache license, General  Public\tLicense", "mitt license mit licenses xmit license", "émit license mit licenseé", None, "", "general public license public license"]
    rows = [(k, x) for k, x in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    phrases = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
    want = []
    for i, x in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(x))
        places = [(k, label) for phrase, label in phrases for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want.append((i, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))))
    got = licenses.scan(documents(spark, rows)).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
        ("released under the BSD 3-Clause license", "bsd-3-clause"), ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), ("a plain text under the tree", ""), ("distributed under the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ],
)
def test_license_labels(text, labels):
    assert licenses.scan_text(text)["labels"] == labels


def unfiltered(text):
    return licenses.suppress([(m.start(), m.end(), rule) for rule in licenses.rules() for m in rule.pattern.finditer(text)])


def example(tree, rnd):
    """A text that a parsed pattern may match: one alternative of each choice, white space of several kinds."""
    out = ""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "BRANCH":
            out += example(rnd.choice(value[1]), rnd)
        elif op == "SUBPATTERN":
            out += example(value[-1], rnd)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(example(value[2], rnd) for _ in range(rnd.randint(value[0], min(value[1], value[0] + 1))))
        elif op == "IN":
            kind, of = rnd.choice(value)
            known = {"LITERAL": lambda: chr(of), "RANGE": lambda: chr(rnd.randint(*of)), "CATEGORY": lambda: "x" if "NOT_SPACE" in str(of) else "7" if "DIGIT" in str(of) else "w" if "WORD" in str(of) else rnd.choice([" ", "\n", "\t ", "  "])}
            out += known.get(str(kind), lambda: "-")() if str(value[0][0]) != "NEGATE" else rnd.choice("-\n ")
        elif op == "ANY":
            out += "n"
    return out


def test_license_prefilter_loses_nothing():
    rnd, missed = random.Random(6), []
    known = {"licensed by the mit": "mit", "it may not be copied without leave": "proprietary", "permission is\nhereby\ngranted,  free of charge, to any person obtaining a copy": "mit", "all  advertising\nmaterials mentioning features": "bsd-4-clause", "all rights\nreserved": "proprietary", "in the public\ndomain": "public-domain", "see\nisc": "isc", "neither the name of the\nowner may be used to endorse": "bsd-3-clause", "licensed under the creative\ncommons  zero": "cc0-1.0", " * you may not use this file except\n * in compliance with the license.": "apache-2.0", "# altered source versions must be plainly\n# marked as such, and must not be misrepresented as being the original software": "zlib"}
    for text, label in known.items():
        found = licenses.detect(text)
        assert label in {rule.label for _, _, rule in found} and found == unfiltered(text)
    for rule in licenses.rules():
        tree = re._parser.parse(rule.pattern.pattern)
        texts = [example(tree, rnd) for _ in range(40)]
        assert any(rule.pattern.search(x) for x in texts)
        missed += [(rule.name, x) for x in texts if licenses.detect(x) != unfiltered(x)]
    assert missed == []


def brute_suppress(found):
    """The same by definition: what lies in another goes, then of two that overlap in part with different labels the one of smaller priority stays."""
    def hides(x, y):
        return x is not y and x[0] <= y[0] and y[1] <= x[1] and (x[:2] != y[:2] or x[2].priority < y[2].priority)

    outer = [y for y in found if not any(hides(x, y) for x in found)]
    kept = []
    for y in sorted(outer, key=lambda y: (y[2].priority, y[0])):
        if all(x[1] <= y[0] or y[1] <= x[0] or x[2].label == y[2].label for x in kept):
            kept.append(y)
    return sorted(kept, key=lambda y: y[0])


def test_license_suppression_by_containment_and_priority():
    rule = licenses.rules()
    assert len(rule) > 200 and [x.priority for x in rule] == list(range(len(rule)))
    one = {x.label: x for x in rule}
    first, second, third = sorted([one["mit"], one["isc"], one["zlib"]], key=lambda x: x.priority)
    inside = [(0, 10, third), (2, 8, first), (0, 10, second), (20, 22, first)]
    assert licenses.suppress(inside) == [(0, 10, second), (20, 22, first)]
    chain = [(0, 10, first), (8, 20, second), (18, 30, third)]
    assert licenses.suppress(chain) == [chain[0], chain[2]]
    alike = [(0, 10, first), (8, 20, first)]
    assert licenses.suppress(alike) == alike
    rnd = random.Random(8)
    for _ in range(300):
        spans = {(start, start + rnd.randint(1, 12), rnd.randrange(len(rule))) for start in (rnd.randrange(40) for _ in range(rnd.randrange(14)))}
        found = [(start, end, rule[k]) for start, end, k in sorted(spans)]
        assert licenses.suppress(found) == brute_suppress(found)


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment (the shortest of equals), then look left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            total = sum(scores[a:b])
            if total > 0 and (best is None or total > best[2] or total == best[2] and b - a < best[1] - best[0]):
                best = a, b, total
    if best is None:
        return []
    a, b, total = best
    return brute_segments(scores[:a]) + [best] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_segments_of_a_long_toxic_text_take_linear_time():
    import time

    scores = np.where(np.arange(400_000) % 5 == 0, 1.0, -0.5)
    began = time.time()
    assert len(toxicity.segments(scores)) == 80_000
    assert len(toxicity.segments(-scores[::-1])) > 0
    assert time.time() - began < 5


def test_maximal_segments():
    rnd = random.Random(6)
    for _ in range(300):
        scores = [rnd.choice([-3, -2, -1, -1, 1, 2, 5]) for _ in range(rnd.randint(0, 14))]
        got = [(a, b) for a, b, _ in toxicity.segments(np.array(scores, float))]
        assert sorted(s for *_, s in toxicity.segments(np.array(scores, float))) == sorted(s for *_, s in brute_segments(scores)), scores
        assert all(sum(scores[a:b]) > 0 for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def toxic_rows(seed=8, n=600):
    rnd = random.Random(seed)
    words, bad = vocabulary(rnd, 300), ["vileword", "vilething", "grimly", "grimness"]
    rows, labels = [], []
    for k in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(10, 80))]
        if k % 6 == 0:
            for _ in range(rnd.randint(2, 4)):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 6 == 0)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_rows()
    docs = documents(spark, [*rows, (9001, None), (9002, ""), (None, rows[0][1]), rows[1]]).repartition(3)
    known = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, known.where(~toxicity.held_out())).collect()
    assert len(got) == len(rows) + 4
    scores = {r.doc_id: r.score for r in got}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    wrong = sum((scores[k] >= 0.7) != (k % 6 == 0) for k in held)
    assert wrong <= 0.03 * len(held)
    assert scores[9001] == scores[9002] < 0.5
    assert all(0 <= x <= 1 for x in scores.values())
    left = toxicity.reject(docs, known)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.collect()}
    assert {9001, 9002} <= kept and len({k for k, _ in rows if k % 6} - kept) <= 10 and len(kept & {k for k, _ in rows if k % 6 == 0}) <= 5


def test_toxicity_without_labels(spark):
    docs = documents(spark, toxic_rows()[0][:20])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score(docs, none).collect())


def test_empty_tables(spark):
    empty = documents(spark, [])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    path = public_tokenizers.path("word_bpe_49k.json")
    results = [
        exact_dedup.exact_dedup(empty, empty, 0), near_dup.near_duplicates(empty), near_dup.one_of_each(empty), substring_dedup.substring_dedup(empty), substring_dedup.clean(empty), line_dedup.line_dedup(empty), line_dedup.clean(empty),
        packing.pack(packing.pieces(empty, path)), bpe.digests(empty, RANKS, public_tokenizers.PATTERN), licenses.scan(empty), toxicity.score(empty, none), toxicity.reject(empty, none),
        token_counts.follow(token_counts.build(empty, RANKS, public_tokenizers.PATTERN).withColumn("edits", F.lit(None).cast(token_counts.EDITS)), RANKS, public_tokenizers.PATTERN),
    ]
    for df in results:
        assert df.collect() == []


def test_new_words_are_encoded_together_and_counted_as_alone(monkeypatch):
    own = token_counts.Counter(RANKS, public_tokenizers.PATTERN)
    rnd, letters = random.Random(7), [*"ab1 .,\n'st é$\t  ", "'ll", "\r", "\x1c", "\x85", "²", "́", "😀", "ا"]
    some = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(3000)] + [" ".join(f"w{k}x{rnd.random()}" for k in range(2000)), "", "one", "x" * 5000 + " y"]
    want = [[[len(x), len(own.encode(x))] for x in own.pattern.findall(text)] for text in some]
    calls, encode = [], own.encode
    own.encode = lambda text: calls.append(text) or encode(text)
    own.pieces.clear()
    assert [x.tolist() for x in own.leaves(some)] == want
    assert len(calls) < 2500  # before: one for each of more than 10,000 new words and pre-tokens
    monkeypatch.setattr(token_counts, "TOGETHER", 50)
    own.words.most = own.words.room = 4000  # forgets again and again
    own.words.clear()
    assert [x.tolist() for x in own.leaves(some)] == want
    own.sizes[:] = 2  # no word ends where tokens end by this: each is encoded by itself
    own.words.clear()
    assert [x.tolist() for x in own.leaves(some[:200])] == want[:200]
