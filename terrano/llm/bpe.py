"""Byte-level BPE: encoding by speculation and verification, and decoding.

Merging by ranks is a sequential rule, but its result is easy to check: a row of tokens is what merging gives
exactly if every token is what its own bytes merge to and every adjacent pair is what the pair's bytes merge
to. So all words of a batch that the worker has not met are laid end to end, and

1. the longest token that begins at every byte is found at once, level by level of a trie (arrays, no loop
   over words); following these from the start of each word *proposes* its tokens,
2. each distinct adjacent pair is *verified*: both tokens are taken apart in falling order of rank, all pairs
   at once, and the pair fails if a merge across the border would have come before those undone so far,
3. only words with a failing pair, or with a token that its own bytes do not merge to, are *merged exactly*
   with a heap.

Words are cut by the vocabulary's own pattern. A text that holds code points which this Python's tables do not
know is cut by the library's own pre-tokenizer, as tables of different years disagree about those alone.
Added tokens of the file are cut out first, as the library does.

Defined cases: a null text counts as empty and has no ids; ids that the vocabulary lacks decode to nothing; null
ids decode to null; bytes that are no UTF-8 are replaced by U+FFFD; repeated rows are encoded each; columns
``ids`` or ``decoded`` of the input are replaced; an empty table gives an empty table. Texts are never cut short,
but a word of more than 65,536 characters is not kept in memory for later batches. Vocabularies with a
normalizer, another pre-tokenizer, or added tokens that take white space along are refused.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from terrano.llm.arrow_map import texts, with_arrow_columns, within_bytes

#: Words and pieces a worker keeps; beyond them, or with one of more than MAX_KEPT_LENGTH characters, it starts anew.
MAX_KEPT = 600_000
MAX_KEPT_LENGTH = 1 << 16
#: White space for Python but not for the pattern.
UNLIKE = "\x1c\x1d\x1e\x1f"
WIDE = re.compile(r"(\s{2,})")
#: Bytes of a word up to which scanning all pairs is quicker than a heap.
SHORT = 64
NEVER = 1 << 40
#: Bytes of text that one pass holds, if no single text is longer.
PASS_BYTES = 1 << 21
_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens by rank: the 256 bytes first, then the merges in order. Everything inside is by rank; ``ids`` maps ranks to ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only byte-level vocabularies without normalizer and prefix space")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.path = path
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        raw = lambda token: bytes(alphabet[c] for c in token)
        names = [c for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.bytes = [bytes([b]) for b in range(256)]
        rank = {c: b for b, c in enumerate(names)}
        left, right = list(range(256)), list(range(256))
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if a + b in rank:
                raise ValueError("two merges give one token")
            rank[a + b] = len(names)
            names.append(a + b)
            left.append(rank[a])
            right.append(rank[b])
            self.bytes.append(raw(a + b))
        self.ids = np.array([vocab[n] for n in names], np.int32)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.pair_of = {(a, b): r for r, (a, b) in enumerate(zip(left[256:], right[256:], strict=True), 256)}
        keys = (self.left[256:] << 32) | self.right[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order + 256
        self._trie()
        self.sound = np.ones(len(names), bool)
        for r in self._levels():  # shorter tokens first, so that both halves are judged
            self.sound[r] = self.sound[self.left[r]] & self.sound[self.right[r]] & self.compatible(self.left[r], self.right[r], r)
        table = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for n, i in vocab.items():
            table[i] = raw(n)
        for s, i in self.special.items():
            table[i] = s.encode()
        self.by_id = np.array(table, object)

    def _levels(self):
        size = np.array([len(b) for b in self.bytes])
        for n in range(2, size.max() + 1):
            if len(at := np.flatnonzero(size == n)):
                yield at

    def _trie(self) -> None:
        """Children as sorted keys (node, byte); nodes in order of key, so a child is found by one search."""
        nodes, ends, step = {b"": 0}, [-1], {}
        for r, b in enumerate(self.bytes):
            for n in range(1, len(b) + 1):
                if (p := b[:n]) not in nodes:
                    nodes[p] = len(ends)
                    ends.append(-1)
                    step[nodes[b[: n - 1]] << 8 | b[n - 1]] = nodes[p]
            ends[nodes[b]] = r
        keys = sorted(step)
        self.step_keys, self.step_to = np.array(keys, np.int64), np.array([step[k] for k in keys], np.int64)
        self.ends = np.array(ends, np.int64)
        self.first = np.array([step[b] for b in range(256)], np.int64)

    def longest(self, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every byte: the longest token that begins there and ends by ``end``, and the place behind it."""
        token, behind = text.astype(np.int64), np.arange(1, len(text) + 1)
        at, node, depth = np.arange(len(text)), self.first[text], 1
        while len(at):
            on = at + depth < end[at]
            at, node = at[on], node[on]
            key = node << 8 | text[at + depth]
            found = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            on = self.step_keys[found] == key
            at, node, depth = at[on], self.step_to[found[on]], depth + 1
            whole = self.ends[node] >= 0
            token[at[whole]], behind[at[whole]] = self.ends[node[whole]], at[whole] + depth
        return token, behind

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of a and b, side by side, leaves exactly a and b.

        The two are taken apart, the later merge first; ``limit`` is the rank from which on a merge across the border would
        have come too late. On equal ranks the left merge comes first.
        """
        out = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        bound = np.full(len(a), NEVER, np.int64) if limit is None else limit.astype(np.int64)
        while len(at):
            key = x << 32 | y
            found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            fails = (self.pair_keys[found] == key) & (self.pair_ranks[found] < bound)
            out[at[fails]] = False
            # what is taken apart next: the side of the later merge, or the other if that is a byte; two bytes are done
            undo_x = (x > y) & (x >= 256)
            undo_y = ~undo_x & (y >= 256)
            undo_x |= ~undo_y & (x >= 256)
            go = ~fails & (undo_x | undo_y)
            bound = np.where(undo_x, x, y + 1)[go]
            x, y, at = np.where(undo_x, self.right[x], x)[go], np.where(undo_y, self.left[y], y)[go], at[go]
        return out

    def merged(self, word: bytes) -> list[int]:
        """The ranks of a word's tokens by exact merging: the lowest rank first, the leftmost of equal ones."""
        token, n = list(word), len(word)
        if n <= SHORT:
            pairs = [self.pair_of.get(p, NEVER) for p in zip(token, token[1:])]
            while pairs and (r := min(pairs)) < NEVER:
                i = pairs.index(r)
                token[i : i + 2] = [r]
                del pairs[i]
                if i:
                    pairs[i - 1] = self.pair_of.get((token[i - 1], r), NEVER)
                if i < len(pairs):
                    pairs[i] = self.pair_of.get((r, token[i + 1]), NEVER)
            return token
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := self.pair_of.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = behind[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = r, -1
            behind[i] = k = behind[j]
            if k < n:
                before[k] = i
                if (s := self.pair_of.get((r, token[k]))) is not None:
                    heapq.heappush(heap, (s, i, r, token[k]))
            if (h := before[i]) >= 0 and (s := self.pair_of.get((token[h], r))) is not None:
                heapq.heappush(heap, (s, h, token[h], r))
        return [t for t in token if t >= 0]

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ranks of all words' tokens end to end, tokens a word, and how many words were merged exactly. Words are not empty."""
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        text = np.frombuffer(b"".join(words), np.uint8)
        word_of = np.repeat(np.arange(len(words)), size)
        token, behind = self.longest(text, ends[word_of])
        starts, p, jump = [], 0, behind.tolist()
        while p < len(jump):  # a word's last token ends where the next word begins
            starts.append(p)
            p = jump[p]
        starts = np.array(starts, np.int64)
        token, word = token[starts], word_of[starts]
        fails = np.zeros(len(words), bool)
        fails[word[~self.sound[token]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(token[inner] << 32 | token[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        fails[word[inner[~good[which]]]] = True
        count = np.bincount(word, minlength=len(words))
        if not fails.any():
            return token, count, 0
        first = np.cumsum(count) - count
        exact = {w: self.merged(words[w]) for w in np.flatnonzero(fails).tolist()}
        count[list(exact)] = [len(x) for x in exact.values()]
        out = np.empty(count.sum(), np.int64)
        at = np.cumsum(count) - count
        keep = ~fails[word]
        out[at[word[keep]] + np.flatnonzero(keep) - first[word[keep]]] = token[keep]
        for w, got in exact.items():
            out[at[w] : at[w] + len(got)] = got
        return out, count, len(exact)


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once per Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Encoder:
    """Encodes batches of texts; keeps the tokens of words and of space-separated pieces it has met."""

    def __init__(self, vocab: Vocabulary, max_kept: int = MAX_KEPT) -> None:
        self.vocab, self.max_kept, self.exact, self.proposed = vocab, max_kept, 0, 0
        self.known, self.library = set(map(chr, range(128))), None
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.foreign: set[str] = set()  # words cut by the library
        self.full = False
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, text: str) -> bool:
        """Whether this Python's tables know every code point and mean the same white space."""
        if any(c in text for c in UNLIKE):
            return False
        if text.isascii():
            return True
        new = set(text) - self.known
        odd = {c for c in new if unicodedata.category(c) == "Cn"}
        self.known |= new - odd
        return not odd

    def _by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocab.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def units(self, text: str) -> list[str]:
        """Stretches of a text whose words do not depend on what stands beside them: at a single space, the next word takes the space along."""
        if not self._plain(text):
            words = self._by_library(text)
            self.foreign.update(words)
            return words
        out: list[str] = []
        parts = WIDE.split(text)
        for i in range(0, len(parts), 2):
            lead = ""
            if i and parts[i]:  # of the white space before a word all but the last is one word, and a last space goes to the next
                out.append(parts[i - 1][:-1])
                lead = parts[i - 1][-1]
                if lead != " ":
                    out.append(lead)
                    lead = ""
            elif i:
                out.append(parts[i - 1])
            first, *rest = parts[i].split(" ")
            if lead or first:
                out.append(lead + first)
            out += [" " + p for p in rest]
        return out

    def _append(self, names: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        at = len(self.start)
        self.slot.update(zip(names, range(at, at + len(names)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slots end to end, and how many each has."""
        count = self.count[slots]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[slots] - ends + count, count) + np.arange(total)], count

    def _learn(self, units: list[str]) -> None:
        """Gives units, and the words they are made of, slots with their tokens."""
        find = self.vocab.words.findall
        words = [[u] if u in self.foreign else find(u) for u in units]
        if new := [w for w in dict.fromkeys(w for x in words for w in x) if w not in self.slot]:
            ranks, count, exact = self.vocab.tokens([w.encode() for w in new])
            self.proposed, self.exact = self.proposed + len(new), self.exact + exact
            self._append(new, self.vocab.ids[ranks], count)
        made = [(u, x) for u, x in zip(units, words, strict=True) if u not in self.slot]
        flat, count = self._gather(np.array([self.slot[w] for _, x in made for w in x], np.int64))
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = ends[np.cumsum([0] + [len(x) for _, x in made])]
        self._append([u for u, _ in made], flat, np.diff(bounds))

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (one more at the end)."""
        if self.full or len(self.slot) > self.max_kept:
            self._clear()
        special, cut = self.vocab.special, self.vocab.special_cut
        if not self.slot:
            self._append([_mark(s) for s in special], np.array(list(special.values()), np.int32), np.ones(len(special), np.int64))
        units, sizes = [], []
        for text in batch:
            n = len(units)
            if cut and any(s in text for s in special):
                for part in cut.split(text):
                    units += [_mark(part)] if part in special else self.units(part)
            else:
                units += self.units(text)
            sizes.append(len(units) - n)
        get = self.slot.get
        slots = [get(u, -1) for u in units]
        if -1 in slots:
            new = list(dict.fromkeys(u for u, s in zip(units, slots, strict=True) if s < 0))
            self._learn(new)
            slots = [self.slot[u] for u in units]
            self.full = max(map(len, new)) > MAX_KEPT_LENGTH
        ids, count = self._gather(np.array(slots, np.int64))
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.cumsum([0, *sizes])]


def _mark(special: str) -> str:
    """The key of an added token: no unit ends in a space behind a visible character."""
    return special + "x "


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``: what the tokenizers library gives without added special tokens, truncation and padding."""
    path = path or vocabulary_path()

    def make():
        encoder = Encoder(vocabulary(path))

        def of(batch: pa.RecordBatch) -> dict:
            parts, sizes = [], []
            for piece in within_bytes(texts(batch.column(text)), PASS_BYTES):
                ids, bounds = encoder.encode([t.decode("utf-8", "replace") for t in piece])
                parts.append(ids)
                sizes.append(np.diff(bounds))
            flat = np.concatenate([np.zeros(0, np.int32), *parts])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
            return {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))}

        return of

    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return with_arrow_columns(docs, schema, make, drop=() if keep_text else (text,), rows=256)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", keep_ids: bool = True) -> DataFrame:
    """``encoded`` with ``decoded``: the text of the ids, special tokens included."""
    path = path or vocabulary_path()

    def make():
        table = vocabulary(path).by_id

        def of(batch: pa.RecordBatch) -> dict:
            column = batch.column(ids)
            out = []
            for row in column:
                if not row.is_valid:
                    out.append(None)
                    continue
                got = row.values.drop_null().to_numpy(zero_copy_only=False)
                out.append(b"".join(table[got[(got >= 0) & (got < len(table))]].tolist()).decode("utf-8", "replace"))
            return {"decoded": out}

        return of

    return with_arrow_columns(encoded, T.StructType([T.StructField("decoded", T.StringType())]), make, drop=() if keep_ids else (ids,), rows=128)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    out = decode(encode(docs.select("doc_id", "text"), path, keep_text=False), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
