"""BPE with word ends: a backtracking encoder and an offset-table decoder.

A word is cut by the longest vocabulary entry at each position. One pass of an Aho-Corasick automaton over the
text, read backwards, finds them all: its states are the ends of entries, failure links lead to the next shorter one, so
each letter costs one step. An entry is accepted only if the pair (previous, entry) is stable under the merge list,
otherwise the next shorter prefix is tried and, when none is left, the previous entry is taken back. A position
that turned out dead is marked, so each is left at most once per entry length, and the
result equals the merges in rank order. The decoder copies entries out of one array of bytes by a table of offsets.
All words not met lately go through each step together, as arrays; the ids of the others are gathered from one array.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import kept, map_texts

#: So many words are remembered per worker before all are forgotten, and so many places there are for pairs (a power of two).
CACHED_WORDS, STABLE_PAIRS = 150_000, 1 << 19
#: Parts of a text that take the automaton's steps together.
LANES = 4_096
#: Texts are taken in slices of about so many characters, and ids in slices of so many.
TEXT_SLICE, ID_SLICE = 1 << 20, 1 << 18

#: White space of the vocabulary's patterns (Unicode White_Space; str.split also cuts at 1C-1F).
_SPACE = "\t-\r \x85\xa0  -     　"
_WHITE = regex.compile(f"[{_SPACE}]")
_SPLIT = regex.compile(f"[^{_SPACE}]+")
#: The vocabulary's pattern of pieces, which ``WordBpe.spelled`` follows.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = ""  # stands for the vocabulary's word-end suffix while a word is matched


def _byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of ``pool`` that begin at ``start``, end to end."""
    ends = np.cumsum(size)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


class Table:
    """Byte strings in one array, found by an offset table."""

    def __init__(self, parts: list[bytes]):
        self.blob = np.frombuffer(b"".join([p + b" " for p in parts]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        """The strings with these numbers, a space between each two: copied as one gather."""
        start = self.offsets[ids]
        return _gathered(self.blob, start, self.offsets[ids + 1] - start).tobytes()[:-1]


def _kinds() -> np.ndarray:
    """Of each code point: 1 for letters, 2 for digits, 3 for the line feed, else 0. Code points that this Unicode
    version doesn't know are neither letters nor digits."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for at in range(0, len(out), 1 << 16):
        shape = "".join(["$" if unicodedata.category(c) == "Cn" else c for c in map(chr, range(at, at + (1 << 16)))])
        for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+")):
            for m in regex.finditer(pattern, shape):
                out[at + m.start() : at + m.end()] = kind
    out[ord("\n")] = 3
    return out


class WordBpe:
    """Encoder and decoder of one ``tokenizers`` file of the kind "BPE with a word-end suffix"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if not suffix or spec["decoder"] is not None:
            raise ValueError("expected a vocabulary with a word-end suffix and no decoder")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        own = {t: i for t, i in model["vocab"].items() if t not in self.added}
        short = lambda t: t[: -len(suffix)] + _END if t.endswith(suffix) else t
        id_of = {short(t): i for t, i in own.items()}
        size = max(own.values()) + 1
        # the order in which merges apply (by their results), the two halves of each result, and pairs with their order
        self.rank, self.halves = np.full(size, -1, np.int64), np.zeros((2, size), np.int64)
        pairs = np.zeros(len(model["merges"]), np.int64)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = id_of[short(a)], id_of[short(b)], id_of[short(a + b)]
            if self.rank[whole] >= 0:
                raise ValueError("an entry with two merges is not supported")
            pairs[rank] = left << 20 | right
            self.halves[:, whole] = left, right
            self.rank[whole] = rank
        self.pair_rank = np.argsort(pairs)
        self.pairs = pairs[self.pair_rank]
        self.build_automaton(id_of)
        self.width = np.zeros(size, np.int64)
        self.shorter = np.full(size, -1, np.int64)
        for t, i in id_of.items():
            self.width[i] = len(t)
            self.shorter[i] = next((id_of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in id_of), -1)
        #: Columns of the bytes of words; a line feed (no byte of a word) stands for the word end.
        self.byte_column = self.column[[ord(c) for c in _byte_letters()]]
        self.end_column = self.byte_column[ord("\n")] = self.column[ord(_END)]
        self.kinds = _kinds()
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != _PIECES:
            raise ValueError("an unknown pattern of pieces")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.special_marks = [s[:2] for s in self.added]
        #: Places by a hash of the pair: twice the pair, and one more where it is stable.
        self.stable = np.full(STABLE_PAIRS, -1, np.int64)
        strings = {i: t for t, i in {**model["vocab"], **self.added}.items()}
        last = max(strings)
        #: All entries end to end, each with a space behind it, and where each begins: the decoder's table. Likewise ids.
        self.entries = Table([strings.get(i, "").encode() for i in range(last + 1)])
        self.numbers = Table([str(i).encode() for i in range(last + 1)])
        self.forget()

    def forget(self) -> None:
        """Drops the words met so far: their numbers, the ids of all end to end, and where each word's begin."""
        self.words: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves ``left`` and ``right`` side by side: take both apart, last
        merge first, and see that no merge across the border would have come before those undone."""
        ok, rest, none = np.ones(len(left), bool), np.arange(len(left)), len(self.pairs) + 1
        bound = np.full(len(left), none)
        while len(rest):
            pair = left << 20 | right
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            bad = np.where(self.pairs[at] == pair, self.pair_rank[at], none) < bound
            ok[rest[bad]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~bad & ((a >= 0) | (b >= 0))
            rest, left, right, a, b = rest[on], left[on], right[on], a[on], b[on]
            first = a > b  # at equal place the left part merges first, so a right part undone lets ties through
            bound = np.where(first, a, b + 1)
            left, right = np.where(first, self.halves[1][left], left), np.where(first, right, self.halves[0][right])
        return ok

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised runs without white space, cut as the vocabulary's pattern ``_PIECES`` does: the columns of
        all pieces' bytes, each piece with a word end behind it, and where each word ends."""
        text = "\n".join(words) + "\n"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kinds[points]
        begins = np.ones(len(kind), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        mark = np.flatnonzero(points == ord("'"))
        mark = mark[begins[mark]]  # within a run of signs it is one of them
        if len(mark):
            one, two = points[mark + 1], points[np.minimum(mark + 2, len(points) - 1)]
            size = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
            for a, b in ("re", "ve", "ll"):
                size[(one == ord(a)) & (two == ord(b))] = 2
            mark, size = mark[size > 0], size[size > 0]
            begins[mark + 1], begins[mark + 1 + size] = False, True
        inner = np.flatnonzero(begins[1:] & (kind[1:] != 3) & (kind[:-1] != 3)) + 1
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) > len(points):
            inner = np.flatnonzero(raw & 0xC0 != 0x80)[inner]
        last = np.flatnonzero(raw == ord("\n"))
        return np.insert(self.byte_column[raw], inner, self.end_column), last + np.searchsorted(inner, last) + 1

    def longest(self, whole: np.ndarray) -> np.ndarray:
        """The longest entry that starts at each place, or -1: the automaton's one pass, from the last letter on.

        The letters (columns) are cut into lanes that take their steps together. A state is settled by as many letters as the
        longest entry has, so each lane begins that many before its own part."""
        n = len(whole)
        warm = self.depth - 1
        width = max(-(-n // LANES), 4 * warm)
        lanes = -(-n // width)
        code = np.full(warm + lanes * width, self.other, np.int32)  # letters of no entry lead back to the root
        code[warm : warm + n] = whole[::-1]
        steps = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(code, warm + width)[::width].T)
        state = np.zeros(lanes, np.int32)
        found = np.empty((width, lanes), np.int32)
        flat = self.next.ravel()
        for step in range(warm + width):
            state = flat.take(self.row.take(state) + steps[step])
            if step >= warm:
                found[step - warm] = state
        out = np.full(n + 1, -1, np.int64)
        out[:n] = self.entry_at[found.T.ravel()[:n][::-1]]
        return out

    def build_automaton(self, id_of: dict[str, int]) -> None:
        """Over the entries read backwards: the next state for (row of a state, letter), the row of each state (one
        without goto edges shares the row of its failure link), and the longest entry that ends with each state."""
        names = sorted({c for t in id_of for c in t})
        self.other = len(names)
        self.column = np.full(max(map(ord, names)) + 1, self.other, np.int32)
        self.column[[ord(c) for c in names]] = np.arange(len(names))
        states: dict[str, int] = {"": 0}
        accepts, edges = [-1], []  # by rising depth: shorter ends of an entry come first
        for t in sorted(id_of, key=len):
            for k in range(1, len(t) + 1):
                if t[-k:] not in states:
                    states[t[-k:]] = len(accepts)
                    accepts.append(-1)
                    edges.append((k, states[t[len(t) - k + 1 :]], self.column[ord(t[-k])], states[t[-k:]]))
            accepts[states[t]] = id_of[t]
        depth, parent, letter, child = np.array(edges, np.int64).T
        self.depth = int(depth.max())
        self.entry_at = np.array(accepts, np.int64)
        inner = np.unique(parent)
        self.row = np.zeros(len(accepts), np.int32)
        self.row[inner] = np.arange(len(inner))
        self.next = np.zeros((len(inner), self.other + 1), np.int32)
        has_row = np.zeros(len(accepts), bool)
        has_row[inner] = True
        link = np.zeros(len(accepts), np.int32)
        for d in range(1, self.depth + 1):  # rows of all shorter states are complete
            at = depth == d
            up, by, to = parent[at], letter[at], child[at]
            if d > 1:
                link[to] = self.next[self.row[link[up]], by]
            none = self.entry_at[to] < 0
            self.entry_at[to[none]] = self.entry_at[link[to[none]]]
            if d == 1:
                self.next[0, by] = to
            own = to[has_row[to]]
            self.next[self.row[own]] = self.next[self.row[link[own]]]
            leaf = to[~has_row[to]]
            self.row[leaf] = self.row[link[leaf]]
            below = depth == d + 1
            self.next[self.row[parent[below]], letter[below]] = child[below]
        self.row *= self.next.shape[1]  # places in the flat table

    def backtrack(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in ``whole`` (columns, each piece closed by the word end), end to end, and where each id's entry starts.

        All pieces take one step at a time together: try the entry in hand; if it doesn't fit behind
        the previous entry, or ends where all ways on have failed, try its next shorter prefix;
        without one, mark the place as failed and take the previous entry back in hand."""
        longest = self.longest(whole)
        ends = np.flatnonzero(whole == self.end_column) + 1
        first = np.concatenate([[0], ends[:-1]])
        alive = np.ones(len(whole) + 1, bool)
        chosen = np.full(len(whole) + 1, -1, np.int64)  # the entry that starts here, if taken
        before = np.full(len(whole) + 1, -1, np.int64)  # where the entry before this place starts
        at, hand, row = first.copy(), longest[first], np.arange(len(ends))
        while len(row):
            none = hand < 0
            if none.any():
                back = before[at[none]]
                alive[at[none]] = False
                at[none] = back
                # the entry taken back was accepted before; its end has now failed
                hand[none] = self.shorter[chosen[back]]
                continue
            end = at + self.width[hand]
            last = np.where(before[at] >= 0, chosen[before[at]], -1)
            good = alive[end]
            asked = good & (last >= 0)
            good[asked] = self.fit(last[asked], hand[asked])
            here = at[good]
            chosen[here], before[end[good]] = hand[good], here
            at, hand = np.where(good, end, at), np.where(good, longest[end], self.shorter[hand])
            on = at < ends[row]
            if not on.all():
                at, hand, row = at[on], hand[on], row[on]
        # follow the way back from each end, all texts together
        kept = np.zeros(len(whole) + 1, bool)
        at, low = ends, first
        while len(at):
            at = before[at]
            kept[at] = True
            more = at > low
            at, low = at[more], low[more]
        places = np.flatnonzero(kept)
        return chosen[places].astype("<u4"), places

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pair table, filled as pairs turn up; a pair takes the place of an earlier one with the same hash."""
        pair = left << 20 | right
        at = (pair * 0x9E3779B1 >> 15) & (len(self.stable) - 1)
        held = self.stable[at]
        new = np.flatnonzero(held >> 1 != pair)
        if len(new):
            asked, back = np.unique(pair[new], return_inverse=True)
            held[new] = (asked << 1 | self.fits(asked >> 20, asked & (1 << 20) - 1))[back]
            self.stable[at[new]] = held[new]
        return (held & 1).astype(bool)

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that aren't remembered, all in one go."""
        new = list(words)
        if not new:
            return
        whole, ends = self.spelled(new)
        ids, places = self.backtrack(whole)
        at = len(self.words)
        self.words.update(zip(new, range(at, at + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.searchsorted(places, ends)])
        self.ids = np.concatenate([self.ids, ids])

    def split(self, text: str) -> list[str]:
        """The normal form (composed, lower case letter by letter: no final sigma), cut at white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])
        return _SPLIT.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def slices(self, text: str | None) -> Iterator[tuple[int, str]]:
        """Slices of a text that end at white space or a special entry; the id of the latter, or -1."""
        special = self.special is not None and text and any(m in text for m in self.special_marks)
        for part in (self.special.split(text) if special else [text or ""]):
            if part in self.added:
                yield self.added[part], ""
                continue
            at = 0
            while at < len(part):
                end = at + TEXT_SLICE
                if end < len(part):
                    cut = _WHITE.search(part, end)
                    end = cut.start() if cut else len(part)
                yield -1, part[at:end]
                at = end

    def encoded(self, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
        """(place of the text, little-endian 32-bit ids) for each slice of each text, in order."""
        held: list[tuple[int, int, list[str]]] = []
        size = 0

        def flush() -> Iterator[tuple[int, bytes]]:
            if len(self.words) > CACHED_WORDS:
                self.forget()
            words = list(chain.from_iterable([x for _, _, x in held]))
            self.learn(set(words).difference(self.words))
            word = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            counts = self.starts[word + 1] - self.starts[word]
            ids = _gathered(self.ids, self.starts[word], counts)
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(x) for _, _, x in held])]
            low = 0
            for (k, special, _), high in zip(held, ends.tolist(), strict=True):
                yield k, np.array([special], "<u4").tobytes() if special >= 0 else ids[low:high].tobytes()
                low = high
            held.clear()

        for k, text in enumerate(texts):
            for special, part in self.slices(text):
                held.append((k, special, self.split(part)))
                size += len(part)
                if size >= TEXT_SLICE:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out: list[list[bytes]] = [[] for _ in texts]
        for k, raw in self.encoded(texts):
            out[k].append(raw)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        return self.entries.joined(np.asarray(ids, np.int64)).decode()


_loaded: dict[str, WordBpe] = {}
kept["bpe"] = _loaded.clear


def load(path: str) -> WordBpe:
    """The vocabulary at ``path``, once per worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def text_or_empty(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, and the digests of ids and of the decoded text.

    Null text counts as empty (no ids, digests of the empty string); repeated rows give repeated
    results; null keys pass through; other columns are not read. No shuffle: each task streams its
    own rows, memory is bounded by the slices and the remembered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = text_or_empty(batch)
            counts = [0] * len(texts)
            id_sums, text_sums = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            for k, raw in bpe.encoded(texts):
                for at in range(0, len(raw), 4 * ID_SLICE):
                    some = np.frombuffer(raw[at : at + 4 * ID_SLICE], "<u4").astype(np.int64)
                    gap = b" " if counts[k] else b""
                    id_sums[k].update(gap + bpe.numbers.joined(some))
                    text_sums[k].update(gap + bpe.entries.joined(some))
                    counts[k] += len(some)
            id_hex, text_hex = [x.hexdigest() for x in id_sums], [x.hexdigest() for x in text_sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    some = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(some, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe")


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and its ids, as ``array<int>``.

    Null text counts as empty and has no ids; null and repeated keys pass through; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [np.frombuffer(raw, "<i4") for raw in bpe.encode_all(text_or_empty(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    some = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(some, run, "doc_id long, ids array<int>", "bpe")


def detokenize(ids: DataFrame, path: str) -> DataFrame:
    """The decoded text of ``(doc_id, ids)`` rows; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_texts(ids.select("doc_id", "ids"), run, "doc_id long, text string", "bpe")
