"""Token counts by compiled finite-state transducers, without running a tokenizer.

Two deterministic transducers do the work. The first has eight states over character classes and marks where a pre-token
starts. Its transition monoid is compiled to a multiplication table, so a text is cut into chunks, each chunk becomes one
monoid element (the map from entry state to exit state), and a parallel prefix scan of those elements gives each chunk's
entry state. The second transducer reads the bytes of one pre-token; its transitions carry the change in the number of
tokens. A state stands for the part of the word that a later merge may still reach, with the last token of every prefix in
it; states are compiled as words ask for them, and dropped together when there are `MAX_STATES` (but for the one that a word is in), so
memory is bounded however long a word is.

Two tokens may stand next to each other exactly if no merge across their border comes before the merges that built them;
that test replaces the merge loop, and makes the count of a prefix depend on a bounded stretch before its end.

Defined results: null counts as empty text (0 bytes, 0 tokens); repeated rows are each counted; other columns pass through.
Texts are normalised as the vocabulary file states: composed (NFC), white space dropped, lower case; the strings of special tokens inside a text
count as one token each.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MAX_STATES = 80_000
MAX_WORDS = 200_000
#: Characters of one chunk of the boundary transducer.
CHUNK = 128

#: White space of the pre-tokenizer's pattern.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that follow an apostrophe in one pre-token.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Texts of these characters alone are composed already and lower-case one to one.
PLAIN = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]*")


def normalized(text: str) -> str:
    if PLAIN.fullmatch(text):
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Boundaries:
    """Where pre-tokens start: a transducer over classes of characters and its transition monoid.

    States: 0 between tokens, 1 in letters, 2 in other characters, 3 after an apostrophe that starts a token, 4 to 6 after
    that and r, v or l; 7 can't be reached. Outputs: bit 1 a token starts here, bit 2 one started at the previous character.
    """

    SPACE, NUMBER, OTHER, LETTER, APOSTROPHE, ONE, R, V, L, E = range(10)

    def __init__(self):
        kinds = np.full(0x110000, self.OTHER, np.uint8)
        for cp in range(0x110000):
            major = unicodedata.category(chr(cp))[0]
            if major in "LN":
                kinds[cp] = self.LETTER if major == "L" else self.NUMBER
        kinds[SPACES] = self.SPACE
        kinds[ord("'")] = self.APOSTROPHE
        for c, kind in [*((x, self.ONE) for x in ENDINGS if len(x) == 1), ("r", self.R), ("v", self.V), ("l", self.L), ("e", self.E)]:
            kinds[ord(c)] = kind
        self.kinds = kinds
        n_kinds, letters = 10, {self.LETTER, self.ONE, self.R, self.V, self.L, self.E}
        self.next = np.zeros((8, n_kinds), np.uint8)
        self.out = np.zeros((8, n_kinds), np.uint8)

        def plain(kind: int, state: int) -> tuple[int, int]:
            if kind == self.SPACE:
                return 0, 0
            if kind == self.NUMBER:
                return 0, 1
            if kind in letters:
                return 1, int(state != 1)
            if state == 2:
                return 2, 0
            return (3, 1) if kind == self.APOSTROPHE else (2, 1)

        second = {self.R: 4, self.V: 5, self.L: 6}
        for kind in range(n_kinds):
            for state in (0, 1, 2):
                self.next[state, kind], self.out[state, kind] = plain(kind, state)
            if kind == self.ONE:
                self.next[3, kind] = 0
            elif kind in second:
                self.next[3, kind] = second[kind]
            else:
                self.next[3, kind], self.out[3, kind] = plain(kind, 2)
            for state, ends in ((4, self.E), (5, self.E), (6, self.L)):
                if kind == ends:
                    continue  # the ending is complete: state 0, no new token
                self.next[state, kind], out = plain(kind, 1)
                self.out[state, kind] = out | 2
        elements = [tuple(range(8)), *(tuple(map(int, self.next[:, k])) for k in range(n_kinds))]
        elements = list(dict.fromkeys(elements))
        known, at = {m: i for i, m in enumerate(elements)}, 0
        while at < len(elements):
            for k in range(n_kinds):
                new = tuple(int(self.next[s, k]) for s in elements[at])
                if new not in known:
                    known[new] = len(elements)
                    elements.append(new)
            at += 1
        assert len(elements) < 65_536
        self.maps = np.array(elements, np.uint8)
        self.step = np.array([[known[tuple(int(self.next[s, k]) for s in m)] for k in range(n_kinds)] for m in elements], np.uint16)
        self.product = np.array([[known[tuple(b[s] for s in a)] for b in elements] for a in elements], np.uint16)

    def starts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a pre-token starts at each character, and whether the character is white space."""
        n = len(codes)
        width = -(-n // CHUNK)
        kinds = np.zeros(width * CHUNK, np.uint8)
        kinds[:n] = self.kinds[codes]
        lanes = np.ascontiguousarray(kinds.reshape(width, CHUNK).T)
        before = np.empty((CHUNK, width), np.uint16)
        element = np.zeros(width, np.uint16)
        for i in range(CHUNK):  # every chunk's map, in lockstep
            before[i] = element
            element = self.step[element, lanes[i]]
        scan, gap = element.copy(), 1
        while gap < width:  # inclusive prefix products of the chunk maps
            scan[gap:] = self.product[scan[:-gap], scan[gap:]]
            gap *= 2
        entry = np.zeros(width, np.uint8)
        entry[1:] = self.maps[scan[:-1], 0]
        states = self.maps[before, entry[None, :]]
        out = self.out[states, lanes].T.ravel()[:n]
        here = (out & 1).astype(bool)
        here[:-1] |= (out[1:] & 2).astype(bool)
        if n:
            last = int(self.next[states[(n - 1) % CHUNK, -1], lanes[(n - 1) % CHUNK, -1]])
            here[-1] |= last in (4, 5, 6)  # the ending never came
        return here, kinds[:n] == self.SPACE


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible bytes stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words:
    """Tokens of one pre-token: a transducer over bytes, compiled state by state. Symbols 256 to 511 are bytes that end the word."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"] for x in model["added_tokens"]]
        end = model["model"]["end_of_word_suffix"]
        alphabet = _byte_alphabet()

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(end) and token != end
            raw = [alphabet[c] for c in (token[: -len(end)] if last else token)]
            return (*raw[:-1], raw[-1] + 256) if last else tuple(raw)

        self.pair: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * 512
        self.rank: list[int] = [-1] * 512
        ids = {(b,): b for b in range(512)}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = ids[symbols(left)], ids[symbols(right)]
            whole = symbols(left) + symbols(right)
            if whole not in ids:
                ids[whole] = len(self.parts)
                self.parts.append((a, b))
                self.rank.append(rank)
            self.pair.setdefault((a, b), rank)
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for whole, token in ids.items():
            node = 0
            for s in whole:
                key = node << 9 | s
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = token
        self.beside: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.edges: list[dict[int, tuple[int, int]]] = [{}]
        #: A state: for every start that a token may still grow from, its trie node, the last token before it and the tokens before it less those of the whole prefix.
        self.states: list[tuple] = [((0, -1, 0),)]
        self.ids = {self.states[0]: 0}

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the tokenizer leaves the pair apart: follow the border back through the merges that built both sides."""
        if left < 0:
            return True
        known = self.beside.get((left, right))
        if known is None:
            a, b, a_up, b_up = left, right, 1 << 30, 1 << 30  # ranks of the merges that take a and b in
            known = True
            while True:
                rank = self.pair.get((a, b), 1 << 30)
                if rank < a_up and rank <= b_up and rank < 1 << 30:
                    known = False
                    break
                if self.parts[a] is None and self.parts[b] is None:
                    break
                if self.rank[a] >= self.rank[b] and self.parts[a] is not None:
                    a_up, a = self.rank[a], self.parts[a][1]
                else:
                    b_up, b = self.rank[b], self.parts[b][0]
            if len(self.beside) > 400_000:
                self.beside.clear()
            self.beside[left, right] = known
        return known

    def _edge(self, state: int, symbol: int) -> tuple[int, int]:
        last = count = None
        grown = []
        for node, before, tokens in self.states[state]:
            node = self.child.get(node << 9 | symbol)
            if node is None:
                continue
            grown.append((node, before, tokens))
            if last is None and (token := self.token[node]) >= 0 and self.adjacent(before, token):
                last, count = token, tokens + 1
        assert last is not None
        if symbol >= 256:
            new = 0
        else:
            key = (*((node, before, tokens - count) for node, before, tokens in grown), (0, last, 0))
            new = self.ids.get(key)
            if new is None:
                new = self.ids[key] = len(self.states)
                self.states.append(key)
                self.edges.append({})
        self.edges[state][symbol] = new, count
        return new, count

    def _only(self, state: int) -> int:
        """Drop all compiled states but this one, under its new number."""
        live = self.states[state]
        self._clear()
        if live not in self.ids:
            self.ids[live] = len(self.states)
            self.states.append(live)
            self.edges.append({})
        return self.ids[live]

    def count(self, word: bytes) -> int:
        known = self.known.get(word)
        if known is None:
            state = known = 0
            for s in word[:-1]:
                edge = self.edges[state].get(s)
                if edge is None:
                    if len(self.states) >= MAX_STATES:
                        state = self._only(state)
                    edge = self._edge(state, s)
                state, known = edge[0], known + edge[1]
            s = word[-1] + 256
            known += (self.edges[state].get(s) or self._edge(state, s))[1]
            if len(self.known) > MAX_WORDS:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = known
        return known


class PreTokens:
    """The pre-tokens of some normalised texts: which distinct one stands where, and in which text."""

    def __init__(self, plain: list[str], boundaries: Boundaries):
        self.joined = "\n".join(plain)
        codes = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        starts, space = boundaries.starts(codes)
        at = np.flatnonzero(starts)
        gaps = np.flatnonzero(space)
        ends = np.append(at[1:], len(codes))[: len(at)]
        if len(at):
            ends = np.minimum(ends, np.append(gaps, len(codes))[np.searchsorted(gaps, at)])
        values = codes.astype(np.uint64) + np.uint64(1)
        values = values * C.MULT ^ (values << np.uint64(32))
        _, first, self.which = np.unique(C.range_hash(values, at, ends), return_index=True, return_inverse=True)
        self.distinct = [self.joined[s:e] for s, e in zip(at[first].tolist(), ends[first].tolist())]
        self.row = np.repeat(np.arange(len(plain)), [len(x) + 1 for x in plain])[at]


@functools.lru_cache(1)
def boundaries() -> Boundaries:
    return Boundaries()


@functools.lru_cache(1)
def words_of(path: str) -> Words:
    return Words(path)


C.keeps("token_count", words_of.cache_clear)


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    words = words_of(path)
    special = re.compile("|".join(map(re.escape, words.special)) or "(?!)")
    extra, plain = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        parts = special.split(text)
        extra[i] = len(parts) - 1
        plain.append(" ".join(map(normalized, parts)))
    found = PreTokens(plain, boundaries())
    each = np.fromiter(map(words.count, map(str.encode, found.distinct)), np.int64, len(found.distinct))
    return extra + np.bincount(found.row, weights=each[found.which], minlength=len(plain)).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of text_col; a column of out_col's name is replaced.

    vocabulary: path of a byte-level BPE file in the JSON form, present on every executor.
    """
    docs = docs.drop(out_col)
    columns = docs.columns
    at = columns.index(text_col)

    def count(batches):
        C.enter("token_count")
        for batch in batches:
            column = batch.column(at)
            data, offs = C.text_buffer(column)
            counts = [count_texts([x or "" for x in column.slice(lo, hi - lo).to_pylist()], vocabulary) for lo, hi in C.slices(offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=[*columns, out_col])
            C.release()

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField(out_col, T.LongType())]))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json"))).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {"op4_token_count": op4_token_count}
ORACLE: dict[str, str] = {}
