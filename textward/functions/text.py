"""Column functions over text: phrase tests, and regular expressions written for RE2."""

from __future__ import annotations

import bisect
import functools
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    import re._parser as _parser

_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


@functools.lru_cache(None)
def java(regex: str) -> str:
    """An RE2 pattern for Spark's engine: only \\n ends a line, $ is the very end, \\b looks at ASCII letters, \\s has no vertical tab."""
    out, i, in_class = [], 0, False
    if regex.startswith("\\b") and first_characters(regex):
        # A word's edge before characters of words: the character first, as that is the cheap test.
        out.append(f"(?=[{''.join(sorted(first_characters(regex)))}])(?<![0-9A-Za-z_])")
        i = 2
    while i < len(regex):
        c = regex[i]
        if c == "\\" and i + 1 < len(regex):
            two = regex[i : i + 2]
            out.append(_EDGE if two == "\\b" and not in_class else ("\\t\\n\\f\\r\\x20" if in_class else "[\\t\\n\\f\\r\\x20]") if two == "\\s" else two)
            i += 2
            continue
        if c == "[" and in_class:
            out.append("\\[")
        elif c == "&" and in_class:
            out.append("\\&")
        elif c == "$" and not in_class:
            out.append("\\z")
        else:
            out.append(c)
        if c == "[" and not in_class:
            in_class = True
            if regex[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if regex[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "]" and in_class:
            in_class = False
        i += 1
    return "(?d)" + "".join(out)


@functools.lru_cache(None)
def required_literal(regex: str) -> str:
    """The longest lower-case string that every match holds ('' if none is sure): a cheap test before the pattern."""
    best, run = "", []

    def walk(items) -> None:
        nonlocal best, run
        for op, arg in items:
            if str(op) == "LITERAL" and arg < 128:
                run.append(chr(arg).lower())
                if len(run) > len(best):
                    best = "".join(run)
                continue
            if str(op) == "SUBPATTERN":
                walk(arg[3])
                continue
            run = []
            if str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                walk(arg[2])
                run = []

    try:
        walk(_parser.parse(regex))
    except re.error:
        return ""
    return best


def _telling(literal: str) -> bool:
    return len(literal) > 1 or bool(literal) and not literal.isalnum() and literal not in " .-_"


@functools.lru_cache(None)
def required_any(regex: str) -> tuple[str, ...]:
    """Lower-case strings of which every match holds at least one (none if that is not sure): the fewest and longest that can be told."""

    def better(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
        return max(a, b, key=lambda x: (bool(x) and all(map(_telling, x)), min(map(len, x), default=0), -len(x)))

    def walk(items) -> tuple[str, ...]:
        best, run = (), ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run += chr(arg).lower()
                best = better(best, (run,))
                continue
            run = ""
            if name == "SUBPATTERN":
                best = better(best, walk(arg[3]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                best = better(best, walk(arg[2]))
            elif name == "BRANCH":
                each = [walk(x) for x in arg[1]]
                if all(each):
                    best = better(best, tuple(dict.fromkeys(x for own in each for x in own)))
        return best

    try:
        found = walk(_parser.parse(regex))
    except re.error:
        return ()
    literal = required_literal(regex)
    found = better(found, (literal,) if literal else ())
    return found if found and all(map(_telling, found)) else ()


def one_pass(literals) -> str:
    """A pattern that is found where one of the strings stands: their common beginnings are tried once, and the next character halves what is left."""
    root: dict = {}
    for literal in literals:
        node = root
        for c in literal:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:
            return ""  # what is longer holds this one
        return halved(sorted(node.items()))

    def halved(parts: list) -> str:
        if len(parts) < 3:
            each = [re.escape(c) + pattern(rest) for c, rest in parts]
            return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"
        half = len(parts) // 2
        return f"(?:(?=[{''.join(re.escape(c) for c, _ in parts[:half])}]){halved(parts[:half])}|{halved(parts[half:])})"

    return pattern(root)


_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")


@functools.lru_cache(None)
def first_characters(regex: str) -> frozenset[str]:
    """The characters with which a match can begin, where that is a set of ASCII letters, digits and underscores; else none."""

    def own(items) -> tuple[set[str] | None, bool]:
        """Beginnings, and whether nothing may be consumed."""
        out: set[str] = set()
        for op, arg in items:
            name = str(op)
            if name == "AT":
                continue
            if name == "LITERAL":
                return out | {chr(arg)}, False
            if name == "IN":
                for kind, x in arg:
                    if str(kind) == "LITERAL":
                        out.add(chr(x))
                    elif str(kind) == "RANGE" and x[1] < 128:
                        out |= {chr(c) for c in range(x[0], x[1] + 1)}
                    else:
                        return None, False
                return out, False
            if name == "SUBPATTERN":
                found, empty = own(arg[3])
            elif name == "BRANCH":
                each = [own(x) for x in arg[1]]
                found, empty = (None if any(x[0] is None for x in each) else set().union(*(x[0] for x in each))), any(x[1] for x in each)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                found, empty = own(arg[2])
                empty = empty or arg[0] == 0
            else:
                return None, False
            if found is None:
                return None, False
            out |= found
            if not empty:
                return out, False
        return out, True

    try:
        tree = _parser.parse(regex)
    except re.error:
        return frozenset()
    found, empty = own(tree)
    if not found or empty or not found <= _WORD or tree.state.flags & re.IGNORECASE and not found <= set("0123456789_"):
        return frozenset()
    return frozenset(found)


@functools.lru_cache(None)
def requires_digit(regex: str) -> bool:
    """Whether every match holds a decimal digit of ASCII."""

    def digits(items) -> bool:
        return all(str(op) == "RANGE" and 48 <= arg[0] and arg[1] <= 57 or str(op) == "CATEGORY" and str(arg) == "CATEGORY_DIGIT" or str(op) == "LITERAL" and 48 <= arg <= 57 for op, arg in items)

    def walk(items) -> bool:
        for op, arg in items:
            name = str(op)
            if name == "IN" and digits(arg) or name == "LITERAL" and 48 <= arg <= 57:
                return True
            if name == "SUBPATTERN" and walk(arg[3]) or name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1 and walk(arg[2]):
                return True
            if name == "BRANCH" and all(walk(x) for x in arg[1]):
                return True
        return False

    try:
        return walk(_parser.parse(regex))
    except re.error:
        return False


def matches(text: Column, low: Column, regex: str) -> Column:
    """Whether the pattern is found; low is the lower-case text. Cheap tests that every match passes come first."""
    literals = required_any(regex)
    found = text.rlike(java(regex))
    if literals:
        return F.when(any_of(low, list(literals)), found).otherwise(F.lit(False))
    return F.when(text.rlike("[0-9]"), found).otherwise(F.lit(False)) if requires_digit(regex) else found


def _rare(literals: tuple[str, ...]) -> bool:
    return bool(literals) and all(len(x) > 3 or not x.isalnum() for x in literals)


def _any_fold(literals: list[str]) -> str:
    """A pattern of RE2 that is found where one of the strings stands, in whatever case."""
    return f"(?i:{'|'.join(map(re.escape, literals))})"


def holders(texts: pa.Array, needs: list[tuple[int, tuple[str, ...]]], fold: bool = False, at: np.ndarray | None = None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """For each number of `needs`, in their order, the texts that hold one of its strings (fold: in whatever case), and their places; none for those that stand nowhere.

    One search by RE2 for all strings leaves those texts that hold any, and each half of the strings is searched in these alone.
    """
    at = np.arange(len(texts)) if at is None else at
    strings = sorted({x for _, own in needs for x in own})
    if not len(texts) or not strings:
        return
    some = np.flatnonzero(pc.match_substring_regex(texts, _any_fold(strings) if fold else "|".join(map(re.escape, strings))).to_numpy(zero_copy_only=False))
    if not len(some):
        return
    if len(some) < len(texts):
        texts, at = texts.take(pa.array(some)), at[some]
    if len(needs) == 1:
        yield needs[0][0], texts, at
        return
    half = len(needs) // 2
    yield from holders(texts, needs[:half], fold, at)
    yield from holders(texts, needs[half:], fold, at)


def matched(text: Column, regexes: list[str]) -> Column:
    """Numbers of the patterns that are found in the text, ascending (none for null). The patterns are RE2's, and Arrow searches each batch with that engine.

    A pattern that requires one of some rarer strings is tried on the texts that hold one, others on all texts.
    """
    needs = [required_any(r) for r in regexes]
    bound = sorted(((i, own) for i, own in enumerate(needs) if _rare(own)), key=lambda x: x[1])
    free = [i for i, own in enumerate(needs) if not _rare(own)]

    def found(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("")
        rows, numbers = [], []

        def ask(own: pa.Array, at: np.ndarray, which: list[int]) -> None:
            for i in which:
                hit = at[own_rows(pc.match_substring_regex(own, regexes[i]))]
                rows.append(hit)
                numbers.append(np.full(len(hit), i))

        ask(texts, np.arange(len(texts)), free)
        for i, own, at in holders(texts, bound, True):
            ask(own, at, [i])
        row, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, numbers))
        order = np.lexsort([number, row])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(number[order].astype(np.int32)))

    def own_rows(flags: pa.Array) -> np.ndarray:
        return np.flatnonzero(flags.to_numpy(zero_copy_only=False))

    return F.arrow_udf(found, "array<int>")(text)



def ascii_counts(text: Column, classes: dict[str, str]) -> Column:
    """struct of how often characters of each class (of ASCII) stand in the text, and `rest`: its characters beyond ASCII. Null for null.

    Bytes of an Arrow batch are looked up in tables at once; only what is beyond ASCII, mostly little, is left for patterns.
    """
    tables = {}
    for name, own in classes.items():
        tables[name] = np.zeros(256, np.uint8)
        tables[name][[ord(c) for c in own]] = 1

    def counted(texts: pa.Array) -> pa.Array:
        null = texts.is_null()
        texts = texts.fill_null("").cast(pa.string())
        offs = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = (int(offs[0]), int(offs[-1])) if len(texts) else (0, 0)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        filled = np.flatnonzero(np.diff(offs))

        def sums(flags: np.ndarray) -> np.ndarray:
            out = np.zeros(len(texts), np.int64)
            if len(filled):
                out[filled] = np.add.reduceat(flags, (offs[:-1] - lo)[filled], dtype=np.int64)
            return out

        arrays = [pa.array(sums(t[data])) for t in tables.values()]
        beyond = data >= 128
        ends = np.concatenate([[0], np.cumsum(sums(beyond))]).astype(np.int32)
        rest = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[beyond].tobytes()))
        return pa.StructArray.from_arrays([*arrays, rest], names=[*tables, "rest"], mask=null)

    return F.arrow_udf(counted, ", ".join(f"{n} bigint" for n in tables) + ", rest string")(text)



@functools.lru_cache(None)
def required_sets(regex: str) -> tuple[tuple[str, ...], ...]:
    """Sets of lower-case strings, of each of which every match holds one at least."""
    out: list[tuple[str, ...]] = []

    def alone(items) -> tuple[str, ...]:
        """The best set of a branch of its own."""
        kept, out[:] = out[:], []
        walk(items)
        own, out[:] = out[:], kept
        return min(own, key=len) if own else ()

    def walk(items) -> None:
        run = ""
        for op, arg in [*items, ("END", None)]:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run += chr(arg).lower()
                continue
            if _telling(run):
                out.append((run,))
            run = ""
            if name == "SUBPATTERN":
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                walk(arg[2])
            elif name == "BRANCH":
                each = [alone(x) for x in arg[1]]
                if all(each):
                    out.append(tuple(dict.fromkeys(x for own in each for x in own)))

    try:
        walk(_parser.parse(regex))
    except re.error:
        return ()
    return tuple(dict.fromkeys(out))


@functools.lru_cache(None)
def telling_sets(regex: str) -> tuple[tuple[str, ...], ...]:
    """The required sets that tell most: those of strings of four characters and more, else the one whose strings are longest."""
    every = sorted(required_sets(regex), key=lambda own: -min(map(len, own)))
    return tuple(own for own in every if min(map(len, own)) >= 4) or tuple(every[:1])


#: Characters of texts whose tokens are looked at together.
_TOGETHER = 1 << 22


def _stretches(texts: list[str]) -> Iterator[list[str]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _TOGETHER:
            yield texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield texts[lo:]


def _holders(tokens: set[str], pieces: list[str]) -> dict[str, int]:
    """The tokens that hold pieces, each with a bit for every piece. All tokens are searched as one string, so a piece costs one search."""
    every = list(tokens)
    joined, starts, at = "\n".join(every), [], 0
    for t in every:
        starts.append(at)
        at += len(t) + 1
    out: dict[str, int] = {}
    for i, piece in enumerate(pieces):
        at = joined.find(piece)
        while at >= 0:
            k = bisect.bisect_right(starts, at) - 1
            out[every[k]] = out.get(every[k], 0) | 1 << i
            at = joined.find(piece, starts[k] + len(every[k]))
    return out


def _pieces(strings: list[str]) -> tuple[list[str], dict[str, list[int]]]:
    """The longest word of each string (empty where it has none), without repeats, and the numbers of each word's strings."""
    of: dict[str, list[int]] = {}
    for i, x in enumerate(strings):
        of.setdefault(max(x.split(), key=len, default=""), []).append(i)
    return list(of), of


def _bits(number: int) -> Iterator[int]:
    while number:
        low = number & -number
        yield low.bit_length() - 1
        number ^= low


def _standing(texts: list[str], strings: list[str]) -> Iterator[int]:
    """For each text a bit for every string that stands in it.

    A string's longest word lies within a token of the text. So the distinct tokens of some million characters are searched for each word once, and a
    text needs its own tokens looked up; strings of several words are then searched in the texts with their longest.
    """
    pieces, of = _pieces(strings)
    alone = [sum(1 << i for i in of[p] if strings[i] == p) for p in pieces]
    longer = [[i for i in of[p] if strings[i] != p] for p in pieces]
    blank = 1 << pieces.index("") if "" in pieces else 0
    words = [p or "\n\n" for p in pieces]  # no string of tokens holds the latter
    for some in _stretches(texts):
        own = [set(t.split()) for t in some]
        holders = _holders(set().union(*own), words)
        known = set(holders)
        for t, tokens in zip(some, own):
            hit = functools.reduce(lambda a, token: a | holders[token], tokens & known, blank)
            found = 0
            for p in _bits(hit):
                found |= alone[p]
                for i in longer[p]:
                    if strings[i] in t:
                        found |= 1 << i
            yield found


def counts_of(low: Column, groups: dict[str, list[str]]) -> Column:
    """struct of how many of each group's phrases the text holds (those that repeat in a group count each), Null for null."""
    strings = sorted({x for own in groups.values() for x in own})
    number = {x: i for i, x in enumerate(strings)}
    times = np.zeros((len(strings), len(groups)), np.int32)
    for k, own in enumerate(groups.values()):
        np.add.at(times, ([number[x] for x in own], k), 1)

    def found(texts: pa.Array) -> pa.Array:
        counts = np.zeros((len(texts), len(groups)), np.int32)
        for i, _, at in holders(texts.fill_null(""), [(i, (x,)) for i, x in enumerate(strings)]):
            counts[at] += times[i]
        return pa.StructArray.from_arrays([pa.array(c) for c in counts.T.copy()], names=list(groups), mask=texts.is_null())

    return F.arrow_udf(found, ", ".join(f"`{g}` int" for g in groups))(low)


def standing(low: Column, phrases: list[str]) -> Column:
    """Those of the phrases that the text holds, in the order given. Null for null."""

    def found(texts: pa.Array) -> pa.Array:
        hits: list[list[str]] = [[] for _ in range(len(texts))]
        for i, _, at in holders(texts.fill_null(""), [(i, (x,)) for i, x in enumerate(phrases)]):
            for row in at.tolist():
                hits[row].append(phrases[i])
        return pc.if_else(texts.is_null(), pa.scalar(None, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.string())))

    return F.arrow_udf(found, "array<string>")(low)


def candidates(low: Column, regexes: list[str]) -> Column:
    """Numbers of the patterns that may be found in the text (ascending), by the strings that each requires. low is the lower-case text."""
    strings = sorted({x for r in regexes for own in telling_sets(r) for x in own})
    bit = {x: 1 << i for i, x in enumerate(strings)}
    masks = [[sum(bit[x] for x in own) for own in telling_sets(r)] for r in regexes]

    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[i for i, own in enumerate(masks) if all(hit & m for m in own)] for hit in _standing(texts.fillna("").tolist(), strings)], dtype=object)

    return F.pandas_udf(found, "array<int>")(low)


def matches_of(text: Column, candidates: Column, number: int, regex: str) -> Column:
    """Whether a pattern with its number among the candidates is found."""
    found = text.rlike(java(regex))
    if not required_sets(regex) and requires_digit(regex):
        return F.when(text.rlike("[0-9]"), found).otherwise(F.lit(False))
    return F.when(F.array_contains(candidates, number), found).otherwise(F.lit(False))


#: What parts words here; other blanks of Unicode are parts of words.
_TOKEN = re.compile("[^\t\n\x0b\f\r\x20\x85\xa0]+")


def looked_up(text: Column, weights: list[tuple[str, float]], regexes: tuple[str, ...] = (), strings: tuple[str, ...] = (), blanked: str = "") -> Column:
    """struct of points, maybe and some, by one look at the tokens of a lower-case text; 0, none and false for null.

    points: the sum of weights, of one-word strings for every token that holds them, of others once where they stand. maybe: candidates of the patterns.
    some: whether one of `strings` stands there. blanked: characters for which the text has blanks; the patterns' strings and `strings` are read likewise.
    """
    plain = lambda x: x.lower().translate(dict.fromkeys(map(ord, blanked), " "))
    required = sorted({plain(x) for r in regexes for own in telling_sets(r) for x in own})
    bit = {x: 1 << i for i, x in enumerate(required)}
    masks = [[functools.reduce(lambda a, x: a | bit[plain(x)], own, 0) for own in telling_sets(r)] for r in regexes]
    literals = [plain(x) for x in strings]
    keys, weight, first = [*required, *(k for k, _ in weights)], [w for _, w in weights], len(required)
    pieces, of = _pieces(keys)
    words = [p or "\n\n" for p in pieces]  # no string of tokens holds the latter
    blank = 1 << pieces.index("") if "" in pieces else 0

    def found(texts: pd.Series) -> pd.DataFrame:
        points, maybe = [], []
        every = texts.fillna("").tolist()
        for some in _stretches(every):
            own = [Counter(_TOKEN.findall(t)) for t in some]
            holders = _holders(set().union(*own), words)
            known = set(holders)
            for t, tokens in zip(some, own):
                held = tokens.keys() & known
                hit, counts = 0, {}
                for p in _bits(functools.reduce(lambda a, token: a | holders[token], held, blank)):
                    for i in of[pieces[p]]:
                        if i < first:
                            hit |= 1 << i if keys[i] == pieces[p] or keys[i] in t else 0
                        elif keys[i] == pieces[p]:
                            counts[i - first] = sum(tokens[token] for token in held if holders[token] >> p & 1)
                        elif keys[i] in t:
                            counts[i - first] = 1
                total = 0.0
                for i in sorted(counts):
                    total += counts[i] * weight[i]
                points.append(total)
                maybe.append([i for i, m in enumerate(masks) if all(hit & x for x in m)])
        return pd.DataFrame({"points": points, "maybe": pd.Series(maybe, dtype=object), "some": [any(x in t for x in literals) for t in every]})

    return F.pandas_udf(found, "points double, maybe array<int>, some boolean")(text)


def any_of(low: Column, phrases: list[str]) -> Column:
    """Whether the text holds one of the phrases."""
    return functools.reduce(lambda a, b: a | b, (low.contains(p) for p in phrases))


def count_of(low: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text holds (int)."""
    return functools.reduce(lambda a, b: a + b, (low.contains(p).cast("int") for p in phrases))


def starts_with_any(low: Column, phrases: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, (low.startswith(p) for p in phrases))
