"""Byte-level BPE by a deterministic token automaton built from merge gadgets, and whole-token counting.

Gadgets. The automaton of tokens starts as one state with a loop for each byte. Merge k of (a, b) into ab applies a gadget:
every state with an arc a to a state D_a that has an arc b gets D_a without its arc b as the target of a, and a new arc
ab to where b led. As each state is named by the token that leads to it, the gadget for merge k is three facts, kept in
arrays by token in rank order: D_ab copies D_b as it stood before k; D_a has no arc b from k on; every state that has an
arc a at k has an arc ab from then on (but the copy of D_a itself, when a is b). `arc(u, v)` reads them. A word's token
sequence is the only path from the start whose labels spell the word.

Determinised by bytes. A state of the byte automaton is what a prefix leaves open: the last token of the prefix's own path
(each prefix has just one), and each (token state, label begun) that may still become an arc. One byte leads to one
next state, so a word is read by a look-up a byte in a transition array, never stepping back, and all words of a slice
are read side by side. Each state names its last token, so the tokens follow from the word's end by their lengths.
Transitions are compiled when a byte first asks for them, for at most STATES states; words that need more are walked
without them, and the next slice starts with empty arrays. No size changes a result.

Nulls count as empty texts; an empty text has no tokens. Bytes that are no UTF-8 count as U+FFFD (n_bytes counts them as
they are). Very long texts are read in parts that end before white space; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import decoded, file_bytes, map_texts

NEVER = 1 << 30
#: Arcs that a worker remembers, states whose rows it keeps, bytes of words that are read side by side, and of the longest such word.
ARCS, STATES, SLICE, LONG = 1 << 20, 1 << 18, 1 << 19, 64
#: Places of the transition arrays, of which half are used at most.
ROW_BITS, WALKED = 21, 1


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of tokens of one vocabulary file; states and arcs are token ids, and the start state is -1."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        letters = byte_letters()
        unspell = lambda s: bytes(letters[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.ids = {unspell(s): i for s, i in vocab.items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels = [b""] * size
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.labels[i] = s
        self.left, self.right, self.born, self.gone = [-1] * size, [-1] * size, [-1] * size, {}
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            u, v = vocab[a], vocab[b]
            t = vocab[a + b]
            self.gone[u, v] = k
            if self.born[t] < 0:
                self.left[t], self.right[t], self.born[t] = u, v, k
        self.known: dict[int, bool] = {}
        #: Proved whole tokens: strings of the vocabulary that the automaton reads as one arc from the start.
        self.whole: dict[bytes, int] = {}
        whole = [False] * size
        for s, i in sorted(self.ids.items(), key=lambda x: self.born[x[1]]):
            a, b = self.left[i], self.right[i]
            whole[i] = a < 0 or whole[a] and whole[b] and self.arc_at(a, b, self.born[i])
            if whole[i]:
                self.whole[s] = i

    def arc_at(self, u: int, v: int, time: int) -> bool:
        """Has the state that u leads to an arc v, when merges before `time` are applied?"""
        born, left, right, gone = self.born, self.left, self.right, self.gone
        while True:
            if gone.get((u, v), NEVER) < time:
                return False
            if born[u] == born[v] == -1:
                return True
            if born[u] > born[v]:
                time, u = born[u], right[u]
            else:
                time, half = born[v], left[v]
                if half == u == right[v]:
                    return False
                v = half

    def arc(self, u: int, v: int) -> bool:
        key = u * self.size + v
        if (found := self.known.get(key)) is None:
            if len(self.known) >= ARCS:
                self.known.clear()
            found = self.known[key] = self.arc_at(u, v, NEVER)
        return found


class Trie:
    """The labels of the proved whole tokens, by bytes, from node 0."""

    def __init__(self, whole: dict[bytes, int]):
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for s, i in whole.items():
            at = 0
            for b in s:
                self.inner[at] = True
                key = at << 8 | b
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                at = to
            self.token[at] = i


class Transitions:
    """(state << 8 | byte) to the next state, in open-addressed arrays that are read for many words at once."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """The next states; 0 where there is none."""
        at = self.slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.to[at], 0)
        rest = np.flatnonzero((held != key) & (held >= 0))
        at, wanted = at[rest], key[rest]
        while len(rest):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == wanted
            out[rest[hit]] = self.to[at[hit]]
            more = np.flatnonzero(~hit & (held >= 0))
            rest, at, wanted = rest[more], at[more], wanted[more]
        return out

    def add(self, keys: np.ndarray, to: np.ndarray) -> None:
        """New keys, all different."""
        at = self.slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several that meet in a place the last stays
            here = self.keys[at] == keys
            self.to[at[here]] = to[here]
            keys, to, at = keys[~here], to[~here], (at[~here] + 1) & self.mask


NODE_BITS = 24


class ByteAutomaton:
    """The automaton of tokens, determinised by bytes.

    State 0 is the start, and no byte leads back to it; state WALKED is that of words that are walked without the arrays.
    """

    def __init__(self, auto: MergeAutomaton):
        self.auto, self.trie = auto, Trie(auto.whole)
        if len(self.trie.token) >= 1 << NODE_BITS:
            raise ValueError("the vocabulary's labels are too long together")
        self.length = np.array([len(x) for x in auto.labels], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        begin = (0,)  # (token state + 1) << NODE_BITS | node of a label begun
        self.open, self.state = [begin, ()], {begin: 0}
        self.last = np.full(STATES, -1, dtype=np.int32)  # the last token of the path
        self.rows, self.used = Transitions(ROW_BITS), 0

    def full(self) -> bool:
        return len(self.open) >= STATES or self.used >= 1 << ROW_BITS - 1

    def step(self, begun: tuple, byte: int) -> tuple[int, tuple]:
        """The last token, and what is open, after one more byte."""
        child, token, inner = self.trie.child.get, self.trie.token, self.trie.inner
        out, last = [], -1
        for x in begun:
            at = x & (1 << NODE_BITS) - 1
            to = child(at << 8 | byte)
            if to is not None:
                if last < 0 <= token[to] and (x < 1 << NODE_BITS or self.auto.arc((x >> NODE_BITS) - 1, token[to])):
                    last = token[to]
                if inner[to]:
                    out.append(x - at + to)
        if last < 0:
            raise ValueError("the vocabulary lacks a byte")
        out.append(last + 1 << NODE_BITS)
        return last, tuple(out)

    def compiled(self, key: int) -> int:
        """The state that state key >> 8 goes to with byte key & 255."""
        last, out = self.step(self.open[key >> 8], key & 255)
        if (to := self.state.get(out)) is None:
            if self.full():
                return WALKED
            to = self.state[out] = len(self.open)
            self.open.append(out)
            self.last[to] = last
        return to

    def next(self, key: np.ndarray) -> np.ndarray:
        """The next states by the arrays; what they lack is compiled first."""
        to = self.rows.look_up(key)
        if len(miss := np.flatnonzero(to == 0)):
            asked, which = np.unique(key[miss], return_inverse=True)
            made = np.array([WALKED if k >> 8 == WALKED else self.compiled(k) for k in asked.tolist()], dtype=np.int32)
            new = np.flatnonzero(made != WALKED)[: max(0, (1 << ROW_BITS - 1) - self.used)]
            self.rows.add(asked[new], made[new])
            self.used += len(new)
            to[miss] = made[which]
        return to

    def walk(self, word: bytes) -> list[int]:
        """A word's tokens, without the arrays."""
        begun, lasts = self.open[0], []
        for byte in word:
            last, begun = self.step(begun, byte)
            lasts.append(last)
        out, at = [], len(word)
        while at:
            out.append(lasts[at - 1])
            at -= len(self.auto.labels[out[-1]])
        return out[::-1]

    def read(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words [begin, end) in data: the token that ends with each byte, and where one of its word's tokens ends."""
        if self.full():
            self.clear()
        token, ends = np.full(len(data), -1, dtype=np.int32), np.zeros(len(data), dtype=bool)
        size = end - begin
        short = np.where((size > 0) & (size <= LONG))[0]
        order = short[np.argsort(-size[short], kind="stable")]
        at, state = begin[order], np.zeros(len(order), dtype=np.int64)
        longer = len(order) - np.cumsum(np.bincount(size[order], minlength=LONG + 1))  # how many words have more than p bytes
        for p in range(LONG):
            if not (n := int(longer[p])):
                break
            place = at[:n] + p
            state[:n] = self.next((state[:n] << 8) + data[place])
            token[place] = self.last[state[:n]]
        read = state != WALKED
        back, stop = end[order[read]], at[read]
        while len(back):
            last = back - 1
            ends[last] = True
            back = back - self.length[token[last]]
            more = back > stop
            back, stop = back[more], stop[more]
        for w in [*order[~read].tolist(), *np.where(size > LONG)[0].tolist()]:
            spot = int(begin[w])
            for t in self.walk(data[spot : int(end[w])].tobytes()):
                spot += int(self.length[t])
                token[spot - 1], ends[spot - 1] = t, True
        return token, ends


LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4


class Splitter:
    """Where byte-level pre-splitting cuts texts; classes of code points are asked of the installed library, once each."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.ask = Tokenizer.from_str(raw.decode()).pre_tokenizer.pre_tokenize_str
        self.kind = np.zeros(0x110000, dtype=np.uint8)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        found = self.kind[points]
        if not found.all():
            for c in np.unique(points[found == 0]).tolist():
                self.kind[c] = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.ask(x + chr(c))) == 1), SPACE)
            found = self.kind[points]
        return found

    def words(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a word begins at each code point; first: where a text begins, which always begins a word.

        Words are runs of letters, of numbers, of other signs, each with one blank before it, and what is left of white space;
        after a text's start or another word's end, an apostrophe and one of s, t, m, d, re, ve, ll are a word.
        """
        n = len(points)
        kind = self.kinds(points)
        new = first.copy()
        new[1:] |= kind[1:] != kind[:-1]
        before_word = np.zeros(n, dtype=bool)  # white space just before another sign of its text
        before_word[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]
        new |= before_word
        new[np.flatnonzero(before_word & (points == 32)) + 1] = False
        mark = np.flatnonzero((points == 39) & new)
        if len(mark):
            ahead = np.append(points, [0, 0, 0]), np.append(first, [True, True, True])
            a, b = ahead[0][mark + 1], ahead[0][mark + 2]
            one = ~ahead[1][mark + 1] & np.isin(a, [ord(c) for c in "stmd"])
            two = ~ahead[1][mark + 1] & ~ahead[1][mark + 2] & np.isin(a * 256 + b, [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")]) & (b < 256)
            for found, size in ((mark[one], 2), (mark[two], 3)):
                new[found + 1] = False
                after = found + size
                new[after[after < n]] = True
        return new


class Encoder:
    """Encodes whole texts: special strings, then pre-splitting, then the automaton."""

    def __init__(self, raw: bytes):
        self.auto = MergeAutomaton(raw)
        self.bytes, self.splitter = ByteAutomaton(self.auto), Splitter(raw)
        self.special = {s.decode(): i for s, i in self.auto.special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        trie = self.bytes.trie
        self.labels, self.proved = Transitions(max(8, (2 * len(trie.child)).bit_length())), np.array(trie.token) >= 0
        self.labels.add(np.fromiter(trie.child, np.int64, len(trie.child)), np.fromiter(trie.child.values(), np.int32, len(trie.child)))

    def parts(self, text: str):
        """(part, its special id or -1) in order; the leftmost special string goes first, the longest of those that start there.

        Parts of over SLICE code points end before the next white space that follows another sign.
        """
        pieces = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                yield piece, self.special[piece]
                continue
            at = 0
            while len(piece) - at > SLICE and (found := re.compile(r"[!-~](?=[ \n])").search(piece, at + SLICE)):
                yield piece[at : found.end()], -1
                at = found.end()
            if at < len(piece):
                yield piece[at:] if at else piece, -1

    def slices(self, texts: list[str]):
        """Lists of (text number, part, special id) of about SLICE code points."""
        group, size = [], 0
        for k, t in enumerate(texts):
            for part, special in self.parts(t):
                group.append((k, part, special))
                size += len(part)
                if size >= SLICE:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def layout(self, group):
        """(bytes, first byte and end of each word, first byte and end of each part) of the parts that aren't special strings."""
        points = np.frombuffer("".join(p for _, p, special in group if special < 0).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sizes = np.array([0 if special >= 0 else len(p) for _, p, special in group], dtype=np.int64)
        stops = np.cumsum(sizes)
        first = np.zeros(len(points), dtype=bool)
        first[(stops - sizes)[sizes > 0]] = True
        at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        data = np.frombuffer("".join(p for _, p, special in group if special < 0).encode(), dtype=np.uint8)
        begin = at[:-1][self.splitter.words(points, first)] if len(points) else at[:0]
        return data, begin, np.append(begin[1:], at[-1])[: len(begin)], at[stops - sizes], at[stops]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for group in self.slices(texts):
            data, begin, end, a, b = self.layout(group)
            token, ends = self.bytes.read(data, begin, end)
            ids = token[ends].astype("<u4")
            before = np.concatenate([[0], np.cumsum(ends)])
            for (k, _, special), x, y in zip(group, before[a].tolist(), before[b].tolist()):
                out[k].append(ids[x:y] if special < 0 else np.array([special], dtype="<u4"))
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, dtype="<u4") for x in out]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def decode(self, ids: bytes) -> str:
        """The arcs' labels, joined; bytes that are no UTF-8 become U+FFFD as the library does it."""
        label = self.auto.labels.__getitem__
        return b"".join(map(label, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")

    def count_all(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text: proved whole tokens count one, only the other pre-tokens go through the automaton."""
        total = np.zeros(len(texts), dtype=np.int64)
        for group in self.slices(texts):
            data, begin, end, a, b = self.layout(group)
            whole = self.whole_words(data, begin, end)
            _, ends = self.bytes.read(data, begin[~whole], end[~whole])
            ends[end[whole] - 1] = True
            before = np.concatenate([[0], np.cumsum(ends)])
            number = before[b] - before[a] + np.array([special >= 0 for *_, special in group])
            np.add.at(total, np.array([k for k, *_ in group], dtype=np.int64), number)
        return total.tolist()

    def whole_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which words are proved whole tokens: those that end in a token's node of the table of labels."""
        out = np.zeros(len(begin), dtype=bool)
        at, live, node = begin.copy(), np.arange(len(begin)), np.zeros(len(begin), dtype=np.int64)
        while len(live):
            node = self.labels.look_up((node << 8) + data[at]).astype(np.int64)
            at = at + 1
            done = at == end[live]
            out[live[done]] = self.proved[node[done]]
            go = ~done & (node > 0)
            at, live, node = at[go], live[go], node[go]
        return out

    def count(self, text: str) -> int:
        return self.count_all([text])[0]


_LOADED: dict[bytes, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """One encoder for each vocabulary and Python process."""
    key = hashlib.sha256(raw).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(raw)
    return _LOADED[key]


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, ids: bool = True, decoded_text: bool = True) -> DataFrame:
    """Adds n_tokens, token_ids (little-endian unsigned 32-bit integers) and decoded_text to the kept columns (all but none by default).

    Map-only; a kept column gives way to an added one of its name.
    """
    keep = list(df.columns) if keep is None else keep
    spec = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))  # of the vocabulary's fixed size

    def each(found, _):
        e = encoder(spec.value)
        packed = [x.tobytes() for x in e.encode_all([decoded(t) for t in found])]
        return [(len(x) // 4, *((x,) if ids else ()), *((e.decode(x),) if decoded_text else ())) for x in packed]

    return map_texts(df, text_col, keep, "n_tokens long" + ", token_ids binary" * ids + ", decoded_text string" * decoded_text, each)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Adds decoded_text to the kept columns; null ids decode to an empty text."""
    from pyspark.sql import functions as F

    spec = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    keep = [c for c in df.columns if c != ids_col] if keep is None else keep
    # the ids travel as base64 text, as map_texts takes strings
    import base64

    def each(found, _):
        e = encoder(spec.value)
        return [(e.decode(base64.b64decode(t)),) for t in found]

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.base64(F.col(f"`{ids_col}`")).alias("_ids64"))
    return map_texts(source, "_ids64", keep, "decoded_text string", each)


def count_tokens(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, limit: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to the kept columns; map-only."""
    keep = list(df.columns) if keep is None else keep
    spec = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def each(found, _):
        return [(len(t), n, n > limit) for t, n in zip(found, encoder(spec.value).count_all([decoded(t) for t in found]))]

    return map_texts(df, text_col, keep, "n_bytes long, n_tokens long, over_limit boolean", each)


def digests(df: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, n_tokens, ids_sha256 and decoded_sha256: what encode() gives, hashed where it is made so that no ids travel."""
    keep = ["doc_id"] if keep is None else keep
    spec = df.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def each(found, _):
        e = encoder(spec.value)
        packed = [x.tobytes() for x in e.encode_all([decoded(t) for t in found])]
        return [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(e.decode(x).encode()).hexdigest()) for x in packed]

    return map_texts(df, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", each)
