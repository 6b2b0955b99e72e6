"""Token counts by a tokenizer compiled to a deterministic transducer over bytes.

The byte-level BPE tokenizer (pre-tokenizer pattern and merges together) becomes one finite-state
transducer: every transition on a byte carries the change of the token count. States and transitions are
compiled when a text first needs them and are kept by the worker. A batch's texts are cut into chunks of
a fixed length. From its first synchronising byte on (where every state that can stand there is the start
state) a chunk's state map is constant, so all chunks run at once; a prefix scan of the maps then gives each
chunk the state it is entered in, and only its bytes before that point are run from there.

Results equal the library's for every valid text: null and empty texts have 0 tokens, texts of any length are
counted whole, repeated rows each give a row, an empty table gives an empty result, and further columns of
the input are ignored. A null doc_id stays null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import flat, slices

#: White space of the pre-tokenizer pattern (Unicode White_Space), as a fixed set.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
LETTER, NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
#: Bytes of a chunk, and states kept before the compiled table is dropped and begun anew.
CHUNK, MAX_STATES = 512, 400_000
#: A packed transition is the next state times 64, plus the emitted count plus 32.
SHIFT, BIAS = 6, 32
START = 0


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as the inverse map."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The tokenizer file ``path`` as a lazily compiled transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        of_special = {t["content"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.bytes_of = {i: raw(s) for s, i in spec["model"]["vocab"].items() if s not in of_special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(self.id_of[raw(a)], self.id_of[raw(b)]): (n, self.id_of[raw(a + b)]) for n, (a, b) in enumerate(pairs)}
        # The trie of all tokens' bytes: child of (node, byte), token at a node, nodes with children.
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        inner = set()
        for b, i in self.id_of.items():
            node = 0
            for x in b:
                inner.add(node)
                at = node << 8 | x
                if at not in self.child:
                    self.child[at] = len(self.token)
                    self.token.append(-1)
                node = self.child[at]
            self.token[node] = i
        self.inner = inner
        self.fits: dict[tuple[int, int], bool] = {}
        self.kinds: dict[bytes, str] = {}
        self.reset()

    def reset(self) -> None:
        self.columns = np.full(256, -1, np.int64)
        self.used: list[int] = []
        self.width = 64
        self.table = np.full((4096, self.width), -1, np.int32)
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.end = np.zeros(4096, np.int64)
        self.state(("", None, b""))

    # Merges, and which token may follow which.

    def encode(self, text: bytes) -> list[int]:
        """BPE of a short byte string: the lowest-ranked pair first, the leftmost of equals."""
        ids = [self.id_of[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            best = min(((*self.rank.get(p, (1 << 30, -1)), i) for i, p in enumerate(zip(ids, ids[1:]))), key=lambda x: (x[0], x[2]))
            if best[1] < 0:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def follows(self, before: int, token: int) -> bool:
        """Whether the merges keep ``before`` and ``token`` side by side (-1: nothing stands before)."""
        key = (before, token)
        if key not in self.fits:
            want = [token] if before < 0 else [before, token]
            self.fits[key] = self.encode(b"".join(self.bytes_of[i] for i in want)) == want
        return self.fits[key]

    def grow(self, bpe: tuple | None, byte: int) -> tuple[tuple, int]:
        """The state of the merges after one more byte of a pre-token, and the change of its token count.

        A state holds the last token of the prefix so far, and for each place where a longer token could
        still begin: its node in the trie, the token before it, and the tokens counted since.
        The last token of a prefix is the one that ends there and may follow the last token before it.
        """
        last, live = bpe or (-1, ())
        kept, token, since = [], -1, 0
        for node, before, d in (*live, (0, last, 0)):
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            t = self.token[to]
            if token < 0 and t >= 0 and self.follows(before, t):
                token, since = t, d
            if to in self.inner:
                kept.append((to, before, d))
        emitted = 1 - since
        return (token, tuple((n, b, d + emitted) for n, b, d in kept)), emitted

    # The pre-tokenizer.

    def kind(self, char: bytes) -> str:
        """L letter, N number, S white space, O other."""
        if char not in self.kinds:
            c = char.decode("utf-8", "replace")
            self.kinds[char] = "S" if c in WHITE else "L" if LETTER.match(c) else "N" if NUMBER.match(c) else "O"
        return self.kinds[char]

    def feed(self, bpe: tuple | None, text: bytes) -> tuple[tuple | None, int]:
        total = 0
        for b in text:
            bpe, e = self.grow(bpe, b)
            total += e
        return bpe, total

    def char(self, mode: str, bpe: tuple | None, held: bytes, char: bytes) -> tuple[tuple, int]:
        """One more character. ``held`` is what waits: the last white space of a run, or the start of a contraction."""
        kind, total = self.kind(char), 0
        if mode == "Q":  # after an apostrophe that begins a pre-token
            whole = held + char
            if whole in (b"'s", b"'t", b"'m", b"'d", b"'re", b"'ve", b"'ll"):
                return ("", None, b""), self.feed(None, whole)[1]
            if whole in (b"'r", b"'v", b"'l"):
                return ("Q", None, whole), 0
            bpe, total = self.feed(None, b"'")
            mode = "O"
            if len(held) == 2:
                mode, (bpe, e) = "L", self.feed(None, held[1:])
                total += e
            held = b""
        if mode == "S":
            if kind == "S":
                bpe, total = self.feed(bpe, held)
                return ("S", bpe, char), total
            # The run ended before its last character; a blank joins what follows, others stand alone.
            if held == b" ":
                bpe, total = self.feed(None, held + char)
                return (kind, bpe, b""), total
            total, mode = self.feed(None, held)[1], ""
        if kind == "S":
            return ("S", None, char), total
        if mode == kind:
            bpe, e = self.feed(bpe, char)
            return (kind, bpe, b""), total + e
        if char == b"'":
            return ("Q", None, char), total
        bpe, e = self.feed(None, char)
        return (kind, bpe, b""), total + e

    def state(self, key: tuple) -> int:
        """The number of the state ``key`` (mode, merges, held bytes [, bytes of an unfinished character])."""
        if key in self.ids:
            return self.ids[key]
        n = self.ids[key] = len(self.keys)
        self.keys.append(key)
        if n >= len(self.table):
            more = len(self.table) // 2
            self.table = np.concatenate([self.table, np.full((more, self.width), -1, np.int32)])
            self.end = np.concatenate([self.end, np.zeros(more, np.int64)])
        mode, bpe, held = key[:3]
        if mode == "S":
            self.end[n] = self.feed(bpe, held)[1]
        elif mode == "Q":
            self.end[n] = 1 if len(held) == 1 else 2
        return n

    def compile(self, state: int, byte: int) -> None:
        """Fill in the transition of ``state`` on ``byte``."""
        mode, bpe, held, *part = self.keys[state]
        text = (part[0] if part else b"") + bytes([byte])
        lead = text[0]
        if len(text) < (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
            to, emitted = (mode, bpe, held, text), 0
        else:
            to, emitted = self.char(mode, bpe, held, text)
        n = self.state(to)
        self.table[state, self.columns[byte]] = n << SHIFT | (emitted + BIAS)

    def prepare(self, data: np.ndarray) -> None:
        """A column for every byte of ``data``; a table grown too large is begun anew."""
        if len(self.keys) > MAX_STATES:
            self.reset()
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.columns[b] < 0:
                if len(self.used) == self.width:
                    self.table = np.concatenate([self.table, np.full((len(self.table), 16), -1, np.int32)], axis=1)
                    self.width += 16
                self.columns[b] = len(self.used)
                self.used.append(int(b))

    def run(self, column: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and emitted count of each span ``start`` to ``end``, entered in ``state``; all spans step together."""
        length = end - start
        order = np.argsort(-length, kind="stable")
        longest = length[order]
        at, now = start[order].copy(), state[order].astype(np.int64)
        sums = np.zeros(len(order), np.int64)
        flat_table, done = self.table.reshape(-1), 0
        active = len(order)
        while True:
            active = int(np.searchsorted(-longest[:active], -done, "left"))
            if not active:
                break
            if active < 12:  # a few long spans: byte by byte
                for i in range(active):
                    s, total = int(now[i]), 0
                    for c in column[at[i] : at[i] + longest[i] - done].tolist():
                        v = self.table.item(s, c)
                        if v < 0:
                            self.compile(s, self.used[c])
                            v = self.table.item(s, c)
                        s = v >> SHIFT
                        total += (v & 63) - BIAS
                    now[i], sums[i] = s, sums[i] + total
                break
            col = column[at[:active]]
            v = flat_table[now[:active] * self.width + col]
            if v.min() < 0:
                for pair in np.unique(now[:active][v < 0] * 256 + col[v < 0]).tolist():
                    self.compile(pair >> 8, self.used[pair & 255])
                flat_table = self.table.reshape(-1)
                v = flat_table[now[:active] * self.width + col]
            now[:active] = v >> SHIFT
            sums[:active] += (v & 63) - BIAS
            at[:active] += 1
            done += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], sums[back]

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text; ``off`` has the n + 1 offsets in ``data``."""
        extra = np.zeros(len(off) - 1, np.int64)
        if not len(data):
            return extra
        owner = np.arange(len(off) - 1)
        starts, ends = off[:-1], off[1:]
        starts, ends, owner = self.without_special(data, starts, ends, owner, extra)
        self.prepare(data)
        column = self.columns[data]
        some = ends > starts
        starts, ends, owner = starts[some], ends[some], owner[some]
        if not len(starts):
            return extra
        # Chunks of all texts, and each one's first synchronising byte.
        n = -(-(ends - starts) // CHUNK)
        first = np.concatenate([[0], np.cumsum(n)])
        text = np.repeat(np.arange(len(n)), n)
        a = starts[text] + (np.arange(first[-1]) - first[text]) * CHUNK
        b = np.minimum(a + CHUNK, ends[text])
        sync = np.append(synchronising(data), len(data))
        point = sync[np.searchsorted(sync, a)]
        point[first[:-1]] = starts
        constant = point < b
        point = np.where(constant, point, b)
        exit_state = np.full(len(a), -1, np.int64)
        counted = np.zeros(len(a), np.int64)
        exit_state[constant], counted[constant] = self.run(column, point[constant], b[constant], np.zeros(int(constant.sum()), np.int64))
        # The scan: the last constant map before a chunk fixes the state it is entered in; maps that aren't constant
        # take theirs in turn from the one before.
        ready = np.flatnonzero(np.concatenate([[False], constant[:-1]]) & (a != starts[text]))
        while len(ready):
            out, e = self.run(column, a[ready], point[ready], exit_state[ready - 1])
            counted[ready] += e
            was = constant[ready]
            counted[ready[was]] += self.end[out[was]]
            exit_state[ready[~was]] = out[~was]
            ready = ready[~was] + 1
            ready = ready[ready < len(a)]
            ready = ready[a[ready] != starts[text[ready]]]
            ready = ready[exit_state[ready - 1] >= 0]
        last = first[1:] - 1
        counted[last] += self.end[exit_state[last]]
        np.add.at(extra, owner[text], counted)
        return extra

    def without_special(self, data, starts, ends, owner, extra):
        """Texts cut at the strings of special tokens, each of which adds one to its text's ``extra``."""
        blob = data.tobytes()
        if not any(s in blob for s in self.special):
            return starts, ends, owner
        cuts = []
        pattern = regex.compile(b"|".join(regex.escape(s) for s in self.special))
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            for m in pattern.finditer(blob, a, b):
                extra[i] += 1
                cuts.append((a, m.start(), i))
                a = m.end()
            cuts.append((a, b, i))
        return (np.array(x, np.int64) for x in zip(*cuts))


_ASCII = np.zeros(256, np.uint8)  # 1 letter, 2 number, 3 white space, 4 other, 0 not ASCII
_ASCII[:128] = 4
_ASCII[[*range(65, 91), *range(97, 123)]] = 1
_ASCII[48:58] = 2
_ASCII[[0x20, *range(0x09, 0x0E)]] = 3


def synchronising(data: np.ndarray) -> np.ndarray:
    """Places before which a pre-token ends whatever came earlier: an ASCII letter or digit, then ASCII of another kind; or other ASCII, then white space."""
    kind = _ASCII[data]
    before, here = kind[:-1], kind[1:]
    return np.flatnonzero((before > 0) & (here > 0) & (before != here) & ((before < 3) | (before == 4) & (here == 3))) + 1


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of ``path``, compiled so far by this process."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, without a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            data, off = flat(batch.column(1))
            counts = [machine.counts(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in slices(off)]
            tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_column, text_column).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
