"""Byte-level BPE: the merges become a lazily determinised transducer that emits a token as
soon as no later byte can change it; decoding runs an incremental UTF-8 state machine."""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import ship, slices, tidy

#: Bounds of what a worker remembers: pairs of tokens, transitions, and (in each of two
#: generations) bytes of pieces with their ids. What is full is emptied.
PAIRS, STEPS, MEMO = 200_000, 200_000, 48 << 20
#: Bytes of memory that an entry of the memo takes besides its piece and ids.
ENTRY = 180
#: Longer pieces aren't memoised as a whole.
PIECE_CHARS = 48
#: Bytes read before what is final is emitted, again and again.
LOOKED = 512
_NEVER = 1 << 60


class Transducer:
    """Exact BPE by ranks over one piece of bytes, read once from left to right.

    The encoding of any prefix ends in one token only: the one whose left neighbour, the end
    of the shorter prefix, stays separate from it when both are merged afresh. So the states
    are those of the automaton that knows the longest end of the input which begins a token
    (transitions and the tokens that may end there are determinised when first needed), with
    the last tokens of the prefixes that this end covers as registers. What the encodings up
    to all places where a token may still begin share is final and is emitted: the lookahead
    is bounded by the longest token.

    The trie is one table from state and byte to state and a few arrays; only states that were
    visited have a table of transitions, and all are emptied when they have STEPS entries."""

    def __init__(self, ranks: dict[bytes, int], words: dict[int, bytes]):
        self.ranks, self.words = ranks, words
        self.trie: dict[int, int] = {}
        self.parent, self.byte, self.depth, self.token = array("i", [0]), bytearray(1), array("i", [0]), array("i", [-1])
        #: The two tokens whose merge makes a token (none for a byte), and when: by rank.
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.ordered = True  # every token comes after its parts
        stem = bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                child = self.trie.get(node << 8 | byte)
                if child is None:
                    child = self.trie[node << 8 | byte] = len(self.parent)
                    stem[node] = 1
                    stem.append(0)
                    self.parent.append(node)
                    self.byte.append(byte)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = child
            parts = self.merged(token, 2)
            if len(parts) < 3:  # else its own merges don't reach it
                self.token[node] = rank
            if len(parts) == 2:
                self.left[rank], self.right[rank] = ranks[parts[0]], ranks[parts[1]]
                self.ordered &= all(len(p) == 1 or ranks[p] < rank for p in parts)
        n = len(self.parent)
        self.stem = bytes(stem)  # whether a longer token begins so
        self.fall = array("i", [-1]) * n
        self.ends: list[tuple[tuple[int, int, dict[int, bool]], ...] | None] = [None] * n
        self.none: dict[int, int] = {}  # stands for every state without a determinised transition
        self.go: list[dict[int, int]] = [self.none] * n
        self.steps = 0
        #: For each token, whether it stays apart from a left neighbour; from none (-1) it does.
        self.apart: dict[int, dict[int, bool]] = {}
        self.pairs = 0

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges by definition: of all neighbours, the pair of the lowest rank first,
        until none is left or only `least` parts are."""
        get, none = self.ranks.get, _NEVER
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while len(costs) >= least:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _shorter(self, state: int) -> int:
        """The state of the next shorter end."""
        out = self.fall[state]
        if out < 0:
            up = self.parent[state]
            out = self.fall[state] = self._next(self._shorter(up), self.byte[state]) if up else 0
        return out

    def _next(self, state: int, byte: int) -> int:
        """Determinise one transition."""
        out = self.go[state].get(byte)
        if out is None:
            out = self.trie.get(state << 8 | byte)
            if out is None:
                if not state:
                    raise ValueError(f"no token has byte {byte}")
                out = self._next(self._shorter(state), byte)
            if self.steps >= STEPS:
                self.go[:] = [self.none] * len(self.go)
                self.steps = 0
            self.steps += 1
            if self.go[state] is self.none:
                self.go[state] = {}
            self.go[state][byte] = out
        return out

    def _ends(self, state: int) -> tuple[tuple[int, int, dict[int, bool]], ...]:
        """(token, bytes, what is known of its left neighbours) of the tokens that may end here,
        the longest first."""
        out = self.ends[state]
        if out is None:
            token = self.token[state]
            own = ((token, self.depth[state], self.apart.setdefault(token, {-1: True})),) if token >= 0 else ()
            out = self.ends[state] = own + (self._ends(self._shorter(state)) if state else ())
        return out

    def _separate(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay apart when their bytes are merged afresh.

        Both are unmerged step by step, the younger first. At each step the two parts that
        meet are neighbours until one of them goes into its whole; they merge if their pair
        comes before that. Of equal pairs the left one is merged first."""
        if self.pairs >= PAIRS:
            for known in self.apart.values():  # states hold these, so they are emptied where they are
                known.clear()
                known[-1] = True
            self.pairs = 0
        self.pairs += 1
        words, get = self.words, self.ranks.get
        if not self.ordered:
            ok = self.merged(words[a] + words[b]) == [words[a], words[b]]
            self.apart[b][a] = ok
            return ok
        x, y, x_until, y_until = a, b, _NEVER, _NEVER
        while True:
            pair = get(words[x] + words[y])
            if pair is not None and pair < x_until and pair <= y_until:
                ok = False
                break
            x_born = x if x in self.right else -1
            y_born = y if y in self.left else -1
            if x_born > y_born:
                x_until, x = x_born, self.right[x]
            elif y_born >= 0:
                y_until, y = y_born, self.left[y]
            else:
                ok = True
                break
        self.apart[b][a] = ok
        return ok

    def _final(self, state: int, sizes: list[int]) -> int:
        """Up to where the encoding can't change any more."""
        cut = len(sizes)
        while state:
            if self.stem[state]:
                j = len(sizes) - self.depth[state]
                while cut != j:
                    if cut > j:
                        cut -= sizes[cut - 1]
                    else:
                        j -= sizes[j - 1]
            state = self._shorter(state)
        return cut

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        go, ends = self.go, self.ends
        state, n = 0, 0
        tokens = [-1]  # the last token emitted, then of each prefix not yet emitted its last token
        for start in range(0, len(piece), LOOKED):
            if n:
                sizes = [len(self.words[t]) for t in tokens[1:]]
                cut = self._final(state, sizes)
                if cut:
                    ready = self._back(tokens, cut)
                    out += ready
                    n -= cut
                    tokens = [ready[-1], *tokens[cut + 1 :]]
            add = tokens.append
            for byte in piece[start : start + LOOKED] if start or len(piece) > LOOKED else piece:
                try:
                    state = go[state][byte]
                except KeyError:
                    state = self._next(state, byte)
                n += 1
                for token, size, known in ends[state] or self._ends(state):
                    ok = known.get(tokens[n - size])
                    if ok is None:
                        ok = self._separate(tokens[n - size], token)
                    if ok:
                        break
                add(token)
        return out + self._back(tokens, n)

    def _back(self, tokens: list[int], n: int) -> list[int]:
        out, words = [], self.words
        while n:
            token = tokens[n]
            out.append(token)
            n -= len(words[token])
        return out[::-1]


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get the characters complete so far. Its state is the
    begun character (at most 3 bytes); malformed bytes become U+FFFD as usual."""

    def __init__(self):
        self.begun = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.begun + data
        cut = len(data)
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                lead = data[-back]
                if lead >= 0xC0:
                    if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                        cut -= back
                    break
                if lead < 0x80:
                    break
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")


class Codec:
    """A vocabulary file (base64 bytes and rank a line) with the pattern that cuts texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.cut = regex.compile(pattern)
        self.words = {i: t for t, i in self.ranks.items()}
        self.forget()

    def forget(self) -> None:
        """Empty the memo of pieces, at the end of a task."""
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the memo

    @cached_property
    def transducer(self) -> Transducer:
        """Made when the first piece is encoded; decoding doesn't need it."""
        out = Transducer(self.ranks, self.words)
        gc.freeze()  # the collector of cycles needn't walk the automaton again and again
        return out

    def _miss(self, piece: str) -> bytes:
        """A piece that isn't in the memo. Two generations: a full memo becomes the older one, and what is used again stays."""
        out = self.older.get(piece)
        if out is None:
            out = array("i", self.transducer.encode(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= PIECE_CHARS:
            if self.held >= MEMO:
                self.older, self.memo, self.held = self.memo, {}, 0
            self.memo[piece] = out
            self.held += ENTRY + 2 * len(piece) + len(out)
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian int32."""
        get, miss = self.memo.get, self._miss
        if len(text) < 1 << 20:
            return b"".join([get(p) or miss(p) for p in self.cut.findall(text)])
        out = bytearray()  # the pieces of a very long text aren't listed at once
        for m in self.cut.finditer(text):
            p = m.group()
            out += get(p) or miss(p)
        return bytes(out)

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> Iterator[str]:
        machine = Utf8Machine()
        for i in range(0, len(ids), step):
            yield machine.feed(b"".join(map(self.words.__getitem__, ids[i : i + step].tolist())))
        yield machine.feed(b"", final=True)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True, text_col: str = "text", drop: tuple[str, ...] = (), decoded: str | None = None) -> DataFrame:
    """docs with n_tokens, (unless ids is False) ids array<int>, and, if `decoded` names a
    column, the text that the ids decode to; a narrow map, no shuffle.

    Null text counts as empty and has no ids. Input columns named like result columns are
    replaced; `drop` leaves input columns out. Lone surrogates become U+FFFD. Very long texts
    are encoded in linear time; an empty table gives an empty result."""
    ship(docs.sparkSession)
    made = [T.StructField("n_tokens", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    keep = [f for f in docs.schema.fields if f.name not in {m.name for m in made} and f.name not in drop]
    schema = T.StructType([*keep, *made])
    names = [f.name for f in keep]
    source = docs.select(*names, *([text_col] if text_col not in names else []))

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches, text_col):
            parts = [c.encode(t) for t in _texts(b.column(text_col))]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            cols = [b.column(n) for n in names] + [pa.array(np.diff(ends).astype("int64"))]
            if ids:
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
                cols.append(pa.ListArray.from_arrays(pa.array(ends.astype("int32")), values))
            if decoded:
                cols.append(pa.array(["".join(c.decode(np.frombuffer(p, "<i4"))) for p in parts], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        c.forget()
        tidy()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the decoded text. Null ids give an empty text."""
    ship(encoded.sparkSession)
    keep = [f for f in encoded.schema.fields if f.name != to]
    schema = T.StructType([*keep, T.StructField(to, T.StringType())])

    def run(batches):
        c = codec(path, pattern)
        for b in slices(batches, ids_col):
            lists = b.column(ids_col)
            texts = ["".join(c.decode(np.asarray(x.values)) if x.is_valid else ()) for x in lists]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op5(spark, sf_dir):
    path, pattern = vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode(docs, path, pattern, drop=("text",), decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
