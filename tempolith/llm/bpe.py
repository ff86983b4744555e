"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by an incremental UTF-8 machine."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, text_bytes

#: Words, transducer states and token pairs that a worker keeps; beyond that it starts anew (of words, the last so many stay).
CACHE_WORDS, CACHE_STATES, CACHE_PAIRS = 250_000, 200_000, 500_000
#: Bytes of a word after which decided tokens are emitted.
WINDOW = 4096

#: Unicode's White_Space characters, as the inside of a character class.
SPACE = "\\t-\\r \x85\xa0  -     　"


def splitter(pattern: str):
    """A function that cuts a text into the pattern's matches, ``\\s`` being Unicode's white space."""
    full = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
    ascii_only = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]"))
    return lambda text: (ascii_only if text.isascii() else full).findall(text)


class State(dict):
    """A state's arcs by byte, each (next state, token that ends after the byte); an arc is made when first asked for."""

    __slots__ = ("places", "make")

    def __init__(self, places: tuple[tuple[int, int], ...], make: Callable[[State, int], tuple[State, int]]) -> None:
        self.places, self.make = places, make

    def __missing__(self, byte: int) -> tuple[State, int]:
        found = self[byte] = self.make(self, byte)
        return found


class Transducer:
    """The merges of a rank file as a transducer from bytes to tokens.

    A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs, so the
    last token of every prefix is decided by the token before it. Reading bytes, a state knows the places where a token
    may still begin: for each, the node of the vocabulary's trie reached since and the token that ends there. An arc
    tells the token that ends after its byte. Tokens on which the ways to all of these places agree are emitted, so the
    lookahead is at most the longest token. States and arcs are made when first needed and kept.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(token or b"") for token in self.tokens]
        self.child: list[dict[int, int]] = [{}]
        self.token_at, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.depth.append(self.depth[node] + 1)
                    self.child.append({})
                    self.token_at.append(-1)
                node = self.child[node][b]
            self.token_at[node] = rank
        self.made: dict[int, list[tuple[int, bytes, bytes]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}
        self._forget()

    def _forget(self) -> None:
        """Make all states anew, when first needed."""
        self.states: dict[tuple[tuple[int, int], ...], State] = {}
        self.start = self._state(((0, -1),))

    def _state(self, places: tuple[tuple[int, int], ...]) -> State:
        found = self.states.get(places)
        if found is None:
            found = self.states[places] = State(places, self._arc)
        return found

    def merge(self, word: bytes) -> list[int]:
        """The encoding by its definition: join the neighbours of the lowest rank, the leftmost first, until none joins."""
        return [self.ranks[p] for p in self._merged(word)[0]]

    def _merged(self, word: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """The parts in the end, and for each join its rank and the first and last part after it."""
        parts, steps, never = [word[i : i + 1] for i in range(len(word))], [], 1 << 40
        joined = [self.ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while joined and (rank := min(joined)) < never:
            at = joined.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = self.ranks.get(parts[at - 1] + parts[at], never)
            if at < len(joined):
                joined[at] = self.ranks.get(parts[at] + parts[at + 1], never)
            steps.append((rank, parts[0], parts[-1]))
        return parts, steps

    def _steps(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """How merging builds the token from its bytes; None if it does not."""
        if token not in self.made:
            word = self.tokens[token]
            parts, steps = self._merged(word)
            self.made[token] = [(-1, word[:1], word[-1:]), *steps, (1 << 41, b"", b"")] if len(parts) == 1 else None
        return self.made[token]

    def _stand_together(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these tokens: no join across their border comes first.

        Until one does, each side's joins come in their own order, and of both sides' the lower rank first, the left one of equals.
        """
        a, b = self._steps(left), self._steps(right)
        if a is None or b is None:
            return False
        i = j = 0
        get, never = self.ranks.get, 1 << 40
        across = get(a[0][2] + b[0][1], never)
        while True:
            next_a, next_b = a[i + 1][0], b[j + 1][0]
            if across < next_a and across <= next_b and across < never:
                return False
            if next_a > never and next_b > never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1
            across = get(a[i][2] + b[j][1], never)

    def _follows(self, left: int, token: int) -> bool:
        """Whether ``token`` may stand after ``left``, or at the start (-1)."""
        if left < 0:
            return self._steps(token) is not None
        key = left << 32 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._stand_together(left, token)
        return found

    def _arc(self, state: State, byte: int) -> tuple[State, int]:
        after, last = [], -1
        child, token_at = self.child, self.token_at
        for node, before in state.places:
            node = child[node].get(byte, 0)
            if node:
                token = token_at[node]
                if last < 0 and token >= 0 and self._follows(before, token):
                    last = token
                if child[node]:
                    after.append((node, before))
        after.append((0, last))
        return self._state(tuple(after)), last

    def _way(self, ends: list[int], at: int) -> dict[int, int]:
        """The tokens of the way to ``at``, from the last to the first, by the places where they end."""
        way, lengths = {}, self.lengths
        while at > 0:
            token = way[at] = ends[at - 1]
            at -= lengths[token]
        return way

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one match of the pattern; a match that is a token is that token."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.states) >= CACHE_STATES:
            self._forget()
        state, out, ends = self.start, [], []
        for byte in word:
            state, last = state[byte]
            ends.append(last)
            if len(ends) >= WINDOW:  # a very long word: emit what is decided
                ways = [self._way(ends, len(ends) - self.depth[node]) for node, _ in state.places]
                decided = max((at for at in ways[0] if all(at in way for way in ways)), default=0)
                out += reversed([token for at, token in ways[-1].items() if at <= decided])
                del ends[:decided]
                if len(self.states) >= CACHE_STATES:
                    self._forget()
                    state = self._state(state.places)
        return out + list(self._way(ends, len(ends)).values())[::-1]

    def encode(self, words: Iterable[str]) -> tuple[list[int], str]:
        """Tokens of the words one after the other, also as decimal numbers joined by commas."""
        words = list(words)
        found = list(map(self.words.get, words))
        for at in [at for at, entry in enumerate(found) if entry is None] if None in found else ():
            found[at] = self._entry(words[at])
        return list(chain.from_iterable(map(itemgetter(0), found))), ",".join(map(itemgetter(1), found))

    def _entry(self, word: str) -> tuple[tuple[int, ...], str]:
        """Tokens of a word that was not at hand, kept from now on if the word is not long."""
        entry = self.words.get(word) or self.older.get(word)
        if entry is None:
            ids = tuple(self.encode_word(word.encode()))
            entry = (ids, ",".join(map(str, ids)))
        if len(word) < 64:
            if len(self.words) >= CACHE_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = entry
        return entry


class Effects:
    """What tokens do to the states of ``Utf8Decoder``, each worked out once; ``whole`` tokens lead from state 0 to state 0."""

    def __init__(self) -> None:
        self.after: dict[tuple[int, int], int] = {}
        self.whole: set[int] = set()


class Utf8Decoder:
    """Turns tokens into text piece by piece; a character whose bytes are not all there waits for the next piece.

    The machine's states are the ways a character can be incomplete; state 0 is between characters, -1 is malformed. The
    effect of a token on each state is worked out once. Malformed bytes become U+FFFD in the text, and in ``malformed``.
    """

    #: For each state, the continuation bytes allowed next and the state they lead to: as UTF-8 defines them.
    NEXT = {1: ((0x80, 0xBF, 0),), 2: ((0x80, 0xBF, 1),), 3: ((0x80, 0xBF, 2),), 4: ((0xA0, 0xBF, 1),), 5: ((0x80, 0x9F, 1),), 6: ((0x90, 0xBF, 2),), 7: ((0x80, 0x8F, 2),), 0: ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7))}

    def __init__(self, tokens: list[bytes | None], effects: Effects | None = None) -> None:
        self.tokens, self.effects = tokens, effects or Effects()
        self.state, self.held, self.malformed = 0, b"", False

    @classmethod
    def step(cls, state: int, byte: int) -> int:
        return next((to for low, high, to in cls.NEXT.get(state, ()) if low <= byte <= high), -1)

    def _effect(self, state: int, token: int) -> int:
        after = state
        for byte in self.tokens[token]:
            after = self.step(after, byte)
        self.effects.after[state, token] = after
        if state == after == 0:
            self.effects.whole.add(token)
        return after

    def feed(self, ids: list[int]) -> str:
        state, known = self.state, self.effects.after
        if state or not self.effects.whole.issuperset(ids):
            for i in ids:
                after = known.get((state, i))
                state = self._effect(state, i) if after is None else after
                if state < 0:
                    break
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        if state < 0:  # hold back what may be the start of a character, if the end looks like one
            self.malformed = True
            cut = next((k for k in (1, 2, 3) if k <= len(data) and self._open(data[-k:]) > 0), 0)
            state = self._open(data[-cut:]) if cut else 0
        else:
            cut = next((k for k in (1, 2, 3) if state and data[-k] >= 0xC0), 0)
        self.state, self.held = state, data[len(data) - cut :]
        return data[: len(data) - cut].decode(errors="replace")

    def _open(self, tail: bytes) -> int:
        state = 0
        for byte in tail:
            state = self.step(state, byte)
        return state

    def finish(self) -> str:
        rest, self.held, self.malformed, self.state = self.held.decode(errors="replace"), b"", self.malformed or self.state != 0, 0
        return rest


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """The transducer of a rank file, once for each worker."""
    with open(path, "rb") as lines:
        return Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text, without special tokens.

    Null texts count as empty and have no ids. Repeated rows stay, an empty table gives an empty one, other columns are
    ignored. ``ranks_path`` names a file that every worker has; its texts are cut by ``pattern`` first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, cut = load(ranks_path), splitter(pattern)
        for batch in batches:
            ids = [transducer.encode(cut((t or b"").decode()))[0] for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, piece: int = 4096) -> DataFrame:
    """(doc_id, text) of ``encode_documents``' rows, decoded ``piece`` tokens at a time; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, effects = load(ranks_path), Effects()
        for batch in batches:
            texts = ["".join(decode_stream(ids.as_py() or [], transducer.tokens, effects, piece)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def decode_stream(ids: list[int], tokens: list[bytes | None], effects: Effects, piece: int = 4096) -> Iterator[str]:
    decoder = Utf8Decoder(tokens, effects)
    for at in range(0, len(ids), piece):
        yield decoder.feed(ids[at : at + piece])
    yield decoder.finish()


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: texts are encoded, and the ids decoded, in one pass.

    Nulls, repeats and empty tables are as in ``encode_documents``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, cut, effects = load(ranks_path), splitter(pattern), Effects()
        for batch in batches:
            n, encoded, decoded = [], [], []
            for text in text_bytes(batch.column(1)):
                ids, decimals = transducer.encode(cut((text or b"").decode()))
                n.append(len(ids))
                encoded.append(hashlib.sha256(decimals.encode()).hexdigest())
                back = hashlib.sha256()
                for part in decode_stream(ids, transducer.tokens, effects):
                    back.update(part.encode())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
