"""Token counts of a unigram tokenizer: Aho-Corasick finds the pieces, dynamic programming carries score and count only.

Where sums of scores are exact, the distinct words of some texts go through the automaton side by side, a character of all
of them at a time; else one after the other.
"""

from __future__ import annotations

from collections import Counter as Tally
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, text_bytes

#: The mark that stands for a blank and begins every word.
MARK = "▁"
#: An unknown character scores so much less than the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Words whose results a worker keeps, and as many older ones.
CACHE_WORDS = 200_000
#: Characters of a text that are cut into words at once, and of a word whose places are all kept while it is segmented.
PIECE, WHOLE_WORD = 1 << 20, 1 << 14
#: Characters whose moves the automaton has as a table, words that go through it together and their characters at most, and bytes of text whose words are told apart at once.
COMMON, ABREAST, SHORT, TOGETHER = 127, 4096, 64, 4 << 20


class Automaton:
    """Aho-Corasick automaton over words side by side. Its moves by common characters are a table, failures included; those by others are looked up, failures followed."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: float) -> None:
        self.unknown = unknown
        score = dict(pieces)
        kids: list[dict[str, int]] = [{}]
        names = [""]
        for piece in score:
            node = 0
            for k, char in enumerate(piece):
                if char not in kids[node]:
                    kids[node][char] = len(kids)
                    kids.append({})
                    names.append(piece[: k + 1])
                node = kids[node][char]
        n = len(kids)
        common = [c for c, _ in Tally(c for piece in score for c in piece).most_common(COMMON)]
        place = {c: k + 1 for k, c in enumerate(common)}
        self.place = np.zeros(0x110000, np.uint8)
        self.place[[ord(c) for c in common]] = np.arange(1, len(common) + 1)
        self.table = np.zeros((n, len(common) + 1), np.min_scalar_type(n))
        self.fail, self.above = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.length = np.array([len(x) for x in names], np.int32)
        self.score = np.array([score.get(x, -np.inf) for x in names])
        self.is_piece = np.array([x in score for x in names])
        self.is_piece[0] = False
        #: The node of the longest piece that a node ends with, itself included, 0 if none; ``above`` has the next shorter one.
        self.longest = np.zeros(n, np.int32)
        level = [0]
        while level:
            following = []
            for node in level:
                self.table[node] = self.table[self.fail[node]] if node else 0
                for char, kid in kids[node].items():
                    back = self.fail[node]
                    while node and back and char not in kids[back]:
                        back = self.fail[back]
                    self.fail[kid] = kids[back].get(char, 0) if node else 0
                    self.above[kid] = self.longest[self.fail[kid]]
                    self.longest[kid] = kid if self.is_piece[kid] else self.above[kid]
                    if char in place:
                        self.table[node, place[char]] = kid
                    following.append(kid)
            level = following
        moves = sorted((node << 21 | ord(char), kid) for node, own in enumerate(kids) for char, kid in own.items() if char not in place)
        self.keys, self.kids = np.array([k for k, _ in moves] + [1 << 62], np.int64), np.array([k for _, k in moves] + [0], np.int64)
        self.alone = np.zeros(0x110000, bool)
        self.alone[[ord(piece) for piece in score if len(piece) == 1]] = True

    def _rare(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes after a character that has no column."""
        found, left = np.zeros(len(node), np.int64), np.arange(len(node))
        while len(left):
            key = node[left] << 21 | char[left]
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            found[left[hit]] = self.kids[at[hit]]
            left = left[~hit & (node[left] > 0)]
            node[left] = self.fail[node[left]]
        return found

    def run(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Score and pieces, as real and imaginary part, of the words in the rows of ``chars``, of which the first ``sizes`` count. Of equal ways the one whose last piece begins first stays."""
        n, longest = chars.shape
        rows = np.arange(n)
        best, count = np.zeros((longest + 1, n)), np.zeros((longest + 1, n), np.int64)
        node = np.zeros(n, np.int64)
        for at in range(longest):
            char = chars[:, at]
            place = self.place[char]
            after = self.table[node, place].astype(np.int64)
            if len(rare := np.flatnonzero(place == 0)):
                after[rare] = self._rare(node[rare], char[rare])
            node = after
            top, number = np.full(n, -np.inf), np.zeros(n, np.int64)
            some, piece = rows, self.longest[node]
            while len(keep := np.flatnonzero(piece)):
                some, piece = some[keep], piece[keep]
                start = at + 1 - self.length[piece]
                total = self.score[piece] + best[start, some]
                better = np.flatnonzero(total > top[some])
                top[some[better]] = total[better]
                number[some[better]] = count[start[better], some[better]] + 1
                piece = self.above[piece]
            if len(odd := np.flatnonzero(~self.alone[char])):
                total = self.unknown + best[at, odd]
                odd, total = odd[more := total > top[odd]], total[more]
                top[odd] = total
                code = char[odd]
                number[odd] = count[at, odd] + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            best[at + 1], count[at + 1] = top, number
        return best[sizes, rows] + 1j * count[sizes, rows]


class Counter:
    """Best score and number of pieces of a text under a unigram vocabulary.

    The text is cut before every blank, which becomes MARK, and each word is segmented by itself. Ties are broken as the
    usual forward pass does: of the ways to reach a place with the same score, the one whose last piece starts first
    stays. A character that no piece of its own covers may be unknown; if the vocabulary has the 256 pieces ``<0x00>`` to
    ``<0xFF>``, an unknown character counts as its UTF-8 bytes, else neighbouring unknown characters count as one piece.
    """

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.unknown: float = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # in no longer piece, a line end stands between pieces; exact only if neither sums are rounded nor unknown pieces join
        alone = all("\n" not in piece for piece, _ in pieces if len(piece) > 1)
        self.by_line = alone and all(score == int(score) for _, score in pieces) and (self.bytes or "\n" in names)
        self.line_end = complex(*self.word("\n"))
        #: None where a sum may be rounded or unknown characters join.
        self.abreast = Automaton([(piece, score) for piece, score in pieces if piece], self.unknown) if self.by_line and self.bytes else None
        #: Results of parts; beyond CACHE_WORDS the last so many stay.
        self.cache: dict[str, complex] = {}
        self.older: dict[str, complex] = {}

    def word(self, word: str) -> tuple[float, int]:
        """(score, pieces) of one word, mark included."""
        if len(word) > WHOLE_WORD:
            return self._long(word)
        best, count, unknown = [0.0], [0], set()  # unknown: places after an unknown character
        at, top, n, single, nothing = 0, float("-inf"), 0, False, float("-inf")
        for end, (length, score) in self.matches.iter(word):
            if end > at:
                if single:
                    best.append(top)
                    count.append(n)
                else:
                    self._unknown(word, at, top, n, best, count, unknown)
                for at in range(at + 1, end):
                    self._unknown(word, at, nothing, 0, best, count, unknown)
                at, top, single = end, nothing, False
            start = end + 1 - length  # longest first, so the earliest start is first
            total = score + best[start]
            if total > top:
                top, n = total, count[start] + 1
            if length == 1:
                single = True
        if single:
            best.append(top)
            count.append(n)
        elif word:
            self._unknown(word, at, top, n, best, count, unknown)
        for at in range(at + 1, len(word)):
            self._unknown(word, at, nothing, 0, best, count, unknown)
        return best[-1], count[-1]

    def _long(self, word: str) -> tuple[float, int]:
        """As ``word``; only the places that a piece may still begin at are held, in a ring."""
        size = self.longest + 1
        best, count, unknown = [float("-inf")] * size, [0] * size, [False] * size
        best[0], settled = 0.0, 0
        top, n, single = float("-inf"), 0, False

        def settle(upto: int) -> None:
            """Settle the places after the characters from the last settled one up to ``upto``; a match ends at the first alone."""
            nonlocal settled, top, n, single
            while settled < upto:
                here, after = settled % size, (settled + 1) % size
                unknown[after] = False
                if not single and self.unknown + best[here] > top:
                    top, n = self.unknown + best[here], count[here] + (len(word[settled].encode()) if self.bytes else not unknown[here])
                    unknown[after] = True
                best[after], count[after] = top, n
                settled, top, n, single = settled + 1, float("-inf"), 0, False

        for end, (length, score) in self.matches.iter(word):
            settle(end)
            start = (end + 1 - length) % size
            if score + best[start] > top:
                top, n = score + best[start], count[start] + 1
            single = single or length == 1
        settle(len(word))
        return best[settled % size], count[settled % size]

    def _unknown(self, word: str, at: int, top: float, n: int, best: list[float], count: list[int], unknown: set[int]) -> None:
        """Settle the place after the character ``at``, which is no piece: it may be unknown, or end a longer piece (top, n)."""
        if self.unknown + best[at] > top:
            top, n = self.unknown + best[at], count[at] + (len(word[at].encode()) if self.bytes else at not in unknown)
            unknown.add(at + 1)
        best.append(top)
        count.append(n)

    def _new(self, part: str) -> complex:
        """Result of a part that is not kept yet: a word less its mark, or a line end and what follows it."""
        if self.by_line and part.startswith("\n"):
            return self.line_end + (complex(*self.word(part[1:])) if len(part) > 1 else 0)
        return complex(*self.word(MARK + part))

    def text(self, text: str) -> tuple[float, int]:
        """(score, pieces) of a whole text; an empty one has no piece."""
        if not text:
            return 0.0, 0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        if self.by_line:
            marked = marked.replace("\n", MARK + "\n")
        marked = marked[1:]
        total, at = 0j, 0
        while at <= len(marked):
            end = marked.find(MARK, at + PIECE) if len(marked) - at > PIECE else -1
            end = len(marked) if end < 0 else end
            total = self._sum(marked[at:end].split(MARK), total)
            at = end + 1
        return total.real, int(total.imag)

    def texts(self, texts: Iterable[bytes | None]) -> tuple[list[float], list[int]]:
        """(scores, pieces) of UTF-8 texts, as ``text``; null ones count as empty."""
        if self.abreast is None:
            found = np.array([complex(*self.text((t or b"").decode())) for t in texts], complex)
            return found.real.tolist(), found.imag.astype(np.int64).tolist()
        mark, totals, owners, held, size = MARK.encode(), [], [], [], 0

        def settle() -> None:
            nonlocal owners, held, size
            for owner, found in zip(owners, self._sums(held) if held else (), strict=True):
                totals[owner] += found
            owners, held, size = [], [], 0

        for row, text in enumerate(texts):
            totals.append(0j)
            marked = (text or b"").replace(b" ", mark).removeprefix(mark).replace(b"\n", mark + b"\n")
            at = 0
            while text and at <= len(marked):
                end = marked.find(mark, at + PIECE) if len(marked) - at > PIECE else -1
                end = len(marked) if end < 0 else end
                owners.append(row)
                held.append(marked[at:end])
                size += end - at
                at = end + len(mark)
                if size >= TOGETHER:
                    settle()
        settle()
        found = np.array(totals, complex)
        return found.real.tolist(), found.imag.astype(np.int64).tolist()

    def _sums(self, sections: list[bytes]) -> list[complex]:
        """The results of sections of marked texts, each distinct part worked out once."""
        split = pc.split_pattern(pa.array(sections, pa.large_binary()).cast(pa.large_string()), MARK)
        parts = split.flatten().dictionary_encode()
        each = self._parts(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        return np.add.reduceat(each, split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()).tolist()

    def _parts(self, parts: list[str]) -> np.ndarray:
        """Results of parts: words less their marks, or line ends and what follows them."""
        found = np.array([self.line_end if part.startswith("\n") else 0j for part in parts], complex)
        words = [part[1:] if part.startswith("\n") else MARK + part for part in parts]
        sizes = np.array([len(word) for word in words])
        for at in np.flatnonzero(sizes > SHORT).tolist():
            found[at] += complex(*self.word(words[at]))
        order = np.argsort(sizes, kind="stable")
        order = order[: np.searchsorted(sizes[order], SHORT, "right")]
        for start in range(0, len(order), ABREAST):
            some = order[start : start + ABREAST]
            own = sizes[some]
            chars = np.zeros((len(some), max(1, own[-1])), np.int64)
            chars[np.arange(chars.shape[1]) < own[:, None]] = np.frombuffer("".join([words[i] for i in some.tolist()]).encode("utf-32-le"), "<u4")
            found[some] += self.abreast.run(chars, own)
        return found

    def _sum(self, parts: list[str], total: complex) -> complex:
        """The results of parts added to ``total``: scores add up as real parts, pieces as imaginary ones."""
        found, at = [*map(self.cache.get, parts), None], -1
        while (at := found.index(None, at + 1)) < len(parts):
            part = parts[at]
            known = self.cache.get(part) or self.older.get(part) or self._new(part)
            if len(part) < 64:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache, self.older = {}, self.cache
                self.cache[part] = known
            found[at] = known
        return sum(found[:-1], total)


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    """The counter of a sentencepiece model file, once for each worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Counter([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())])


def counted(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, score) of each (doc_id, text)."""
    counter = load(model_path)
    for batch in batches:
        scores, numbers = counter.texts(text_bytes(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_tokens", "score"])


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of every row, over the whole text.

    Null texts count as empty, which have 0 tokens and score 0. Repeated rows stay, an empty table gives an empty one,
    other columns are ignored. ``model_path`` names a file that every worker has.
    """

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: counted(batches, model_path), "doc_id long, n_tokens long, score double")
