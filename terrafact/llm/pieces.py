"""Operator 4: SentencePiece encoding and decoding.

A merge-type model (every adjacent pair whose join is a piece may merge, best score first, then
leftmost) is encoded without a merge loop over the text: Aho-Corasick finds the longest piece at
every position, neighbouring pieces must be what merging the two together again would give, and
where no piece fits, the position is set in a bitfield of failed positions and the search goes
one piece back. A sequence whose neighbours all fit is the encoding.

Words are encoded on their own where no piece holds a space mark behind another character (so
nothing merges across); otherwise the text is one word. Encoded words are remembered per worker, up
to `MEMORY` words.

Edge cases: null counts as an empty text, an empty text has no ids and decodes to an empty text;
characters without a piece become their bytes' pieces (or the unknown id); rows are independent, so
repeated rows, null ids and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

#: Words and pairs that one Python worker remembers before it starts anew.
MEMORY = 400_000
PAIRS = 1_000_000

MARK = "▁"
NORMAL = 0


class PieceModel:
    """A merge-type model with the identity normaliser."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unk = sp.unk_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if sp.is_byte(i)}
        self.has_bytes = len(self.byte_of) == 256
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.length = [len(p) for p in self.pieces]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        # Pieces that merging can give, how each came about, and the longest shorter one that it starts with.
        self.halves: dict[str, tuple[str, str]] = {}
        own = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.late = {p: -s for p, s in self.score.items()}  # merges come in this order
        # The order of merges can be undone step by step where a piece is merged after its halves and no two at once.
        tied = {s for s, n in Counter(self.score.values()).items() if n > 1}
        self.plain = {
            self.ids[p] for p in own
            if len(p) == 1 or self.score[p] not in tied and all(len(h) == 1 or self.late[h] < self.late[p] for h in self.halves[p])
        }
        self.automaton = ahocorasick.Automaton()
        for p in own:
            self.automaton.add_word(p, (self.ids[p], len(p)))
        self.automaton.make_automaton()
        self.shorter = [-1] * n
        for p in own:
            for k in range(len(p) - 1, 0, -1):
                if p[:k] in own:
                    self.shorter[self.ids[p]] = self.ids[p[:k]]
                    break

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text, for the checks of pairs."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joined:
                continue
            if joined == text:
                self.halves[text] = (parts[i], parts[j])
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def remerged(self, a: str, b: str) -> bool:
        """Whether no merge crosses between two pieces: their merges next to the border are taken
        back, the latest first, and what then meets must not merge before the one taken back last."""
        late, halves = self.late, self.halves
        limit = float("inf")
        while True:
            crossing = late.get(a + b)
            if crossing is not None and crossing < limit:
                return False
            x = late[a] if len(a) > 1 else -1.0
            y = late[b] if len(b) > 1 else -1.0
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = x, halves[a][1]
            else:
                # merging is leftmost first: of equal merges the one that crosses comes before b's
                limit, b = math.nextafter(y, math.inf), halves[b][0]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging both pieces' text again leaves just these two."""
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            one, two = self.pieces[a], self.pieces[b]
            plain = a in self.plain and b in self.plain
            known = self._pairs[key] = self.remerged(one, two) if plain else self.merge(one + two) == [one, two]
        return known

    def _segment(self, longest: list[int], lo: int, hi: int) -> list[int]:
        """Ids of the characters [lo, hi), all of which have pieces."""
        out: list[int] = []
        pairs, length, shorter = self._pairs, self.length, self.shorter
        failed, pos = 0, lo
        token = longest[lo]
        while pos < hi:
            last = out[-1] if out else -1
            while token >= 0:
                end = pos + length[token]
                if end <= hi and not (failed >> (end - lo)) & 1:
                    if last < 0:
                        break
                    ok = pairs.get(last << 20 | token)
                    if ok or ok is None and self.fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += length[token]
                token = longest[pos] if pos < hi else -1
            else:
                failed |= 1 << (pos - lo)
                token = out.pop()
                pos -= length[token]
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a text in which nothing has to be split."""
        n = len(word)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(word):
            longest[end - size + 1] = token  # later ends are longer
        # Where the longest pieces fit each other, there is nothing to take back.
        pairs, length = self._pairs, self.length
        out: list[int] = []
        pos = last = 0
        while pos < n:
            token = longest[pos]
            if token < 0 or last and not pairs.get(last << 20 | token):
                return self._searched(word, longest)
            out.append(token)
            pos += length[token]
            last = token
        return tuple(out)

    def _searched(self, word: str, longest: list[int]) -> tuple[int, ...]:
        n = len(word)
        out: list[int] = []
        lo = 0
        while lo < n:
            if longest[lo] < 0:
                out += [self.bytes[b] for b in word[lo].encode()] if self.has_bytes else [self.unk]
                lo += 1
                continue
            hi = lo + 1
            while hi < n and longest[hi] >= 0:
                hi += 1
            out += self._segment(longest, lo, hi)
            lo = hi
        return tuple(out)

    def words(self, text: str) -> list[str]:
        """A text with its space marks, cut where no merge crosses."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.by_word else [marked]

    def ids_of(self, word: str) -> tuple[int, ...]:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= MEMORY:
                self._words.clear()
            found = self.encode_word(word)
            if len(word) <= 64:
                self._words[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.ids_of(w)]

    def surface(self, ids: tuple[int, ...] | list[int]) -> str:
        """What ids stand for, with space marks; bytes in a row are decoded together."""
        out: list[str] = []
        run = bytearray()
        for i in (*ids, -1):
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i < 0 or i in self.control:
                continue
            out.append(" ⁇ " if i == self.unk else self.pieces[i])
        return "".join(out)

    def text_of(self, surface: str) -> str:
        """A surface without the mark that encoding put in front, its marks as spaces."""
        return surface.removeprefix(MARK).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.text_of(self.surface(ids))


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One per worker process and file."""
    return PieceModel(path)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the general operator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = [m.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids])],
                ["doc_id", "ids", "decoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row. Each distinct word is encoded, and
    its ids decoded, once while it is remembered; a text costs little more than looking its words up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        known: dict[str, str] = {}
        changed: dict[str, str] = {}  # words whose ids stand for another text than the word

        def look(word: str) -> str:
            if len(known) >= MEMORY:
                known.clear()
                changed.clear()
            ids = m.encode_word(word)
            if (surface := m.surface(ids)) != word:
                changed[word] = surface
            found = ",".join(map(str, ids))
            if len(word) <= 64:
                known[word] = found
            return found

        for batch in batches:
            counts, coded, plain = [], [], []
            for text in batch.column("text"):
                get = known.get
                words = m.words(text.as_py() or "")
                ids = ",".join([get(w) or look(w) for w in words])
                surface = "".join([changed.get(w, w) for w in words] if changed else words)
                counts.append(ids.count(",") + 1 if ids else 0)
                coded.append(hashlib.sha256(ids.encode()).hexdigest())
                plain.append(hashlib.sha256(m.text_of(surface).encode()).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
