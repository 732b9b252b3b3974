"""SentencePiece encoding and decoding (operator 10) and count-only Viterbi (operator 7).

Both work on a public piece vocabulary, read from its model file by the sentencepiece library, which is
asked for the pieces and scores only.  A text is normalised as the model says (a space in front, spaces
written as U+2581).  No piece has U+2581 after another character, so a text's encoding is that of its
words, each with the U+2581 before it, one after another; a bounded cache keeps what repeated words give.

Defined results: null and empty texts have no ids, 0 tokens and an empty decoding; characters outside
the vocabulary become the byte pieces of their UTF-8; runs of spaces and very long words are handled by
the same rules; repeated rows give equal values; other columns are not touched.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitrine.llm.common import BoundedCache, map_texts

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
UNKNOWN = -2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and an Aho-Corasick automaton over the pieces that texts can match."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[int, float] = {}
        self.pieces: list[str] = []
        self.byte_id: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.pieces.append(piece)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.score[i] = model.get_score(i)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.chars = frozenset(p for p in self.ids if len(p) == 1)
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in self.byte_id.items()}
        self.fits: dict[int, bool] = {}
        self.min_score = min(self.score.values())

    def fallback(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "replace")]

    def merge(self, word: str) -> list[int]:
        """Byte-pair merging by the definition: best score first, leftmost among equals."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts):
                i = self.ids.get(parts[left] + parts[right])
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], left, parts[left], parts[right]))

        for k in range(len(parts) - 1):
            offer(k)
        while heap:
            _, left, a, b = heapq.heappop(heap)
            if parts[left] != a or (right := after[left]) >= len(parts) or parts[right] != b:
                continue
            parts[left], parts[right] = a + b, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        out: list[int] = []
        for part in parts:
            if part is not None:
                out += [self.ids[part]] if part in self.ids else self.fallback(part)
        return out

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two pieces, side by side, stay as they are under merging."""
        key = first << 20 | second
        found = self.fits.get(key)
        if found is None:
            found = self.merge(self.pieces[first] + self.pieces[second]) == [first, second]
            if len(self.fits) >= 2_000_000:
                self.fits.clear()
            self.fits[key] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """The ids of a word from its prefix table.

        The encoding of each prefix has one last piece: the match that ends there and is compatible
        with the last piece of the prefix before it.  Ids are then read off from the end.  Runs of spaces,
        whose pieces share one score, are words like others.  Were a prefix ever without a last piece, the word
        would be merged by the definition.
        """
        n, fits, compatible = len(word), self.fits, self.compatible
        last = [-1] * (n + 1)
        if not self.chars.issuperset(word):
            for k, c in enumerate(word):
                if c not in self.chars:
                    last[k + 1] = UNKNOWN
        for end, (i, size) in self.automaton.iter(word):
            end += 1
            if last[end] == -1:
                start = end - size
                if start == 0 or (before := last[start]) == UNKNOWN:
                    last[end] = i
                else:
                    found = fits.get(before << 20 | i)
                    if found or found is None and compatible(before, i):
                        last[end] = i
        ids: list[int] = []
        while n:
            i = last[n]
            if i == -1:
                return self.merge(word)
            if i == UNKNOWN:
                ids += self.fallback(word[n - 1])[::-1]
                n -= 1
            else:
                ids.append(i)
                n -= len(self.pieces[i])
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")

    def count_word(self, word: str) -> tuple[int, int]:
        """(pieces, score) of the best segmentation of a word under the scores as a unigram model.

        Matches come by end and, for one end, from the longest to the shortest; only a better score
        replaces a found one, so the earliest start wins ties, as in the tokenizer.
        """
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0
        score = self.score
        outside = [] if self.chars.issuperset(word) else [k for k, c in enumerate(word) if c not in self.chars]
        penalty = self.min_score - 10
        done = 0
        for end, (i, size) in self.automaton.iter(word):
            while outside and outside[0] <= end - size:
                k = outside.pop(0)
                best[k + 1], count[k + 1] = best[k] + penalty, count[k] + len(word[k].encode("utf-8", "replace"))
            end += 1
            start = end - size
            got = best[start] + score[i]
            if best[end] is None or got > best[end]:
                best[end], count[end] = got, count[start] + 1
            done = end
        for k in outside:
            best[k + 1], count[k + 1] = best[k] + penalty, count[k] + len(word[k].encode("utf-8", "replace"))
        return count[n], int(best[n]) if done or n else 0


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_of(text: str | None) -> list[str]:
    """The normalised words of a text; one that has one space in front stands without it here."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] if w[1:2] not in ("", SPACE) else w for w in WORDS.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def whole(word: str) -> str:
    return word if word[0] == SPACE else SPACE + word


class _WordIds(BoundedCache):
    """The ids of words, in two generations: a word that is asked for again moves from the old one to the new, so
    frequent words are worked out once, however many rare ones pass through."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__(400_000)
        self.vocab = vocab
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = np.array(self.vocab.encode_word(whole(word)), np.int32).tobytes()
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[word] = found
        return found


class _WordCounts(BoundedCache):
    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> tuple[int, int]:
        self.room(1)
        found = self[word] = self.vocab.count_word(whole(word))
        return found


_KEPT: dict[tuple[type, str], BoundedCache] = {}


def kept(kind: type, model: str) -> BoundedCache:
    """The cache of this Python worker: tasks that follow each other in it share one."""
    if (kind, model) not in _KEPT:
        _KEPT[kind, model] = kind(vocabulary(model))
    return _KEPT[kind, model]


def encode_pieces(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: the piece ids of each text."""
    model = model or default_model()

    def make():
        cache = kept(_WordIds, model)

        def run(texts):
            got = [b"".join([cache[w] for w in words_of(t)]) for t in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in got)], dtype=np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))}

        return run

    return map_texts(docs, make, [("ids", "array<int>", pa.list_(pa.int32()))], id_col, text_col)


def encode_decode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded string: encoding, and the text that its ids give back."""
    model = model or default_model()

    def make():
        cache, vocab = kept(_WordIds, model), vocabulary(model)
        table = np.array([vocab.bytes_of.get(i, b"") for i in range(len(vocab.pieces))], object)

        def run(texts):
            got = [np.frombuffer(b"".join([cache[w] for w in words_of(t)]), np.int32) for t in texts]
            ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
            decoded = [b"".join(table[x].tolist()).decode("utf-8", "replace").removeprefix(" ") for x in got]
            ids = pa.array(np.concatenate(got) if got else np.zeros(0, np.int32))
            return {"ids": pa.ListArray.from_arrays(pa.array(ends), ids), "decoded": decoded}

        return run

    return map_texts(docs, make, [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())], id_col, text_col)


def count_tokens(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens long, score long: pieces and summed score of the best segmentation of each text.

    Sums are exact integers when the model's scores are; the tokenizer library adds 32-bit floats, whose
    rounding can decide between segmentations of very long inputs.
    """
    model = model or default_model()

    def make():
        cache = kept(_WordCounts, model)

        def run(texts):
            n, score = [], []
            for t in texts:
                found = [cache[w] for w in words_of(t)]
                n.append(sum([x[0] for x in found]))
                score.append(sum([x[1] for x in found]))
            return {"n_tokens": n, "score": score}

        return run

    return map_texts(docs, make, [("n_tokens", "long", pa.int64()), ("score", "long", pa.int64())], id_col, text_col)
