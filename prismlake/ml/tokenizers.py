"""Tokenizers of the text encoders: byte-level pairs with word ends, and word pieces."""

from __future__ import annotations

import heapq

import regex

# Fixed value: how the pair tokenizer parts a text into words.
WORDS = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """A printable letter for every byte: itself where it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTER = byte_letters()


class PairTokenizer:
    """Merges the neighbouring pair of lowest rank until none is left; padded with the end token to a fixed length."""

    def __init__(self, vocabulary: dict[str, int], ranks: dict[tuple[str, str], int], length: int = 77):
        self.vocabulary, self.ranks, self.length = vocabulary, ranks, length
        self.start, self.end = vocabulary["<|startoftext|>"], vocabulary["<|endoftext|>"]
        self.known: dict[str, list[str]] = {}

    def merge(self, word: str) -> list[str]:
        """The pieces of a word: neighbours joined by rising rank, from the left among equal ones.

        Pieces are a chain of positions; a heap holds the ranked pairs, and those of pieces that have changed are passed by.
        """
        if word in self.known:
            return self.known[word]
        piece = [*word[:-1], word[-1] + "</w>"]
        after, before = [*range(1, len(piece)), -1], [-1, *range(len(piece) - 1)]
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (rank := self.ranks.get((piece[i], piece[after[i]]))) is not None:
                heapq.heappush(heap, (rank, i, piece[i], piece[after[i]]))

        for i in range(len(piece)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if piece[i] != left or j < 0 or piece[j] != right:
                continue
            piece[i], piece[j] = left + right, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        self.known[word] = [p for p in piece if p]
        return self.known[word]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """(ids, mask)."""
        ids = [self.start]
        for word in WORDS.findall(" ".join(text.split()).lower()):
            ids += [self.vocabulary[p] for p in self.merge("".join(LETTER[b] for b in word.encode())) if p in self.vocabulary]
        ids = [*ids[: self.length - 1], self.end]
        return ids + [self.end] * (self.length - len(ids)), [1] * len(ids) + [0] * (self.length - len(ids))


class PieceTokenizer:
    """Longest known prefix first, continuations marked with ##; a word without one is unknown. Not padded."""

    def __init__(self, vocabulary: dict[str, int], length: int = 128, lower: bool = True, longest: int = 100):
        self.vocabulary, self.length, self.lower, self.longest = vocabulary, length, lower, longest

    def words(self, text: str) -> list[str]:
        text = regex.sub(r"[\x00�]|(?![\t\n\r])\p{C}", "", text)
        text = regex.sub(r"([\p{P}$+<=>^`|~\p{Han}])", r" \1 ", text)
        return (text.lower() if self.lower else text).split()

    def pieces(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word) <= self.longest:
            for end in range(len(word), at, -1):
                if (found := self.vocabulary.get(("##" if at else "") + word[at:end])) is not None:
                    break
            else:
                return [self.vocabulary["[UNK]"]]
            out.append(found)
            at = end
        return out or [self.vocabulary["[UNK]"]]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        ids = [self.vocabulary["[CLS]"]]
        for word in self.words(text):
            ids += self.pieces(word)
            if len(ids) >= self.length - 1:
                break
        ids = [*ids[: self.length - 1], self.vocabulary["[SEP]"]]
        return ids, [1] * len(ids)
