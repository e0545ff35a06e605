"""What a Python worker remembers of the words of the texts it has met."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

SLICE_CHARS = 1_000_000  # texts are worked on in slices of about so many characters


class Remembered:
    """Values of words in two generations of at most ``limit`` words each.

    A word that is asked for moves to the young generation. When that is full it becomes the old one,
    and what the old one still held is forgotten: words that return stay, words met once go.
    """

    def __init__(self, learn: Callable[[list[str]], dict], limit: int):
        self.learn, self.limit = learn, limit
        self.young: dict = {}
        self.old: dict = {}

    def resolve(self, words: Iterable[str]) -> dict:
        """A mapping that holds all of ``words``; new ones are learned in one call."""
        words = set(words)
        missing = [w for w in words if w not in self.young]
        if missing:
            old = self.old
            found = {w: old[w] for w in missing if w in old}
            if len(found) < len(missing):
                found |= self.learn([w for w in missing if w not in old])
            if len(self.young) + len(found) > self.limit:
                self.old = self.young
                self.young = {w: self.old[w] for w in words if w in self.old}
            self.young.update(found)
        return self.young


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters together; a longer text is a slice of its own."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
