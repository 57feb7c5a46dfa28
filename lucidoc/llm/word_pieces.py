"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary's trie gets, for each node v, a failure link and a number of popped tokens: when no
edge leads on from v, the greedy tokenizer would cut that many tokens off the front of the node's
string, and what is left is the string of the link's node. So a text's count comes from one pass
over its characters without going back and without building pieces.

The automaton takes a set of pieces that begin words and one of pieces that continue them, so it fits vocabularies that mark
word ends ("</w>" after the last piece, the same set twice) as well as those that mark continuations. `WordPieceCounter` reads files of the first kind.
A file whose own algorithm is merging pairs may split a word in more pieces than greedy matching does: this counts word pieces, not its tokens.
"""

from __future__ import annotations

import json
from functools import partial

import regex
from pyspark.sql import DataFrame

from .common import Memory, per_document
from .encoding import shown_bytes

END = "\x00"


class LongestMatch:
    """Counts greedy longest-match pieces of words.

    `pieces`: those that begin a word and those that continue one (the same set for vocabularies
    with word ends). A word that greedy matching can't cover counts as one unknown token.
    """

    def __init__(self, first: set[str], further: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # nodes 0 and 1: the roots of a word and of a continuation
        self.ends: list[bool] = [False, False]
        for root, words in ((0, first), (1, further)):
            for word in words:
                node = root
                for c in word:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.ends.append(False)
                    node = self.next[node][c]
                self.ends[node] = True
        self._link()

    def _link(self) -> None:
        """Breadth first, so that a node's parent and all shorter nodes are done before it."""
        n = len(self.next)
        self.fail: list[int] = [-1] * n
        self.popped: list[int] = [0] * n
        queue = [0, 1]
        for v in queue:
            for c, u in self.next[v].items():
                queue.append(u)
                if self.ends[u]:
                    self.fail[u], self.popped[u] = 1, 1
                    continue
                z, popped = self.fail[v], self.popped[v]
                while z >= 0 and c not in self.next[z]:
                    popped += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[u], self.popped[u] = self.next[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of a word, 1 if it can't be covered, 0 for no characters."""
        if not word:
            return 0
        follow, fail, pops = self.next, self.fail, self.popped
        node = count = 0
        for c in word:
            while c not in follow[node]:
                count += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = follow[node][c]
        while node > 1:  # what the last node still holds
            count += pops[node]
            node = fail[node]
        return count if node == 1 else 1


#: The pre-tokenizer of public byte-level vocabularies with word ends.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordPieceCounter:
    """Token counts of texts under a `tokenizers` file with word ends, by greedy longest match.

    `remember` bounds the blank-separated chunks whose count is kept.
    """

    def __init__(self, path: str, remember: int = 400_000, longest: int = 48):
        import unicodedata

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        pieces = {w[:-4] + END if w.endswith("</w>") else w for w in vocabulary}
        self.match = LongestMatch(pieces, pieces)
        self.normal = partial(unicodedata.normalize, "NFC")
        self.shown = shown_bytes()
        self.remember = remember
        self.known = Memory(self.chunk, longest)

    def chunk(self, chunk: str) -> tuple[int, int]:
        """Words and pieces of a chunk."""
        words = PRE_TOKEN.findall(self.normal(chunk).lower())
        return len(words), sum(self.match.count(w.encode().decode("latin-1").translate(self.shown) + END) for w in words)

    def count(self, texts: list[str | None]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {"n_words": [], "n_tokens": []}
        self.known.begin(self.remember)
        get = self.known.__getitem__
        for text in texts:
            counts = [get(c) for c in (text or "").split()]
            out["n_words"].append(sum(n for n, _ in counts))
            out["n_tokens"].append(sum(n for _, n in counts))
        return out


_counters: dict[str, WordPieceCounter] = {}


def _count(path: str, texts: list) -> dict:
    if path not in _counters:
        _counters[path] = WordPieceCounter(path)
    return _counters[path].count(texts)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words (pre-tokens) and n_tokens (greedy longest-match pieces) of each whole text.

    Null and empty texts have 0 of both. Repeated rows are counted each. An empty table gives no
    rows. Other columns are ignored.
    """
    return per_document(docs, partial(_count, path), "n_words long, n_tokens long")
