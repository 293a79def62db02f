"""Token counts by a linear longest-match automaton.

A word piece tokenizer takes, from the left, the longest piece of its vocabulary, again and again. Here the vocabulary is a trie in which
each node knows, for when the next character leads nowhere, how many tokens the longest matches within its string would have given
(`popped`) and at which node the rest of that string stands (`fail`). A word's token count comes from one pass over its characters; no piece
is ever built. A character that no piece begins with counts as its UTF-8 bytes, as byte fallback does.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, encode

#: A vocabulary travels with the tasks, so its size is bounded. Word lengths remembered by a task.
MOST_PIECES, REMEMBERED = 2_000_000, 200_000
#: What stands before each word in this kind of vocabulary.
MARK = "▁"


class Automaton:
    """children[node]: next node by character; token weights are 1, or the bytes of a character that is no piece itself."""

    def __init__(self, pieces: Iterable[str], mark: str = MARK):
        self.mark = mark
        self.children: list[dict[str, int]] = [{}]
        weight = [0]

        def add(piece: str, n: int) -> None:
            node = 0
            for c in piece:
                after = self.children[node].get(c)
                if after is None:
                    after = self.children[node][c] = len(self.children)
                    self.children.append({})
                    weight.append(0)
                node = after
            weight[node] = weight[node] or n

        characters: set[str] = set()
        for count, piece in enumerate(pieces):
            if count >= MOST_PIECES:
                raise ValueError(f"more than {MOST_PIECES} pieces")
            if piece:
                add(piece, 1)
                characters.update(piece)
        for c in sorted(characters):
            add(c, len(encode(c)))
        self.fail, self.popped = [0] * len(self.children), [0] * len(self.children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.children[parent].items():
                queue.append(node)
                if weight[node]:
                    self.fail[node], self.popped[node] = 0, weight[node]
                    continue
                at, popped = self.fail[parent], self.popped[parent]
                while c not in self.children[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                self.fail[node], self.popped[node] = self.children[at][c], popped

    def count(self, word: str) -> int:
        """Tokens of a word without white space."""
        children, fail, popped = self.children, self.fail, self.popped
        node = total = 0
        for c in self.mark + word:
            after = children[node].get(c)
            while after is None:
                if not node:
                    total += len(encode(c))
                    after = 0
                    break
                total += popped[node]
                node = fail[node]
                after = children[node].get(c)
            node = after
        while node:
            total += popped[node]
            node = fail[node]
        return total


class Counter(dict):
    """Token count by word as UTF-8; forgets all when it has grown too large."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def sentencepiece_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model: no control, unknown, byte or unused ones."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not any(f(k) for f in special)]


def token_counts(docs: DataFrame, pieces: Iterable[str], doc_id: str = "doc_id", text: str = "text", mark: str = MARK) -> DataFrame:
    """One row for each row of docs: (doc_id, n_words, n_tokens) by greedy longest match of `mark` + word over the pieces.

    Words are runs of anything but ASCII white space. Null and empty texts have no words; of very long texts and words every character counts. A null id is
    kept. Repeated rows count alike; an empty table gives no rows; other columns are ignored. An empty vocabulary counts UTF-8 bytes.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces, mark))

    @F.arrow_udf("struct<n_words:long,n_tokens:long>")
    def counted(texts: pa.Array) -> pa.Array:
        counter = getattr(shared, "counter", None)
        if counter is None:
            counter = shared.counter = Counter(shared.value)
        sizes, tokens = [], []
        for text in texts:
            words = encode(text.as_py() or "").split()
            sizes.append(len(words))
            tokens.append(sum(map(counter.__getitem__, words)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["n_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), counted(F.col(text)).alias("of"))
    return rows.select("doc_id", "of.n_words", "of.n_tokens")
