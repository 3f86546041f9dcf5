"""Token counts of a unigram tokenizer by count-only Viterbi.

Aho-Corasick enumerates every vocabulary piece that ends at each character; dynamic programming
carries, per position, the best score and the number of pieces of the best path, and nothing else.
Rules are those of the tokenizers library's Unigram model: white space becomes U+2581 and starts
the next word (Metaspace, prefix added), each word is segmented alone, a character that is no piece
by itself may stand alone at the least score minus 10 and counts as its UTF-8 bytes (byte
fallback), and of equal scores the path whose last piece starts first wins.

The vocabulary is the piece list of a public sentencepiece file with its own scores, read as a
unigram vocabulary; the path is a parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 400_000  # words a worker remembers; beyond, it starts anew


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for piece, score in dict(vocab).items():
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of one word."""
        n = len(word)
        score = [0.0] + [-np.inf] * n
        count = [0] * (n + 1)
        at, single = 0, False  # the position whose matches are being read, longest first
        unknown = self.unknown

        def close(end: int) -> None:
            if not single and score[end - 1] + unknown > score[end]:
                score[end], count[end] = score[end - 1] + unknown, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))

        for last, (length, own) in self.trie.iter(word):
            end = last + 1
            while at < end:
                if at:
                    close(at)
                at, single = at + 1, False
            if length == 1:
                single = True
            if (s := score[end - length] + own) > score[end]:
                score[end], count[end] = s, count[end - length] + 1
        while at <= n:
            if at:
                close(at)
            at, single = at + 1, False
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty have none."""
        if not text:
            return 0
        line = text.replace(" ", SPACE)
        parts = (line if line[0] == SPACE else SPACE + line).split(SPACE)[1:]
        known = self.known
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in parts:
                if w not in known:
                    known[w] = self.word(SPACE + w)
            return sum(map(known.__getitem__, parts))


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long) for every row of docs."""

    def run(batches):
        key = path or default_path()
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(vocabulary(key))
        c = _COUNTERS[key]
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t) for t in b.column(1).to_pylist()], pa.int64())], ["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, n_tokens long")
