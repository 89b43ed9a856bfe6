"""Token counts under a unigram model, by dynamic programming over a shared trie.

A text's pre-tokens are its runs of non-white-space, each led by the word mark of the vocabulary.
Distinct pre-tokens are inserted in a trie; a node's forward score - the best log probability of any
segmentation of its prefix - depends on the prefix alone, so it is computed once per node, from the
scores of its ancestors, and shared by all pre-tokens that pass through it.  Terminal nodes store
the token count of the best segmentation.

The vocabulary is a piece file; probabilities follow the pieces' ranks by Zipf's law.  A character
outside the vocabulary falls back to its UTF-8 bytes, one token each.  Of equally probable
segmentations, that with the longest last piece counts.

Each Python worker keeps its trie between batches and starts a new one when it holds
``MAX_NODES``, which bounds memory and changes no result.

Defined results: null, empty and blank texts have 0 tokens; repeated rows are each counted; very
long pre-tokens are handled whole, outside the trie.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_NODES = 1_000_000
#: Longer pre-tokens are not kept in the trie.
LONG = 64


@dataclass
class Unigram:
    """Log probabilities of pieces; ``byte_score`` is that of one fallback byte."""

    score: dict[str, float]
    byte_score: float
    longest: int

    @classmethod
    def of_pieces(cls, pieces: list[str]) -> Unigram:
        """Pieces in order of rank; the probability of rank r is in proportion to 1 / (r + 1)."""
        norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        score: dict[str, float] = {}
        for r, piece in enumerate(pieces):
            score.setdefault(piece, -math.log(r + 1) - norm)
        return cls(score, -math.log(len(pieces) + 1) - norm - 10.0, max(map(len, pieces), default=1))

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Unigram:
        """Reads a sentencepiece file on the driver; its control and byte pieces are left out."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        return cls.of_pieces([sp.id_to_piece(i) for i in sorted(plain, key=lambda i: -sp.get_score(i))])


def step(model: Unigram, text: str, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
    """Forward score and token count of ``text[:end]``, given those of all shorter prefixes."""
    top, tokens = -math.inf, 0
    score = model.score
    for start in range(max(0, end - model.longest), end):
        s = score.get(text[start:end])
        if s is not None and best[start] + s > top:
            top, tokens = best[start] + s, count[start] + 1
    if score.get(text[end - 1]) is None:
        n = len(text[end - 1].encode("utf-8", "surrogatepass"))
        if best[end - 1] + n * model.byte_score > top:
            top, tokens = best[end - 1] + n * model.byte_score, count[end - 1] + n
    return top, tokens


@dataclass
class Trie:
    """Nodes are numbered; ``child`` maps (node, character) to a node.  ``ends`` holds every suffix of
    every piece, with the piece's score if it is one, so that a search for pieces that end at a node
    stops at the first suffix that no piece has."""

    model: Unigram
    child: dict[tuple[int, str], int] = field(default_factory=dict)
    best: list[float] = field(default_factory=lambda: [0.0])
    count: list[int] = field(default_factory=lambda: [0])
    terminal: dict[bytes, int] = field(default_factory=dict)
    ends: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.ends:
            for piece in self.model.score:
                for at in range(1, len(piece)):
                    self.ends.setdefault(piece[at:], -math.inf)
            self.ends.update(self.model.score)

    def renewed(self) -> Trie:
        return Trie(self.model, ends=self.ends)

    def tokens(self, word: bytes) -> int:
        """The token count of a pre-token, given as UTF-8 without its mark."""
        text = MARK + word.decode("utf-8", "replace")
        if len(text) > LONG:
            return self.alone(text)
        child, best, count, ends = self.child, self.best, self.count, self.ends
        node, path, counts = 0, [0.0], [0]
        shared = 0
        for c in text:
            known = child.get((node, c))
            if known is None:
                break
            node = known
            path.append(best[node])
            counts.append(count[node])
            shared += 1
        for end in range(shared + 1, len(text) + 1):
            top, tokens, start = -math.inf, 0, end - 1
            while start >= 0:
                s = ends.get(text[start:end])
                if s is None:
                    break
                s += path[start]
                if s > top or (s == top and s > -math.inf):
                    top, tokens = s, counts[start] + 1
                start -= 1
            c = text[end - 1]
            if c not in self.model.score:
                n = len(c.encode("utf-8", "surrogatepass"))
                s = path[end - 1] + n * self.model.byte_score
                if s > top:
                    top, tokens = s, counts[end - 1] + n
            child[node, c] = node = len(best)
            best.append(top)
            count.append(tokens)
            path.append(top)
            counts.append(tokens)
        self.terminal[word] = counts[-1]
        return counts[-1]

    def alone(self, text: str) -> int:
        best, count = [0.0], [0]
        for end in range(1, len(text) + 1):
            top, tokens = step(self.model, text, end, best, count)
            best.append(top)
            count.append(tokens)
        return count[-1]


#: The trie of this Python worker, kept between tasks: the vocabulary's identity and the trie.
_worker: dict[str, Trie] = {}


def _count(name: str, model: Unigram, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = _worker.get(name) or Trie(model)
    for batch in batches:
        n_words = np.zeros(batch.num_rows, np.int64)
        n_tokens = np.zeros(batch.num_rows, np.int64)
        for i, cell in enumerate(batch.column(1)):
            if not cell.is_valid:
                continue
            words = cell.as_buffer().to_pybytes().split()
            known = trie.terminal
            found = list(map(known.get, words))
            if None in found:
                for at, n in enumerate(found):
                    if n is None:
                        found[at] = known.get(words[at]) or trie.tokens(words[at])
                if len(trie.best) > MAX_NODES:
                    trie = trie.renewed()
            n_words[i], n_tokens[i] = len(words), sum(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], names=["id", "n_words", "n_tokens"])
    _worker.clear()
    _worker[name] = trie


def token_counts(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words (pre-tokens) and n_tokens of every row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary: its file's size bounds it
    name = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()
    cells = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return cells.mapInArrow(lambda batches: _count(name, held.value, batches), f"id {kind}, n_words long, n_tokens long")


def op9_tokens(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), Unigram.load(vocabulary))
    return counted.withColumnRenamed("id", "doc_id")
