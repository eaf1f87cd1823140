"""Token counts of a unigram vocabulary, with the scores of shared prefixes computed once.

The distinct pre-tokens of a bounded slice of texts are visited in the order of a trie, depth first: sorted, each
shares with the one before it the path from the root down to their longest common prefix. The best forward score of
every node on the path, and the tokens it takes, stay on a stack, so they are computed once for all pre-tokens below
it; a pre-token's terminal node gives its count, which is stored. A text's count is the sum over its words.

A piece's log-probability follows from its rank in the vocabulary file by Zipf's law, as the files hold merge ranks and
no tokenizer is trained here. Scores are whole millionths, so that sums are exact and ties are true ties: of equal
scores the one with fewer tokens wins. A character that no piece covers counts as its UTF-8 bytes.

Defined cases: NULL counts as the empty text, with no tokens; equal rows are counted separately; an empty table
gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm import text as T
from platewise.llm.wordbpe import texts_of

CACHE = 500_000
SPACE = "▁"  # stands for the space before a word in vocabulary files


def zipf_scores(pieces: list[str]) -> dict[str, int]:
    """Millionths of the log-probability of each piece, most frequent first, under Zipf's law."""
    total = math.log(sum(1 / (rank + 2.7) for rank in range(len(pieces))))
    return {piece: round(-1e6 * (math.log(rank + 2.7) + total)) for rank, piece in enumerate(pieces)}


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Scores of the ordinary pieces of a sentence-piece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return zipf_scores([model.id_to_piece(i) for i in range(model.get_piece_size())
                        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))])


def trie_counts(words: Iterable[str], scores: dict[str, int]) -> dict[str, int]:
    """Tokens of the best segmentation of each distinct word."""
    longest = max(map(len, scores), default=1)
    bytes_score = min(scores.values(), default=0) - 10_000_000
    find = scores.get
    out: dict[str, int] = {}
    before, best, tokens = "", [0], [0]
    for word in sorted(set(words)):
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1:], tokens[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, count = best[end - 1] + size * bytes_score, tokens[end - 1] + size
            for start in range(max(0, end - longest), end):
                own = find(word[start:end])
                if own is not None:
                    score = best[start] + own
                    if score > top or score == top and tokens[start] + 1 < count:
                        top, count = score, tokens[start] + 1
            best.append(top)
            tokens.append(count)
        out[word] = tokens[-1]
        before = word
    return out


@functools.lru_cache(maxsize=2)
def _known(path: str) -> dict[bytes, int]:
    return {}


def token_counts(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_words, n_tokens) of every whole text. Nothing is shuffled; a task's table of words is bounded."""
    part = docs.select(F.col(id_column), F.col(text).alias("__text"))

    def count(batches):
        known, scores = _known(path), vocabulary(path)
        for batch in batches:
            for piece in T.slices(batch, 1):
                words = [x.split() for x in texts_of(piece.column(1))]
                missing = set().union(*words).difference(known)
                if len(known) + len(missing) > CACHE:
                    known.clear()
                    missing = set().union(*words)
                found = trie_counts((SPACE + w.decode() for w in missing), scores)
                known.update((w, found[SPACE + w.decode()]) for w in missing)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(map(len, words), pa.int64()),
                     pa.array((sum(map(known.__getitem__, own)) for own in words), pa.int64())],
                    [id_column, "n_words", "n_tokens"])

    return part.mapInArrow(count, f"`{id_column}` {part.schema[0].dataType.simpleString()}, n_words long, n_tokens long")
