"""Token counts under a unigram model, by dynamic programming shared over a trie of words.

The distinct pre-tokens of a batch are put in a trie.  The unigram forward scores of a
node (the best score of any segmentation of its prefix, and the number of pieces of that
segmentation) depend on the path from the root alone, so they are computed once for all
words that share the prefix: a node looks back over at most as many letters as the
longest piece has.  Terminal nodes store their counts, and a text's count is the sum over
its words.  Nothing is shuffled; a task holds the trie of one batch.

The scores are a unigram vocabulary's (piece -> log-probability), given as a mapping or
as a file; letters without a piece cost ``UNKNOWN`` each and count as a piece each.  Of segmentations with equal scores, the one
whose last piece is longest is counted.

Defined cases: null or empty text, or white space alone, has no tokens; repeated rows are
counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from minekit.llm.common import map_arrow, need, table

#: The mark that begins a word in the vocabulary.
SPACE = "▁"
#: Below the score of any piece, as unigram models set it.
UNKNOWN = 10.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str | None = None) -> dict[str, float]:
    """piece -> score of a vocabulary file's ordinary pieces.

    Scores of a unigram file are log-probabilities and are used as they are.  A BPE file
    has ranks of merges for scores; by Zipf's law a piece of rank r has a log-probability
    near -log(r + shift), which is what the model uses then.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    ids = [i for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
    ranks = all(p.get_score(i) == int(p.get_score(i)) for i in ids)
    return {p.id_to_piece(i): -float(np.log(i + 3.0)) if ranks else p.get_score(i) for i in ids}


class UnigramTrie:
    """Forward scores over words, each shared prefix once."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        # Suffix look-up: pieces by their last letter, backwards, so that a node tries only pieces that end there.
        self.backward: dict = {}
        for piece, score in scores.items():
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    def count(self, words: list[str]) -> np.ndarray:
        """Pieces of each word (words in ascending order share their prefixes).

        Sorted words visit the trie depth first: the path from the root is a stack of
        (best score, pieces), kept as far as the next word shares it.
        """
        out = np.zeros(len(words), np.int64)
        best, pieces, last = [0.0], [0], ""
        backward, unknown = self.backward, self.unknown
        for i, word in enumerate(words):
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared, len(word)):
                top, n = best[end] + unknown, pieces[end] + 1
                node, k = backward, end
                while k >= 0 and (node := node.get(word[k])) is not None:
                    score = node.get("")
                    if score is not None and best[k] + score >= top:
                        top, n = best[k] + score, pieces[k] + 1
                    k -= 1
                best.append(top)
                pieces.append(n)
            out[i], last = pieces[-1], word
        return out


_tries: dict[str | None, UnigramTrie] = {}


def trie(path: str | None = None) -> UnigramTrie:
    if path not in _tries:
        _tries[path] = UnigramTrie(piece_scores(path))
    return _tries[path]


def token_counts(docs: DataFrame, *, vocabulary: str | None = None, scores: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every document, by ``scores`` (piece -> log-probability) or those of a vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = UnigramTrie(scores) if scores is not None else trie(vocabulary)
        for batch in batches:
            split = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            ends = np.asarray(split.offsets)
            coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            order = np.asarray(pc.sort_indices(coded.dictionary))
            words = coded.dictionary.take(pa.array(order)).to_pylist()
            counts = np.zeros(len(order), np.int64)
            counts[order] = np.where([bool(w) for w in words], model.count([SPACE + w for w in words]), 0) if words else 0
            index = np.asarray(coded.indices)
            sums = np.concatenate([[0], np.cumsum(counts[index])])
            full = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(coded.dictionary)).astype(np.int64)[index] > 0)]) if len(index) else np.zeros(1, np.int64)
            at = ends - ends[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(full[at])), pa.array(np.diff(sums[at]))], names=["doc_id", "n_words", "n_tokens"]
            )

    return map_arrow(need(docs, "doc_id", "text"), run, "doc_id long, n_words long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
