"""Encode whole texts with a public word BPE, byte for byte as the tokenizers library does.

The vocabulary drops white space and never forms a token across it, so the ids of a
text are the ids of its space-separated chunks in order.  Arrow splits a batch of
texts into chunks and finds the distinct ones; the library encodes those, many joined
by spaces in a call, and ids that end a word show where each chunk ends.  The texts'
ids are then gathered by chunk.  Nothing is kept from batch to batch.  Texts with
special-token strings go to the library whole.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks joined in a call, and words of texts gathered at a time.
JOINED, GATHERED = 1000, 200_000
END_OF_WORD = "</w>"
#: Words of letters that stay letters when lowered and composed.  The vocabulary's pattern cuts such a
#: word from a run of ASCII punctuation after it.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ſА-яё]+"
PUNCTUATION = string.punctuation


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """texts -> little-endian id bytes (two bytes an id where the vocabulary fits, else four)."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or default_vocabulary())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The same model for plain words, without the steps that leave them as they are.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.normalizer = normalizers.Lowercase()
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith(END_OF_WORD)]] = True

    def _library(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        tokenizer = tokenizer or self.tokenizer
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [np.array(x.ids, self.dtype) for x in encode(texts, add_special_tokens=False)]

    def _alone(self, chunks: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        ids = self._library(chunks)
        return ids, np.array([len(x) for x in ids], np.int64)

    def _joined(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of plain words, in order, and how many each has."""
        made, sizes = [], []
        for i in range(0, len(words), JOINED):
            group = words.slice(i, JOINED)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group), " ")[0].as_py()
            ids = self._library([text], self.words)[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):
                made.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:  # not a vocabulary with word ends
                ids, n = self._alone(group.to_pylist())
                made += ids
                sizes.append(n)
        return made, np.concatenate(sizes) if sizes else np.zeros(0, np.int64)

    def _chunks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunks in some order; for each chunk two first places there, and two sizes: word and punctuation."""
        core = pc.utf8_rtrim(words, PUNCTUATION)
        plain = np.asarray(pc.match_substring_regex(core, PLAIN + "$"))
        at, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        cores = core.take(pa.array(at)).dictionary_encode()
        tails = pc.replace_substring_regex(words.take(pa.array(at)), PLAIN, "").dictionary_encode()
        made, n_cores = self._joined(cores.dictionary)
        ids, n_tails = self._alone(tails.dictionary.to_pylist())
        others, n_others = self._alone(words.take(pa.array(rest)).to_pylist())
        made += ids + others
        sizes = np.concatenate([n_cores, n_tails, n_others])
        firsts = np.cumsum(sizes) - sizes
        piece = np.zeros((len(words), 2), np.int64)
        piece[at, 0], piece[at, 1] = np.asarray(cores.indices), len(n_cores) + np.asarray(tails.indices)
        piece[rest, 0] = len(n_cores) + len(n_tails) + np.arange(len(rest))
        lengths = sizes[piece] if len(sizes) else piece
        lengths[rest, 1] = 0
        return np.concatenate(made) if made else np.zeros(0, self.dtype), firsts[piece] if len(sizes) else piece, lengths

    def _gathered(self, pool: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, index: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of texts whose words are ``index``, up to each of ``ends``."""
        sizes = lengths[index].ravel()
        until = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(firsts[index].ravel() - until[:-1], sizes)
        take += np.arange(len(take))
        data = pool[take].tobytes()
        at = until[2 * ends] * self.width
        return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text (null as empty)."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(texts)
        ends = np.asarray(split.offsets)
        # ASCII letters are lowered here, as the vocabulary does, for fewer distinct chunks.
        coded = pc.ascii_lower(split.values.slice(ends[0], ends[-1] - ends[0])).dictionary_encode()
        pool, firsts, lengths = self._chunks(coded.dictionary)
        index, ends = np.asarray(coded.indices), ends - ends[0]
        # Some words at a time, so that the gathering takes little memory.
        out: list[bytes] = []
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + GATHERED, "right")) - 1)
            out += self._gathered(pool, firsts, lengths, index[ends[low] : ends[high]], ends[low : high + 1] - ends[low])
            low = high
        special = [pc.match_substring(texts, x) for x in self.special]
        if whole := sorted({int(i) for x in special for i in np.flatnonzero(np.asarray(x))}):
            for i, x in zip(whole, self._library([texts[i].as_py() for i in whole]), strict=True):
                out[i] = x.tobytes()
        return out


_encoders: dict[str | None, ChunkEncoder] = {}


def encoder(path: str | None = None) -> ChunkEncoder:
    """This worker's encoder."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
