"""Token counts (operator 10): batch encoding in Arrow functions that returns lengths only.

Batches are balanced by bytes. Texts are split only where no token can cross: for a vocabulary with
word ends (every pre-token ends at white space and white space is dropped) at every run of ASCII white
space, so that a word's tokens depend on the word alone and are computed once per distinct word; for
other vocabularies long texts are split before a single space that follows a visible character.

Defined cases: null text counts as the empty text (0 bytes, 0 tokens); repeated rows give repeated
results; other columns of the input are ignored whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbatch import Words, slices, texts_of

#: A mark that stands between words that are encoded in one call; words that contain it are encoded alone.
MARK = "\x01"
#: A way of cutting words into pieces (fixed value): letters, single digits, runs of other marks.
LETTERS_AND_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that fall into one piece of letters and one of marks under it, however special strings are read: no quote, "<" or "|".
STEM_AND_MARKS = r"^[a-z]+[!-&(-/:;=-@\[-`{}~]+$"


class WordEncoder:
    """Token ids of words, for tokenizers whose words are independent of each other.

    ``cache_words`` bounds how many words are remembered between batches.
    """

    def __init__(self, path: str, cache_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.folds_case = '"type": "Lowercase"' in json.dumps(spec.get("normalizer"))
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        pattern = LETTERS_AND_MARKS in [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.letters = self._letters_only(path) if pattern and self.folds_case else None
        suffix = spec.get("model", {}).get("end_of_word_suffix")
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.cache_words = cache_words
        self.ids = np.zeros(0, np.int32)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.known_ends, self.known_ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _letters_only(path: str):
        """The same model for words of a-z, which need no normalising and are one piece each."""
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        t.normalizer, t.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        return t

    @staticmethod
    def fits(path: str) -> bool:
        """True if the file describes a tokenizer with word ends that drops white space."""
        if not path.endswith(".json"):
            return False
        with open(path, encoding="utf-8") as f:
            model = json.load(f).get("model", {})
        if not model.get("end_of_word_suffix"):
            return False
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        ids = lambda x: t.encode(x, add_special_tokens=False).ids
        return ids(" a1, \t\n b's ") == ids("a1,") + ids("b's")

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of words that are not in the cache."""
        if self.letters is None:
            return self._by_marks(words.to_pylist())
        plain = pc.match_substring_regex(words, "^[a-z]+$").to_numpy(zero_copy_only=False)
        found = self._by_word_ends(words.filter(pa.array(plain)).to_pylist())
        if found is None:
            return self._by_marks(words.to_pylist())
        lengths = np.zeros(len(words), np.int64)
        lengths[plain], own = found
        ends, rest = self._by_marks(words.filter(pa.array(~plain)).to_pylist())
        lengths[~plain] = np.diff(ends)
        of_plain = np.repeat(plain, lengths)
        ids = np.empty(len(of_plain), np.int32)
        ids[of_plain], ids[~of_plain] = own, rest
        return np.concatenate([[0], np.cumsum(lengths)]), ids

    def _by_word_ends(self, words: list[str], step: int = 512) -> tuple[np.ndarray, np.ndarray] | None:
        """Lengths and ids of words of a-z, told apart by the tokens that end a word; None if that fails."""
        texts = [" ".join(words[at : at + step]) for at in range(0, len(words), step)]
        ids = np.concatenate([np.zeros(0, np.int32), *(np.asarray(e.ids, np.int32) for e in self.letters.encode_batch_fast(texts, add_special_tokens=False))])
        cuts = np.flatnonzero(self.ends_word[ids])
        return (np.diff(np.concatenate([[-1], cuts])), ids) if len(cuts) == len(words) and (not len(ids) or cuts[-1] == len(ids) - 1) else None

    def _by_marks(self, words: list[str], step: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of any words: many in a call with a mark after each, those with the mark alone."""
        odd = np.fromiter((self.mark is None or MARK in w for w in words), bool, len(words))
        sound = [w for w, x in zip(words, odd.tolist()) if not x]
        texts = [f" {MARK} ".join(sound[at : at + step]) + f" {MARK}" for at in range(0, len(sound), step)]
        joined = np.concatenate([np.zeros(0, np.int32), *(np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        cuts = np.flatnonzero(joined == self.mark) if len(sound) else np.zeros(0, np.int64)
        if len(cuts) != len(sound):  # some word swallows or makes marks: each word in a call of its own
            odd[:], sound, joined, cuts = True, [], joined[:0], cuts[:0]
        lengths = np.zeros(len(words), np.int64)
        lengths[~odd] = np.diff(np.concatenate([[-1], cuts])) - 1
        alone = [np.asarray(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([w for w, x in zip(words, odd.tolist()) if x], add_special_tokens=False)]
        lengths[odd] = [len(x) for x in alone]
        of_odd = np.repeat(odd, lengths)
        ids = np.empty(len(of_odd), np.int32)
        ids[~of_odd], ids[of_odd] = joined[joined != self.mark] if len(sound) else joined, np.concatenate([np.zeros(0, np.int32), *alone])
        return np.concatenate([[0], np.cumsum(lengths)]), ids

    def _known(self, words: pa.Array) -> np.ndarray:
        """The place of each distinct word in the cache, which takes up the new ones."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        if len(new) and len(self.known) + len(new) > self.cache_words:  # start again from the words of this batch
            self._forget()
            at, new = pa.nulls(len(words), pa.int32()), words
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            place[place < 0] = np.arange(len(self.known), len(self.known) + len(new))
            ends, ids = self._fresh(new)
            self.known = pa.concat_arrays([self.known, new])
            self.known_ends = np.concatenate([self.known_ends, ends[1:] + self.known_ends[-1]])
            self.known_ids = np.concatenate([self.known_ids, ids])
        return place

    def encode(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) into ``self.ids`` of each word of ``vocab``; they hold until the next call."""
        keys = vocab
        if self.folds_case and len(vocab):
            special = np.zeros(len(vocab), bool)
            for s in self.specials:  # a special string is matched as it is written: such words keep their case
                special |= pc.match_substring(vocab, s, ignore_case=True).to_numpy(zero_copy_only=False)
            lowered = pc.ascii_lower(vocab)
            keys = pc.if_else(pa.array(special), vocab, lowered) if special.any() else lowered
        coded = keys.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if self.letters is None:
            place = self._known(words)[code]
            self.ids = self.known_ids
            return self.known_ends[place], self.known_ends[place + 1] - self.known_ends[place]
        # Words of letters and marks are two pieces: a piece is encoded once for all words that it is in.
        two = pc.match_substring_regex(words, STEM_AND_MARKS)
        both = words.filter(two)
        pieces = pa.concat_arrays([words.filter(pc.invert(two)), pc.replace_substring_regex(both, "[^a-z]+$", ""), pc.replace_substring_regex(both, "^[a-z]+", "")]).dictionary_encode()
        place = self._known(pieces.dictionary)[pieces.indices.to_numpy(zero_copy_only=False)]
        is_two = two.to_numpy(zero_copy_only=False)
        one, n = int((~is_two).sum()), int(is_two.sum())
        parts = np.empty(one + 2 * n, np.int64)  # the pieces of all words in order
        first = np.cumsum(1 + is_two) - (1 + is_two)
        parts[first[~is_two]] = place[:one]
        parts[first[is_two]], parts[first[is_two] + 1] = place[one : one + n], place[one + n :]
        length = self.known_ends[parts + 1] - self.known_ends[parts]
        ends = np.cumsum(length)
        self.ids = self.known_ids[np.repeat(self.known_ends[parts] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.append(first, len(parts))]
        return bounds[:-1][code], np.diff(bounds)[code]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


#: Where a text may be cut for any vocabulary: before one space between two visible characters.
_SAFE_CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def safe_parts(text: str, size: int) -> list[str]:
    """Cut a text into parts of at least ``size`` characters before such spaces; the parts joined are the text."""
    parts, at = [], 0
    while len(text) - at > size:
        m = _SAFE_CUT.search(text, at + size)
        if m is None:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


def _text_lengths(path: str, texts: list[str], part_chars: int) -> list[int]:
    """Lengths for vocabularies whose tokens depend on neighbouring white space."""
    cut = [safe_parts(t, part_chars) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # The model puts a space before each input: a later part gives its own leading space up for that one.
        flat = [p if i == 0 else p[1:] for parts in cut for i, p in enumerate(parts)]
        lengths = [len(x) for x in model.encode(flat, num_threads=1)]
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        lengths = [len(e.ids) for e in tokenizer.encode_batch_fast([p for parts in cut for p in parts], add_special_tokens=False)]
    it = iter(lengths)
    return [sum(next(it) for _ in parts) for parts in cut]


def token_lengths(path: str, texts: pa.Array, part_chars: int = 65_536) -> np.ndarray:
    """Tokens of each text of an Arrow array."""
    if WordEncoder.fits(path) if path not in _ENCODERS else True:
        words = Words(texts)
        _, lengths = word_encoder(path).encode(words.vocab)
        return words.sums(lengths)
    return np.asarray(_text_lengths(path, texts.to_pylist(), part_chars), np.int64)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each document; a narrow step without any shuffle.

    ``over_limit``: more than ``limit`` tokens. The file at ``tokenizer_path`` must exist on every executor.
    """
    id_type = docs.schema[id_col].dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, slice_bytes):
            texts = texts_of(part, text_col)
            n = token_lengths(tokenizer_path, texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(counted, schema)
