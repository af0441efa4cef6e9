"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash of eight bytes cuts each text into chunks of about ``1 << CHUNK_BITS`` bytes, so texts
that share a passage share its chunks wherever it lies. A task encodes each chunk once and keeps it;
inside a chunk, each distinct word is encoded once. For the tokenizer whose preparation of texts is stated below, most
words are cut into its pre-tokens here and only merged by the library; other words and tokenizers go through the
whole library, all new words of a chunk in one call. A chunk's encoding covers its
inner words only, from its first to its last blank. What lies between the inner words of two chunks
is re-encoded together with the last word before and the first word after it: if the tokens of both
words come out as the chunks hold them, the join is exact; if not, the window widens by 1, 2, 4, .. words on each
side until both ends agree, and if none does, the whole text is encoded in one piece. A chunk without
inner words makes the window run into the next. A tokenizer for which blanks count gets whole texts.

Stores live in the task: two generations of bounded size, so memory does not grow with the input and is
free again for the next operator, no text is shuffled, and a lost task simply starts again. A chunk
that several tasks meet is encoded once in each of them.

Defined results: null or empty text has no tokens and decodes to the empty text. Only ASCII blanks
count as blanks; any other space is left to the tokenizer. Special tokens written in a text become
their ids, as in the library. Repeated rows are encoded alike; a null doc_id is kept.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.registry import query, table, texts

CHUNK_BITS = 11
LONGEST_CHUNK = 16 << CHUNK_BITS
WORDS_HELD, CHUNKS_HELD, JOINS_HELD = 120_000, 3_000, 20_000
ROWS_AT_ONCE = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@cache
def _byte_values() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64) * _ODD) ^ np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cuts(raw: bytes, bits: int = CHUNK_BITS, longest: int = LONGEST_CHUNK) -> list[int]:
    """Ends of the chunks: after eight bytes with a chosen hash, moved to the next character."""
    n = len(raw)
    data = np.frombuffer(raw, np.uint8)
    value = _byte_values()[data]
    rolling = value.copy()
    for k in range(1, 8):
        rolling[k:] += value[:-k] << np.uint32(3 * k) if n > k else 0
    # the high bits take in all eight bytes
    ends = np.flatnonzero((rolling >> np.uint32(32 - bits)) == 0) + 1
    out, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > longest:
            last += longest
            while last < n and data[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        if end > last:
            out.append(end)
            last = end
    return out


class Generations:
    """A bounded store: what was not asked for during a whole generation is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


#: How the tokenizer file that words are cut for here prepares a text.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {
        "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
        "behavior": "Removed", "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_ASCII = re.compile(rb"[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")
_LATIN = re.compile(r"[^\W\d_]+|[0-9]|[!-/:-@\[-`{-~]+")


@cache
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary, where it is another one."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + i) for i, b in enumerate(b for b in range(0x100) if b not in plain)}


def pretokens(word: bytes) -> tuple[bytes, ...] | None:
    """What the tokenizer cuts a word into before merging, in lower case; None where that is left to the library.

    Cut here are words of ASCII characters and of Latin letters below U+0280, which neither compose nor
    decompose: without an apostrophe, which binds letters after it, and ``<``, which begins special tokens.
    """
    if word.isalpha():  # of bytes: ASCII letters alone
        return (word.lower(),)
    if b"'" in word or b"<" in word or max(word) > 0xC9:
        return None
    if word.isascii():
        found = _ASCII.findall(word.lower())
        return tuple(found) if sum(map(len, found)) == len(word) else None
    text = word.decode().lower()
    found = _LATIN.findall(text)
    if sum(map(len, found)) != len(text) or not all(x.isascii() or x.isalpha() for x in found):
        return None
    return tuple([x.encode() for x in found])


class Codec:
    """Encodes whole texts; ids are int32 bytes, decoded pieces are the library's decode of them."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.words, self.pieces = Generations(WORDS_HELD), Generations(WORDS_HELD)
        self.chunks, self.joins = Generations(CHUNKS_HELD), Generations(JOINS_HELD)
        self.encoded_bytes = self.chunk_hits = self.chunk_misses = 0
        added = self.tok.get_added_tokens_decoder()
        self.starts = {t.content[0] for t in added.values()}
        marks = [(i, t.content) for i, t in added.items() if not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = marks[0] if marks else None  # a token cut out of a raw text before anything else, so it can part words
        self.names = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()} if self.tok.decoder is None else None
        ids = [self.tok.encode(t, add_special_tokens=False).ids for t in ("a", "b", "a b")]
        self.by_word = ids[0] + ids[1] == ids[2]  # otherwise blanks count and texts are encoded in one piece
        parts = [x and json.loads(x.__getstate__()) for x in (self.tok.normalizer, self.tok.pre_tokenizer)]
        self.model = self.tok.model if parts == [_NORMALIZER, _PRE_TOKENIZER] and self.names else None

    def _piece(self, token: bytes) -> tuple[bytes, str]:
        """The part of one pre-token, by the tokenizer's merges alone."""
        got = self.pieces.get(token)
        if got is None:
            letters = token.decode("latin-1")
            ids = [t.id for t in self.model.tokenize(letters if token.isascii() else letters.translate(_byte_letters()))]
            got = (np.array(ids, np.int32).tobytes(), " ".join([self.names[i] for i in ids]))
            self.encoded_bytes += len(token)
            self.pieces.put(token, got)
        return got

    def _decoded(self, ids: list[int]) -> str:
        if self.names is None:
            return self.tok.decode(ids, skip_special_tokens=False)
        return " ".join([self.names[i] for i in ids])  # what decode does without a decoder

    def _library(self, pieces: list[str]) -> list[tuple[bytes, str]]:
        self.encoded_bytes += sum(map(len, pieces))
        ids = [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        return [(np.array(i, np.int32).tobytes(), self._decoded(i)) for i in ids]

    def _parted(self, words: list[str]) -> list[tuple[bytes, str]]:
        """The parts of words from one call: a special token parts them, which the tokenizer cuts out of the raw text first."""
        if self.mark is None or len(words) == 1 or any(c in w for w in words for c in self.starts):
            return self._library(words)
        number, content = self.mark
        self.encoded_bytes += sum(map(len, words))
        ids = self.tok.encode_batch_fast([content.join(words)], add_special_tokens=False)[0].ids
        out, at = [], 0
        for _ in words[1:]:
            end = ids.index(number, at)
            out.append(ids[at:end])
            at = end + 1
        return [(np.array(i, np.int32).tobytes(), self._decoded(i)) for i in [*out, ids[at:]]]

    def _word_parts(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        young, get = self.words.young.get, self.words.get
        parts = [young(w) or get(w) for w in words]
        if None in parts:
            new = dict.fromkeys(w for w, p in zip(words, parts) if p is None)
            others, held = [], self.pieces.young.get
            for w in new:
                tokens = pretokens(w) if self.model else None
                if tokens is None:
                    others.append(w)
                elif len(tokens) == 1:
                    new[w] = held(tokens[0]) or self._piece(tokens[0])
                else:
                    own = [held(x) or self._piece(x) for x in tokens]
                    new[w] = (b"".join([i for i, _ in own]), " ".join([d for _, d in own]))
            if others:
                new.update(zip(others, self._parted([w.decode() for w in others])))
            for w, p in new.items():
                self.words.put(w, p)
            parts = [p or new[w] for w, p in zip(words, parts)]
        return parts

    def _chunk(self, raw: bytes):
        """(head, words, ids, decoded, first and last word with ids, tail) or, without inner words, the text alone."""
        got = self.chunks.get(raw)
        if got is not None:
            self.chunk_hits += 1
            return got
        self.chunk_misses += 1
        words = raw.split()  # of bytes: at ASCII blanks alone
        head = words.pop(0).decode() if words and not raw[:1].isspace() else ""
        tail = words.pop().decode() if words and not raw[-1:].isspace() else ""
        if not words:
            got = (raw.decode(),)
        else:
            inner = self._word_parts(words)
            got = (
                head, words, b"".join([p[0] for p in inner]), " ".join([p[1] for p in inner if p[1]]),
                (words[0].decode(), inner[0][0]), (words[-1].decode(), inner[-1][0]), tail,
            )
        self.chunks.put(raw, got)
        return got

    def _join(self, before, window: str, after):
        """The window's part, if both neighbours come out as their chunks hold them."""
        key = (before and before[0], window, after and after[0])
        got = self.joins.get(key)
        if got is None:
            pieces = [window] if before is None else [before[0], window]
            ids = self._library([" ".join(pieces if after is None else [*pieces, after[0]])])[0][0]
            left, right = before[1] if before else b"", after[1] if after else b""
            fits = len(ids) >= len(left) + len(right) and ids.startswith(left) and ids.endswith(right)
            middle = ids[len(left) : len(ids) - len(right)] if fits else b""
            got = (fits, middle, self._decoded(np.frombuffer(middle, np.int32).tolist()))
            self.joins.put(key, got)
        return got

    def _widened(self, left: list[bytes], window: str, right: list[bytes] | None):
        """A failed join with 1, 2, 4, .. more words on each side: (words taken, middle, its text), or None if no width agrees.

        A word further out has to stay as the check on each side; ``right`` is None at the end of a text.
        """
        step = 1
        while step < len(left) and (right is None or step < len(right)):
            inside = [w.decode() for w in left[-step:]] + [window] + [w.decode() for w in (right or [])[:step]]
            ends = [left[-step - 1]] + ([] if right is None else [right[step]])
            checks = [(w.decode(), p[0]) for w, p in zip(ends, self._word_parts(ends))]
            fits, middle, piece = self._join(checks[0], " ".join(inside), None if right is None else checks[1])
            if fits:
                return step, middle, piece
            step *= 2
        return None

    def _text(self, words: list[bytes]) -> tuple[bytes, str]:
        parts = self._word_parts(words)
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])

    def encode(self, text: str) -> tuple[bytes, str]:
        if not self.by_word:
            return self._library([text])[0]
        raw = text.encode()
        ids, decoded, before, left, window, start = [], [], None, [], "", 0
        for end in [*cuts(raw), None]:
            got = self._chunk(raw[start:end]) if end is not None else None
            if got is not None and len(got) == 1:
                window += got[0]
                start = end
                continue
            if got is None and not window:
                break
            head, words, inner, spelt, first, last, tail = got or ("", None, b"", "", None, None, "")
            fits, middle, piece = self._join(before, window + head, first)
            if not fits:
                wide = self._widened(left, window + head, words)
                if wide is None:
                    return self._library([text])[0]
                step, middle, piece = wide
                ids[-1], decoded[-1] = self._text(left[:-step])
                if words is not None:
                    inner, spelt = self._text(words[step:])
            ids += [middle, inner]
            decoded += [piece, spelt]
            before, left, window, start = last, words, tail, end
        whole = b"".join(ids)
        if self.tok.decoder is not None:  # pieces of a text may decode otherwise than the whole
            return whole, self._decoded(np.frombuffer(whole, np.int32).tolist())
        return whole, " ".join([p for p in decoded if p])


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of every row of ``docs``; ``path`` names a tokenizer file all executors have."""
    path = path or default_path()

    def scan(batches):
        codec = Codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                got = [codec.encode(t.as_py()) for t in part.column("text")]
                ends = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(i) // 4 for i, _ in got], out=ends[1:])
                flat = pa.array(np.frombuffer(b"".join([i for i, _ in got]), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([d for _, d in got], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return texts(docs).mapInArrow(scan, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and further columns of ``coded``."""
    return coded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    return digests(encoded(table(spark, sf_dir, "documents")))
