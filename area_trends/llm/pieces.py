"""Merge-type encoding with a sentence-piece vocabulary by backtracking, and decoding."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable
from itertools import pairwise
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from area_trends.llm.common import slices, texts, worker_cache

SPACE = "▁"
MAX_CACHED = 500_000
SLICE_BYTES = 1_000_000
NO_SCORE = float("-inf")


def one_mark_per_byte(error):
    return "�", error.start + 1


codecs.register_error("one_mark_per_byte", one_mark_per_byte)


class Vocabulary:
    """Pieces, merge scores and byte pieces of a model file; no text is encoded with it."""

    def __init__(self, path: str):
        held = SentencePieceProcessor(model_file=path)
        size = range(held.vocab_size())
        plain = [i for i in size if not (held.is_byte(i) or held.is_control(i) or held.is_unknown(i))]
        self.begin, self.end = held.bos_id(), held.eos_id()
        self.ids = {held.id_to_piece(i): i for i in plain}
        self.scores = {held.id_to_piece(i): held.get_score(i) for i in plain}
        self.bytes = {int(held.id_to_piece(i)[3:5], 16): i for i in size if held.is_byte(i)}
        shown = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        shown |= {i: bytes([b]) for b, i in self.bytes.items()}
        shown |= {i: " ⁇ ".encode() for i in size if held.is_unknown(i)}
        #: the bytes of each id; none of the control ids
        self.shown = pa.array([shown.get(i, b"") for i in size], pa.binary())
        self.spaced = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        self.controls = {i for i in size if held.is_control(i)}
        #: characters that stand side by side in a piece
        self.neighbours = {a + b for p in self.ids for a, b in pairwise(p)}
        #: no piece goes from a letter into a space, so words can be encoded alone
        self.words_apart = not any(pair[0] != SPACE == pair[1] for pair in self.neighbours)


class Remembered(dict):
    """Values of a function that were asked for; beyond `most`, if given, it starts anew."""

    def __init__(self, find: Callable, most: int | None = None):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, key):
        found = self.find(key)
        if self.most and len(self) >= self.most:
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Encodes texts exactly as merging pair by pair would, without merging them.

    A sequence of tokens is the merge result if each token is the result of merging its
    own characters, and each two neighbours are the result of merging theirs. Tokens are
    taken as the longest matches of an Aho-Corasick automaton; where two neighbours do
    not stand that test, a shorter token is tried, and where none is left, the position
    is marked in a bit field, never to be reached again, and the token before gives way.
    """

    def __init__(self, path: str, max_cached: int = MAX_CACHED):
        self.vocabulary = Vocabulary(path)
        self.matches = ahocorasick.Automaton()
        for piece in self.vocabulary.ids:
            if len(piece) > 1:
                self.matches.add_word(piece, len(piece))
        self.matches.make_automaton()
        self.spaced = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: ids of words without the space before them, and of runs within words
        self.known = Remembered(self.word_ids, max_cached)
        self.inner = Remembered(self.run_ids, max_cached)
        #: whether a token's own characters merge to it
        self.whole = Remembered(lambda token: self.merge(token) == [token])
        #: whether two neighbours stay as they are when merged anew
        self.together = Remembered(self.stand, max_cached)
        #: the longest shorter token that a token begins with
        self.shorter = Remembered(self.next_shorter)

    def stand(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        return self.merge(left + right, len(left)) == [left, right]

    def next_shorter(self, token: str) -> str:
        sizes = range(len(token) - 1, 0, -1)
        return next((token[:k] for k in sizes if k == 1 or token[:k] in self.vocabulary.ids), "")

    def merge(self, text: str, limit: int = 0) -> list[str]:
        """Merges the characters of a short text: best score first, from the left.

        Stops at the first merge across `limit`, if that is the number of characters of a
        part in front; its result is then not a list that begins with that part.
        """
        score, symbols = self.vocabulary.scores.get, list(text)
        joined = [score(a + b, NO_SCORE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while joined and (best := max(joined)) != NO_SCORE:
            at = joined.index(best)
            symbols[at] += symbols.pop(at + 1)
            del joined[at]
            if limit and (start := sum(map(len, symbols[:at]))) < limit < start + len(symbols[at]):
                break
            if at:
                joined[at - 1] = score(symbols[at - 1] + symbols[at], NO_SCORE)
            if at < len(joined):
                joined[at] = score(symbols[at] + symbols[at + 1], NO_SCORE)
        return symbols

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text that is not empty; characters outside the vocabulary stand alone."""
        longest = [1] * len(text)
        for end, size in self.matches.iter(text):  # of those that begin alike the longest comes last
            longest[end + 1 - size] = size
        failed = bytearray(len(text) // 8 + 1)  # a bit for each position
        found, at, last = [], 0, ""
        whole, together, shorter = self.whole, self.together, self.shorter
        token = text[: longest[0]]
        while at < len(text):
            while token:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1 and whole[token] and (not last or together[last, token]):
                    break
                token = shorter[token]
            if token:
                found.append(token)
                last, at = token, end
                if at < len(text):
                    token = text[at : at + longest[at]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = shorter[found.pop()]
                at -= len(last)
                last = found[-1] if found else ""
        return found

    def word_ids(self, word: str) -> bytes:
        """The ids of a word and the visible space before it, as little-endian unsigned 32-bit integers."""
        first, *rest = self.runs(SPACE + word)
        if not rest:
            return self.run_ids(first)
        return b"".join([self.known[first[1:]], *map(self.inner.__getitem__, rest)])

    def runs(self, text: str) -> list[str]:
        """The text cut between characters that stand side by side in no piece."""
        inside = self.vocabulary.neighbours
        ends = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inside]
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)] if ends else [text]

    def run_ids(self, run: str) -> bytes:
        held, out = self.vocabulary, []
        for token in self.tokens(run):
            if token in held.ids:
                out.append(held.ids[token])
            else:
                out.extend(held.bytes[b] for b in token.encode())
        return np.array(out, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """The text cut where no token can cross; a visible space goes before each part."""
        if not text:
            return []
        if not self.vocabulary.words_apart:
            return [text.replace(" ", SPACE)]
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in self.spaced.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, values: list[str]) -> list[bytes]:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        look_up = self.known.__getitem__
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.vocabulary.begin, self.vocabulary.end))
        return [begin + b"".join(map(look_up, self.words(text))) + end for text in values]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space put before a text goes, byte pieces become characters."""
        return self.decode_all([np.array(ids, "<u4").tobytes()])[0]

    def decode_all(self, encoded: list[bytes]) -> list[str]:
        """The texts of ids as `encode` gives them."""
        held = self.vocabulary
        ids = np.frombuffer(b"".join(encoded), "<u4")
        shown = held.shown.take(pa.array(ids))
        data = shown.buffers()[2].to_pybytes() if shown.buffers()[2] else b""
        places = np.r_[0, np.cumsum(pc.binary_length(shown).to_numpy(), dtype=np.int64)]
        ends = np.cumsum([0, *map(len, encoded)]) // 4
        found = []
        for a, b in pairwise(ends.tolist()):
            text = data[places[a] : places[b]].decode("utf-8", "one_mark_per_byte")
            first = next((i for i in ids[a:b] if i not in held.controls), None)
            found.append(text[1:] if first in held.spaced else text)
        return found


def coding(path: str, max_cached: int, whole: bool) -> Callable:
    def run(batches):
        codecs.register_error("one_mark_per_byte", one_mark_per_byte)
        encoder = worker_cache(f"pieces {path}", lambda: Encoder(path, max_cached))
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = part.column("text").to_pylist()
                encoded = encoder.encode(rows)
                decoded = encoder.decode_all(encoded)
                columns = [part.column(n) for n in part.schema.names if n != "text"]
                names = [n for n in part.schema.names if n != "text"]
                if whole:
                    ends = np.cumsum([0, *map(len, encoded)]) // 4
                    values = pa.array(np.frombuffer(b"".join(encoded), "<i4"))
                    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                else:
                    columns += [
                        pa.array([len(e) // 4 for e in encoded], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                    ]
                    names += ["n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def piece_ids(docs: DataFrame, model: str, max_cached: int = MAX_CACHED) -> DataFrame:
    """doc_id, ids (with begin and end) and the text decoded from them.

    `model` is the path of a merge-type model file with byte fallback, the same on all
    executors. Null is read as the empty text, which has the begin and end ids only.
    Repeated rows are coded one by one, other columns are ignored. There is no shuffle;
    a task keeps the ids of at most `max_cached` words between its slices.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(
        coding(model, max_cached, True), f"doc_id {kind}, ids array<int>, decoded string"
    )


def piece_digests(docs: DataFrame, model: str, max_cached: int = MAX_CACHED) -> DataFrame:
    """As `piece_ids`, with n_tokens and the SHA-256 of the ids and of the decoded text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(
        coding(model, max_cached, False),
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
