"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix there is exactly one token that can end its encoding. It is found from the entries before it: a
token that ends the prefix, and that BPE would leave apart from the last token of the shorter prefix. With these entries
an append costs only the new bytes, and an edit only the bytes up to where the entries agree again.

Defined results: null or empty text has no tokens and decodes to no bytes; repeated rows give repeated results; an empty
table gives an empty table. Only the id and text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpuslens.llm.common import Memo, id_and_text, map_texts, pieces

# Unicode white space, as the split pattern understands \s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Cuts a text where the split pattern must cut it too: at white space that does not lead a word.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
# Words that a worker remembers.
WORDS = 100_000


class Vocabulary:
    """Token bytes and ranks, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        # Every ending of a token, with the rank of the token it is or -1: where it ends, no longer token fits.
        self.endings = {token[i:]: -1 for token in ranks for i in range(1, len(token))} | ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.array(list(map(len, self.tokens)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # Keys are left * size + right; a token that begins a text has the left neighbour ``size``.
        self.edges, self.apart = Memo(self._edges), Memo(self._apart, 300_000)

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        """From lines of base64 token and rank."""
        pairs = (line.split() for line in data.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def merge(self, data: bytes, parts: int = 1) -> list[bytes]:
        """BPE by definition: join the neighbours of lowest rank until none can be joined or few enough are left."""
        found = [data[i : i + 1] for i in range(len(data))]
        while len(found) > parts:
            rank, i = min((self.ranks.get(a + b, self.size), i) for i, (a, b) in enumerate(zip(found, found[1:])))
            if rank == self.size:
                break
            found[i : i + 2] = [found[i] + found[i + 1]]
        return found

    def _edges(self, token: int) -> tuple[list, list] | None:
        """What stands at a token's end and at its start while BPE builds it, each with the rank that absorbs it.

        None if BPE never builds the token.
        """
        whole = self.tokens[token]
        if self.merge(whole) != [whole]:
            return None
        sides = []
        for side in (-1, 0):
            part, absorbed, found = whole, self.size, []
            while True:
                found.append((part, absorbed))
                if len(part) == 1:
                    break
                absorbed = self.ranks[part]
                part = self.merge(part, 2)[side]
            sides.append(found)
        return tuple(sides)

    def _apart(self, pair: int) -> bool:
        """Whether BPE would leave the two tokens as they are.

        It would not if some end of the left and some start of the right form a token before either is absorbed. A token
        ranks above its parts, so ranks are the order in time; of equal ranks the left one is first.
        """
        left, right = divmod(pair, self.size)
        starts = self.edges[right]
        if left == self.size or starts is None:
            return starts is not None
        ends = self.edges[left]
        if ends is None:
            return False
        for end, end_rank in ends[0]:
            for start, start_rank in starts[1]:
                rank = self.ranks.get(end + start)
                if rank is not None and rank < end_rank and rank <= start_rank:
                    return False
        return True

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Add to ``last`` the last token of each prefix of ``data`` up to ``stop`` that it lacks."""
        endings, apart, size = self.endings, self.apart, self.size
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            for start in range(end - 1, -1, -1):
                token = endings.get(data[start:end])
                if token is None:
                    raise ValueError("the vocabulary lacks single bytes")
                if token >= 0 and apart[(last[start - 1] if start else size) * size + token]:
                    last.append(token)
                    break

    def follow(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes stand for."""
        found, end, tokens = [], len(last), self.tokens
        while end:
            found.append(last[end - 1])
            end -= len(tokens[found[-1]])
        return found[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.bytes[shift + np.arange(len(shift))].tobytes()


class PrefixTokens:
    """Bytes with, for each prefix, the last token of its encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.data, self.last)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of ``[start, stop)``; returns how many bytes were looked at again."""
        known = self.last[stop:]
        self.data, self.last = self.data[:start] + data + self.data[stop:], self.last[:start]
        tail, same = start + len(data), 0
        self.vocabulary.extend(self.data, self.last, tail)
        for i in range(len(known)):
            self.vocabulary.extend(self.data, self.last, tail + i + 1)
            same = same + 1 if self.last[-1] == known[i] else 0
            # An entry depends on as many entries before it as the longest token has bytes.
            if same >= self.vocabulary.longest:
                self.last += known[i + 1 :]
                break
        else:
            i = len(known) - 1
        return len(data) + i + 1

    def ids(self) -> list[int]:
        return self.vocabulary.follow(self.last)


def even(text: str) -> bool:
    """Whether white space stands singly between words, so that each word can be taken by itself."""
    return bool(text) and text.replace("\n", " ").split(" ") == text.split()


class Encoder:
    """Texts to token ids, each match of ``pattern`` by itself; ids are packed little-endian, 32 bits each."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.packed = [rank.to_bytes(4, "little") for rank in range(vocabulary.size)]
        # Packed ids of a word with the space before it, or of a line end and the word behind it.
        self.words: dict[str, bytes] = {}

    def pack(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; the words of all texts are learnt together."""
        plain = list(map(even, texts))
        split = [text.replace("\n", " \n").split(" ") for text, is_even in zip(texts, plain) if is_even]
        missing = list(set().union(*(words[1:] for words in split)).difference(self.words))
        self.words.update(zip(missing, self.ids_of([word if word[0] == "\n" else f" {word}" for word in missing])))
        heads = self.ids_of([words[0] for words in split])
        of = self.words.__getitem__
        packed = (head + b"".join(map(of, words[1:])) for head, words in zip(heads, split))
        others = iter(self.ids_of([text for text, is_even in zip(texts, plain) if not is_even]))
        found = [next(packed if is_even else others) for is_even in plain]
        if len(self.words) > WORDS:
            self.words.clear()
        return found

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Packed ids. Pieces are taken in order, so that each extends the table of what it shares with the last."""
        find = self.pattern.findall
        cut = [
            [piece.encode() for chunk in (CHUNK.findall(text)) for piece in find(chunk)] for text in texts
        ]
        ids, ranks, packed = {}, self.vocabulary.ranks, self.packed
        known, last = b"", []
        for piece in sorted(set().union(*cut)):
            if piece in ranks:
                ids[piece] = packed[ranks[piece]]
                continue
            same = 0
            for a, b in zip(known, piece):
                if a != b:
                    break
                same += 1
            del last[same:]
            self.vocabulary.extend(piece, last)
            known = piece
            ids[piece] = b"".join(map(packed.__getitem__, self.vocabulary.follow(last)))
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in cut]

    def unpack(self, packed: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(packed, "<u4").astype(np.int64))


def encode(
    df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, token_ids`` (packed) for every row, with ``decoded`` also the bytes decoded from the ids.

    ``vocabulary`` is the path of a rank file; its bytes (under a megabyte) are broadcast.
    """
    encoder_of = _shared_encoder(df, vocabulary, pattern)

    def start():
        encoder = encoder_of()

        def work(ids, texts):
            packed = encoder.pack(texts)
            columns = {
                "doc_id": pa.array(ids, pa.int64()),
                "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                "token_ids": pa.array(packed, pa.binary()),
            }
            if decoded:
                columns["decoded"] = pa.array(list(map(encoder.unpack, packed)), pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return work

    schema = "doc_id long, n_tokens long, token_ids binary" + ", decoded binary" * decoded
    return map_texts(id_and_text(df, id_col, text_col), start, schema)


def _shared_encoder(df: DataFrame, vocabulary: str, pattern: str):
    """Makes the encoder of a task from the broadcast file; what it remembers goes when the task ends."""
    with open(vocabulary, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    return lambda: Encoder(Vocabulary.parse(shared.value), pattern)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, decoded`` (bytes) from the result of :func:`encode`."""
    encoder_of = _shared_encoder(encoded, vocabulary, "")

    def run(batches):
        encoder = encoder_of()
        for batch in batches:
            for part in pieces(batch):
                decoded = [encoder.unpack(packed) for packed in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*part.schema.names, "decoded"])

    columns = encoded.select("doc_id", "n_tokens", "token_ids")
    return columns.mapInArrow(run, "doc_id long, n_tokens long, token_ids binary, decoded binary")
