"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The encoding of every prefix of a piece ends in exactly one token. ``last[i]`` holds that token for
the prefix of ``i`` bytes. A token ``t`` that ends at ``i`` is the last one exactly if the merges of
``last[i - len(t)]`` followed by ``t`` leave those two tokens apart, so each new byte needs only the
tokens that end there. Appending bytes extends the table; after an edit the table stands up to the
edit's start and is redone from there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_map, kept, only, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Encoded pieces that a worker remembers; beyond it the memory starts anew.
CACHE = 250_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Ranks of byte strings, an automaton that finds the tokens that end at a byte, and memoised
    checks of which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.apart: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._build()

    def _build(self) -> None:
        """Trie of all tokens with failure links; ``ending[state]``: (length, rank), longest first."""
        children: dict[int, int] = {}
        token_at, depth = [-1], [0]
        for token, rank in self.ranks.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                nxt = children.get(key)
                if nxt is None:
                    nxt = children[key] = len(depth)
                    token_at.append(-1)
                    depth.append(depth[state] + 1)
                state = nxt
            token_at[state] = rank
        fail, ending = [0] * len(depth), [()] * len(depth)
        for key, state in sorted(children.items(), key=lambda kv: depth[kv[1]]):
            parent, byte = key >> 8, key & 255
            if parent:
                at = fail[parent]
                while at and (at << 8 | byte) not in children:
                    at = fail[at]
                fail[state] = children.get(at << 8 | byte, 0)
            own = ((depth[state], token_at[state]),) if token_at[state] >= 0 else ()
            ending[state] = own + ending[fail[state]]
        self.step, self.fail, self.ending, self.trie, self.depth = dict(children), fail, ending, children, depth

    def next_state(self, key: int) -> int:
        """The automaton's step for ``state << 8 | byte``, remembered."""
        at, byte = key >> 8, key & 255
        while at and (at << 8 | byte) not in self.trie:
            at = self.fail[at]
        if len(self.step) > 1_000_000:
            self.step = dict(self.trie)
        got = self.step[key] = self.trie.get(at << 8 | byte, 0)
        return got

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merged(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """Parts after merging neighbours with ranks under ``below``, lowest first, leftmost among equals."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        below = self.size if below is None else below
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], below))
            if ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge is this one; None for a byte, or for what no merge makes."""
        if rank not in self.halves:
            parts = self.merged(self.bytes[rank], rank)
            self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[rank]

    def whole(self, rank: int) -> bool:
        """Whether merging a token's bytes gives that token."""
        return len(self.bytes[rank]) == 1 or self.split(rank) is not None

    def stay_apart(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            known = self.apart[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undo both tokens' merges, newest first; no older merge may join the parts that meet between them.

        The merge of the meeting parts comes first if its rank is lower than that of the merge that
        would take one of them away; between equal ranks the left one comes first.
        """
        limit = self.size
        while True:
            joint = self.ranks.get(self.bytes[left] + self.bytes[right])
            if joint is not None and joint < limit and self.split(joint) == (left, right):
                return False
            first, second = (self.split(left), self.split(right))
            if first is not None and (left > right or second is None):
                limit, left = left, first[1]
            elif second is not None:
                limit, right = right + 1, second[0]
            else:
                return True


class PrefixTable:
    """The dynamic program's steps, remembered.

    A place holds what decides all later steps after some prefix: the automaton's state and the last
    tokens of the prefixes that a later token may follow. Equal places of different texts are one,
    so a byte costs one look-up once its step is known. Beyond ``most`` steps the table starts anew.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.vocabulary, self.most = vocabulary, most
        self.clear()

    def clear(self) -> None:
        #: The token -1 stands for the start of the text.
        self.places: list[tuple[int, tuple[int, ...]]] = [(0, (-1,))]
        self.known: dict[tuple[int, tuple[int, ...]], int] = {self.places[0]: 0}
        self.last = [-1]
        self.steps: dict[int, int] = {}

    def step(self, key: int) -> int:
        """The place after ``place << 8 | byte``."""
        v = self.vocabulary
        state, lasts = self.places[key >> 8]
        at = state << 8 | key & 255
        state = v.step.get(at)
        if state is None:
            state = v.next_state(at)
        for length, rank in v.ending[state]:
            before = lasts[length - 1]
            if v.whole(rank) if before < 0 else v.stay_apart(before, rank):
                break
        else:
            raise ValueError(f"no token of the vocabulary ends in byte {key & 255}")
        place = (state, (rank, *lasts[: v.depth[state]]))
        found = self.known.get(place)
        if found is None:
            found = self.known[place] = len(self.places)
            self.places.append(place)
            self.last.append(rank)
        self.steps[key] = found
        return found

    def ids(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if len(self.steps) > self.most:
            self.clear()
        place, path, steps = 0, [], self.steps
        for byte in data:
            key = place << 8 | byte
            place = steps.get(key)
            if place is None:
                place = self.step(key)
            path.append(place)
        return self.walk_back(path)

    def walk_back(self, path: list[int]) -> list[int]:
        out, end, last, tokens = [], len(path), self.last, self.vocabulary.bytes
        while end:
            rank = last[path[end - 1]]
            out.append(rank)
            end -= len(tokens[rank])
        return out[::-1]


class PrefixEncoder:
    """The last token of every prefix of one piece, open to appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.table, self.data, self.path = PrefixTable(vocabulary), b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        place, table = self.path[-1] if self.path else 0, self.table
        for byte in more:
            key = place << 8 | byte
            place = table.steps[key] if key in table.steps else table.step(key)
            self.path.append(place)
        self.data += more

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes [start, end); the table before ``start`` is kept.

        Past the edit it is redone only until it meets the old table again.
        """
        rest, old = self.data[end:], self.path[end:]
        self.data = self.data[:start]
        del self.path[start:]
        self.append(new)
        for i, byte in enumerate(rest):
            self.append(bytes((byte,)))
            if self.path[-1] == old[i]:
                self.data += rest[i + 1 :]
                self.path += old[i + 1 :]
                return

    def ids(self) -> list[int]:
        return self.table.walk_back(self.path)


def tokenizer_for(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each Python worker; later tasks of the worker use it again, or free it."""
    return kept(("tokenizer", path, pattern), lambda: Tokenizer(path, pattern))


class Tokenizer:
    """Encodes texts piece by piece; words seen before are looked up while they are remembered.

    A space between two characters that aren't white space always starts a piece, whatever stands
    before it, so texts are cut there first: a word with its space encodes the same everywhere.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary.load(path)
        self.table = PrefixTable(self.vocabulary)
        self.pieces = regex.compile(pattern).findall
        self.words = _Words(self)
        self.cut = pattern == _pattern()

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.cut or _UNEVEN.search(text) or not text or text[0].isspace() or text[-1].isspace():
            return self.by_pieces(text)
        first, *rest = text.split(" ")
        return self.by_pieces(first) + b"".join(map(self.words.__getitem__, rest))

    def by_pieces(self, text: str) -> bytes:
        ids, ranks = [], self.vocabulary.ranks
        for piece in self.pieces(text):
            data = piece.encode("utf-8", "surrogatepass")
            whole = ranks.get(data)
            if whole is None:
                ids += self.table.ids(data)
            else:
                ids.append(whole)
        return _pack(ids)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


def _pack(ids) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


#: White space beside a space.
_UNEVEN = re.compile(r" \s|\s ")


class _Words(dict):
    """Ids of a space and a word. Full, it keeps what came first, and starts anew after many misses."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.missed = tokenizer, 0

    def __missing__(self, word: str) -> bytes:
        tokenizer, data = self.tokenizer, f" {word}".encode("utf-8", "surrogatepass")
        whole = tokenizer.vocabulary.ranks.get(data)
        if word.isascii() and word.isalpha():  # one piece
            packed = _pack(tokenizer.table.ids(data) if whole is None else (whole,))
        else:
            packed = tokenizer.by_pieces(" " + word)
        if len(word) <= 128:
            if len(self) < CACHE:
                self[word] = packed
            else:
                self.missed += 1
                if self.missed > 5 * CACHE:
                    self.clear()
                    self.missed = 0
        return packed


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens`` of every text; ids is a binary of little-endian 32-bit integers.

    A null text counts as empty and gives no ids. Rows stay one to one, repeated rows included;
    extra columns are left out.
    """
    path, pattern = _defaults(ranks_path, pattern)

    def make():
        tokenizer = tokenizer_for(path, pattern)

        def run(c):
            ids = [tokenizer.packed(t or "") for t in c["text"]]
            return {"doc_id": c["doc_id"], "ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

        return run

    return arrow_map(only(docs, "doc_id", "text"), make, "doc_id bigint, ids binary, n_tokens bigint")


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, data`` (UTF-8 bytes) from ``doc_id, ids``; null ids give empty bytes."""
    path, pattern = _defaults(ranks_path, None)

    def make():
        tokens = tokenizer_for(path, pattern).vocabulary.bytes

        def run(c):
            data = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in c["ids"]]
            return {"doc_id": c["doc_id"], "data": data}

        return run

    return arrow_map(only(encoded, "doc_id", "ids"), make, "doc_id bigint, data binary")


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode and decode in one pass over the texts."""
    path, pattern = _defaults(ranks_path, pattern)

    def make():
        tokenizer = tokenizer_for(path, pattern)

        def run(c):
            n, a, b = [], [], []
            for text in c["text"]:
                packed = tokenizer.packed(text or "")
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(tokenizer.decode(np.frombuffer(packed, "<u4").tolist())).hexdigest())
            return {"doc_id": c["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return run

    return arrow_map(
        only(docs, "doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or default_ranks(), pattern or _pattern()


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def tokenize_stage(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """The documents' ids for training: ``doc_id, source, lang, n_tokens, token_ids, round_trip``.

    ``round_trip`` tells that decoding the ids gave back the text's bytes.
    """
    path, pattern = _defaults(ranks_path, None)

    def make():
        tokenizer = tokenizer_for(path, pattern)

        def run(c):
            out = {"doc_id": c["doc_id"], "source": c["source"], "lang": c["lang"], "n_tokens": [], "token_ids": [], "round_trip": []}
            for text in c["text"]:
                # An array holds four bytes for each id, a list of integers nine times as many.
                ids = np.frombuffer(tokenizer.packed(text or ""), "<u4").astype(np.int32)
                out["n_tokens"].append(len(ids))
                out["token_ids"].append(ids)
                out["round_trip"].append(tokenizer.decode(ids.tolist()) == (text or "").encode("utf-8", "surrogatepass"))
            return out

        return run

    return arrow_map(
        only(docs, "doc_id", "source", "lang", "text").withColumns({c: F.col(c).cast("string") for c in ("source", "lang")}),
        make,
        "doc_id bigint, source string, lang string, n_tokens bigint, token_ids array<int>, round_trip boolean",
    )
