"""Secret scans: fixed patterns, and strings that a primed compressor can't shorten.

The patterns give the base spans. Beyond them, every token of some length and variety that stands in a sensitive
context is a candidate. A zstandard dictionary is primed with common identifiers and with the code around the
candidate, and the candidate's marginal compressed bytes are measured: ordinary names and words are
found in the dictionary and cost little, random keys cost almost as many bytes as they carry.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import arrow_map, only, table

KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words that make the text after them sensitive, beyond those of the assignments.
_CONTEXT = re.compile(
    r"passw|secret|token|api[_ -]?key|credential|private[_ -]?key|access[_ -]?key|authorization|bearer|"
    r"client[_ -]?id|signature|encryption|\bauth\b|\bpwd\b|\bkey\b",
    re.I | re.A,
)
_DIGIT = re.compile(r"[0-9]")
#: Character classes: small letters, digits, and capitals that don't just begin a word.
_CLASSES = (re.compile(r"[a-z]"), _DIGIT, re.compile(r"[A-Z](?![a-z])"))

#: Identifiers that code is full of; what they spell is not novel.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret authorization bearer "
    "credential signature encryption session cookie header request response config settings environment variable "
    "default example placeholder changeme undefined null none true false string number boolean object array function "
    "return import export class public static final void const let var def self this super init main args kwargs "
    "value values name names type types user users username email address host hostname port url uri path file "
    "filename directory index count length size width height start end begin first last next previous parent child "
    "children node nodes edge edges list map set dict tuple key keys item items data database table column row rows "
    "query select insert update delete create drop alter where from join group order limit offset error exception "
    "message logger debug info warning critical trace level handler listener callback event events thread process "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef the and for that with this from "
    "not are was have which their would there about when your can said each she how will other many then them these"
).encode()

_PROSE = IDENTIFIERS[-400:]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, in code points: leftmost and not overlapping for each kind.

    A match that fails its kind's least length is dropped, but the text that it took stays taken.
    """
    spans = []
    if _KEYWORD.search(text):
        spans += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return spans


def _blanked(text: str, token: str, low: int, high: int) -> str:
    """``text[low:high]`` with a space for what it holds of the token's occurrences."""
    n = len(token)
    parts, at = [], low
    i = text.find(token, max(0, low - n + 1), high + n - 1)
    while i >= 0:
        parts.append(text[at : max(at, min(i, high))])
        at = min(high, i + n)
        i = text.find(token, i + n, high + n - 1)
    parts.append(text[at:high])
    return " ".join(parts)


def symbols(token: str) -> int:
    """Size of the alphabet that the token's character classes make up; hexadecimal letters are a class of six."""
    n = 10 if _DIGIT.search(token) else 0
    for low, few in (("a", "f"), ("A", "F")):
        letters = [c for c in token if low <= c <= chr(ord(low) + 25)]
        n += (6 if max(letters) <= few else 26) if letters else 0
    return n + len({c for c in token if not c.isalnum()})


class Novelty:
    """Marginal compressed bytes of candidates against identifiers and the text around them."""

    def __init__(self, around: int = 400, reach: int = 48, least: float = 0.85, shortest: int = 12, classes: int = 2):
        import zstandard

        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # The highest ordinary level prices literals and matches best; the frame's own fields cost nothing.
        params = zstandard.ZstdCompressionParameters.from_level(
            19, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3
        )
        self.compress = zstandard.ZstdCompressor(dict_data=primed, compression_params=params).compress
        self.around, self.reach, self.least = around, reach, least
        self.candidate, self.classes = re.compile(rf"[A-Za-z0-9+/_=-]{{{shortest},}}"), classes

    def marginal(self, context: bytes, candidate: bytes) -> float:
        """Compressed bytes that the candidate adds after the context, for each of its own."""
        return (len(self.compress(context + b" " + candidate)) - len(self.compress(context))) / len(candidate)

    def bound(self, token: str) -> float:
        """``least`` is for letters of both cases and digits; smaller alphabets carry fewer bits."""
        return self.least * min(1.0, math.log2(symbols(token)) / math.log2(62))

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Novel candidates that overlap no base span and start soon after a sensitive word."""
        found: list[tuple[int, int, str]] = []
        words = [m.end() for m in _CONTEXT.finditer(text)]
        if not words:
            return found
        base = sorted(taken)
        starts, reached = [a for a, _, _ in base], list(itertools.accumulate((b for _, b, _ in base), max))
        for m in self.candidate.finditer(text):
            start, end = m.span()
            before = bisect.bisect_right(words, start)
            if not before or start > words[before - 1] + self.reach:
                continue
            token = m[0]
            if sum(bool(c.search(token)) for c in _CLASSES) < self.classes:
                continue
            at = bisect.bisect_left(starts, end) - 1
            if at >= 0 and reached[at] > start:
                continue
            # A second copy would make the first one cheap, even one that the window's edge cuts.
            low, high = max(0, start - self.around), end + self.around
            around = _blanked(text, token, low, start) + _blanked(text, token, end, min(high, len(text)))
            # Some prose in front: a short text alone would give the compressor no table of its letters.
            if self.marginal(_PROSE + around.encode("utf-8", "surrogatepass"), token.encode()) >= self.bound(token):
                found.append((start, end, "novel"))
        return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def scan(docs: DataFrame, around: int = 400, reach: int = 48, least: float = 0.85, shortest: int = 12, classes: int = 2) -> DataFrame:
    """Secrets of every whole text: ``doc_id, n_assign, n_access, n_hex, n_novel, base_spans, spans``.

    Spans are strings ``kind:start:end`` by start, then kind. ``around`` characters on either side
    prime the compressor; a candidate starts at most ``reach`` characters after a sensitive word and
    is reported if it costs ``least`` compressed bytes for each of its own, fewer if its alphabet is
    smaller. It has ``shortest`` characters or more, of ``classes`` of these: small letters, digits, and
    capitals that don't just begin a word; with 1 and 1 every token is a candidate, and one in seven of the
    unknown words after a sensitive one is reported. Other copies of a candidate don't count as text around
    it. A null text counts as empty. Rows stay one to one; extra columns are left out.
    """

    def make():
        novelty = Novelty(around, reach, least, shortest, classes)

        def run(c):
            out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans")}
            out["doc_id"] = c["doc_id"]
            for text in c["text"]:
                base = base_spans(text or "")
                extra = novelty.spans(text or "", base)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base + extra))
                out["base_spans"].append(joined(base))
                out["spans"].append(joined(base + extra))
            return out

        return run

    return arrow_map(
        only(docs, "doc_id", "text"),
        make,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_spans string, spans string",
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_novel", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


def digest(spans: str) -> str:
    """Lowercase hex digest of joined spans."""
    return hashlib.sha256(spans.encode()).hexdigest()
