"""Secret scan: fixed patterns, and novelty against a dictionary-primed zstandard compressor.

Operator 4. Base spans come from three patterns (assignments, access keys, long hex strings). The method adds spans:
unbroken strings of 16 characters or more, however long, that hold such a word or lie close before or behind one
are candidates. A compressor primed with identifiers and parts of words compresses the surrounding text with and without
the candidate; the difference is what the candidate costs. Ordinary words and repeated strings cost little;
a string that costs as many bytes as random characters of its alphabet is reported as ``novel``. Words alone may be
reported where they are rare and long and hold none of the parts. Base spans stay whatever they cost.

One pass over the documents without a shuffle; a regular-expression engine linear in the text sorts out texts
that can hold nothing before Python looks at the rest.

Defined results: a null text counts as empty and gives no span. Spans are code points, end exclusive. A novel span
that lies in a base span is not reported again. Repeated rows are judged alike; null doc_ids are kept; only
doc_id and text are read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import table

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
#: Candidates of the method; a sensitive word has to lie within ``CONTEXT`` characters before or behind, or inside.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization", re.IGNORECASE | re.ASCII)
CONTEXT = 48
#: Characters of text before and after a candidate that are compressed with it.
AROUND = 400
#: Least marginal bytes, as a part of those that random characters of the alphabet need: the sum for strings of ``SHORT``
#: characters or fewer, the second falling with the length, as the compressor spends more on short ones.
NOVEL, EXTRA, SHORT = 0.85, 0.15, 40
#: Texts without a match of these have no span of any kind.
_ANY = r"(?i)(passw|passphrase|secret|token|api_?key|api-key|access[_-]?key|private[_-]?key|credential|bearer|authorization)"
_ANY_CASED = r"(AKIA[A-Z0-9]{16}|[0-9a-f]{24})"
#: Fixed identifiers that prime the compressor: usual names and placeholders near sensitive words.
IDENTIFIERS = """
password passwd passphrase secret token api_key apikey api-key access_key access-key private_key credential bearer authorization
client_secret client_id refresh_token access_token id_token session_token auth_token csrf_token secret_key public_key ssh-rsa
username user_name database connection_string configuration environment variable parameter response request
example_password your_api_key_here changeme placeholder xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef getElementById application_default_credentials authentication authorization_code
"""
#: Fixed parts of long words and names, so that those cost less than random letters.
WORD_PARTS = """
ational ization isation ability ibility fulness iveness lessness ingness ments ically ology ological graphic graphy metric
inter intra trans counter under over micro macro multi hyper super electro photo thermo psycho neuro cardio immuno pharma
consti represent respons administr communic environ develop manage govern character different independ understand institut
tion sion ment ness ance ence able ible ious eous ship hood ward wise like less ling ight ough ound ther ever some thing
Controller Manager Service Handler Factory Provider Exception Request Response Config Listener Repository Validator Generator
"""
#: Fixed text before the surrounding one: where that is short, the compressor would store letters as they are.
PLAIN = """the mail went out on friday and nobody knew that the entry for the new server, which is needed by all of us, was gone,
and we have to change it before the end of the month because the other team will need it as well. A quick look at both of
the jobs gave no clue; you may ask again, but expect a lazy reply. """


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns; matches that are too short use up their text all the same."""
    out = [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [Span("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    at = 0
    while m := _LONG_HEX.search(text, at):
        run = _HEX.match(text, m.start())
        out.append(Span("hex", *run.span()))
        at = run.end()
    return out


class Novelty:
    """Marginal compressed bytes, with identifiers and parts of words as dictionary."""

    def __init__(self, level: int = 19, identifiers: str = WORD_PARTS + IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_dict_id=False)

    def marginal(self, before: str, candidate: str, after: str) -> int:
        return self._size(before + candidate + after) - self._size(before + after)

    def _size(self, text: str) -> int:
        return len(self.press.compress((PLAIN + text).encode()))

    def expected(self, candidate: str) -> float:
        """Bytes that random characters of the candidate's alphabet need."""
        sizes = ((r"[0-9]", 10), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[+/_=-]", 5))
        if re.fullmatch(r"[0-9a-f]+", candidate) or re.fullmatch(r"[0-9A-F]+", candidate):
            letters = 16
        else:
            letters = sum(n for p, n in sizes if re.search(p, candidate))
        return len(candidate) * math.log2(max(letters, 2)) / 8


def novel_spans(text: str, base: list[Span], novelty: Novelty) -> list[tuple[Span, float]]:
    """Candidates outside base spans that cost what random characters do, with that ratio."""
    signs = [m.span() for m in _SENSITIVE.finditer(text)]
    if not signs:
        return []
    taken = sorted((s.start, s.end) for s in base)
    out, near, cover, reach = [], 0, 0, -1
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        # Candidates go up and don't overlap: words too far before this one are too far before all that follow.
        while near < len(signs) and signs[near][1] + CONTEXT < a:
            near += 1
        if near == len(signs):
            break
        while cover < len(taken) and taken[cover][0] < b:
            reach = max(reach, taken[cover][1])
            cover += 1
        if signs[near][0] > b + CONTEXT or reach > a:
            continue
        ratio = novelty.marginal(text[max(0, a - AROUND) : a], m[0], text[b : b + AROUND]) / novelty.expected(m[0])
        if ratio >= NOVEL + EXTRA * min(1, SHORT / (b - a)):
            out.append((Span("novel", a, b), ratio))
    return out


def spans_of(text: str | None, novelty: Novelty) -> list[Span]:
    """All spans of a text by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return sorted([*base, *(s for s, _ in novel_spans(text, base, novelty))], key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and found: array<struct<kind, start, end, value>>, a row for each of the input."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            texts = batch.column(1)
            may = pc.fill_null(pc.or_(pc.match_substring_regex(texts, _ANY), pc.match_substring_regex(texts, _ANY_CASED)), False).to_pylist()
            rows = []
            for k, m in enumerate(may):
                text = texts[k].as_py() if m else ""
                rows.append([{"kind": s.kind, "start": s.start, "end": s.end, "value": text[s.start : s.end]} for s in spans_of(text, novelty)] if m else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, found)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint,value:string>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def line(spans):
        return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            counts = [pa.array([sum(s["kind"] == k for s in r) for r in rows], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(line([s for s in r if s["kind"] != "novel"]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([line(r) for r in rows], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return find_secrets(docs).mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
