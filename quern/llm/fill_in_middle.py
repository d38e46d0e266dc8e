"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, and put into psm or spm order.

Operator 13. A Split pre-tokenizer of the tokenizers library with isolated matches of ``TOKEN`` gives the units of a text and
their code-point offsets. Nothing is trained: the model behind it knows one unknown token. The number of offsets is n,
and the offset at a drawn rank is where a slice begins. The draws come from sha256 of seed and id alone, so reruns agree.

A text goes through the library in windows of about ``WINDOW`` characters that end behind a character other than
a letter, where no unit can cross; so memory doesn't grow with a text's units, and every character is covered.

Defined results: a null text is an empty one; an empty text, or one that holds a mark, stays plain. A null id is drawn for as
an empty string. Repeated rows give repeated results; no rows give no rows. The input row comes back whole, as the
column ``row``, so that none of its columns can clash with the results.
"""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

#: The pattern of a unit, and the marks before prefix, suffix and middle.
TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: texts from this draw on stay plain; texts below that one are in spm order.
PLAIN_FROM, SPM_BELOW = 90, 20
WINDOW = 8_000

_NOT_LETTER = re.compile("[^A-Za-z]")
_MARK = re.compile("<[PSM]>")


class Units:
    """Offsets of a text's units by rank."""

    def __init__(self, pattern: str = TOKEN, window: int = WINDOW):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        # Every unit is the unknown token: no vocabulary is looked up.
        self.splitter = Tokenizer(models.WordPiece(vocab={"?": 0}, unk_token="?", max_input_chars_per_word=0))
        self.splitter.pre_tokenizer = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
        self.window = window

    def windows(self, text: str):
        """(start, encoding of text from there) window by window."""
        at = 0
        while at < len(text):
            stop = _NOT_LETTER.search(text, at + self.window - 1)
            end = stop.end() if stop else len(text)
            yield at, self.splitter.encode(text[at:end], add_special_tokens=False)
            at = end

    def cuts(self, text: str, ranks) -> tuple[int, list[int]]:
        """n and the code-point offset of each of ``ranks(n)``; rank n is the text's end."""
        held = list(self.windows(text)) if len(text) <= 64 * self.window else None
        n = sum(len(e) for _, e in held or self.windows(text))
        wanted = ranks(n)
        out = [len(text)] * len(wanted)
        first = 0
        for at, encoding in held or self.windows(text):
            for k, rank in enumerate(wanted):
                if first <= rank < first + len(encoding):
                    out[k] = at + encoding.token_to_chars(rank - first)[0]
            first += len(encoding)
        return n, out


def draws(key: str) -> list[int]:
    """Four 32-bit numbers of a key."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: str, key: str, units: Units) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and middle, output."""
    h1, h2, h3, h4 = draws(key)
    n, (a, b) = units.cuts(text, lambda n: sorted((h1 % (n + 1), h2 % (n + 1))))
    if not text or h3 % 100 >= PLAIN_FROM or _MARK.search(text):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: str = "1", id_column: str = "doc_id") -> DataFrame:
    """row (the input row), n, form (plain, psm, spm), prefix_chars, middle_chars, output."""
    slim = docs.select(F.struct("*").alias("row"), F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def run(batches):
        units = Units()
        for batch in batches:
            # Short runs of rows: outputs of a batch of long texts don't pile up.
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [transformed(t, key, units) for key, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["row", *kinds])

    schema = slim.select("row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return slim.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; marks can't stand in the parts, so they part it uniquely."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = fill_in_middle(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t,
  ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(t)::BIGINT AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1))::BIGINT AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1))::BIGINT AS b FROM u),
p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:n], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
