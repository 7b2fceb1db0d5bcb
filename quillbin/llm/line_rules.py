"""Line-first cleaning: rules on lines, then a rule on what documents lose by them.

A line (between line feeds) with a word fails if

* punctuation: symbols are over a tenth of its characters, or it has more than one
  exclamation or question mark for each two words, or it has fewer than three words and
  does not end as a sentence does;
* navigation: it has three or more separators, at least one for each three words;
* boilerplate: it has one of ``PHRASES``, or is equal to an earlier line.

Failing lines and lines without a word go.  A document is rejected if over 30 % of the
characters of its words were in failing lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillbin.llm.common import lean, table
from quillbin.llm.tokens import batches
from quillbin.llm.words import SPACES, Words

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
SEPARATORS = "|»›•"
ENDS = ".!?:;…\"'”»)"
#: In lower case.
PHRASES = (
    "all rights reserved",
    "accept cookies",
    "use of cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "subscribe to our newsletter",
    "sign up for our",
    "click here to",
    "skip to content",
    "enable javascript",
    "share on facebook",
    "share on twitter",
    "licensed under",
    "powered by",
)
PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
#: Tenths of the characters of words that failing lines may hold.
LOSS_TENTHS = 3
BLANK = str.maketrans("", "", SPACES)


def fails(line: str, chars: int) -> bool:
    """The rules on a line with a word, but for equality to an earlier line; chars: those of its words."""
    n_words = len(line.encode("utf-8", "surrogatepass").split())
    if 10 * sum(map(line.count, SYMBOLS)) > chars or 2 * sum(map(line.count, MARKS)) > n_words:
        return True
    if n_words < 3 and line.rstrip(SPACES)[-1] not in ENDS:
        return True
    bars = sum(map(line.count, SEPARATORS))
    return bars >= 3 and 3 * bars >= n_words or PHRASE.search(line.lower()) is not None


def clean(text: str) -> tuple[str, int, int]:
    """The lines that stay, the characters of words in failing lines, and the lines equal to an earlier one."""
    seen: set[str] = set()
    stay = []
    lost = again = 0
    for line in text.split("\n"):
        chars = len(line) - sum(map(line.count, SPACES))
        if not chars:
            continue
        if line in seen:
            again += 1
            lost += chars
        elif fails(line, chars):
            lost += chars
        else:
            stay.append(line)
        seen.add(line)
    return "\n".join(stay), lost, again


KINDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "cleaned": pa.string()}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, cleaned string"


def judged(docs: DataFrame, loss_tenths: int = LOSS_TENTHS, keep_text: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` to counts, verdicts and the cleaned text (null unless keep_text), one row for each of docs.

    Null and empty texts have no words and fail the base rule; repeated rows and null ids
    are judged like any other row.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            for some in batches(texts, 2 << 20):
                words = Words(texts[some])
                rows = []
                for i, t, edge, end, repeat in zip(ids[some], texts[some], words.edges, words.edges[1:], words.repeated(), strict=False):
                    n, chars = int(end - edge), len(t) - sum(map(t.count, SPACES))
                    cleaned, lost, again = clean(t)
                    failed = n < 50 or 100 * int(repeat) > 50 * n
                    rows.append((i, n, chars, sum(map(t.count, SYMBOLS)), again, int(repeat), failed, not failed and 10 * lost <= loss_tenths * chars, cleaned if keep_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS.values(), strict=True)], [*KINDS])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(lean(run), SCHEMA)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), keep_text=False).drop("cleaned")


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY r),
l AS (SELECT r, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)),
m AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again,
        length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words,
        len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
        len(regexp_extract_all(line, '[!?]')) AS marks,
        len(regexp_extract_all(line, '[|»›•]')) AS bars
      FROM l),
f AS (SELECT r, again, chars, again OR 10 * symbols > chars OR 2 * marks > n_words
        OR (n_words < 3 AND NOT regexp_matches(line, '[.!?:;…"''”»)][\x20\x09-\x0D]*$'))
        OR (bars >= 3 AND 3 * bars >= n_words)
        OR regexp_matches(lower(line), '{"|".join(PHRASES)}') AS failed
      FROM m WHERE chars > 0),
s AS (SELECT r, sum(chars) AS chars, count(*) FILTER (again) AS dup, coalesce(sum(chars) FILTER (failed), 0) AS lost FROM f GROUP BY r),
o AS (SELECT d.doc_id, len(w.ws) AS n_words, coalesce(s.chars, 0) AS word_chars,
        len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, coalesce(s.dup, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(s.lost, 0) AS lost
      FROM d JOIN w USING (r) LEFT JOIN s USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * lost <= {LOSS_TENTHS} * word_chars AS kept
FROM o
"""
