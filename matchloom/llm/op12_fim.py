"""Operator 12: fill-in-middle transformation of whole texts.

An Arrow-batched pandas UDF: the `regex` library's finditer gives the end offset of each unit (white
space and the word after it, or white space alone at the end), kept in a compact array; two lookups there
cut the text into prefix, middle and suffix; hashlib makes the seeds from the id, and the digests.

Null counts as the empty text, which stays as it is (`plain`), as do texts that hold a marker. A null id
seeds as the empty string, so the choice is defined for it too. Repeated rows give repeated results; an empty table gives
none. Offsets and lengths are code points. Only the id and the text are read, so extra columns do no harm;
those to be kept must not be named like results.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import no_clash

UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
P, S, M = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Rates:
    """In a hundred: of texts that are transformed, and of these of the form suffix, prefix, middle."""

    transformed: int = 50
    spm: int = 80


def unit_ends(text: str) -> array:
    """Where each unit ends."""
    return array("q", (m.end() for m in UNIT.finditer(text)))


def seeds(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, key: str, seed: int, rates: Rates) -> tuple[str, int, str, int | None, int | None]:
    """Output, number of units, form, and the lengths of prefix and middle."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = seeds(key, seed)
    if not text or h3 % 100 >= rates.transformed or P in text or S in text or M in text:
        return text, len(ends), PLAIN, None, None
    first, last = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < rates.spm:
        return f"{S}{suffix}{P}{prefix}{M}{middle}", len(ends), SPM, a, b - a
    return f"{P}{prefix}{S}{suffix}{M}{middle}", len(ends), PSM, a, b - a


def restore(output: str, form: str) -> str:
    """The text that an output was made from: markers don't occur in it, nor across its cuts."""
    if form == PLAIN:
        return output
    head, middle = output.split(M, 1)
    first, second = head.split(P if form == SPM else S, 1)
    return second + middle + first[len(S) :] if form == SPM else first[len(P) :] + middle + second


_PARTS = "n long, form string, prefix_chars long, middle_chars long"


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({c: "Int64" for c in ("prefix_chars", "middle_chars")})


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _column(digests: bool, seed: int, rates: Rates):
    names = [*(("output_sha256", "restored_sha256") if digests else ("output",)), "n", "form", "prefix_chars", "middle_chars"]

    @F.pandas_udf(("output_sha256 string, restored_sha256 string, " if digests else "output string, ") + _PARTS)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for key, text in zip(ids.fillna(""), texts.fillna("")):
                output, *rest = transform(text, key, seed, rates)
                rows.append((_sha(output), _sha(restore(output, rest[1])), *rest) if digests else (output, *rest))
            yield _frame(rows, names)

    return made


def _key(doc_id: str) -> Column:
    return F.col(doc_id).cast("string")


def fill_in_middle(docs: DataFrame, seed: int = 42, rates: Rates = Rates(), keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`keep`, output (the text to train on), n (units), form, prefix_chars and middle_chars of every row."""
    no_clash(keep, "output", "n", "form", "prefix_chars", "middle_chars")
    made = docs.select(*keep, _column(False, seed, rates)(_key(doc_id), F.col(text)).alias("__made"))
    return made.select(*keep, "__made.*")


def restored(made: DataFrame, output: str = "output", form: str = "form") -> Column:
    """The texts that outputs were made from."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return back(made[output], made[form])


def digests(docs: DataFrame, seed: int = 42, rates: Rates = Rates(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of each output and of the text restored from it; outputs stay in the task."""
    made = docs.select(F.col(doc_id).alias("doc_id"), _column(True, seed, rates)(_key(doc_id), F.col(text)).alias("__made"))
    return made.select("doc_id", "__made.n", "__made.form", "__made.prefix_chars", "__made.middle_chars", "__made.output_sha256", "__made.restored_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
s AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM s),
c AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS x FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || x || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || x || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || x END) AS restored_sha256 FROM c
"""
