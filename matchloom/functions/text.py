"""Scalar functions on text: each takes columns and gives a column, and stays in the JVM unless it says otherwise."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def collapse(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed, null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def folded(c: Column) -> Column:
    return F.lower(collapse(c))


def key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def slug(c: Column, sep: str = "-") -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", sep), f"^{sep}|{sep}$", ""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (collapse(c) == "")


def is_blank_json(c: Column) -> Column:
    """A JSON value that says nothing: none, null, an empty or white text, an empty list or object; 0 and false say something."""
    return is_blank(c) | F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "").isin("null", '""', "[]", "{}") | c.rlike(r'^\s*"\s*"\s*$')


def distinct_parts(parts: Column) -> Column:
    """Array of collapsed non-empty texts; of those equal but for case, the first."""
    clean = F.filter(F.transform(parts, collapse), lambda x: x != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def combine(parts: Column) -> Column:
    return F.array_join(distinct_parts(parts), " ")


def keywords(c: Column) -> Column:
    """Parts between commas, semicolons and bars."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;|]"), collapse), lambda x: x != "")


def doi(c: Column) -> Column:
    """Bare lower-case DOI in a text, or the empty text."""
    found = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"(10\.\d{4,9}/\S+)", 1)
    return F.regexp_replace(found, r"[.,;)]+$", "")


def module_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(collapse(c)), r"[\s-]", "")


def module_codes(c: Column, pattern: str = r"\b([A-Z]{2,4}\s?-?\d{3,5})\b") -> Column:
    """All module codes in a text, normalised, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(pattern)), module_code)))


def first_text(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(collapse(c), F.lit("")) for c in cs], F.lit(""))


def year(c: Column) -> Column:
    return F.expr("cast(null as int)") if c is None else F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def urls(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(https?://[^\s\"'<>]+)"))


def domain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.expr("null") if c is None else F.try_parse_url(c, F.lit("HOST")), F.lit(""))), "^www\\.", "")


def number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def whole(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def percentage(c: Column) -> Column:
    """One decimal; a tie of the binary value goes to the even digit (56.25 gives 56.2%), which Java's formats don't. Null stays null. Arrow-batched."""

    @F.pandas_udf("string")
    def said(values: pd.Series) -> pd.Series:
        return values.map(lambda x: f"{x:.1f}%", na_action="ignore").astype(object)

    return said((c * 100).cast("double"))


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def listed(parts: Column) -> Column:
    """One, one and two, or one, two and three."""
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(parts, 1)).otherwise(F.concat(head, F.lit(" and "), F.element_at(parts, -1)))


def stable_id(c: Column, how: str = "sha256", length: int = 20) -> Column:
    made = {"sha256": lambda x: F.sha2(x, 256), "md5": F.md5, "sha1": F.sha1}[how]
    return F.substring(made(F.coalesce(c, F.lit(""))), 1, length)


def replace_ids(text: Column, old: Column, new: Column) -> Column:
    """Every occurrence of an id, in any case, by a name."""
    quoted = F.concat(F.lit("(?i)\\Q"), old, F.lit("\\E"))
    return F.regexp_replace(text, quoted, F.regexp_replace(new, F.lit(r"([\\$])"), F.lit(r"\\$1")))


def topic_text(c: Column) -> Column:
    """Case folded; & is and, slashes and bars are spaces, other signs go."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", " and ")
    s = F.regexp_replace(F.regexp_replace(s, "covid-19", "covid19"), r"[/|_]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\-+.\s]", " "), r"\s+", " "))


def topic_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9+#.\s]", " "), r"\s+", " "))


def rebuilt(inverted: Column) -> Column:
    """Text of a map from words to their places; of two words in a place the later one in order wins."""
    places = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    kept = F.aggregate(F.array_sort(places), F.array().cast("array<struct<at:bigint,word:string>>"),
                       lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["at"] == x["at"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(F.concat(acc, F.array(x))))
    return F.coalesce(F.array_join(F.transform(kept, lambda x: x["word"]), " "), F.lit(""))


#: A module code, and what stands where no code is known yet.
CODE = "[A-Za-z]{2,4}[0-9]{1,4}[A-Za-z0-9]{0,3}"
NO_CODES = ("TB", "TBC", "TBA")


def code_and_title(code: Column, title: Column, slug_text: Column) -> tuple[Column, Column]:
    """(code, title): the title without leading codes; the code if it is one, else from the title, the slug, or a code run into a title; else N/A."""
    c, t, s = (F.trim(F.coalesce(x, F.lit(""))) for x in (code, title, slug_text))
    lead = rf"^({CODE})\s*[-:]\s*"
    in_title = F.upper(F.regexp_extract(t, lead, 1))
    rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, lead, "")), lead, ""))
    plain_title = F.when((in_title != "") & (rest != ""), rest).otherwise(t)
    mashed = F.upper(F.replace(plain_title, F.lit(" "), F.lit("")))
    usable = lambda x: F.when((x != "") & ~x.isin(*NO_CODES) & (x != mashed), x)
    given = usable(F.upper(F.regexp_extract(c, f"^({CODE})$", 1)))
    from_slug = F.nullif(F.upper(F.regexp_extract(s, r"^([a-z]{2,4}[0-9]{1,4}[a-z0-9]{0,3})-", 1)), F.lit(""))
    run_in = F.nullif(F.upper(F.regexp_extract(c, r"^([A-Za-z]{2,4}[0-9]{2,4}[A-Za-z0-9]{0,2})[A-Za-z]+$", 1)), F.lit(""))
    found = F.coalesce(given, F.nullif(in_title, F.lit("")), from_slug, run_in, F.lit(""))
    return F.coalesce(usable(found), F.lit("N/A")), plain_title


# ---- what only Python has; meant for distinct labels ---------------------------------------------


#: What a department label begins and ends with, without meaning.
PREFIXES = ("department of ", "school of ", "division of ")
SUFFIXES = (" department", " school", " division")


def department_text(value: str | None, institutions: tuple[str, ...] = ()) -> str:
    """A department's bare name: without what it begins with, again and again (also the institutions' own names, lower-case), nor what it ends with."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.combining(c)).casefold().replace("&", " and ")
    heads = "|".join(re.escape(x.strip()) for x in (*PREFIXES, *institutions))
    tails = "".join(f"(?:{x})?" for x in reversed(SUFFIXES))
    bare = re.sub(rf"^(?:(?:{heads}) )+", "", " ".join(re.findall("[a-z0-9]+", plain)))
    return re.sub(f"{tails}$", "", bare)


def plain_text(value: str | None) -> str:
    """Entities resolved, tags dropped, white space collapsed."""
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", html.unescape(value or "")))).strip()


def repaired(value: str | None) -> str:
    """UTF-8 that was read as cp1252, read again; any other text as it is."""
    text = value or ""
    if not any(m in text for m in ("â", "Ã", "Â")):
        return text
    try:
        return text.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text


def ascii_topic(value: str | None) -> str:
    """Topic text in ASCII; c++, c# and .net survive."""
    s = unicodedata.normalize("NFKD", (value or "").strip()).encode("ascii", "ignore").decode().lower()
    for a, b in (("c++", "cplusplus"), ("c#", "csharp"), (".net", "dotnet"), ("&", " and ")):
        s = s.replace(a, b)
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", s)).strip()


def vectorised(f):
    """An Arrow-batched UDF of a text function."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(f, na_action=None)

    return run
