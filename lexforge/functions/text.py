"""Text functions as columns. Native forms stay in the JVM; lookup_form and content_form, the keys of searches, add NFKC and case folding where a text needs it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

NOT_WORD = r"[^\p{L}\p{N}]+"
STRONG, WEAK = "。！？!?；;", "，,、"
#: Patterns of quoted literals, in order.
LITERALS = (r"《([^《》]{1,100})》", r"“([^“”]{1,100})”", r"‘([^‘’]{1,100})’", r'"([^"]{1,100})"')
#: Fixed value: the pattern of citation markers.
CITATION = r"\[(\d+(?:\s*[,，]\s*\d+)*)\]"
_GAPS = re.compile(r"[\W_]+")


def lookup_key(text: str | None) -> str:
    """NFKC, stripped, case-folded."""
    return unicodedata.normalize("NFKC", text or "").strip().casefold()


def content_key(text: str | None) -> str:
    """NFKC and case-folded, letters and digits only."""
    return _GAPS.sub("", unicodedata.normalize("NFKC", text or "").casefold())


#: Bytes of texts that become Python strings together.
FORM_BYTES = 1 << 20


def formed(text: pa.Array, form: Callable[[str], str]) -> pa.Array:
    """The forms of an array's texts, made in slices of about FORM_BYTES; null stays null."""
    step = max(1, len(text) * FORM_BYTES // max(1, text.nbytes))
    parts = [pa.array([None if t is None else form(t) for t in text.slice(i, step).to_pylist()], pa.string()) for i in range(0, len(text), step)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def normalize_lookup_full(text: pa.Array) -> pa.Array:
    return formed(text, lookup_key)


@F.arrow_udf(StringType())
def normalize_content_full(text: pa.Array) -> pa.Array:
    return formed(text, content_key)


@F.arrow_udf(ArrayType(StringType()))
def lookup_forms(texts: pa.Array) -> pa.Array:
    """The lookup forms of the texts of an array."""
    return pa.array([None if values is None else [lookup_key(v) for v in values] for values in texts.to_pylist()], pa.list_(pa.string()))


#: White space of all kinds, as strip() takes it off.
SPACES = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())


def required_text(value: Column, line: Column, *path: str) -> tuple[Column, Column]:
    """(text, error) of a field of a variant under a path of keys: the stripped text, or why there is none, with the number of the line.

    On the way every key has to hold an object, the last one a text that is not blank. Keys hold no double quote.
    """
    at = lambda n: "$" + "".join(f'["{k}"]' for k in path[:n])
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(value, at(n), "variant")), F.lit(""))
    missing = lambda what: F.concat(F.lit("line "), line.cast("string"), F.lit(f": missing {what}"))
    text = F.trim(F.when(kind(len(path)) == "STRING", F.try_variant_get(value, at(len(path)), "string")), F.lit(SPACES))
    found = F.length(text) > 0
    error = F.when(~F.coalesce(found, F.lit(False)), missing(".".join(path)))
    for n in range(len(path) - 1, 0, -1):
        error = F.when(~F.startswith(kind(n), F.lit("OBJECT")), missing(".".join(path[:n]) + " object")).otherwise(error)
    return F.when(error.isNull(), text), error


def is_plain_letter(letter: str) -> bool:
    """Whether NFKC leaves a letter alone beside any other such letter and folding is its lower case, or ss for ß. Meant for letters of PLAIN_RANGES, in which none joins with the one before it but marks."""
    same = unicodedata.normalize("NFKC", letter) == letter and not unicodedata.combining(letter) and not letter.isspace() and unicodedata.category(letter) not in ("Cc", "Cn")
    return same and (letter == "ß" or (letter.casefold() == letter.lower() and len(letter.lower()) == 1))


#: Latin letters, punctuation and ideographs, of which the plain ones are formed natively.
PLAIN_RANGES = ((0x80, 0x180), (0x2010, 0x2028), (0x20AC, 0x20AD), (0x4E00, 0x9FF0))


def plain_class() -> str:
    """ASCII and the plain letters as the inside of a class of a regular expression."""
    points = [c for low, high in PLAIN_RANGES for c in range(low, high) if is_plain_letter(chr(c))]
    starts = [c for c, before in zip(points, [-1, *points]) if c != before + 1]
    ends = [c for c, after in zip(points, [*points[1:], -1]) if c != after - 1]
    return r"\x00-\x7f" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))


#: A run of a class from end to end; looking for a letter outside of it takes ten times as long.
PLAIN = rf"\A[{plain_class()}]*+\z"


def is_plain(text: Column) -> Column:
    """Whether NFKC leaves a text alone and folding is the lower case: ASCII, of as many bytes as letters, or plain letters only."""
    return (F.octet_length(text) == F.length(text)) | F.rlike(text, F.lit(PLAIN))


#: Marks of letter_table: a letter that goes, and one whose text needs NFKC.
DROPPED, OTHER = 0, 0xFFFF


def letter_table() -> np.ndarray:
    """What content_key makes of each ASCII and plain letter by its number; ß and all others, among them those beyond the table, are OTHER."""
    table = np.full(max(high for _, high in PLAIN_RANGES) + 1, OTHER, np.uint16)
    for low, high in ((0, 0x80), *PLAIN_RANGES):
        for c in range(low, high):
            if c < 0x80 or (chr(c) != "ß" and is_plain_letter(chr(c))):
                table[c] = DROPPED if _GAPS.match(chr(c)) else ord(chr(c).casefold())
    return table


def content_keys(texts: list[str | None], table: np.ndarray) -> list[str | None]:
    """content_key of each text by letter_table, and by NFKC for those that need it; null stays null."""
    plain = [(t or "").replace("ß", "ss") for t in texts]
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([0, *map(len, plain)])
    made = table[np.minimum(points, len(table) - 1)]
    kept = made != DROPPED
    at = np.concatenate([[0], np.cumsum(kept)])[ends].tolist()
    odd = np.diff(np.concatenate([[0], np.cumsum(made == OTHER)])[ends]) > 0
    letters = made[kept].astype(np.uint32).tobytes().decode("utf-32-le", "replace")
    return [None if t is None else content_key(t) if other else letters[a:b] for t, other, a, b in zip(texts, odd.tolist(), at, at[1:])]


def folded(text: Column) -> Column:
    """The case folding of a plain text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


#: ASCII white space that strip() takes off.
STRIPPED = "".join(chr(c) for c in range(0x80) if chr(c).isspace())


def lookup_form(text: Column) -> Column:
    """NFKC, stripped, case-folded: natively for plain texts, in Arrow batches for others, which alone are sent."""
    return F.coalesce(normalize_lookup_full(F.when(~is_plain(text), text)), folded(F.trim(text, F.lit(STRIPPED))))


def content_form(text: Column) -> Column:
    """NFKC and case-folded, letters and digits only; natively where lookup_form is."""
    return F.coalesce(normalize_content_full(F.when(~is_plain(text), text)), F.regexp_replace(folded(text), NOT_WORD, ""))


def normalize_lookup(text: Column) -> Column:
    return F.lower(F.trim(text))


def normalize_content(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), NOT_WORD, "")


def one_upper(letter: str) -> str:
    """The upper case of a letter as SQL's upper() has it: one letter for one, the title case or the letter itself where the full form has several; ß is ẞ."""
    return "ẞ" if letter == "ß" else next((x for x in (letter.upper(), letter.title()) if len(x) == 1), letter)


#: Letters that one_upper changes, and what it makes of them.
LOWER_LETTERS = "".join(c for c in map(chr, range(0x80, 0x20000)) if one_upper(c) != c)
UPPER_LETTERS = "".join(map(one_upper, LOWER_LETTERS))


def upper_by_letter(text: Column) -> Column:
    """text with as many letters in upper case; F.upper makes SS of ß."""
    ascii_letters = "".join(map(chr, range(ord("a"), ord("z") + 1)))
    return F.translate(text, ascii_letters + LOWER_LETTERS, ascii_letters.upper() + UPPER_LETTERS)


def length_bucket(text: Column, short: int = 80, medium: int = 300) -> Column:
    size = F.length(text)
    return F.when(size < short, "short").when(size <= medium, "medium").otherwise("long")


def mapped(value: Column, names: dict[str, str]) -> Column:
    """names[value], or the value itself."""
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, value), value)


def citation_ranks(answer: Column) -> Column:
    """Ranks in [1] or [1, 2] markers, each once, in order of appearance."""
    marks = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.transform(F.split(m, r"[,，]"), lambda x: F.trim(x).cast("int")))))


def literals(text: Column) -> Column:
    """Quoted literals in the order of the patterns, trimmed, the first of each lookup key."""
    found = F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in LITERALS)), F.trim)
    return distinct_by_key(found)


def distinct_by_key(values: Column) -> Column:
    """Non-blank values whose lookup key did not occur before."""
    keys = F.transform(values, normalize_lookup)
    return F.filter(values, lambda v, i: (normalize_lookup(v) != "") & (F.array_position(keys, normalize_lookup(v)) == i + 1))


def gram_terms(run: Column, most: int = 8) -> Column:
    """Terms of an unbroken run of letters: the run itself up to four letters, its pairs, its triples; the first most of at least two."""
    size = F.length(run)
    grams = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - (n - 1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    whole = F.when((size >= 2) & (size <= 4), F.array(run)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(whole, grams(2), grams(3))), 1, most)


def strip_terms(text: Column, terms: list[str]) -> Column:
    """text with every term replaced by a blank, longest terms first."""
    for term in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)):
        text = F.replace(text, F.lit(term), F.lit(" "))
    return text


def contains_any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(text, t))


def content_overlap(text: Column, terms: Column) -> Column:
    """Sum of the squared lengths of the terms that text holds; repeated terms count again."""
    kept = F.filter(terms, lambda t: (t != "") & F.contains(text, t))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, t: a + F.length(t) * F.length(t))


def group_score(text: Column, title: Column, terms: Column, anchors: Column) -> Column:
    """Overlap of text and title with terms, doubled where an anchor occurs, and the anchors' own share."""
    anchor = 2 * content_overlap(text, anchors) + 3 * content_overlap(title, anchors)
    return (content_overlap(text, terms) + content_overlap(title, terms)) * F.when(anchor > 0, 2).otherwise(1) + anchor


def title_matches(candidate: Column, target: Column) -> Column:
    """Equal lookup keys, or a prefix that something else than a CJK letter follows."""
    c, t = normalize_lookup(candidate), normalize_lookup(target)
    rest = F.substring(c, F.length(t) + 1, F.length(c))
    return (c == t) | (c.startswith(t) & (F.length(rest) > 0) & ~rest.rlike("^[\\x{3400}-\\x{9fff}]"))


def is_verse(content: Column, title: Column, most: int = 600, line_most: int = 45, line_short: int = 30, short_share: float = 0.8, letter_share: float = 0.6, letters: str = r"[\x{4e00}-\x{9fff}]") -> Column:
    """The verse heuristic on trimmed text: nothing blank or long; a dot in the title decides; else two or more short lines, mostly of letters.

    Surrounding white space goes first, so an indent of the first line does not count.
    """
    body = F.regexp_replace(content, r"^\s+|\s+$", "")
    sizes = F.transform(F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), F.trim), lambda x: x != ""), F.length)
    short = F.size(F.filter(sizes, lambda n: n <= line_short))
    shape = (F.size(sizes) >= 2) & (F.array_max(sizes) <= line_most) & (short >= short_share * F.size(sizes))
    share = F.length(body) - F.length(F.regexp_replace(body, letters, "")) >= letter_share * F.length(body)
    return F.when((body == "") | (F.length(body) > most), False).when(F.contains(title, F.lit("·")), True).otherwise(F.coalesce(shape & share, F.lit(False)))


def preview(text: Column, most: int = 80) -> Column:
    """White space compacted, cut to most letters with three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def vector_id(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name, computed with sha1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    nibble = F.element_at(F.split(F.lit("8,9,a,b"), ","), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(nibble, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def ratio(numerator: Column, denominator: Column) -> Column:
    """The quotient rounded to six places, 0.0 for a zero denominator."""
    return F.round(F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0)), 6)


def f1(precision: Column, recall: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 6)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, summed in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def clamped(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


@F.pandas_udf(StringType())
def redacted(text: pd.Series) -> pd.Series:
    """JSON with the values of keys that name a secret replaced, at any depth; other text is left as it is."""
    import json

    markers = ("key", "token", "secret", "password", "authorization")

    def clean(value):
        if isinstance(value, dict):
            return {k: "[REDACTED]" if any(m in k.lower() for m in markers) else clean(v) for k, v in value.items()}
        return [clean(v) for v in value] if isinstance(value, list) else value

    def run(value):
        try:
            return json.dumps(clean(json.loads(value)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return value

    return text.map(run, na_action="ignore")
