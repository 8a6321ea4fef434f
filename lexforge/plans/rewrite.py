"""Query rewriting: one query at a time, in batches on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LITERALS, content_key, lookup_key

# Words of questions, and bounds of terms.
MULTI_EVIDENCE = ("两首", "两篇", "多首", "多个作品", "分别", "各自", "对比", "比较")
TAIL = ("结尾", "最后", "末尾", "收尾", "尾句", "结束处")
DYNASTY_SUFFIXES = ("代", "朝", "诗", "词", "曲", "赋", "人", "时期", "时代", "文学", "作品")
NATURAL = ("怎样", "怎么", "如何", "什么", "为什么", "哪些", "哪一", "描写", "表达", "关于", "中的", "诗句", "意象", "情感", "赏析", "译文", "意思", "写", "诗", "词", "曲")
STOPWORDS = (
    "请找", "请问", "帮我", "一下", "有关", "关于", "中的", "之中", "怎样", "怎么", "如何", "什么", "为什么", "哪些", "哪一", "描写", "夸张", "表达", "说明", "赏析", "译文", "意思", "诗句", "诗歌", "作品", "意象", "情感", "作者", "诗人", "朝代",
    "句子", "词句", "所见", "散曲", "写于", "写在", "为了", "我们", "他们", "以及", "并且", "或者", "然后", "其中", "可以", "能够", "没有", "不是", "的", "和", "与", "及", "在", "中", "了", "是", "有", "哪", "年", "吗", "呢", "写", "诗", "词", "曲",
)
UNAVAILABLE = ("写于哪一年", "创作于哪一年", "作于哪一年", "哪一年创作", "哪一年写成", "出生地", "出生于哪里", "出生在哪里", "生于何地", "生卒年")
CLAUSE_STARTS = ("描写", "关于", "写")
CLAUSE_ENDS = ("的作品", "的唐诗", "的宋词", "的元曲", "的诗", "的词", "的曲", "并说明", "并解释", "并分析", "并比较", "，", ",", "；", ";", "。")
FRAGMENTS = re.compile("以及|和|与|、")
LETTER_RUN = re.compile("[㐀-鿿]+")
MOST_TERMS, MOST_GROUP_TERMS, NATURAL_LENGTH = 8, 5, 8


@dataclass(frozen=True)
class Lexicon:
    """concepts: (name, triggers, expansions)."""

    concepts: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()
    authors: tuple[str, ...] = ()
    dynasties: tuple[str, ...] = ()
    intents: tuple[str, ...] = ()

    @staticmethod
    def of(row) -> Lexicon:
        """From a row of the lexicon reader."""
        return Lexicon(tuple((c.name, tuple(c.triggers), tuple(c.expansions)) for c in row.concepts), tuple(row.known_authors), tuple(row.known_dynasties), tuple(row.poetic_intent_terms))


@dataclass
class Rewrite:
    original_query: str
    variants: list[str] = field(default_factory=list)
    matched_concepts: list[str] = field(default_factory=list)
    matched_entities: list[str] = field(default_factory=list)
    matched_authors: list[str] = field(default_factory=list)
    matched_dynasties: list[str] = field(default_factory=list)
    explicit_titles: list[str] = field(default_factory=list)
    content_terms: list[str] = field(default_factory=list)
    concept_terms: list[str] = field(default_factory=list)
    content_term_groups: list[list[str]] = field(default_factory=list)
    content_term_group_anchors: list[list[str]] = field(default_factory=list)
    multi_evidence: bool = False
    prefer_tail: bool = False
    unavailable: bool = False


def distinct(values) -> list[str]:
    """Values with a lookup key that did not occur before."""
    seen: dict[str, str] = {}
    for v in values:
        if key := lookup_key(v):
            seen.setdefault(key, v)
    return list(seen.values())


def holds_any(text: str, terms) -> bool:
    return any(lookup_key(t) in text for t in terms)


class Cover:
    """The parts of a query that terms have taken."""

    def __init__(self, query: str):
        self.query, self.spans = query, []

    def places(self, term: str) -> list[tuple[int, int]]:
        key = lookup_key(term)
        return [(m.start(), m.start() + len(key)) for m in re.finditer(f"(?={re.escape(key)})", self.query)] if key else []

    def free(self, term: str) -> list[tuple[int, int]]:
        return [(s, e) for s, e in self.places(term) if all(e <= a or s >= b for a, b in self.spans)]

    def take(self, spans) -> bool:
        self.spans += spans
        return bool(spans)


def run_terms(run: str):
    """The run itself up to four letters, then its pairs and triples."""
    if len(run) <= 4:
        yield run
    for n in (2, 3):
        yield from (run[i : i + n] for i in range(len(run) - n + 1))


def gathered(candidates, limit: int) -> list[str]:
    """The first limit different lookup keys of two letters or more."""
    out: list[str] = []
    for c in candidates:
        key = lookup_key(c)
        if len(key) >= 2 and key not in out:
            out.append(key)
            if len(out) >= limit:
                break
    return out


def runs_without(text: str, excluded) -> list[str]:
    for word in sorted({*STOPWORDS, *MULTI_EVIDENCE, *excluded} - {""}, key=lambda w: (-len(w), w)):
        text = text.replace(word, " ")
    return LETTER_RUN.findall(text)


def is_natural(query: str) -> bool:
    return len(query) >= NATURAL_LENGTH and any(m in query for m in NATURAL)


def clause(query: str) -> str:
    """The part of a question that names what several works are about."""
    start = query.find("分别") + 2 if "分别" in query else 0
    marks = [(p, -len(m), len(m)) for m in CLAUSE_STARTS if (p := query.find(m, start)) >= 0]
    if marks:
        at, _, size = min(marks)
        start = at + size
    ends = [p for m in CLAUSE_ENDS if (p := query.find(m, start)) >= 0]
    fallback = query.find("的", start)
    return query[start : min(ends) if ends else fallback if fallback >= 0 else len(query)].strip()


def term_groups(query: str, excluded, lexicon: Lexicon) -> tuple[list[list[str]], list[list[str]]]:
    """Terms and anchors of each fragment of the clause, if it has two fragments or more."""
    parts = [p.strip() for p in FRAGMENTS.split(clause(query)) if p.strip()] if is_natural(query) else []
    if len(parts) < 2:
        return [], []
    limit = MOST_GROUP_TERMS if len(parts) == 2 else max(1, min(MOST_GROUP_TERMS, MOST_TERMS // len(parts)))
    expansions = [e for _, _, found in lexicon.concepts for e in found]
    groups, anchors = [], []
    for part in parts:
        themes = [e for _, triggers, found in lexicon.concepts if holds_any(lookup_key(part), triggers) for e in found]
        terms = gathered([content_key(part), *themes, *(t for run in runs_without(part, excluded) for t in run_terms(run))], limit)
        if terms:
            groups.append(terms)
            own = next((a for run in runs_without(part, expansions) if (a := gathered(run_terms(run), 2))), [])
            anchors.append(own or next(([run[:2]] for run in LETTER_RUN.findall(lookup_key(part)) if len(run) >= 2), []))
    return groups, anchors


def rewrite(query: str, lexicon: Lexicon) -> Rewrite:
    """Variants of a query with their origin: literals, authors, concepts and dynasties where the query is about works, then terms."""
    key, out = lookup_key(query), Rewrite(query)
    if not key:
        return out
    found = [[m.group(1).strip() for m in re.finditer(p, query)] for p in LITERALS]
    literals = distinct(x for part in found for x in part)
    out.explicit_titles = distinct(found[0])
    variants = list(literals)
    cover = Cover(key)
    cover.take([s for _, triggers, _ in lexicon.concepts for t in triggers for s in cover.places(t)])
    for author in lexicon.authors:
        if cover.take(cover.free(author)):
            out.matched_authors.append(author)
    variants += out.matched_authors
    intent = holds_any(key, lexicon.intents)
    if intent or out.explicit_titles:
        for name, triggers, expansions in lexicon.concepts:
            if holds_any(key, triggers):
                out.matched_concepts.append(name)
                out.concept_terms += [*triggers, *expansions]
                variants += expansions
        for dynasty in lexicon.dynasties:
            spans = cover.free(dynasty)
            if key != lookup_key(dynasty):
                spans = [(s, e) for s, e in spans if key[e:].startswith(DYNASTY_SUFFIXES)]
            if cover.take(spans):
                out.matched_dynasties.append(dynasty)
        variants += out.matched_dynasties
    out.matched_entities = out.matched_authors + out.matched_dynasties
    out.multi_evidence = any(t in key for t in MULTI_EVIDENCE) or len(out.explicit_titles) >= 2
    out.prefer_tail, out.unavailable = any(t in key for t in TAIL), holds_any(key, UNAVAILABLE)
    quoted = any(x not in out.explicit_titles for x in literals)
    if (intent or out.matched_concepts or out.matched_entities or out.explicit_titles) and not quoted:
        excluded = [*out.explicit_titles, *out.matched_entities, *out.concept_terms]
        if out.multi_evidence:
            out.content_term_groups, out.content_term_group_anchors = term_groups(key, excluded, lexicon)
            out.content_terms = distinct(t for part in (out.content_term_groups, out.content_term_group_anchors) for g in part for t in g)
        if not out.content_terms and is_natural(key):
            out.content_terms = gathered((t for run in runs_without(query, excluded) for t in run_terms(run)), MOST_TERMS)
    out.concept_terms = distinct(out.concept_terms)
    out.variants = distinct([*variants, *out.content_terms])
    return out


SCHEMA = ", ".join(f"{f.name} " + ("boolean" if f.type == "bool" else "string" if f.type == "str" else "array<array<string>>" if "list[list" in f.type else "array<string>") for f in fields(Rewrite))


def selection_terms(r: Rewrite) -> list[str]:
    """Terms that selectors look for: the content's, else the concepts', else the variants, without titles."""
    titles = {lookup_key(x) for x in r.explicit_titles}
    for terms in (r.content_terms, r.concept_terms, r.variants):
        if found := [x for x in distinct(terms) if lookup_key(x) not in titles]:
            return found
    return []


def weighted(r: Rewrite) -> list[tuple]:
    """(ord, question, weight, title, author, dynasty) of the query and its variants: the weight by the first list that holds the variant, and whether it is one of these names."""
    keys = lambda values: {lookup_key(x) for x in values}
    titles, authors, dynasties = keys(r.explicit_titles), keys(r.matched_authors), keys(r.matched_dynasties)
    quoted = keys(m.group(1) for p in LITERALS for m in re.finditer(p, r.original_query))
    held = (({lookup_key(r.original_query)}, 3.0), (titles, 2.5), (quoted, 3.0), (authors | dynasties, 2.0), (keys(r.concept_terms), 1.5))
    terms, out = keys(r.content_terms), []
    for i, variant in enumerate(distinct([r.original_query, *r.variants])):
        key = lookup_key(variant)
        weight = next((w for found, w in held if key in found), (1.5 if len(key) >= 4 else 0.5) if key in terms else 1.0)
        out.append((i, variant, weight, key in titles, key in authors, key in dynasties))
    return out


RUNS = "runs array<struct<ord:int,question:string,weight:double,title:boolean,author:boolean,dynasty:boolean>>, terms array<string>"


def rewritten(queries: DataFrame, lexicon: Lexicon) -> DataFrame:
    """query_id and question of queries, with the rewrite's columns, the runs (weighted variants) and the selectors' terms; a null question is an empty one."""
    names = [f.name for f in fields(Rewrite)]
    places = ("ord", "question", "weight", "title", "author", "dynasty")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [rewrite(q or "", lexicon) for q in batch["question"]]
            columns = {n: [getattr(r, n) for r in made] for n in names} | {"runs": [[dict(zip(places, v)) for v in weighted(r)] for r in made], "terms": [selection_terms(r) for r in made]}
            yield batch.assign(**{n: pd.Series(v, index=batch.index, dtype=object) for n, v in columns.items()})

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "question").mapInPandas(run, f"query_id long, question string, {SCHEMA}, {RUNS}")


def rewrites(spark: SparkSession, queries: list[tuple[int, str]], lexicon: Lexicon) -> DataFrame:
    """The same of a list of queries."""
    return rewritten(spark.createDataFrame(queries, "query_id long, question string"), lexicon)
