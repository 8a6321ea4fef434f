import random
import uuid

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.functions import text as t
from lexforge.operators import chunking
from lexforge.plans import rewrite as rw
from lexforge.streaming.chat import split_frames


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column).first()[0]


def test_normalisers(spark):
    assert one(spark, t.normalize_content_full("x"), x="Ａ b_c，静夜思ß²") == "abc静夜思ss2"
    assert one(spark, t.normalize_lookup_full("x"), x=" Ｔitle ß ") == "title ss"
    assert one(spark, t.normalize_content(F.col("x")), x="A b_c，静夜思!") == "abc静夜思"
    assert one(spark, t.normalize_lookup_full("x"), x=None) is None


def test_citations_literals_and_terms(spark):
    assert one(spark, t.citation_ranks(F.col("x")), x="a [2] b [1, 3，2] [x] []") == [2, 1, 3]
    assert one(spark, t.literals(F.col("x")), x='读《静夜思》和“明月” "明月" ‘霜’《 静夜思 》') == ["静夜思", "明月", "霜"]
    assert one(spark, t.gram_terms(F.col("x")), x="竹林月") == ["竹林月", "竹林", "林月"]
    assert one(spark, t.gram_terms(F.col("x")), x="竹林月夜幽居") == ["竹林", "林月", "月夜", "夜幽", "幽居", "竹林月", "林月夜", "月夜幽"]
    assert one(spark, t.gram_terms(F.col("x")), x="月") == []
    assert one(spark, t.strip_terms(F.col("x"), ["的", "关于", "关"]), x="关于月的诗") == " 月 诗"
    assert one(spark, t.content_overlap(F.col("x"), F.col("y")), x="ab cd", y=["ab", "cd ", "ab", ""]) == 8
    assert one(spark, t.group_score(F.lit("洛城思乡"), F.lit("洛城"), F.array(F.lit("思乡")), F.array(F.lit("洛城"))), x="") == 4 * 2 + 2 * 4 + 3 * 4


def test_titles_and_verse(spark):
    match = t.title_matches(F.col("a"), F.col("b"))
    assert one(spark, match, a="静夜思（其一）", b="静夜思") and one(spark, match, a=" 静夜思", b="静夜思")
    assert not one(spark, match, a="静夜思集", b="静夜思")
    verse = t.is_verse(F.col("a"), F.col("b"))
    assert one(spark, verse, a="床前明月光\n疑是地上霜", b="x") and one(spark, verse, a="一行", b="词·牌")
    assert not one(spark, verse, a="only latin\nlines here", b="x") and not one(spark, verse, a="床前明月光", b="x") and not one(spark, verse, a="字" * 601, b="词·牌")


def test_identifiers_and_redaction(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    for name in ("1:line:v1:0:ab", "静"):
        assert one(spark, t.vector_id(ns, F.col("x")), x=name) == str(uuid.uuid5(uuid.UUID(ns), name))
    assert one(spark, t.redacted("x"), x='{"a":{"API_Key":1,"b":[{"token":"t"}]}}') == '{"a":{"API_Key":"[REDACTED]","b":[{"token":"[REDACTED]"}]}}'
    assert one(spark, t.redacted("x"), x="no json") == "no json"
    assert one(spark, t.mapped(F.col("x"), {"唐代": "唐"}), x="宋") == "宋"


def test_ratios(spark):
    row = spark.range(1).select(t.ratio(F.lit(1), F.lit(3)), t.ratio(F.lit(1), F.lit(0)), t.f1(F.lit(0.0), F.lit(0.0)), t.clamped(F.lit(1.5))).first()
    assert tuple(row) == (0.333333, 0.0, 0.0, 1.0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab。，\n\r !", max_size=80), st.integers(1, 12))
def test_pieces_fit_and_lose_no_letter(text, most):
    found = chunking.pieces(text, most)
    assert all(0 < len(p) <= most and p == p.strip() for p in found)
    assert "".join("".join(found).split()) == "".join(text.split())


def test_pieces_prefer_strong_then_weak_marks():
    assert chunking.pieces("一二三。四五，六七八九", 6) == ["一二三。", "四五，", "六七八九"] or chunking.pieces("一二三。四五，六七八九", 6)[0] == "一二三。"
    assert chunking.pieces("abcdefgh", 3) == ["abc", "def", "gh"]
    assert chunking.pieces("ab\n\ncd", 50) == ["ab", "cd"]


def test_chunks(spark):
    notes = [{"annotation_id": 5, "content": "n1", "line_start": 1, "line_end": 2}, {"annotation_id": 6, "content": "n2", "line_start": None, "line_end": None}]
    rows = chunking.drafts("l1\r\n\r\nl3\n", notes)
    assert [(r[0], r[1], r[2], r[5], r[6], r[7]) for r in rows] == [("poem", 0, "l1\nl3", 1, 3, None), ("line", 0, "l1", 1, 1, None), ("line", 1, "l3", 3, 3, None), ("note", 0, "n1", 1, 2, 5), ("note", 1, "n2", None, None, 6)]
    packed = [r for r in chunking.drafts("aaaa\nbbbb\n\ncc\n" + "d" * 12, [], {**chunking.MOST, "poem": 9}) if r[0] == "poem"]
    assert [(r[2], r[5], r[6]) for r in packed] == [("aaaa\nbbbb", 1, 2), ("cc", 4, 4), ("d" * 9, 5, 5), ("ddd", 5, 5)]
    try:
        chunking.drafts("x", [{"annotation_id": 1, "content": "c", "line_start": 2, "line_end": 1}])
        raise AssertionError
    except ValueError:
        pass
    frame = spark.createDataFrame([(1, "a\nb"), (2, ""), (3, None)], "id long, content string")
    assert [(r.id, r.granularity, r.chunk_index) for r in chunking.chunk_texts(frame).collect()] == [(1, "poem", 0), (1, "line", 0), (1, "line", 1)]


def test_incremental_frames_equal_whole_ones():
    stream = ": hi\r\nevent: a\r\ndata: 1\r\ndata: 2\r\n\r\ndata: x\n\nevent: none\n\nevent: b\ndata: y\n\n"
    whole, rest = split_frames("", stream)
    assert whole == [("a", "1\n2"), ("message", "x"), ("b", "y")] and rest == ""
    random.seed(1)
    for _ in range(20):
        cuts = sorted(random.sample(range(len(stream.replace("\r\n", "\n"))), 5))
        flat, got, buffer = stream.replace("\r\n", "\n"), [], ""
        for a, b in zip([0, *cuts], [*cuts, len(flat)]):
            frames, buffer = split_frames(buffer, flat[a:b])
            got += frames
        assert got == whole


LEXICON = rw.Lexicon((("moon", ("月亮", "明月"), ("明月", "月光")), ("homesickness", ("思乡",), ("故乡", "思乡"))), ("李白", "杜甫"), ("唐", "宋"), ("诗", "描写"))


def test_rewrite(spark):
    r = rw.rewrite("李白怎样描写明月和黄河的诗句", LEXICON)
    assert r.matched_authors == ["李白"] and r.matched_concepts == ["moon"] and r.variants[:3] == ["李白", "明月", "月光"] and "黄河" in r.content_terms and not r.multi_evidence
    assert rw.rewrite("唐诗里的月亮", LEXICON).matched_dynasties == ["唐"] and rw.rewrite("荒唐的故事诗", LEXICON).matched_dynasties == []
    titles = rw.rewrite("比较《静夜思》和《望月怀远》", LEXICON)
    assert titles.explicit_titles == ["静夜思", "望月怀远"] and titles.multi_evidence
    groups = rw.rewrite("哪两首诗分别描写洛城思乡和阳关送别的作品？", LEXICON)
    assert len(groups.content_term_groups) == 2 and groups.content_term_groups[0][:3] == ["洛城思乡", "故乡", "思乡"] and groups.content_term_group_anchors[0] == ["洛城"]
    assert rw.rewrite("", LEXICON).variants == [] and rw.rewrite("“明月”的诗", LEXICON).content_terms == []
    assert rw.rewrite("杜甫的出生地", LEXICON).unavailable and rw.rewrite("这首诗的结尾", LEXICON).prefer_tail
    assert rw.rewrites(spark, [(1, "李白的诗"), (2, "x")], LEXICON).where("size(variants) > 0").count() == 1


def test_search_forms_equal_the_full_forms_for_every_code_point(spark):
    """The native part of the forms against unicodedata, for each code point (all planes that hold any letters) at both ends of a text, and in random texts."""
    import random

    random.seed(9)
    points = [c for c in [*range(1, 0x33480), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    texts = [f"{chr(c)}aB{chr(c)}" for c in points]
    low = [c for c in points if c < 0x3100]
    texts += ["".join(chr(random.choice(low)) for _ in range(random.randint(1, 6))) for _ in range(30_000)]
    texts += ["STRASSE straße", "ＦＵＬＬ　ｗｉｄｔｈ", "ﬁne", "é", "한", "ΟΔΟΣ", " \t x \n", "", "İ"]
    frame = spark.createDataFrame(pd.DataFrame({"t": texts}))
    rows = frame.select("t", t.lookup_form(F.col("t")).alias("l"), t.content_form(F.col("t")).alias("c"), t.is_plain(F.col("t")).alias("p")).toPandas()
    wrong = [(s, x, y) for s, x, y in zip(rows["t"], rows["l"], rows["c"]) if x != t.lookup_key(s) or y != t.content_key(s)]
    assert not wrong, wrong[:5]
    assert rows["p"].sum() > 120
    nothing = spark.createDataFrame([(None,)], "t string").select(t.lookup_form(F.col("t")), t.content_form(F.col("t"))).first()
    assert tuple(nothing) == (None, None)


def test_upper_by_letter(spark):
    """One letter for one, as the SQL twins' upper() has it; letters of the newest Unicode versions may be unknown to either."""
    import duckdb

    assert one(spark, t.upper_by_letter(F.col("x")), x="Straße ŉ ﬁ ᾀ é z") == "STRAẞE ŉ ﬁ ᾈ É Z"
    letters = [chr(i) for i in range(1, 0x10D50) if not 0xD800 <= i < 0xE000]
    pairs = spark.createDataFrame([(c,) for c in letters], "c string").select("c", t.upper_by_letter(F.col("c")).alias("u")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE letters AS SELECT unnest(?) AS c", [letters])
    sql = dict(con.execute("SELECT c, upper(c) FROM letters").fetchall())
    assert [(r.c, r.u, sql[r.c]) for r in pairs if r.u != sql[r.c]] == []
