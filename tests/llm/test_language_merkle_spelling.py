"""Language kernel, Merkle manifest and spelling variants against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexforge.llm import language_kernel, merkle, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, leaf string, path int, lang_pred int"


def table(spark, rows, parts=3):
    """Documents with columns whose names the operators make themselves."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "clash", "clash", 1, 2) for i, t, lang, source in rows], SCHEMA).repartition(parts)


def words_of(seed, n, stems):
    random.seed(seed)
    return [random.choice(stems) for _ in range(n)]


# ---- spelling


def plain_variants(rows, least=7, slips=31):
    counts = Counter()
    for i, text, *_ in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            if slips and i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    by_word = {a: [b for b in words if near(a, b)] for a in words}
    form = {}
    for w, others in by_word.items():
        if others and words[best := min(others, key=lambda x: (-words[x], x))] >= 10 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(by_word[w]), form.get(w) or "", words[form[w]] if w in form else 0, root(w)) for w, n in words.items())


@pytest.fixture(scope="module")
def spelt():
    stems = ["language", "langage", "langauge", "languagé", "ßtrasse", "aaaaaaaa", "aaaaaaa", "aaaaaab", "Ünderway", "ünderway", "×crossed", "crossed÷", "letters", "lettters", "lettersx", "short"]
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " 12 \n", "en", "s"), (None, "language " * 30 + "langages langages", "en", "s")]
    rows += [(10 + i, " ".join(words_of(i, 40, stems)), "en", "s") for i in range(60)]
    # A chain of forms: each ten times as frequent as the one before.
    rows += [(200 + i, "Chainedaa " * 2 + "chainedab " * 20 + "chainedbb " * 200 + "chainebbb-" * 2000, "en", "s") for i in range(2)]
    return rows + [rows[10], rows[10], (900, "x" * 3_000_000 + " verylongword verylongwords verylongwords verylongword", "en", "s")]


def shaped(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


def test_spelling_variants(spark, spelt):
    assert shaped(spelling.variant_groups(table(spark, spelt))) == plain_variants(spelt)
    chain = {r[0]: r[5] for r in shaped(spelling.variant_groups(table(spark, spelt), slips=None))}
    assert chain["chainedaa"] == "chainebbb"


def test_spelling_in_several_ranges(spark, spelt, monkeypatch):
    monkeypatch.setattr(spelling, "TASK_WORDS", 7)
    assert shaped(spelling.variant_groups(table(spark, spelt), most_bits=256)) == plain_variants(spelt)


def test_spelling_of_nothing(spark):
    empty = table(spark, [(1, "a", "en", "s")]).limit(0)
    assert spelling.variant_groups(empty).collect() == []
    assert spelling.variant_groups(table(spark, [(1, None, None, None)])).collect() == []


def test_neighbourhood_is_whole_and_distinct():
    words, alphabet = ["abba", "aa", "b", "caab"], [ord(c) for c in "abc"]
    points, bounds = spelling.letters(pa.array(words))
    made = defaultdict(list)
    for letter, word, place, hashes in spelling.neighbours(points, bounds, np.array(alphabet)):
        texts = [spelling.edited(words[w], int(x), int(p)) for w, x, p in zip(word, letter, place)]
        assert (spelling.plain_hashes(*spelling.letters(pa.array(texts))) == hashes).all()
        for w, t in zip(word, texts):
            made[words[w]].append(t)
    for w in words:
        wanted = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abc"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abc"}
        assert sorted(made[w]) == sorted(wanted - {w})


# ---- Merkle


def plain_tree(leaves):
    """(root, siblings of each leaf from its run up)."""
    below, paths = list(leaves), [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(below) > 1:
        for i, spot in enumerate(at):
            run = below[spot // 8 * 8 : spot // 8 * 8 + 8]
            paths[i].append((spot % 8, run[: spot % 8] + run[spot % 8 + 1 :]))
        below = [sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)]
        at = [spot // 8 for spot in at]
    return below[0], paths


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(i, text, lang, source):
    values = (i, source, lang, None if text is None else len(text), text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[g] = (members, *plain_tree([plain_leaf(*r) for r in members]))
    root, upper = plain_tree([trees[g][1] for g in order])
    out = []
    for g, above in zip(order, upper):
        members, subroot, paths = trees[g]
        for r, path in zip(members, paths):
            i, text = r[0], r[1]
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
                text = text.translate(LOW)
            # n_chars is that of the untouched text, whose length lower-casing keeps.
            acc = plain_leaf(i, text, g, r[3])
            for place, others in path + above:
                acc = sha("".join(others[:place]) + acc + "".join(others[place:]))
            proof = sha("".join("".join(others) for _, others in path + above))
            out.append(repr((i, plain_leaf(*r), subroot, root, proof, acc, acc == root)))
    return sorted(out)


def manifest_rows(df):
    rows = merkle.manifest(df, claimed=merkle.tampered(df)).withColumn("f", merkle.folded(F.col("claimed"), F.col("path")))
    got = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("p"), "f", (F.col("f") == F.col("root")).alias("ok")).collect()
    return sorted(repr(tuple(r)) for r in got)


@pytest.mark.parametrize("size", [1, 2, 8, 9, 65, 300])
def test_manifest(spark, size):
    random.seed(size)
    langs = ["en"] * 5 + ["de", "", None, "é"]
    rows = [(random.randint(-50, 50) if i % 9 else None, random.choice([None, "", "Some TEXT", "lower", "Ünder A " * i]), random.choice(langs), random.choice([None, "s1"])) for i in range(size)]
    rows += rows[:2]
    assert manifest_rows(table(spark, rows)) == plain_manifest(rows)


def test_manifest_of_one_row_and_none(spark):
    one = [(7, "Only ONE", "en", "s")]
    assert manifest_rows(table(spark, one)) == plain_manifest(one)
    assert manifest_rows(table(spark, one).limit(0)) == []


def test_one_hot_group_is_dealt_out(spark):
    """Windows hold a run each: no plan of a level partitions by the group alone."""
    docs = table(spark, [(i, "t", "en", "s") for i in range(200)])
    plan = merkle.manifest(docs)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "collect_list" in line and "Window " in line]
    assert windows and all("parent" in line for line in windows)


# ---- languages

SYLLABLES = {"en": ["the", "ing", "and", "sh", "ow"], "de": ["sch", "ung", "ein", "ä", "ß"], "ru": ["ов", "на", "ст", "ени", "ра"]}


def prose(lang, seed, words=40):
    random.seed(f"{lang}{seed}")
    return " ".join("".join(random.choice(SYLLABLES[lang]) for _ in range(random.randint(1, 4))) for _ in range(words))


def test_languages_are_learned_from_permitted_rows_only(spark):
    rows = [(i, prose(lang, i), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 60)]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    # Held-out rows bear a wrong label: it must not be learned.
    rows = [(i, t, "zz" if i in held else lang, s) for i, t, lang, s in rows]
    truth = {i: lang for i, lang in enumerate(list(SYLLABLES) * 60)}
    docs = table(spark, rows)
    model = language_kernel.train(docs, sample_texts=90, landmarks=30, known_grams=2000)
    assert model.languages == ["de", "en", "ru"]
    found = language_kernel.add_languages(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found if r.doc_id in held]) > 0.95
    assert [c for c in docs.columns if c != "lang_pred"] + ["lang_pred", "score"] == language_kernel.add_languages(docs, model).columns
    again = language_kernel.add_languages(docs.repartition(7), language_kernel.train(docs.repartition(7), 90, 30, 2000)).collect()
    by_id = lambda rows: sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in rows)
    assert by_id(again) == by_id(found)


def test_texts_without_letters_and_long_ones(spark):
    rows = [(i, prose(lang, i), lang, "s") for i, lang in enumerate(["en", "de"] * 40)]
    model = language_kernel.train(table(spark, rows))
    odd = [(1, None, "en", None), (2, "", None, "s"), (3, "12 !? \n", "de", "s"), (4, "漢字", "en", "s"), (5, prose("de", 5, 600_000), "en", "s"), (5, prose("de", 5, 600_000), "en", "s"), (None, prose("en", 1), None, None), (6, "THE ING AND!! SHOW", "x", "s")]
    found = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in language_kernel.add_languages(table(spark, odd), model).collect()))
    assert [f[1] for f in found][:4] == ["en", "und", "und", "und"] and [f[1] for f in found][5:] == ["de", "de", "en"]
    assert [f[2] for f in found[1:4]] == [0.0, 0.0, 0.0] and all(0 <= f[2] <= 1 for f in found)


def test_no_language_learned(spark):
    docs = table(spark, [(1, "some text", None, "s"), (2, None, "en", "s"), (None, "text", "en", "s")])
    model = language_kernel.train(docs)
    assert model.languages == []
    assert [(r.lang_pred, r.score) for r in language_kernel.add_languages(docs, model).collect()] == [("und", 0.0)] * 3
    assert language_kernel.add_languages(docs.limit(0), model).collect() == []


def test_presence_kernel_against_sets():
    texts = ["abab", "b", "abcabcabcd" * 3, ""]
    grams = {n: [t.encode()[i : i + n] for t in texts for i in range(len(t) - n + 1)] for n in range(1, 5)}
    codes = {(n, g): int.from_bytes(g, "big") | (n << 40) for n, found in grams.items() for g in found}
    known = np.array(sorted(set(codes.values())), np.int64)
    tables, kept = language_kernel.looked_up(known)
    [(start, rows)] = language_kernel.presence(pa.array(texts), known, tables, kept)
    held = [{codes[n, t.encode()[i : i + n]] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    assert start == 0 and [set(known[r > 0]) for r in rows] == held
    marks = rows[:3] / np.sqrt(rows[:3].sum(axis=1, keepdims=True))
    wanted = [[len(a & b) / (max(1, len(a)) * len(b)) ** 0.5 for b in held[:3]] for a in held]
    assert np.allclose(language_kernel.kernels(rows, marks), wanted)
