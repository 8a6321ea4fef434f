"""Selectors of fused candidates that depend on what was selected before: one bounded group of candidates per query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup_key

#: Candidates of a query that a selector sees (20 variants of 200 hits have no more), and rows of one work before the others are filled up.
MOST_CANDIDATES, EACH_WORK = 4000, 2
ORDER = {"line": 0, "poem": 1, "note": 2}
RESULT = "query_id long, place long, chunk_id long, work_id long, hard_filtered boolean"


class Picker:
    """Candidates of one query in rank order, and the ones picked so far."""

    def __init__(self, rows: pd.DataFrame, terms, limit: int):
        self.rows = rows.sort_values("rank").to_dict("records")
        for r in self.rows:
            r["key"], r["title_key"] = lookup_key(r["text"]), lookup_key(r["title"])
            r["grain"] = ORDER.get(r["granularity"], 99)
            r["overlap"] = self.overlap(r["key"], terms)
        self.limit, self.picked, self.used = limit, [], {}

    @staticmethod
    def overlap(text: str, terms) -> int:
        return sum(len(lookup_key(t)) ** 2 for t in terms if t and lookup_key(t) in text)

    @property
    def full(self) -> bool:
        return len(self.picked) >= self.limit

    def pick(self, row) -> None:
        self.picked.append(row)
        self.used[row["work_id"]] = self.used.get(row["work_id"], 0) + 1

    def open(self) -> list[dict]:
        chosen = {r["chunk_id"] for r in self.picked}
        return [r for r in self.rows if r["chunk_id"] not in chosen]

    def fill(self, each: int | None) -> None:
        for r in self.open():
            if self.full:
                return
            if each is None or self.used.get(r["work_id"], 0) < each:
                self.pick(r)

    def titled(self, title: str, tail: bool, primary: bool) -> dict | None:
        """The best open candidate of a title.

        With tail the last line wins. Else candidates that overlap the terms come before whole texts, these
        before lines, these before notes; primary leaves notes out where it can, and lines where a whole
        text overlaps.
        """
        want = lookup_key(title)
        fits = lambda key: key == want or key.startswith(want) and not "㐀" <= key[len(want)] <= "鿿"
        found = [r for r in self.open() if want and fits(r["title_key"])]
        if not found:
            return None
        lined = [r for r in found if r["line_start"] is not None and not pd.isna(r["line_start"])]
        if tail and lined:
            return min(lined, key=lambda r: (-r["line_start"], -r["overlap"], -r["rrf"], r["best_rank"], r["chunk_id"]))
        if primary:
            found = [r for r in found if r["granularity"] != "note"] or found
            found = [r for r in found if r["granularity"] == "poem" and r["overlap"] > 0] or found
        tiers = (([r for r in found if r["overlap"] > 0], True), ([r for r in found if r["granularity"] == "poem"], False), ([r for r in found if r["granularity"] != "note"], False), (found, False))
        rows, overlapping = next(t for t in tiers if t[0])
        return min(rows, key=lambda r: (-r["overlap"] if overlapping else 0, -r["rrf"], r["grain"], r["best_rank"], r["chunk_id"]))

    def of_group(self, terms, anchors) -> dict | None:
        """The finest of the open candidates within a quarter of the group's best score, of a work not used yet if there is one."""

        def score(r: dict) -> int:
            anchor = 2 * self.overlap(r["key"], anchors) + 3 * self.overlap(r["title_key"], anchors)
            return (self.overlap(r["key"], terms) + self.overlap(r["title_key"], terms)) * (2 if anchor else 1) + anchor

        for rows in ([r for r in self.open() if r["work_id"] not in self.used], self.open()):
            scored = [(s, r) for r in rows if (s := score(r)) > 0]
            if scored:
                best = max(s for s, _ in scored)
                return min(((s, r) for s, r in scored if s >= 0.75 * best), key=lambda x: (x[1]["grain"], -x[0], -x[1]["rrf"], x[1]["best_rank"], x[1]["chunk_id"]))[1]
        return None

    def frame(self, query: int, hard: bool) -> pd.DataFrame:
        rows = [(query, i, r["chunk_id"], r["work_id"], False) for i, r in enumerate(self.picked[: self.limit], 1)]
        if hard:
            rows = [(query, None, None, None, True)]
        return pd.DataFrame(rows, columns=["query_id", "place", "chunk_id", "work_id", "hard_filtered"]).astype({"place": "Int64", "chunk_id": "Int64", "work_id": "Int64"})


def applied(ranked: DataFrame, wanted: DataFrame, run) -> DataFrame:
    rows = ranked.where(F.col("rank") <= MOST_CANDIDATES).join(wanted, "query_id")
    return rows.groupBy("query_id").applyInPandas(run, RESULT)


def explicit_titles(ranked: DataFrame, wanted: DataFrame, k: int, diversify: bool = False, tail: bool = False, primary: bool = False) -> DataFrame:
    """Candidates of the titles that a query names, then the rest by rank.

    ranked: query_id, rank, chunk_id, work_id, title, granularity, text, line_start, rrf, best_rank; wanted:
    query_id, titles, terms. A title without a candidate empties the query's result, which then is one row
    with hard_filtered. A single title also brings the whole text of its work. diversify, tail and primary
    may also be columns of wanted, for each query its own.
    """
    flags = {"diversify": diversify, "tail": tail, "primary": primary}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        diversify, tail, primary = (bool(first.get(name, value)) for name, value in flags.items())
        picker = Picker(rows, first["terms"], k)
        for title in first["titles"]:
            row = picker.titled(title, tail, primary)
            if row is None:
                return picker.frame(int(first["query_id"]), True)
            picker.pick(row)
            if picker.full:
                return picker.frame(int(first["query_id"]), False)
        if not diversify and picker.picked:
            whole = next((r for r in picker.open() if r["work_id"] == picker.picked[0]["work_id"] and r["granularity"] == "poem"), None)
            if whole:
                picker.pick(whole)
        picker.fill(EACH_WORK if diversify else None)
        return picker.frame(int(first["query_id"]), False)

    return applied(ranked, wanted, run)


def multi_evidence(ranked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """One candidate for each title and each group of terms, then at most two of a work by rank, then the rest.

    wanted: query_id, titles, terms, groups (array<array<string>>), anchors (one list for each group).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        picker = Picker(rows, first["terms"], k)
        for title in first["titles"]:
            row = None if picker.full else picker.titled(title, False, False)
            if row is not None:
                picker.pick(row)
        for i, group in enumerate(first["groups"]):
            row = None if picker.full else picker.of_group(group, first["anchors"][i] if i < len(first["anchors"]) else ())
            if row is not None:
                picker.pick(row)
        picker.fill(EACH_WORK)
        picker.fill(None)
        return picker.frame(int(first["query_id"]), False)

    return applied(ranked, wanted, run)
