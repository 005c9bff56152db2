"""URL filters: all glob rules at once, by a bit-parallel automaton over each canonical URL.

A glob matches the whole of "." + host + path: ``*`` is any run without ``/``, ``**`` any run, ``?`` one byte but ``/``. Every glob
holds one bit for its start and one for each literal, packed end to end over 64-bit words; a byte moves all of them by
one shift with carry and two masks (which bits the byte may reach, on which it may stay for a star). States of many URLs
advance together, one byte position at a time.

A rule of a host and a path prefix is the glob ``*.host`` + path + ``**``; of the matching rules the longest decides. Without a
rule, a URL that matches a blocking glob is blocked, any other allowed.

Defined results: a null URL or one without ``://`` has empty host and path and no rule. Null ids keep their rows; rows repeat as
given; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]
#: What is blocked where no rule fits.
GLOBS = ["*spam*.**", "*.cheap-*.**", "*casino*.**", "*-pills.**", "**/ads/**", "**/track/**", "**.exe", "**.zip"]


class Automaton:
    def __init__(self, globs: list[str]):
        """Masks of all globs. Per byte: reach, the bits that it may enter; stay, the bits on which a star keeps it."""
        places: list[tuple[bytes | None, str]] = []  # of each bit: the literal (None: a start, b"" any but a slash), the star behind it
        self.final: list[int] = []
        for glob in globs:
            data, i = glob.encode(), 0
            places.append((None, ""))
            while i < len(data):
                if data[i : i + 1] == b"*":
                    double = data[i : i + 2] == b"**"
                    places[-1] = (places[-1][0], "**" if double or places[-1][1] == "**" else "*")
                    i += 1 + double
                else:
                    places.append((b"" if data[i : i + 1] == b"?" else data[i : i + 1], ""))
                    i += 1
            self.final.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.reach, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for k, (literal, star) in enumerate(places):
            w, bit = k // 64, np.uint64(1 << (k % 64))
            if literal is None:
                self.start[w] |= bit
            for c in range(256):
                if literal is not None and (c != 47 if literal == b"" else literal[0] == c):
                    self.reach[c, w] |= bit
                if star == "**" or star == "*" and c != 47:
                    self.stay[c, w] |= bit

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x globs: which globs match the whole row."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, length = offsets[:-1][order], length[order]
        state = np.tile(self.start, (len(order), 1))
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, side="left"))  # rows longer than t
            c = data[begin[:n] + t]
            s = state[:n]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.reach[c]) | (s & self.stay[c])
        out = np.zeros((len(order), len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, globs: list[str] = GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url)."""
    automaton = Automaton([f"*.{r.host}{r.path}**" for r in rules] + globs)
    by_length = sorted(range(len(rules)), key=lambda k: len(rules[k].host) + len(rules[k].path))
    names = [r.host + r.path for r in rules]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "canonical"):
            hit = automaton.matches(*text_bytes(batch.column("canonical")))
            best = np.full(len(hit), -1)
            for k in by_length:
                best[hit[:, k]] = k
            method = hit[:, len(rules) :].any(axis=1)
            verdict = [rules[k].verdict if k >= 0 else "block" if m else "allow" for k, m in zip(best, method, strict=True)]
            rule = pa.array([names[k] if k >= 0 else None for k in best], pa.string())
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "path")), rule, pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return seen.withColumn("canonical", F.concat(F.lit("."), "host", "path")).mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def oracle_sql(rules: list[Rule] = RULES, globs: list[str] = GLOBS) -> str:
    """The same for DuckDB, over the view pages."""

    def pattern(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**", i):
                out, i = out + "(.|\n)*", i + 2
            else:
                c = glob[i]
                out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/-" else "\\" + c), i + 1
        return f"^{out}$".replace("'", "''")

    cases = "".join(f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.host}{r.path}'" for r in sorted(rules, key=lambda r: -len(r.host + r.path)))
    verdicts = "".join(f" WHEN rule = '{r.host}{r.path}' THEN '{r.verdict}'" for r in rules)
    blocked = " OR ".join(f"regexp_matches('.' || host || path, '{pattern(g)}')" for g in globs)
    return f"""WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE{cases} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE{verdicts} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
