"""URL filters: a bit-parallel wildcard automaton that follows all glob rules at once over each canonical URL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import table


@dataclass(frozen=True)
class Rule:
    """verdict for a host, all its subdomains, and the paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """Over '.' + host + path: '^' stands for any run without '/', '*' for any run."""
        return f"^.{self.host}{self.path}*"


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


class WildcardAutomaton:
    """Multiword Shift-And over UTF-8 bytes for patterns of literal bytes, '*' (any run) and '^' (any run without '/').

    Each pattern takes one bit for each literal byte and one for the state before them; the bits of all patterns lie in one row of 64-bit words.
    A state that a wildcard follows keeps itself alive on the bytes of its class, so a step is (states << 1 & literal[byte]) | (states & loop[byte]) for all patterns together.
    """

    def __init__(self, globs: list[str]):
        literal, loops, starts, finals, at = [], [], [], [], 0
        for glob in globs:
            starts.append(at)
            for byte in glob.encode():
                if byte in b"*^":
                    loops.append((at, byte == ord("^")))
                else:
                    at += 1
                    literal.append((at, byte))
            finals.append(at)
            at += 1
        self.words = at // 64 + 1
        self.literal, self.loop = np.zeros((2, 256, self.words), np.uint64)
        bit = lambda i: np.uint64(1 << (i % 64))
        for i, byte in literal:
            self.literal[byte, i // 64] |= bit(i)
        for i, within in loops:
            self.loop[[b for b in range(256) if not within or b != ord("/")], i // 64] |= bit(i)
        self.start = np.zeros(self.words, np.uint64)
        for i in starts:
            self.start[i // 64] |= bit(i)
        self.finals = np.array(finals)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Whether each pattern (column) matches each whole text (row). Texts step together, longest first, so that each step touches only those that go on."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        states = np.tile(self.start, (len(texts), 1))
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        going = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
        for i, n in enumerate(going):
            live, byte = states[:n], data[begins[:n] + i]
            shifted = live << np.uint64(1)
            shifted[:, 1:] |= live[:, :-1] >> np.uint64(63)
            states[:n] = (shifted & self.literal[byte]) | (live & self.loop[byte])
        out = np.empty((len(texts), len(self.finals)), bool)
        out[order] = (states[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64)) & np.uint64(1) != 0
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row.

    The longest rule that fits decides, the first of equally long ones; rule is null and verdict the default where none fits.
    Null and malformed urls have an empty host and path, so no rule fits. Repeated rows and null ids are kept; other columns are dropped. Nothing is shuffled.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [r.glob for r in ranked]
    names, verdicts = np.array([*(r.name for r in ranked), None], object), np.array([*(r.verdict for r in ranked), default], object)
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WildcardAutomaton(globs)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                texts = [f".{h}{p}".encode() for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)]
                fits = automaton.matches(texts)
                first = np.where(fits.any(1), fits.argmax(1), len(ranked)) if len(ranked) else np.zeros(len(texts), int)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[first], pa.string()), pa.array(verdicts[first], pa.string())], names=[*part.schema.names, "rule", "verdict"])

    return parts.mapInArrow(judged, StructType([*parts.schema, StructField("rule", StringType()), StructField("verdict", StringType())]))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP2_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k
      FROM p LEFT JOIN r ON ends_with('.' || p.host, '.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
