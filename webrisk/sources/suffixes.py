"""Rules of public suffixes as small tables, one per number of labels."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: More rules than this aren't a suffix list; it also bounds what is sent to the executors.
MOST_RULES = 200_000
PRIVATE_FROM, PRIVATE_TO = "===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS==="


@dataclass(frozen=True)
class SuffixRules:
    """levels[k-1]: (suffix, exact, wild, exception) for the rules whose own labels are k in number.

    `exact`: the suffix itself is a rule; `wild`: any label before it belongs to the suffix; `exception`: the suffix starts one label later.
    """

    levels: tuple[DataFrame, ...]


def parse_rules(lines: Iterable[str], private: bool) -> list[str]:
    """Rules of the list format: one per line, comments behind //, private domains between markers."""
    out, inside = [], False
    for line in lines:
        inside = (inside or PRIVATE_FROM in line) and PRIVATE_TO not in line
        words = line.split()
        if words and not words[0].startswith("//") and (private or not inside):
            out.append(words[0])
    return out


def _bundled(data: bytes, private: bool) -> list[str]:
    """Rules of the Java runtime's copy: an archive with a file per ending, whose lines begin with 0 or 1 (private)."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for name in archive.namelist():
            for line in archive.read(name).decode("utf-8").splitlines():
                if line and (private or line[0] == "\0"):
                    out.append(line[1:])
    return out


def _table(rules: Iterable[str]) -> dict[str, list[bool]]:
    """Suffix to [exact, wild, exception], in lower case and, for other scripts, in the form used in URLs as well."""
    found: dict[str, list[bool]] = {}
    for rule in rules:
        kind = 1 if rule.startswith("*.") else 2 if rule.startswith("!") else 0
        bare = rule[2:] if kind == 1 else rule[1:] if kind == 2 else rule
        names = {bare.lower()}
        if not bare.isascii():
            names.add(bare.encode("idna").decode())
        for name in names:
            found.setdefault(name, [False, False, False])[kind] = True
    return found


def make_rules(spark: SparkSession, rules: Iterable[str]) -> SuffixRules:
    table = _table(rules)
    if not table or len(table) > MOST_RULES:
        raise ValueError(f"{len(table)} suffix rules")
    by_depth: dict[int, list] = {}
    for name, flags in table.items():
        by_depth.setdefault(name.count(".") + 1, []).append((name, *flags))
    levels = []
    for k in range(1, max(by_depth) + 1):
        names, exact, wild, exception = zip(*by_depth.get(k, [("", False, False, False)]), strict=True)
        levels.append(spark.createDataFrame(pa.table({
            "suffix": pa.array(names, pa.string()), "exact": pa.array(exact, pa.bool_()),
            "wild": pa.array(wild, pa.bool_()), "exception": pa.array(exception, pa.bool_())})))
    return SuffixRules(tuple(levels))


_KNOWN: WeakKeyDictionary = WeakKeyDictionary()


def suffix_rules(spark: SparkSession, path: str | None = None, private: bool = False) -> SuffixRules:
    """Rules of a suffix list that Spark can read, by default of the copy that the Java runtime brings along.

    Private domains (hosting services and the like) count as suffixes only on request.
    """
    known = _KNOWN.setdefault(spark, {})
    if (path, private) not in known:
        if path is not None:
            rules = parse_rules((r.value for r in spark.read.text(path, wholetext=False).coalesce(1).limit(2 * MOST_RULES).toLocalIterator()), private)
        else:
            home = spark.sparkContext._jvm.java.lang.System.getProperty("java.home")
            own = os.path.join(home, "lib", "security", "public_suffix_list.dat")
            if not os.path.exists(own):
                raise FileNotFoundError(f"{own}: name a public suffix list with suffix_rules(spark, path)")
            with open(own, "rb") as f:
                rules = _bundled(f.read(), private)
        known[path, private] = make_rules(spark, rules)
    return known[path, private]
