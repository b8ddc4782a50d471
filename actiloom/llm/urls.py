"""URL rules by Bloom filter cascades.

A rule lists a key: a host and a path prefix. A url's keys are its host and every
parent domain, each with the prefixes of its path that have the length of some
rule's. Which of them are listed is asked of a cascade of Bloom filters: the first
holds the listed keys, the second the corpus's keys that the first takes for
listed though they are not, the third the listed keys that the second takes for
such, and so on, until nothing is mistaken. Over all keys of the corpus the
answers are exact, and no url is joined with a list.

The first level is sized for the rules. Its rate of false positives is set from
the number of distinct keys of the corpus, so that the second level has about as
many as there are rules; all levels together have a few bits per rule and
doubling of the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actiloom.llm.frames import pick

#: More rules than this are refused: the filters are broadcast.
MOST_RULES = 1_000_000
#: False positives of the levels behind the first.
RATE = 0.5
MOST_LEVELS = 60


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """``allow org/``: a verdict, a host, a path that begins with a slash."""
    verdict, key = line.split(" ", 1)
    host, slash, path = key.partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValueError(f"not a rule: {line}")
    return Rule(verdict, host, "/" + path)


class Bloom:
    def __init__(self, n: int, rate: float) -> None:
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.probes = max(1, round(self.bits / max(1, n) * math.log(2)))
        self.probes = min(self.probes, 30)
        self.words = np.zeros(self.bits // 64 + 1, np.uint64)

    def _places(self, keys: np.ndarray, level: int) -> np.ndarray:
        """A row of bit places for each key (two 64-bit hashes)."""
        a = keys[:, :1] ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
        step = keys[:, 1:] | np.uint64(1)
        x = a + step * np.arange(1, self.probes + 1, dtype=np.uint64)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return (x ^ x >> np.uint64(29)) % np.uint64(self.bits)

    def add(self, keys: np.ndarray, level: int) -> None:
        places = self._places(keys, level).ravel()
        np.bitwise_or.at(self.words, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        places = self._places(keys, level)
        return ((self.words[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1)).all(axis=1)


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is listed: the parity of the first level that denies it."""
        answer, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            passed = level.has(keys[left], depth)
            answer[left[~passed]] = depth % 2 == 1
            left = left[passed]
        answer[left] = len(self.levels) % 2 == 1
        return answer


def hashed(host: Column, path: Column) -> list[Column]:
    return [F.xxhash64(host, path).alias("key_a"), F.xxhash64(path, host, F.lit(7)).alias("key_b")]


def _keys(rows) -> np.ndarray:
    table = rows.toArrow()
    return np.stack([table[c].to_numpy().view(np.uint64) for c in ("key_a", "key_b")], axis=1) if len(table) else np.zeros((0, 2), np.uint64)


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that tells ``listed`` from the rest of ``universe`` (``key_a``, ``key_b``, distinct).

    On the driver are the listed keys and the universe's false positives at the
    first level, in expectation as many.
    """
    spark = listed.sparkSession
    inside = _keys(listed.distinct())
    if len(inside) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not len(inside):
        return Cascade([])
    others = universe.join(listed, ["key_a", "key_b"], "left_anti")
    rate = min(0.5, max(1e-9, len(inside) / max(1, others.count())))
    level = Bloom(len(inside), rate)
    level.add(inside, 0)
    first = spark.sparkContext.broadcast(level)

    def taken(batches):
        for batch in batches:
            keys = np.stack([batch[c].to_numpy().view(np.uint64) for c in ("key_a", "key_b")], axis=1)
            yield batch.filter(pa.array(first.value.has(keys, 0)))

    outside = _keys(others.select("key_a", "key_b").mapInArrow(taken, "key_a long, key_b long"))
    levels, encode, against = [level], outside, inside
    while len(encode):
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("keys with equal hashes are both listed and not")
        level = Bloom(len(encode), RATE)
        level.add(encode, len(levels))
        wrong = against[level.has(against, len(levels))]
        levels.append(level)
        encode, against = wrong, encode
    return Cascade(levels)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.expr("substring(url, locate('://', url) + 3)")
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest fitting rule decides (of two equal ones, block). Where none fits,
    ``rule`` is null and ``verdict`` is ``default``. A null url or one without
    ``://`` has neither host nor path, so no rule fits. Rows are judged each for
    itself; an empty table gives no rows; other columns are not looked at.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    rows = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(rule.path) for rule in rules})
    # Every parent domain with every prefix of a length that some rule has.
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.filter(
        F.transform(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: F.substring("path", F.lit(1), n)),
        lambda p: F.length(p) > 0,
    )
    prefixes = F.array_distinct(prefixes)
    pairs = F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.struct(d.alias("host"), p.alias("path")))))
    keyed = F.transform(pairs, lambda x: F.struct(x["host"].alias("host"), x["path"].alias("path"), *hashed(x["host"], x["path"])))
    each = rows.select("host", "path").distinct().select(F.explode(keyed).alias("k")).select("k.key_a", "k.key_b").distinct()
    cascades = {}
    for verdict in ("allow", "block"):
        listed = [(rule.host, rule.path) for rule in rules if rule.verdict == verdict]
        listed = spark.createDataFrame(listed, "host string, path string").select(*hashed(F.col("host"), F.col("path")))
        cascades[verdict] = build(listed, each)
    filters = spark.sparkContext.broadcast(cascades)

    def decide(batches):
        for batch in batches:
            keys = batch["keys"]
            flat = keys.flatten()
            both = np.stack([flat.field(c).to_numpy().view(np.uint64) for c in ("key_a", "key_b")], axis=1)
            member = {verdict: cascade.has(both) if len(both) else np.zeros(0, bool) for verdict, cascade in filters.value.items()}
            found = np.flatnonzero(member["allow"] | member["block"])
            starts = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            owner = np.searchsorted(starts, found, "right") - 1
            rule, verdict = [None] * len(batch), [default] * len(batch)
            best: dict[int, tuple] = {}
            for row, k in zip(owner.tolist(), found.tolist(), strict=True):
                key = flat[k]
                text = key["host"].as_py() + key["path"].as_py()
                blocked = bool(member["block"][k])
                if (len(text), blocked) > best.get(row, (-1, False))[:2]:
                    best[row] = (len(text), blocked, text)
            for row, (_, blocked, text) in best.items():
                rule[row], verdict[row] = text, "block" if blocked else "allow"
            out = {name: batch[name] for name in ("page_id", "host", "path")}
            yield pa.record_batch(out | {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())})

    schema = "page_id long, host string, path string, rule string, verdict string"
    return rows.withColumn("keys", keyed).mapInArrow(decide, schema)
