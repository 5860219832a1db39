"""URL rules held in Bloom filter cascades: exact membership without joins.

A rule is (host, path, action). It fits its host and all subdomains, where the url's path
starts with the rule's; the longest rule (host and path together, then host) wins. Rules
of one action are the listed keys of a cascade. The key universe is every key that any url
of the corpus can be asked about: each suffix of its host that is as long as some rule's
host, with each start of its path that is as long as some rule's path. Level 0 is a Bloom filter of the listed keys; level 1 one
of the universe's keys that pass level 0 without being listed; level 2 one of the listed
keys that pass level 1; and so on until a level lets nothing wrong pass. So the answer is
exact for every key of the universe, and hence for every url of the corpus.

The filters' bits are set by Spark (a bitwise-or for each word of 64 bits). Their size
follows the number of rules, and only with its logarithm the corpus; it is checked against
``MOST_BYTES`` before the filters are sent to the tasks. Rules, too, are counted first.

Nulls: a url that is null or has no ``://`` has an empty host and path, and no rule; a null
page_id is kept. Repeated rows are judged each for itself; of rules with the same host and
path the one with action ``block`` counts. An empty table gives no rows, no rules make every
url ``allow``. A long url is looked at whole; how many keys it has depends on the rules, not on its
length. A rule with an empty or null host, or a null path, fits no url. Keys are 64-bit hashes: among n distinct keys of
urls and r rules a key is taken for another with a chance of about n * r / 2^64. Other
columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.common import save

# The rules of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
MOST_BYTES = 64 << 20
MOST_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.expr("substr(_url, instr(_url, '://') + 3)"))
    host = F.regexp_extract(F.coalesce(after, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(after, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def parsed(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    return rows.select("page_id", host.alias("host"), path.alias("path"))


def candidate_keys(host_lengths: list[int], lengths: list[int]) -> Column:
    """Keys of host suffix and path start, longest first: array of struct(total, wide, key).

    Only suffixes and starts of the given lengths, as no other can be listed. A key starts with the length of its host, so host and path can't be mistaken for each other.
    """
    wide = ", ".join(str(n) for n in host_lengths if n) or "-1"
    whole_label = "n = length(host) or (n < length(host) and substr(host, length(host) - n, 1) = '.')"
    labels = f"transform(filter(array({wide}), n -> {whole_label}), n -> right(host, n))"
    starts = f"filter(array({', '.join(map(str, lengths)) or '0'}), n -> n <= length(path))"
    keys = (
        f"flatten(transform({labels}, h -> transform({starts}, n -> "
        "named_struct('total', length(h) + n, 'wide', length(h), 'key', concat(length(h), ':', h, substr(path, 1, n))))))"
    )
    return F.when(F.length("host") == 0, F.expr("filter(array(named_struct('total', 0, 'wide', 0, 'key', '')), x -> false)")).otherwise(
        F.sort_array(F.expr(keys), asc=False)
    )


@dataclass
class Level:
    bits: np.ndarray  # words of 64 bits
    size: int
    hashes: int
    salt: int

    def passes(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for i in range(self.hashes):
            at = _slot(h, self.salt, i, self.size)
            ok &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Whether keys, given as 64-bit hashes, are listed; exact for the universe it was built on."""
        answer, asked = np.zeros(len(h), bool), np.arange(len(h))
        for i, level in enumerate(self.levels):
            # What passes level i is taken for what it encodes until a later level passes it too.
            asked = asked[level.passes(h[asked])]
            answer[asked] = i % 2 == 0
        return answer

    def n_bytes(self) -> int:
        return sum(level.bits.nbytes for level in self.levels)


def _slot(h: np.ndarray, salt: int, i: int, size: int) -> np.ndarray:
    from trajlake.llm.words import mix64

    with np.errstate(over="ignore"):
        return (mix64(h + np.uint64((salt * 64 + i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the hashes ``h`` in ``keys``, of which there are n, with false positives at ``rate``."""
    hashes = max(1, round(-np.log2(rate)))
    size = 64 * max(1, int(np.ceil(-n * np.log(rate) / np.log(2) ** 2 / 64)))
    if size > 8 * MOST_BYTES:
        raise ValueError(f"a filter of {size // 8} bytes is beyond {MOST_BYTES}")

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h = frame["h"].to_numpy().view(np.uint64)
            at = np.concatenate([_slot(h, salt, i, size) for i in range(hashes)])
            yield pd.DataFrame({"word": at >> 6, "bit": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)})

    bits = np.zeros(size // 64, np.uint64)
    words = keys.mapInPandas(places, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, size, hashes, salt)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[level.passes(frame["h"].to_numpy().view(np.uint64))]

    return keys.mapInPandas(test, "h long")


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade of the hashes ``h`` in ``listed``, exact for all in ``universe`` and ``listed``; both distinct."""
    others = universe.join(listed, "h", "left_anti")
    cascade = Cascade()
    n, m = listed.count(), others.count()
    if not n:
        return cascade
    # The first level is as strict as makes the whole cascade smallest; the others halve what passes.
    rate = min(0.5, max(1e-6, n / (max(m, 1) * 2**0.5)))
    inside, outside = listed, others
    while n:
        cascade.levels.append(_level(inside, n, rate, len(cascade.levels)))
        outside = save(_passing(outside, cascade.levels[-1]), "passing")
        inside, outside = outside, inside
        n, rate = inside.count(), 0.5
    if cascade.n_bytes() > MOST_BYTES:
        raise ValueError(f"the filters take {cascade.n_bytes()} bytes, beyond {MOST_BYTES}")
    return cascade


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id``, ``url``)."""
    once = rules.dropna(subset=["host", "path"]).groupBy("host", "path").agg(F.max("action").alias("action"))
    if once.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    lengths = [sorted(r[0] for r in once.select(F.length(part)).distinct().collect()) for part in ("host", "path")]
    rows = save(parsed(pages), "urls")
    asked = rows.select("host", "path").distinct().select(F.explode(candidate_keys(*lengths)).alias("k"))
    universe = save(asked.select(_hash(F.col("k.key")).alias("h")).distinct(), "universe")
    cascades = {
        action: build(once.where(F.col("action") == action).select(_hash(F.concat(F.length("host"), F.lit(":"), "host", "path")).alias("h")).distinct(), universe)
        for action in ("allow", "block")
    }
    allow, block = cascades["allow"], cascades["block"]

    @F.pandas_udf("array<int>")
    def verdicts(hashes: pd.Series) -> pd.Series:
        """For each url, place (from 1) of its longest listed key and 1 if that is blocked; 0, 0 without any."""
        sizes = [len(x) for x in hashes]
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashes]).view(np.uint64) if sum(sizes) else np.zeros(0, np.uint64)
        blocked, allowed = block.contains(flat), allow.contains(flat)
        out, at = [], 0
        for n in sizes:
            hit = np.flatnonzero(blocked[at : at + n] | allowed[at : at + n])
            out.append([int(hit[0]) + 1, int(blocked[at + hit[0]])] if len(hit) else [0, 0])
            at += n
        return pd.Series(out)

    keyed = rows.withColumn("_k", candidate_keys(*lengths))
    keyed = keyed.withColumn("_v", verdicts(F.transform("_k", lambda k: _hash(k["key"]))))
    place = F.col("_v")[0]
    key = F.expr("element_at(_k, greatest(_v[0], 1)).key")
    rule = F.regexp_replace(key, r"^\d+:", "")
    verdict = F.when(place == 0, default).when(F.col("_v")[1] == 1, "block").otherwise("allow")
    return keyed.select("page_id", "host", "path", F.when(place > 0, rule).alias("rule"), verdict.alias("verdict"))
