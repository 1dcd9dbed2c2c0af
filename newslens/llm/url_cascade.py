"""URL filters: allow and block lists in Bloom filter cascades, in DataFrame functions only.

A rule is a key: host, slash, path ("example.com/en/"). It fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's, so the rules that could fit a URL are known: each suffix of its host at a dot, with each
prefix of its path as long as some rule's path. These candidates, over all URLs of the corpus, are the key universe.

A cascade encodes one list against that universe. Level 1 is a Bloom filter of the listed keys. Level 2 holds the keys of
the universe that level 1 takes for listed but aren't, level 3 the listed keys that level 2 then takes for false, and so on
until no error is left. A key of the universe is listed exactly if the first level that misses it is an even one. So
membership of every candidate is exact, and judging needs no join: a filter is a literal array of longs.

Filters are built by distributed aggregation (bit positions from xxhash64, ored into words); BITS bits a key and level, so
level 1 grows with the list, and later levels with its false positives, each about a hundredth of what it is tested
against. MOST_WORDS bounds what a plan may carry; a list beyond it is refused with an error, never cut.

Cases: a null URL, or one without "://", has empty host and path, which no rule fits; empty lists and tables work (every
URL gets the default verdict); a key on both lists is blocked; repeated rows repeat; a URL of any length is judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.common import stage

BITS = 10
HASHES = 7
MOST_WORDS = 1 << 20
DEFAULT = "allow"


class Bloom:
    """One level: 2**log bits as longs, in a literal."""

    def __init__(self, words: list[int], log: int, seed: int):
        self.words, self.log, self.seed = words, log, seed

    def holds(self, key: Column) -> Column:
        words = F.array(*[F.lit(w).cast("bigint") for w in self.words])
        out = F.lit(True)
        for k in range(HASHES):
            bit = _position(key, self.seed, k, self.log)
            out = out & (F.get(words, F.shiftright(bit, 6).cast("int")).bitwiseAND(_mask(bit)) != 0)
        return out


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def _position(key: Column, seed: int, k: int, log: int) -> Column:
    """Bit k of a key in a filter of 2**log bits: double hashing."""
    one, two = F.xxhash64(F.lit(seed), key), F.xxhash64(F.lit(seed + 1), key)
    mask = F.lit((1 << log) - 1).cast("bigint")
    half = F.lit((1 << 31) - 1).cast("bigint")
    return (one.bitwiseAND(half) + F.lit(k) * two.bitwiseAND(half)).bitwiseAND(mask)


def build_level(keys: DataFrame, seed: int) -> Bloom | None:
    """The Bloom filter of keys (key); None if there are none."""
    n = keys.count()
    if not n:
        return None
    log = max(6, (n * BITS - 1).bit_length())
    if (1 << log) // 64 > MOST_WORDS:
        raise ValueError(f"{n} keys need a filter of {1 << log} bits, more than a plan may carry")
    spots = keys.select(F.explode(F.array(*[_position(F.col("key"), seed, k, log) for k in range(HASHES)])).alias("bit"))
    rows = spots.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(_mask(F.col("bit"))).alias("bits")).collect()
    words = [0] * ((1 << log) // 64)
    for row in rows:
        words[row.word] = row.bits
    return Bloom(words, log, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 1) -> list[Bloom]:
    """Levels that tell listed keys from the other keys of the universe; both have one column, key."""
    listed = listed.where("key is not null").distinct()
    inside, outside = listed, universe.join(listed, "key", "left_anti").distinct()
    levels: list[Bloom] = []
    while True:
        level = build_level(inside, seed + 2 * len(levels))
        if level is None:
            return levels
        levels.append(level)
        wrong = stage(outside.where(level.holds(F.col("key"))), "cascade")
        inside, outside = wrong, inside


def member(levels: list[Bloom], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def _listed(levels: list[Bloom], keys: Column) -> Column:
    return F.filter(keys, lambda k: member(levels, k))


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path: see the module's cases."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lowered, "path": path})


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys of all rules that could fit, longest first: host suffixes by number of labels, path prefixes by length."""
    labels = F.split(host, "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.char_length(path) >= n, F.substring(path, F.lit(1), n))), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    # of equal length, the longer host: it was generated first, and the sort is by length, then text
    sized = F.array_distinct(F.transform(keys, lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("key"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(sized), lambda s: s["key"]))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id_col, host, path, rule, verdict) of every page. rules: host, path, verdict (allow or block). The longest rule that
    fits decides; without one, rule is null and the verdict is ``default``."""
    listed = rules.select(F.concat("host", "path").alias("key"), F.char_length("path").alias("n"), "verdict")
    lengths = sorted(r.n for r in listed.select("n").distinct().collect() if r.n is not None)
    urls = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")), "url")
    urls = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    # outer: a plain explode would evaluate the keys once more, in a filter that Spark infers
    universe = stage(urls.select(F.explode_outer("keys").alias("key")).where("key is not null").distinct(), "universe")
    lists = {v: build_cascade(listed.where(F.col("verdict") == v).select("key"), universe) for v in ("block", "allow")}
    urls = urls.withColumns({v: F.get(_listed(lists[v], F.col("keys")), F.lit(0)) for v in lists})
    by_block = F.col("block").isNotNull() & (F.col("allow").isNull() | (F.char_length("block") >= F.char_length("allow")))
    rule = F.when(by_block, F.col("block")).otherwise(F.col("allow"))
    verdict = F.when(by_block, F.lit("block")).when(F.col("allow").isNotNull(), F.lit("allow")).otherwise(F.lit(default))
    return urls.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (host, path, verdict) triples."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
